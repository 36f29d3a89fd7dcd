"""Writers of texts, JSON, samples and provenance, and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import RULE


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; characters beyond ASCII as they are."""
    df.write.mode("overwrite").json(path)


def write_samples(df: DataFrame, path: str, keys: list[str], header: str, body: str) -> None:
    """One folder for each key, holding header, rule and body."""
    made = df.select(*keys, F.concat(F.lit("# "), F.col(header), F.lit(f"\n{RULE}\n"), F.col(body)).alias("value"))
    made.write.mode("overwrite").partitionBy(*keys).text(path)


def upsert_variants(rows: DataFrame, path: str, training: str, written: str) -> None:
    """Write (variant, ...) rows under ``path``/rows: a variant's folder is replaced by its new rows, others stay as they are.

    A line of provenance for each variant is put under ``path``/provenance in the folder of its run, so a rerun of the same
    (training, written) replaces its own lines and a writer that failed half-way can simply be run again.
    """
    dynamic = {"partitionOverwriteMode": "dynamic"}
    rows.write.mode("overwrite").options(**dynamic).partitionBy("variant").parquet(f"{path}/rows")
    made = rows.select("variant").distinct().select("variant", F.lit(training).alias("training"), F.lit(written).alias("written"), F.concat_ws("_", F.lit(written), F.lit(training)).alias("run"))
    made.write.mode("overwrite").options(**dynamic).partitionBy("run").parquet(f"{path}/provenance")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all variants with the training and time of the latest run that wrote each."""
    prov = spark.read.parquet(f"{path}/provenance").select("variant", "training", "written")
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(record_provenance(prov.limit(0), prov)), "variant", "left")  # a row for each variant folder


def record_provenance(old: DataFrame, new: DataFrame) -> DataFrame:
    """Provenance (variant, training, written): of each variant the latest entry."""
    return old.unionByName(new).groupBy("variant").agg(F.max_by("training", "written").alias("training"), F.max("written").alias("written"))


def format_table(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    """A Markdown table of a small result; numbers are formatted here and nowhere before."""
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def quality_notes(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(note, n): how many rows meet each named SQL condition."""
    counts = df.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("note"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")
