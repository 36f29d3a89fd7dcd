"""Readers of texts, JSON and sample files."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X

RULE = "-" * 72


class MissingInput(FileNotFoundError):
    """An input that a query needs is not there."""


def require(spark: SparkSession, path: str) -> str:
    """The path, if anything lies there in whatever store; else MissingInput."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise MissingInput(f"missing input: {path}")
    return path


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file, value): one row for each file, line ends made LF, bytes that are not UTF-8 replaced."""
    for p in [paths] if isinstance(paths, str) else paths:
        require(spark, p)
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), X.newlines(F.decode("content", "UTF-8")).alias("value"))


def setting(spark: SparkSession, name: str, variable: str, default: str) -> str:
    """A path from the session's settings, else from the environment, else the default."""
    return spark.conf.get(name, None) or os.environ.get(variable) or default


def read_log_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_rank, seq, line): lines of log files in the order of ``paths``; missing files are skipped.

    Files are split as Spark's text source does, so a large one is many tasks. ``seq`` ascends with the place in the file: it is
    the first byte of the split plus the number of the line in it, and a line has one byte at least.
    """
    out = None
    for rank, p in enumerate(paths):
        try:
            require(spark, p)
        except MissingInput:
            continue
        raw = spark.read.text(p).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
        first = raw.groupBy("f", "b").agg(F.min("i").alias("i0"))
        one = raw.join(first, ["f", "b"]).select(F.lit(rank).alias("file_rank"), (F.col("b") + F.col("i") - F.col("i0")).alias("seq"), "line")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "file_rank int, seq long, line string")


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """A JSON document (or JSON lines) with a fixed schema; blank lines are skipped."""
    require(spark, path)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of files that hold either an array of them or an object with the array under ``records``."""
    raw = read_documents(spark, path).select("file", "value")
    as_object = F.from_json("value", f"records array<{record}>")["records"]
    as_array = F.from_json("value", f"array<{record}>")
    return raw.select("file", F.explode(F.when(F.trim("value").startswith("["), as_array).otherwise(as_object)).alias("r")).select("file", "r.*")


def parse_header(md: Column) -> dict[str, Column]:
    """source, written and body of a note: marks from its first six lines, the body after leading ``#`` and blank lines."""
    lines = F.split(md, "\n")
    head = F.slice(lines, 1, 6)

    def field(name: str) -> Column:
        found = F.filter(head, lambda x: F.startswith(x, F.lit(f"# {name}:")))
        return X.strip(F.substring(F.try_element_at(found, F.size(found)), len(name) + 4, 1 << 20))

    body = F.regexp_replace(md, rf"\A(?:#[^\n]*(?:\n|\z)|{X.SPACE_IN_LINE}*(?:\n|\z))*", "")
    return {"source": field("source"), "written": field("written"), "body": X.strip(body)}


def render_sample(header: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), header, F.lit(f"\n{RULE}\n"), body)


def parse_sample(value: Column, numbers: list[str]) -> dict[str, Column]:
    """Named numbers of a sample's header, NULL where it has none, and its body after the rule."""
    parts = F.split(value, f"\n{RULE}\n", 2)
    head = F.element_at(parts, 1)
    out: dict[str, Column] = {n: F.try_to_number(F.nullif(F.regexp_extract(head, rf"\b{n}[=: ]\s*([0-9.]+)", 1), F.lit("")), F.lit("999999999999.999999")).cast("double") for n in numbers}
    return out | {"body": F.element_at(parts, -1)}


def read_samples(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """(config, slug, numbers, body) of files ``<config>__<slug>.txt``."""
    name = F.split(F.regexp_replace("file", r"\.txt$", ""), "__", 2)
    raw = read_documents(spark, path)
    return raw.select(F.element_at(name, 1).alias("config"), F.element_at(name, -1).alias("slug"), *[c.alias(n) for n, c in parse_sample(F.col("value"), numbers).items()])


def strip_known_prefix(text: Column, prefix: Column) -> Column:
    return F.when(F.startswith(text, prefix), F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)


def discover(spark: SparkSession, pattern: str, marker: str) -> list[str]:
    """Names of the folders that match a glob and hold the file ``marker``, sorted."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{pattern}/{marker}")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(PurePosixPath(x.getPath().toUri().getPath()).parent.name for x in found)


def snapshot_or_live(spark: SparkSession, path: str, cut: Callable[[], DataFrame]) -> DataFrame:
    """The frozen table at ``path``; where there is none, ``cut()`` is written there first."""
    try:
        require(spark, path)
    except MissingInput:
        cut().write.parquet(path)
    return spark.read.parquet(path)


#: Seconds that an outside program may take for a slice.
PROGRAM_SECONDS = 180


def program(argv: list[str], seconds: float = PROGRAM_SECONDS) -> Callable[[str], str]:
    """Runs an outside program with a text as its input; its output. Raises if it fails or takes longer."""

    def run(text: str) -> str:
        return subprocess.run(argv, input=text, capture_output=True, text=True, timeout=seconds, check=True).stdout.strip()

    return run


def day_slices(log: DataFrame, ts: str, seq: str, line: str) -> DataFrame:
    """(day, text): the lines of each day in order."""
    at = F.array_sort(F.collect_list(F.struct(ts, seq, line)))
    return log.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.array_join(F.transform(at, lambda x: x[line]), "\n").alias("text"))


def external(slices: DataFrame, key: str, text: str, run: Callable[[str], str | None]) -> DataFrame:
    """(key, output, failed): each text through an outside program; a failure is noted and does not stop the others."""

    def each(batches):
        for b in batches:
            done = []
            for k, t in zip(b[key], b[text], strict=True):
                try:
                    done.append((k, run(t), None))
                except Exception as e:  # noqa: BLE001  whatever the program raises is the note
                    done.append((k, None, str(e)[:500]))
            yield type(b)(done, columns=[key, "output", "failed"])

    return slices.select(key, text).mapInPandas(each, f"`{key}` {slices.schema[key].dataType.simpleString()}, output string, failed string")
