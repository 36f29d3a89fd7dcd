"""Pair sets by name in SQL: ``select * from pairs('session', 64, 16)``.

Loaders are frames of (name, grp, source, summary). They become one table function, which Spark inlines into the query that
calls it: with a literal name only that set's plan is left, and filters and columns reach its scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["name", "grp", "source", "summary"]


def from_variants(rows: DataFrame, name: str, group: str, source: str, summary: str = "text", variant: str = "variant") -> DataFrame:
    """(pair_set, name, grp, source, summary): every variant on disk is a set of its own, so a new one needs no code."""
    return rows.select(F.col(variant).alias("pair_set"), *[F.col(c).alias(a) for c, a in zip((name, group, source, summary), COLUMNS, strict=True)])


def register(spark: SparkSession, sets: dict[str, DataFrame], variants: DataFrame | None = None, function: str = "pairs") -> None:
    """Make the temporary table function ``function(wanted, least_source, least_summary)``.

    It returns (pair_set, name, grp, source, summary, reason): the pairs of the set ``wanted``, all sets where that is null, with the
    reason why a pair is not scored, null if it is. A set of ``sets`` hides a variant of the same name. An unknown name gives no rows.
    """
    branches = []
    for i, (name, df) in enumerate(sorted(sets.items())):
        df.select(*[F.col(c).cast("string") for c in COLUMNS]).createOrReplaceTempView(f"{function}_set{i}")
        literal = name.replace("\\", "\\\\").replace("'", "\\'")
        branches.append(f"select '{literal}' as pair_set, {', '.join(COLUMNS)} from {function}_set{i}")
    if variants is not None:
        own = variants.select(*[F.col(c).cast("string") for c in ("pair_set", *COLUMNS)])
        own.where(~F.col("pair_set").isin(sorted(sets))).createOrReplaceTempView(f"{function}_variants")
        branches.append(f"select pair_set, {', '.join(COLUMNS)} from {function}_variants")
    if not branches:
        raise ValueError("no pair sets")
    reason = """case when coalesce(length(source), 0) = 0 then 'no source' when coalesce(length(summary), 0) = 0 then 'no summary'
      when size(split(source, ' ')) < least_source then 'short source' when size(split(summary, ' ')) < least_summary then 'short summary' end"""
    spark.sql(f"""create or replace temporary function {function}(wanted string, least_source int default 0, least_summary int default 0)
      returns table (pair_set string, name string, grp string, source string, summary string, reason string)
      return select pair_set, name, grp, source, summary, {reason} from ({' union all '.join(branches)}) where wanted is null or pair_set = wanted""")
