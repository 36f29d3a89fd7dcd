"""Structured Streaming over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.windows import parse_line


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream of lines."""
    return spark.readStream.format("text").load(folder).select(F.col("value").alias("line"))


def read_entries(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def entries(lines: DataFrame) -> DataFrame:
    """Parsed header lines."""
    return lines.select(*[c.alias(n) for n, c in parse_line(F.col("line")).items()]).where("ts is not null")


def deduped(log: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: snapshots that repeat entries add nothing."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counts(log: DataFrame, by: str, window: str = "1 hour", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Entries of each key in tumbling windows of event time."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"))
