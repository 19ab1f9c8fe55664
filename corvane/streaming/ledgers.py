"""Append-only logs as streams: the batch forms of the usage meter and of the ledger, kept up to date.

The library has no streaming semantics of its own; these are the same aggregates over a log
that grows. Late lines are taken until the watermark passes their day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of JSON-lines files, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def daily_usage(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(source, kind, day, calls, usd) of usage lines (time, source, kind, usd)."""
    rows = log.withWatermark("time", late)
    sums = rows.groupBy(F.window("time", "1 day"), "source", "kind").agg(F.count("*").alias("calls"), F.sum("usd").alias("usd"))
    return sums.select("source", "kind", F.to_date("window.start").alias("day"), "calls", "usd")


def latest_status(log: DataFrame) -> DataFrame:
    """(id, status) of decisions (id, line, status): the last line stands."""
    return log.groupBy("id").agg(F.max_by("status", "line").alias("status"))
