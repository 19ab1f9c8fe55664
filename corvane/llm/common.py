"""Shared helpers: scratch tables in the cluster's shared folder, row ids, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, and the gap between words, as the contracts define them.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most row ids (two longs, and one more) that are sent to every executor: some tens of MB there. Beyond, the join shuffles.
BROADCAST_IDS = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-scratch-"))
            held = spark.sparkContext.getCheckpointDir()
        found = held
    return found.rstrip("/")


#: Folders that this driver has made in the shared folder.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_dir(spark)}/corvane-{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete what the operators have left in the shared folder; their results must have been written elsewhere."""
    while _MADE:
        remove(spark, _MADE.pop())


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage is cut and no executor's loss undoes it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _scans_files(df: DataFrame) -> bool:
    """Whether the frame is a scan of Parquet files with nothing over it but projections and filters."""
    if "_metadata" in df.columns:
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower()


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique id of each row, the same in every scan whatever the splits and the executors.

    A row of a file is named by its file and its place in it, which no split changes. Any
    other frame is written once, with its ids, and read from there; its ids have the same type.
    """
    if _scans_files(df):
        return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
    return written(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"))), "rows")


def sent(side: DataFrame, most: int) -> DataFrame:
    """A written table of rows of fixed width as a side of a join: to every executor if it has ``most`` rows at most, else shuffled."""
    return F.broadcast(side) if side.count() <= most else side.hint("shuffle_hash")


def in_order(df: DataFrame, order: list, tag: str) -> DataFrame:
    """The rows sorted over all partitions, written with ``part`` and ``place``.

    Parts follow one another and places count from 0 within each, so that ranks and running
    sums over the whole need a window within parts and a sum of each part, never one task for all.
    """
    at = F.monotonically_increasing_id()
    held = df.orderBy(*order).select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    return written(held, tag)


def before_part(df: DataFrame, value: Column, name: str) -> DataFrame:
    """(part, name): the sum of ``value`` over the parts before each, of a table from ``in_order``.

    One task takes a row per part: as many rows as partitions, however long the table.
    """
    sums = df.groupBy("part").agg(F.sum(value).alias("s"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("part", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias(name)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
