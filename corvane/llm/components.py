"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import remove, scratch_path


def _towards_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star round: each node's neighbours are tied to the least of its closed neighbourhood.

    With ``both_ways`` (large star) the larger neighbours move, else (small star) the
    smaller ones and the node itself. Least values are combined before the shuffle, and
    the join back to a much-linked node is one that adaptive execution may split.
    """
    near = edges.select(F.col("src").alias("at"), F.col("dst").alias("nb"))
    if both_ways:
        near = near.union(edges.select(F.col("dst").alias("at"), F.col("src").alias("nb")))
    least = near.groupBy("at").agg(F.min("nb").alias("low")).select("at", F.least("at", "low").alias("low"))
    tied = near.join(least, "at")
    if both_ways:
        out = tied.where(F.col("nb") > F.col("at")).select(F.col("nb").alias("src"), F.col("low").alias("dst"))
    else:
        out = tied.select(F.col("nb").alias("src"), F.col("low").alias("dst")).union(
            least.select(F.col("at").alias("src"), F.col("low").alias("dst"))
        )
    return out.where(F.col("src") != F.col("dst")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link to another one; component is the least node.

    ``edges`` has columns src and dst of one orderable type; direction, repeats, loops and
    nulls do not matter. Each round is written to the shared folder, and the rounds end
    when the set of links stays the same. No edge: an empty result.
    """
    spark = edges.sparkSession
    schema = edges.select("src", "dst").schema
    clean = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    state = clean.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    before, held = None, []
    while True:
        path = scratch_path(spark, "components")
        state.write.parquet(path)
        held.append(path)
        now = spark.read.schema(schema).parquet(path)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        for old in held[:-2]:
            remove(spark, old)
        held = held[-2:]
        if mark == before or not mark[0]:
            ties = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return ties.union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        before = mark
        state = _towards_least(_towards_least(now, True), False)
