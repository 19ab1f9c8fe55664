"""Keyed tables, sampling, ordering and set operators (SRC02, WIN01-WIN21, SRT01-SRT05, SET01-SET08)."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nulls_last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def keep_latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that is greatest in ``order``, as one aggregate without a sort."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def hash_rank(stratum: list[str], seed: int, ident: str, salt: list[Column] = ()) -> Column:
    """The place of a row in its stratum, drawn by a seeded SHA-256 of its id: the same in any order of rows."""
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), *salt, *[F.col(c).cast("string") for c in stratum], F.col(ident).cast("string")), 256)
    return F.row_number().over(Window.partitionBy(*stratum).orderBy(draw, ident))


def stratified_sample(df: DataFrame, stratum: list[str], ident: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows per stratum."""
    return df.withColumn("_rank", hash_rank(stratum, seed, ident)).where(F.col("_rank") <= most).drop("_rank")


def exact_sample(df: DataFrame, case: str, per_year: int, seed: int) -> DataFrame:
    """At most ``per_year`` works per frame and year, drawn as numpy's seeded choice without replacement.

    Reproduces a draw that is keyed by entropy ``seed`` and the keys (case, frame, year),
    over works sorted by id. ``df``: frame_id, year, work_id (strings but the year).
    """
    import hashlib

    import numpy as np

    def key(text: str) -> int:
        return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf.sort_values("work_id", ignore_index=True)
        if len(pool) <= per_year:
            return pool
        rng = np.random.default_rng(np.random.SeedSequence(entropy=seed, spawn_key=(key(case), key(str(pool.frame_id[0])), int(pool.year[0]))))
        return pool.iloc[sorted(rng.choice(len(pool), size=per_year, replace=False).tolist())]

    return df.select("frame_id", "year", "work_id").groupBy("frame_id", "year").applyInPandas(draw, "frame_id string, year int, work_id string")


def chunk_no(order: list[Column | str], size: int, partition: list[str] = ()) -> Column:
    """Number of the fixed-size chunk that a row falls in, from 0."""
    return F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / size)


def ranked(df: DataFrame, order: list[str], name: str = "rank", parts: int = 128) -> DataFrame:
    """Add the place of each row in the whole order, from 0, without one task for all rows.

    Rows fall into parts between the values of ``order`` at sampled places; places count within parts,
    and a small table of the parts' sizes is summed up. Any sample gives the same places.
    """
    key = F.struct(*order)
    sample = df.select(*order).sample(min(1.0, 20.0 * parts / max(1, df.count())), 7).distinct().orderBy(*order).collect()
    bounds = sample[:: max(1, len(sample) // parts)][1:]
    if not bounds:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    kinds = df.select(key.alias("k")).schema["k"].dataType
    listed = F.array(*[F.struct(*[F.lit(x) for x in b]) for b in bounds]).cast(f"array<{kinds.simpleString()}>")
    placed = df.withColumn("_part", F.size(F.filter(listed, lambda b: b <= key)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_in", within).join(F.broadcast(sizes.drop("_n")), "_part").withColumn(name, F.col("_ahead") + F.col("_in")).drop("_part", "_in", "_ahead")


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add ``chunk``, the number of the fixed-size chunk that a row falls in, from 0."""
    return ranked(df, order, "_rank").withColumn("chunk", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def batches(df: DataFrame, ident: str, size: int, seed: int, rep: int) -> DataFrame:
    """Batches of ids in a seeded order: (batch, ids)."""
    shuffled = F.sha2(F.concat_ws(":", F.lit(f"{seed}:{rep}"), F.col(ident).cast("string")), 256)
    dealt = ranked(df.select(ident, shuffled.alias("_draw")), ["_draw", ident], "rank").withColumn("batch", F.floor(F.col("rank") / size))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", ident))), lambda x: x[ident])
    return dealt.groupBy("batch").agg(ids.alias("ids"))


def seeded_sample(df: DataFrame, subject: str, order: list[str], most: int, seed: int, prefix: bool = False) -> DataFrame:
    """At most ``most`` rows of each subject as Python's ``random.Random("seed:subject").sample`` draws them; ``drawn`` is the place in the draw.

    The pool of a subject is its rows in ``order``, which tells them apart. Only the places drawn reach Python, so a
    subject of any size is no group in one task; ``prefix`` takes the first of a draw of the whole pool, so that a larger ``most`` adds rows and
    keeps the others, and lists all its places in one row. A null subject draws under the text None. No rows: no rows.
    """
    @F.pandas_udf("array<long>")
    def places(named: pd.Series, sizes: pd.Series) -> pd.Series:
        draw = lambda name, n: random.Random(f"{seed}:{name}").sample(range(n), n if prefix else min(most, n))[:most]
        return pd.Series([draw(name, n) for name, n in zip(named, sizes)])

    rows = ranked(df, [subject, *order], "_rank")
    pools = rows.groupBy(subject).agg(F.min("_rank").alias("first"), F.count("*").alias("n"))
    name = F.coalesce(F.col(subject).cast("string"), F.lit("None"))
    picks = pools.select("first", F.posexplode(places(name, F.col("n"))).alias("drawn", "place"))
    return rows.join(picks.select((F.col("first") + F.col("place")).alias("_rank"), "drawn"), "_rank").drop("_rank")


def exact_batches(df: DataFrame, ident: str, size: int, seed: int, rep: int) -> DataFrame:
    """Batches of distinct ids, (batch, ids), in the order of Python's ``random.Random("seed:rep").shuffle``.

    The shuffle is a sequence by nature: one task numbers the ids of the pass and one deals their places. Where
    Python's own order is not needed, ``batches`` has no such tasks.
    """
    rows = df.select(ident, (F.row_number().over(Window.orderBy(ident)) - 1).cast("long").alias("at"))
    n = df.count()

    def deal(frames):
        for _ in frames:
            places = list(range(n))
            random.Random(f"{seed}:{rep}").shuffle(places)
            for k in range(0, n, 100_000):
                yield pd.DataFrame({"rank": range(k, min(n, k + 100_000)), "at": places[k : k + 100_000]})

    dealt = df.sparkSession.range(1).coalesce(1).mapInPandas(deal, "rank long, at long")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", ident))), lambda x: x[ident])
    return rows.join(dealt, "at").groupBy(F.floor(F.col("rank") / size).alias("batch")).agg(ids.alias("ids"))


def sub_windows(spark, start: int, end: int, length: int, one_if_short: bool) -> DataFrame:
    """(window_start, window_end): inclusive year windows a year apart; a short span gives one window or none."""
    if end - start + 1 <= length:
        fits = end - start + 1 == length
        rows = spark.range(1).select(F.lit(start).alias("window_start"), F.lit(end).alias("window_end"))
        return rows if one_if_short or fits else rows.limit(0)
    return spark.range(start, end - length + 2).select(F.col("id").cast("int").alias("window_start"), (F.col("id") + length - 1).cast("int").alias("window_end"))


def window_variants(spark, start: int, end: int, shortest: int, longest: int, shift_max: int) -> DataFrame:
    """(length, shift, window_start, window_end) of every variant of length and shifted start."""
    grid = spark.range(shortest, longest + 1).select(F.col("id").cast("int").alias("length")).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shift_max))))
    first = F.lit(start) + F.col("shift")
    last = F.lit(end) - F.col("length") + 1
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return grid.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.col("window_start") + F.col("length") - 1)


def duplicates(df: DataFrame, *cols: str) -> DataFrame:
    """Values that occur more than once, with their counts."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def table_diff(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state): missing, added or changed between two (path, sha256) tables."""
    a, b = recorded.select("path", F.col("sha256").alias("was")), found.select("path", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), F.lit("missing")).when(F.col("was").isNull(), F.lit("added")).when(F.col("was") != F.col("now"), F.lit("changed"))
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state is not null")


def multiset_rest(counts: DataFrame, group: str, item: str) -> DataFrame:
    """Of each group's items, how many the other groups have; those with none are left out."""
    everything = Window.partitionBy(item)
    rest = F.sum("n").over(everything) - F.col("n")
    return counts.select(group, item, rest.alias("rest")).where("rest > 0")


def union_first(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in order that keeps, of each key, the row of the earliest frame."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("_source", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return keep_first(out, key, ["_source", *nulls_last(*[c for c in out.columns if c not in (*key, "_source")])]).drop("_source")
