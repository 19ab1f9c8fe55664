"""Embedding near-duplicates found by a pivot-permutation index.

Reference points (pivots) are picked from a bounded sample of the vectors. A vector is
described by its ``PREFIX`` nearest pivots. Pivots are numbered from rare to frequent, and
a vector stands in the inverted lists of the first of its pivots only: of vectors that
share ``SHARED`` pivots of ``PREFIX``, two always meet in one of these lists. Within a list,
the shared pivots of all vectors are counted, each pair in the list of the first pivot that
it shares, and pairs that share enough are verified, once, by their cosine in double precision.

Vectors within half the link angle of a pivot (its core) are all linked with one another,
by the triangle inequality for angles, and, as pivots lie more than twice the link angle
apart, cores of different pivots never are. Cores are therefore counted by sums, and only
the other vectors' pairs are compared; lists are compared in blocks, so that no list is one
task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written
from corvane.llm.components import connected_components

COSINE = 0.9
#: Pivots: as many as PER_ROOT times the root of the number of vectors, LEAST_PIVOTS at least, as long as they have
#: COMPONENTS numbers at most (128 MB). Fewer pivots make longer lists and lose no link. The sample that they are fitted
#: on (the vectors with the least hashes) is SAMPLED times as large.
PER_ROOT, LEAST_PIVOTS, COMPONENTS, SAMPLED = 9, 256, 1 << 24, 4
#: Base of the numbers of lists; over the number of pivots of a size.
DIGIT = 1 << 24
#: Nearest pivots that describe a vector, and how many of them a pair must share.
PREFIX, SHARED = 10, 3
#: Vectors of a list that are compared with as many others at once.
BLOCK = 1024
#: Pairs that are verified at once.
PAIRS = 1 << 15


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.array(v, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pivot_count(vectors: int, components: int = 64) -> int:
    return min(max(1, COMPONENTS // max(1, components)), max(LEAST_PIVOTS, round(PER_ROOT * math.sqrt(vectors))))


def pick_pivots(sample: list, cosine: float = COSINE, most: int = LEAST_PIVOTS, prefix: int = PREFIX) -> dict[int, np.ndarray]:
    """Pivots by number of components: sample vectors far from one another, each moved to the mean of those near it.

    They are ordered by how many sample vectors have them among their nearest, rare ones first.
    """
    apart = math.cos(min(math.pi, 2 * math.acos(cosine))) - 1e-9
    found = {}
    for size in sorted({len(v) for v in sample}):
        units = _unit([v for v in sample if len(v) == size])
        kept, n = np.empty((min(most, len(units)), size)), 0
        for unit in units:
            if n == len(kept):
                break
            mean = units[units @ unit >= cosine].sum(axis=0)
            mean /= np.sqrt(mean @ mean)
            if n == 0 or (kept[:n] @ mean).max() < apart:
                kept[n] = mean
                n += 1
        seen = np.zeros(n, dtype=np.int64)
        for at in range(0, len(units), BLOCK):
            seen += np.bincount(_nearest(units[at : at + BLOCK] @ kept[:n].T, min(prefix, n)).ravel(), minlength=n)
        found[size] = kept[np.argsort(seen, kind="stable")]
    return found


def _nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of each row, largest first."""
    if k < near.shape[1]:
        some = np.argpartition(-near, k - 1, axis=1)[:, :k]
    else:
        some = np.tile(np.arange(near.shape[1]), (len(near), 1))
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def _describe(pivots, cosine: float, prefix: int, shared: int):
    core_cosine = math.sqrt((1 + cosine) / 2) + 1e-9

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                whole = batch[sizes == size]
                points = pivots.value.get(int(size), np.zeros((0, int(size))))
                k = min(prefix, len(points))
                for at in range(0, len(whole), BLOCK):
                    part = whole.iloc[at : at + BLOCK]
                    if not k:
                        keys = np.full((len(part), 1), int(size) * DIGIT, dtype=np.int64)
                        yield pd.DataFrame({"cls": part["cls"], "n": part["n"], "core": -1, "prefix": [[]] * len(part), "keys": list(keys)})
                        continue
                    near = _unit(np.stack(part["v"].to_numpy())) @ points.T
                    order = _nearest(near, k)
                    best = near[np.arange(len(part)), order[:, 0]]
                    core = np.where(best >= core_cosine, int(size) * DIGIT + order[:, 0] + 1, -1)
                    prefixes = np.sort(order, axis=1)
                    keys = int(size) * DIGIT + prefixes[:, : k - min(shared, k) + 1] + 1
                    yield pd.DataFrame({"cls": part["cls"], "n": part["n"], "core": core, "prefix": list(prefixes.astype(np.int32)), "keys": list(keys)})

    return describe


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _candidates(pivot: int, a: np.ndarray, b: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of descriptions that share enough pivots and whose first shared one is ``pivot``."""
    if not a.shape[1]:
        return tuple(x.ravel() for x in np.indices((len(a), len(b))))
    known, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    place = place.reshape(-1, a.shape[1])
    has = np.zeros((len(place), len(known)), dtype=np.float32)
    has[np.arange(len(place))[:, None], place] = 1
    count = has[: len(a)] @ has[len(a) :].T
    # Of pivots before this one none may be shared: such a pair is counted in that one's list.
    before = known < pivot
    enough = count >= min(shared, a.shape[1])
    if before.any():
        enough &= has[: len(a), before] @ has[len(a) :, before].T == 0
    return np.nonzero(enough)


def _compare(key: int, side: np.ndarray, cls: np.ndarray, n: np.ndarray, core: np.ndarray, prefix: np.ndarray, vectors: np.ndarray, cosine: float, shared: int) -> list[tuple[int, int, int]]:
    """(class, linked vectors, least class tied to it) of one cell of a list."""
    units = _unit(vectors)
    a, b = np.nonzero(side <= 0)[0], np.nonzero(side >= 0)[0]
    i, j = _candidates(key % DIGIT - 1, prefix[a], prefix[b], shared)
    i, j = a[i], b[j]
    # Side 0: both sides are the same block, whose pairs count once. Within a core all is counted already.
    keep = ((side[i] != 0) | (cls[i] < cls[j])) & ((core[i] < 0) | (core[i] != core[j]))
    i, j = i[keep], j[keep]
    near = [np.einsum("ij,ij->i", units[i[at : at + PAIRS]], units[j[at : at + PAIRS]]) >= cosine for at in range(0, len(i), PAIRS)]
    linked = np.concatenate(near) if near else np.zeros(0, dtype=bool)
    degree: dict[int, int] = {}
    forest = _Forest()
    for x, y in zip(i[linked].tolist(), j[linked].tolist()):
        cx, cy = int(cls[x]), int(cls[y])
        degree[cx] = degree.get(cx, 0) + int(n[y])
        degree[cy] = degree.get(cy, 0) + int(n[x])
        forest.tie(cx, cy)
    return [(c, d, forest.find(c)) for c, d in degree.items()]


def _verify(cosine: float, shared: int):
    names = ["key", "cell", "side", "cls", "n", "core", "prefix", "v"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = batch[names] if rest is None else pd.concat([rest, batch[names]], ignore_index=True)
            if rest is None or not len(rest):
                continue
            key, cell = rest["key"].to_numpy(), rest["cell"].to_numpy()
            starts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))[0] + 1, [len(rest)]])
            whole = starts if batch is None else starts[:-1]
            out = []
            side, cls, n, core = (rest[c].to_numpy() for c in ("side", "cls", "n", "core"))
            prefix, vectors = rest["prefix"].to_numpy(), rest["v"].to_numpy()
            for lo, hi in zip(whole[:-1], whole[1:]):
                if hi - lo > 1:
                    out += _compare(int(key[lo]), side[lo:hi], cls[lo:hi], n[lo:hi], core[lo:hi], np.stack(prefix[lo:hi]), np.stack(vectors[lo:hi]), cosine, shared)
            yield pd.DataFrame(out, columns=["cls", "degree", "root"], dtype=np.int64)
            rest = rest.iloc[whole[-1] :]

    return verify


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _valid(v: Column) -> Column:
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def _cells(listed: DataFrame, block: int) -> DataFrame:
    """Rows of lists dealt to cells: pairs of blocks of loose vectors, and of loose with core ones."""
    sizes = listed.groupBy("key").agg(F.count_if(F.col("core") < 0).alias("loose"), F.count_if(F.col("core") >= 0).alias("tight")).where("loose > 0 and loose + tight > 1")
    met = listed.join(sizes, "key")
    loose_blocks, tight_blocks = F.ceil(F.col("loose") / block).cast("int"), F.ceil(F.col("tight") / block).cast("int")
    mine = F.xxhash64("cls", F.lit(7))
    of_loose = F.pmod(mine, loose_blocks).cast("int")
    of_tight = F.pmod(mine, tight_blocks).cast("int")

    def cell(kind: int, a: Column, b: Column, side: Column) -> Column:
        return F.struct((F.lit(kind).cast("long") * (1 << 60) + F.shiftleft(a.cast("long"), 28) + b).alias("cell"), side.cast("int").alias("side"))

    def among_loose(o: Column) -> Column:
        side = F.when(o == of_loose, 0).when(of_loose < o, -1).otherwise(1)
        return cell(0, F.least(o, of_loose), F.greatest(o, of_loose), side)

    loose_cells = F.concat(
        F.transform(F.sequence(F.lit(0), loose_blocks - 1), among_loose),
        F.when(tight_blocks > 0, F.transform(F.sequence(F.lit(0), tight_blocks - 1), lambda c: cell(1, of_loose, c, F.lit(-1)))).otherwise(F.array().cast("array<struct<cell:bigint,side:int>>")),
    )
    tight_cells = F.transform(F.sequence(F.lit(0), loose_blocks - 1), lambda u: cell(1, u, of_tight, F.lit(1)))
    return met.select("key", "cls", F.explode(F.when(F.col("core") < 0, loose_cells).otherwise(tight_cells)).alias("c")).select("key", "cls", "c.*")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) of each row.

    Links are pairs of rows with a cosine of ``cosine`` or more, between vectors with equally
    many components. Vectors that are null or zero, or hold null or non-finite components,
    link with nothing. n_links: other rows linked directly, equal vectors included.
    component_id: the least key reachable (of null keys only: null). kept: the key is its
    component's id. Repeated rows are vectors of their own; no rows: no rows. ``pivots``
    replaces the number of pivots.
    """
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    rows = rows.withColumn("valid", _valid(F.col("v")))
    h = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    valid = rows.where("valid").select("id", "v", *h)
    classes = valid.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("components")).first()
    most = pivots or pivot_count(facts.n, facts.components or 1)
    sample = [r.v for r in classes.orderBy(F.xxhash64("h1"), "h2").limit(SAMPLED * most).select("v").toLocalIterator()]
    held = vectors.sparkSession.sparkContext.broadcast(pick_pivots(sample, cosine, most))
    described = classes.select("cls", "n", "v").mapInPandas(_describe(held, cosine, PREFIX, SHARED), "cls long, n long, core long, prefix array<int>, keys array<long>")
    described = written(described, "pivot-lists")
    listed = described.select("cls", "core", F.explode("keys").alias("key"))
    dealt = _cells(listed, block)
    facts = described.select("cls", "n", "core", "prefix").join(classes.select("cls", "v"), "cls")
    met = dealt.join(facts, "cls").repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = written(met.mapInPandas(_verify(cosine, SHARED), "cls long, degree long, root long"), "links")
    cores = described.where("core >= 0").groupBy("core").agg(F.sum("n").alias("all"), F.min("cls").alias("root"))
    tight = described.where("core >= 0").join(cores, "core").select("cls", (F.col("all") - F.col("n")).alias("degree"), "root")
    linked = found.unionByName(tight)
    degrees = linked.groupBy("cls").agg(F.sum("degree").alias("degree"))
    groups = connected_components(linked.select(F.col("cls").alias("src"), F.col("root").alias("dst")))
    rooted = classes.select("h1", "h2", "cls", "n", "least").join(groups, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cls"))
    rooted = written(rooted.join(degrees, "cls", "left").select("h1", "h2", "n", "least", "root", F.coalesce("degree", F.lit(0)).alias("degree")), "rooted-vectors")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = rooted.join(named, "root").select("h1", "h2", (F.col("n") - 1 + F.col("degree")).alias("n_links"), "component_id")
    out = valid.select("id", "h1", "h2").join(facts, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
