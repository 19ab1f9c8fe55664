"""Communities, lineages and matchings: steps that depend on their own results (GRF02, GRF04, JOIN13, WIN09, WIN13).

Overlaps are counted by joins; only the sequential remainder (moves of one window's graph,
naming of clusters in order, greedy choice) runs as a function of one group.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.social import predecessors

CLUSTERS = "window_start int, resolution double, cluster int, author_id string"


def _move(order: np.ndarray, start: np.ndarray, nb: np.ndarray, w: np.ndarray, strength: np.ndarray, label: np.ndarray, gamma: float, within: np.ndarray | None = None) -> bool:
    """Move nodes to the neighbouring group that raises modularity most, until none does. ``within`` bounds the moves."""
    total = strength.sum()
    mass = np.bincount(label, weights=strength, minlength=len(label)).astype(float)
    moved, active = False, deque(order)
    waiting = np.zeros(len(label), dtype=bool)
    waiting[order] = True
    while active:
        v = active.popleft()
        waiting[v] = False
        near = nb[start[v] : start[v + 1]]
        links = w[start[v] : start[v + 1]]
        if within is not None:
            ok = within[near] == within[v]
            near, links = near[ok], links[ok]
        ties: dict[int, float] = {int(label[v]): 0.0}
        for n, x in zip(near, links):
            if n != v:
                ties[int(label[n])] = ties.get(int(label[n]), 0.0) + x
        mass[label[v]] -= strength[v]
        gain = {c: t - gamma * strength[v] * mass[c] / total for c, t in ties.items()}
        best = max(sorted(gain), key=lambda c: gain[c])
        if gain[best] <= gain[int(label[v])] + 1e-12:
            best = int(label[v])
        mass[best] += strength[v]
        if best != label[v]:
            label[v] = best
            moved = True
            for n in near:
                if label[n] != best and not waiting[n]:
                    waiting[n] = True
                    active.append(n)
    return moved


def communities(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, gamma: float, seed: int) -> np.ndarray:
    """Leiden's scheme (Traag, Waltman and van Eck 2019): local moves, a refinement inside groups, aggregation by the refined parts."""
    rng = np.random.default_rng(seed)
    member = np.arange(n)
    loops = np.zeros(n)
    start_label = np.arange(n)
    while True:
        a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
        order = np.argsort(a, kind="stable")
        a, b, w = a[order], b[order], w[order]
        starts = np.searchsorted(a, np.arange(n + 1))
        strength = np.bincount(a, weights=w, minlength=n) + 2 * loops
        if strength.sum() == 0:
            return member
        label = start_label.copy()
        _move(rng.permutation(n), starts, b, w, strength, label, gamma)
        fine = np.arange(n)
        _move(rng.permutation(n), starts, b, w, strength, fine, gamma, within=label)
        parts, fine = np.unique(fine, return_inverse=True)
        if len(parts) == n:
            return label[member]
        group = np.zeros(len(parts), dtype=np.int64)
        group[fine] = label
        first = {}
        start_label = np.array([first.setdefault(int(g), i) for i, g in enumerate(group)])
        member = fine[member]
        fs, fd = fine[src], fine[dst]
        inner = fs == fd
        loops = np.bincount(fine, weights=loops, minlength=len(parts)) + np.bincount(fs[inner], weights=weight[inner], minlength=len(parts))
        key = np.minimum(fs, fd)[~inner] * len(parts) + np.maximum(fs, fd)[~inner]
        keys, at = np.unique(key, return_inverse=True)
        weight = np.bincount(at, weights=weight[~inner], minlength=len(keys))
        src, dst, n = keys // len(parts), keys % len(parts), len(parts)


def leiden(nodes: DataFrame, edges: DataFrame, resolutions: list[float], seed: int) -> DataFrame:
    """(window_start, resolution, cluster, author_id) of every window's graph; clusters largest first, then by least member.

    One window's graph at one resolution is one task. ``nodes``: window_start, author_id; ``edges``: window_start, src, dst, weight.
    """
    spark = nodes.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(float(r)) for r in resolutions])).alias("resolution"))
    rows = nodes.select("window_start", F.col("author_id").cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("weight"))
    rows = rows.union(edges.select("window_start", F.col("src").cast("string"), F.col("dst").cast("string"), "weight")).crossJoin(F.broadcast(grid))

    def cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf.loc[pdf.dst.isna(), "src"].unique().astype(str))
        links = pdf[pdf.dst.notna()].sort_values(["src", "dst"])
        s, d = np.searchsorted(names, links.src.to_numpy(str)), np.searchsorted(names, links.dst.to_numpy(str))
        found = communities(len(names), s, d, links.weight.to_numpy(float), key[1], seed)
        groups = pd.DataFrame({"g": found, "author_id": names}).groupby("g").author_id.agg(["size", "min"]).sort_values(["size", "min"], ascending=[False, True])
        number = {g: i for i, g in enumerate(groups.index)}
        return pd.DataFrame({"window_start": key[0], "resolution": key[1], "cluster": [number[g] for g in found], "author_id": names})

    return rows.groupBy("window_start", "resolution").applyInPandas(cluster, CLUSTERS)


LINEAGES = "resolution double, lineage_id string, window_start int, cluster int, members long, parent string, overlap double"


def lineages(clusters: DataFrame, least_overlap: float, least_members: int) -> DataFrame:
    """Clusters followed over windows: a sole successor goes on with its lineage, several start branches, none found starts a root.

    Overlaps with the window before are counted by joins over all resolutions at once; ids L1, L2, ... in
    order of first appearance are given per resolution to a table of clusters, not of members.
    """
    sizes = clusters.groupBy("resolution", "window_start", "cluster").agg(F.count("*").alias("members")).where(F.col("members") >= least_members)
    followed = clusters.join(sizes.drop("members"), ["resolution", "window_start", "cluster"], "left_semi")
    # A window of a resolution is told apart from others by a struct, so one join serves all.
    tagged = followed.select(F.col("window_start"), F.struct("resolution", "cluster").alias("cluster"), F.concat_ws("|", "resolution", "author_id").alias("author_id"))
    best = predecessors(tagged, least_overlap).select("window_start", F.col("cluster.resolution").alias("resolution"), F.col("cluster.cluster").alias("cluster"), F.col("predecessor.cluster").alias("predecessor"), "overlap")
    steps = sizes.join(best, ["resolution", "window_start", "cluster"], "left")

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[tuple[int, int], str] = {}
        out, count = [], 0
        pdf = pdf.sort_values(["window_start", "cluster"])
        heirs = pdf.groupby(["window_start", "predecessor"]).size().to_dict()
        for r in pdf.itertuples():
            known = not pd.isna(r.predecessor)
            from_ = held.get((r.window_start - 1, int(r.predecessor))) if known else None
            if known and heirs[(r.window_start, r.predecessor)] == 1:
                held[(r.window_start, r.cluster)] = from_
                out.append((r.resolution, from_, r.window_start, r.cluster, r.members, None, r.overlap))
            else:
                count += 1
                held[(r.window_start, r.cluster)] = f"L{count}"
                out.append((r.resolution, f"L{count}", r.window_start, r.cluster, r.members, from_, r.overlap if known else None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LINEAGES.split(", ")])

    return steps.groupBy("resolution").applyInPandas(name, LINEAGES)


def greedy_match(reference: DataFrame, variant: DataFrame) -> DataFrame:
    """(reference, variant): greedy one-to-one matching of member sets by Jaccard overlap, ties by ids; unmatched ones are null.

    ``reference`` and ``variant``: id, member. Only pairs that share a member exist.
    """
    a, b = reference.select(F.col("id").alias("ref"), "member").distinct(), variant.select(F.col("id").alias("var"), "member").distinct()
    na, nb = a.groupBy("ref").agg(F.count("*").alias("na")), b.groupBy("var").agg(F.count("*").alias("nb"))
    pairs = a.join(b, "member").groupBy("ref", "var").agg(F.count("*").alias("k")).join(na, "ref").join(nb, "var")
    pairs = pairs.select("ref", "var", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("overlap"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken_a, taken_b, out = set(), set(), []
        for r in pdf.sort_values(["overlap", "ref", "var"], ascending=[False, True, True]).itertuples():
            if r.ref not in taken_a and r.var not in taken_b:
                taken_a.add(r.ref)
                taken_b.add(r.var)
                out.append((r.ref, r.var))
        return pd.DataFrame(out, columns=["ref", "var"])

    chosen = pairs.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: choose(pdf), "ref string, var string")
    return na.select(F.col("ref").cast("string")).join(chosen, "ref", "left").select(F.col("ref").alias("reference"), F.col("var").alias("variant"))


#: Names of a round that the driver holds; more are kept by checkpoint().
FRONT = 10_000


def dependency_order(links: DataFrame, start: list[str], most: int = 1000) -> DataFrame:
    """(name, depth) of components and all they depend on, deepest first in build order; ``links``: name, upstream.

    Each round takes the upstreams of the last round's names, combined, until there are none: as many
    rounds as the longest chain. A cycle, or a chain longer than ``most``, raises.
    """
    spark = links.sparkSession
    level = 0
    links = links.where("name is not null and upstream is not null").select("name", "upstream")
    held = []
    front = spark.createDataFrame([(n,) for n in sorted(set(start))], "name string")
    while True:
        if level > most:
            raise ValueError("dependencies form a cycle")
        held.append(front.withColumn("depth", F.lit(level)))
        front = links.join(front, "name", "left_semi").select(F.col("upstream").alias("name")).distinct()
        front = spark.createDataFrame(front.toArrow()) if front.limit(FRONT + 1).count() <= FRONT else front.checkpoint()
        if front.isEmpty():
            break
        level += 1
    found = held[0]
    for more in held[1:]:
        found = found.union(more)
    return found.groupBy("name").agg(F.max("depth").alias("depth")).orderBy(F.desc("depth"), "name")
