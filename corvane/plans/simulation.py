"""Planted data and the simulation grid (SRC31-SRC33, GRF05-GRF08, AGG32-AGG34, AGG42, NUM07-NUM10, STG09).

A replicate is one row of a grid; its generator is seeded by its own key, so any number of
tasks gives the same rows. Measures of a replicate are numpy over its label arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORT, AGAINST, DISCOUNT, NONE = range(4)
A, B, C, D = range(4)


@dataclass(frozen=True)
class Profile:
    """Rates of one kind of community."""

    name: str
    cite: tuple[float, float]  # of favourable and unfavourable results
    discount: tuple[float, float]  # where the filter's property holds
    uncheckable: float  # of unfavourable results
    ledger: tuple[float, float, float, float]  # A, B, C, D
    rounds: tuple[float, float, float, float]  # success, debit, no debit, open
    retention: tuple[float, float]  # after breaks, after other changes
    honoured: float


HEALTHY = Profile("healthy", (0.6, 0.6), (0.3, 0.3), 0.0, (0.3, 0.6, 0.05, 0.05), (0.4, 0.4, 0.05, 0.15), (0.8, 0.8), 0.9)
INSULATED = Profile("insulated", (0.7, 0.3), (0.1, 0.7), 0.3, (0.05, 0.15, 0.5, 0.3), (0.1, 0.1, 0.6, 0.2), (0.2, 0.8), 0.2)


@dataclass(frozen=True)
class Config:
    families: tuple[float, ...] = (0.05, 0.05, 0.08)  # flip rates of coder families
    results_per_member: float = 2.0
    support_share: float = 0.5
    property_share: float = 0.5
    disconfirmations_per_member: float = 0.3
    breaks_per_member: float = 0.2
    changes_per_member: float = 0.3
    conditions_per_member: float = 0.2
    ties_per_member: float = 5.0
    window_end: float = 2000.0
    window_years: float = 15.0
    lag: float = 5.0
    idle_years: float = 10.0
    strata: int = 5
    draws: int = 200
    level: float = 0.95
    seed: int = 7
    profiles: dict = field(default_factory=lambda: {"healthy": HEALTHY, "insulated": INSULATED})


def row_rng(seed: int, name: str, *numbers: int) -> np.random.Generator:
    key = int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big")
    return np.random.default_rng(np.random.SeedSequence(entropy=seed, spawn_key=(key, *numbers)))


def flipped(true: np.ndarray, options: int, rates: tuple[float, ...], rng: np.random.Generator) -> np.ndarray:
    """Labels (families, items): with a family's rate another option, each as likely."""
    shape = (len(rates), len(true))
    other = (true[None] + rng.integers(1, options, shape)) % options
    return np.where(rng.random(shape) < np.array(rates)[:, None], other, true[None])


def plant_commitment(p: Profile, members: int, c: Config, rng: np.random.Generator) -> dict:
    """Arrays of one commitment's evidence with its coders' labels."""
    n = max(1, round(members * c.results_per_member))
    favourable = rng.random(n) < c.support_share
    has = rng.random(n) < c.property_share
    cited = rng.random(n) < np.where(favourable, *p.cite)
    by_filter = has & (rng.random(n) < np.where(favourable, *p.discount))
    by_excuse = ~by_filter & ~favourable & (rng.random(n) < p.uncheckable)
    stance = np.where(by_filter | by_excuse, DISCOUNT, SUPPORT)
    labels = flipped(stance, 4, c.families, rng)
    reason = np.where((stance == DISCOUNT)[None], np.where(by_filter, 0, 1)[None], rng.integers(0, 2, labels.shape))
    m = rng.poisson(members * c.disconfirmations_per_member)
    when = c.window_end - c.window_years + rng.random(m) * (c.window_years - c.lag)
    code = rng.choice(4, m, p=np.array(p.ledger) / sum(p.ledger))
    outcome = rng.choice(4, m, p=np.array(p.rounds) / sum(p.rounds))
    order = np.argsort(when)

    def ties(count: int, keep: float) -> np.ndarray:
        before = 1 + rng.poisson(max(c.ties_per_member - 1, 0), count)
        return np.stack([before, rng.binomial(before, keep)], axis=1)

    return {
        "favourable": favourable, "prominence": rng.lognormal(size=n), "cited": cited, "labels": labels, "reason": reason, "applies": flipped(has.astype(int), 2, c.families, rng),
        "codes": flipped(code[order], 4, c.families, rng), "outcome": outcome[order], "breaks": ties(rng.poisson(members * c.breaks_per_member), p.retention[0]),
        "changes": ties(rng.poisson(members * c.changes_per_member), p.retention[1]), "honoured": rng.random(rng.poisson(members * c.conditions_per_member)) < p.honoured,
    }


def vote(labels: np.ndarray, options: int, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The label with most weight of each item, ties at random."""
    counts = np.stack([(weights[:, None] * (labels == k)).sum(0) for k in range(options)])
    return (counts + rng.random(counts.shape) * 1e-6).argmax(0)


def asymmetry(e: dict, at: np.ndarray, discount: np.ndarray, applies: np.ndarray, side: bool) -> float | None:
    """Reason-by-reason asymmetry toward a side over drawn results."""
    at = at[e["cited"][at]]
    fav = e["favourable"][at] == side
    total = weight = 0.0
    lane = applies[at] == 1
    f, u = lane & fav, lane & ~fav
    if f.any() and u.any():
        k = f.sum() + u.sum()
        total += ((discount[at[u]] == 0).mean() - (discount[at[f]] == 0).mean()) * k
        weight += k
    if (~fav).any():
        total += (discount[at[~fav]] == 1).sum()
        weight += (~fav).sum()
    return total / weight if weight else None


def omission(e: dict, at: np.ndarray, side: bool, strata: int) -> float | None:
    ranked = at[np.lexsort((at, e["prominence"][at]))]
    bucket = np.minimum(np.arange(len(at)) * strata // max(len(at), 1), strata - 1)
    fav, cited = e["favourable"][ranked] == side, e["cited"][ranked]
    gaps = [cited[(bucket == s) & fav].mean() - cited[(bucket == s) & ~fav].mean() for s in range(strata) if (fav & (bucket == s)).any() and (~fav & (bucket == s)).any()]
    return float(np.mean(gaps)) if gaps else None


def longest_run(insulating: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], insulating.astype(int), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def interval(point: float | None, draws: list, level: float) -> list[float] | None:
    values = [x for x in draws if x is not None]
    if point is None or not values:
        return None
    tail = (1 - level) / 2
    return [float(point), *map(float, np.quantile(values, [tail, 1 - tail]))]


def measure(e: dict, c: Config, rng: np.random.Generator) -> dict:
    """Point estimates and percentile intervals of one commitment, toward the favoured side, or toward both where neither is."""
    families, n, m = len(c.families), len(e["favourable"]), e["codes"].shape[1]

    def take(weights: np.ndarray, at: np.ndarray, entries: np.ndarray, tie) -> dict:
        stance = vote(e["labels"], 4, weights, tie)
        reason = vote(np.where(e["labels"] == DISCOUNT, e["reason"], 2), 2, weights, tie)
        discount = np.where(stance == DISCOUNT, reason, -1)
        applies = vote(e["applies"], 2, weights, tie)
        cited = at[e["cited"][at]]
        toward = (stance[cited] == SUPPORT) == e["favourable"][cited]
        toward &= np.isin(stance[cited], (SUPPORT, DISCOUNT))
        away = np.isin(stance[cited], (SUPPORT, DISCOUNT)) & ~toward
        code = vote(e["codes"], 4, weights, tie) if m else np.zeros(0, dtype=int)
        insulating = (code == C) | (code == D) | ((code == B) & (e["outcome"] == 2))
        return {"stance": stance, "discount": discount, "applies": applies, "p": int(toward.sum()), "q": int(away.sum()), "share": float(insulating[entries].mean()) if len(entries) else None, "loop": float(longest_run(insulating)) if m else None}

    every, all_entries = np.arange(n), np.arange(m)
    point = take(np.ones(families), every, all_entries, rng)
    sides = [True, False] if point["p"] == point["q"] else [point["p"] > point["q"]]
    kept = lambda t: None if not len(t) or t[:, 0].sum() == 0 else t[:, 1].sum() / t[:, 0].sum()

    def tau(b: np.ndarray, o: np.ndarray) -> float | None:
        x, y = kept(b), kept(o)
        return None if x is None or not y else x / y

    held: dict = {(s, k): [] for s in sides for k in ("delta", "omega", "share", "loop")} | {"tau": [], "honoured": []}
    for _ in range(c.draws):
        weights = np.bincount(rng.integers(0, families, families), minlength=families).astype(float)
        at, entries = rng.integers(0, n, n), rng.integers(0, m, m) if m else all_entries
        one = take(weights, at, entries, rng)
        for s in sides:
            held[s, "delta"].append(asymmetry(e, at, one["discount"], one["applies"], s))
            held[s, "omega"].append(omission(e, at, s, c.strata))
            held[s, "share"].append(one["share"])
            held[s, "loop"].append(one["loop"])
        again = lambda t: t[rng.integers(0, len(t), len(t))] if len(t) else t
        held["tau"].append(tau(again(e["breaks"]), again(e["changes"])))
        h = again(e["honoured"])
        held["honoured"].append(float(h.mean()) if len(h) else None)
    oriented = []
    for s in sides:
        points = {"delta": asymmetry(e, every, point["discount"], point["applies"], s), "omega": omission(e, every, s, c.strata), "share": point["share"], "loop": point["loop"]}
        oriented.append({"side": "p" if s else "not_p"} | {k: interval(v, held[s, k], c.level) for k, v in points.items()})
    ties = interval(tau(e["breaks"], e["changes"]), held["tau"], c.level)
    conditions = interval(float(e["honoured"].mean()) if len(e["honoured"]) else None, held["honoured"], c.level)
    first = {k: x for k, x in oriented[0].items() if k != "side"}
    return first | {"tau": ties, "honoured": conditions, "oriented": oriented, "side": "both" if len(sides) == 2 else oriented[0]["side"], "citations": int(e["cited"].sum()), "entries": m}


ORIENTED = "array<struct<side:string,delta:array<double>,omega:array<double>,share:array<double>,loop:array<double>>>"
GRID = "profile string, members int, replicate int, side string, citations int, entries int, delta array<double>, omega array<double>, share array<double>, loop array<double>, tau array<double>, honoured array<double>, oriented " + ORIENTED
#: Columns of the grid in order.
GRID_COLUMNS = [c.split()[0] for c in GRID.removesuffix(ORIENTED).split(", ")]


def grid(spark: SparkSession, config: Config, members: list[int], replicates: int) -> DataFrame:
    """Measured replicates of every profile and size; one row is one replicate, dealt evenly."""
    rows = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"), F.explode(F.array(*[F.lit(m) for m in members])).alias("members"))
    rows = rows.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in config.profiles])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                rng = row_rng(config.seed, r.profile, r.members, r.replicate)
                e = plant_commitment(config.profiles[r.profile], r.members, config, rng)
                out.append({"profile": r.profile, "members": r.members, "replicate": r.replicate} | measure(e, config, rng))
            yield pd.DataFrame(out, columns=GRID_COLUMNS)

    return rows.repartition(spark.sparkContext.defaultParallelism, "profile", "members", "replicate").mapInPandas(run, GRID)


def thresholds(rows: DataFrame, alpha: float) -> DataFrame:
    """(delta_band, insulating_most, loop_least): order statistics of the profiles' bounds at each size, the widest over sizes."""
    from corvane.operators.measures import order_statistic

    healthy, insulated = rows.where("profile = 'healthy'"), rows.where("profile = 'insulated'")
    bound = lambda c, i, d: F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(d))
    widest = F.greatest(*[F.abs(bound(c, i, 1.0)) for c in ("delta", "omega") for i in (1, 2)])
    band = order_statistic(healthy.withColumn("x", widest), ["members"], "x", alpha).agg(F.max("threshold").alias("delta_band"))
    most = order_statistic(healthy.withColumn("x", bound("share", 2, 1.0)), ["members"], "x", alpha).agg(F.max("threshold").alias("insulating_most"))
    loop = order_statistic(insulated.withColumn("x", -bound("loop", 1, 0.0)), ["members"], "x", alpha).agg((-F.max("threshold")).alias("loop_least"))
    return band.crossJoin(most).crossJoin(loop)


#: Gates of a verdict: least disconfirmations, members, citations and coverage; bands and thresholds; met conditions before H counts.
GATES = {"n": 1, "m": 2, "v": 2, "r": 0.5, "delta": 0.2, "c": 0.4, "k": 3.0, "t": 0.6, "h": 0.6, "h0": 2}


def verdicts(rows: DataFrame, gates: dict = GATES) -> DataFrame:
    """Add the verdict (verdict, reason, note, corroboration, side) of measured rows; ``closed`` where there is one.

    Where no side is favoured both orientations are read, and the verdict stands on both readings.
    """
    from corvane.functions import decision

    def iv(x):
        x = F.col(x) if isinstance(x, str) else x
        return F.when(F.size(x) == 3, F.struct(F.get(x, F.lit(0)).alias("point"), F.get(x, F.lit(1)).alias("lower"), F.get(x, F.lit(2)).alias("upper"), F.lit(0).alias("n")))

    p = {k: F.lit(v) for k, v in gates.items()}
    if "oriented" not in rows.columns:
        rows = rows.withColumn("oriented", F.array(F.struct("side", "delta", "omega", "share", "loop")))

    def read(o):
        found = decision.reading(iv(o["delta"]), iv(o["omega"]), iv(o["share"]), iv(o["loop"]), p["delta"], p["c"], p["k"])
        return F.struct(o["side"].alias("side"), found["reading"].alias("reading"), found["note"].alias("note"))

    rows = rows.withColumn("oriented", F.transform("oriented", read))
    closed = F.coalesce("closed", F.lit(False)) if "closed" in rows.columns else F.lit(False)
    m = {
        "closed": closed, "cites": F.lit(True), "disconfirmations": F.col("entries"), "members": F.col("members"), "citations": F.col("citations"), "coverage": F.lit(1.0), "favoured": F.col("side"),
        "primary": decision.primary_reading(F.col("oriented")), "tau": iv("tau"), "tau_measurable": F.col("tau").isNotNull(), "honoured": iv("honoured"), "honoured_measurable": F.col("honoured").isNotNull(),
    }
    return rows.withColumn("verdict", decision.verdict(m, p)).drop("oriented")


def recovery(rows: DataFrame, gates: dict = GATES) -> DataFrame:
    """(profile, members, verdict, reason, n, share) over replicates."""
    from pyspark.sql import Window

    counts = verdicts(rows, gates).groupBy("profile", "members", "verdict.verdict", "verdict.reason").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("profile", "members")))


SCENARIO = "lineage_id string, parent string, profile string, window int, members int, closed boolean"


def scenario(spark: SparkSession, config: Config, lineages: list[tuple[str, str | None, str, int, int, int | None]], windows: int, replicates: int, gates: dict = GATES) -> DataFrame:
    """A verdict of each lineage in each window and replicate; a window after a lineage's end is closed.

    ``lineages``: (id, parent, profile, first window, members, last window or none).
    """
    plan = [(i, p, kind, w, size, end is not None and w > end) for i, p, kind, start, size, end in lineages for w in range(start, windows)]
    rows = spark.createDataFrame(plan, SCENARIO).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                rng = row_rng(config.seed, f"{r.lineage_id}:{r.profile}", r.members, r.window, r.replicate)
                e = plant_commitment(config.profiles[r.profile], r.members, config, rng)
                out.append({"lineage_id": r.lineage_id, "window": r.window, "closed": r.closed, "profile": r.profile, "members": r.members, "replicate": r.replicate} | measure(e, config, rng))
            yield pd.DataFrame(out, columns=["lineage_id", "window", "closed", *[c.split()[0] for c in GRID.split(", ")]])

    return verdicts(rows.mapInPandas(run, f"lineage_id string, window int, closed boolean, {GRID}"), gates)


def scenario_summary(found: DataFrame) -> DataFrame:
    """(replicate, summary) of a scenario's verdicts: uniform, split, shifted or undetermined."""
    from corvane.operators.measures import field_summary

    return field_summary(found.select("replicate", "lineage_id", "verdict.verdict"), ["replicate"])


def pilot_power(found: DataFrame, predicted: str) -> DataFrame:
    """(replicates, power): how often a scenario's summary is the predicted one."""
    return scenario_summary(found).agg(F.count("*").alias("replicates"), F.avg((F.col("summary") == predicted).cast("double")).alias("power"))


def planted_network(spark: SparkSession, communities: int, members: int, years: range, papers: int, seed: int, inside: float = 0.9, cites: int = 4, outsiders: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, authorships, citations) with planted communities; a small fixture made on the driver."""
    rng = np.random.default_rng(seed)
    people = [[f"c{k}m{i:03d}" for i in range(members)] for k in range(communities)]
    works, signed, cited, earlier = [], [], set(), [[] for _ in range(communities)]
    for year in years:
        fresh = []
        for k in range(communities):
            for _ in range(papers):
                w = f"W{len(works) + 1}"
                team = set(rng.choice(people[k], int(rng.integers(2, 5)), replace=False))
                if rng.random() < outsiders:
                    team.add(str(rng.choice(people[int(rng.integers(communities))])))
                works.append((w, year, k))
                signed += [(w, str(a)) for a in sorted(team)]
                everyone = [x for e in earlier for x in e]
                for _ in range(cites):
                    pool = earlier[k] if earlier[k] and rng.random() < inside else everyone
                    if pool:
                        cited.add((w, pool[int(rng.integers(len(pool)))]))
                fresh.append((k, w))
        for k, w in fresh:
            earlier[k].append(w)
    return spark.createDataFrame(works, "work_id string, year int, community int"), spark.createDataFrame(signed, "work_id string, author_id string"), spark.createDataFrame(sorted(cited), "citing string, cited string")


def memberships(lineages: list[tuple[str, int, int, str | None]], windows: int, churn: float, seed: int) -> list[tuple[str, int, str]]:
    """(lineage, window, member) of lineages (id, start, members, parent): a branch inherits half of its members, a share is renewed each window."""
    rng = np.random.default_rng(seed)
    now: dict[str, list[str]] = {}
    count, out = 0, []

    def fresh(k: int) -> list[str]:
        nonlocal count
        count += k
        return [f"u{i}" for i in range(count - k, count)]

    for window in range(windows):
        for name, start, size, parent in lineages:
            if window < start:
                continue
            if name not in now:
                pool = now.get(parent, [])
                half = min(len(pool), size) // 2
                old = [str(x) for x in rng.choice(pool, half, replace=False)] if half else []
                now[name] = old + fresh(size - half)
            else:
                leaving = round(churn * len(now[name]))
                stay = [str(x) for x in rng.choice(now[name], len(now[name]) - leaving, replace=False)] if leaving else now[name]
                now[name] = stay + fresh(leaving)
            out += [(name, window, m) for m in now[name]]
    return out
