"""Census, social and measure operators on hand-computed values."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import census, core, graph, measures, social
from corvane.plans import simulation


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_author_graph(spark):
    works = spark.createDataFrame([("A", 1990), ("B", 1991), ("C", 1980)], "work_id string, year int")
    signed = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "z"), ("B", "x"), ("B", "w"), ("C", "old")], "work_id string, author_id string")
    cites = spark.createDataFrame([("B", "A"), ("B", "C"), ("A", "A")], "citing string, cited string")
    windows = core.sub_windows(spark, 1989, 1993, 5, True)
    edges = {(r.src, r.dst): round(r.weight, 9) for r in social.graph_edges(works, signed, cites, windows).collect()}
    assert edges == {("x", "y"): round(0.5 + 1 / 6, 9), ("x", "z"): round(0.5 + 1 / 6, 9), ("y", "z"): 0.5, ("w", "x"): round(1 + 1 / 6, 9), ("w", "y"): round(1 / 6, 9), ("w", "z"): round(1 / 6, 9)}
    assert {r.author_id for r in social.active_authors(works, signed, windows).collect()} == {"w", "x", "y", "z"}


def test_windows(spark):
    pairs = lambda df: [tuple(r) for r in df.collect()]
    assert pairs(core.sub_windows(spark, 1989, 1995, 5, True)) == [(1989, 1993), (1990, 1994), (1991, 1995)]
    assert pairs(core.sub_windows(spark, 1989, 1991, 5, True)) == [(1989, 1991)]
    assert pairs(core.sub_windows(spark, 1989, 1991, 5, False)) == []
    assert pairs(core.sub_windows(spark, 1989, 1993, 5, False)) == [(1989, 1993)]


def test_bearing_is_one_hop(spark):
    anchors = spark.createDataFrame([("S",), ("E",)], "work_id string")
    cites = spark.createDataFrame([("A", "S"), ("B", "A"), ("C", "E"), ("D", "X")], "citing string, cited string")
    assert {r.work_id for r in social.bearing(anchors, cites).collect()} == {"S", "E", "A", "C"}


def test_lineages_continue_and_branch(spark):
    sets = {0: [set("abcdefghij")], 1: [set("abcdefghijk"), set("xyz")], 2: [set("abcdef"), set("ghijk")]}
    data = [(w, 1.0, i, a) for w, clusters in sets.items() for i, c in enumerate(clusters) for a in c]
    df = spark.createDataFrame(data, "window_start int, resolution double, cluster int, author_id string")
    got = {(r.window_start, r.cluster): (r.lineage_id, r.parent, None if r.overlap is None else round(r.overlap, 6)) for r in graph.lineages(df, 0.3, 2).collect()}
    assert got[0, 0] == ("L1", None, None) and got[1, 0] == ("L1", None, round(10 / 11, 6)) and got[1, 1] == ("L2", None, None)
    assert got[2, 0] == ("L3", "L1", round(6 / 11, 6)) and got[2, 1] == ("L4", "L1", round(5 / 11, 6))


def test_eligibility(spark):
    members = spark.createDataFrame([("L1", y, y, a) for y in (1990, 1991, 1992) for a in "abc"], "lineage_id string, window_start int, window_end int, author_id string")
    credited = spark.createDataFrame([("W1", 1990, "a"), ("W2", 1990, "b"), ("W3", 1991, "c"), ("W4", None, "a")], "work_id string, year int, author_id string")
    cites = spark.createDataFrame([("W1", "S"), ("W1", "E"), ("W2", "S"), ("W2", "F"), ("W3", "S"), ("W4", "E"), ("S", "S")], "citing string, cited string")
    bearing = spark.createDataFrame([("S",), ("E",), ("F",)], "work_id string")
    cover = spark.createDataFrame([("L1", 1990, 0.8)], "lineage_id string, window_start int, coverage double")
    found = social.eligibility(social.on_claim(members, credited, cites, bearing), cover, [1989.5, 1993.4], 3, 2, 0.7, 1)
    got = {r.window_start: (r.members, r.citations_on_claim, r.disconfirmations, r.closed, r.meets_m, r.meets_v, r.meets_r) for r in found.collect()}
    assert got == {1990: (3, 3, 1, False, True, True, True), 1991: (3, 1, 1, True, True, False, None), 1992: (3, 0, 1, True, True, False, None)}


def test_seeded_draws_are_pythons(spark):
    import random

    pools = {"b": [f"w{k:03d}" for k in range(90)], "a": ["x", "y"], None: ["n1", "n2", "n3"]}
    df = spark.createDataFrame([(s, i) for s, ids in pools.items() for i in ids], "subject string, item string").repartition(5)
    for most, prefix in ((5, False), (5, True), (200, False)):
        got = {}
        for r in core.seeded_sample(df, "subject", ["item"], most, 7, prefix).collect():
            got.setdefault(r.subject, {})[r.drawn] = r["item"]
        assert {s: [d[k] for k in sorted(d)] for s, d in got.items()} == {s: random.Random(f"7:{s}").sample(ids, len(ids) if prefix else min(most, len(ids)))[:most] for s, ids in pools.items()}
    assert core.seeded_sample(df.where("false"), "subject", ["item"], 5, 7).count() == 0
    dealt = list(pools["b"])
    random.Random("7:2").shuffle(dealt)
    got = core.exact_batches(df.where("subject = 'b'").select("item"), "item", 40, 7, 2).orderBy("batch").collect()
    assert [(r.batch, r.ids) for r in got] == [(0, dealt[:40]), (1, dealt[40:80]), (2, dealt[80:])]
    assert core.exact_batches(df.where("false").select("item"), "item", 40, 7, 2).count() == 0


def test_exact_sample_is_numpys(spark):
    works = [("f", 1990, f"W{i:03d}") for i in range(30)] + [("f", 1991, f"V{i:03d}") for i in range(5)]
    df = spark.createDataFrame(works, "frame_id string, year int, work_id string").repartition(3)
    got = sorted(r.work_id for r in core.exact_sample(df, "case", 10, 7).collect())
    key = lambda s: int.from_bytes(hashlib.sha256(s.encode()).digest()[:4], "big")
    rng = np.random.default_rng(np.random.SeedSequence(entropy=7, spawn_key=(key("case"), key("f"), 1990)))
    want = [f"W{i:03d}" for i in rng.choice(30, size=10, replace=False)] + [f"V{i:03d}" for i in range(5)]
    assert got == sorted(want)


def test_coverage(spark):
    ddl = "frame_id string, kind string, year int, "
    papers = spark.createDataFrame([("f", "venue", 1990, 6, 6), ("f", "venue", 1991, 5, 5)], ddl + "frame_works int, sampled int")
    excluded = spark.createDataFrame([("f", "venue", 1995, 1)], ddl + "frame_works_excluded int")
    counts = dict(zip(census.COUNTS, (21, 11, 0, 0, 5, 5, 5, 1, 0)))
    measured = spark.createDataFrame([("f", "venue", 1990, 6, *counts.values())], ddl + "measured int, " + ", ".join(f"{c} int" for c in counts))
    out = {r.year: r for r in census.coverage(papers, excluded, measured).collect()}
    assert out[1990].resolved_estimated == 16.0 and out[1990].unmeasured == 0
    assert out[1991].unmeasured == 5 and out[1995].frame_works_excluded == 1 and out[1995].resolved_estimated == 0.0
    total = census.summary(census.coverage(papers, excluded, measured), ["frame_id"], 0.5).first()
    assert total.coverage == pytest.approx(16 / 21) and total.unmeasured_share == pytest.approx(5 / 11) and total.measurable
    none = census.summary(census.coverage(papers, excluded, measured.limit(0)), ["frame_id"], 1.0).first()
    assert none.coverage is None and none.unmeasured_share == 1.0 and not none.measurable
    assert spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "x int").agg(census.upper_median(F.col("x"))).first()[0] == 3


def test_delta_rules(spark):
    ddl = "g int, result_id string, supports string, filter_id string, applies string, discounted boolean"
    filters = spark.createDataFrame([("b", True), ("u", False)], "filter_id string, checkable boolean")

    def delta(data, which="b"):
        df = spark.createDataFrame(data, ddl)
        return measures.delta(df, filters.where(f"filter_id = '{which}'"), ["g"], "p").first().delta

    against = [(1, f"n{i}", "not_p", "b", "yes", True) for i in range(2)]
    assert delta(against + [(1, "p1", "p", "b", "yes", False)]) == 1.0
    assert delta([(1, "n1", "not_p", "b", "yes", False), (1, "p1", "p", "b", "yes", True)]) == -1.0
    assert delta(against + [(1, "p1", "p", "b", "no", False)]) is None
    assert delta([(1, "n1", "not_p", "u", "no", True), (1, "n2", "not_p", "u", "no", False), (1, "p1", "p", "u", "no", True)], "u") == 0.5


def test_omega_and_strata(spark):
    df = spark.createDataFrame([(1, f"r{i}", float(i), i % 2 == 0) for i in range(7)], "g int, result_id string, prominence double, cited boolean")
    sizes = df.withColumn("s", measures.stratum(["g"], 5, ["prominence", "result_id"])).groupBy("s").count().orderBy("s").collect()
    assert [r["count"] for r in sizes] == [2, 1, 2, 1, 1]
    ddl = "g int, result_id string, prominence double, cited boolean, supports string"
    of = lambda data: measures.omega(spark.createDataFrame(data, ddl), ["g"], "p", 1).first().omega
    assert of([(1, "a", 1.0, True, "p"), (1, "b", 1.0, False, "not_p")]) == 1.0
    assert of([(1, "a", 1.0, False, "p"), (1, "b", 1.0, True, "not_p")]) == -1.0
    assert of([(1, "a", 1.0, True, "p")]) is None


def test_loop_length(spark):
    codes = ["C", "D", None, "B_TO_C", "A", "C", "C", "B_OPEN"]

    def longest(risk):
        df = spark.createDataFrame([(1, i, c, i == risk) for i, c in enumerate(codes)], "g int, i int, code string, at_risk boolean")
        return measures.loop_length(df, ["g"], ["i"]).first().loop_length, df.groupBy("g").agg(measures.insulating_share(F.col("code"))).first()[1]

    assert longest(None) == (3, pytest.approx(5 / 7)) and longest(1)[0] == 2


def test_trajectory(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([9, 7, 1, 0, 2])], "g int, i int, n int")
    got = [r.c for r in df.withColumn("c", social.trajectory_closed(F.col("n"), 4, ["g"], "i")).orderBy("i").collect()]
    assert got == [False, False, True, True, True]


def test_agreement(spark):
    df = spark.createDataFrame([(i, c, l) for i, (a, b) in enumerate([(1, 1), (0, 0), (1, 1), (0, 0)]) for c, l in (("a", a), ("b", b))], "i int, c string, l int")
    assert measures.kappa(df, "i", "c", F.col("l") == 1).first().kappa == 1.0
    same = df.withColumn("l", F.lit(1))
    assert measures.kappa(same, "i", "c", F.col("l") == 1).first().kappa == 1.0
    three = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", None), (2, "b", None), (3, "a", "x")], "i int, f string, l string")
    assert measures.disagreement(three, "i", "f", "l").first()[0] == pytest.approx((2 / 3 + 0) / 2)


def test_leakage(spark):
    df = spark.createDataFrame([("c", "a-b", "a_b"), ("c", "a-b", "x"), ("c", "x", "x"), ("c", "x", None)], "coder string, actual string, guess string")
    r = measures.leakage(df, 5, 10.0).first()
    assert (r.answered, r.missing, round(r.accuracy, 6), r.above_chance_pp, r.passes) == (3, 1, round(2 / 3, 6), 46.7, False)


def test_pilot_sign_flips(spark):
    data = [("c", "for", "+"), ("c", "for", "+"), ("c", "for", "+"), ("c", "for", "x"), ("c", "against", "x"), ("c", "against", "x"), ("c", "against", "x"), ("c", "against", "+")]
    df = spark.createDataFrame(data, "coder string, direction string, stance string")
    a = measures.pilot_points(df).first()
    b = measures.pilot_points(df.withColumn("direction", F.when(F.col("direction") == "for", "against").otherwise("for"))).first()
    assert (a.d0, a.a0) == (0.5, 0.5) and (b.d0, b.a0) == (-0.5, -0.5)


def test_triggers(spark):
    ddl = "truth string, verdict string, replaced boolean, reason string"
    v = spark.createDataFrame([("science", "insulated", False, None), ("science", "healthy", False, None), ("science", "closed", False, None), ("science", "indeterminate", True, "unstable")], ddl)
    assert measures.calibration_trigger(v, 0.4, 0.9).first().fired and not measures.calibration_trigger(v, 0.5, 0.9).first().fired
    assert measures.calibration_trigger(v.limit(0), 0.5, 0.9).first().fired is None
    assert measures.instability_trigger(v).first().fired is False
    pairs = spark.createDataFrame([("x", "split", "split"), ("y", "uniform", None)], "pair_id string, predicted string, actual string")
    assert tuple(measures.separation_trigger(pairs).first()) == (2, 1, True)
    assert measures.separation_trigger(pairs.limit(0)).first().fired is None
    one = lambda k, p: spark.range(1).select(measures.reliability_trigger(F.lit(k).cast("double"), F.lit(p).cast("boolean"), 0.6)).first()[0]
    assert (one(0.5, None), one(None, True), one(None, None), one(0.7, False)) == (True, False, None, True)
    checks = spark.createDataFrame([(0.5, None), (9.0, None), (None, None)], "depth_ratio double, deletion_rate double")
    assert measures.check_trigger(checks, (0.0, 1.0), (0.0, 1.0)).first().fired is False


def test_greedy_match(spark):
    a = spark.createDataFrame([("r1", m) for m in "abcd"] + [("r2", m) for m in "cdef"] + [("r3", "z")], "id string, member string")
    b = spark.createDataFrame([("v1", m) for m in "abcdef"] + [("v2", m) for m in "ef"], "id string, member string")
    got = {r.reference: r.variant for r in graph.greedy_match(a, b).collect()}
    assert got == {"r1": "v1", "r2": "v2", "r3": None}


def test_leiden_finds_planted_communities(spark):
    works, signed, cited = simulation.planted_network(spark, 2, 30, range(1990, 1995), 12, 7)
    windows = core.sub_windows(spark, 1990, 1994, 5, True)
    found = graph.leiden(social.active_authors(works, signed, windows), social.graph_edges(works, signed, cited, windows), [1.0], 7).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r.cluster, []).append(r.author_id[:2])
    big = [g for g in sizes.values() if len(g) >= 5]
    purity = sum(max(g.count(x) for x in set(g)) for g in sizes.values()) / len(found)
    assert len(big) >= 2 and purity >= 0.9 and len({r.author_id for r in found}) == len(found)
    again = graph.leiden(social.active_authors(works, signed, windows).repartition(5), social.graph_edges(works, signed, cited, windows), [1.0], 7).collect()
    assert sorted(found) == sorted(again)


def test_grid_recovers_what_is_planted(spark):
    grid = simulation.grid(spark, simulation.Config(draws=60), [40], 6).collect()
    by = lambda p, c: np.mean([r[c][0] for r in grid if r.profile == p and r[c]])
    assert by("insulated", "delta") > by("healthy", "delta") + 0.1
    assert by("insulated", "omega") > by("healthy", "omega") + 0.1
    assert by("insulated", "share") > 0.6 > by("healthy", "share")
    assert by("insulated", "tau") < by("healthy", "tau")
    rows_ = simulation.grid(spark, simulation.Config(draws=60), [40], 6).collect()
    assert sorted(rows_, key=repr) == sorted(grid, key=repr)
    bands = simulation.thresholds(simulation.grid(spark, simulation.Config(draws=40), [20, 40], 8), 0.05).first()
    assert 0 < bands.insulating_most <= 1 and bands.delta_band > 0


def test_scenarios_are_split_where_planted_so(spark):
    config = simulation.Config(draws=60)
    lineages = [("L1", None, "healthy", 0, 60, None), ("L2", "L1", "insulated", 1, 60, 1)]
    found = simulation.scenario(spark, config, lineages, 3, 4).cache()
    got = found.select("lineage_id", "window", "verdict.*").collect()
    assert len(got) == 20 and all(r.verdict == "closed" for r in got if r.lineage_id == "L2" and r.window == 2)
    assert not any(r.verdict == "insulated" for r in got if r.lineage_id == "L1")
    assert not any(r.verdict == "healthy" for r in got if r.lineage_id == "L2")
    assert all((r.reason is not None) == (r.verdict == "indeterminate") for r in got)
    power = simulation.pilot_power(found, "split").first()
    assert power.replicates == 4 and 0 <= power.power <= 1
    share = simulation.recovery(simulation.grid(spark, config, [60], 6)).collect()
    assert abs(sum(r.share for r in share if r.profile == "healthy") - 1) < 1e-9


def test_memberships():
    rows_ = simulation.memberships([("a", 0, 10, None), ("b", 1, 6, "a")], 3, 0.2, 1)
    of = lambda n, w: {m for x, y, m in rows_ if x == n and y == w}
    assert len(of("a", 0)) == len(of("a", 2)) == 10 and len(of("a", 0) & of("a", 1)) == 8 and len(of("b", 1) & of("a", 1)) == 3


def test_dependency_cycle_raises(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "name string, upstream string")
    with pytest.raises(Exception, match="cycle"):
        graph.dependency_order(links, ["a"]).collect()


def test_union_first_and_diff(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert rows(core.union_first([a, b], ["k"]), "k", "v") == [(1, "a"), (2, "c")]


def test_catalogue_rule(spark):
    from test_functions import refs

    wanted = [
        dict(year=1999, volume="D12", first_page="7", journal="J. Things", text="Lee A."),
        dict(year=1999, volume="12", first_page="8", journal="J. Things", text="Lee A."),
        dict(year=2009, volume="12", first_page="7", journal="J. Things", text="Lee A."),
        dict(year=1999, volume="12", journal="J. Things", text="Lee A. No page."),
        dict(year=1999, volume="12", first_page="7", journal="Other", text="Lee A."),
        dict(year=1999, first_page="7", journal="J. Things", text="Lee A."),
    ]
    df = refs(spark, wanted).select(F.col("i").alias("ref_id"), "ref")
    entry = [(["Journal of Things"], 2000, "12", "7", "lee")]
    entries = spark.createDataFrame(entry, "aliases array<string>, year int, volume string, first_page string, first_author string")
    assert sorted(r.ref_id for r in census.catalogue_matches(df, entries, 1).collect()) == [0, 3]


def test_reference_matches_break_ties_by_journal(spark):
    from test_functions import refs

    df = refs(spark, [dict(year=1986, volume="56", first_page="3", journal="Phys. Rev. Lett."), dict(year=1986, volume="57", first_page="3", journal="Nature"), dict(year=1990, volume="1", first_page="1"), dict(year=1978)])
    works = [(1986, "56", "3", "Physical Review Letters"), (1987, "56", "3", "Physics Letters B"), (1986, "57", "3", "A"), (1986, "57", "3", "B")]
    found = census.match_references(df.select(F.col("i").alias("ref_id"), "ref"), spark.createDataFrame(works, "year int, volume string, first_page string, journal string"), 1)
    assert {r.ref_id: r.match for r in found.collect()} == {0: True, 1: False, 2: False, 3: None}


def test_frames_and_windows_of_a_census(spark):
    rows_ = spark.createDataFrame([("L1@1990", 0.5, True), ("L@2@1991", 0.25, False)], "frame_id string, coverage double, measurable boolean")
    got = {(r.lineage_id, r.window_start): r.coverage for r in census.coverage_by_window(rows_).collect()}
    assert got == {("L1", 1990): 0.5, ("L@2", 1991): None}
    frames = spark.createDataFrame([("f", "W1"), ("f", "W1"), ("f", "W2"), ("g", "W1")], "frame_id string, work_id string")
    assert rows(census.frame_counts(frames), "frame_id", "works") == [("f", 2), ("g", 1)]
    from corvane.sources.bibliographic import cut_listing

    at = spark.createDataFrame([(0, 100), (9900, 99), (9900, 50)], "o int, n int").select(cut_listing(F.col("o"), F.col("n"), 99, 10000)).collect()
    assert [r[0] for r in at] == [False, True, False]


def test_ties_are_read_toward_both_sides(spark):
    """Where neither side is favoured a commitment is measured toward both, and the verdict does not depend on which comes first."""
    import numpy as np

    from corvane.plans import simulation

    config = simulation.Config(draws=40)
    rows = []
    for k in range(30):
        e = simulation.plant_commitment(config.profiles["insulated"], 12, config, np.random.default_rng(k))
        n = len(e["favourable"])
        e = e | {"favourable": np.arange(n) % 2 == 0, "labels": np.full_like(e["labels"], simulation.SUPPORT), "cited": np.arange(n) < n // 2 * 2}
        m = simulation.measure(e, config, np.random.default_rng(k))
        if m["side"] == "both":
            rows.append(m)
    assert rows and all([o["side"] for o in m["oriented"]] == ["p", "not_p"] for m in rows)
    rows = [{"profile": "x", "members": 12, "replicate": i} | m for i, m in enumerate(rows)]
    turned = [r | {"oriented": r["oriented"][::-1]} for r in rows]
    read = lambda some: [tuple(r.verdict)[:3] for r in simulation.verdicts(spark.createDataFrame([tuple(x[c] for c in simulation.GRID_COLUMNS) for x in some], simulation.GRID)).orderBy("replicate").collect()]
    first, second = read(rows), read(turned)
    assert [x[:2] for x in first] == [x[:2] for x in second]


def test_bootstrap_joins_draws_by_sorting(spark):
    """Draws and items both grow with the input: neither is broadcast. Rows are drawn by place, as a plain loop draws them, also where ids repeat."""
    from corvane.plans import catalog

    df = catalog.QUERIES["bootstrap_interval"](spark, "/root/testdata/sf0.001")
    assert len(df.collect()) == 5
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [_place" in plan
    items = [("a", i // 2, float(i // 2)) for i in range(40)] + [("b", i, float(i)) for i in range(7)] + [(None, 1, 1.0)]
    drawn = measures.bootstrap_draws(spark.createDataFrame(items, "g string, i long, v double").repartition(3), ["g"], "i", 4, 11, ["v"])
    want = []
    for g in "ab":
        mine = sorted(x for x in items if x[0] == g)
        for d in range(4):
            for k in range(len(mine)):
                at = int(hashlib.md5(f"11:{g}:{d}:{k}".encode()).hexdigest()[:12], 16) % len(mine)
                want.append((g, d, mine[at][1], mine[at][2]))
    assert sorted(map(tuple, drawn.collect())) == sorted(want)


def test_range_counts_do_not_pair_rows(spark):
    """3,000 alike references and works are 9,000,000 pairs; only their counted values meet. Nulls meet nothing."""
    df = spark.range(3000).selectExpr("id", "'k' as k", "cast(id % 3 as int) as size").unionByName(spark.createDataFrame([(9001, None, 1), (9002, "k", None), (9003, "l", 1)], "id long, k string, size int"))
    got = {r.id: r.candidates for r in census.range_counts(df, df, ["k"], "size", 1).collect()}
    assert got == {i: 3000 if i % 3 == 1 else 2000 for i in range(3000)} | {9001: 0, 9002: 0, 9003: 1}
    from corvane.plans import catalog

    part = spark.createDataFrame([(i, "b", "t", i % 50) for i in range(1000)], "p_partkey long, p_brand string, p_type string, p_size int")
    import tempfile

    folder = tempfile.mkdtemp(prefix="corvane-part-")
    part.write.parquet(f"{folder}/part.parquet")
    query = catalog.QUERIES["biblio_range_match"](spark, folder)
    assert {r.candidates for r in query.collect()} == {40, 60}
    met = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if "Join" in name and plan.metrics().contains("numOutputRows"):
            met.append(plan.metrics().get("numOutputRows").get().value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(query._jdf.queryExecution().executedPlan())
    assert met and max(met) <= 1000


def test_range_counts_name_the_links(spark, tmp_path):
    """Classes and their links hold every pair of the join; a work without an id is no candidate, as in the SQL."""
    from corvane.plans import catalog

    duckdb = pytest.importorskip("duckdb")
    rows = [(i, "bc"[i % 2], "t" if i % 7 else None, [1, 2, 3, 5, 8, 9, None][i * i % 11 % 7]) for i in range(200)]
    links_of = {}
    for at, part in enumerate((rows, [*rows, (None, "b", "t", 2), (None, "b", "t", 4), (None, "z", "t", 4), (900, "z", "t", 5)])):
        folder = f"{tmp_path}/{at}"
        spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
        got = catalog.QUERIES["biblio_range_match"](spark, folder).collect()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
        want = con.execute(f"SELECT ref, candidates, class_id, links FROM ({catalog.ORACLE_SQL['biblio_range_match']})").fetchall()
        assert sorted(((r.ref, r.candidates, r.class_id, r.links) for r in got), key=repr) == sorted(want, key=repr)
        links_of[at] = {r.ref: r for r in got}
    assert links_of[1][900].candidates == 1 and links_of[1][900].links == [900]
    members = {}
    for r in links_of[0].values():
        members.setdefault(r.class_id, []).append(r.ref)
    pairs = sorted((r.ref, b) for r in links_of[0].values() for c in r.links for b in members[c])
    near = sorted((a[0], b[0]) for a in rows for b in rows if None not in (*a, *b) and a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 1)
    assert pairs == near and any(a != b for a, b in pairs)
    assert all(sum(len(members[c]) for c in r.links) == r.candidates for r in links_of[0].values())
