import re
from collections import defaultdict

import pytest

from corvane.llm import mixing, queries


def slow_targets(sizes):
    """Reshare the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, {}
    while True:
        left = [s for s in names if s not in fixed]
        share = sum(weight[s] for s in left)
        target = fixed | {s: (total - sum(fixed.values())) * weight[s] / share for s in left}
        over = [s for s in left if target[s] > 3 * sizes[s]]
        if not over:
            return target
        fixed |= {s: 3 * sizes[s] for s in over}


def checked(rows, sizes, slack=4):
    """``slack``: blocks that a source may be off its target by."""
    target = slow_targets(sizes)
    block = max(1, -(-sum(sizes.values()) // mixing.LEAST_SLOTS))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= slack * block


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query_against_plain_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == words(texts[r.doc_id].text)
        sizes[r.source] += r.size
    assert len(rows) == len(texts)
    checked(rows, sizes)
    again = queries.op3_mixing(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.taken, r.first_slot if r.taken else -1) for r in rows) == sorted((r.doc_id, r.taken, r.first_slot if r.taken else -1) for r in again)


def test_caps_and_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 11
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    checked(rows, sizes)
    assert sizes["a"] == 0 and sizes[None] == 6
    assert mixing.mix(no_docs).count() == 0
    blank = mixing.mix(odd_docs.where("doc_id <= 3")).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 3


def shares_of(spark, sizes):
    return mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3))


def test_prefixes_of_the_schedule_hold_the_shares(spark):
    shares = shares_of(spark, {"a": 1000, "b": 2000, "c": 3000, "d": 0, None: 10})
    target = {r.source_no: r.target for r in shares.collect()}
    slots = mixing.schedule(shares, 40_000).collect()
    assert sorted(r.slot for r in slots) == list(range(40_000))
    for upto in (100, 1000, 40_000):
        for no, t in target.items():
            assert abs(sum(r.source_no == no for r in slots if r.slot < upto) - t / 6010 * upto) < 8
    for no in target:
        assert [r.rank for r in sorted(slots, key=lambda r: r.slot) if r.source_no == no] == list(range(sum(r.source_no == no for r in slots)))


def test_points_keep_their_digits(spark):
    from decimal import Decimal, getcontext

    getcontext().prec = 50
    golden = (Decimal(5).sqrt() - 1) / 2
    for r in mixing.points(spark, 1 << 22).where("slot % 100003 = 0").collect():
        assert abs(Decimal(r.x) - golden * r.slot % 1) < Decimal("1e-9")


def slow_taken(docs, points, shares, block):
    """The mix by lists of single words: docs (id, source, words) in their order, a slot after another."""
    stream, taken, first = defaultdict(list), defaultdict(int), {}
    for k, source, size in docs:
        stream[source] += [k] * size
    ends, low = [], 0.0
    total = sum(shares.values())
    for source, target in shares.items():
        ends.append((low, low + target / total, source))
        low += target / total
    rank = defaultdict(int)
    for slot, x in enumerate(points):
        source = next((s for a, b, s in ends if a <= x < b), ends[-1][2])
        words = (stream[source] * 3)[rank[source] * block : (rank[source] + 1) * block]
        rank[source] += 1
        for k in words:
            taken[k] += 1
            first.setdefault(k, slot)
    return dict(taken), first


@pytest.mark.parametrize("points", ["golden", "skewed"])
def test_taken_follows_the_slots(spark, points):
    """Against a plain version, and with other points: what is taken is what the slots take."""
    sizes = [(k, "abc"[k % 3], 5 + k * 7 % 11) for k in range(60)]
    df = spark.createDataFrame([(k, s, " ".join(["w"] * n)) for k, s, n in sizes], "doc_id long, source string, text string")
    total = sum(n for *_, n in sizes)
    slots, block = -(-total // 4), 4
    x = [r.x for r in mixing.points(spark, slots).orderBy("slot").collect()]
    x = x if points == "golden" else [0.01 if i % 2 else v for i, v in enumerate(x)]
    at = spark.createDataFrame(list(enumerate(x)), "slot long, x double")
    order = [r.doc_id for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) h").selectExpr("*", "shiftrightunsigned(h, 56) p").orderBy("p", "h").collect()]
    by = {k: (k, s, n) for k, s, n in sizes}
    source_sizes = defaultdict(int)
    for _, s, n in sizes:
        source_sizes[s] += n
    want, first = slow_taken([by[k] for k in order], x, slow_targets(source_sizes), block)
    rows = mixing.mixed(df.withColumn("r", df.doc_id), row="r", slots=slots, at=at).collect()
    assert {r.doc_id: r.taken for r in rows if r.taken} == want
    assert {r.doc_id: r.first_slot for r in rows if r.taken} == first
