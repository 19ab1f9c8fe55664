import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corvane.llm import queries, simhash


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: {class value: least key}; all pairs are compared."""
    values = list(prints)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    array = np.array(values, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(array ^ array[i]) <= 2)[0]:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, v in enumerate(values):
        least[find(i)] = min(least.get(find(i), prints[v]), prints[v])
    return {v: least[find(i)] for i, v in enumerate(values)}


def test_golay_words_at_distance_two_share_an_index():
    rng = random.Random(5)
    for _ in range(3000):
        a = rng.getrandbits(23)
        b = a
        for place in rng.sample(range(23), rng.choice((0, 1, 2))):
            b ^= 1 << place
        ka, kb = simhash.golay_keys(np.array([a, b]))
        assert set(ka[ka >= 0]) & set(kb[kb >= 0])
    counts = (simhash.golay_keys(np.arange(1 << 14)) >= 0).sum(1)
    assert set(counts) == {1, 6}


def test_query_equals_all_pairs(spark, sf_dir):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {k: slow_fingerprint(t) for k, t in docs.items()}
    classes = {}
    for k, v in prints.items():
        classes[v] = min(classes.get(v, k), k)
    rooted = slow_components(classes)
    assert got == {k: (f"{v:016x}", rooted[v]) for k, v in prints.items()}
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("bucket", [1, 4, 32])
def test_crowded_keys_lose_no_link(spark, bucket):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(400):
        v = centre
        for place in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
            v ^= 1 << place
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from corvane.llm.components import connected_components

    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket)
    bad = edges.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) > 2)
    assert bad.count() == 0
    got = {r.node: r.component for r in connected_components(edges).collect()}
    groups = {}
    for s in signed:
        groups.setdefault(got.get(s, s), set()).add(s)
    slow = slow_components({v: s for v, s in zip(values, signed)})
    expected = {}
    for v, s in zip(values, signed):
        expected.setdefault(slow[v], set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[5].component_id == by[6].component_id == 5
    assert by[4].fp == np.array([xxhash.xxh64_intdigest(b"one", 42)], dtype=np.uint64).view(np.int64)[0]
    assert by[None].component_id is None
    assert simhash.near_duplicates(no_docs).count() == 0


def slow_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(texts):
    sets = {k: slow_set(t) for k, t in texts.items()}
    root = dict.fromkeys(sets)
    for k in sorted(sets):
        if root[k] is None:
            root[k], todo = k, [k]
            while todo:
                a = sets[todo.pop()]
                for m, b in sets.items():
                    if root[m] is None and (a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))):
                        root[m] = k
                        todo.append(m)
    return root


def planted():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 150))]
        for edits in (0, 1, 2, 3, 4, 6):
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = word()
            texts.append(" ".join(w))
    texts += [" ".join(common + [word() for _ in range(rng.randint(5, 60))]) for _ in range(30)]
    texts += ["", None, " \t", "one two", "One TWO", "one two three"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("bucket", [32, 2])
def test_similar_texts_equal_slow(spark, bucket):
    texts = planted()
    df = spark.createDataFrame([(k, t, k + 100) for k, t in texts.items()], "doc_id long, text string, row_id long").selectExpr("*", "1 as no", "2 as low", "3 as sig")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(df, bucket=bucket).collect()}
    mostly_equal(got, slow_groups(texts))


def mostly_equal(got, want):
    """No text is in a group that is not its own, and nearly all are in the whole of it."""
    assert got.keys() == want.keys() and all(want[k] == want[c] for k, c in got.items())
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)


def test_similar_texts_of_one_crowd(spark):
    """Edits of one text: nearly all keys are crowded, and no pair is lost."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = {}
    for k in range(300):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(0, 5)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(w)
    df = spark.createDataFrame([(k, t, k + 100) for k, t in texts.items()], "doc_id long, text string, row_id long")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(df, bucket=8).collect()}
    mostly_equal(got, slow_groups(texts))


def test_meetings_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate([rng.integers(0, 40, 200), np.full(90, 41), np.full(33, 42), np.full(32, 43)])) << 8 | 30
    rows = pd.DataFrame({"key": key, "no": rng.permutation(len(key)), "low": rng.integers(-1 << 63, 1 << 63, len(key)), "high": 0})
    rows.loc[rng.choice(200, 60, replace=False), "low"] = 7
    want = {a.no for _, g in rows.groupby("key") for a in g.itertuples() if len(g) > 32 or any(a.no != b.no and ((int(a.low) ^ int(b.low)) & (1 << 64) - 1).bit_count() <= simhash.APART for b in g.itertuples())}
    for size in (1, 7, 32, 1000):
        out = pd.concat(list(simhash._meetings(32)(rows.iloc[at : at + size] for at in range(0, len(rows), size))))
        near = set(out["no"])
        assert near == {x for x in near if x in want} and want <= near


def test_pieces_of_eleven_errors_share_a_key():
    rng = np.random.default_rng(6)
    for _ in range(300):
        low, high = rng.integers(0, 1 << 63, 2)
        flips = rng.choice(128, 11, replace=False)
        other = [low, high]
        for f in flips:
            other[f // 64] = np.int64(np.uint64(other[f // 64]) ^ np.uint64(1 << int(f % 64)))
        a = simhash.wide_keys(np.array([low]), np.array([high]))[1]
        b = simhash.wide_keys(np.array([other[0]]), np.array([other[1]]))[1]
        assert set(a) & set(b)


def test_similar_texts_of_odd_rows(spark, odd_docs, no_docs):
    got = simhash.similar_texts(odd_docs.withColumn("r", F.monotonically_increasing_id()), row="r").collect()
    assert len(got) == 11
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5 and by[7] == 7 and by[None] is None
    assert simhash.similar_texts(no_docs.withColumn("r", F.lit(1)), row="r").count() == 0


def test_stage_drops_edited_copies(spark, sf_dir):
    """A copy with two changed words of a hundred is beyond two bits of SimHash but shares nine tenths of its shingles."""
    w = [f"word{i}" for i in range(100)]
    edited = [*w[:20], "other", *w[21:70], "another", *w[71:]]
    rows = [(1, " ".join(w)), (2, " ".join(edited)), (3, " ".join(w[:50]))]
    docs = cp.written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "edited")
    assert sorted(r.doc_id for r in cp.one_of_each(spark, docs, sf_dir).collect()) == [1, 3]
