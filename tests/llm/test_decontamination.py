import random

import numpy as np
import pytest

from corvane.llm import decontamination as d
from corvane.llm import queries


def slow_tiles(doc, item, least):
    """Greedy string tiling by comparing all places."""
    in_doc, in_item, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while j + k < len(item) and i + k < len(doc) and doc[i + k] == item[j + k] and i + k not in in_doc and j + k not in in_item:
                    k += 1
                if k > best[0]:
                    best = (k, j, i)
        if best[0] < least:
            return tiles
        k, j, i = best
        tiles.append((i, j, k))
        in_doc.update(range(i, i + k))
        in_item.update(range(j, j + k))


def slow_leaks(docs, items):
    out = []
    for k, text in docs:
        doc = d.tokens(text)
        for no, t in items:
            item = d.tokens(t)
            if item:
                least = min(d.LEAST_MATCH, len(item))
                runs = {tuple(doc[i : i + least]) for i in range(len(doc) - least + 1)}
                if not any(tuple(item[j : j + least]) in runs for j in range(len(item) - least + 1)):
                    continue
                covered = sum(x[2] for x in slow_tiles(doc, item, least)) / len(item)
                if covered >= d.COVERAGE:
                    out.append((k, no, covered))
    return out


def test_tiles_equal_slow_tiling():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randint(5, 20))]
        doc = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(item))
            doc += item[a : a + rng.randint(1, 9)] + [rng.randrange(8)]
        if len(doc) < 3:
            continue
        doc, item = np.array(doc), np.array(item)
        seeds = [(i, j) for i in range(len(doc) - 2) for j in range(len(item) - 2) if (doc[i : i + 3] == item[j : j + 3]).all()]
        got = d.tile(np.array(seeds), 3, len(item)) if seeds else []
        assert got == slow_tiles(doc.tolist(), item.tolist(), 3)


def test_query_equals_slow(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 9)) for r in queries.op5_decontamination(spark, sf_dir).collect())
    want = sorted((k, no, round(c, 9)) for k, no, c in slow_leaks(docs, items))
    assert got == want and got


@pytest.mark.parametrize("bits", [64, d.BITS])
def test_moved_passages_and_odd_rows(spark, odd_docs, no_docs, bits, monkeypatch):
    """With a bit table that rules out nothing, too: the join decides."""
    monkeypatch.setattr(d, "BITS", bits)
    passage = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa! Lambda mu nu xi omicron."
    moved = "Something else. LAMBDA mu nu, xi omicron -- alpha beta gamma delta epsilon and then zeta eta theta iota kappa"
    half = "alpha beta gamma delta epsilon only"
    docs = odd_docs.select("doc_id", "text", "size").union(spark.createDataFrame([(20, moved, 1), (21, half, 1), (None, passage, 1), (22, passage * 3000, 1)], "doc_id long, text string, size int"))
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "one two"), (None, passage)], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as coverage")
    got = d.leaks(docs, bench).collect()
    pairs = sorted(((r.doc_id, r.item_id) for r in got), key=repr)
    assert pairs == sorted([(k, i) for k in (20, None, 22) for i in (1, 1, None)] + [(5, 4), (6, 4)], key=repr)
    assert [len(r.tiles) for r in got if r.doc_id == 20] == [3, 3, 3]
    kept = d.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 15 - 5
    assert d.leaks(no_docs, bench).count() == 0
    assert d.leaks(docs, bench.limit(0)).count() == 0
    assert d.without_leaks(docs, bench.limit(0)).count() == 15


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("a", "one two three four five six"), (None, "nothing")], "doc_id string, text string")
    bench = spark.createDataFrame([("x", "two three four five six")], "item_id string, text string")
    assert [tuple(r)[:4] for r in d.leaks(docs, bench).collect()] == [("a", "x", 1.0, 5)]
    assert [r.doc_id for r in d.without_leaks(docs, bench).collect()] == [None]
