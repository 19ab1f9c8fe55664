import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import line_dedup, queries


def words_of(line):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", line))


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def slow_dedup(docs):
    """docs: (key, text) in row order. All classes of like length are compared."""
    first = {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    for r in order:
        for at, line in enumerate((docs[r][1] or "").split("\n")):
            if words_of(line):
                first.setdefault(words_of(line), (order.index(r), r, at))
    by_size = {}
    for w in first:
        by_size.setdefault(len(w), []).append(w)
    gone = set()
    for n, group in by_size.items():
        for a in group if n >= line_dedup.LEAST_WORDS else []:
            for m in (n - 1, n, n + 1):
                for b in by_size.get(m, []) if m >= line_dedup.LEAST_WORDS else []:
                    # One edit leaves the first or the last word alone.
                    if first[b] < first[a] and (a[0] == b[0] or a[-1] == b[-1]) and distance(a, b) == 1:
                        gone.add(a)
    kept = {(r, at) for w, (_, r, at) in first.items() if w not in gone}
    out = []
    for r, (k, text) in enumerate(docs):
        lines = (text or "").split("\n")
        worded = [i for i, x in enumerate(lines) if words_of(x)]
        out.append((k, len(worded), sum((r, i) in kept for i in worded), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in worded or (r, i) in kept)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_kept, r.clean_text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_planted_edits(spark, broadcast_rows):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(4, 12))] for _ in range(12)]
    docs = []
    for k in range(60):
        lines = []
        for _ in range(4):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 1, 1, 2))):
                at = rng.randrange(len(w))
                kind = rng.choice("sid")
                if kind == "s":
                    w[at] = rng.choice(vocab)
                elif kind == "i":
                    w.insert(at, rng.choice(vocab))
                elif len(w) > 3:
                    del w[at]
            lines.append(rng.choice(("", "  ")) + rng.choice((" ", "\t")).join(w))
        docs.append((k * 7 % 61, "\n".join(lines + [""])))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = line_dedup.with_row_id(df.select("doc_id", "text"))
    got = rows_of(line_dedup.deduped(rows, broadcast_rows=broadcast_rows))
    assert got == sorted(slow_dedup(docs), key=repr)
    assert any(n != kept for _, n, kept, _ in got)


def test_query_equals_slow(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_lines, r.n_kept, r.clean_text) for r in queries.op10_line_dedup(spark, sf_dir).collect()), key=repr)
    assert got == sorted(slow_dedup(docs), key=repr)


def test_within_one(spark):
    rows = [("a b c", "a b c"), ("a b c", "a x c"), ("a b c", "a c"), ("a b", "a b c"), ("a b c", "x b y"), ("a", "b"), ("a b c d", "a b"), ("a a a", "a a")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.within_one(F.split("a", " "), F.split("b", " ")).alias("near"))
    for r in df.collect():
        assert r.near == (distance(r.a.split(), r.b.split()) <= 1)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = line_dedup.dedup(odd_docs).collect()
    assert len(rows) == 11
    assert [r.clean_text for r in rows if r.doc_id == 1] == [None]
    assert [r.clean_text for r in rows if r.doc_id == 2] == [""]
    assert sorted(r.n_kept for r in rows if r.doc_id == 7) == [0, 1]
    assert line_dedup.dedup(no_docs).count() == 0
