from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_decontamination import slow_leaks
from test_line_dedup import slow_dedup
from test_mixing import slow_targets, words
from test_simhash import slow_groups

import corpus_pipeline as cp
from corvane.llm import mixing, quality


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_equal_slow_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, held = [], docs
    for name, stage in cp.STAGES:
        held = cp.written(stage(spark, held, sf_dir), f"test-{name}")
        got.append(held)
        if name != "mixing":
            assert held.columns == docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("grade", quality.grade(F.col("quality"), F.col("toxic")))
    model = quality.fit(docs, labels)
    rows = by_id(docs)
    kept = sorted(k for k, r in rows.items() if model.grades_of([r.text]).keep[0])
    first = by_id(got[0])
    assert sorted(first) == kept and all(first[k] == rows[k] for k in kept)

    lines = {k: text for k, n, left, text in slow_dedup([(k, first[k].text) for k in kept]) if left or not n}
    second = by_id(got[1])
    assert {k: r.text for k, r in second.items()} == lines
    assert all(r.n_chars == len(r.text) for k, r in second.items() if r.text != rows[k].text)

    rooted = slow_groups(lines)
    third = by_id(got[2])
    assert set(third) >= set(rooted.values()) and len(third) <= 1.01 * len(set(rooted.values()))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {k for k, *_ in slow_leaks([(k, r.text) for k, r in third.items()], items)}
    fourth = by_id(got[3])
    assert sorted(fourth) == sorted(set(third) - leaked)

    last = by_id(got[4])
    sizes, taken = defaultdict(int), defaultdict(int)
    for k, r in fourth.items():
        sizes[r.source] += words(r.text)
    for k, r in last.items():
        assert 0 < r.mix_words <= 3 * words(r.text) and r.text == fourth[k].text
        taken[r.source] += r.mix_words
    for s, t in slow_targets(sizes).items():
        assert abs(taken[s] - t) <= 4 * max(1, -(-sum(sizes.values()) // mixing.LEAST_SLOTS))
    ran = by_id(cp.run(spark, sf_dir))
    assert ran.keys() == last.keys() and all(ran[k] == last[k] for k in ran)


@pytest.mark.parametrize("rows", [11, 0])
def test_odd_rows(spark, odd_docs, sf_dir, rows):
    clash = ["_row", "row", "rating", "_rating", "order", "k", "t", "mix_words", "mix_slot", "carried", "s", "no"]
    docs = odd_docs.limit(rows).selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(clash)])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        kept = [c for c in docs.columns if name != "mixing" or not c.startswith("mix_")]
        assert out.columns[: len(kept)] == kept
        docs = cp.written(out, f"odd-{name}")
    got = docs.collect()
    assert len(got) <= rows and all(r[c] == i for r in got for i, c in enumerate(clash) if not c.startswith("mix_"))
    assert mixing.MOST_PASSES == 3
