"""The ordinal classifier against a version by loops over documents and features."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import quality, queries


def slow_features(text):
    raw = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", (text or "").encode()) if w]
    size = quality.FEATURES
    found = {zlib.crc32(w.lower()) % size for w in raw} | {zlib.crc32(w[-3:], 1) % size for w in raw}
    if raw:
        count = len(raw)
        shares = [sum(w.isupper() for w in raw) / count, sum(w[-1] < 128 and not chr(w[-1]).isalnum() for w in raw) / count, 1 - len(set(raw)) / count, sum(len(w) == 1 for w in raw) / count]
        lines = [x for x in text.split("\n") if x.strip()]
        if lines:
            shares.append(1 - len(Counter(lines)) / len(lines))
        found |= {zlib.crc32(f"share {k} {int(10 * s)}".encode(), 2) % size for k, s in enumerate(shares)}
    return sorted(found | {zlib.crc32(f"words {len(raw).bit_length()}".encode(), 3) % size})


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def slow_fit(rows, grades, count=3):
    """Follow-the-regularised-leader steps on the likelihood of cumulative links, one document and feature at a time."""
    seen = Counter(grades)
    totals = [seen[k] + 1.0 for k in range(count)]
    above = [1 - sum(totals[: k + 1]) / sum(totals) for k in range(count - 1)]
    theta = [math.log((1 - a) / a) for a in above]
    w, z, n = Counter(), Counter(), Counter()
    steps = [1e-8] * (count - 1)
    rng = np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        order = rng.permutation(len(rows)).tolist()
        for at in range(0, len(order), quality.STEP):
            slope, turn = Counter(), [0.0] * (count - 1)
            for i in order[at : at + quality.STEP]:
                score, g = sum(w[f] for f in rows[i]), grades[i]
                below = [sigmoid(t - score) for t in theta]
                low, high = ([0.0, *below][g], [*below, 1.0][g])
                for f in rows[i]:
                    slope[f] += 1 - low - high
                chance = max(high - low, 1e-12)
                for k, b in enumerate(below):
                    turn[k] += ((g == k + 1) - (g == k)) * b * (1 - b) / chance
            for f, g in slope.items():
                move = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / quality.RATE
                z[f] += g - move * w[f]
                n[f] += g * g
                w[f] = 0.0 if abs(z[f]) <= quality.L1 else -(z[f] - math.copysign(quality.L1, z[f])) / ((quality.OFFSET + math.sqrt(n[f])) / quality.RATE + quality.L2)
            for k in range(count - 1):
                steps[k] += turn[k] ** 2
                theta[k] -= 0.1 * turn[k] / math.sqrt(steps[k])
            for k in range(1, count - 1):
                theta[k] = max(theta[k], theta[k - 1] + quality.LEAST_GAP)
    return w, theta


def test_query_equals_slow(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("length(text) < 4000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rated = spark.read.parquet(f"{source}/labels.parquet").select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("g")).collect()
    known = sorted((r.doc_id, r.g) for r in rated if r.g is not None and r.doc_id in texts)
    assert len(known) > 30 and len({g for _, g in known}) == 3
    w, theta = slow_fit([slow_features(texts[k]) for k, _ in known], [g for _, g in known])
    for r in queries.op6_quality(spark, str(tmp_path)).collect():
        score = sum(w[f] for f in slow_features(texts[r.doc_id]))
        tail = [sigmoid(score - t) for t in theta]
        assert (r.p_not_toxic, r.p_good, r.expected_grade) == pytest.approx((*tail, sum(tail)), abs=1e-6)
        assert r.keep == (r.p_good >= quality.KEEP)
