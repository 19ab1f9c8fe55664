"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds
cut its score, P(grade >= k) = sigmoid(score - threshold_k). It is fitted in numpy by
follow-the-regularised-leader steps, whose L1 term leaves only telling features, on a
bounded sample of the rated documents; every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rated documents that are fitted on at most: those with the least hashes of their keys.
SAMPLE = 12_000
#: Hashed features, passes over the sample, documents a step.
FEATURES, EPOCHS, STEP = 1 << 18, 8, 64
#: Learning rate, its offset, L1 and L2 of the leader's steps.
RATE, OFFSET, L1, L2 = 1.0, 1.0, 4.0, 0.02
#: Thresholds stay in order, so far apart at least.
LEAST_GAP = 1e-3
#: The probability of the top grade from which a document is kept.
KEEP = 0.5

MODEL = "expected_grade double, tail array<double>, keep boolean"


def grade(quality: Column, toxic: Column) -> Column:
    """Ratings in order: 0 toxic, 1 poor, 2 good; null without any rating."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def features(text) -> np.ndarray:
    """Distinct feature numbers of a whole text: words, their last three bytes as written, and shares in tenths."""
    raw = text.encode("utf-8", "replace").split() if isinstance(text, str) else []
    distinct = set(raw)
    crc, mask = zlib.crc32, FEATURES - 1
    found = {crc(w.lower()) & mask for w in distinct}
    found.update({crc(w[-3:], 1) & mask for w in distinct})
    if raw:
        shares = (
            sum(map(bytes.isupper, raw)) / len(raw),
            sum(not w[-1:].isalnum() and w[-1] < 128 for w in raw) / len(raw),
            1 - len(distinct) / len(raw),
            sum(len(w) == 1 for w in raw) / len(raw),
        )
        lines = [x for x in text.split("\n") if x.strip()]
        shares += (1 - len(set(lines)) / len(lines),) if lines else ()
        found.update(crc(b"share %d %d" % (k, int(10 * s)), 2) & mask for k, s in enumerate(shares))
    found.add(crc(b"words %d" % len(raw).bit_length(), 3) & mask)
    return np.fromiter(found, dtype=np.int64, count=len(found))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """Shared weights and ordered thresholds of grades 0 to ``grades`` - 1."""

    def __init__(self, grades: int = 3) -> None:
        self.grades = grades
        self.weights = np.zeros(FEATURES)
        self.thresholds = np.array([])
        self.fitted = False

    def fit(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Ordinal:
        """``rows``: feature numbers of each document, ``y``: its grade. One grade or none: base rates only."""
        counts = np.bincount(y, minlength=self.grades)[: self.grades] + 1.0
        above = 1 - np.cumsum(counts)[:-1] / counts.sum()
        theta = np.log((1 - above) / above)
        self.thresholds, self.fitted = theta, len(set(y.tolist())) > 1
        if not self.fitted:
            return self
        w, z, n = self.weights, np.zeros(FEATURES), np.zeros(FEATURES)
        steps = np.full(len(theta), 1e-8)
        gaps = LEAST_GAP * np.arange(len(theta))
        rng = np.random.default_rng(seed)
        sizes = np.array([len(r) for r in rows])
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), STEP):
                batch = order[at : at + STEP]
                index = np.concatenate([rows[i] for i in batch])
                doc = np.repeat(np.arange(len(batch)), sizes[batch])
                score = np.bincount(doc, weights=w[index], minlength=len(batch))
                below = _sigmoid(theta[None, :] - score[:, None])
                edge = np.hstack([np.zeros((len(batch), 1)), below, np.ones((len(batch), 1))])
                mine = y[batch]
                low, high = edge[np.arange(len(batch)), mine], edge[np.arange(len(batch)), mine + 1]
                slope = 1 - low - high  # of the loss, by the score
                g = np.bincount(index, weights=slope[doc], minlength=FEATURES)
                hit = np.unique(index)
                gh = g[hit]
                move = (np.sqrt(n[hit] + gh * gh) - np.sqrt(n[hit])) / RATE
                z[hit] += gh - move * w[hit]
                n[hit] += gh * gh
                zh = z[hit]
                w[hit] = np.where(np.abs(zh) <= L1, 0.0, -(zh - np.sign(zh) * L1) / ((OFFSET + np.sqrt(n[hit])) / RATE + L2))
                # Thresholds: those at either end of the document's grade.
                chance = np.maximum(high - low, 1e-12)
                dense = below * (1 - below)
                gt = np.zeros(len(theta))
                for k in range(len(theta)):
                    gt[k] = ((mine == k + 1) * dense[:, k] / chance - (mine == k) * dense[:, k] / chance).sum()
                steps += gt * gt
                theta -= 0.1 * gt / np.sqrt(steps)
                theta = np.maximum.accumulate(theta - gaps) + gaps
        self.thresholds = theta
        return self

    def tails(self, texts) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of whole texts."""
        w = self.weights
        score = np.fromiter((w[features(t)].sum() for t in texts), dtype=np.float64, count=len(texts))
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def grades_of(self, texts) -> pd.DataFrame:
        tail = self.tails(texts)
        keep = tail[:, -1] >= KEEP if self.fitted else np.ones(len(tail), dtype=bool)
        return pd.DataFrame({"expected_grade": tail.sum(axis=1), "tail": list(tail), "keep": keep})


def rated_sample(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, grade, text) of at most ``sample`` rated documents. ``ratings`` has the key and grade; nulls are left out."""
    rated = ratings.where(F.col("grade").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col("grade").cast("int").alias("grade"))
    rated = rated.groupBy("k").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("k"), "k").limit(sample)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    # The sample is bounded, and of a document's repeated rows one is taken.
    return texts.join(F.broadcast(rated), "k").groupBy("k", "grade").agg(F.min("t").alias("text"))


def fit(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, grades: int = 3) -> Ordinal:
    """Fit on the rated sample; executors send feature numbers, not texts."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "grade": batch["grade"], "features": [np.sort(features(t)).astype(np.int32) for t in batch["text"]]})

    rows = rated_sample(docs, ratings, key, text, sample).mapInPandas(number, "k long, grade int, features array<int>").toArrow()
    rows = rows.sort_by("k")
    values = rows["features"].combine_chunks()
    flat, cuts = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.offsets.to_numpy()
    return Ordinal(grades).fit([flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])], rows["grade"].to_numpy().astype(np.int64))


def graded(docs: DataFrame, model: Ordinal, text: str = "text", out: str = "rating") -> DataFrame:
    """Add (expected_grade, tail, keep) of each row's whole text; null and empty texts are scored as texts without words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(MODEL)
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield held.value.grades_of(batch)

    return docs.withColumn(out, rate(F.col(text)))
