import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import gru, queries
from corvane.llm import lm_scoring as lm


def toks(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), ""]


def base_of(docs):
    out = {k for k, _ in docs if zlib.crc32(str(k).encode()) % 10 == 0}
    counts = Counter(t for k, text in docs if k not in out for t in toks(text))
    n, v = sum(counts.values()), len(counts)
    rows = {}
    for k, text in docs:
        found = toks(text)
        rows[k] = (k in out, len(found), sum(counts[t] > 0 for t in found), n, sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found))
    return rows


def test_query_base_and_gain(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", 3000)
    got = {r.doc_id: r for r in lm.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    want = base_of([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    assert got.keys() == want.keys()
    for k, (held, n, known, total, base) in want.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert np.isfinite(r.score) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.97


def test_table_size_does_not_change_the_base(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 200")
    want = base_of([(r.doc_id, r.text) for r in docs.collect()])
    for r in queries.lm_scoring.score_documents(docs).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def _small(seed=0):
    rng = np.random.default_rng(seed)
    flat = gru.initial(rng.integers(1, 50, gru.WORDS).astype(float), rng.random(gru.ENDINGS) * 900 + 1, seed)
    return gru.Gru(flat + rng.normal(0, 0.05, gru.SIZE).astype(np.float32)), rng


def test_chances_sum_to_one():
    model, rng = _small()
    tokens = np.arange(gru.WORDS + gru.ENDINGS)
    state = np.tile(rng.normal(size=(1, gru.UNITS)).astype(np.float32), (len(tokens), 1))
    assert np.exp(model.log_chance(state, tokens).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_windows_and_lanes_do_not_change_scores(monkeypatch):
    model, rng = _small(1)
    texts = [rng.integers(0, gru.WORDS + gru.ENDINGS, n) for n in (1, 700, 3, 40, 40, 17, 2)]
    whole = []
    for t in texts:
        states, _ = model.forward(t[:, None], np.ones((len(t), 1), np.float32), np.zeros((1, gru.UNITS), np.float32))
        whole.append(model.log_chance(states[:, 0], t).sum())
    for lanes, steps in ((1, 5), (3, 16), (512, 64)):
        monkeypatch.setattr(gru, "SCORE_LANES", lanes)
        monkeypatch.setattr(gru, "SCORE_STEPS", steps)
        assert np.allclose(model.score(texts), whole, rtol=1e-4)


def test_gradients_are_those_of_the_loss(monkeypatch):
    model, rng = _small(2)
    texts = [rng.integers(0, gru.WORDS + gru.ENDINGS, n) for n in (29, 25, 6)]
    monkeypatch.setattr(gru, "LEARN_LANES", 2)
    monkeypatch.setattr(gru, "LEARN_STEPS", 40)
    grads = {}

    def keep(self, name, grad, at=slice(None)):
        grads.setdefault(name, np.zeros(gru.SHAPES[name]))[at] += grad

    monkeypatch.setattr(gru.Gru, "_move", keep)
    model.learn(texts)
    n = 2 * 40
    double = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss(p):
        model.p = p
        return -model.score(texts).sum() / n

    for name in gru.SHAPES:
        flat = grads[name].ravel()
        for at in np.argsort(-np.abs(flat))[:4]:
            up, down = {k: v.copy() for k, v in double.items()}, {k: v.copy() for k, v in double.items()}
            up[name].ravel()[at] += 1e-2
            down[name].ravel()[at] -= 1e-2
            assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(flat[at], rel=0.05, abs=1e-4)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = lm.score_documents(odd_docs).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[None].held_out and by[8].n_tokens == 80_001
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert lm.score_documents(no_docs).count() == 0
    alone = lm.score_documents(odd_docs.where("doc_id is null")).first()
    assert (alone.train_tokens, alone.n_known) == (0, 0) and np.isfinite(alone.score)
