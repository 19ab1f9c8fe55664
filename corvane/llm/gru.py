"""Gated recurrent unit in numpy: truncated backpropagation and a class-factored softmax.

A token is one of ``WORDS`` core words, in classes of ``WIDE`` by rank, or stands for a class
of all other words with a like ending. The state before a token predicts its class,
and, for a core word, the word within the class. Texts are laid end to end in lanes that
advance together by windows; the state is carried from window to window and is zero where a text begins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Core words, words of a class, classes of other words, units of the state.
WORDS, WIDE, ENDINGS, UNITS = 2048, 64, 64, 16
CORE = WORDS // WIDE
CLASSES = CORE + ENDINGS
#: Lanes and steps of a window while learning and while scoring, and the learning rate.
LEARN_LANES, LEARN_STEPS, SCORE_LANES, SCORE_STEPS, RATE = 512, 16, 512, 16, 0.08
#: Lanes under which windows get longer, and how many times longer at most.
FEW_LANES, LONGER = 256, 8
ABSENT = -30.0
#: Tokens whose class exponents are held at once, so that they stay in a core's cache.
BLOCK = 1024

SHAPES = {
    "x": (WORDS + ENDINGS, 3 * UNITS),
    "u": (UNITS, 3 * UNITS),
    "wc": (UNITS, CLASSES),
    "bc": (CLASSES,),
    "wk": (CORE, UNITS, WIDE),
    "bk": (CORE, WIDE),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(core_counts: np.ndarray, class_mass: np.ndarray, seed: int = 0) -> np.ndarray:
    """Parameters whose predictions are the corpus's own rates: biases of classes and of core words."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, dtype=np.float32)
    p = unflatten(flat)
    p["x"][:] = rng.normal(0, 0.1, SHAPES["x"])
    p["u"][:] = rng.normal(0, 0.5 / np.sqrt(UNITS), SHAPES["u"])
    p["wc"][:] = rng.normal(0, 0.02, SHAPES["wc"])
    p["wk"][:] = rng.normal(0, 0.02, SHAPES["wk"])
    counts = np.zeros(WORDS)
    counts[: len(core_counts)] = core_counts
    p["bk"][:] = np.where(counts > 0, np.log(np.maximum(counts, 1)), ABSENT).reshape(CORE, WIDE)
    mass = np.concatenate([counts.reshape(CORE, WIDE).sum(1), class_mass])
    p["bc"][:] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / max(mass.sum(), 1e-9)), ABSENT)
    return flat


def lanes_of(texts: list[np.ndarray], most: int, order=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, text of each token, start of each lane, length of each lane), longest lane first. Every text has a token.

    Texts go to the shortest lane in the given order (longest first by default).
    """
    n = min(most, len(texts))
    lanes: list[list[int]] = [[] for _ in range(n)]
    load = [(0, k) for k in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])) if order is None else order:
        size, k = heapq.heappop(load)
        lanes[k].append(i)
        heapq.heappush(load, (size + len(texts[i]), k))
    sizes = np.array([sum(len(texts[i]) for i in lane) for lane in lanes])
    order = np.argsort(-sizes, kind="stable")
    flat = [i for k in order for i in lanes[k]]
    tokens = np.concatenate([texts[i] for i in flat])
    owner = np.repeat(np.array(flat, dtype=np.int32), [len(texts[i]) for i in flat])
    lengths = sizes[order]
    return tokens, owner, np.cumsum(lengths) - lengths, lengths


def _spread(sizes: list[int]) -> list[int]:
    """An order in which to fill lanes: the longest texts first, so that no lane ends far behind the rest, then the others at random."""
    rng = np.random.default_rng(len(sizes))
    even = sum(sizes) / LEARN_LANES
    large = sorted((i for i, n in enumerate(sizes) if 4 * n > even), key=lambda i: -sizes[i])
    small = [i for i, n in enumerate(sizes) if 4 * n <= even]
    return large + [small[i] for i in rng.permutation(len(small))]


def windows(owner: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, valid, keep) of each window, each (steps, active lanes); keep: 0 where a text begins."""
    begins = np.concatenate([[True], owner[1:] != owner[:-1]])
    begins[starts] = True
    at = 0
    while at < int(lengths[0]):
        n = int(np.searchsorted(-lengths, -at, "left"))
        # Where only the longest texts are left, windows are longer, so that each holds enough tokens to be worth its step.
        now = steps * max(1, min(LONGER, FEW_LANES // n))
        offset = at + np.arange(now)[:, None]
        valid = offset < lengths[None, :n]
        places = np.where(valid, starts[None, :n] + offset, 0)
        yield places, valid, (~begins[places]).astype(np.float32)
        at += now


def _log_softmax(exponents: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at one place."""
    chosen = exponents[np.arange(len(at)), at]
    np.exp(exponents, out=exponents)
    return chosen - np.log(exponents.sum(axis=1))


def _slope(exponents: np.ndarray, at: np.ndarray, scale: np.float32) -> np.ndarray:
    """Gradient of the scaled loss by the exponents."""
    np.exp(exponents, out=exponents)
    exponents *= (scale / exponents.sum(axis=1))[:, None]
    exponents[np.arange(len(at)), at] -= scale
    return exponents


class Gru:
    def __init__(self, flat: np.ndarray) -> None:
        self.flat = np.array(flat, dtype=np.float32)
        self.p = unflatten(self.flat)

    def forward(self, tokens: np.ndarray, keep: np.ndarray, h: np.ndarray, store: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States before each token, (steps, lanes, units), and the state after the last."""
        steps, n = tokens.shape
        x, u, k = self.p["x"], self.p["u"], UNITS
        states = np.empty((steps, n, k), dtype=np.float32)
        if store is not None:
            store |= {"gates": np.empty((steps, n, 2 * k), np.float32), "new": np.empty((steps, n, k), np.float32), "mixed": np.empty((steps, n, k), np.float32)}
        for t in range(steps):
            h = h * keep[t][:, None]
            states[t] = h
            a, xs = h @ u, x[tokens[t]]
            gates = xs[:, : 2 * k] + a[:, : 2 * k]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = gates[:, k:] * a[:, 2 * k :]
            new += xs[:, 2 * k :]
            np.tanh(new, out=new)
            if store is not None:
                store["gates"][t], store["new"][t], store["mixed"][t] = gates, new, a[:, 2 * k :]
            h = new + gates[:, :k] * (h - new)
        return states, h

    def _classes(self, states: np.ndarray) -> np.ndarray:
        """Exponent of each class; far from overflow, as states lie within 1 and weights are small."""
        out = states @ self.p["wc"]
        out += self.p["bc"]
        return out

    def _by_class(self, tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Places of core words sorted by class, and (class, start, end) of the classes that occur."""
        core = np.nonzero(tokens < WORDS)[0]
        kind = tokens[core] // WIDE
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(CORE + 1)).tolist()
        return core[order], [(k, bounds[k], bounds[k + 1]) for k in range(CORE) if bounds[k] < bounds[k + 1]]

    def _within(self, k: int, states: np.ndarray) -> np.ndarray:
        """Exponent of each word of a class, less the largest bias."""
        out = states @ self.p["wk"][k]
        out += self.p["bk"][k] - self.p["bk"][k].max()
        return out

    def log_chance(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Natural log of each token's probability: of its class and, for core words, of the word in it."""
        kind = np.where(tokens < WORDS, tokens // WIDE, tokens - WORDS + CORE)
        out = np.empty(len(tokens), dtype=np.float32)
        for at in range(0, len(tokens), BLOCK):
            out[at : at + BLOCK] = _log_softmax(self._classes(states[at : at + BLOCK]), kind[at : at + BLOCK])
        order, classes = self._by_class(tokens)
        own, word = states[order], tokens[order] % WIDE
        more = np.empty(len(order), dtype=np.float32)
        for k, a, b in classes:
            more[a:b] = _log_softmax(self._within(k, own[a:b]), word[a:b])
        out[order] += more
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole text."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        tokens, owner, starts, lengths = lanes_of(texts, SCORE_LANES)
        h = np.zeros((len(lengths), UNITS), dtype=np.float32)
        for places, valid, keep in windows(owner, starts, lengths, SCORE_STEPS):
            now = tokens[places]
            states, h = self.forward(now, keep, h[: places.shape[1]])
            states, now, who = states.reshape(-1, UNITS), now.ravel(), owner[places.ravel()]
            if not valid.all():
                at = valid.ravel()
                states, now, who = states[at], now[at], who[at]
            out += np.bincount(who, weights=self.log_chance(states, now), minlength=len(texts))
        return out

    def learn(self, texts: list[np.ndarray]) -> int:
        """One pass of truncated backpropagation by Adagrad; the number of tokens seen.

        Gradients stop at a window's start, the state does not: it is carried to a text's end.
        """
        if not texts:
            return 0
        tokens, owner, starts, lengths = lanes_of(texts, LEARN_LANES, _spread([len(t) for t in texts]))
        if not hasattr(self, "seen"):
            self.seen = unflatten(np.full(SIZE, 1e-8, dtype=np.float32))
        h = np.zeros((len(lengths), UNITS), dtype=np.float32)
        for places, valid, keep in windows(owner, starts, lengths, LEARN_STEPS):
            h = self._step(tokens[places], valid, keep, h[: places.shape[1]])
        return len(tokens)

    def _move(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        seen = self.seen[name][at] + grad * grad
        self.seen[name][at] = seen
        self.p[name][at] -= RATE * grad / np.sqrt(seen)

    def _step(self, now: np.ndarray, valid: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
        steps, n = now.shape
        k, store = UNITS, {}
        states, after = self.forward(now, keep, h, store)
        at = np.nonzero(valid.ravel())[0]
        s, tok = states.reshape(-1, k)[at], now.ravel()[at]
        scale = np.float32(1 / (LEARN_LANES * LEARN_STEPS))
        kind = np.where(tok < WORDS, tok // WIDE, tok - WORDS + CORE)
        ds, wc, bc = np.empty_like(s), np.zeros(SHAPES["wc"], np.float32), np.zeros(CLASSES, np.float32)
        for lo in range(0, len(tok), BLOCK):
            dl = _slope(self._classes(s[lo : lo + BLOCK]), kind[lo : lo + BLOCK], scale)
            np.matmul(dl, self.p["wc"].T, out=ds[lo : lo + BLOCK])
            wc += s[lo : lo + BLOCK].T @ dl
            bc += dl.sum(axis=0)
        moves = []
        own, classes = self._by_class(tok)
        sc, word, back = s[own], tok[own] % WIDE, np.empty((len(own), k), dtype=np.float32)
        for c, lo, hi in classes:
            dk = _slope(self._within(c, sc[lo:hi]), word[lo:hi], scale)
            np.matmul(dk, self.p["wk"][c].T, out=back[lo:hi])
            moves.append((c, sc[lo:hi].T @ dk, dk.sum(axis=0)))
        ds[own] += back
        out = np.zeros((steps * n, k), dtype=np.float32)
        out[at] = ds
        out = out.reshape(steps, n, k)
        da = np.zeros((steps, n, 3 * k), dtype=np.float32)
        dm = np.zeros((steps, n, 3 * k), dtype=np.float32)
        total, ut = out[-1], self.p["u"].T
        for t in range(steps - 2, -1, -1):
            g = total * keep[t + 1][:, None]
            gates, new = store["gates"][t], store["new"][t]
            z, r = gates[:, :k], gates[:, k:]
            dn = g * (1 - z) * (1 - new * new)
            dz = g * (states[t] - new) * z * (1 - z)
            dr = dn * store["mixed"][t] * r * (1 - r)
            da[t, :, :k], da[t, :, k : 2 * k], da[t, :, 2 * k :] = dz, dr, dn
            dm[t, :, :k], dm[t, :, k : 2 * k], dm[t, :, 2 * k :] = dz, dr, dn * r
            total = out[t] + g * z + dm[t] @ ut
        du = states.reshape(-1, k).T @ dm.reshape(-1, 3 * k)
        order = np.argsort(tok, kind="stable")
        rows, first = np.unique(tok[order], return_index=True)
        dx = np.add.reduceat(da.reshape(-1, 3 * k)[at[order]], first, axis=0)
        self._move("wc", wc)
        self._move("bc", bc)
        for c, w, b in moves:
            self._move("wk", w, c)
            self._move("bk", b, c)
        self._move("u", du)
        self._move("x", dx, rows)
        return after
