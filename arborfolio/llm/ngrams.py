"""Hashed character n-grams of whole texts, computed with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def char_ngrams(points: np.ndarray, orders: range, bits: int, seed: int = 0) -> Iterator[np.ndarray]:
    """For each order, the bucket (int64, below 2**bits) of every n-gram, in text order."""
    h = np.full(len(points), np.uint64(seed * 2 + 1))
    shift = np.uint64(64 - bits)
    for n in range(1, orders.stop):
        if len(points) < n:
            return
        h = h[: len(points) - n + 1] * _STEP + points[n - 1 :]
        if n in orders:
            x = (h ^ (h >> np.uint64(31))) * _MIX
            yield (x >> shift).astype(np.int64)


class Rows:
    """A matrix of which each row has the value `scale` of some columns (each once) and 0 elsewhere."""

    def __init__(self, sets: list[np.ndarray], scale: np.ndarray) -> None:
        self.sizes, self.scale = np.array([len(s) for s in sets], np.int64), scale
        self.columns = np.concatenate(sets).astype(np.int32) if sets else np.zeros(0, np.int32)
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, (self.scale * w)[self.columns], len(self.sizes))

    def back(self, v: np.ndarray) -> np.ndarray:
        return self.scale * np.bincount(self.columns, v[self.owner], len(self.scale))


def fit_logistic(x: Rows, y: np.ndarray, l2: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by Newton steps with conjugate gradients; weights and intercept."""
    n, d = len(x.sizes), len(x.scale)
    w, b = np.zeros(d), 0.0
    rate = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    b = float(np.log(rate / (1 - rate)))

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * l2 * (w @ w))

    z = x.dot(w) + b
    for _ in range(steps if n else 0):
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        g = np.append(x.back(p - y) + l2 * w, (p - y).sum())
        s = p * (1 - p) + 1e-6

        def curve(v: np.ndarray, s: np.ndarray = s) -> np.ndarray:
            t = s * (x.dot(v[:-1]) + v[-1])
            return np.append(x.back(t) + l2 * v[:-1], t.sum())

        step, r = np.zeros(d + 1), -g
        q, rr = r.copy(), float(r @ r)
        stop = rr * 1e-4
        for _ in range(50):
            if rr <= stop or rr == 0:
                break
            a = curve(q)
            t = rr / float(q @ a)
            step += t * q
            r -= t * a
            rr, was = float(r @ r), rr
            q = r + rr / was * q
        size, now, along = 1.0, loss(z, w), x.dot(step[:-1]) + step[-1]
        while size > 1e-4 and loss(z + size * along, w + size * step[:-1]) > now:
            size /= 2
        w, b, z = w + size * step[:-1], b + size * step[-1], z + size * along
        if now - loss(z, w) < 1e-7 * (1 + now):
            break
    return w, b
