"""Logistic regression over hashed features, trained in numpy on a bounded number of rows at a time."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np


def bucket(name: str, width: int) -> int:
    """The place of a feature among ``width``; the same on every machine."""
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % width


class Block:
    """Features that come together: each row has one of a few patterns, a pattern has the same places and values in every row.

    ``scale`` multiplies a row's values; rows that are not ``there`` have no features of the block (their scale is 0)."""

    def __init__(self, which: np.ndarray, patterns: Sequence[Sequence[tuple[int, float]]], scale: np.ndarray | None = None, there: np.ndarray | None = None):
        self.which, self.k, self.scale, self.there = which, len(patterns), scale, there
        self.owner = np.repeat(np.arange(self.k), [len(p) for p in patterns])
        self.place = np.array([at for p in patterns for at, _ in p], np.int64)
        self.value = np.array([v for p in patterns for _, v in p], np.float64)


class Rows:
    """Sparse rows as blocks."""

    def __init__(self, n: int, blocks: list[Block]):
        self.n, self.blocks = n, blocks

    def dot(self, w: np.ndarray) -> np.ndarray:
        z = np.zeros(self.n)
        for b in self.blocks:
            s = np.bincount(b.owner, w[b.place] * b.value, b.k)[b.which]
            z += s if b.scale is None else s * b.scale
        return z

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        """The sum of the rows' values at each place, a row's times its ``r``."""
        g = np.zeros(width)
        for b in self.blocks:
            s = np.bincount(b.which, r if b.scale is None else r * b.scale, b.k)
            g += np.bincount(b.place, s[b.owner] * b.value, width)
        return g

    def seen(self, width: int) -> np.ndarray:
        """How often each place occurs."""
        out = np.zeros(width, np.int64)
        for b in self.blocks:
            times = np.bincount(b.which if b.there is None else b.which[b.there], minlength=b.k)
            out += np.bincount(b.place, times[b.owner], width).astype(np.int64)
        return out

    def packed(self) -> np.ndarray:
        """Renumbers the places to those that there are, which it returns."""
        used, at = np.unique(np.concatenate([b.place for b in self.blocks]), return_inverse=True)
        for b, part in zip(self.blocks, np.split(at, np.cumsum([len(b.place) for b in self.blocks])[:-1]), strict=True):
            b.place = part
        return used

    def row(self, i: int) -> list[tuple[int, float]]:
        """Places and values of one row."""
        return [(int(p), float(v if b.scale is None else v * b.scale[i])) for b in self.blocks if b.there is None or b.there[i] for p, v in zip(b.place[b.owner == b.which[i]], b.value[b.owner == b.which[i]], strict=True)]


def fit(x: Rows, y: np.ndarray, width: int, steps: int = 300, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights by full-batch Adagrad; deterministic."""
    w, h = np.zeros(width), np.full(width, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))
        g = x.back(p - y, width) / x.n + l2 * w
        h += g * g
        w -= rate * g / np.sqrt(h)
    return w
