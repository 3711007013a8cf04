"""Small gradient boosted trees for a bounded labelled table, fitted on the driver and applied as a SQL expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Split | float
    high: Split | float


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: int) -> Split | float:
    leaf = float(-g.sum() / (h.sum() + ridge))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    base, best = g.sum() ** 2 / (h.sum() + ridge), (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            gain = cg[cut] ** 2 / (ch[cut] + ridge) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + ridge) - base
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] < best[2]
    return Split(best[1], best[2], _grow(x[low], g[low], h[low], depth - 1, ridge, least), _grow(x[~low], g[~low], h[~low], depth - 1, ridge, least))


def _walk(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] < tree.at, _walk(tree.low, x), _walk(tree.high, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 3, rate: float = 0.4, ridge: float = 1.0, least: int = 8) -> list[Split | float]:
    """Trees whose scaled sum is the log-odds of ``y``."""
    out: list[Split | float] = []
    margin = np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, (p - y) * rate, p * (1 - p) * rate, depth, ridge, least)
        out.append(tree)
        margin += rate * _walk(tree, x)
    return out


def margin(trees: Sequence[Split | float], x: np.ndarray, rate: float = 0.4) -> np.ndarray:
    return rate * sum((_walk(t, x) for t in trees), np.zeros(len(x)))


def expression(trees: Sequence[Split | float], feature: str, rate: float = 0.4) -> str:
    """The trees' margin as SQL; ``feature`` names the array of feature values."""

    def node(t: Split | float) -> str:
        if not isinstance(t, Split):
            return f"{t!r}D"
        return f"IF({feature}[{t.feature}] < {t.at!r}D, {node(t.low)}, {node(t.high)})"

    return f"{rate!r}D * (" + " + ".join(node(t) for t in trees) + ")"


def calibrate(score: np.ndarray, y: np.ndarray, wanted: float) -> float:
    """The smallest score from which the isotonic probability of ``y`` is at least ``wanted``; infinite if none is."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # [sum, weight, smallest score], pooled so that means rise
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
    return next((b[2] for b in blocks if b[0] / b[1] >= wanted), float("inf"))
