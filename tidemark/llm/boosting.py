"""Gradient-boosted trees for two classes on binned features, small enough to travel with a task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidemark.llm.common import by_value

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth: a feature and a border for each inner node, a value for each leaf."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    border: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, border, leaf in zip(self.feature, self.border, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > border[at])
            out += leaf[at - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits are sought over quantile bins."""
    n, width = x.shape
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(borders)], axis=1)
    cell = binned + np.arange(width) * BINS
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    model = Trees(depth, float(np.log(share / (1 - share))))
    margin = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, border = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            where = ((at - first)[:, None] * (width * BINS) + cell).ravel()
            g, h = (
                np.bincount(where, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS).cumsum(axis=2)
                for v in (slope, bend)
            )
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            best = gain[:, :, :-1].reshape(many, -1).argmax(axis=1)
            for node in range(many):
                f, b = divmod(int(best[node]), BINS - 1)
                if gain[node, f, b] > 1e-6 and b < len(borders[f]):
                    feature[first + node], border[first + node] = f, borders[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > border[at])
        place = at - inner
        leaf = -rate * np.bincount(place, slope, inner + 1) / (np.bincount(place, bend, inner + 1) + ridge)
        margin += leaf[place]
        model.feature.append(feature)
        model.border.append(border)
        model.leaf.append(leaf)
    return model


by_value(__name__)
