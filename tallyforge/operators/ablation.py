"""Feature combinations under agent budgets and coverage targets, from one shared fit.

Budget and combination are both choices of columns, so all of them are candidates of one search.
Scores on left-out rows are counted in bins; for every target the two thresholds of a candidate
are chosen on the inner left-out rows of each outer training part and applied to the outer fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from tallyforge.operators import fits

BINS = 100


@dataclass(frozen=True)
class Selective:
    """What a candidate decides under a target, over all outer folds."""

    candidate: int
    target: float
    table: np.ndarray  # truth (no, yes) x (no, undecided, yes)

    @property
    def decided(self) -> float:
        return float(self.table[:, [0, 2]].sum())

    @property
    def coverage(self) -> float:
        return self.decided / max(float(self.table.sum()), 1.0)

    @property
    def accuracy(self) -> float:
        return float(self.table[0, 0] + self.table[1, 2]) / max(self.decided, 1.0)

    def intervals(self, rounds: int, seed: int, level: float = 0.95) -> tuple[float, float, float, float]:
        """Bounds of accuracy and coverage over resamples of all rows: multinomial numbers of right, wrong and undecided ones."""
        n, right = int(self.table.sum()), self.accuracy * self.decided
        if not n:
            return (float("nan"),) * 4
        shares = np.array([right, self.decided - right, n - self.decided]).clip(0) / n
        drawn = np.random.default_rng(seed).multinomial(n, shares / shares.sum(), size=rounds)
        decided = drawn[:, :2].sum(axis=1)
        tails = [(1 - level) / 2, (1 + level) / 2]
        accuracy = drawn[decided > 0, 0] / decided[decided > 0]
        return (*(np.quantile(accuracy, tails) if len(accuracy) else (float("nan"),) * 2), *np.quantile(decided / n, tails))


def binned(f: fits.Fitted, wanted: Sequence[int], inner: bool, bins: int = BINS) -> np.ndarray:
    """(outer fold, candidate, truth (no, yes), bin of the score) counts on left-out rows of a two-class target."""
    wanted, targets = list(wanted), [np.array(f.candidates[k].target) for k in wanted]

    def count(y: np.ndarray, p: dict[int, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(wanted), 2, bins))
        for i, k in enumerate(wanted):
            t = targets[i][y]
            place = np.minimum((p[k][:, 1] * bins).astype(int), bins - 1)
            out[i] = np.bincount(t[t >= 0] * bins + place[t >= 0], minlength=2 * bins).reshape(2, bins)
        return out

    return fits.counted_left_out(f, wanted, inner, (len(wanted), 2, bins), count)


def cut_points(hist: np.ndarray, target: float) -> tuple[int, int]:
    """Bins (low, high): "no" below the first, "yes" from the second on, undecided between.

    The most accurate pair that decides at least ``target`` of the rows; ties go to more coverage,
    then to the smaller low and high.
    """
    below, total = np.concatenate([np.zeros((2, 1)), hist.cumsum(axis=1)], axis=1), hist.sum()
    above = hist.sum(axis=1, keepdims=True) - below
    right, decided = below[0][:, None] + above[1][None, :], below.sum(axis=0)[:, None] + above.sum(axis=0)[None, :]
    edges = np.arange(below.shape[1])
    allowed = (edges[:, None] <= edges[None, :]) & (decided >= target * total - 1e-9)
    accuracy = np.where(allowed, np.round(right / np.maximum(decided, 1), 9), -1.0)
    best = np.where(accuracy == accuracy.max(), decided, -1.0)
    low, high = np.unravel_index(int(best.argmax()), best.shape)
    return int(low), int(high)


def selective(f: fits.Fitted, wanted: Sequence[int], targets: Sequence[float], bins: int = BINS) -> list[Selective]:
    """Every candidate under every target: thresholds from inner left-out rows, decisions on the outer fold."""
    inside, outside = binned(f, wanted, True, bins), binned(f, wanted, False, bins)
    out = []
    for i, k in enumerate(wanted):
        for target in targets:
            table = np.zeros((2, 3))
            for fold in range(f.folds):
                low, high = cut_points(inside[fold, i], target)
                h = outside[fold, i]
                table += np.stack([h[:, :low].sum(axis=1), h[:, low:high].sum(axis=1), h[:, high:].sum(axis=1)], axis=1)
            out.append(Selective(k, target, table))
    return out
