"""Many fits in one pass: every candidate, fold and start of a search is updated by the same scan.

Each task adds up what its rows contribute to every model (gradients and curvature of
regressions, sums of clusters), sums meet in a shuffle by model that adds them as they come, and
the driver makes the step.  A search of hundreds of models thus costs as many scans as its
longest fit has steps.  What travels is bounded by the number of models and features, never by
rows.  Models that see a row alike share its products, so that their sums are matrix products; rows of a large
table that are equal in the columns of some models are read as one with their number.
Fits of a large table start from those of its hashed ``SAMPLE``; the steps to the optimum of all
rows then take a few scans, each for gradients over every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.relational import stable

CLASSES = 3
#: Above this many tasks, sums of a model are first taken in ``LANES`` parts.
WIDE, LANES = 256, 32
#: Rows from which fits of a larger table start (about as many), and rows that are worked on at a time.
SAMPLE, CHUNK = 1 << 17, 4096


def _summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], n: int, combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> list[np.ndarray | None]:
    """Sums (or minima, ...) over all tasks of the arrays that ``task`` returns per model number."""
    form = "model int, lane int, sums binary"

    def batch(found: dict[int, np.ndarray], lane: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([lane] * len(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["model", "lane", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield batch(task(batches), TaskContext.get().partitionId() % LANES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for model, sums in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                x = np.frombuffer(sums.as_buffer())
                total[model] = combine(total[model], x) if model in total else x
        if total:
            yield batch(total, 0)

    parts = rows.mapInArrow(run, form)
    if rows.rdd.getNumPartitions() > WIDE:
        parts = parts.repartition("model", "lane").mapInArrow(add, form)
    out: list[np.ndarray | None] = [None] * n
    for r in parts.repartition("model").mapInArrow(add, form).collect():
        out[r["model"]] = np.frombuffer(r["sums"])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass(frozen=True)
class Candidate:
    """A linear model to be tried.

    ``c`` is the inverse penalty, ``weight`` None, "balanced" or a weight per target class.
    ``kind``: a regression with squared (l2) or absolute (l1) penalty, or svc: squared hinges, one
    class against the rest, with a sigmoid over each margin.  ``target``: the class that each label
    counts as, -1 where its rows take no part in the fit.  ``fourier``: so many random Fourier
    features of a Gaussian kernel of gamma 1 / features over the scaled columns (0: the columns).
    """

    name: str
    view: str
    features: tuple[str, ...]
    c: float = 1.0
    weight: str | tuple[float, ...] | None = None
    kind: str = "l2"
    target: tuple[int, ...] = (0, 1, 2)
    fourier: int = 0


@dataclass
class _Model:
    outer: int  # rows of this outer fold are left out, -1: none
    inner: int  # and those of this inner fold, -1: none
    columns: np.ndarray
    kind: str
    c: float
    target: np.ndarray
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    w: np.ndarray
    waves: tuple[np.ndarray, np.ndarray] | None = None
    sigmoid: np.ndarray | None = None  # slope and offset per class
    aims: np.ndarray | None = None  # smoothed targets of the sigmoid: own rows, others

    @property
    def design(self) -> tuple:
        """What the model sees of a row is the same for equal values within a split."""
        return (self.columns.tobytes(), self.fill.tobytes(), self.mean.tobytes(), self.scale.tobytes(), 0 if self.waves is None else self.waves[0].shape[1])


@dataclass
class Fitted:
    """The rows with their folds, and the models of every candidate and fold."""

    rows: DataFrame  # key, label, outer, inner, x
    names: list[str]
    candidates: list[Candidate]
    models: dict[tuple[int, int, int], _Model]  # by candidate, outer and inner fold that are left out
    folds: int
    fills: list[np.ndarray]  # medians of all columns, by the outer fold that is left out
    alike: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)  # rows that are equal in some columns, as ``trees`` stores them


def _design(x: np.ndarray, m: _Model) -> np.ndarray:
    """What the model sees (rows of the result) of table columns (rows of ``x``), ones last."""
    v = x[m.columns]
    z = (np.where(np.isnan(v), m.fill[:, None], v) - m.mean[:, None]) / m.scale[:, None]
    if m.waves is not None:
        z = np.cos(m.waves[0].T @ z + m.waves[1][:, None]) * np.sqrt(2 / m.waves[0].shape[1])
    return np.concatenate([z, np.ones((1, x.shape[1]))])


def _softmax(z: np.ndarray) -> np.ndarray:
    """Shares over the last axis but one."""
    z = np.exp(z - z.max(axis=-2, keepdims=True))
    return z / z.sum(axis=-2, keepdims=True)


def _probabilities(z: np.ndarray, m: _Model) -> np.ndarray:
    """Class probabilities (rows x classes) of the columns of a design."""
    z = m.w.T @ z
    if m.sigmoid is not None:
        p = 1 / (1 + np.exp(np.clip(z * m.sigmoid[0][:, None] + m.sigmoid[1][:, None], -500, 500)))
        return (p / np.maximum(p.sum(axis=0), 1e-300)).T
    return _softmax(z).T


def _train(split: tuple[int, int], outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Rows that a model learns from which leaves out an outer and an inner fold."""
    f, g = split
    use = np.ones(len(outer), dtype=bool) if f < 0 else outer != f
    return use if g < 0 else use & (inner[:, f] != g)


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)), _matrix(b.column(3))


Part = tuple[int, int, tuple[bool, ...]]  # outer fold, inner fold, labels that take part


def _medians(body: DataFrame, parts: Sequence[Part], known: np.ndarray, width: int, bins: int = 256, rounds: int = 3) -> np.ndarray:
    """Lower medians (parts x columns) of the known values of each part, by brackets that narrow ``bins`` times a scan.

    The first scan cuts the whole range of a column, so a row's bin is the same for all parts; the
    others read the rows of the brackets alone.  A bracket of one value is that median; else it is
    the least value inside the last bracket: exact unless several values lie within a part in 16
    million of the column's range.
    """

    def members(y: np.ndarray, o: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.stack([_train((f, g), o, n) & np.array(labels)[y] for f, g, labels in parts])

    def place(v: np.ndarray, low: float, step: float) -> np.ndarray:
        return np.clip((v - low) / step, 0, bins - 1).astype(int) if step > 0 else np.zeros(len(v), int)

    def ends(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found = np.full((2, width), np.inf)
        for *_, x in _chunks(batches):
            found = np.fmin(found, [np.fmin.reduce(x, axis=1), np.fmin.reduce(-x, axis=1)])
        return {0: found.ravel()}

    bounds = _summed(body, ends, 1, np.minimum)[0].reshape(2, width)
    low = np.where(np.isfinite(bounds[0]), bounds[0], 0.0)
    step = np.where(np.isfinite(bounds[1]), -bounds[1] - low, 0.0) / bins

    def counts(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found = np.zeros((len(parts), width, bins))
        for y, o, n, x in _chunks(batches):
            use = members(y, o, n)
            for j in range(width):
                have = np.flatnonzero(~np.isnan(x[j]))
                at = place(x[j][have], low[j], step[j])
                for i in range(len(parts)):
                    found[i, j] += np.bincount(at[use[i, have]], minlength=bins)
        return {0: found.ravel()}

    rank, below, value = (known + 1) // 2, np.zeros(known.shape), np.zeros(known.shape)
    upto = _summed(body, counts, 1)[0].reshape(len(parts), width, bins).cumsum(axis=2)
    path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # start and width of the bins of a scan, and the bin that holds the median

    def narrow(upto: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts below, starts and bin widths of the next brackets."""
        at = np.minimum((upto < rank[..., None]).sum(axis=2), bins - 1)
        path.append((low, step, at))
        return np.where(at > 0, np.take_along_axis(upto, np.maximum(at - 1, 0)[..., None], 2)[..., 0], below), low + at * step, step / bins

    below, low_in, step_in = narrow(upto, np.broadcast_to(low, known.shape), np.broadcast_to(step, known.shape))
    pairs = [(i, j) for i in range(len(parts)) for j in range(width) if known[i, j] > 0]
    for left in range(rounds, 0, -1):
        if not pairs:
            break

        def bracketed(batches: Iterator[pa.RecordBatch], pairs: list = pairs, low_in: np.ndarray = low_in, step_in: np.ndarray = step_in, fine: int = bins if left > 1 else 0) -> dict[int, np.ndarray]:
            """Least and largest value of each pair's bracket, and counts per finer bin."""
            ends, found = np.full((len(pairs), 2), np.inf), np.zeros((len(pairs), fine))
            of: dict[int, list[int]] = {}
            for k, (_, j) in enumerate(pairs):
                of.setdefault(j, []).append(k)
            for y, o, n, x in _chunks(batches):
                use = members(y, o, n)
                for j, own in of.items():
                    have = np.flatnonzero(~np.isnan(x[j]))
                    v = x[j][have]
                    at = place(v, low[j], step[j])
                    near = np.isin(at, [path[0][2][pairs[k][0], j] for k in own])
                    have, v, at = have[near], v[near], at[near]
                    for k in own:
                        i = pairs[k][0]
                        u = v[(at == path[0][2][i, j]) & use[i, have]]
                        for start, size, bin_ in path[1:]:
                            u = u[place(u, start[i, j], size[i, j]) == bin_[i, j]]
                        if len(u):
                            ends[k] = np.minimum(ends[k], [u.min(), -u.max()])
                            if fine:
                                found[k] += np.bincount(place(u, low_in[i, j], step_in[i, j]), minlength=bins)
            return {0: np.concatenate([ends.ravel(), found.ravel()])}

        size = 2 * len(pairs)
        got = _summed(body, bracketed, 1, lambda a, b: np.concatenate([np.minimum(a[:size], b[:size]), a[size:] + b[size:]]))[0]
        limits, inside = got[:size].reshape(-1, 2), got[size:].reshape(len(pairs), -1)
        for k, (i, j) in enumerate(pairs):
            if np.isfinite(limits[k, 0]):
                value[i, j] = limits[k, 0]
        if left > 1:
            upto = np.zeros((*known.shape, bins))
            for k, (i, j) in enumerate(pairs):
                upto[i, j] = below[i, j] + inside[k].cumsum()
            below, low_in, step_in = narrow(upto, low_in, step_in)
        pairs = [p for p, (least, most) in zip(pairs, limits, strict=True) if least != -most]
    return value


def _scaled(body: DataFrame, parts: Sequence[Part], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows per label, medians, means, deviations) of the rows of each part, gaps counted as medians."""

    def moments(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found = np.zeros((len(parts), CLASSES + 3 * width))
        for y, o, n, x in _chunks(batches):
            use = np.stack([_train((f, g), o, n) & np.array(labels)[y] for f, g, labels in parts]).astype(float)
            gap = np.isnan(x)
            v = np.where(gap, 0.0, x)
            found += use @ np.concatenate([y == np.arange(CLASSES)[:, None], ~gap, v, v * v]).astype(float).T
        return dict(enumerate(found))

    sums = np.stack(_summed(body, moments, len(parts)))
    per_label, (known, total, square) = sums[:, :CLASSES], (sums[:, CLASSES + k * width : CLASSES + (k + 1) * width] for k in range(3))
    n = per_label.sum(axis=1, keepdims=True)
    fill = _medians(body, parts, known, width) if (known < n).any() else np.zeros(known.shape)
    rows = np.maximum(n, 1)
    mean = (total + (n - known) * fill) / rows
    scale = np.sqrt(np.maximum((square + (n - known) * fill * fill) / rows - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    return list(zip(per_label, fill, mean, scale, strict=True))


def _step_l1(slope: np.ndarray, curve: np.ndarray, w: np.ndarray, penalty: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Step that minimises the quadratic model plus the absolute penalty, a coordinate at a time; zeros come out exact."""
    d, move = np.zeros(len(w)), np.zeros(len(w))
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            a = curve[j, j]
            v = w[j] - (slope[j] + move[j] - a * d[j]) / a
            new = np.sign(v) * max(abs(v) - penalty[j] / a, 0.0) - w[j]
            if new != d[j]:
                move += curve[:, j] * (new - d[j])
                most = max(most, abs(new - d[j]))
                d[j] = new
        if most < 1e-10:
            break
    return d


def seen(names: Sequence[str], features: Sequence[str]) -> Column:
    """The columns of ``x``, with 0 in place of those that are not among ``features``."""
    return F.array(*[F.element_at("x", i + 1) if name in features else F.lit(0.0) for i, name in enumerate(names)])


def _repeated(body: DataFrame, names: Sequence[str], views: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], DataFrame]:
    """For every list of columns the rows of ``body``; those that are equal in these are one with their number (a fifth column), where that at least halves them."""
    folds = ["label", "outer", "inner"]
    found = body.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.xxhash64(*folds, seen(names, v))).alias(f"v{i}") for i, v in enumerate(views)]).first()
    return {v: stable(body.select(*folds, seen(names, v).alias("x")).groupBy(*folds, "x").agg(F.count(F.lit(1)).alias("many"))) if 2 * found[f"v{i}"] <= found["n"] else body for i, v in enumerate(views)}


def _slopes(z: np.ndarray, t: np.ndarray, models: Sequence[_Model], curved: bool, many: np.ndarray | None = None) -> np.ndarray:
    """A row per model: gradient of the loss of some rows and, if ``curved``, its curvature.

    All models have the same design ``z`` and classes.  The curvature is a symmetric block for each
    class (support vectors) or pair of classes (regressions; the others follow), of which only the
    upper half is summed.  ``many``: how many rows each column of ``z`` stands for (None: one).
    """
    (d, n), k, size = z.shape, models[0].w.shape[1], len(models)
    own = (t == np.arange(k)[:, None]).astype(float)
    w = np.stack([m.weight for m in models])[:, None, t]
    if many is not None:
        w = w * many
    scores = (np.concatenate([m.w.T for m in models]) @ z).reshape(size, k, n)
    if models[0].kind == "svc":
        side = 2 * own - 1
        bend = 2 * np.array([m.c for m in models])[:, None, None] * w * (side * scores < 1)
        rest = bend * (scores - side)
    else:
        p = _softmax(scores)
        rest = w * (p - own)
        bend = np.stack([w[:, 0] * p[:, a] * p[:, c] for a in range(k) for c in range(a + 1, k)], axis=1) if curved else None
    slope = (rest.reshape(size * k, n) @ z.T).reshape(size, k * d)
    if not curved:
        return slope
    i, j = np.triu_indices(d)
    return np.concatenate([slope, (bend.reshape(size * bend.shape[1], n) @ (z[i] * z[j]).T).reshape(size, bend.shape[1] * len(i))], axis=1)


def _curvature(sums: np.ndarray, m: _Model) -> np.ndarray:
    """The full matrix of all classes from the upper halves of its blocks."""
    d, k = m.w.shape
    i, j = np.triu_indices(d)
    half = sums.reshape(-1, len(i))
    blocks = np.zeros((len(half), d, d))
    blocks[:, i, j] = blocks[:, j, i] = half
    out = np.zeros((k, d, k, d))
    if m.kind == "svc":
        out[range(k), :, range(k)] = blocks
    else:
        for block, (a, c) in zip(blocks, [(a, c) for a in range(k) for c in range(a + 1, k)], strict=True):
            out[a, :, c], out[c, :, a] = -block, -block
            out[a, :, a] += block
            out[c, :, c] += block
    return out.reshape(d * k, d * k)


def _move(m: _Model, slope: np.ndarray, curve: np.ndarray) -> float:
    """Makes the model's step from summed gradients and curvature; returns its size."""
    d, k = m.w.shape
    w = m.w.T.ravel()
    free = np.tile(np.arange(d) == d - 1, k)  # the intercepts
    if m.kind == "svc":
        ridge = np.where(free, 1e-6, 1.0)
        step = np.linalg.solve(curve + np.diag(ridge), slope + ridge * w)
    else:
        # of two mirrored classes each carries half of a binary regression's weights
        penalty = np.where(free, 0.0, (2.0 if k == 2 and m.kind == "l2" else 1.0) / m.c)
        ridge = np.where(free, 1e-6, penalty) if m.kind == "l2" else np.full(d * k, 1e-6)
        curve = curve + np.diag(ridge)
        step = -_step_l1(slope, curve, w, penalty) if m.kind == "l1" else np.linalg.solve(curve, slope + ridge * w)
    step = step.reshape(k, d).T
    if m.kind != "svc":
        step[-1] -= step[-1].mean()  # a shift of all intercepts changes nothing, so what sums say of it is rounding
    step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    m.w = m.w - step
    return float(np.abs(step).max())


def _by_split(models: Sequence[_Model]) -> dict[tuple[int, int], list[list[int]]]:
    """Model numbers by the rows that they leave out and, within these, by what they see and learn of a row."""
    found: dict[tuple[int, int], dict[tuple, list[int]]] = {}
    for i, m in enumerate(models):
        found.setdefault((m.outer, m.inner), {}).setdefault((m.design, m.kind, m.target.tobytes()), []).append(i)
    return {split: list(groups.values()) for split, groups in found.items()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, outer folds, inner folds, columns x rows) of some rows at a time."""
    return (part[:4] for part in _counted(batches))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """What ``_chunks`` gives, and how many rows each of them stands for (None: one)."""
    for b in batches:
        y, o, n, x = _arrays(b)
        many = b.column(4).to_numpy() if b.num_columns > 4 else None
        for at in range(0, len(y), CHUNK):
            part = slice(at, at + CHUNK)
            yield y[part], o[part], n[part], np.ascontiguousarray(x[part].T), None if many is None else many[part]


def _over_training_rows(models: Sequence[_Model], own: dict[tuple[int, int], list[list[int]]], batches: Iterator[pa.RecordBatch], sums: Callable[[np.ndarray, np.ndarray, list[int], np.ndarray | None], np.ndarray], wanted: set[int]) -> dict[int, np.ndarray]:
    """What ``sums`` (design, classes, models that share them, numbers of rows) adds up to for each wanted model over the rows that it learns from."""
    found: dict[int, np.ndarray] = {}
    for y, o, n, x, many in _counted(batches):
        for split, groups in own.items():
            live = [g for g in ([i for i in group if i in wanted] for group in groups) if g]
            if not live:
                continue
            use = np.flatnonzero(_train(split, o, n))
            mine, labels = x[:, use], y[use]
            times = None if many is None else many[use]
            designs: dict[tuple, np.ndarray] = {}
            for group in live:
                m = models[group[0]]
                z = designs.get(m.design)
                if z is None:
                    z = designs[m.design] = _design(mine, m)
                t, mult = m.target[labels], times
                if t.min(initial=0) < 0:
                    z, t, mult = z[:, t >= 0], t[t >= 0], None if times is None else times[t >= 0]
                for i, s in zip(group, sums(z, t, group, mult), strict=True):
                    found[i] = found[i] + s if i in found else s
    return found


def _newton(body: DataFrame, models: list[_Model], own: dict, rounds: int, times: float = 1.0, curves: dict[int, np.ndarray] | None = None) -> tuple[set[int], dict[int, np.ndarray]]:
    """Moves all models to the optimum over the rows, each of which stands for ``times`` rows; returns those that are not there, and last curvatures.

    A model with a curvature in ``curves`` (of a sample) keeps it and needs gradients alone, as long
    as each step is at most a third of the one before; one that does slower gets its own curvature
    with every later scan.
    """
    curves, last = dict(curves or {}), {}
    moving, kept = set(range(len(models))), set(curves)
    for _ in range(rounds if models else 0):

        def sums(z: np.ndarray, t: np.ndarray, group: list[int], many: np.ndarray | None, kept: frozenset[int] = frozenset(kept)) -> list[np.ndarray]:
            parts = [(curved, [i for i in group if (i not in kept) == curved]) for curved in (False, True)]
            out = {i: s for curved, some in parts if some for i, s in zip(some, _slopes(z, t, [models[i] for i in some], curved, many), strict=True)}
            return [out[i] for i in group]

        found = _summed(body, lambda batches: _over_training_rows(models, own, batches, sums, moving), len(models))
        still = set()
        for i in sorted(moving):
            if found[i] is None:
                continue
            m, size = models[i], models[i].w.size
            if i not in kept:
                curves[i] = times * _curvature(found[i][size:], m)
            step = _move(m, times * found[i][:size], curves[i])
            if step >= 1e-6:
                still.add(i)
                if step > last.get(i, np.inf) / 3:
                    kept.discard(i)
            last[i] = step
        moving = still
        if not moving:
            break
    return moving, curves


def _fit_sigmoids(body: DataFrame, models: list[_Model], own: dict, rows: dict[int, np.ndarray], rounds: int = 12) -> None:
    """A sigmoid of each class's margin by Newton steps on the rows that the model learned from, with smoothed targets."""
    wanted = {i for i, m in enumerate(models) if m.kind == "svc"}
    for i in wanted:
        if models[i].sigmoid is None:
            models[i].sigmoid = np.stack([np.full(models[i].w.shape[1], -1.0), np.zeros(models[i].w.shape[1])])
        n = rows[i]
        models[i].aims = np.stack([(n + 1) / (n + 2), 1 / (n.sum() - n + 2)])

    def sums(z: np.ndarray, t: np.ndarray, group: list[int], many: np.ndarray | None) -> list[np.ndarray]:
        return [one(z, t, models[i], 1.0 if many is None else many) for i in group]

    def one(z: np.ndarray, t: np.ndarray, m: _Model, many: np.ndarray | float) -> np.ndarray:
        margin, own_rows = m.w.T @ z, t == np.arange(m.w.shape[1])[:, None]
        aim = np.where(own_rows, m.aims[0][:, None], m.aims[1][:, None])
        p = 1 / (1 + np.exp(np.clip(margin * m.sigmoid[0][:, None] + m.sigmoid[1][:, None], -500, 500)))
        q, rest = many * p * (1 - p), many * (aim - p)
        return np.stack([(margin * rest).sum(axis=1), rest.sum(axis=1), (margin * margin * q).sum(axis=1), (margin * q).sum(axis=1), q.sum(axis=1)]).ravel()

    for _ in range(rounds if wanted else 0):
        moved = 0.0
        for i, s in enumerate(_summed(body, lambda batches: _over_training_rows(models, own, batches, sums, wanted), len(models))):
            if s is None:
                continue
            ga, gb, aa, ab, bb = s.reshape(5, -1)
            aa, bb = aa + 1e-9, bb + 1e-9
            det = np.maximum(aa * bb - ab * ab, 1e-18)
            step = np.clip(np.stack([(bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det]), -5, 5)
            models[i].sigmoid = models[i].sigmoid - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-6:
            break


def _optimise(body: DataFrame, few: DataFrame | None, times: int, models: list[_Model], sizes: dict[int, np.ndarray], rounds: int) -> None:
    """Moves models to the optimum over the rows, from that of a sample (``few``) if there is one, and fits their sigmoids."""
    own, curves = _by_split(models), None
    if few is not None:
        lost, curves = _newton(few, models, own, rounds, times)
        for i in lost:  # starts from nothing, with curvatures of its own
            models[i].w = np.zeros_like(models[i].w)
            curves.pop(i, None)
    _newton(body, models, own, rounds, 1.0, curves)
    if few is not None:
        _fit_sigmoids(few, models, own, sizes)
    _fit_sigmoids(body, models, own, sizes)


def fit_candidates(df: DataFrame, key: str, label: str, outer: str, inner: Sequence[str], candidates: Sequence[Candidate], inner_folds: int, rounds: int = 12, also: Sequence[str] = ()) -> Fitted:
    """Fits every candidate without each outer fold and, inside it, without each inner fold.

    ``inner``: one fold column per outer fold (none: only outer folds are left out).  Gaps are
    filled with the median, features scaled by mean and deviation, and Fourier features taken of
    these, all from the rows that the model itself learns from; nothing of a left-out fold, outer
    or inner, reaches a model.  ``also``: columns that other models of the search use.
    """
    names = list(dict.fromkeys([*(x for c in candidates for x in c.features), *also]))
    rows = df.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(outer).cast("int").alias("outer"), F.array(*[F.col(i).cast("int") for i in inner], *([] if inner else [F.lit(0)])).alias("inner"), F.array(*[F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))) for x in names]).alias("x"))
    rows = stable(rows)
    folds = len(inner) or rows.agg(F.max("outer").alias("n")).first()["n"] + 1
    body = rows.select("label", "outer", "inner", "x")
    splits = [(f, g) for f in range(folds) for g in ([-1, *range(inner_folds)] if inner else [-1])]
    part_of = {c: tuple(t >= 0 for t in c.target) for c in candidates}
    every = (True,) * CLASSES
    parts: list[Part] = [(f, g, labels) for f, g in splits for labels in dict.fromkeys([*([every] if g < 0 else []), *part_of.values()])]
    scaled = dict(zip(parts, _scaled(body, parts, len(names)), strict=True))
    models: dict[tuple[int, int, int], _Model] = {}
    sizes: dict[int, np.ndarray] = {}
    for f, g in splits:
        for k, c in enumerate(candidates):
            per_label, fill, mean, scale = scaled[f, g, part_of[c]]
            at, target = np.array([names.index(x) for x in c.features]), np.array(c.target)
            n_k = np.bincount(target[target >= 0], per_label[target >= 0], max(c.target) + 1)
            n = n_k.sum()
            weight = np.ones(len(n_k)) if c.weight is None else n / (max((n_k > 0).sum(), 1) * np.maximum(n_k, 1)) if c.weight == "balanced" else np.array(c.weight)
            waves = None
            if c.fourier:
                rng = np.random.default_rng(c.fourier)
                waves = rng.normal(0, np.sqrt(2 / len(at)), (len(at), c.fourier)), rng.uniform(0, 2 * np.pi, c.fourier)
            sizes[len(models)] = n_k
            models[k, f, g] = _Model(f, g, at, c.kind, c.c, target, fill[at], mean[at], scale[at], weight, np.zeros(((c.fourier or len(at)) + 1, len(n_k))), waves)
    times = int(max((n.sum() for n in sizes.values()), default=0)) // SAMPLE
    few = stable(rows.where(F.pmod(F.xxhash64("key"), F.lit(times)) == 0).select("label", "outer", "inner", "x").coalesce(df.sparkSession.sparkContext.defaultParallelism)) if times > 1 else None
    views = list(dict.fromkeys(tuple(sorted(set(c.features))) for c in candidates))
    # rows with inner folds are hardly alike in all of these
    bodies = dict.fromkeys(views, body) if inner or few is None else _repeated(body, names, views)
    together: dict[int, tuple[DataFrame, list[int]]] = {}
    for i, (k, _, _) in enumerate(models):
        seen_by = bodies[tuple(sorted(set(candidates[k].features)))]
        together.setdefault(id(seen_by), (seen_by, []))[1].append(i)
    every_model = list(models.values())
    for table, members in together.values():
        _optimise(table, few, times, [every_model[i] for i in members], {j: sizes[i] for j, i in enumerate(members)}, rounds)
    return Fitted(rows, names, list(candidates), models, folds, [scaled[f, -1, every][1] for f in range(folds)])


# the rules of decide_many, with their two parameters
Rule = tuple[str, float, float]


def decide_many(p: np.ndarray, rule: Rule) -> np.ndarray:
    """Classes of rows of probabilities under one rule, as the column builders of the same names."""
    kind, a, b = rule
    nh, nmr, h = p.T
    side = np.where(h >= nh, 2, 0)
    if kind == "nmr_gate":
        return np.where(nmr >= a, 1, side)
    if kind == "margin_to_nmr":
        return np.where((np.abs(h - nh) < a) & (nmr >= b), 1, side)
    if kind == "resolved_gap":
        return np.where(np.maximum(h, nh) - nmr < a, 1, side)
    return p.argmax(axis=1)


def counted_left_out(f: Fitted, wanted: Sequence[int], inner: bool, shape: tuple[int, ...], count: Callable[[np.ndarray, dict[int, np.ndarray]], np.ndarray]) -> np.ndarray:
    """(outer fold, *shape) sums of ``count(labels, probabilities by candidate)`` over the rows that fits left out.

    ``inner``: each outer fold's training rows under the models of their inner folds; else each
    row under the models of its outer fold.
    """
    folds, models = f.folds, f.models  # the tables stay behind

    def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found = {i: np.zeros(shape) for i in range(folds)}
        for b in batches:
            y, o, g, x = _arrays(b)
            for i in range(folds):
                for j in np.unique(g[:, i]) if inner else [-1]:
                    use = (o != i) & (g[:, i] == j) if inner else o == i
                    if use.any():
                        found[i] += count(y[use], _scores(models, wanted, i, int(j), x[use]))
        return {i: c.ravel() for i, c in found.items()}

    return np.stack([s.reshape(shape) for s in _summed(f.rows.select("label", "outer", "inner", "x"), task, folds)])


def _scores(models: dict[tuple[int, int, int], _Model], wanted: Sequence[int], i: int, j: int, x: np.ndarray) -> dict[int, np.ndarray]:
    """Probabilities of rows under some candidates of one split; what several see alike is made once."""
    seen: dict[tuple, np.ndarray] = {}
    out = {}
    x = np.ascontiguousarray(x.T)
    for k in wanted:
        m = models[k, i, j]
        if m.design not in seen:
            seen[m.design] = _design(x, m)
        out[k] = _probabilities(seen[m.design], m)
    return out


def confusions(f: Fitted, rules: Sequence[Rule], inner: bool, wanted: Sequence[int] | None = None) -> np.ndarray:
    """(outer fold, candidate, rule, truth, prediction) counts on rows that the fits left out.

    Rules that compare one value with thresholds are counted by how many of these it passes, so a
    row costs the same for any number of thresholds.
    """
    wanted = list(range(len(f.candidates))) if wanted is None else list(wanted)
    families: dict[tuple[str, float], list[int]] = {}
    for r, (kind, a, b) in enumerate(rules):
        families.setdefault((kind, a if kind == "margin_to_nmr" else 0.0), []).append(r)
    limits = {key: np.array(sorted(rules[r][2 if key[0] == "margin_to_nmr" else 1] for r in own)) for key, own in families.items()}

    def count(y: np.ndarray, p: dict[int, np.ndarray]) -> np.ndarray:
        found = np.zeros((len(wanted), len(rules), CLASSES, CLASSES))
        for at, k in enumerate(wanted):
            nh, nmr, h = p[k].T
            side = np.where(h >= nh, 2, 0)
            for (kind, a), own in families.items():
                if kind == "argmax":
                    found[at, own] += np.bincount(y * CLASSES + p[k].argmax(axis=1), minlength=CLASSES**2).reshape(CLASSES, CLASSES)
                    continue
                limit = limits[kind, a]
                if kind == "resolved_gap":  # undecided below the threshold
                    passed = len(limit) - np.searchsorted(limit, np.maximum(h, nh) - nmr, "right")
                    order = np.arange(len(limit))[::-1]
                else:  # undecided from the threshold on
                    passed = np.searchsorted(limit, nmr, "right")
                    order = np.arange(len(limit))
                    if kind == "margin_to_nmr":
                        passed = np.where(np.abs(h - nh) < a, passed, 0)
                cells = np.bincount((y * CLASSES + side) * (len(limit) + 1) + passed, minlength=CLASSES**2 * (len(limit) + 1)).reshape(CLASSES, CLASSES, -1)
                undecided = cells[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]  # passed at least 1, 2, ... thresholds
                for r in own:
                    place = order[np.searchsorted(limit, rules[r][2 if kind == "margin_to_nmr" else 1])]
                    table = cells.sum(axis=2) - undecided[:, :, place]
                    table[:, 1] += undecided[:, :, place].sum(axis=1)
                    found[at, r] += table
        return found

    return counted_left_out(f, wanted, inner, (len(wanted), len(rules), CLASSES, CLASSES), count)


def quality(c: np.ndarray) -> tuple[float, float, float]:
    """(balanced accuracy, accuracy, minus cross errors) of a confusion table."""
    n = c.sum(axis=1)
    recall = np.diag(c)[n > 0] / n[n > 0]
    return (round(float(recall.mean()), 9) if len(recall) else 0.0, round(float(np.trace(c) / max(c.sum(), 1)), 9), -float(c[0, 2] + c[2, 0]))


def predict(f: Fitted, chosen: Sequence[Sequence[tuple[int, float]]], rules: Sequence[Rule]) -> DataFrame:
    """(key, outer, p_nh, p_nmr, p_h, pred): each row under the weighted candidates and the rule chosen for its outer fold."""
    kind, models = f.rows.schema["key"].dataType.simpleString(), f.models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, x = b.column(1).to_numpy(), _matrix(b.column(2))
            p, pred = np.zeros((len(o), CLASSES)), np.zeros(len(o), np.int32)
            for i in np.unique(o):
                use, total = o == i, sum(w for _, w in chosen[i])
                scores = _scores(models, [k for k, _ in chosen[i]], int(i), -1, x[use])
                p[use] = sum(w / total * scores[k] for k, w in chosen[i])
                pred[use] = decide_many(p[use], rules[i])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(p[:, k].copy()) for k in range(CLASSES)), pa.array(pred)], ["key", "outer", "p_nh", "p_nmr", "p_h", "pred"])

    return f.rows.select("key", "outer", "x").mapInArrow(run, f"key {kind}, outer int, p_nh double, p_nmr double, p_h double, pred int")


def left_out(f: Fitted, chosen: Sequence[Sequence[int]], inner: bool) -> DataFrame:
    """(key, label, fold, p array<array<double>>): probabilities of several candidates, which may differ by outer fold, on rows that they left out.

    ``inner``: a row comes once for each outer fold that it is not in, under the models without
    its inner fold there; else once, under the models without its outer fold.
    """
    kind, models, folds = f.rows.schema["key"].dataType.simpleString(), f.models, f.folds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, g, x = b.column(2).to_numpy(), _matrix(b.column(3)), _matrix(b.column(4))
            for i in range(folds):
                for j in np.unique(g[:, i]) if inner else [-1]:
                    at = np.flatnonzero((o != i) & (g[:, i] == j) if inner else o == i)
                    if len(at):
                        scores = _scores(models, chosen[i], i, int(j), x[at])
                        each = [[scores[k][r].tolist() for k in chosen[i]] for r in range(len(at))]
                        rows = pa.array(at)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.full(len(at), i, np.int32)), pa.array(each, pa.list_(pa.list_(pa.float64())))], ["key", "label", "fold", "p"])

    return f.rows.select("key", "label", "outer", "inner", "x").mapInArrow(run, f"key {kind}, label int, fold int, p array<array<double>>")


def nested(f: Fitted, rules: Sequence[Rule]) -> list[tuple[int, int]]:
    """(candidate, rule) of every outer fold, chosen on inner left-out rows of its training part; ties go to the earlier one."""
    c = confusions(f, rules, inner=True)
    return [max(((k, r) for k in range(c.shape[1]) for r in range(c.shape[2])), key=lambda x, i=i: (*quality(c[i][x]), -x[0], -x[1])) for i in range(len(c))]


def pool(f: Fitted, top: int) -> list[list[tuple[int, float, int]]]:
    """For every outer fold the ``top`` candidates of each view by inner quality: (candidate, weight, rank in its view)."""
    c = confusions(f, [("argmax", 0.0, 0.0)], inner=True)
    out = []
    for i in range(len(c)):
        views: dict[str, list[tuple[tuple, int]]] = {}
        for k, cand in enumerate(f.candidates):
            views.setdefault(cand.view, []).append((quality(c[i][k, 0]), k))
        out.append([(k, max(0.01, q[0]), rank) for items in views.values() for rank, (q, k) in enumerate(sorted(items, key=lambda x: (x[0], -x[1]), reverse=True)[:top], start=1)])
    return out


STARTS_FROM = 4096


def kmeans_many(df: DataFrame, names: Sequence[str], ks: Sequence[int], starts: int = 20, rounds: int = 30, seed: int = 1) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """((k, inertia, silhouette, calinski_harabasz, davies_bouldin), best centers per k) of scaled columns.

    All starts of all k move in the same scans.  Starts are chosen by k-means++ on at most
    ``STARTS_FROM`` rows.  The silhouette is on squared distances, from cluster sums, over all rows.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [(F.col(x).cast("double") - (stats[f"m{i}"] or 0.0)) / (stats[f"s{i}"] or 1.0) for i, x in enumerate(names)]
    rows = stable(df.select(F.array(*z).alias("x")))
    n, p = stats["n"], len(names)
    share = min(1.0, STARTS_FROM / max(n, 1))
    sample = np.array(sorted(r["x"] for r in rows.where(F.rand(seed) <= share).limit(2 * STARTS_FROM).collect())).reshape(-1, p)
    usable = [k for k in ks if k <= len(np.unique(sample, axis=0))]
    rng = np.random.default_rng(seed)
    models = [(k, _plus_plus(sample, k, rng)) for k in usable for _ in range(starts)]
    moving = set(range(len(models)))

    def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            x = _matrix(b.column(0))
            xx = (x * x).sum(axis=1)
            for i in moving:
                c = models[i][1]
                d = xx[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
                own, near = d.argmin(axis=1), np.maximum(d.min(axis=1), 0)
                k = len(c)
                s = np.zeros((k, p))
                np.add.at(s, own, x)
                far = np.bincount(own, np.sqrt(near), k)
                found[i] = found.get(i, 0) + np.concatenate([np.bincount(own, minlength=k), np.bincount(own, xx, k), np.bincount(own, near, k), far, s.ravel()])
        return found

    last: dict[int, np.ndarray] = {}
    for step in range(rounds + 1):
        sums = _summed(rows, task, len(models))
        for i in sorted(moving):
            last[i] = sums[i]
            k, c = models[i]
            count, s = sums[i][:k], sums[i][4 * k :].reshape(k, p)
            new = np.where(count[:, None] > 0, s / np.maximum(count, 1)[:, None], c)
            if step == rounds or np.abs(new - c).max() < 1e-6:
                moving.discard(i)
            else:
                models[i] = (k, new)
        if not moving:
            break
    best = {k: min((i for i, m in enumerate(models) if m[0] == k), key=lambda i: (last[i][2 * m_k(models, i) : 3 * m_k(models, i)].sum(), i)) for k in usable}

    def silhouettes(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found = {i: np.zeros(1) for i in best.values()}
        for b in batches:
            x = _matrix(b.column(0))
            xx = (x * x).sum(axis=1)
            for i in best.values():
                k, c = models[i]
                count, q, s = last[i][:k], last[i][k : 2 * k], last[i][4 * k :].reshape(k, p)
                own = (xx[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
                m = np.maximum(count, 1)
                d = xx[:, None] - 2 * x @ (s / m[:, None]).T + (q / m)[None, :]
                d[:, count == 0] = np.inf
                at = np.arange(len(x))
                inside = d[at, own] * m[own] / np.maximum(count[own] - 1, 1)
                d[at, own] = np.inf
                outside = d.min(axis=1)
                value = np.where(count[own] > 1, (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300), 0.0)
                found[i] += np.nan_to_num(value).sum()
        return found

    scores = _summed(rows, silhouettes, len(models)) if best else []
    out = []
    for k, i in best.items():
        count, within, far, s = last[i][:k], last[i][2 * k : 3 * k], last[i][3 * k : 4 * k], last[i][4 * k :].reshape(k, p)
        have = count > 0
        center, spread = s[have] / count[have][:, None], far[have] / count[have]
        mean = s.sum(axis=0) / n
        between = (count[have] * ((center - mean) ** 2).sum(axis=1)).sum()
        apart = np.sqrt(((center[:, None] - center[None, :]) ** 2).sum(axis=2))
        np.fill_diagonal(apart, np.inf)
        worst = ((spread[:, None] + spread[None, :]) / np.maximum(apart, 1e-300)).max(axis=1).mean()
        inertia = float(within.sum())
        out.append((k, inertia, float(scores[i][0] / n), float(between / max(k - 1, 1) / max(inertia / max(n - k, 1), 1e-300)), float(worst)))
    return df.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"), {k: models[i][1] for k, i in best.items()}


def m_k(models: Sequence[tuple[int, np.ndarray]], i: int) -> int:
    return models[i][0]


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [x[rng.integers(len(x))]]
    d = ((x - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        chosen.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def assign_clusters(df: DataFrame, names: Sequence[str], centers: np.ndarray, column: str = "cluster") -> DataFrame:
    """Adds the nearest of centers in the scaled space of ``kmeans_many`` (computed on this table)."""
    stats = df.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [(F.col(x).cast("double") - (stats[f"m{i}"] or 0.0)) / (stats[f"s{i}"] or 1.0) for i, x in enumerate(names)]
    distance = [sum(((z[i] - float(c[i])) ** 2 for i in range(1, len(z))), (z[0] - float(c[0])) ** 2) for c in centers]
    return df.withColumn(column, F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(distance)]))["k"])
