"""Whitening of embeddings: principal components by a randomised range finder.

Entries become whole numbers floor(256 c), so number, sums and deviations of the distinct vectors
(the fit list) are exact.  A random basis of ``components + OVERSAMPLE`` directions goes through
power passes: each is one scan of the fit list, in which every task centres its vectors and adds
up X'(X Q), and the sums are taken row by row of the matrix in a shuffle, so what reaches the
driver is one dimension x directions matrix.  Rayleigh-Ritz on the basis gives components and
eigenvalues.  Where the residuals do not reach rounding within ``POWER_PASSES``, or the basis
is as large as the space, one more scan takes all directions, which needs no further pass.

Rows whose vector is null or holds null, NaN or infinite entries are dropped, and so are vectors
without entries.  Vectors of each length are a fit of their own.  Repeated vectors count once in
the fit and each gets its rows.  Components beyond the vector's length do not exist; where a
component has no variance (all vectors equal, or fewer than the components span) whitened is
null.  identity_error is over the components that have variance, null without one.  Entries
beyond the range of a long are its limits; a deviation beyond 38 digits is null.  Null ids are
kept.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import save, temporary

SCALE = 256
OVERSAMPLE = 8
POWER_PASSES = 6
#: Residual of a component, as a part of the largest eigenvalue, that counts as rounding.
RESIDUAL = 2e-14
#: Eigenvalues up to this part of the total variance are none.
NO_VARIANCE = 1e-13
ROWS = 2048


@dataclass
class Whitener:
    """One fit: exact number and sums, components (dimension x components), their eigenvalues and what was measured."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None
    directions: int

    @property
    def kept(self) -> np.ndarray:
        return self.eigenvalues > NO_VARIANCE * self.trace

    @property
    def scaled(self) -> np.ndarray:
        """Components over the root of their eigenvalues; NaN where there is no variance."""
        return self.components / np.sqrt(np.where(self.kept, self.eigenvalues, np.nan))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x array<bigint>) of the rows whose vector is complete and finite."""
    finite = F.forall("__v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("__v")).filter((F.size("__v") > 0) & finite)
    return kept.select(id_col, F.transform("__v", lambda c: F.floor(F.lit(float(scale)) * c)).alias("x"))


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as a matrix), at most ``ROWS`` vectors of one length at a time."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            yield some, values[starts[some][:, None] + np.arange(dim)]


def summed(fit: DataFrame, shape: tuple[int, int], per_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of a rows x columns matrix of doubles that ``per_block`` gives for some of them."""
    rows, columns = shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for _, x in blocks(b.column(0)):
                total += per_block(x)
        yield from out(np.arange(rows, dtype=np.int32), total)

    def out(i: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 256):
            flat = pa.array(y[at : at + 256].ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, columns, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(i[at : at + 256]), pa.ListArray.from_arrays(offsets, flat)], ["i", "y"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for b in batches:
            y = b.column(1).flatten().to_numpy().reshape(-1, columns)
            for i, row in zip(b.column(0).to_pylist(), y, strict=True):
                mine[i] = mine[i] + row if i in mine else row.copy()
        if mine:
            yield from out(np.array(list(mine), np.int32), np.stack(list(mine.values())))

    parts = fit.mapInArrow(partial, "i int, y array<double>")
    total = np.zeros(shape)
    for r in parts.repartition(min(rows, 64), "i").mapInArrow(add, "i int, y array<double>").collect():
        total[r["i"]] = r["y"]
    return total


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and sums per dimension of the vectors of each length; halves of 32 bits are summed apart, so none overflows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in blocks(b.column(0)):
                halves = np.stack([np.full(x.shape[1], len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + halves
        for dim, (n, high, low) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (np.full(dim, dim), np.arange(dim), n, high, low)], ["dim", "i", "n", "high", "low"])

    parts = fit.mapInArrow(partial, "dim bigint, i bigint, n bigint, high bigint, low bigint")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("dim", "i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("dim", "i").collect():
        found.setdefault(r["dim"], (r["n"], []))[1].append((r["high"] << 32) + r["low"])
    return found


def components_of(power: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` leading eigenpairs of a covariance V that is known by V @ Q only, and how many directions it took."""
    width = min(dim, k + OVERSAMPLE)
    if width < dim:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
        before = np.inf
        for left in reversed(range(POWER_PASSES)):
            y = power(q)
            values, inner = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
            values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
            rest, most = np.linalg.norm(y @ inner - (q @ inner) * values, axis=0).max(), RESIDUAL * abs(values[0])
            if rest <= most:
                return q @ inner, values, width
            if before < np.inf and rest * (rest / before) ** left > most:  # the passes that are left will not do
                break
            before = rest
            q = np.linalg.qr(y)[0]
    y = power(np.eye(dim))
    values, vectors = np.linalg.eigh((y + y.T) / 2)
    return vectors[:, ::-1][:, :k], values[::-1][:k], dim


def fit_one(fit: DataFrame, n: int, sums: list[int], components: int) -> Whitener:
    """The whitener of distinct vectors (x array<bigint>) of one length."""
    dim, mean = len(sums), np.array([s / n for s in sums])

    def power(q: np.ndarray) -> np.ndarray:
        return summed(fit, q.shape, lambda x: (c := x - mean).T @ (c @ q)) / n

    vectors, values, directions = components_of(power, dim, min(components, dim))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    found = Whitener(n, sums, vectors, values, 0.0, None, directions)
    found.trace = float(summed(fit, (1, 1), lambda x: np.square(x - mean).sum(keepdims=True))[0, 0]) / n
    if found.kept.any():
        w = found.scaled[:, found.kept]
        m = w.shape[1]
        got = summed(fit, (m, m + 1), lambda x: (y := (x - mean) @ w).T @ np.column_stack([y, np.ones(len(y))])) / n
        covariance = got[:, :m] - np.outer(got[:, m], got[:, m])
        found.identity_error = float(np.abs(covariance - np.eye(m)).max())
    return found


def fit_whiteners(df: DataFrame, components: int = 4, vector_col: str = "embedding", scale: int = SCALE) -> dict[int, Whitener]:
    """A whitener for each length of vectors, fitted on the distinct ones."""
    with temporary(df.sparkSession):
        fit = save(whole_vectors(df.select(F.col(vector_col), F.lit(0).alias("__id")), "__id", vector_col, scale).select("x").distinct(), "fit")
        return {dim: fit_one(fit.filter(F.size("x") == dim), n, sums, components) for dim, (n, sums) in exact_sums(fit).items()}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums over dimensions of (n x - S) ** 2, as decimals; in longs where nothing can overflow."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if x.shape[1] * most**2 < 1 << 63:
        return pa.array(np.square(n * x - np.array(sums, np.int64)).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = np.square(n * x.astype(object) - np.array(sums, object)).sum(axis=1)
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """One row per complete vector and component: id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error."""
    models = fit_whiteners(df, components, vector_col, scale)
    kept = whole_vectors(df, id_col, vector_col, scale)
    kind = kept.schema[id_col].dataType.simpleString()
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in blocks(b.column(1)):
                m = models[x.shape[1]]
                k = len(m.eigenvalues)
                whitened = (x - np.array([s / m.n for s in m.sums])) @ m.scaled
                explained = m.eigenvalues / m.trace if m.trace else np.full(k, np.nan)
                ids, each = np.repeat(rows, k), np.repeat(np.arange(len(rows)), k)
                columns = [
                    b.column(0).take(pa.array(ids)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(ids), m.n)),
                    deviations(x, m.n, m.sums).take(pa.array(each)),
                    pa.array(whitened.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, len(rows)), from_pandas=True),
                    pa.array([m.identity_error] * len(ids), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
