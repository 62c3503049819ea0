"""Whitening, against exact sums and a plain eigendecomposition."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries, whitening
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, x string, component int, label int"


def plain(vectors, k=4):
    """(n, sums, components, eigenvalues, trace) of the distinct whole vectors."""
    x = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(v, mean)] for v in x])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    return n, sums, vectors[:, ::-1][:, :k], values[::-1][:k], np.trace(v)


def check(rows, vectors):
    """Rows (of a query) for vectors by id, all of one length."""
    n, sums, components, values, trace = plain(list(vectors.values()))
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert set(got) == set(vectors) and all(set(c) == set(range(1, len(values) + 1)) for c in got.values())
    signs = None
    for i, v in vectors.items():
        x = [math.floor(256 * c) for c in v]
        expected = np.array([float(c - Fraction(s, n)) for c, s in zip(x, sums)]) @ components / np.sqrt(values)
        found = np.array([got[i][c].whitened for c in sorted(got[i])])
        if signs is None and np.abs(expected).min() > 1e-3:
            signs = np.sign(expected * found)
        if signs is not None:
            assert found * signs == pytest.approx(expected, abs=1e-7)
        for c, r in got[i].items():
            assert (r.n, int(r.deviation)) == (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)))
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)
            assert r.identity_error <= 1e-9
    assert signs is not None


def test_the_query(spark):
    rows = queries.op12_whitening(spark, DATA).collect()
    assert {type(r.deviation) for r in rows} == {int}
    check(rows, {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()})


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 7, 1) for i, v in vectors], SCHEMA).repartition(3)


def test_few_directions_are_enough(spark):
    """Four strong directions: the small basis reaches rounding; a flat spectrum takes the whole space."""
    rng = np.random.default_rng(1)
    strong = (rng.normal(size=(400, 4)) * [40, 30, 20, 12]) @ np.linalg.qr(rng.normal(size=(30, 4)))[0].T
    vectors = {i: v.tolist() for i, v in enumerate(strong + 0.01 * rng.normal(size=(400, 30)))}
    df = frame(spark, vectors.items())
    assert whitening.fit_whiteners(df)[30].directions == 4 + whitening.OVERSAMPLE
    check(whitening.whiten(df).collect(), vectors)
    flat = frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 30)))])
    assert whitening.fit_whiteners(flat)[30].directions == 30


def test_awkward_vectors(spark):
    """Dropped rows, repeats of a vector and of an id, null ids, extra columns with clashing names."""
    rng = np.random.default_rng(2)
    good = {i: v.tolist() for i, v in enumerate(rng.normal(size=(60, 6)))}
    bad = [None, [], [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] + [1.0] * 5, [-float("inf")] + [1.0] * 5]
    df = frame(spark, [*good.items(), *((100 + i, v) for i, v in enumerate(bad)), *((200 + i, good[3]) for i in range(50)), (3, good[3]), (None, good[4])])
    rows = whitening.whiten(df).collect()
    assert sum(r.vec_id is None for r in rows) == 4 and sum(r.vec_id == 3 for r in rows) == 8
    by_id = {(r.vec_id, r.component): r.whitened for r in rows}
    assert all(by_id[200, c] == by_id[3, c] == by_id[249, c] for c in (1, 2, 3, 4))
    assert not {r.vec_id for r in rows} & set(range(100, 106))
    check([r for r in rows if r.vec_id is not None and r.vec_id < 100], good)


def test_lengths_have_their_own_fit(spark):
    rng = np.random.default_rng(5)
    long, short = {i: v.tolist() for i, v in enumerate(rng.normal(size=(40, 5)))}, {100 + i: v.tolist() for i, v in enumerate(rng.normal(size=(30, 2)))}
    rows = whitening.whiten(frame(spark, [*long.items(), *short.items()])).collect()
    check([r for r in rows if r.vec_id < 100], long)
    check([r for r in rows if r.vec_id >= 100], short)


def test_without_variance(spark):
    rows = whitening.whiten(frame(spark, [(i, [0.5, -0.5, 1.0]) for i in range(5)])).collect()
    assert len(rows) == 15 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in rows)
    line = whitening.whiten(frame(spark, [(i, [0.5 * i, 0.5, float(i)]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and all(r.identity_error < 1e-12 for r in line)


def test_large_entries_and_empty_table(spark):
    """Deviations are exact beyond longs; entries beyond longs are their limits."""
    df = frame(spark, [(0, [3e9, 1.0]), (1, [-3e9, 2.0]), (2, [1.0, 1e300]), (3, [2.0, 5.0])])
    got = {r.vec_id: r for r in whitening.whiten(df).collect() if r.component == 1}
    x = {0: [768 * 10**9, 256], 1: [-768 * 10**9, 512], 2: [256, 2**63 - 1], 3: [512, 1280]}
    sums = [sum(v[i] for v in x.values()) for i in (0, 1)]
    for i, v in x.items():
        exact = sum((4 * a - s) ** 2 for a, s in zip(v, sums))
        assert got[i].deviation == (exact if exact < 10**38 else None)
    assert whitening.whiten(frame(spark, [(0, [1.0])]).filter(F.lit(False))).collect() == []
