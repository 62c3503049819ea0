"""Mini-batch k-means against full batches, the Euclidean silhouette against a plain one, and a search that is stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import clusters, fits

NAMES = ["a", "b"]


def blobs(n, k=5, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, 2)) * 6
    return centers[rng.integers(0, k, n)] + rng.normal(size=(n, 2))


def frame(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(4)


def test_quality_with_few_rows_read(spark):
    """Within 2 % of the inertia of full batches, with steps that read a tenth of its rows."""
    x = blobs(12_000)
    df = frame(spark, x)
    full = {r.k: r.inertia for r in fits.kmeans_many(df, NAMES, [3, 5, 8], starts=10)[0].collect()}
    batch, steps = 256, 40
    got = {r.k: r for r in clusters.search_k(df, NAMES, "id", [3, 5, 8], batch=batch, steps=steps).collect()}
    assert batch * steps <= len(x) * 30 / 10  # the full batches take up to 30 scans
    for k in full:
        assert got[k].inertia <= 1.02 * full[k] and got[k].n_rows == len(x) and got[k].sample_size == clusters.SAMPLE


def test_repeatable(spark):
    x = blobs(900)
    one, two = (clusters.search_k(frame(spark, x).repartition(n), NAMES, "id", [2, 5], batch=128, steps=20).collect() for n in (3, 7))
    for a, b in zip(one, two, strict=True):
        assert tuple(a) == pytest.approx(tuple(b), rel=1e-9)


def test_scores_against_plain_ones(spark):
    x = blobs(700, 4)
    rows = clusters.scaled(frame(spark, x), NAMES, "id")
    z = np.array([r.x for r in rows.orderBy("h", "x").collect()])
    centers = {k: z[np.random.default_rng(k).choice(len(z), k, replace=False)] for k in (2, 4)}
    centers[1] = z[:1]
    for size in (700, 90):
        silhouettes, used = clusters.euclidean_silhouettes(rows, centers, size, block=64)
        assert used == size and np.isnan(silhouettes[1])
        s = z[:size]
        d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(axis=2))
        for k in (2, 4):
            own = ((s[:, None] - centers[k][None]) ** 2).sum(axis=2).argmin(axis=1)
            values = []
            for i in range(size):
                mine = own == own[i]
                a = d[i][mine].sum() / max(mine.sum() - 1, 1)
                b = min(d[i][own == c].mean() for c in set(own.tolist()) - {own[i]})
                values.append((b - a) / max(a, b) if mine.sum() > 1 else 0.0)
            assert silhouettes[k] == pytest.approx(np.mean(values), abs=1e-9)
    for k, n, _, inertia, _, ch, db in clusters.scored(rows, len(z), centers):
        own = ((z[:, None] - centers[k][None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (n, inertia) == (700, pytest.approx(((z - centers[k][own]) ** 2).sum()))
        if k == 1:
            assert np.isnan(ch) and np.isnan(db)
            continue
        m = np.array([z[own == c].mean(axis=0) for c in range(k)])
        within = sum(((z[own == c] - m[c]) ** 2).sum() for c in range(k))
        between = sum((own == c).sum() * ((m[c] - z.mean(axis=0)) ** 2).sum() for c in range(k))
        spread = [np.sqrt(((z[own == c] - m[c]) ** 2).sum(axis=1)).mean() for c in range(k)]
        worst = [max((spread[i] + spread[j]) / np.linalg.norm(m[i] - m[j]) for j in range(k) if j != i) for i in range(k)]
        assert ch == pytest.approx(between / (k - 1) / (within / (n - k))) and db == pytest.approx(np.mean(worst))


def test_a_stopped_search_goes_on(spark, tmp_path, monkeypatch):
    """Runs that were logged are not made again, and the table is the same."""
    df, ks, more = frame(spark, blobs(500)), [2, 3, 4, 5], {"at_once": 2, "batch": 128, "steps": 8}
    whole = clusters.search_k(df, NAMES, "id", ks, **more).collect()
    made, real = [], clusters.mini_batches

    def stops(rows, n, wanted, **given):
        made.append(list(wanted))
        if len(made) == 2:
            raise KeyboardInterrupt
        return real(rows, n, wanted, **given)

    monkeypatch.setattr(clusters, "mini_batches", stops)
    log = f"file://{tmp_path}/log"
    with pytest.raises(KeyboardInterrupt):
        clusters.search_k(df, NAMES, "id", ks, log, **more)
    again = clusters.search_k(df, NAMES, "id", ks, log, **more).collect()
    assert made == [[2, 3], [4, 5], [4, 5]]
    assert all(tuple(a) == pytest.approx(tuple(b), rel=1e-9) for a, b in zip(again, whole, strict=True))
    assert clusters.search_k(df, NAMES, "id", ks, log, **more).count() == 4 and len(made) == 3


def test_few_rows(spark):
    """No rows, equal rows, fewer distinct rows than clusters."""
    assert clusters.search_k(frame(spark, np.zeros((0, 2))), NAMES, "id", [2, 3]).count() == 0
    assert clusters.search_k(frame(spark, np.ones((5, 2))), NAMES, "id", [2, 3]).count() == 0
    assert [r.k for r in clusters.search_k(frame(spark, np.array([[0, 0], [1, 1], [0, 0]])), NAMES, "id", [2, 3], steps=3).collect()] == [2]


def test_clusters_of_a_table(spark):
    """The count with the best silhouette; few, equal and no rows."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.4 + c for c in ((0, 0), (9, 0), (0, 9))])
    got = clusters.clustered(frame(spark, x), NAMES, "id", range(2, 6)).collect()
    of = {r.id: r.cluster for r in got}
    assert len(of) == 180 and len(set(of.values())) == 3 and all(len({of[i] for i in range(at, at + 60)}) == 1 for at in (0, 60, 120))
    assert {r.cluster for r in clusters.clustered(frame(spark, x[[0, 1, 2]] + [[0, 0], [0, 0], [9, 0]]), NAMES, "id", range(2, 6)).collect()} == {0, 1}
    assert {r.cluster for r in clusters.clustered(frame(spark, np.ones((5, 2))), NAMES, "id", range(2, 6)).collect()} == {0}
    assert clusters.clustered(frame(spark, x[:0]), NAMES, "id", range(2, 6)).count() == 0


def test_groups_and_shared_columns(spark):
    """Groups in shared scans, with columns that rows share by a key, as each group alone with these columns in its rows."""
    rng = np.random.default_rng(4)
    texts = {t: [0.0, 0.25, v] for t, v in ((0, 3.0), (1, 0.0), (2, -3.0))}
    rows = [(i, i % 3, int(rng.integers(0, 5)), float(rng.normal() + 8 * (i % 2))) for i in range(600)]
    rows = [(i, g, t if t < 4 else None, a) for i, g, t, a in rows]  # texts 3 and null have no columns
    df = spark.createDataFrame(rows, "id long, g int, t int, a double").repartition(4)
    shared = spark.createDataFrame(list(texts.items()), "t int, v array<double>")
    got = {r.id: r.cluster for r in clusters.clustered(df, ["a"], "id", range(2, 6), group="g", shared=shared, width=3, on="t").collect()}
    assert len(got) == 600
    wide = spark.createDataFrame([(i, g, a, *texts.get(t, [0.0] * 3)) for i, g, t, a in rows], "id long, g int, a double, w0 double, w1 double, w2 double")
    for g in range(3):
        alone = clusters.clustered(wide.where(F.col("g") == g), ["a", "w0", "w1", "w2"], "id", range(2, 6)).collect()
        assert len({r.cluster for r in alone}) > 1 and {r.id: r.cluster for r in alone} == {i: c for i, c in got.items() if i % 3 == g}


def test_repeated_keys(spark):
    """Keys whose hashes all lie above the bound for samples."""
    x = np.concatenate([np.zeros((12_000, 2)), np.full((9_000, 2), 5.0)])
    df = frame(spark, x).withColumn("id", F.lit(1))
    bound = int(2**64 * 1.2 * clusters.SAMPLE / len(x)) - (1 << 63)
    if df.select(F.xxhash64("id").alias("h")).first()["h"] <= bound:
        df = df.withColumn("id", F.lit(next(i for i in range(99) if spark.range(1).select(F.xxhash64(F.lit(i)).alias("h")).first()["h"] > bound)))
    got = clusters.clustered(df, NAMES, "id", [2]).groupBy("a").agg(F.count_distinct("cluster").alias("k"), F.max("cluster").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r.n for r in got) == [9_000, 12_000] and all(r.k == 1 for r in got)


def test_classes_share_their_scans(spark, monkeypatch):
    """All classes take a step in one scan, and no note carries the words of its text."""
    from tallyforge.plans import models
    from tests.conftest import DATA

    scans, widths, real, placed = [], [], fits._summed, clusters.clustered
    monkeypatch.setattr(fits, "_summed", lambda *a, **more: scans.append(1) or real(*a, **more))
    monkeypatch.setattr(clusters, "clustered", lambda df, *a, **more: widths.append(len(df.columns)) or placed(df, *a, **more))
    models.reason_clusters(spark, DATA)
    assert len(scans) <= 25 and widths and max(widths) < models.TERMS


def test_reason_clusters(spark):
    """Three classes, every note in a cluster, words of real texts by side, five examples of each cluster or all its notes."""
    from tallyforge.plans import registry
    from tests.conftest import DATA

    got = registry.QUERIES["reason_clusters"](spark, DATA).collect()
    assert {r.label for r in got} == {"HELPFUL", "NEEDS_MORE_RATINGS", "NOT_HELPFUL"}
    notes = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").join(spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey")).count()
    assert sum(r.n for r in got) == notes
    text = " ".join(r.text.lower() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text)
    for r in got:
        assert len(r.examples.split(";")) == min(r.n, 5)
        terms = [t.split("=")[0] for side in (r.helpful_terms, r.not_helpful_terms) for t in side.split(";") if t]
        assert terms and all(t in text for t in terms)
