"""Shared-scan fits, trees and searches against plain versions on the same rows, and what left-out rows may not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ablation, fits, models, search, trees
from tallyforge.plans import models as plans

N, FOLDS = 360, 3


def data(seed=3, gaps=True):
    """Rows of three classes with three features, some values missing, with outer and inner folds."""
    rng = np.random.default_rng(seed)
    y = np.arange(N) % 3
    x = rng.normal(size=(N, 3)) + y[:, None] * [[1.2, 0.4, 0.0]]
    x[:, 2] = np.round(x[:, 2])
    if gaps:
        x[rng.random(N) < 0.15, 1] = np.nan
    return y, x, (np.arange(N) // 3) % FOLDS, (np.arange(N) // 9) % 2


def frame(spark, y, x, outer, inner):
    rows = [(i, int(y[i]), int(outer[i]), int(inner[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "key long, label int, outer int, in0 int, a double, b double, c double").repartition(3)


NAMES = ("a", "b", "c")


def fit(spark, candidates, inner=False, source=None, **more):
    df = frame(spark, *(source or data()))
    return fits.fit_candidates(df.withColumns({"in1": F.col("in0"), "in2": F.col("in0")}), "key", "label", "outer", ["in0", "in1", "in2"] if inner else [], candidates, 2 if inner else 0, **more)


def lower_median(v):
    v = np.sort(v[~np.isnan(v)])
    return v[(len(v) + 1) // 2 - 1]


def design(x, use):
    """Filled and scaled columns by what the used rows say, with a column of ones."""
    fill = np.array([lower_median(c) for c in x[use].T])
    v = np.where(np.isnan(x), fill, x)
    return np.concatenate([(v - v[use].mean(axis=0)) / v[use].std(axis=0), np.ones((len(x), 1))], axis=1)


def test_medians_and_scales_come_from_each_split(spark):
    y, x, outer, inner = data()
    f = fit(spark, [fits.Candidate("one", "v", NAMES)], inner=True)
    for (_, i, j), m in f.models.items():
        use = (outer != i) & ((inner != j) if j >= 0 else True)
        assert m.fill == pytest.approx([lower_median(c) for c in x[use].T], abs=1e-12)
        v = np.where(np.isnan(x[use]), m.fill, x[use])
        assert m.mean == pytest.approx(v.mean(axis=0)) and m.scale == pytest.approx(v.std(axis=0))


def test_left_out_rows_reach_no_model(spark):
    """Other values and labels in outer fold 0 and in inner fold 1 change none of the models that leave them out."""
    candidates = [fits.Candidate("l2", "v", NAMES, 1.0, "balanced"), fits.Candidate("rbf", "v", NAMES, 1.0, "balanced", fourier=8), fits.Candidate("svc", "v", NAMES, 1.0, None, "svc", fourier=8)]
    y, x, outer, inner = data()
    changed = (outer == 0) | (inner == 1)
    y2, x2 = np.where(changed, (y + 1) % 3, y), np.where(changed[:, None], 9 * x + 5, x)
    one, two = fit(spark, candidates, inner=True), fit(spark, candidates, inner=True, source=(y2, x2, outer, inner))
    for k in range(len(candidates)):
        assert np.allclose(one.models[k, 0, 1].w, two.models[k, 0, 1].w, rtol=0, atol=1e-7)
        assert not np.allclose(one.models[k, 1, 0].w, two.models[k, 1, 0].w)


def test_absolute_penalty(spark):
    """Zeros are exact, and every weight meets the optimality conditions."""
    y, x, outer, _ = data()
    cs = (0.01, 0.05, 1.0)
    f = fit(spark, [fits.Candidate(f"c{c}", "v", NAMES, c, "balanced", "l1") for c in cs], rounds=40)
    zeros = []
    for k, c in enumerate(cs):
        for fold in range(FOLDS):
            use, m = outer != fold, f.models[k, fold, -1]
            z, t = design(x, use)[use], y[use]
            p = np.exp(z @ m.w)
            p /= p.sum(axis=1, keepdims=True)
            weight = (len(t) / (3 * np.bincount(t)))[t][:, None]
            slope = (z.T @ (weight * (p - np.eye(3)[t])))[:-1]
            w = m.w[:-1]
            assert np.abs(slope[w == 0]).max(initial=0) <= 1 / c + 1e-4
            assert slope[w != 0] == pytest.approx(-np.sign(w[w != 0]) / c, abs=1e-3)
            zeros.append(int((w == 0).sum()))
    assert max(zeros[:3]) > max(zeros[-3:]) and min(zeros[:3]) > 0


def test_heads_are_binary_regressions(spark):
    """Two mirrored classes give what one vector of weights gives; rows of no class take no part, in scaling either."""
    y, x, outer, _ = data()
    f = fit(spark, [fits.Candidate("h", "v", NAMES, 0.5, "balanced", target=search.HELPFUL)], rounds=30)
    for fold in range(FOLDS):
        use = (outer != fold) & (y != 1)
        z, t = design(x, use)[use], (y[use] == 2).astype(float)
        weight = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
        w, ridge = np.zeros(4), np.array([2.0, 2.0, 2.0, 0.0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - t)) + ridge * w)
        m = f.models[0, fold, -1]
        assert m.w[:, 1] - m.w[:, 0] == pytest.approx(w, abs=1e-4)


def test_support_vectors(spark):
    """Gradients of the squared hinges and of the sigmoids' likelihood vanish on the training rows."""
    y, x, outer, _ = data()
    f = fit(spark, [fits.Candidate("svc", "v", NAMES, 0.5, "balanced", "svc", fourier=10)], rounds=60)
    for fold in range(FOLDS):
        use, m = outer != fold, f.models[0, fold, -1]
        waves, phase = m.waves
        z = np.concatenate([np.cos(design(x, use)[use][:, :-1] @ waves + phase) * np.sqrt(2 / 10), np.ones((use.sum(), 1))], axis=1)
        n = np.bincount(y[use])
        weight = (use.sum() / (3 * n))[y[use]]
        for k in range(3):
            side = np.where(y[use] == k, 1.0, -1.0)
            margin = z @ m.w[:, k]
            slope = 2 * 0.5 * z.T @ (weight * (side * margin < 1) * (margin - side))
            slope[:-1] += m.w[:-1, k]
            assert np.abs(slope).max() < 1e-3
            p = 1 / (1 + np.exp(margin * m.sigmoid[0, k] + m.sigmoid[1, k]))
            aim = np.where(side > 0, (n[k] + 1) / (n[k] + 2), 1 / (use.sum() - n[k] + 2))
            assert abs((aim - p).sum()) < 1e-3 and abs((margin * (aim - p)).sum()) < 1e-3
    out = fits.predict(f, [[(0, 1.0)]] * FOLDS, [("argmax", 0.0, 0.0)] * FOLDS).collect()
    assert all(abs(r.p_nh + r.p_nmr + r.p_h - 1) < 1e-9 for r in out) and np.mean([r.pred == y[r.key] for r in out]) > 0.5


def test_rules_are_counted_by_thresholds(spark):
    """Every rule's confusion table equals applying the rule to each row."""
    y, *_ = data()
    rules = models.rule_grid()
    f = fit(spark, [fits.Candidate("one", "v", NAMES, 1.0), fits.Candidate("two", "v", ("a",), 1.0, "balanced")])
    tables = fits.confusions(f, rules, inner=False).sum(axis=0)
    for k in range(2):
        p = {r.key: [r.p_nh, r.p_nmr, r.p_h] for r in fits.predict(f, [[(k, 1.0)]] * FOLDS, [("argmax", 0.0, 0.0)] * FOLDS).collect()}
        p = np.array([p[i] for i in range(N)])
        for r, rule in enumerate(rules):
            assert np.array_equal(tables[k, r], np.bincount(3 * y + fits.decide_many(p, rule), minlength=9).reshape(3, 3)), rule


def test_two_stages(spark):
    y, *_ = data()
    f = fit(spark, [fits.Candidate("n", "v", NAMES, 1.0, "balanced", target=search.UNDECIDED), fits.Candidate("h", "v", NAMES, 0.3, "balanced", target=search.HELPFUL)])
    p = {r.key: [v[1] for v in r.p] for r in fits.left_out(f, [[0, 1]] * FOLDS, False).collect()}
    p = np.array([p[i] for i in range(N)])
    first, second = (0.25, 0.33, 0.4, 0.48), (0.4, 0.5, 0.6)
    tables = search.two_stage_confusions(f, [(0, 1)], first, second).sum(axis=0)[0]
    for i, tn in enumerate(first):
        for j, th in enumerate(second):
            pred = np.where(p[:, 0] >= tn, 1, np.where(p[:, 1] >= th, 2, 0))
            assert np.array_equal(tables[i, j], np.bincount(3 * y + pred, minlength=9).reshape(3, 3))


def test_disagreement_rules(spark):
    rng = np.random.default_rng(6)
    rows = [(int(y), *(None if rng.random() < 0.1 else float(v) for v in (s, m, e))) for y, s, m, e in zip(rng.integers(0, 3, 300), rng.integers(0, 9, 300) / 8, rng.integers(0, 9, 300) / 8, rng.random(300))]
    df = spark.createDataFrame(rows, "label int, s double, m double, e double")
    margins, entropies, cuts = (0.0, 0.125, 0.25), (0.5, 0.7), (0.5, 0.625)
    got = search.disagreement_confusions(df, "label", F.col("s"), F.col("m"), F.col("e"), margins, entropies, cuts)
    for i, a in enumerate(margins):
        for j, b in enumerate(entropies):
            for k, cut in enumerate(cuts):
                plain = np.zeros((3, 3))
                for y, s, m, e in rows:
                    plain[y, 1 if (m is not None and m <= a) or (e is not None and e >= b) else 2 if s is not None and s >= cut else 0] += 1
                assert np.array_equal(got[i, j, k], plain)


def test_one_extra_tree_against_recursion(spark):
    y, x, outer, _ = data()
    f = fit(spark, [], also=NAMES)
    forest = trees.Forest("extra", NAMES, 4, 5, trees=3)
    for tree in trees.grow(f, [forest], seed=7):
        use = outer != tree.fold
        v = np.where(np.isnan(x[use]), [lower_median(c) for c in x[use].T], x[use])
        t = y[use]
        weight = len(t) / (3 * np.bincount(t))

        def impurity(part):
            w = np.bincount(part, minlength=3) * weight
            return w.sum() - (w * w).sum() / w.sum()

        def check(node, rows, depth):
            assert np.array_equal(tree.counts[node], np.bincount(t[rows], minlength=3))
            best = None
            if depth < 4 and len(rows) >= 10 and len(set(t[rows])) > 1:
                for j, cut in trees.draws(7, tree, node, v[rows].min(axis=0), v[rows].max(axis=0)):
                    left, right = rows[v[rows, j] < cut], rows[v[rows, j] >= cut]
                    if min(len(left), len(right)) >= 5:
                        score = round(impurity(t[left]) + impurity(t[right]), 9)
                        if best is None or score < best[0]:
                            best = (score, j, cut, left, right)
            if best is None:
                assert tree.feature[node] == -1
                return
            assert (tree.feature[node], tree.cut[node]) == best[1:3]
            check(2 * node + 1, best[3], depth + 1)
            check(2 * node + 2, best[4], depth + 1)

        check(0, np.arange(len(t)), 0)


def test_forests_on_left_out_rows(spark):
    y, *_ = data()
    f = fit(spark, [], also=NAMES)
    forests = [trees.Forest("a", NAMES, 3, 3), trees.Forest("b", ("a",), 1, 3, balanced=False)]
    grown = trees.grow(f, forests)
    table = trees.confusions(f, forests, grown).sum(axis=0)
    out = trees.predict(f, forests[0], [t for t in grown if t.forest == 0]).collect()
    assert np.trace(table[0]) == sum(r.pred == y[r.key] for r in out) > N / 2
    assert table[1].sum() == N and all(abs(r.p_nh + r.p_nmr + r.p_h - 1) < 1e-9 for r in out)


def test_ensembles_are_single_fits(spark):
    """What the search counts for a fold is what one fit of Spark ML on the other folds gives."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    y, x, outer, inner = data(gaps=False)
    f = fit(spark, [], source=(y, x, outer, inner), also=NAMES)
    forest = search.Ensemble("rf", NAMES, "rf", 3, 3, 5, False)
    got = search.ensemble_confusions(f, [forest, search.Ensemble("gbt", NAMES, "gbt", 2, 3, 2)], at_once=3)
    assert got.shape == (FOLDS, 2, 3, 3) and got.sum() == 2 * N and np.trace(got[:, 1].sum(axis=0)) > N / 2
    rows = f.rows.select(F.col("label").cast("double").alias("label"), "outer", array_to_vector("x").alias("features"))
    model = RandomForestClassifier(numTrees=5, maxDepth=3, minInstancesPerNode=3, seed=42).fit(rows.where("outer <> 1"))
    single = model.transform(rows.where("outer = 1")).groupBy("label", "prediction").count().collect()
    assert {(int(r.label), int(r.prediction)): r["count"] for r in single} == {(a, b): int(n) for (a, b), n in np.ndenumerate(got[1, 0]) if n}


def test_jobs_keep_their_order_and_failures_rise(spark):
    assert search.side_by_side(spark, [lambda i=i: spark.range(i + 1).count() for i in range(7)], 3) == list(range(1, 8))

    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="no"):
        search.side_by_side(spark, [fails], 2)


def test_labels_of_an_outer_fold_do_not_reach_its_gate(spark):
    """Shuffled labels in one outer fold change none of its predictions, heads or thresholds."""
    rng = np.random.default_rng(11)
    y, x, _, _ = data(gaps=False)
    rows = [(i, i, int(y[i]), *map(float, x[i])) for i in range(N)]
    df = plans.folded(spark.createDataFrame(rows, "note_id long, note_key long, label int, a double, b double, c double"))
    fold = {r.note_id: r.outer for r in df.collect()}
    mine = [i for i in range(N) if fold[i] == 2]
    other = dict(zip(mine, rng.permutation(y[mine])))
    swapped = spark.createDataFrame([(i, int(other.get(i, y[i]))) for i in range(N)], "note_id long, __y int")
    views = {"summary": ["a", "b"], "full": list(NAMES)}
    read = lambda d: {r.note_id: tuple(r)[1:] for r in plans.rescue(d, views).where("outer_fold = 2").collect()}
    one, two = read(df), read(df.join(swapped, "note_id").withColumn("label", F.col("__y")).drop("__y"))
    assert one == two and set(one) == set(mine)


def test_cut_points_against_all_pairs():
    rng = np.random.default_rng(9)
    for target in (0.0, 0.4, 0.8, 1.0):
        hist = rng.integers(0, 6, (2, 8)).astype(float)
        best = None
        for low in range(9):
            for high in range(low, 9):
                decided = hist[:, :low].sum() + hist[:, high:].sum()
                if decided >= target * hist.sum():
                    right = hist[0, :low].sum() + hist[1, high:].sum()
                    key = (round(right / max(decided, 1), 9), decided, -low, -high)
                    best = max(best, (key, low, high)) if best else (key, low, high)
        assert ablation.cut_points(hist, target) == best[1:]


def test_selective_targets(spark):
    """Decisions per target equal cutting each row's score; no outer label moves a threshold; intervals are those of plain resampling."""
    y, x, outer, inner = data(gaps=False)
    candidates = [fits.Candidate("h", "v", NAMES, 1.0, "balanced", target=search.HELPFUL)]
    f = fit(spark, candidates, inner=True, source=(y, x, outer, inner))
    got = ablation.selective(f, [0], (0.5, 1.0), bins=20)
    inside = ablation.binned(f, [0], True, 20)
    scores = {r.key: r.p[0][1] for r in fits.left_out(f, [[0]] * FOLDS, False).collect()}
    for s in got:
        table = np.zeros((2, 3))
        for i in range(N):
            if y[i] != 1:
                low, high = ablation.cut_points(inside[outer[i], 0], s.target)
                place = min(int(scores[i] * 20), 19)
                table[y[i] // 2, 0 if place < low else 2 if place >= high else 1] += 1
        assert np.array_equal(s.table, table) and s.coverage >= s.target - 0.15
        a, b, c, d = s.intervals(4000, 3)
        right = np.repeat([1, 0, -1], [int(table[0, 0] + table[1, 2]), int(table[0, 2] + table[1, 0]), int(table[:, 1].sum())])
        rng = np.random.default_rng(5)
        draws = [right[rng.integers(0, len(right), len(right))] for _ in range(2000)]
        assert (a, b) == pytest.approx(np.quantile([(z == 1).sum() / (z >= 0).sum() for z in draws], [0.025, 0.975]), abs=0.02)
        assert (c, d) == pytest.approx(np.quantile([(z >= 0).mean() for z in draws], [0.025, 0.975]), abs=0.02)
    swapped = np.where(outer == 1, 2 - y, y)
    other = ablation.binned(fit(spark, candidates, inner=True, source=(swapped, x, outer, inner)), [0], True, 20)
    assert np.array_equal(inside[1], other[1]) and not np.array_equal(inside[0], other[0])


@pytest.mark.parametrize("kind, rounds", [("l2", 12), ("l1", 40), ("svc", 60)])
def test_large_tables_start_from_a_sample(spark, monkeypatch, kind, rounds):
    """Fits that start from a sample end where fits on all rows end, with gradients alone in few scans over all rows."""
    rng = np.random.default_rng(4)
    n = 6000
    y = np.arange(n) % 3
    x = rng.normal(size=(n, 3)) + y[:, None] * [[1.2, 0.4, 0.0]]
    x[rng.random(n) < 0.15, 1] = np.nan
    source = y, x, (np.arange(n) // 3) % FOLDS, (np.arange(n) // 9) % 2
    candidates = [fits.Candidate("one", "v", NAMES, 0.1, "balanced", kind), fits.Candidate("two", "v", ("a", "b"), 1.0, None, kind)]
    plain = fit(spark, candidates, inner=True, source=source, rounds=rounds)
    scans = []
    newton = fits._summed

    def counted(rows, task, n, *more):
        scans.append(rows.count())
        return newton(rows, task, n, *more)

    monkeypatch.setattr(fits, "SAMPLE", 1000)
    monkeypatch.setattr(fits, "_summed", counted)
    started = fit(spark, candidates, inner=True, source=source, rounds=rounds)
    for key, m in plain.models.items():
        assert np.allclose(m.w[:-1] - m.w[:-1].mean(axis=1, keepdims=True), started.models[key].w[:-1] - started.models[key].w[:-1].mean(axis=1, keepdims=True), rtol=0, atol=2e-5), key
        assert m.kind != "svc" or np.allclose(m.sigmoid, started.models[key].sigmoid, atol=1e-3)
    assert any(s < n / 3 for s in scans)


def test_models_that_see_a_row_alike_share_its_sums(spark):
    """Batched gradients and curvatures equal those of one model at a time, written out."""
    rng = np.random.default_rng(2)
    z, t = np.concatenate([rng.normal(size=(4, 50)), np.ones((1, 50))]), rng.integers(0, 3, 50)
    for kind in ("l2", "svc"):
        group = [fits._Model(0, -1, np.arange(4), kind, c, np.arange(3), np.zeros(4), np.zeros(4), np.ones(4), rng.random(3) + 0.5, rng.normal(size=(5, 3))) for c in (0.3, 2.0)]
        for m, got in zip(group, fits._slopes(z, t, group, True)):
            slope, curve = np.zeros((3, 5)), np.zeros((3, 5, 3, 5))
            for k in range(50):
                s, w = m.w.T @ z[:, k], m.weight[t[k]]
                p = np.exp(s) / np.exp(s).sum()
                for a in range(3):
                    side = 1 if t[k] == a else -1
                    hit = 2 * m.c * w * (side * s[a] < 1)
                    slope[a] += (hit * (s[a] - side) if kind == "svc" else w * (p[a] - (t[k] == a))) * z[:, k]
                    for b in range(3):
                        bend = hit * (a == b) if kind == "svc" else w * p[a] * ((a == b) - p[b])
                        curve[a, :, b] += bend * np.outer(z[:, k], z[:, k])
            assert np.allclose(got[:15], slope.ravel()) and np.allclose(fits._curvature(got[15:], m), curve.reshape(15, 15))
            assert np.allclose(fits._slopes(z, t, group, False), fits._slopes(z, t, group, True)[:, :15])
            assert not fits._slopes(z[:, :0], t[:0], group, True).any()


def test_folds_keep_repeated_and_missing_keys(spark):
    """Every row comes back once with its folds, rows that share a key or have none too; classes are dealt evenly."""
    keys = [*range(60), 7, 7, None, None]
    df = spark.createDataFrame([(i, k, i % 3) for i, k in enumerate(keys)], "note_id long, note_key long, label int")
    got = plans.folded(df).collect()
    assert sorted(r.note_id for r in got) == list(range(len(keys)))
    for label in range(3):
        sizes = np.bincount([r.outer for r in got if r.label == label], minlength=plans.OUTER)
        assert sizes.max() - sizes.min() <= 1
        for f in range(plans.OUTER):
            inside = np.bincount([r[f"inner{f}"] for r in got if r.label == label and r.outer != f], minlength=plans.INNER)
            assert inside.max() - inside.min() <= 1


def test_votes_are_shuffled_and_not_the_sums_of_all_statistics(spark):
    from tallyforge.operators import votes as vote_ops

    df = spark.createDataFrame([("n", i % 3, 10 * i, i) for i in range(5)], "note_id string, raw_label_id int, confidence int, understanding int")
    out = vote_ops.vote_features(df)
    below = out._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]
    assert "Aggregate" not in below
    assert out.first().n_votes == 5


def test_equal_rows_are_read_once(spark):
    """Trees of a table whose rows are there four times, some gaps among them, scan its distinct rows and count every copy."""
    y, x, outer, inner = data()
    four = [np.concatenate([a] * 4) for a in (y, x, outer, inner)]
    f = fit(spark, [], source=four, also=NAMES)
    alike = trees.alike(f, NAMES).collect()
    rows = {(int(a), *(None if np.isnan(z) else float(z) for z in b)) for a, b in zip(y, x, strict=True)}
    assert len(alike) == len(rows) and sum(sum(r.n) for r in alike) == 4 * len(y)
    forest = [trees.Forest("a", NAMES, 3, 3), trees.Forest("b", NAMES[:1], 2, 3)]
    grown = trees.grow(f, forest)
    table = trees.confusions(f, forest, grown)
    o = four[2]
    for k, tree in ((k, [t for t in grown if (t.forest, t.fold) == (k, 0)]) for k in (0, 1)):
        pred = trees.probabilities(tree, four[1][o == 0], forest[k].depth).argmax(axis=1)
        assert np.array_equal(table[0, k], np.bincount(four[0][o == 0] * 3 + pred, minlength=9).reshape(3, 3))
        n = np.bincount(four[0][o != 0], minlength=3)
        for t in tree:
            node = t.node(t.values(four[1][o != 0]), forest[k].depth)
            assert np.array_equal(t.counts[0], n) and all(np.array_equal(t.counts[i], np.bincount(four[0][o != 0][node == i], minlength=3)) for i in np.unique(node))


def test_fits_read_equal_rows_once(spark, monkeypatch):
    """A large table whose rows are often equal in a model's columns is scanned by its distinct rows, to the same weights and sigmoids."""
    rng = np.random.default_rng(8)
    n = 3000
    y = np.arange(n) % 3
    x = np.round(rng.normal(size=(n, 3)) + y[:, None] * [[1.2, 0.4, 0.0]])
    x[:, 2] += rng.random(n)
    x[rng.random(n) < 0.1, 1] = np.nan
    source = y, x, (np.arange(n) // 3) % FOLDS, np.zeros(n, int)
    candidates = [fits.Candidate("few", "v", ("a", "b"), 0.3, "balanced"), fits.Candidate("svc", "v", ("b", "a"), 1.0, "balanced", "svc", fourier=6), fits.Candidate("head", "v", ("a", "b"), 1.0, target=search.HELPFUL), fits.Candidate("all", "v", NAMES, 1.0)]
    plain = fit(spark, candidates, source=source, rounds=60)
    scans, newton = [], fits._newton

    def counted(body, *more):
        scans.append(body.count())
        return newton(body, *more)

    monkeypatch.setattr(fits, "SAMPLE", 500)
    monkeypatch.setattr(fits, "_newton", counted)
    got = fit(spark, candidates, source=source, rounds=60)
    distinct = {(int(a), int(b), *(None if np.isnan(v) else v for v in r)) for a, b, r in zip(y, source[2], x[:, :2])}
    assert sorted(scans)[-1] == n and len(distinct) in scans and len(distinct) < n / 4
    for key, m in plain.models.items():
        other = got.models[key]
        assert np.allclose(m.w[:-1] - m.w[:-1].mean(axis=1, keepdims=True), other.w[:-1] - other.w[:-1].mean(axis=1, keepdims=True), rtol=0, atol=2e-5), key
        assert m.kind != "svc" or np.allclose(m.sigmoid, other.sigmoid, atol=1e-3)


def test_one_random_forest_against_recursion(spark):
    """Every cut is the best bound of the node's features on the tree's own sample; a forest of less depth is the upper part."""
    y, x, outer, inner = data()
    four = [np.concatenate([a] * 2) for a in (y, x, outer, inner)]
    f = fit(spark, [], source=four, also=NAMES)
    forests = [trees.Forest("deep", NAMES, 4, 5, trees=3), trees.Forest("flat", NAMES, 1, 5, trees=3), trees.Forest("other", NAMES[:2], 2, 3, trees=1, balanced=False)]
    grown = trees.grow_bagged(f, forests, seed=7)
    assert [(t.forest, t.fold, t.number) for t in grown] == [(k, i, j) for k, g in enumerate(forests) for i in range(FOLDS) for j in range(g.trees)]
    rows = sorted(trees.alike(f, NAMES).collect(), key=lambda r: r.label)
    label, n, hashes = (np.array([r[i] for r in rows]) for i in ("label", "n", "hash"))
    values = np.array([r.x for r in rows])
    for tree in (t for t in grown if t.forest == 0):
        many = n.sum(axis=1) - n[:, tree.fold]
        use = many > 0
        v, t = tree.values(values[use]), label[use]
        times = trees.bag(hashes[use].view(np.uint64), many[use], 7, tree.number)
        assert 0.8 < times.sum() / many.sum() < 1.2
        all_rows = tree.values(four[1][four[2] != tree.fold])
        bounds = [trees.bounds(c) for c in all_rows.T]
        counts = lambda part: np.bincount(t[part], times[part], 3)

        def check(node, part, depth):
            assert np.array_equal(tree.counts[node], counts(part))
            best = None
            if depth < 4:
                for j in trees.chosen(7, tree, node):
                    for cut in bounds[j]:
                        left, right = part[v[part, j] <= cut], part[v[part, j] > cut]
                        if min(times[left].sum(), times[right].sum()) >= 5:
                            score = round(float(trees.gini(counts(left), tree.weight) + trees.gini(counts(right), tree.weight)), 9)
                            if (best is None or score < best[0]) and score < round(float(trees.gini(counts(part), tree.weight)), 9):
                                best = (score, j, left, right)
            if tree.feature[node] < 0:
                # no cut, or one below which all leaves say the same
                return {int((tree.counts[node] * tree.weight).argmax())}
            assert tree.feature[node] == best[1]
            says = check(2 * node + 1, best[2], depth + 1) | check(2 * node + 2, best[3], depth + 1)
            assert len(says) > 1
            return says

        check(0, np.arange(len(t)), 0)
        flat = next(u for u in grown if u.forest == 1 and (u.fold, u.number) == (tree.fold, tree.number))
        assert len(flat.counts) == 3 and np.array_equal(flat.counts, tree.counts[:3])
    table = trees.confusions(f, forests, grown)
    assert table.sum() == 3 * 2 * N and np.trace(table[:, 0].sum(axis=0)) > N


def test_random_forests_classify_as_spark_ml(spark):
    y, x, outer, inner = data(gaps=False)
    f = fit(spark, [], source=(y, x, outer, inner), also=NAMES)
    own = [trees.Forest("d3", NAMES, 3, 3), trees.Forest("d6", NAMES, 6, 3)]
    got = trees.confusions(f, own, trees.grow_bagged(f, own)).sum(axis=0)
    ml = search.ensemble_confusions(f, [search.Ensemble(g.name, NAMES, "rf", g.depth, g.leaf) for g in own]).sum(axis=0)
    assert all(abs(np.trace(a) - np.trace(b)) < 0.05 * N for a, b in zip(got, ml, strict=True))


def test_samples_of_equal_rows_are_sums_of_samples():
    """Poisson numbers of n equal rows have mean and variance n, and are the same in every scan."""
    hashes = np.random.default_rng(1).integers(0, 2**63, 40000).astype(np.uint64)
    for n in (1, 3, 400, 100000):
        k = trees.bag(hashes, np.full(len(hashes), n), 42, 3)
        assert abs(k.mean() / n - 1) < 0.02 and abs(k.var() / n - 1) < 0.05
        assert np.array_equal(k[:100], trees.bag(hashes[:100], np.full(100, n), 42, 3))
    assert not np.array_equal(k, trees.bag(hashes, np.full(len(hashes), n), 42, 4))
    assert np.array_equal(trees.bounds(np.array([3.0, 1.0, 1.0, 2.0])), [1.5, 2.5]) and len(trees.bounds(np.arange(1000.0))) == trees.BINS - 1 and len(trees.bounds(np.ones(5))) == 0
