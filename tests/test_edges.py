"""Hand-written edge cases: sentinels, ties, nulls, capacity, malformed replies."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.functions import parsing as p
from tallyforge.operators import metrics, models, personas, relational, sampling, texts, votes
from tallyforge.sources import collect, files


def one(df):
    return [tuple(r) for r in df.collect()]


def test_latest_prefers_missing_time(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "x"), ("b", None, "z"), ("c", 3, "p"), ("c", 3, "q")], "id string, ts long, s string")
    assert sorted(one(relational.keep_latest(df, ["id"], "ts", [F.col("s")]).select("id", "s"))) == [("a", "y"), ("b", "z"), ("c", "p")]


def test_indicator_modes(spark):
    df = spark.createDataFrame([(x,) for x in ["-1", "0", "1", "2", None, "1.0", " 1 ", "abc", ""]], "x string")
    zero = [r[0] for r in df.select(c.indicator(F.col("x"))).collect()]
    null = [r[0] for r in df.select(c.indicator(F.col("x"), "null")).collect()]
    raw = [r[0] for r in df.select(c.indicator(F.col("x"), "raw")).collect()]
    assert zero == [0, 0, 1, 1, 0, 1, 1, 0, 0]
    assert null == [None, 0, 1, 2, None, 1, 1, None, None]
    assert raw == [-1, 0, 1, 2, None, 1, 1, None, None]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in [20.0, 20.0001, 40.0, 80.0, -5.0, 1000.0, None]], "x double")
    assert [r[0] for r in df.select(c.right_closed_bin(F.col("x"), [20, 40, 60, 80])).collect()] == [0, 1, 1, 3, 0, 4, None]


def test_argmax_ties_go_low(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 1.0, 1.0), (1.0, 1.0, 1.0), (0.0, 0.0, 1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(c.argmax3(F.col("a"), F.col("b"), F.col("c"))).collect()] == [0, 1, 0, 2]


def test_single_vote_has_no_spread(spark):
    df = spark.createDataFrame([("n", 2, 70, 50)], "note_id string, raw_label_id int, confidence int, understanding int")
    r = votes.vote_features(df).first()
    assert (r.n_votes, r.std_score, r.std_confidence, r.share_h) == (1, 0.0, 0.0, 1.0)


def test_allocation(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 1)], "s string, n long")
    got = dict(one(sampling.allocate(counts, ["s"], 10).select("s", "allocated")))
    assert sum(got.values()) == 10 and got["a"] >= got["b"] >= got["c"]
    assert dict(one(sampling.allocate(counts, ["s"], 31).select("s", "allocated"))) == {"a": 10, "b": 10, "c": 10, "d": 1}
    with pytest.raises(ValueError):
        sampling.check_size(counts, 32)


def test_redistribution_matches_rounds(spark):
    import random

    r = random.Random(1)
    for _ in range(4):
        rows = [(f"s{i:02d}", r.randint(0, 9), r.randint(0, 12)) for i in range(12)]
        given = {k: min(a, b) for k, a, b in rows}
        room = {k: max(b - a, 0) for k, a, b in rows}
        deficit = min(sum(a for _, a, _ in rows) - sum(given.values()), 10**9)
        if deficit > sum(room.values()):
            continue
        order = sorted((k for k in room if room[k]), key=lambda k: (-room[k], k))
        want, i = dict(given), 0
        top = {k: given[k] + room[k] for k in room}
        while deficit:
            k = order[i % len(order)]
            if want[k] < top[k]:
                want[k] += 1
                deficit -= 1
            i += 1
        df = spark.createDataFrame(rows, "s string, allocated long, available long")
        assert dict(one(sampling.redistribute(df, ["s"]).select("s", "final"))) == want


def test_distribution_counts_null_keys(spark):
    pop = spark.createDataFrame([("x",), (None,), (None,)], "t string")
    sam = spark.createDataFrame([(None,), ("y",)], "t string")
    got = {r["value"]: (r.population_count, r.sample_count) for r in relational.distribution(pop, sam, ["t"], "d").collect()}
    assert got == {"x": (1, 0), "null": (2, 1), "y": (0, 1)}


def test_reason_choice(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 2, 3), (1, 1, 0), (5, 4, 3)], "a long, b long, c long")
    got = [r[0] for r in votes.ranked_reasons(df, ["a", "b", "c"], most=2).select("reasons").collect()]
    assert got == [[], ["a"], ["c", "a"], ["a"], ["a", "b"]]


def test_bands(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "x double")
    got = [r[0] for r in personas.bands(df, {"x": ("high", "low")}).orderBy("x").select("x_band").collect()]
    assert got == ["middle", "very low", "moderately low", "moderately high", "very high", "very high"]


def test_metrics_with_missing_classes(spark):
    df = spark.createDataFrame([(2, 2), (2, 0), (1, 2)], "t int, p int")
    r = df.agg(*metrics.three_way(F.col("t"), F.col("p"))).first()
    assert r.recall_not_helpful is None and r.balanced_accuracy == pytest.approx(0.25) and r.cross_error == 1
    empty = df.where("false").agg(*metrics.three_way(F.col("t"), F.col("p"))).first()
    assert empty.accuracy is None and empty.n_helpful == 0


def test_auc_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    r = metrics.roc_auc(df, "s", F.col("y") == 1).first()
    assert r.roc_auc == pytest.approx(0.875)
    assert metrics.roc_auc(df.where("y = 1"), "s", F.col("y") == 1).first().roc_auc is None


def test_global_rank(spark):
    df = spark.range(1000).repartition(7)
    got = one(relational.global_rank(df, [F.col("id").desc()]).orderBy("rank"))
    assert [r[0] for r in got] == list(range(999, -1, -1)) and [r[1] for r in got] == list(range(1, 1001))


def test_replies(spark):
    texts_ = ['{"helpfulnessLevel":"HELPFUL","agree":0,"confidence":70.5}', 'Sure: {"rating":"x","helpfulnessLevel":"not helpful","agree":"NO"} ok', '{""helpfulnessLevel"":""HELPFUL"",""agree"":""yes""}', "no json", "", None]
    df = spark.createDataFrame([(t,) for t in texts_], "t string").withColumn("b", p.json_blob(F.col("t")))
    raw = F.coalesce("t", F.lit(""))
    got = one(df.select(p.rating(p.field(F.col("b"), "helpfulnessLevel"), raw), p.yes_no(p.field(F.col("b"), "agree")), p.yes_no(p.field(F.col("b"), "agree"), "compat"), p.score_100(p.field(F.col("b"), "confidence"))))
    assert got == [("HELPFUL", 0, -1, 70), ("NOT_HELPFUL", 0, 0, -1), ("HELPFUL", 1, 1, -1), ("UNKNOWN", -1, -1, -1), ("UNKNOWN", -1, -1, -1), ("UNKNOWN", -1, -1, -1)]


def test_topics_first_bucket_wins(spark):
    df = spark.createDataFrame([("a war over the election",), ("nothing élection xvotes",), (None,)], "t string")
    assert [r[0] for r in df.select(texts.semantic_topic(F.col("t"))).collect()] == ["politics_elections_government", "other_misc", "other_misc"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿id\tx\n1\t a\n2\tb\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,x\n")
    assert one(files.read_delimited(spark, str(tmp_path), "id string, x string", pattern="*.tsv")) == [("1", " a"), ("2", "b")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/x.json").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    assert sorted(one(files.read_json_log(spark, str(tmp_path / "log"), "k long"))) == [(1,), (2,)]
    df = files.ensure_columns(spark.range(1), {"ID": 5, "y": 7})
    assert df.columns == ["id", "y"]
    with pytest.raises(ValueError):
        files.require_columns(df, ["zz"])


def test_collect(spark):
    def fetch(row):
        if row["k"] == 2:
            raise RuntimeError("no")
        return {"text": f"t{row['k']}"}

    queue = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = {r.key: r.status for r in collect.collect_from(queue, "k", fetch, retries=2).collect()}
    assert got == {"1": "success", "2": "failed", "3": "success"}
    done = spark.createDataFrame([("1", "success"), ("2", "failed")], "k string, status string")
    assert sorted(r.k for r in collect.pending(queue.select(F.col("k").cast("string").alias("k")), done, "k").collect()) == ["2", "3"]
    assert collect.preflight(queue, "k", fetch, 1)


def test_model_selection(spark):
    df = spark.range(240).select("id", F.col("id").alias("key"), (F.col("id") % 3).cast("double").alias("label"))
    df = df.withColumn("x", F.col("label") * 2 + F.rand(1)).withColumn("y", F.when(F.col("id") % 7 != 0, F.rand(2)))
    for kind in ("rf", "gbt"):
        p = models.fit_predict(df.where("id < 120"), df.where("id >= 120"), ["x", "y"], "label", models.Spec(kind=kind, balanced=True))
        assert p.where("abs(p_nh + p_nmr + p_h - 1) > 1e-6").isEmpty()


def test_vote_stream(spark, tmp_path):
    from tallyforge.streaming import votes as stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"note_id":"n","agent_id":"a","raw_label_id":2,"confidence":50,"at":"2024-01-01T00:00:00Z"}\n' * 2 + '{"note_id":"n","agent_id":"b","raw_label_id":0,"confidence":70,"at":"2024-01-01T00:00:01Z"}\n')
    q = stream.start_snapshots(stream.running_summary(stream.vote_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    r = stream.read_snapshot(spark, str(tmp_path / "out")).first()
    assert (r.n_votes, r.vote_h, r.vote_nh, r.mean_confidence) == (2, 1, 1, 60.0)


def test_json_search(spark):
    rows = ['{"a": {"text": " "}, "b": [{"text": "x"}], "k": 3}', '{"k": [1, {"z": 2}]}', "bad", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(texts.json_search(F.col("t"), ["text", "z", "k"])).collect()] == ["3", "2", None, None]
    assert [r[0] for r in df.select(texts.json_search(F.col("t"), ["text"])).collect()] == ["x", None, None, None]
    assert [r[0] for r in df.select(texts.json_paths(F.col("t"))).collect()] == [["a", "a.text", "b", "b[].text", "k"], ["k"], [], []]


def test_cluster_quality_of_whole_vectors(spark):
    import numpy as np

    from tests.conftest import DATA

    df = spark.read.parquet(f"{DATA}/embeddings.parquet").select("label", "embedding")
    got = personas.cluster_quality(df, "label", "embedding").first()
    x, y = (np.array(v) for v in zip(*[(r.embedding, r.label) for r in df.collect()]))
    names = np.unique(y)
    centers = np.array([x[y == c].mean(axis=0) for c in names])
    inertia = sum(((x[y == c] - m) ** 2).sum() for c, m in zip(names, centers))
    between = sum((y == c).sum() * ((m - x.mean(axis=0)) ** 2).sum() for c, m in zip(names, centers))
    scatter = np.array([np.sqrt(((x[y == c] - m) ** 2).sum(axis=1)).mean() for c, m in zip(names, centers)])
    apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) + np.diag(np.full(len(names), np.inf))
    worst = ((scatter[:, None] + scatter[None]) / apart).max(axis=1).mean()
    k, n = len(names), len(y)
    assert x.shape[1] == 64 and (got.k, got.n) == (k, n)
    assert np.allclose([got.inertia, got.calinski_harabasz, got.davies_bouldin], [inertia, between / (k - 1) / (inertia / (n - k)), worst])


def test_progress_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "progress.json")
    assert files.read_progress(spark, path) is None
    for i in range(3):
        files.write_progress(spark, path, {"done": i})
    assert files.read_progress(spark, path) == {"done": 2} and [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["progress.json"]


def test_scorer_table(spark, tmp_path):
    names = [x.split()[0] for x in files.SCORER.split(", ")]
    (tmp_path / "out.tsv").write_text("\t".join(names) + "\nr1" + "\t0.5" * 7 + "\ttrue\nr2" + "\t" * 7 + "0.25\t\n")
    got = files.read_scores(spark, str(tmp_path / "out.tsv"))
    kept = personas.rater_features(got, ["meanNoteScore", "raterAgreeRatio"]).collect()
    assert got.count() == 2 and [r.raterParticipantId for r in kept] == ["r1"]


def test_batched_and_limited_requests(spark):
    import time

    sizes = []

    def many(keys):
        assert len(keys) <= 3
        return {k: {"error": "gone"} if k == "2" else {"text": k} for k in keys if k != "5"}

    queue = spark.createDataFrame([(i,) for i in range(8)], "k long").coalesce(1)
    got = {r.key: (r.status, r.error) for r in collect.collect_batches(queue, "k", many, 3).collect()}
    assert got["2"] == ("failed", "gone") and got["5"] == ("failed", "not_returned") and got["7"] == ("success", None) and not sizes

    def one_by_one(row):
        if row["k"] == 6:
            raise collect.Stop("402")
        return {"k": row["k"]}

    began = time.monotonic()
    rows = collect.collect_limited(queue, "k", one_by_one, per_second=20, senders=2).collect()
    assert len(rows) == 8 and time.monotonic() - began > 0.1
    assert {r.key: r.error for r in rows}["6"] == "stopped: 402" and sum(r.status == "success" for r in rows) >= 4


def test_fallback_order_and_replies(spark):
    def first(row):
        raise RuntimeError("first")

    def second(row):
        return {"content": 'ok {"helpfulnessLevel": "not helpful", "agree": "yes", "confidence": 81.5}'}

    log = collect.collect_from(spark.createDataFrame([(1,)], "k long"), "k", [first, second], retries=1)
    assert [r.status for r in log.collect()] == ["success"]
    r = collect.parsed_replies(log).first()
    assert (r.key, r.rating, r.score, r.agree, r.confidence) == ("1", "NOT_HELPFUL", 0.0, 1, 82)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"')], "k long, s string").coalesce(1)
    for form in ("csv", "json", "parquet"):
        files.write_table(df, str(tmp_path / form), form)
    assert sorted(one(files.read_delimited(spark, str(tmp_path / "csv"), "k long, s string", ","))) == [(1, "a,b"), (2, 'q"')]
    for _ in range(2):
        files.append_log(df, str(tmp_path / "log"))
    assert files.read_json_log(spark, str(tmp_path / "log"), "k long, s string").count() == 4
    assert one(spark.createDataFrame([(None, 5)], "a long, b long").select(files.first_present(spark.createDataFrame([(None, 5)], "a long, b long"), ["zz", "a", "b"]))) == [(5,)]


def test_column_helpers(spark):
    assert relational.ordered_union(["b", "a"], ["a", "c"], ["b"]) == ["b", "a", "c"] and relational.ordered_difference(["b", "a", "b", "c"], ["a"]) == ["b", "c"]
    assert [c.target_key(x) for x in (0.65, 0.8, 1.0)] == ["0p65", "0p80", "1p00"]


def test_running_counts_and_medians(spark):
    import random
    import statistics

    r = random.Random(4)
    values = [(r.choice("ab"), round(r.gauss(0, 1), 2) if r.random() > 0.1 else None) for _ in range(3000)]
    df = spark.createDataFrame(values, "g string, x double").repartition(5)
    per = df.where("x IS NOT NULL").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    got = {(q.g, q.x): q.upto_n for q in relational.counts_up_to(per, "x", ["g"]).collect()}
    assert all(got[g, x] == sum(1 for h, y in values if h == g and y is not None and y <= x) for g, x in list(got)[:80])
    med = {q.g: q.x for q in relational.exact_medians(df, ["x"], ["g"]).collect()}
    assert all(med[g] == pytest.approx(statistics.median(y for h, y in values if h == g and y is not None)) for g in "ab")
    assert relational.exact_medians(df.where("g = 'z'"), ["x"]).count() <= 1


def test_hash_places(spark):
    df = spark.range(900).select(F.col("id").alias("k"), (F.col("id") % 4).alias("s"), F.when(F.col("id") % 9 != 0, F.lit("t")).alias("u"))
    got = sampling.hash_places(df, ["s", "u"], "k", 3).collect()
    groups = {}
    for q in got:
        groups.setdefault((q.s, q.u), []).append((q["__k"], (q.k * 2654435761 + 3) % 4294967296, q.k))
    for rows in groups.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)


def test_orthants(spark):
    import random

    from tallyforge.operators import grids

    r = random.Random(2)
    data = [(r.random(), r.random(), r.randrange(3)) for _ in range(400)] + [(None, 0.5, 1)]
    ts, us = [0.1, 0.4, 0.7], [0.9, 0.5]
    df = spark.createDataFrame(data, "a double, b double, y int")
    axes = {"i": grids.passed(F.col("a"), ts, ">="), "j": grids.passed(F.col("b"), us, "<")}
    got = {(q.i, q.j, q.y): q.n for q in grids.orthant_counts(grids.counted_cells(df, axes, ["y"]), {"i": 3, "j": 2}, ["y"]).collect()}
    for (i, j, y), n in got.items():
        assert n == sum(1 for a, b, z in data if z == y and a is not None and a >= ts[i] and b < us[j])
    assert len(got) == 18


def test_many_fits_against_one(spark):
    """A shared-scan fit has the gradient of its own training rows at zero, and predicts what it should."""
    import numpy as np

    from tallyforge.operators import fits

    rng = np.random.default_rng(3)
    y = np.arange(300) % 3
    x = rng.normal(size=(300, 2)) + y[:, None] * [[1.0, 0.5]]
    rows = [(i, int(y[i]), i // 3 % 4, float(x[i, 0]), float(x[i, 1]) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, label int, outer int, a double, b double")
    candidates = [fits.Candidate("one", "v", ("a",), 1.0), fits.Candidate("two", "v", ("a", "b"), 0.3, "balanced")]
    f = fits.fit_candidates(df, "key", "label", "outer", [], candidates, 0, rounds=25)
    for fold in range(4):
        m = f.models[1, fold, -1]
        use = [r for r in rows if r[2] != fold]
        v = np.array([[r[3], r[4] if r[4] is not None else m.fill[1]] for r in use])
        t = np.eye(3)[[r[1] for r in use]]
        z = np.concatenate([(v - v.mean(axis=0)) / v.std(axis=0), np.ones((len(v), 1))], axis=1)
        p = np.exp(z @ m.w)
        p /= p.sum(axis=1, keepdims=True)
        slope = z.T @ (p - t)
        slope[:-1] += m.w[:-1] / 0.3
        assert np.abs(slope).max() < 1e-3
    tables = fits.confusions(f, [("argmax", 0.0, 0.0)], inner=False).sum(axis=0)
    out = fits.predict(f, [[(1, 1.0)]] * 4, [("argmax", 0.0, 0.0)] * 4).collect()
    assert len(out) == 300 and np.trace(tables[1, 0]) == sum(q.pred == y[q.key] for q in out)
    nested_df = df.withColumns({f"in{k}": (F.col("key") % 5 % 2).cast("int") for k in range(4)})
    g = fits.fit_candidates(nested_df, "key", "label", "outer", [f"in{k}" for k in range(4)], candidates, 2)
    best = fits.nested(g, [("argmax", 0.0, 0.0), ("nmr_gate", 0.4, 0.0)])
    assert len(best) == 4 and all(len(p) == 2 for p in fits.pool(g, 2))


def test_many_kmeans_and_silhouette(spark):
    import numpy as np

    from tallyforge.operators import fits

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.2 + c for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    scored, centers = fits.kmeans_many(df, ["a", "b"], [2, 3, 4, 500], starts=5)
    r = {q.k: q for q in scored.collect()}
    assert set(r) == {2, 3, 4} and max(r, key=lambda k: r[k].silhouette) == 3
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    own = ((z[:, None] - centers[3][None]) ** 2).sum(axis=2).argmin(axis=1)
    d2 = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    s = []
    for i in range(len(z)):
        a = d2[i][own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d2[i][own == c].mean() for c in range(3) if c != own[i])
        s.append((b - a) / max(a, b))
    assert r[3].silhouette == pytest.approx(np.mean(s)) and r[3].inertia == pytest.approx(sum(d2[own == c][:, own == c].sum() / (2 * (own == c).sum()) for c in range(3)))
    vectors = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(own, z)], "c int, v array<double>")
    assert personas.silhouette(vectors, "c", "v", 2).first()[0] == pytest.approx(np.mean(s))
    assert models.choose_k(df, ["a", "b"]) == 3
    assert {q.cluster for q in fits.assign_clusters(df, ["a", "b"], centers[3]).collect()} == {0, 1, 2}


def test_l1(spark):
    df = spark.range(240).select("id", (F.col("id") % 3).cast("double").alias("label")).withColumn("x", F.col("label") * 2 + F.rand(1)).withColumn("z", F.rand(3))
    p = models.fit_predict(df.where("id < 150"), df.where("id >= 150"), ["x", "z"], "label", models.Spec(c=0.05, l1=True))
    assert p.where("abs(p_nh + p_nmr + p_h - 1) > 1e-6").isEmpty()


def test_stored_tables_need_a_shared_folder():
    """A session of several machines without a folder is refused."""
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", applicationId="test"))
    with pytest.raises(ValueError, match="checkpoint"):
        relational.stable(SimpleNamespace(sparkSession=session))


def test_resamples_cover_the_truth(spark):
    """Weights are Poisson and independent between rounds, and 95 % intervals hold the true accuracy about that often."""
    import numpy as np

    df = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    w = sampling.resampled(df, "key", 10, 4).groupBy("key").pivot("round", list(range(10))).agg(F.first("weight")).toPandas().set_index("key").fillna(0).to_numpy()
    w = np.concatenate([w, np.zeros((3000 - len(w), 10))])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06
    assert np.abs(np.corrcoef(w.T) - np.eye(10)).max() < 0.08
    sims, n, p_true = 120, 150, 0.7
    rng = np.random.default_rng(1)
    rows = [(s, f"{s}-{i}", 0, int(rng.random() > p_true), 0.5) for s in range(sims) for i in range(n)]
    drawn = sampling.resampled(spark.createDataFrame(rows, "sim int, key string, y int, pred int, h double"), "key", 200, 7)
    found = drawn.groupBy("sim", "round").agg(*sampling.accuracy_statistics(F.col("y"), F.col("pred"), F.col("h"), 0.2, 0.8, F.col("weight")))
    got = sampling.intervals(found, ["accuracy", "balanced_accuracy", "selective_coverage"], ["sim"]).collect()
    accuracy = [r for r in got if r.metric == "accuracy"]
    assert len(accuracy) == sims and 0.88 <= np.mean([r.low <= p_true <= r.high for r in accuracy]) <= 0.99
    width = np.mean([r.high - r.low for r in accuracy])
    assert width == pytest.approx(2 * 1.96 * np.sqrt(p_true * (1 - p_true) / n), rel=0.1)
    assert all(r.mean == r.low == r.high == 0 for r in got if r.metric == "selective_coverage")
