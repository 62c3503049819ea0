"""Model queries: rows only, as fits are not expressible in SQL."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.operators import ablation, clusters, fits, models, sampling, search, trees
from tallyforge.operators import personas as persona_ops
from tallyforge.operators import texts as text_ops
from tallyforge.operators import votes as vote_ops
from tallyforge.operators.relational import stable
from tallyforge.plans import views as v
from tallyforge.plans.grids import GATE, best_gates
from tallyforge.plans.personas import raters
from tallyforge.plans.declare import query
from tallyforge.plans.votes import rich, rich_aggregates, rounded

GROUPS = {
    "vote": ["share_nh", "share_sh", "share_h", "vote_entropy", "h_nh_margin"],
    "confidence": ["mean_confidence", "std_confidence"],
    "understanding": ["mean_understanding", "std_understanding"],
    "reasons": ["helpful_reason_any_rate", "not_helpful_reason_any_rate", "helpful_clear_rate", "not_helpful_incorrect_rate"],
}
ALL = [x for g in GROUPS.values() for x in g]
OUTER, INNER = 5, 4
# Inverse penalties and class weights that are tried.
CS = (0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
WEIGHTS = (None, "balanced", (1.0, 1.15, 1.0))


def labelled(spark, d):
    truth = v.notes(spark, d).select("note_id", "note_key", F.col("true_label_3way").alias("label"))
    return rich(spark, d).join(truth, "note_id")


def folded(df, outer: int = OUTER, inner: int = INNER):
    """Stratified outer folds, and for each of them inner folds of the rows that it leaves for training.

    Folds are dealt on a narrow table of stored row numbers, so a table is not shuffled whole for each of them.
    """
    rows = stable(df.withColumn("__row", F.monotonically_increasing_id()))
    out = stable(sampling.folds(rows.select("__row", "label", "note_key"), "label", "note_key", outer, 13).withColumnRenamed("fold", "outer"))
    for f in range(outer if inner else 0):
        # rows of the outer fold itself are a stratum of their own and never used
        part = out.withColumn("__stratum", F.when(F.col("outer") == f, -1).otherwise(F.col("label")))
        out = stable(sampling.folds(part, "__stratum", "note_key", inner, 29 + f).withColumnRenamed("fold", f"inner{f}").drop("__stratum"))
    return rows.join(out.drop("label", "note_key"), "__row").drop("__row")


def fitted(df, candidates, inner: int = INNER, also=(), **more):
    names = [f"inner{f}" for f in range(OUTER)] if inner else []
    used = dict.fromkeys([*(x for c in candidates for x in c.features), *also])
    return fits.fit_candidates(folded(df.select("note_id", "note_key", "label", *used), OUTER, inner), "note_id", "label", "outer", names, candidates, inner, also=also, **more)


def _named(view, names, cs, weights):
    return [fits.Candidate(f"{view}_c{c_}_{w if not isinstance(w, tuple) else 'alt'}", view, tuple(names), c_, w) for c_, w in product(cs, weights)]


@query()
def nested_cv_lr(spark, d):
    """5 x 4 folds: penalty, weighting and decision rule are chosen inside each outer training part."""
    candidates = _named("vote", [*GROUPS["vote"], *GROUPS["confidence"]], CS, WEIGHTS[:2])
    f, rules = fitted(labelled(spark, d), candidates), models.rule_grid()
    best = fits.nested(f, rules)
    out = fits.predict(f, [[(k, 1.0)] for k, _ in best], [rules[r] for _, r in best])
    name = F.element_at(F.array(*[F.lit(f"{candidates[k].name}:{rules[r][0]}") for k, r in best]), F.col("outer") + 1)
    return out.select(F.col("key").alias("note_id"), F.col("outer").alias("outer_fold"), *rounded(models.PROBS), "pred", name.alias("rule"))


VIEWS = {"vote": GROUPS["vote"], "summary": [*GROUPS["vote"], *GROUPS["confidence"], *GROUPS["understanding"]], "full": ALL}
FOURIER = 24


def _pool():
    """Candidates of every view, a Gaussian kernel's among them."""
    return [*(x for name, names in VIEWS.items() for x in _named(name, names, (0.3, 3.0), WEIGHTS[1:])), *(replace(x, fourier=FOURIER) for x in _named("rbf", ALL, (0.3, 3.0), WEIGHTS[1:]))]


@query()
def candidate_pool(spark, d):
    """Per outer fold the two best candidates of each view by inner quality, and their weights in the blend."""
    candidates = _pool()
    chosen = fits.pool(fitted(labelled(spark, d), candidates), 2)
    rows = [(i, candidates[k].view, candidates[k].name, rank, round(w, 6)) for i, part in enumerate(chosen) for k, w, rank in part]
    return spark.createDataFrame(rows, "outer_fold int, view string, candidate string, rank int, weight double")


@query()
def prob_blend(spark, d):
    """Each row under the blend of its fold's pool, weighted by inner quality."""
    f = fitted(labelled(spark, d), _pool())
    chosen = fits.pool(f, 2)
    out = fits.predict(f, [[(k, w) for k, w, _ in part] for part in chosen], [("argmax", 0.0, 0.0)] * OUTER)
    return out.select(F.col("key").alias("note_id"), F.col("outer").alias("outer_fold"), *rounded(models.PROBS), "pred")


@query()
def flat_candidates(spark, d):
    """All fixed candidates (view x penalty x weighting) under all rules on left-out rows, best 20 first."""
    candidates = [*(x for name, names in VIEWS.items() for x in _named(name, names, CS, WEIGHTS)), *(replace(x, fourier=FOURIER) for x in _named("rbf", ALL, CS, WEIGHTS))]
    rules = models.rule_grid()
    tables = fits.confusions(fitted(labelled(spark, d), candidates, 0), rules, inner=False).sum(axis=0)
    ranked = sorted(((fits.quality(tables[k, r]), -k, -r) for k in range(len(candidates)) for r in range(len(rules))), reverse=True)[:20]
    rows = [(i + 1, candidates[-k].name, rules[-r][0], rules[-r][1], rules[-r][2], q[1], q[0], int(-q[2])) for i, (q, k, r) in enumerate(ranked)]
    return spark.createDataFrame(rows, "rank int, candidate string, rule string, a double, b double, accuracy double, balanced_accuracy double, cross_error int")


@query()
def ablation_run(spark, d):
    """Single groups, base plus each, cumulative and leave-one-out feature lists, on left-out rows of five folds."""
    plans = models.experiments(GROUPS, "vote")
    candidates = [fits.Candidate(e.name, e.name, e.features) for e in plans]
    tables = fits.confusions(fitted(labelled(spark, d), candidates, 0), [("argmax", 0.0, 0.0)], inner=False).sum(axis=0)
    rows = [(e.name, len(e.features), *(fits.quality(tables[k, 0])[i] for i in (1, 0)), int(-fits.quality(tables[k, 0])[2])) for k, e in enumerate(plans)]
    return spark.createDataFrame(rows, "experiment string, n_features int, accuracy double, balanced_accuracy double, cross_error int").select("experiment", "n_features", *rounded(["accuracy", "balanced_accuracy"]), "cross_error")


@query()
def kmeans_search(spark, d):
    names = ["mean_score", "mean_confidence", "mean_understanding"]
    ready = persona_ops.rater_features(raters(spark, d), names)
    return fits.kmeans_many(ready, names, range(2, 33))[0].select("k", *rounded(["inertia", "silhouette", "calinski_harabasz", "davies_bouldin"]))


@query()
def minibatch_search(spark, d):
    """Mini-batch k-means of raters for 2 to 32 clusters, with the Euclidean silhouette of a sample of 10,000."""
    names = ["mean_score", "mean_confidence", "mean_understanding"]
    out = clusters.search_k(persona_ops.rater_features(raters(spark, d), names), names, "rater_id", range(2, 33), at_once=31)
    return out.select("k", "n_rows", "sample_size", *rounded(["inertia", "silhouette", "calinski_harabasz", "davies_bouldin"]))


@query()
def best_k(spark, d):
    """The cluster count with the best silhouette, then the best variance ratio."""
    scored = kmeans_search(spark, d)
    return scored.agg(F.max_by(F.struct("k", "silhouette", "calinski_harabasz"), F.struct("silhouette", "calinski_harabasz", (-F.col("k")).alias("o"))).alias("b")).select("b.*")


REASONS = [f"{r}_rate" for r in (*v.HELPFUL, *v.NOT_HELPFUL)]
COUNTS = ["n_votes", "vote_h", "vote_sh", "vote_nh"]


TERMS = 80


def reasons_and_texts(spark, d):
    """Notes with their reasons, votes and the id of their text; texts as (__doc, weights v of the ``TERMS`` most frequent words); (doc_id, term, weight); these words.

    A note's text is the document whose id is its key modulo the number of documents.  Many notes have
    one text, so its weights are not copied to them.
    """
    texts = v.texts(spark, d).select("doc_id", "text")
    n = texts.agg(F.max("doc_id").alias("n")).first()["n"]
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    weights = stable(text_ops.tfidf(texts, "doc_id", words, features=TERMS))
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]
    wide = weights.groupBy("doc_id").pivot("term", terms).agg(F.max("weight"))
    wide = stable(wide.select(F.col("doc_id").alias("__doc"), F.array(*[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in terms]).cast("array<double>").alias("v")))
    notes = labelled(spark, d).withColumn("__doc", F.col("note_key") % ((n if n is not None else 0) + 1))
    notes = notes.fillna(0.0).select("note_id", "label", "__doc", *REASONS, *COUNTS, (F.col("share_h") > F.col("share_nh")).alias("helpful"))
    return stable(notes), wide, weights, terms


@query()
def reason_clusters(spark, d):
    """Per class: clusters of notes by reasons, votes and words of their texts, with sizes, leading reasons, words by side, and examples.

    Words of the helpful side are the heaviest on average among a cluster's notes with more
    helpful than not helpful votes, those of the other side among the rest.  Five examples of every cluster,
    however small, are its notes with the smallest hashes.
    """
    df, texts, weights, terms = reasons_and_texts(spark, d)
    wide = {"shared": texts, "width": len(terms), "on": "__doc"} if terms else {}
    placed = clusters.clustered(df, [*REASONS, *COUNTS], "note_id", range(2, 9), group="label", **wide)
    # notes of one cluster, side and text are alike in their words, so these are weighed by the notes' number
    cells = stable(placed.groupBy("label", "cluster", "helpful", "__doc").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in [*COUNTS, *REASONS]]))
    by, size = ["label", "cluster"], F.sum("n")
    summary = cells.groupBy(*by).agg(size.alias("n"), *[F.round(F.sum(x) / size, 6).alias(f"mean_{x}") for x in COUNTS], *[(F.sum(x) / size).alias(x) for x in REASONS])
    side = F.when(F.col("helpful"), "h").otherwise("n")
    sides = cells.groupBy(*by, "helpful").agg(size.alias("rows"))
    sums = cells.join(weights, F.col("__doc") == F.col("doc_id")).groupBy(*by, "helpful", "term").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    columns = [f"{x}w_{t}" for x in "hn" for t in terms]
    means = sums.join(sides, [*by, "helpful"]).select(*by, F.concat(side, F.lit("w_"), "term").alias("c"), (F.col("s") / F.col("rows")).alias("m"))
    words = means.groupBy(*by).pivot("c", columns).agg(F.max("m"))
    first = Window.partitionBy(*by).orderBy(F.xxhash64("note_id"), "note_id")
    five = placed.select(*by, "note_id", F.row_number().over(first).alias("at")).where("at <= 5")
    examples = five.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note_id"))), lambda x: x["note_id"]), ";").alias("examples"))
    summary = summary.join(examples, by).join(words, by, "left").fillna(0.0, columns)
    top = lambda x: F.regexp_replace(text_ops.top_terms([f"{x}w_{t}" for t in terms], 5), rf"(^|;){x}w_", "$1")
    label = F.when(F.col("label") == 2, "HELPFUL").when(F.col("label") == 1, "NEEDS_MORE_RATINGS").otherwise("NOT_HELPFUL")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("label"))
    return summary.select(label.alias("label"), "cluster", "n", F.round(share, 6).alias("share"), *[f"mean_{x}" for x in COUNTS], text_ops.top_terms(REASONS, 5).alias("top_reasons"), top("h").alias("helpful_terms"), top("n").alias("not_helpful_terms"), "examples")


@query()
def nested_variants(spark, d):
    """Nested selection inside each view, and the trivial rules, on the rows that outer folds leave out."""
    candidates, rules = _pool(), models.rule_grid()
    f = fitted(labelled(spark, d), candidates)
    inside, outside = fits.confusions(f, rules, inner=True), fits.confusions(f, rules, inner=False)
    rows = []
    for view in dict.fromkeys(c.view for c in candidates):
        own = [(k, r) for k, x in enumerate(candidates) if x.view == view for r in range(len(rules))]
        best = [max(own, key=lambda x, i=i: (*fits.quality(inside[i][x]), -x[0], -x[1])) for i in range(OUTER)]
        rows.append((view, sum(outside[i][x] for i, x in enumerate(best))))
    truth = outside[:, 0, 0].sum(axis=0).sum(axis=1)
    always = [[0.0] * 3 for _ in range(3)]
    for k in range(3):
        always[k][1] = float(truth[k])
    rows.append(("always_undecided", np.array(always)))
    scored = [(name, *(fits.quality(t)[i] for i in (1, 0)), int(-fits.quality(t)[2])) for name, t in rows]
    return spark.createDataFrame(scored, "method string, accuracy double, balanced_accuracy double, cross_error int").select("method", *rounded(["accuracy", "balanced_accuracy"]), "cross_error")


# Specifications of the two heads (view, inverse penalty, class weights) and of the base model.
HEADS = [("summary", 0.3, "balanced"), ("summary", 1.0, "balanced"), ("full", 0.3, "balanced"), ("full", 1.0, "balanced"), ("full", 0.3, (1.0, 1.2))]
BASE = (0.3, "balanced")


def rescue(df, views):
    """Rows (with outer and inner folds) under the base model and the gate that inner left-out rows choose.

    Within each outer training part both heads are the specifications with the best inner balanced
    accuracy, and the gate is the grid point that is best on its inner left-out rows; the rows of
    the outer fold take no part.  Both heads score all left-out rows, undecided ones too, so a
    gate sees its false rescues.
    """
    base = fits.Candidate("base", "full", tuple(views["full"]), *BASE)
    head = lambda kind, target: [fits.Candidate(f"{kind}_{v_}_c{c_}", v_, tuple(views[v_]), c_, w, target=target) for v_, c_, w in HEADS]
    resolved, direction = head("resolved", (1, 0, 1)), head("direction", search.HELPFUL)
    f = fits.fit_candidates(df, "note_id", "label", "outer", [f"inner{i}" for i in range(OUTER)], [base, *resolved, *direction], INNER)
    n = len(HEADS)

    def count(y, p):
        """Confusions of every head at one half, over the labels that it is about."""
        out = np.zeros((2 * n, 2, 2))
        for k, scored in p.items():
            t = np.array(f_candidates[k].target)[y]
            use = t >= 0
            out[k - 1] += np.bincount(2 * t[use] + (scored[use, 1] >= 0.5), minlength=4).reshape(2, 2)
        return out

    f_candidates = f.candidates
    tables = fits.counted_left_out(f, range(1, 2 * n + 1), True, (2 * n, 2, 2), count)
    balanced = (np.diagonal(tables, axis1=2, axis2=3) / np.maximum(tables.sum(axis=3), 1)).mean(axis=2).round(9)
    chosen = [(0, 1 + int(b[:n].argmax()), 1 + n + int(b[n:].argmax())) for b in balanced]

    def scored(inner):
        r9 = lambda x: F.round(x, 9)
        nh, nmr, h = (F.element_at(F.col("p")[0], i) for i in (1, 2, 3))
        resolved, direction = F.element_at(F.col("p")[1], 2), F.element_at(F.col("p")[2], 2)
        rows = fits.left_out(f, chosen, inner)
        return rows.select("key", "fold", F.col("label").alias("y"), c.argmax3(nh, nmr, h).alias("pred"), r9(resolved).alias("resolved"), r9(resolved - nmr).alias("gap"), r9(direction).alias("direction"))

    gates = best_gates(stable(scored(True)), GATE, "fold")
    sure = F.round(F.greatest(F.col("direction"), 1 - F.col("direction")), 9)
    opened = (F.col("pred") == 1) & (F.col("resolved") >= F.col("t_resolved")) & (F.col("gap") >= F.col("t_gap")) & (sure >= F.col("t_conf"))
    rescued = F.when(opened, F.when(F.col("direction") >= 0.5, 2).otherwise(0)).otherwise(F.col("pred"))
    heads = F.element_at(F.array(*[F.lit(f"{f.candidates[a].name}:{f.candidates[b].name}") for _, a, b in chosen]), F.col("fold") + 1)
    return scored(False).join(F.broadcast(gates), "fold").select(F.col("key").alias("note_id"), F.col("fold").alias("outer_fold"), heads.alias("heads"), "t_resolved", "t_gap", "t_conf", "resolved", "direction", F.col("pred").alias("base"), rescued.alias("pred"))


@query()
def two_head_rescue(spark, d):
    """A resolved head and a direction head over a base model; heads and gate are chosen inside each outer training part."""
    out = rescue(folded(labelled(spark, d)), VIEWS)
    return out.select("note_id", "outer_fold", "heads", "t_resolved", "t_gap", "t_conf", *rounded(["resolved", "direction"]), "base", "pred")


# The candidates of the search.
LINEAR_CS, SVC_CS, STAGE_CS = (0.03, 0.1, 0.3, 1.0, 3.0), (0.3, 1.0, 3.0), (0.03, 0.1, 0.3, 1.0)
UNDECIDED_AT, HELPFUL_AT = (0.25, 0.33, 0.40, 0.48), (0.40, 0.50, 0.60)
MARGINS, ENTROPIES, CUTS = (0.0, 0.125, 0.25, 0.375), (0.55, 0.62, 0.68), (0.5, 0.56, 0.62)
DEPTHS, LEAVES = (2, 3, 6), (3, 6)
SEARCH_VIEWS = {"vote": GROUPS["vote"], "compact": [*GROUPS["vote"], *GROUPS["confidence"]], "full": ALL, "vote_reasons": [*GROUPS["vote"], *GROUPS["reasons"]]}
TREE_VIEWS = ("compact", "full")
SVC_WAVES = 48


def all_kinds(df, at_once=4):
    """(name, kind, confusion table on left-out rows) of every candidate; ``df`` has the outer fold."""
    views = {k: tuple(x) for k, x in SEARCH_VIEWS.items()}
    linear = [fits.Candidate(f"lr_{name}_c{c_}_{w or 'none'}", name, x, c_, w) for name, x in views.items() for c_, w in product(LINEAR_CS, (None, "balanced"))]
    svc = [fits.Candidate(f"svc_{name}_c{c_}", name, x, c_, "balanced", "svc", fourier=SVC_WAVES) for name, x in views.items() for c_ in SVC_CS]
    stages = [fits.Candidate(f"{kind}_{name}_c{c_}", name, x, c_, "balanced", target=target) for name, x in views.items() for kind, target in (("nmr", search.UNDECIDED), ("h", search.HELPFUL)) for c_ in STAGE_CS]
    f = fits.fit_candidates(df, "note_id", "label", "outer", [], [*linear, *svc, *stages], 0)
    direct = fits.confusions(f, [("argmax", 0.0, 0.0)], False, range(len(linear) + len(svc))).sum(axis=0)[:, 0]
    found = [(x.name, "lr" if i < len(linear) else "svc", t) for i, (x, t) in enumerate(zip([*linear, *svc], direct, strict=True))]

    at = {x.name: len(linear) + len(svc) + i for i, x in enumerate(stages)}
    pairs = [(name, a, b) for name in views for a in STAGE_CS for b in STAGE_CS]
    tables = search.two_stage_confusions(f, [(at[f"nmr_{name}_c{a}"], at[f"h_{name}_c{b}"]) for name, a, b in pairs], UNDECIDED_AT, HELPFUL_AT).sum(axis=0)
    found += [(f"two_stage_{name}_cn{a}_ch{b}_tn{tn}_th{th}", "two_stage", tables[i, j, k]) for i, (name, a, b) in enumerate(pairs) for j, tn in enumerate(UNDECIDED_AT) for k, th in enumerate(HELPFUL_AT)]

    grid = [(name, depth, leaf) for name in TREE_VIEWS for depth in DEPTHS for leaf in LEAVES]
    extra = [trees.Forest(f"extra_{name}_d{depth}_l{leaf}", views[name], depth, leaf) for name, depth, leaf in grid]
    forests = [trees.Forest(f"rf_{name}_d{depth}_l{leaf}", views[name], depth, leaf) for name, depth, leaf in grid]
    grown = [*trees.grow(f, extra), *(replace(t, forest=len(extra) + t.forest) for t in trees.grow_bagged(f, forests))]
    tables = trees.confusions(f, [*extra, *forests], grown).sum(axis=0)
    found += [(x.name, x.name.split("_")[0], t) for x, t in zip([*extra, *forests], tables, strict=True)]
    boosted = [search.Ensemble("gbt_full_d2", views["full"], "gbt", 2, 3, 6)]
    tables = search.ensemble_confusions(f, boosted, at_once).sum(axis=0)
    found += [(x.name, x.kind, t) for x, t in zip(boosted, tables, strict=True)]

    tables = search.disagreement_confusions(df, "label", F.col("share_h"), F.col("h_nh_margin"), c.entropy([F.col("share_h"), 1 - F.col("share_h")], 1e-6), MARGINS, ENTROPIES, CUTS)
    found += [(f"rule_m{m}_e{e}_h{h}", "rule", tables[i, j, k]) for i, m in enumerate(MARGINS) for j, e in enumerate(ENTROPIES) for k, h in enumerate(CUTS)]
    return found


@query()
def candidate_search(spark, d):
    """Linear, support vector, two-stage, tree, boosted and rule candidates on the same five folds, best first."""
    scored = [{"method": name, "kind": kind, **search.scores(t)} for name, kind, t in all_kinds(folded(labelled(spark, d), OUTER, 0))]
    scored.sort(key=lambda r: (-r["balanced_accuracy"], -r["accuracy"], r["method"]))
    form = "rank int, method string, kind string, accuracy double, balanced_accuracy double, resolved_coverage double, recall_not_helpful double, recall_needs_more_ratings double, recall_helpful double, cross_error int"
    out = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(scored, start=1)], form)
    return out.select("rank", "method", "kind", *rounded(["accuracy", "balanced_accuracy", "resolved_coverage", "recall_not_helpful", "recall_needs_more_ratings", "recall_helpful"]), "cross_error")


@query()
def svc_probabilities(spark, d):
    """Squared-hinge classifier of a Gaussian kernel's random features, with sigmoids over its margins, on left-out rows."""
    f = fitted(labelled(spark, d), [fits.Candidate("svc", "full", tuple(ALL), 1.0, "balanced", "svc", fourier=SVC_WAVES)], 0)
    out = fits.predict(f, [[(0, 1.0)]] * OUTER, [("argmax", 0.0, 0.0)] * OUTER)
    return out.select(F.col("key").alias("note_id"), F.col("outer").alias("outer_fold"), *rounded(models.PROBS), "pred")


@query()
def l1_weights(spark, d):
    """Regressions with absolute penalties: weights that are not zero, and quality on left-out rows, by inverse penalty and fold."""
    cs = (0.003, 0.01, 0.03, 0.1, 1.0)
    f = fitted(labelled(spark, d), [fits.Candidate(f"l1_c{x}", "full", tuple(ALL), x, "balanced", "l1") for x in cs], 0, rounds=30)
    tables = fits.confusions(f, [("argmax", 0.0, 0.0)], inner=False)
    rows = []
    for k, x in enumerate(cs):
        for fold in range(f.folds):
            w = f.models[k, fold, -1].w[:-1]
            q = fits.quality(tables[fold, k, 0])
            rows.append((x, fold, int((w != 0).sum()), int(w.size), int((w != 0).any(axis=1).sum()), round(q[1], 6), round(q[0], 6)))
    return spark.createDataFrame(rows, "c double, outer_fold int, n_weights int, n_all int, n_features int, accuracy double, balanced_accuracy double")


@query()
def extra_trees(spark, d):
    """Extremely randomised trees on left-out rows."""
    forest = trees.Forest("extra", tuple(ALL), 6, 3)
    f = fitted(labelled(spark, d), [], 0, also=ALL)
    out = trees.predict(f, forest, trees.grow(f, [forest]))
    return out.select(F.col("key").alias("note_id"), F.col("outer").alias("outer_fold"), *rounded(models.PROBS), "pred")


TARGETS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
BUDGETS = (12, 24, 36, 48)
COMBOS = [
    *(("single_addition" if e.name.startswith(("only_", "vote+")) else "cumulative" if e.name.startswith("first_") else "leave_one_group_out", e.name, e.features) for e in models.experiments(GROUPS, "vote")),
    ("targeted_combo", "vote+confidence+reasons", (*GROUPS["vote"], *GROUPS["confidence"], *GROUPS["reasons"])),
    ("targeted_combo", "vote+understanding+reasons", (*GROUPS["vote"], *GROUPS["understanding"], *GROUPS["reasons"])),
]


def budget_features(spark, d):
    """A row per decided note: the vote features of its first 12 to 48 agents, as columns of their own."""
    each = F.explode(F.filter(F.array(*map(F.lit, BUDGETS)), lambda b: F.col("rater_id") % 60 < b))
    few = v.votes(spark, d).withColumn("budget", each).withColumn("note_id", F.concat_ws("@", "note_id", "budget"))
    cleaned = vote_ops.with_cleaned(few, [*v.HELPFUL, *v.NOT_HELPFUL])
    long = vote_ops.vote_features(cleaned, extra=rich_aggregates()).withColumn("budget", F.substring_index("note_id", "@", -1).cast("int")).withColumn("note_id", F.substring_index("note_id", "@", 1))
    cells = [F.max(F.when(F.col("budget") == b, F.col(x))).alias(f"{x}_{b}") for b in BUDGETS for x in ALL]
    truth = v.notes(spark, d).select("note_id", "note_key", F.col("true_label_3way").alias("label")).where("label <> 1")
    return truth.join(long.groupBy("note_id").agg(*cells), "note_id")


@query()
def ablation_combos(spark, d):
    """Combination x budget x coverage target on left-out rows, with intervals, the change from votes alone, and the best of each budget and target."""
    plans = [(family, name, x, b) for b in BUDGETS for family, name, x in COMBOS]
    candidates = [fits.Candidate(f"{name}@{b}", name, tuple(f"{y}_{b}" for y in x), 1.0, "balanced", target=search.HELPFUL) for _, name, x, b in plans]
    f = fitted(budget_features(spark, d), candidates, 2)
    rows = []
    for i, s in enumerate(ablation.selective(f, range(len(candidates)), TARGETS)):
        family, name, x, b = plans[s.candidate]
        rows.append((b, s.target, family, name, len(x), *(round(float(z), 6) for z in (s.coverage, s.accuracy, *s.intervals(2000, i)))))
    form = "agent_count int, coverage_target double, family string, method string, n_features int, coverage double, accuracy double, accuracy_low double, accuracy_high double, coverage_low double, coverage_high double"
    out = models.deltas(spark.createDataFrame(rows, form).withColumn("__group", F.concat_ws(":", "agent_count", "coverage_target")), "__group", "method", "accuracy", ["only_vote"])
    best = F.row_number().over(Window.partitionBy("agent_count", "coverage_target").orderBy(F.desc("accuracy"), F.desc("coverage"), "method")) == 1
    return out.withColumn("best", best).withColumn("delta_only_vote", F.round("delta_only_vote", 6)).drop("__group")
