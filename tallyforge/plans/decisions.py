"""Decision rule, metric and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.operators import grids
from tallyforge.operators import metrics as m
from tallyforge.operators import relational as rel
from tallyforge.operators import votes as vote_ops
from tallyforge.plans import views as v
from tallyforge.plans.declare import query
from tallyforge.plans.votes import FEATURES, RICH, features, rich

_SIDE = "CASE WHEN share_h >= share_nh THEN 2 ELSE 0 END"
_ARGMAX = "CASE WHEN share_nh >= share_sh AND share_nh >= share_h THEN 0 WHEN share_sh >= share_h THEN 1 ELSE 2 END"
_JUDGED = f"{FEATURES}, judged AS (SELECT f.*, n.true_label_3way, n.current_status, {_ARGMAX} AS pred FROM features f JOIN notes n ON f.note_id = n.note_id)"


def judged(spark, d):
    truth = v.notes(spark, d).select("note_id", "true_label_3way", "current_status")
    return features(spark, d).join(truth, "note_id").withColumn("pred", c.argmax3(F.col("share_nh"), F.col("share_sh"), F.col("share_h")))


@query(f"WITH {FEATURES} SELECT note_id, CASE WHEN share_h >= 0.5 THEN 2 ELSE 0 END AS majority, {_ARGMAX} AS vote_argmax FROM features")
def rule_majority(spark, d):
    return features(spark, d).select("note_id", c.majority(F.col("share_h")).alias("majority"), c.argmax3(F.col("share_nh"), F.col("share_sh"), F.col("share_h")).alias("vote_argmax"))


@query(f"WITH {FEATURES} SELECT note_id, CASE WHEN mean_score >= 2.0 / 3 THEN 2 WHEN mean_score <= 1.0 / 3 THEN 0 ELSE 1 END AS score_rule, 1 AS always_nmr FROM (SELECT note_id, round(mean_score, 9) AS mean_score FROM features)")
def rule_score(spark, d):
    return features(spark, d).select("note_id", c.score_thirds(F.round("mean_score", 9)).alias("score_rule"), F.lit(1).alias("always_nmr"))


@query(f"WITH {FEATURES} SELECT note_id, CASE WHEN h_nh_margin <= 0.125 OR vote_entropy >= 1.0 OR mean_confidence <= 30 OR mean_understanding <= 25 THEN 1 WHEN share_h >= 0.5 THEN 2 ELSE 0 END AS pred FROM (SELECT note_id, share_h, round(h_nh_margin, 9) AS h_nh_margin, round(vote_entropy, 9) AS vote_entropy, mean_confidence, mean_understanding FROM features)")
def rule_disagreement(spark, d):
    pred = c.disagreement(c.majority(F.col("share_h")), F.round("h_nh_margin", 9), F.round("vote_entropy", 9), F.col("mean_confidence"), F.col("mean_understanding"), 0.125, 1.0, 30, 25)
    return features(spark, d).select("note_id", pred.alias("pred"))


@query(f"""WITH {FEATURES}, {RICH}, s AS (SELECT f.note_id, share_sh, vote_entropy, share_h + 0.4 * (0.35 * helpful_clear_rate + 0.35 * helpful_addresses_claim_rate + 0.20 * helpful_good_sources_rate + 0.001 * mean_understanding) AS h,
  share_nh + 0.4 * (0.30 * not_helpful_missing_key_points_rate + 0.30 * not_helpful_incorrect_rate + 0.001 * (100 - mean_understanding)) AS nh FROM features f JOIN rich r ON f.note_id = r.note_id)
SELECT note_id, CASE WHEN round(abs(h - nh), 9) < 0.12 OR (round(share_sh, 9) >= 0.36 AND vote_entropy > 0.8) THEN 1 WHEN round(h, 9) >= round(nh, 9) THEN 2 ELSE 0 END AS pred FROM s""")
def rule_reason(spark, d):
    g = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    under = F.coalesce("mean_understanding", F.lit(50.0))
    h = F.col("share_h") + 0.4 * (0.35 * g("helpful_clear_rate") + 0.35 * g("helpful_addresses_claim_rate") + 0.20 * g("helpful_good_sources_rate") + 0.001 * under)
    nh = F.col("share_nh") + 0.4 * (0.30 * g("not_helpful_missing_key_points_rate") + 0.30 * g("not_helpful_incorrect_rate") + 0.001 * (100 - under))
    doubt = (F.round(F.abs(h - nh), 9) < 0.12) | ((F.round(F.col("share_sh"), 9) >= 0.36) & (F.col("vote_entropy") > 0.8))
    return rich(spark, d).select("note_id", F.when(doubt, 1).otherwise(c.resolved_side(F.round(nh, 9), F.round(h, 9))).alias("pred"))


@query(f"""WITH {FEATURES}, p AS (SELECT note_id, round(share_nh, 9) AS share_nh, round(share_sh, 9) AS share_sh, round(share_h, 9) AS share_h FROM features), q AS (SELECT *, {_ARGMAX} AS am, {_SIDE} AS side, greatest(share_nh, share_sh, share_h) AS top,
  share_nh + share_sh + share_h - greatest(share_nh, share_sh, share_h) - least(share_nh, share_sh, share_h) AS second FROM p)
SELECT note_id, am AS argmax, CASE WHEN share_sh >= 0.4 THEN 1 ELSE side END AS nmr_gate, CASE WHEN round(abs(share_h - share_nh), 9) < 0.2 AND share_sh >= 0.25 THEN 1 ELSE side END AS margin_to_nmr,
  CASE WHEN round(greatest(share_h, share_nh) - share_sh, 9) < 0.1 THEN 1 ELSE side END AS resolved_gap, CASE WHEN share_sh >= 0.4 THEN 1 WHEN share_h >= 0.5 THEN 2 ELSE 0 END AS two_stage,
  CASE WHEN am <> 1 AND share_sh >= 0.3 AND greatest(share_nh, share_h) <= 0.5 AND round(top - second, 9) <= 0.2 THEN 1 ELSE am END AS guarded,
  CASE WHEN share_h >= 0.4 THEN 2 WHEN share_nh >= 0.45 THEN 0 ELSE 1 END AS helpful_first, CASE WHEN share_nh >= 0.45 THEN 0 WHEN share_h >= 0.4 THEN 2 ELSE 1 END AS not_helpful_first FROM q""")
def decision_rules(spark, d):
    p = features(spark, d).select("note_id", *[F.round(x, 9).alias(x) for x in ("share_nh", "share_sh", "share_h")])
    r9 = lambda x: F.round(x, 9)
    am = c.argmax3(F.col("share_nh"), F.col("share_sh"), F.col("share_h"))
    tops = F.sort_array(F.array(F.col("share_nh"), F.col("share_sh"), F.col("share_h")), False)
    guarded = F.when((am != 1) & (F.col("share_sh") >= 0.3) & (F.greatest(F.col("share_nh"), F.col("share_h")) <= 0.5) & (r9(tops[0] - tops[1]) <= 0.2), 1).otherwise(am)
    return p.select(
        "note_id",
        am.alias("argmax"),
        c.nmr_gate(F.col("share_nh"), F.col("share_sh"), F.col("share_h"), 0.4).alias("nmr_gate"),
        F.when((r9(F.abs(F.col("share_h") - F.col("share_nh"))) < 0.2) & (F.col("share_sh") >= 0.25), 1).otherwise(c.resolved_side(F.col("share_nh"), F.col("share_h"))).alias("margin_to_nmr"),
        F.when(r9(F.greatest(F.col("share_h"), F.col("share_nh")) - F.col("share_sh")) < 0.1, 1).otherwise(c.resolved_side(F.col("share_nh"), F.col("share_h"))).alias("resolved_gap"),
        c.two_stage(F.col("share_sh"), F.col("share_h"), 0.4, 0.5).alias("two_stage"),
        guarded.alias("guarded"),
        c.ordered_thresholds(F.col("share_nh"), F.col("share_sh"), F.col("share_h"), 0.4, 0.45, "helpful_first").alias("helpful_first"),
        c.ordered_thresholds(F.col("share_nh"), F.col("share_sh"), F.col("share_h"), 0.4, 0.45, "not_helpful_first").alias("not_helpful_first"),
    )


@query(f"""WITH {FEATURES}, s AS (SELECT note_id, round(ln(greatest(share_nh, 1e-9)) + 0.1, 9) AS a, round(ln(greatest(share_sh, 1e-9)) - 0.3, 9) AS b, round(ln(greatest(share_h, 1e-9)), 9) AS c FROM features)
SELECT note_id, CASE WHEN round(abs(c - a), 9) < 0.25 AND b >= round(least(c, a) - 0.5, 9) THEN 1 WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pred FROM s""")
def bias_rule(spark, d):
    s = [F.round(F.ln(F.greatest(x, F.lit(1e-9))) + b, 9) for x, b in ((F.col("share_nh"), 0.1), (F.col("share_sh"), -0.3), (F.col("share_h"), 0.0))]
    close = (F.round(F.abs(s[2] - s[0]), 9) < 0.25) & (s[1] >= F.round(F.least(s[2], s[0]) - 0.5, 9))
    return features(spark, d).select("note_id", F.when(close, 1).otherwise(c.argmax3(*s)).alias("pred"))


@query("""WITH c AS (SELECT v.agent_id, v.raw_label_id, count(CASE WHEN t.true_label_3way = 0 THEN 1 END) AS n0, count(CASE WHEN t.true_label_3way = 1 THEN 1 END) AS n1, count(CASE WHEN t.true_label_3way = 2 THEN 1 END) AS n2
  FROM votes v JOIN notes t ON v.note_id = t.note_id GROUP BY 1, 2), r AS (SELECT agent_id, raw_label_id, (n0 + 1.0) / (n0 + n1 + n2 + 3) AS p0, (n1 + 1.0) / (n0 + n1 + n2 + 3) AS p1, (n2 + 1.0) / (n0 + n1 + n2 + 3) AS p2 FROM c),
s AS (SELECT v.note_id, CASE WHEN v.confidence < 0 THEN 1.0 ELSE greatest(v.confidence / 100.0, 0.05) END AS w, p0, p1, p2 FROM votes v JOIN r ON v.agent_id = r.agent_id AND v.raw_label_id = r.raw_label_id),
q AS (SELECT note_id, sum(w * p0) AS s0, sum(w * p1) AS s1, sum(w * p2) AS s2 FROM s GROUP BY note_id)
SELECT note_id, round(s0 / (s0 + s1 + s2), 6) AS q0, round(s1 / (s0 + s1 + s2), 6) AS q1, round(s2 / (s0 + s1 + s2), 6) AS q2 FROM q""")
def agent_reliability(spark, d):
    votes = v.votes(spark, d)
    table = vote_ops.reliability(votes, v.notes(spark, d).select("note_id", "true_label_3way"))
    return vote_ops.posterior(votes, table).select("note_id", *[c.r6(F.col(f"q{k}")).alias(f"q{k}") for k in range(3)])


def _count(cond: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END)"


def _metric_sql(t: str = "true_label_3way", p: str = "pred") -> str:
    rec = {k: f"({_count(f'{t} = {k} AND {p} = {k}')} / nullif({_count(f'{t} = {k}')}, 0))" for k in range(3)}
    bal = "(" + " + ".join(f"coalesce({r}, 0)" for r in rec.values()) + ") / nullif(" + " + ".join(f"least({_count(f'{t} = {k}')}, 1)" for k in range(3)) + ", 0)"
    acc = f"{_count(f'{t} = {p}')} / count(*)"
    h_nh, nh_h = _count(f"{t} = 2 AND {p} = 0"), _count(f"{t} = 0 AND {p} = 2")
    cols = [f"round({acc}, 6) AS accuracy", f"round({bal}, 6) AS balanced_accuracy", f"round(2 * ({acc}) * ({bal}) / nullif(({acc}) + ({bal}), 0), 6) AS joint", f"{h_nh} AS h_to_nh", f"{nh_h} AS nh_to_h", f"{h_nh} + {nh_h} AS cross_error", f"round({_count(f'{p} <> 1')} / count(*), 6) AS resolved_coverage"]
    return ", ".join(cols + [f"round({rec[k]}, 6) AS recall_{n}" for k, n in m.NAMES.items()] + [f"{_count(f'{t} = {k}')} AS n_{n}" for k, n in m.NAMES.items()])


_REAL = ("accuracy", "balanced_accuracy", "joint", "resolved_coverage", *(f"recall_{n}" for n in m.NAMES.values()))


def _rounded(df, names):
    return df.select(*[c.r6(F.col(x)).alias(x) if x in names else F.col(x) for x in df.columns])


@query(f"WITH {_JUDGED} SELECT {_metric_sql()} FROM judged")
def metrics_3way(spark, d):
    return _rounded(judged(spark, d).agg(*m.three_way(F.col("true_label_3way"), F.col("pred"))), _REAL)


_TN, _FP, _FN, _TP = (_count(f"t = {a} AND p = {b}") for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)))


@query(f"""WITH {_JUDGED}, b AS (SELECT true_label_3way // 2 AS t, CASE WHEN share_h >= 0.5 THEN 1 ELSE 0 END AS p FROM judged WHERE true_label_3way <> 1)
SELECT round(({_TP} + {_TN}) / count(*), 6) AS accuracy, round((coalesce({_TN} / nullif({_TN} + {_FP}, 0), 0) + coalesce({_TP} / nullif({_TP} + {_FN}, 0), 0)) / 2, 6) AS balanced_accuracy, round(2 * {_TP} / (2 * {_TP} + {_FP} + {_FN}), 6) AS f1,
  {_TN} AS tn, {_FP} AS fp, {_FN} AS fn, {_TP} AS tp, round({_TN} / ({_TN} + {_FP}), 6) AS recall_not_helpful, round({_TP} / ({_TP} + {_FN}), 6) AS recall_helpful FROM b""")
def metrics_binary(spark, d):
    b = judged(spark, d).where("true_label_3way <> 1")
    out = b.agg(*m.binary(c.binary_class(F.col("true_label_3way")), c.binary_class(c.majority(F.col("share_h")))))
    return _rounded(out, ("accuracy", "balanced_accuracy", "f1", "recall_not_helpful", "recall_helpful"))


_DEC, _REALT = "p IN (0, 2)", "t IN (0, 2)"


@query(f"""WITH {_JUDGED}, b AS (SELECT current_status, true_label_3way AS t, CASE WHEN round(greatest(share_nh, share_h), 9) >= 0.5 THEN CASE WHEN share_h > share_nh THEN 2 ELSE 0 END ELSE -1 END AS p FROM judged)
SELECT current_status, count(*) AS n, {_count(_DEC)} AS resolved, round({_count(_DEC)} / count(*), 6) AS coverage, round({_count(_DEC + ' AND p = t')} / nullif({_count(_DEC)}, 0), 6) AS resolved_accuracy_3way,
  round({_count(f'{_DEC} AND {_REALT} AND p = t')} / nullif({_count(f'{_DEC} AND {_REALT}')}, 0), 6) AS resolved_accuracy_binary, round({_count(f'{_DEC} AND {_REALT}')} / nullif({_count(_REALT)}, 0), 6) AS true_resolved_coverage FROM b GROUP BY current_status""")
def resolved_metrics(spark, d):
    pred = c.resolved_or_abstain(F.round(F.col("share_nh"), 9), F.round(F.col("share_h"), 9), 0.5)
    out = judged(spark, d).groupBy("current_status").agg(*m.resolved(F.col("true_label_3way"), pred))
    return _rounded(out, ("coverage", "resolved_accuracy_3way", "resolved_accuracy_binary", "true_resolved_coverage"))


@query(f"WITH {_JUDGED} SELECT k.range AS true_class, {_count('pred = 2')} AS pred_2, {_count('pred = 1')} AS pred_1, {_count('pred = 0')} AS pred_0 FROM range(3) k LEFT JOIN judged j ON j.true_label_3way = k.range GROUP BY k.range")
def confusion_matrix(spark, d):
    return m.confusion(judged(spark, d), "true_label_3way", "pred")


@query(f"WITH {_JUDGED} SELECT coalesce(CAST(true_label_3way AS STRING), 'All') AS true_class, {_count('pred = 0')} AS pred_0, {_count('pred = 1')} AS pred_1, {_count('pred = 2')} AS pred_2, count(*) AS pred_All FROM judged GROUP BY ROLLUP (true_label_3way)")
def confusion_margins(spark, d):
    return m.crosstab(judged(spark, d), "true_label_3way", "pred", [0, 1, 2])


@query(f"""WITH {_JUDGED}, s AS (SELECT note_id, true_label_3way AS t, {_SIDE} AS p, round(resolved_vote_share, 9) AS score, round(mean_confidence, 9) AS conf FROM judged),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, conf DESC, note_id) AS k, rank() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM s),
u AS (SELECT 'exact_round' AS policy, * FROM r WHERE k <= greatest(1, round_even(0.4 * n, 0)) UNION ALL SELECT 'exact_ceil', * FROM r WHERE k <= greatest(1, ceil(0.4 * n)) UNION ALL SELECT 'tie_inclusive', * FROM r WHERE r <= greatest(1, ceil(0.4 * n)))
SELECT policy, count(*) AS resolved_notes, round(count(*) / max(n), 6) AS coverage, {_count('p = t')} AS resolved_correct, round({_count('p = t')} / count(*), 6) AS resolved_accuracy FROM u GROUP BY policy""")
def topk_coverage(spark, d):
    s = judged(spark, d).select("note_id", "true_label_3way", c.resolved_side(F.col("share_nh"), F.col("share_h")).alias("side"), F.round("resolved_vote_share", 9).alias("score"), F.round("mean_confidence", 9).alias("conf"))
    out = m.coverage_policies(s, "score", [F.col("conf").desc(), F.col("note_id")], F.col("side") == F.col("true_label_3way"), 0.4)
    return _rounded(out, ("coverage", "resolved_accuracy"))


_LOWS, _HIGHS = [i / 100 for i in range(51)], [i / 100 for i in range(50, 96)]


@query(f"""WITH {_JUDGED}, grid AS (SELECT l.range / 100.0::DOUBLE AS low, h.range / 100.0::DOUBLE AS high FROM range(0, 51) l, range(50, 96) h WHERE l.range < h.range), s AS (SELECT round(share_h, 9) AS x, true_label_3way // 2 AS t, count(*) AS n FROM judged WHERE true_label_3way <> 1 GROUP BY 1, 2),
k AS (SELECT low, high, sum(n) AS n, {', '.join(f'sum(CASE WHEN t = {a} AND {b} THEN n ELSE 0 END) AS {x}' for x, a, b in (('tn', 0, 'x <= low'), ('fp', 0, 'x > low AND x >= high'), ('fn', 1, 'x <= low'), ('tp', 1, 'x > low AND x >= high')))} FROM s, grid GROUP BY low, high),
a AS (SELECT low, high, (tn + fp + fn + tp) / n AS cov, (tn + tp) / nullif(tn + fp + fn + tp, 0) AS acc, (coalesce(tn / nullif(tn + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0)) / 2 AS bal FROM k),
t AS (SELECT unnest([0.5, 0.65, 0.8, 0.95]) AS target), r AS (SELECT target, low, high, cov, acc, bal, row_number() OVER (PARTITION BY target ORDER BY round(acc, 9) DESC, round(bal, 9) DESC, round(cov, 9) DESC, low, high) AS k FROM t JOIN a ON round(cov, 9) >= target)
SELECT CAST(target AS DOUBLE) AS target, low, high, round(cov, 6) AS coverage, round(acc, 6) AS accuracy, round(bal, 6) AS balanced_accuracy FROM r WHERE k = 1""")
def selective_curve(spark, d):
    x = F.round("share_h", 9)
    resolved = judged(spark, d).where("true_label_3way <> 1")
    # scores that pass the same thresholds are one cell, so the cells are no more than the thresholds
    cells = resolved.groupBy(grids.passed(x, _LOWS, ">").alias("above"), grids.passed(x, _HIGHS, ">=").alias("reached"), c.binary_class(F.col("true_label_3way")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(_LOWS) for j, b in enumerate(_HIGHS) if a < b], "i int, j int, low double, high double")
    low = F.col("above") <= F.col("i")
    high = ~low & (F.col("reached") > F.col("j"))
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    k = cells.crossJoin(F.broadcast(grid)).groupBy("low", "high").agg(F.sum("n").alias("n"), *[part((F.col("t") == t) & side).alias(n) for n, t, side in (("tn", 0, low), ("fp", 0, high), ("fn", 1, low), ("tp", 1, high))])
    decided = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    balanced = (zero(m.ratio(F.col("tn"), F.col("tn") + F.col("fp"))) + zero(m.ratio(F.col("tp"), F.col("tp") + F.col("fn")))) / 2
    scored = k.select("low", "high", (decided / F.col("n")).alias("coverage"), m.ratio(F.col("tn") + F.col("tp"), decided).alias("accuracy"), balanced.alias("balanced_accuracy"))
    targets = spark.createDataFrame([(0.5,), (0.65,), (0.8,), (0.95,)], "target double")
    reached = scored.crossJoin(F.broadcast(targets)).where(F.round("coverage", 9) >= F.col("target"))
    best = rel.top_n(reached, ["target"], [F.round("accuracy", 9).desc(), F.round("balanced_accuracy", 9).desc(), F.round("coverage", 9).desc(), F.col("low"), F.col("high")], 1)
    return _rounded(best.select("target", "low", "high", "coverage", "accuracy", "balanced_accuracy"), ("coverage", "accuracy", "balanced_accuracy"))


@query(f"""WITH {_JUDGED}, s AS (SELECT round(share_h, 9) AS x, true_label_3way // 2 AS t, count(*) AS n FROM judged WHERE true_label_3way <> 1 GROUP BY 1, 2), g AS (SELECT range / 20.0 AS threshold FROM range(1, 20)),
a AS (SELECT threshold, sum(CASE WHEN (x >= threshold) = (t = 1) THEN n ELSE 0 END) / sum(n) AS acc, (sum(CASE WHEN x >= threshold AND t = 1 THEN n ELSE 0 END) / sum(CASE WHEN t = 1 THEN n ELSE 0 END) + sum(CASE WHEN x < threshold AND t = 0 THEN n ELSE 0 END) / sum(CASE WHEN t = 0 THEN n ELSE 0 END)) / 2 AS bal,
  abs(sum(CASE WHEN x >= threshold THEN n ELSE 0 END) / sum(n) - sum(CASE WHEN t = 1 THEN n ELSE 0 END) / sum(n)) AS prior_gap FROM s, g GROUP BY threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(acc, 6) AS accuracy, round(bal, 6) AS balanced_accuracy FROM a ORDER BY round(acc, 9) DESC, round(bal, 9) DESC, round(prior_gap, 9), threshold LIMIT 1""")
def threshold_search(spark, d):
    per = judged(spark, d).where("true_label_3way <> 1").groupBy(F.round("share_h", 9).alias("x"), c.binary_class(F.col("true_label_3way")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(i / 20,) for i in range(1, 20)], "threshold double")
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    t, pred = F.col("t"), F.col("pred")
    metrics = [
        (part(pred == t) / F.sum("n")).alias("accuracy"),
        ((m.ratio(part((pred == 1) & (t == 1)), part(t == 1)) + m.ratio(part((pred == 0) & (t == 0)), part(t == 0))) / 2).alias("balanced_accuracy"),
        F.abs(part(pred == 1) / F.sum("n") - part(t == 1) / F.sum("n")).alias("prior_gap"),
    ]
    key = [F.round("accuracy", 9), F.round("balanced_accuracy", 9), -F.round("prior_gap", 9), -F.col("threshold")]
    best = m.search(per, grid, (F.col("x") >= F.col("threshold")).cast("int"), metrics, key, ["threshold"])
    return best.select("threshold", c.r6(F.col("accuracy")).alias("accuracy"), c.r6(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query(f"""WITH {_JUDGED}, s AS (SELECT round(share_h, 9) AS x, CAST(count(CASE WHEN true_label_3way = 2 THEN 1 END) AS DOUBLE) AS p, CAST(count(CASE WHEN true_label_3way <> 2 THEN 1 END) AS DOUBLE) AS q FROM judged GROUP BY 1),
w AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY x DESC) AS tp, sum(q) OVER (ORDER BY x DESC) AS fp FROM s)
SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision, CAST(sum(p) AS BIGINT) AS positives FROM w""")
def roc_auc(spark, d):
    s = judged(spark, d).withColumn("score", F.round("share_h", 9))
    return _rounded(m.roc_auc(s, "score", F.col("true_label_3way") == 2), ("roc_auc", "average_precision"))


_FOLD_SQL = "CAST(CAST(note_id AS BIGINT) % 5 AS INT)"


@query(f"""WITH {_JUDGED}, t AS (SELECT unnest([0.5, 0.65]) AS target), p AS (SELECT target, {_FOLD_SQL} AS fold, true_label_3way // 2 AS t, CASE WHEN round(share_h, 9) <= 1 - target THEN 0 WHEN round(share_h, 9) >= target THEN 1 ELSE -1 END AS p FROM judged, t WHERE true_label_3way <> 1),
f AS (SELECT target, fold, {_TP} AS tp, {_TN} AS tn, {_FP} AS fp, {_FN} AS fn, count(*) AS n FROM p GROUP BY target, fold)
SELECT CAST(target AS DOUBLE) AS target, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp + tn) / sum(tp + tn + fp + fn), 6) AS accuracy, round(sum(tp + tn + fp + fn) / sum(n), 6) AS coverage,
  round(avg((tp + tn) / nullif(tp + tn + fp + fn, 0)), 6) AS mean_fold_accuracy, round(stddev_pop((tp + tn) / nullif(tp + tn + fp + fn, 0)), 6) AS std_fold_accuracy FROM f GROUP BY target""")
def pooled_selective(spark, d):
    targets = spark.createDataFrame([(0.5,), (0.65,)], "target double")
    x = F.round("share_h", 9)
    per = judged(spark, d).where("true_label_3way <> 1").groupBy((F.col("note_id").cast("long") % 5).alias("fold"), c.binary_class(F.col("true_label_3way")).alias("t"), x.alias("x")).agg(F.count(F.lit(1)).alias("w"))
    p = per.crossJoin(F.broadcast(targets)).withColumn("p", c.selective(F.col("x"), 1 - F.col("target"), F.col("target")))
    cells = [F.sum(F.when((F.col("t") == a) & (F.col("p") == b), F.col("w")).otherwise(0)).alias(n) for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))]
    folds = p.groupBy("target", "fold").agg(*cells, F.sum("w").alias("n"))
    decided = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    acc = m.ratio(F.col("tp") + F.col("tn"), decided)
    return folds.groupBy("target").agg(*[F.sum(x).alias(x) for x in ("tp", "tn", "fp", "fn")], c.r6(F.sum(F.col("tp") + F.col("tn")) / F.sum(decided)).alias("accuracy"), c.r6(F.sum(decided) / F.sum("n")).alias("coverage"), c.r6(F.avg(acc)).alias("mean_fold_accuracy"), c.r6(F.stddev_pop(acc)).alias("std_fold_accuracy"))


@query(f"WITH {_JUDGED}, f AS (SELECT {_FOLD_SQL} AS fold, {_count('true_label_3way = pred')} / count(*) AS acc FROM judged GROUP BY 1) SELECT count(*) AS folds, round(avg(acc), 6) AS mean_accuracy, round(stddev_samp(acc) / sqrt(count(*)), 6) AS fold_se FROM f")
def fold_se(spark, d):
    f = judged(spark, d).groupBy((F.col("note_id").cast("long") % 5).alias("fold")).agg(F.avg((F.col("true_label_3way") == F.col("pred")).cast("double")).alias("acc"))
    return f.agg(F.count(F.lit(1)).alias("folds"), c.r6(F.avg("acc")).alias("mean_accuracy"), c.r6(F.stddev_samp("acc") / F.sqrt(F.count(F.lit(1)))).alias("fold_se"))


@query(f"""WITH {_JUDGED}, e AS (SELECT note_id, concat(true_label_3way, ' -> ', pred) AS error_type, round(h_nh_margin, 6) AS margin, round(mean_confidence, 6) AS conf FROM judged WHERE pred <> true_label_3way)
SELECT error_type, note_id, margin, conf, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY margin DESC, conf DESC, note_id) AS rank FROM e) WHERE rank <= 2""")
def failure_topn(spark, d):
    e = judged(spark, d).where("pred <> true_label_3way")
    kind = F.concat(F.col("true_label_3way").cast("string"), F.lit(" -> "), F.col("pred").cast("string"))
    e = e.select(kind.alias("error_type"), "note_id", c.r6(F.col("h_nh_margin")).alias("margin"), c.r6(F.col("mean_confidence")).alias("conf"))
    return rel.top_n(e, ["error_type"], [F.desc("margin"), F.desc("conf"), F.col("note_id")], 2)


@query(f"""WITH {_JUDGED}, bad AS (SELECT note_id, pred FROM judged WHERE (true_label_3way = 2 AND pred = 0) OR (true_label_3way = 0 AND pred = 2)),
r AS (SELECT b.note_id, b.pred, v.agent_id, v.confidence, row_number() OVER (PARTITION BY b.note_id ORDER BY CASE WHEN v.raw_label_id = 2 - b.pred THEN 0 ELSE 1 END, v.confidence DESC, v.ord1, v.ord2, v.ord3) AS k FROM bad b JOIN votes v ON b.note_id = v.note_id)
SELECT note_id, max(pred) AS pred, string_agg(concat(agent_id, ':', confidence), ' | ' ORDER BY k) AS against FROM r WHERE k <= 4 GROUP BY note_id""")
def cross_direction(spark, d):
    bad = judged(spark, d).where("abs(true_label_3way - pred) = 2").select("note_id", "pred")
    opposing = F.when(F.col("raw_label_id") == 2 - F.col("pred"), 0).otherwise(1)
    votes = rel.top_n(bad.join(v.votes(spark, d), "note_id"), ["note_id"], [opposing, F.desc("confidence"), F.col("ord1"), F.col("ord2"), F.col("ord3")], 4, "k")
    text = vote_ops.ordered_text(votes, F.concat_ws(":", "agent_id", F.col("confidence").cast("string")), ["k"], sep=" | ").withColumnRenamed("text", "against")
    return bad.join(text, "note_id")


_THREE = f"""three AS (SELECT note_id, true_label_3way, pred AS a, {_SIDE} AS b, CASE WHEN round(mean_score, 9) >= 2.0 / 3 THEN 2 WHEN round(mean_score, 9) <= 1.0 / 3 THEN 0 ELSE 1 END AS c, share_sh, mean_understanding FROM judged)"""


def three(spark, d):
    return judged(spark, d).select("note_id", "true_label_3way", F.col("pred").alias("a"), c.resolved_side(F.col("share_nh"), F.col("share_h")).alias("b"), c.score_thirds(F.round("mean_score", 9)).alias("c"), "share_sh", "mean_understanding")


@query(f"""WITH {_JUDGED}, {_THREE}, s AS (SELECT note_id, {', '.join(f"CASE WHEN a = {k} THEN 1.0 ELSE 0.0 END + CASE WHEN b = {k} THEN 0.75 ELSE 0.0 END + CASE WHEN c = {k} THEN 2.0 ELSE 0.0 END AS s{k}" for k in range(3))} FROM three)
SELECT note_id, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS pred FROM s""")
def weighted_vote(spark, d):
    return three(spark, d).select("note_id", c.weighted_vote([F.col("a"), F.col("b"), F.col("c")], [1.0, 0.75, 2.0]).alias("pred"))
