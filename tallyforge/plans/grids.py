"""Grid search queries: thresholds, gates, biases and blends that are chosen by their metrics."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.operators import grids as g
from tallyforge.operators import sampling as draws
from tallyforge.plans import views as v
from tallyforge.plans.decisions import _JUDGED, _THREE, judged, three
from tallyforge.plans.declare import query
from tallyforge.plans.votes import rounded

METRICS = ["accuracy", "balanced_accuracy", "recall_not_helpful", "recall_needs_more_ratings", "recall_helpful", "min_recall"]


def steps(first: float, step: float, n: int) -> list[float]:
    return [round(first + i * step, 9) for i in range(n)]


def _list(values) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in values) + "]"


def _axis(name: str, values) -> str:
    return f"(SELECT unnest({_list(values)}) AS {name}, unnest(range({len(values)})) AS i_{name})"


def _metrics_sql(y: str = "y", p: str = "p", n: str = "n") -> str:
    part = lambda cond: f"sum(CASE WHEN {cond} THEN {n} ELSE 0 END)"
    rec = {k: f"{part(f'{y} = {k} AND {p} = {k}')} / nullif({part(f'{y} = {k}')}, 0)" for k in range(3)}
    known = [f"coalesce({r}, 0)" for r in rec.values()]
    present = " + ".join(f"least({part(f'{y} = {k}')}, 1)" for k in range(3))
    return (
        f"{part(f'{y} = {p}')} / sum({n}) AS accuracy, ({' + '.join(known)}) / nullif({present}, 0) AS balanced_accuracy, {rec[0]} AS recall_not_helpful, {rec[1]} AS recall_needs_more_ratings, "
        f"{rec[2]} AS recall_helpful, CAST({part(f'{y} = 0 AND {p} = 2')} AS BIGINT) AS nh_to_h, CAST({part(f'abs({y} - {p}) = 2')} AS BIGINT) AS cross_error, least({', '.join(known)}) AS min_recall"
    )


def _r9(x: str) -> str:
    return f"round(coalesce({x}, 0), 9)"


_KEYS = {
    "balanced": [_r9("balanced_accuracy"), _r9("accuracy"), "-cross_error"],
    "hnh_average": ["round((coalesce(recall_helpful, 0) + coalesce(recall_not_helpful, 0)) / 2, 9)", _r9("balanced_accuracy"), "-cross_error"],
    "balanced_cross_penalty": [f"round({_r9('balanced_accuracy')} - 0.0035::DOUBLE * cross_error, 9)", _r9("balanced_accuracy"), _r9("accuracy")],
    "min_resolved": [f"least({_r9('recall_helpful')}, {_r9('recall_not_helpful')})", _r9("balanced_accuracy"), "-cross_error"],
    "cross_safe": ["-cross_error", _r9("balanced_accuracy"), _r9("accuracy")],
}
TARGET = 0.6
_NEAR = f"CASE WHEN {_r9('recall_helpful')} >= {TARGET} THEN -round(abs({_r9('recall_helpful')} - {TARGET}::DOUBLE), 9) ELSE {_r9('recall_helpful')} - 10 END"
_TARGET_KEYS = {
    "target_h_balanced": [_NEAR, _r9("balanced_accuracy"), _r9("accuracy"), "-nh_to_h"],
    "target_h_resolved": [_NEAR, _KEYS["hnh_average"][0], "-nh_to_h", _r9("balanced_accuracy")],
    "target_h_safe": [_NEAR, "-nh_to_h", "-cross_error", _r9("balanced_accuracy")],
}


def _order(key, params) -> str:
    return ", ".join([f"{k} DESC" for k in key] + list(params))


def _metric_cols() -> str:
    return ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


_ROWS = f"""{_JUDGED}, rows_ AS (SELECT note_id, true_label_3way AS y, pred, round(share_nh, 9) AS nh, round(share_sh, 9) AS nmr, round(share_h, 9) AS h, round(share_h + share_nh, 9) AS resolved, round(share_h + share_nh - share_sh, 9) AS gap,
  round(coalesce(share_h / nullif(share_h + share_nh, 0), 0.5), 9) AS direction, round(h_nh_margin, 9) AS margin, coalesce(round(mean_confidence, 9), 100) AS conf, coalesce(round(mean_understanding, 9), 100) AS und, CASE WHEN share_h >= 0.5 THEN 2 ELSE 0 END AS side,
  round(-(greatest(share_h, 1e-9) * ln(greatest(share_h, 1e-9)) + greatest(share_nh, 1e-9) * ln(greatest(share_nh, 1e-9))), 9) AS ent2, n_votes FROM judged)"""


def rows(spark, d):
    """What the rules decide on, rounded so that sums in another order cannot decide."""
    r9 = lambda x: F.round(x, 9)
    j = judged(spark, d)
    h, nh, nmr = F.col("share_h"), F.col("share_nh"), F.col("share_sh")
    return j.select(
        "note_id",
        F.col("true_label_3way").alias("y"),
        "pred",
        r9(nh).alias("nh"),
        r9(nmr).alias("nmr"),
        r9(h).alias("h"),
        r9(h + nh).alias("resolved"),
        r9(h + nh - nmr).alias("gap"),
        r9(F.coalesce(h / F.nullif(h + nh, F.lit(0.0)), F.lit(0.5))).alias("direction"),
        r9(F.col("h_nh_margin")).alias("margin"),
        F.coalesce(r9(F.col("mean_confidence")), F.lit(100.0)).alias("conf"),
        F.coalesce(r9(F.col("mean_understanding")), F.lit(100.0)).alias("und"),
        c.majority(h).alias("side"),
        r9(c.entropy([h, nh])).alias("ent2"),
        "n_votes",
    )


@query(f"WITH {_ROWS} SELECT note_id, margin, CASE WHEN margin <= 0.125 THEN 1 ELSE 0 END AS near_tie FROM rows_")
def near_ties(spark, d):
    return rows(spark, d).select("note_id", "margin", c.near_tie(F.col("margin")).alias("near_tie"))


# The grid of the disagreement rule; 0 switches confidence or understanding off.
MARGINS, ENTROPIES, CONFS, UNDERS = steps(0.0, 0.025, 22), steps(0.10, 0.025, 25), [0.0, 45.0, 55.0, 65.0, 75.0], [0.0, 20.0, 30.0, 40.0, 50.0]
_OFF = -1e9


@query(f"""WITH {_ROWS}, cells AS (SELECT y, side, len(list_filter({_list(MARGINS)}, lambda t: margin > t)) AS m, len(list_filter({_list(ENTROPIES)}, lambda t: ent2 < t)) AS e, 1 + len(list_filter({_list(CONFS[1:])}, lambda t: conf > t)) AS c, 1 + len(list_filter({_list(UNDERS[1:])}, lambda t: und > t)) AS u, count(*) AS n FROM rows_ GROUP BY ALL),
points AS (SELECT t_margin, t_entropy, t_conf, t_under, y, CASE WHEN m > i_t_margin AND e > {len(ENTROPIES) - 1} - i_t_entropy AND c > i_t_conf AND u > i_t_under THEN side ELSE 1 END AS p, n FROM cells, {_axis('t_margin', MARGINS)}, {_axis('t_entropy', ENTROPIES)}, {_axis('t_conf', CONFS)}, {_axis('t_under', UNDERS)}),
scored AS (SELECT t_margin, t_entropy, t_conf, t_under, {_metrics_sql()} FROM points GROUP BY ALL)
SELECT t_margin, t_entropy, t_conf, t_under, {_metric_cols()}, cross_error FROM scored ORDER BY {_order(_KEYS['balanced'], ['t_margin', 't_entropy', 't_conf', 't_under'])} LIMIT 1""")
def disagreement_grid(spark, d):
    r = rows(spark, d)
    axes = {
        "i_m": g.passed(F.col("margin"), MARGINS, ">"),
        "i_e": g.passed(F.col("ent2"), ENTROPIES[::-1], "<"),
        "i_c": g.passed(F.col("conf"), [_OFF, *CONFS[1:]], ">"),
        "i_u": g.passed(F.col("und"), [_OFF, *UNDERS[1:]], ">"),
    }
    sizes = {"i_m": len(MARGINS), "i_e": len(ENTROPIES), "i_c": len(CONFS), "i_u": len(UNDERS)}
    cells = g.counted_cells(r, axes, ["y", "side"])
    kept = g.orthant_counts(cells, sizes, ["y", "side"], "kept")
    totals = cells.groupBy("y", "side").agg(F.sum("n").alias("n"))
    caught = kept.join(totals, ["y", "side"]).select(*axes, "y", "side", F.lit(1).alias("new"), (F.col("n") - F.col("kept")).alias("n"))
    at = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), F.col(i) + 1)
    named = g.changed_metrics(caught, totals, list(axes), "y", "side", "new").withColumns({"t_margin": at(MARGINS, "i_m"), "t_entropy": at(ENTROPIES[::-1], "i_e"), "t_conf": at(CONFS, "i_c"), "t_under": at(UNDERS, "i_u")})
    params = ["t_margin", "t_entropy", "t_conf", "t_under"]
    return g.best(named, g.objective("balanced"), params).select(*params, *rounded(METRICS), "cross_error")


GATE = {"t_resolved": steps(0.35, 0.05, 10), "t_gap": steps(-0.10, 0.0425, 9), "t_conf": steps(0.50, 0.05, 7)}
BAND_GATE = {**GATE, "t_resolved": steps(0.30, 0.05, 11)}
ACC_DROP, MIN_NMR, MIN_CHANGE, NO_GATE = 0.02, 0.10, 0.005, 1.1
_GATE_KEY = [_r9("balanced_accuracy"), _r9("accuracy"), _r9("recall_not_helpful"), _r9("recall_helpful"), _r9("min_recall")]
_SIDE = "CASE WHEN direction >= 0.5 THEN 2 ELSE 0 END"
_OPEN = "pred = 1 AND resolved >= t_resolved AND gap >= t_gap AND round(greatest(direction, 1 - direction), 9) >= t_conf"


def _gate_grid(gate) -> str:
    return ", ".join(_axis(k, x) for k, x in gate.items())


@query(f"""WITH {_ROWS}, as_is AS (SELECT {_metrics_sql('y', 'pred', '1')} FROM rows_), counted AS (SELECT y, pred, resolved, gap, direction, count(*) AS n FROM rows_ GROUP BY ALL),
points AS (SELECT t_resolved, t_gap, t_conf, y, CASE WHEN {_OPEN} THEN {_SIDE} ELSE pred END AS p, CASE WHEN {_OPEN} THEN n ELSE 0 END AS moved, n FROM counted, {_gate_grid(GATE)}),
scored AS (SELECT t_resolved, t_gap, t_conf, {_metrics_sql()}, sum(moved) / sum(n) AS change FROM points GROUP BY ALL),
allowed AS (SELECT s.* FROM scored s, as_is b WHERE round(s.change, 9) >= {MIN_CHANGE} AND round(s.accuracy, 9) >= round(b.accuracy - {ACC_DROP}, 9) AND {_r9('s.recall_needs_more_ratings')} >= {MIN_NMR}),
chosen AS (SELECT * FROM (SELECT 0 AS k, * FROM allowed ORDER BY {_order(_GATE_KEY, GATE)} LIMIT 1) UNION ALL SELECT 1, {NO_GATE}, {NO_GATE}, {NO_GATE}, *, 0 FROM as_is)
SELECT CAST(t_resolved AS DOUBLE) AS t_resolved, CAST(t_gap AS DOUBLE) AS t_gap, CAST(t_conf AS DOUBLE) AS t_conf, {_metric_cols()}, cross_error, round(change, 6) AS change FROM chosen ORDER BY k LIMIT 1""")
def rescue_gate(spark, d):
    return _best_gate(rows(spark, d), GATE).select(*GATE, *rounded(METRICS), "cross_error", F.round("change", 6).alias("change"))


def _gate_points(r, gate, by=()):
    sure = F.round(F.greatest(F.col("direction"), 1 - F.col("direction")), 9)
    axes = {"i0": g.passed(F.col("resolved"), gate["t_resolved"], ">="), "i1": g.passed(F.col("gap"), gate["t_gap"], ">="), "i2": g.passed(sure, gate["t_conf"], ">=")}
    sizes = {f"i{i}": len(x) for i, x in enumerate(gate.values())}
    undecided = r.where("pred = 1").withColumn("new", F.when(F.col("direction") >= 0.5, 2).otherwise(0))
    found = g.orthant_counts(g.counted_cells(undecided, axes, [*by, "y", "new"]), sizes, [*by, "y", "new"])
    names = {name: F.element_at(F.array(*[F.lit(x) for x in values]), F.col(f"i{i}") + 1) for i, (name, values) in enumerate(gate.items())}
    return found.withColumns(names).drop(*axes).withColumn("pred", F.lit(1))


_GATE_NAMES = ["balanced_accuracy", "accuracy", "recall_not_helpful", "recall_helpful", "min_recall"]


def _best_gate(r, gate):
    totals = r.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    base = totals.agg(*g.weighted_three_way(F.col("y"), F.col("pred"), F.col("n")), F.lit(0.0).alias("change"))
    found = g.changed_metrics(_gate_points(r, gate), totals, list(gate), "y", "pred", "new")
    floor = base.select(F.round(F.col("accuracy") - ACC_DROP, 9).alias("floor"))
    allowed = found.crossJoin(F.broadcast(floor)).where((F.round("change", 9) >= MIN_CHANGE) & (F.round("accuracy", 9) >= F.col("floor")) & (F.round(F.coalesce("recall_needs_more_ratings", F.lit(0.0)), 9) >= MIN_NMR)).drop("floor")
    key = [F.round(F.coalesce(x, F.lit(0.0)), 9) for x in _GATE_NAMES]
    return g.or_fallback(g.best(allowed, key, list(gate)), dict.fromkeys(gate, NO_GATE), base)


def best_gates(r, gate, by):
    """The best gate of each group's rows, ``NO_GATE`` where none is allowed."""
    totals = r.groupBy(by, "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    right = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    base = totals.groupBy(by).agg(F.round(right / F.sum("n") - ACC_DROP, 9).alias("floor"))
    found = g.changed_metrics(_gate_points(r, gate, [by]), totals, list(gate), "y", "pred", "new", [by]).join(base, by)
    allowed = found.where((F.round("change", 9) >= MIN_CHANGE) & (F.round("accuracy", 9) >= F.col("floor")) & (F.round(F.coalesce("recall_needs_more_ratings", F.lit(0.0)), 9) >= MIN_NMR))
    key = [F.round(F.coalesce(x, F.lit(0.0)), 9) for x in _GATE_NAMES]
    return base.select(by).join(g.best(allowed, key, list(gate), [by]).select(by, *gate), by, "left").fillna(NO_GATE, list(gate))


MIN_BAND = 30
_BANDED = f"{_ROWS}, banded AS (SELECT r.*, concat(n.primary_topic, '__', CASE WHEN r.n_votes >= 3 THEN 'high' WHEN r.n_votes <= 1 THEN 'low' ELSE 'mid' END) AS band FROM rows_ r JOIN notes n ON n.note_id = r.note_id)"


@query(f"""WITH {_BANDED}, as_is AS (SELECT band, count(*) AS size, {_metrics_sql('y', 'pred', '1')} FROM banded GROUP BY band), counted AS (SELECT band, y, pred, resolved, gap, direction, count(*) AS n FROM banded GROUP BY ALL),
points AS (SELECT band, t_resolved, t_gap, t_conf, y, CASE WHEN {_OPEN} THEN {_SIDE} ELSE pred END AS p, CASE WHEN {_OPEN} THEN n ELSE 0 END AS moved, n FROM counted, {_gate_grid(BAND_GATE)}),
scored AS (SELECT band, t_resolved, t_gap, t_conf, {_metrics_sql()}, sum(moved) / sum(n) AS change FROM points GROUP BY ALL),
allowed AS (SELECT s.*, row_number() OVER (PARTITION BY s.band ORDER BY {_order([k.replace('(coalesce(', '(coalesce(s.') for k in _GATE_KEY[:4]], [f's.{x}' for x in BAND_GATE])}) AS k FROM scored s JOIN as_is b ON b.band = s.band
  WHERE b.size >= {MIN_BAND} AND round(s.change, 9) >= {MIN_CHANGE} AND round(s.accuracy, 9) >= round(b.accuracy - {ACC_DROP}, 9) AND {_r9('s.recall_needs_more_ratings')} >= {MIN_NMR}),
gates AS (SELECT b.band, coalesce(a.t_resolved, {NO_GATE}) AS t_resolved, coalesce(a.t_gap, {NO_GATE}) AS t_gap, coalesce(a.t_conf, {NO_GATE}) AS t_conf FROM as_is b LEFT JOIN allowed a ON a.band = b.band AND a.k = 1)
SELECT note_id, x.band, CAST(t_resolved AS DOUBLE) AS t_resolved, CASE WHEN {_OPEN} THEN {_SIDE} ELSE pred END AS pred FROM banded x JOIN gates q ON q.band = x.band""")
def group_gate(spark, d):
    topic = v.notes(spark, d).select("note_id", "primary_topic")
    size = F.when(F.col("n_votes") >= 3, "high").when(F.col("n_votes") <= 1, "low").otherwise("mid")
    r = rows(spark, d).join(topic, "note_id").withColumn("band", F.concat_ws("__", "primary_topic", size))
    totals = r.groupBy("band", "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    base = totals.groupBy("band").agg(F.sum("n").alias("size"), F.round(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n") - ACC_DROP, 9).alias("floor"))
    found = g.changed_metrics(_gate_points(r, BAND_GATE, ["band"]), totals, list(BAND_GATE), "y", "pred", "new", ["band"]).join(base, "band")
    allowed = found.where((F.col("size") >= MIN_BAND) & (F.round("change", 9) >= MIN_CHANGE) & (F.round("accuracy", 9) >= F.col("floor")) & (F.round(F.coalesce("recall_needs_more_ratings", F.lit(0.0)), 9) >= MIN_NMR))
    key = [F.round(F.coalesce(x, F.lit(0.0)), 9) for x in _GATE_NAMES[:4]]
    gates = base.select("band").join(g.best(allowed, key, list(BAND_GATE), ["band"]).select("band", *BAND_GATE), "band", "left").fillna(NO_GATE, list(BAND_GATE))
    sure = F.round(F.greatest(F.col("direction"), 1 - F.col("direction")), 9)
    opened = (F.col("pred") == 1) & (F.col("resolved") >= F.col("t_resolved")) & (F.col("gap") >= F.col("t_gap")) & (sure >= F.col("t_conf"))
    return r.join(gates, "band").select("note_id", "band", "t_resolved", F.when(opened, F.when(F.col("direction") >= 0.5, 2).otherwise(0)).otherwise(F.col("pred")).alias("pred"))


GUARD = {"t_nmr": [0.46, 0.52, 0.58], "t_resolved_mass": [0.62, 0.56], "t_margin": [0.12, 0.08]}
_TOP2 = "round(greatest(nh, nmr, h) - (nh + nmr + h - greatest(nh, nmr, h) - least(nh, nmr, h)), 9)"
_JOINT = "round(2 * accuracy * balanced_accuracy / nullif(accuracy + balanced_accuracy, 0), 9)"
_GUARD_KEY = [_r9("recall_needs_more_ratings"), _r9("balanced_accuracy"), _r9("accuracy"), _JOINT, _r9("min_recall")]


@query(f"""WITH {_ROWS}, as_is AS (SELECT {_metrics_sql('y', 'pred', '1')} FROM rows_), counted AS (SELECT y, pred, nh, nmr, h, count(*) AS n FROM rows_ GROUP BY ALL),
points AS (SELECT t_nmr, t_resolved_mass, t_margin, y, CASE WHEN pred <> 1 AND nmr >= t_nmr AND greatest(nh, h) <= t_resolved_mass AND {_TOP2} <= t_margin THEN 1 ELSE pred END AS p, n FROM counted, {_gate_grid(GUARD)}),
scored AS (SELECT t_nmr, t_resolved_mass, t_margin, {_metrics_sql()} FROM points GROUP BY ALL), allowed AS (SELECT s.* FROM scored s, as_is b WHERE round(s.accuracy, 9) >= round(b.accuracy - {ACC_DROP}, 9)),
chosen AS (SELECT * FROM (SELECT 0 AS k, * FROM allowed ORDER BY {_order(_GUARD_KEY, GUARD)} LIMIT 1) UNION ALL SELECT 1, {NO_GATE}, 0, 0, * FROM as_is)
SELECT CAST(t_nmr AS DOUBLE) AS t_nmr, CAST(t_resolved_mass AS DOUBLE) AS t_resolved_mass, CAST(t_margin AS DOUBLE) AS t_margin, {_metric_cols()}, cross_error FROM chosen ORDER BY k LIMIT 1""")
def guard_grid(spark, d):
    r = rows(spark, d)
    tops = F.sort_array(F.array("nh", "nmr", "h"), False)
    margin = F.round(tops[0] - (F.col("nh") + F.col("nmr") + F.col("h") - tops[0] - F.least("nh", "nmr", "h")), 9)
    axes = {"i0": g.passed(F.col("nmr"), GUARD["t_nmr"], ">="), "i1": g.passed(F.greatest("nh", "h"), GUARD["t_resolved_mass"], "<="), "i2": g.passed(margin, GUARD["t_margin"], "<=")}
    cells = g.counted_cells(r, axes, ["y", "pred"])
    found = g.orthant_counts(cells.where("pred <> 1"), {f"i{i}": len(x) for i, x in enumerate(GUARD.values())}, ["y", "pred"])
    names = {name: F.element_at(F.array(*[F.lit(x) for x in values]), F.col(f"i{i}") + 1) for i, (name, values) in enumerate(GUARD.items())}
    caught = found.withColumns(names).drop(*axes).withColumn("new", F.lit(1))
    totals = cells.groupBy("y", "pred").agg(F.sum("n").alias("n"))
    base = totals.agg(*g.weighted_three_way(F.col("y"), F.col("pred"), F.col("n")))
    floor = base.select(F.round(F.col("accuracy") - ACC_DROP, 9).alias("floor"))
    scored = g.changed_metrics(caught, totals, list(GUARD), "y", "pred", "new").crossJoin(F.broadcast(floor)).where(F.round("accuracy", 9) >= F.col("floor")).drop("floor", "change")
    joint = F.round(2 * F.col("accuracy") * F.col("balanced_accuracy") / F.nullif(F.col("accuracy") + F.col("balanced_accuracy"), F.lit(0.0)), 9)
    r9 = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 9)
    key = [r9("recall_needs_more_ratings"), r9("balanced_accuracy"), r9("accuracy"), joint, r9("min_recall")]
    found = g.or_fallback(g.best(scored, key, list(GUARD)), {"t_nmr": NO_GATE, "t_resolved_mass": 0.0, "t_margin": 0.0}, base)
    return found.select(*GUARD, *rounded(METRICS), "cross_error")


# Additions to the log probabilities, and (band, cross margin) of the safety rule.
BIAS = {"b_nh": [-0.3, 0.0, 0.2, 0.4, 0.6], "b_nmr": [-0.8, -0.5, -0.3, 0.0, 0.2], "b_h": [-0.3, 0.0, 0.2, 0.4, 0.6]}
SAFETY = [(0.0, 0.0), (0.1, 0.2), (0.2, 0.2), (0.2, 0.4), (0.3, 0.4)]
_BIAS_COLS = [*BIAS, "nmr_band", "cross_margin"]
_LN = {x: f"round(ln(greatest({x}, 1e-9)), 9)" for x in ("nh", "nmr", "h")}
_BIASED = f"""{_ROWS}, counted AS (SELECT y, nh, nmr, h, count(*) AS n FROM rows_ GROUP BY ALL), safety AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in SAFETY)}) t(nmr_band, cross_margin)),
shifted AS (SELECT {', '.join(_BIAS_COLS)}, y, n, round({_LN['nh']} + b_nh, 9) AS s0, round({_LN['nmr']} + b_nmr, 9) AS s1, round({_LN['h']} + b_h, 9) AS s2 FROM counted, safety, {', '.join(_axis(k, x) for k, x in BIAS.items())}),
points AS (SELECT {', '.join(_BIAS_COLS)}, y, n, CASE WHEN cross_margin > 0 AND round(abs(s2 - s0), 9) < cross_margin AND s1 >= round(least(s2, s0) - nmr_band, 9) THEN 1 WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS p FROM shifted),
scored AS (SELECT {', '.join(_BIAS_COLS)}, {_metrics_sql()} FROM points GROUP BY ALL)"""


@query(f"WITH {_BIASED} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS objective, {', '.join(_BIAS_COLS)}, {_metric_cols()}, cross_error FROM scored ORDER BY {_order(key, _BIAS_COLS).replace('balanced_accuracy', 'scored.balanced_accuracy').replace('(accuracy', '(scored.accuracy').replace('coalesce(accuracy', 'coalesce(scored.accuracy').replace('recall_', 'scored.recall_').replace('cross_error', 'scored.cross_error')} LIMIT 1)" for name, key in _KEYS.items()))
def bias_grid(spark, d):
    counted = rows(spark, d).groupBy("y", "nh", "nmr", "h").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(*b, *s) for b in product(*BIAS.values()) for s in SAFETY], ", ".join(f"{x} double" for x in _BIAS_COLS))
    s0, s1, s2 = (F.round(F.round(F.ln(F.greatest(F.col(x), F.lit(1e-9))), 9) + F.col(f"b_{x}"), 9) for x in ("nh", "nmr", "h"))
    close = (F.col("cross_margin") > 0) & (F.round(F.abs(s2 - s0), 9) < F.col("cross_margin")) & (s1 >= F.round(F.least(s2, s0) - F.col("nmr_band"), 9))
    points = g.scored(counted, grid, F.when(close, 1).otherwise(c.argmax3(s0, s1, s2)), _BIAS_COLS)
    # one pass gives the best point of every objective
    names = list(_KEYS)
    chosen = points.agg(*[F.min_by(F.struct(*points.columns), F.struct(*[(-k).alias(f"k{i}") for i, k in enumerate(g.objective(name))], *_BIAS_COLS)).alias(name) for name in names])
    rows_ = chosen.select(F.explode(F.array(*[F.struct(F.lit(name).alias("objective"), F.col(name).alias("best")) for name in names])).alias("r"))
    return rows_.select("r.objective", "r.best.*").select("objective", *_BIAS_COLS, *rounded(METRICS), "cross_error")


TAUS = steps(0.12, 0.04, 13)
MODES = ("helpful_first", "not_helpful_first", "helpful_bias")
_TAU_COLS = ["mode", "t_h", "t_nh"]
_TARGETED = f"""{_ROWS}, counted AS (SELECT y, nh, nmr, h, count(*) AS n FROM rows_ GROUP BY ALL), modes AS (SELECT unnest({list(MODES)!r}) AS mode),
points AS (SELECT mode, t_h, t_nh, y, n, CASE mode WHEN 'helpful_first' THEN CASE WHEN h >= t_h THEN 2 WHEN nh >= t_nh THEN 0 ELSE 1 END WHEN 'not_helpful_first' THEN CASE WHEN nh >= t_nh THEN 0 WHEN h >= t_h THEN 2 ELSE 1 END
  ELSE CASE WHEN nh >= nmr AND nh >= round(h + t_h, 9) THEN 0 WHEN nmr >= round(h + t_h, 9) THEN 1 ELSE 2 END END AS p FROM counted, modes, {_axis('t_h', TAUS)}, {_axis('t_nh', TAUS)}),
scored AS (SELECT mode, t_h, t_nh, {_metrics_sql()} FROM points GROUP BY ALL)"""


def _qualified(key) -> str:
    out = _order(key, _TAU_COLS)
    for name in ("balanced_accuracy", "recall_helpful", "recall_not_helpful", "cross_error", "nh_to_h"):
        out = out.replace(name, f"scored.{name}")
    return out.replace("coalesce(accuracy", "coalesce(scored.accuracy")


@query(f"WITH {_TARGETED} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS objective, mode, t_h, t_nh, {_metric_cols()}, cross_error, nh_to_h FROM scored ORDER BY {_qualified(key)} LIMIT 1)" for name, key in _TARGET_KEYS.items()))
def target_recall_grid(spark, d):
    counted = rows(spark, d).groupBy("y", "nh", "nmr", "h").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame(list(product(MODES, TAUS, TAUS)), "mode string, t_h double, t_nh double")
    nh, nmr, h, th, tn = (F.col(x) for x in ("nh", "nmr", "h", "t_h", "t_nh"))
    rule = F.when(F.col("mode") == MODES[0], c.ordered_thresholds(nh, nmr, h, th, tn, MODES[0])).when(F.col("mode") == MODES[1], c.ordered_thresholds(nh, nmr, h, th, tn, MODES[1])).otherwise(c.argmax3(nh, nmr, F.round(h + th, 9)))
    points = g.scored(counted, grid, rule, _TAU_COLS)
    out = None
    for name in _TARGET_KEYS:
        one = g.best(points, g.objective(name, TARGET), _TAU_COLS).withColumn("objective", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("objective", *_TAU_COLS, *rounded(METRICS), "cross_error", "nh_to_h")


WEIGHTS = (0.5, 1.0, 2.0)
RULES = [("plain", 0.0), ("margin_to_nmr", 0.0), ("margin_to_nmr", 0.5), ("any_cross_to_nmr", 0.0)]
METHODS = ("a", "b", "c", "d")


def _blends() -> list[tuple]:
    out = []
    for size in (2, 3):
        for chosen in combinations(METHODS, size):
            for weights in product(WEIGHTS, repeat=size):
                w = dict(zip(chosen, weights, strict=True))
                out += [("+".join(chosen), *[w.get(m, 0.0) for m in METHODS], rule, margin) for rule, margin in RULES]
    return out


_BLEND_COLS = ["methods", *[f"w_{m}" for m in METHODS], "rule", "margin"]
_VOTED = f"{_JUDGED}, {_THREE}, four AS (SELECT t.note_id, t.true_label_3way AS y, a, b, c, CASE WHEN j.share_h >= 0.5 THEN 2 ELSE 0 END AS d FROM three t JOIN judged j ON j.note_id = t.note_id)"


@query(f"""WITH {_VOTED}, counted AS (SELECT y, a, b, c, d, count(*) AS n FROM four GROUP BY ALL), subsets AS (SELECT m FROM (SELECT [x.m, z.m] AS m FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS m) x, (SELECT unnest(['a', 'b', 'c', 'd']) AS m) z WHERE x.m < z.m
  UNION ALL SELECT [x.m, z.m, w.m] FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS m) x, (SELECT unnest(['a', 'b', 'c', 'd']) AS m) z, (SELECT unnest(['a', 'b', 'c', 'd']) AS m) w WHERE x.m < z.m AND z.m < w.m)),
w AS (SELECT unnest({_list(WEIGHTS)}) AS w), rules AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {x}::DOUBLE)" for r, x in RULES)}) t(rule, margin)),
weighted AS (SELECT DISTINCT array_to_string(m, '+') AS methods, {', '.join(f"CASE WHEN list_contains(m, '{x}') THEN w{i}.w ELSE 0 END AS w_{x}" for i, x in enumerate(METHODS))} FROM subsets, {', '.join(f'w w{i}' for i in range(4))}),
summed AS (SELECT {', '.join(_BLEND_COLS)}, y, n, {', '.join(' + '.join(f'CASE WHEN {x} = {k} THEN w_{x} ELSE 0 END' for x in METHODS) + f' AS s{k}' for k in range(3))} FROM counted, weighted, rules),
points AS (SELECT {', '.join(_BLEND_COLS)}, y, n, CASE WHEN rule = 'margin_to_nmr' AND abs(s2 - s0) <= margin THEN 1 WHEN rule = 'any_cross_to_nmr' AND s0 > 0 AND s1 > 0 AND s2 > 0 THEN 1 WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS p FROM summed),
scored AS (SELECT {', '.join(_BLEND_COLS)}, {_metrics_sql()} FROM points GROUP BY ALL)
SELECT {', '.join(_BLEND_COLS)}, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, cross_error FROM scored ORDER BY {_order([k.replace('balanced_accuracy', 'scored.balanced_accuracy').replace('coalesce(accuracy', 'coalesce(scored.accuracy') for k in _KEYS['balanced']], _BLEND_COLS)} LIMIT 1""")
def blend_grid(spark, d):
    side = rows(spark, d).select("note_id", F.col("side").alias("d"))
    counted = three(spark, d).join(side, "note_id").groupBy(F.col("true_label_3way").alias("y"), *METHODS).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame(_blends(), "methods string, w_a double, w_b double, w_c double, w_d double, rule string, margin double")
    scores = [sum((F.when(F.col(m) == k, F.col(f"w_{m}")).otherwise(0.0) for m in METHODS[1:]), F.when(F.col("a") == k, F.col("w_a")).otherwise(0.0)) for k in range(3)]
    points = g.scored(counted, grid, c.combined(scores, F.col("rule"), F.col("margin")), _BLEND_COLS)
    return g.best(points, g.objective("balanced"), _BLEND_COLS).select(*_BLEND_COLS, *rounded(["accuracy", "balanced_accuracy"]), "cross_error")


LOWS, HIGHS = steps(0.05, 0.02, 26), steps(0.45, 0.02, 26)


@query(f"""WITH {_ROWS}, counted AS (SELECT y, h, count(*) AS n FROM rows_ GROUP BY ALL), points AS (SELECT low, high, y, n, CASE WHEN h <= low THEN 0 WHEN h >= high THEN 2 ELSE 1 END AS p FROM counted, {_axis('low', LOWS)}, {_axis('high', HIGHS)} WHERE low < high),
scored AS (SELECT low, high, {_metrics_sql()} FROM points GROUP BY ALL)
SELECT low, high, {_metric_cols()}, cross_error FROM scored ORDER BY {_order([k.replace('balanced_accuracy', 'scored.balanced_accuracy').replace('coalesce(accuracy', 'coalesce(scored.accuracy') for k in _KEYS['balanced']], ['low', 'high'])} LIMIT 1""")
def dual_threshold(spark, d):
    # values that pass the same thresholds are one cell, so the cells are no more than the thresholds
    r = rows(spark, d)
    cells = r.groupBy("y", g.passed(F.col("h"), LOWS, ">").alias("above"), g.passed(F.col("h"), HIGHS, ">=").alias("reached")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(i, j, low, high) for i, low in enumerate(LOWS) for j, high in enumerate(HIGHS) if low < high], "i int, j int, low double, high double")
    pred = F.when(F.col("above") <= F.col("i"), 0).when(F.col("reached") > F.col("j"), 2).otherwise(1)
    return g.best(g.scored(cells, grid, pred, ["low", "high"]), g.objective("balanced"), ["low", "high"]).select("low", "high", *rounded(METRICS), "cross_error")


_BOOT_U = draws.uniform_sql("range", 9)
_BOOT_V = draws.uniform_sql("range", 10)


@query(f"""WITH {_ROWS}, k AS (SELECT count(*) AS n, count(CASE WHEN h <= 0.35 OR h >= 0.65 THEN 1 END) AS decided, count(CASE WHEN (h <= 0.35 AND y = 0) OR (h >= 0.65 AND y = 2) THEN 1 END) AS correct FROM rows_ WHERE y <> 1),
u AS (SELECT range, n, decided / n AS p, correct / nullif(decided, 0) AS q, {_BOOT_U} AS u, {_BOOT_V} AS w FROM range(200), k), z AS (SELECT n, p, q, {draws.normal_sql('u')} AS z, {draws.normal_sql('w')} AS x FROM u),
m AS (SELECT n, q, x, {draws.binomial_sql('n', 'p', 'z')} AS m FROM z), r AS (SELECT m / n AS coverage, {draws.binomial_sql('m', 'q', 'x')} / nullif(m, 0) AS accuracy FROM m)
SELECT round(quantile_cont(accuracy, 0.025), 9) AS accuracy_low, round(quantile_cont(accuracy, 0.975), 9) AS accuracy_high, round(quantile_cont(coverage, 0.025), 9) AS coverage_low, round(quantile_cont(coverage, 0.975), 9) AS coverage_high FROM r""")
def bootstrap_selective(spark, d):
    low, high = F.col("h") <= 0.35, F.col("h") >= 0.65
    counted = rows(spark, d).where("y <> 1").agg(F.count(F.lit(1)).alias("n"), F.count_if(low | high).alias("decided"), F.count_if((low & (F.col("y") == 0)) | (high & (F.col("y") == 2))).alias("correct"))
    q = lambda x: F.percentile(x, F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.bootstrap_selective(counted, 200, 9).agg(q("accuracy").alias("a"), q("coverage").alias("c"))
    return out.select(*[F.round(F.col(x)[i], 9).alias(n) for x, i, n in (("a", 0, "accuracy_low"), ("a", 1, "accuracy_high"), ("c", 0, "coverage_low"), ("c", 1, "coverage_high"))])


STATISTICS = ["accuracy", "balanced_accuracy", "selective_coverage", "selective_accuracy"]
_TAKEN = "y <> 1 AND (h <= 0.35 OR h >= 0.65)"
_RIGHT = f"{_TAKEN} AND ((h <= 0.35 AND y = 0) OR (h >= 0.65 AND y = 2))"
_SHARE = lambda a, b: f"coalesce(sum(CASE WHEN {a} THEN w END), 0) / sum(CASE WHEN {b} THEN w END)"


@query(f"""WITH {_ROWS}, hashed AS (SELECT y, pred, h, chunk, md5(concat_ws(':', note_id, '9', CAST(chunk AS VARCHAR))) AS x FROM rows_, (SELECT unnest(range({200 // draws.PER_HASH})) AS chunk)),
drawn AS (SELECT y, pred, h, chunk * {draws.PER_HASH} + i AS round, CAST(CAST('0x' || substr(x, CAST(1 + 8 * i AS BIGINT), 8) AS BIGINT) AS DOUBLE) / {float(1 << 32)!r} AS u FROM hashed, (SELECT unnest(range({draws.PER_HASH})) AS i)),
weighted AS (SELECT y, pred, h, round, {draws.poisson_sql('u')} AS w FROM drawn),
s AS (SELECT round, {_SHARE('y = pred', 'true')} AS accuracy, list_avg([{', '.join(_SHARE(f'y = {k} AND pred = {k}', f'y = {k}') for k in range(3))}]) AS balanced_accuracy, {_SHARE(_TAKEN, 'y <> 1')} AS selective_coverage, {_SHARE(_RIGHT, _TAKEN)} AS selective_accuracy FROM weighted GROUP BY round),
long AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {m} AS value FROM s" for m in STATISTICS)})
SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM long GROUP BY metric""")
def bootstrap_metrics(spark, d):
    """Intervals of accuracy, balanced accuracy and selective accuracy from 200 resamples of the rows."""
    drawn = draws.resampled(rows(spark, d).select("note_id", "y", "pred", "h"), "note_id", 200, 9)
    found = drawn.groupBy("round").agg(*draws.accuracy_statistics(F.col("y"), F.col("pred"), F.col("h"), 0.35, 0.65, F.col("weight")))
    return draws.intervals(found, STATISTICS).select("metric", *rounded(["mean", "low", "high"]))
