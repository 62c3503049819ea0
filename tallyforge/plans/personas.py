"""Persona, cluster, ensemble and ablation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.operators import models
from tallyforge.operators import personas as ops
from tallyforge.plans import views as v
from tallyforge.plans.decisions import _JUDGED, _THREE, judged, three
from tallyforge.plans.declare import query
from tallyforge.plans.votes import rounded
from tallyforge.sources.files import table

_RATERS = """raters AS (SELECT rater_id, rater_id % 8 AS cluster, avg(raw_label_id / 2.0) AS mean_score, CASE WHEN rater_id % 17 = 0 THEN NULL ELSE avg(confidence) END AS mean_confidence,
  avg(understanding) AS mean_understanding, avg(CASE WHEN raw_label_id = 2 THEN 1.0 ELSE 0.0 END) AS share_h, avg(CASE WHEN raw_label_id = 0 THEN 1.0 ELSE 0.0 END) AS share_nh, count(*) AS n FROM votes GROUP BY rater_id)"""
_F = ["mean_score", "mean_confidence", "mean_understanding"]


def raters(spark, d):
    raw = F.col("raw_label_id")
    conf = F.when(F.col("rater_id") % 17 != 0, F.avg("confidence"))
    return v.votes(spark, d).groupBy("rater_id").agg(
        F.avg(raw / 2).alias("mean_score"), conf.alias("mean_confidence"), F.avg("understanding").alias("mean_understanding"), F.avg((raw == 2).cast("double")).alias("share_h"), F.avg((raw == 0).cast("double")).alias("share_nh"), F.count(F.lit(1)).alias("n")
    ).withColumn("cluster", F.col("rater_id") % 8)


_FILLED = f"{_RATERS}, filled AS (SELECT rater_id, cluster, mean_score, coalesce(mean_confidence, (SELECT median(mean_confidence) FROM raters)) AS mean_confidence, mean_understanding, share_h, share_nh, n FROM raters)"


@query(f"WITH {_FILLED} SELECT rater_id, {', '.join(f'round({f}, 6) AS {f}' for f in _F)} FROM filled")
def rater_features(spark, d):
    return ops.rater_features(raters(spark, d), _F).select("rater_id", *rounded(_F))


_CLUSTERS = f"{_FILLED}, clusters AS (SELECT cluster, count(*) AS n_raters, {', '.join(f'avg({f}) AS mean_{f}, median({f}) AS median_{f}' for f in _F)}, avg(share_h) AS mean_share_h, avg(share_nh) AS mean_share_nh, count(*) / (SELECT count(*) FROM filled) AS share FROM filled GROUP BY cluster)"
_CCOLS = [f"{a}_{f}" for f in _F for a in ("mean", "median")]


def clusters(spark, d):
    return ops.cluster_profile(ops.rater_features(raters(spark, d), _F), "cluster", [*_F, "share_h", "share_nh"])


@query(f"WITH {_CLUSTERS} SELECT cluster, n_raters, {', '.join(f'round({x}, 6) AS {x}' for x in _CCOLS)}, round(share, 6) AS share FROM clusters")
def cluster_summary(spark, d):
    return clusters(spark, d).select("cluster", "n_raters", *rounded([*_CCOLS, "share"]))


def _band_sql(x: str, high: str, low: str) -> str:
    r = f"(SELECT count(*) FROM s o WHERE o.{x} <= s.{x}) / (SELECT count(*) FROM s)"
    return f"CASE WHEN {r} >= 0.8 THEN 'very {high}' WHEN {r} >= 0.6 THEN 'moderately {high}' WHEN {r} <= 0.2 THEN 'very {low}' WHEN {r} <= 0.4 THEN 'moderately {low}' ELSE 'middle' END AS {x}_band"


@query(f"WITH {_RATERS}, s AS (SELECT rater_id, round(mean_score, 9) AS mean_score, round(mean_understanding, 9) AS mean_understanding FROM raters) SELECT rater_id, {_band_sql('mean_score', 'lenient', 'strict')}, {_band_sql('mean_understanding', 'engaged', 'detached')} FROM s")
def persona_bands(spark, d):
    s = raters(spark, d).select("rater_id", F.round("mean_score", 9).alias("mean_score"), F.round("mean_understanding", 9).alias("mean_understanding"))
    return ops.bands(s, {"mean_score": ("lenient", "strict"), "mean_understanding": ("engaged", "detached")}).select("rater_id", "mean_score_band", "mean_understanding_band")


_NAME = """SELECT rater_id, round(1 - abs(share_h - share_nh) * 3, 9) AS agreement, round(share_h * 2, 9) AS pass_rate, round(mean_score - 0.3, 9) AS mean_note, round((share_h - share_nh) * 4, 9) AS status_gap, round(mean_score - share_nh, 9) AS axis FROM raters"""


def _case(rules, otherwise) -> str:
    when = " ".join(f"WHEN {(' OR ' if any_ else ' AND ').join(f'{n} {op} {x}' for n, op, x in tests)} THEN '{text}'" for text, any_, tests in rules)
    return f"CASE {when} ELSE '{otherwise}' END"


@query(f"WITH {_RATERS}, s AS ({_NAME}) SELECT rater_id, {_case(ops.NAMES, ops.NAME_ELSE)} AS persona FROM s")
def persona_name(spark, d):
    h, nh, s = F.col("share_h"), F.col("share_nh"), F.col("mean_score")
    r9 = lambda x: F.round(x, 9)
    known = {"agreement": r9(1 - F.abs(h - nh) * 3), "pass_rate": r9(h * 2), "mean_note": r9(s - 0.3), "status_gap": r9((h - nh) * 4), "axis": r9(s - nh)}
    return raters(spark, d).select("rater_id", ops.named(known).alias("persona"))


_LABELS = """SELECT rater_id, n, mean_confidence, round(share_h - share_nh, 9) AS margin, round(share_h - 0.35, 9) AS endorsing, round(share_nh - 0.3, 9) AS rejecting, CASE WHEN rater_id % 5 = 0 THEN NULL ELSE rater_id % 7 END AS written, round(share_h / 2, 9) AS accepted, round(share_nh / 2, 9) AS refused FROM raters"""


@query(f"""WITH {_RATERS}, s AS ({_LABELS}) SELECT rater_id, {_case(ops.TENDENCIES, ops.TENDENCY_ELSE)} AS tendency, {_case(ops.DRIFTS, ops.DRIFT_ELSE)} AS drift,
  CASE WHEN written IS NULL THEN '{ops.AUTHORING_UNKNOWN}' ELSE {_case(ops.AUTHORINGS, ops.AUTHORING_ELSE)} END AS authoring FROM s""")
def persona_labels(spark, d):
    h, nh = F.col("share_h"), F.col("share_nh")
    r9 = lambda x: F.round(x, 9)
    written = F.when(F.col("rater_id") % 5 != 0, F.col("rater_id") % 7)
    return raters(spark, d).select("rater_id", ops.tendency(r9(h - nh), F.lit(0.0)).alias("tendency"), ops.drift(r9(h - 0.35), r9(nh - 0.3)).alias("drift"), ops.authoring(r9(h / 2), r9(nh / 2), written).alias("authoring"))


@query(f"""WITH {_RATERS}, s AS ({_LABELS}) SELECT rater_id, concat_ws(chr(10), concat('- Ratings given: ', n, '.'), CASE WHEN mean_confidence IS NOT NULL THEN concat('- Mean confidence: ', CAST(round(mean_confidence, 0) AS BIGINT), '.') END,
  concat('- Helpful less Not Helpful share: ', CAST(round(margin * 100, 0) AS BIGINT), ' points; this rater ', {_case(ops.TENDENCIES, ops.TENDENCY_ELSE)}, '.'), CASE WHEN written IS NOT NULL THEN concat('- As an author: ', {_case(ops.AUTHORINGS, ops.AUTHORING_ELSE)}, '.') END,
  concat('- Recent drift: ', {_case(ops.DRIFTS, ops.DRIFT_ELSE)}, '.')) AS profile FROM s""")
def persona_profile(spark, d):
    h, nh = F.col("share_h"), F.col("share_nh")
    r9 = lambda x: F.round(x, 9)
    written = F.when(F.col("rater_id") % 5 != 0, F.col("rater_id") % 7)
    said = lambda *parts: F.concat(*[p if hasattr(p, "alias") else F.lit(p) for p in parts])
    lines = [
        said("- Ratings given: ", F.col("n").cast("string"), "."),
        said("- Mean confidence: ", F.round("mean_confidence", 0).cast("long").cast("string"), "."),
        said("- Helpful less Not Helpful share: ", F.round(r9(h - nh) * 100, 0).cast("long").cast("string"), " points; this rater ", ops.tendency(r9(h - nh), F.lit(0.0)), "."),
        F.when(written.isNotNull(), said("- As an author: ", ops.authoring(r9(h / 2), r9(nh / 2), written), ".")),
        said("- Recent drift: ", ops.drift(r9(h - 0.35), r9(nh - 0.3)), "."),
    ]
    return raters(spark, d).select("rater_id", ops.profile(lines).alias("profile"))


# The lines of the request for one item.
_REQUEST = "Post creation context: {created}\nAuthor-selected note topic: {topic}\n\nPOST:\n{post}\n\nCOMMUNITY NOTE:\n{note}\n\nEvaluate only the note's usefulness for the post. Do not infer the official status from metadata."
_REQUEST_SQL = "'" + _REQUEST.replace("'", "''").replace("{created}", "', created_year, '").replace("{topic}", "', primary_topic, '").replace("{post}", "', current_status, '").replace("{note}", "', note_id, '") + "'"


@query(f"SELECT note_id, agent_id, concat({_REQUEST_SQL}) AS prompt FROM notes, (SELECT concat('C0', range) AS agent_id FROM range(1, 8))")
def cross_tasks(spark, d):
    agents = spark.createDataFrame([(a,) for a in v.AGENTS], "agent_id string")
    prompt = ops.request(_REQUEST, {"created": F.col("created_year"), "topic": F.col("primary_topic"), "post": F.col("current_status"), "note": F.col("note_id")})
    return ops.tasks(v.notes(spark, d), agents, prompt).select("note_id", "agent_id", "prompt")


@query("""WITH m AS (SELECT note_id, rater_id % 8 AS cluster, avg(raw_label_id / 2.0) AS x FROM votes GROUP BY 1, 2) SELECT note_id, count(*) AS clusters, round(avg(x), 6) AS mean_share, round(stddev_pop(x), 6) AS std_share, round(min(x), 6) AS min_share, round(max(x), 6) AS max_share FROM m GROUP BY note_id""")
def cluster_map_stats(spark, d):
    per = v.votes(spark, d).groupBy("note_id", (F.col("rater_id") % 8).cast("string").alias("cluster")).agg(F.struct(F.avg(F.col("raw_label_id") / 2).alias("share")).alias("stats"))
    as_json = per.groupBy("note_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("cluster", "stats")))).alias("profile"))
    values = F.map_values(F.from_json("profile", "map<string,struct<share:double>>"))
    x = as_json.select("note_id", F.explode(values).alias("s")).select("note_id", F.col("s.share").alias("x"))
    return x.groupBy("note_id").agg(F.count(F.lit(1)).alias("clusters"), *[c.r6(f("x")).alias(n) for f, n in ((F.avg, "mean_share"), (F.stddev_pop, "std_share"), (F.min, "min_share"), (F.max, "max_share"))])


_DIM = 64
_X = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(_DIM))
_D2 = " + ".join(f"(x{i} - c{i}) ** 2" for i in range(_DIM))
_QUALITY = f"""WITH e AS (SELECT label AS cluster, {_X} FROM embeddings), c AS (SELECT cluster, count(*) AS n, {', '.join(f'avg(x{i}) AS c{i}' for i in range(_DIM))} FROM e GROUP BY cluster),
p AS (SELECT e.cluster, sum({_D2}) AS within, avg(sqrt({_D2})) AS scatter FROM e JOIN c ON e.cluster = c.cluster GROUP BY e.cluster), w AS (SELECT {', '.join(f'avg(x{i}) AS m{i}' for i in range(_DIM))} FROM e),
b AS (SELECT sum(n * ({' + '.join(f'(c{i} - m{i}) ** 2' for i in range(_DIM))})) AS b, count(*) AS k, sum(n) AS n FROM c, w),
r AS (SELECT a.cluster, max((pa.scatter + pb.scatter) / sqrt({' + '.join(f'(a.c{i} - z.c{i}) ** 2' for i in range(_DIM))})) AS worst FROM c a JOIN c z ON a.cluster <> z.cluster JOIN p pa ON pa.cluster = a.cluster JOIN p pb ON pb.cluster = z.cluster GROUP BY a.cluster),
v AS (SELECT label AS c, [x::DOUBLE FOR x IN embedding] AS x FROM embeddings), z AS (SELECT c, count(*) AS n, {', '.join(f'sum(x[{i + 1}]) AS s{i}' for i in range(_DIM))}, sum(list_dot_product(x, x)) AS q FROM v GROUP BY c),
far AS (SELECT row_number() OVER () AS id, c, x FROM v), apart AS (SELECT far.id, far.c, z.c AS o, z.n, list_dot_product(far.x, far.x) - 2 * list_dot_product(far.x, [{', '.join(f's{i}' for i in range(_DIM))}]) / z.n + z.q / z.n AS d FROM far, z),
each AS (SELECT id, max(CASE WHEN c = o THEN n END) AS n, max(CASE WHEN c = o THEN d * n / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> o THEN d END) AS b FROM apart GROUP BY id),
sil AS (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS silhouette FROM each)
SELECT b.k, CAST(b.n AS BIGINT) AS n, round((SELECT sum(within) FROM p), 6) AS inertia, round((b.b / (b.k - 1)) / ((SELECT sum(within) FROM p) / (b.n - b.k)), 6) AS calinski_harabasz, round((SELECT avg(worst) FROM r), 6) AS davies_bouldin, round((SELECT silhouette FROM sil), 6) AS silhouette FROM b"""


@query(_QUALITY, views=False)
def cluster_quality(spark, d):
    e = table(spark, d, "embeddings")
    q = ops.cluster_quality(e, "label", "embedding", _DIM).crossJoin(ops.silhouette(e, "label", "embedding", _DIM))
    return q.select("k", "n", *rounded(["inertia", "calinski_harabasz", "davies_bouldin", "silhouette"]))


_PARTS = {"score_thirds": "CASE WHEN mean_score < 0.45 THEN 0 WHEN mean_score < 0.55 THEN 1 ELSE 2 END", "score_halves": "CASE WHEN mean_score < 0.5 THEN 0 ELSE 1 END", "understanding_halves": "CASE WHEN mean_understanding < 51 THEN 0 ELSE 1 END", "both_halves": "CASE WHEN mean_score < 0.5 THEN 0 ELSE 1 END * 2 + CASE WHEN mean_understanding < 51 THEN 0 ELSE 1 END"}
_SPREAD = " UNION ALL ".join(f"SELECT '{name}' AS method, {x} AS c, mean_score AS x, mean_understanding / 100.0 AS y FROM r9" for name, x in _PARTS.items())


@query(f"""WITH {_RATERS}, r9 AS (SELECT round(mean_score, 9) AS mean_score, round(mean_understanding, 9) AS mean_understanding FROM raters), long AS ({_SPREAD}),
m AS (SELECT method, c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM long GROUP BY 1, 2), w AS (SELECT l.method, sum((x - mx) ** 2 + (y - my) ** 2) AS within FROM long l JOIN m ON m.method = l.method AND m.c = l.c GROUP BY 1),
t AS (SELECT method, count(*) AS n, avg(x) AS gx, avg(y) AS gy FROM long GROUP BY 1), b AS (SELECT m.method, count(*) AS k, sum(m.n * ((mx - gx) ** 2 + (my - gy) ** 2)) AS between_ FROM m JOIN t ON t.method = m.method GROUP BY 1)
SELECT b.method, CAST(b.k AS BIGINT) AS k, round((between_ / nullif(b.k - 1, 0)) / (within / nullif(n - b.k, 0)), 6) AS calinski_harabasz FROM b JOIN w ON w.method = b.method JOIN t ON t.method = b.method ORDER BY round((between_ / nullif(b.k - 1, 0)) / (within / nullif(n - b.k, 0)), 6) DESC NULLS LAST, b.k, b.method LIMIT 1""")
def best_method(spark, d):
    """Of several groupings of the raters the one with the best variance ratio; ties go to fewer groups, then the name."""
    r = raters(spark, d).select(F.round("mean_score", 9).alias("mean_score"), F.round("mean_understanding", 9).alias("mean_understanding"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.expr(x).alias("c")) for n, x in _PARTS.items()]))
    long = r.select(named.alias("g"), F.col("mean_score").alias("x"), (F.col("mean_understanding") / 100.0).alias("y")).select("g.*", "x", "y")
    # sums and squares per group give both variances in one pass
    per = long.groupBy("method", "c").agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{x}") for x in ("x", "y") for k, f in (("s", F.sum), ("v", F.var_pop))])
    moments = per.groupBy("method").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("vx") + F.col("vy"))).alias("within"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum((F.col("sx") ** 2 + F.col("sy") ** 2) / F.col("n")).alias("square"))
    between = F.col("square") - (F.col("sx") ** 2 + F.col("sy") ** 2) / F.col("n")
    ratio = (between / F.nullif(F.col("k") - 1, F.lit(0))) / (F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    scored = moments.select("method", "k", F.round(ratio, 6).alias("calinski_harabasz"))
    return scored.agg(F.min_by(F.struct("method", "k", "calinski_harabasz"), F.struct((-F.coalesce("calinski_harabasz", F.lit(-1.0))).alias("q"), "k", "method")).alias("b")).select("b.*")


@query(f"WITH {_JUDGED}, {_THREE} SELECT note_id, CASE WHEN b = 1 AND c <> 1 AND share_sh < 0.5 THEN c WHEN a = 1 AND b = c AND b <> 1 AND share_sh < 0.5 THEN b ELSE a END AS pred FROM three")
def ensemble_gate(spark, d):
    a, b, e = F.col("a"), F.col("b"), F.col("c")
    loose = F.col("share_sh") < 0.5
    return three(spark, d).select("note_id", F.when((b == 1) & (e != 1) & loose, e).when((a == 1) & (b == e) & (b != 1) & loose, b).otherwise(a).alias("pred"))


@query(f"""WITH {_JUDGED}, {_THREE}, s0 AS (SELECT *, CASE WHEN mean_understanding >= 50 THEN 2 ELSE 0 END AS e FROM three), s1 AS (SELECT *, CASE WHEN a <> b AND a <> c THEN CASE WHEN b = c THEN b ELSE least(a, b, c) END ELSE a END AS p1 FROM s0), s2 AS (SELECT *, CASE WHEN p1 = 1 AND b <> 1 AND c <> 1 AND b = c THEN b ELSE p1 END AS p2 FROM s1),
s3 AS (SELECT *, CASE WHEN p2 <> 1 AND e <> p2 AND e <> c AND e <> 1 THEN e ELSE p2 END AS p3 FROM s2)
SELECT note_id, p3 AS selector, CASE WHEN a = 1 AND b = c AND c <> 1 AND share_sh >= 0.5625 AND mean_understanding <= 29.79375 THEN c ELSE a END AS promoted FROM s3""")
def stack_selector(spark, d):
    a, b, e = F.col("a"), F.col("b"), F.col("c")
    promote = (a == 1) & (b == e) & (e != 1) & (F.col("share_sh") >= 0.5625) & (F.col("mean_understanding") <= 29.79375)
    return three(spark, d).select("note_id", c.accuracy_first(a, b, F.when(F.col("mean_understanding") >= 50, 2).otherwise(0), e).alias("selector"), F.when(promote, e).otherwise(a).alias("promoted"))


# Numbers of agents whose votes count.
BUDGETS = (12, 24, 36, 48)
_PER = "count(CASE WHEN raw_label_id = {k} THEN 1 END)"
_ABL = f"""budgets AS (SELECT unnest({list(BUDGETS)}) AS agent_count), placed AS (SELECT note_id, rater_id % 60 AS agent, raw_label_id FROM votes), few AS (SELECT agent_count, note_id, {', '.join(f'{_PER.format(k=k)} AS v{k}' for k in range(3))} FROM placed, budgets WHERE agent < agent_count GROUP BY 1, 2),
counted AS (SELECT f.*, n.true_label_3way AS y, v0 + v1 + v2 AS total FROM few f JOIN notes n ON n.note_id = f.note_id),
long AS (SELECT agent_count, 'vote_only' AS method, y, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS p FROM counted UNION ALL SELECT agent_count, 'resolved_side', y, CASE WHEN v2 >= v0 THEN 2 ELSE 0 END FROM counted
  UNION ALL SELECT agent_count, 'hybrid_all', y, CASE WHEN round((v1 * 0.5 + v2) / total, 9) >= 2.0 / 3 THEN 2 WHEN round((v1 * 0.5 + v2) / total, 9) <= 1.0 / 3 THEN 0 ELSE 1 END FROM counted),
runs AS (SELECT method, agent_count, count(*) AS n, count(CASE WHEN y = p THEN 1 END) / count(*) AS accuracy FROM long GROUP BY 1, 2)"""


def runs(spark, d):
    """Accuracy of three rules on the votes of the first 12, 24, 36 and 48 agents."""
    votes = v.votes(spark, d).select("note_id", (F.col("rater_id") % 60).alias("agent"), "raw_label_id")
    cell = lambda b, k: F.count_if((F.col("agent") < b) & (F.col("raw_label_id") == k))
    # all budgets of a note come from one aggregation
    wide = votes.groupBy("note_id").agg(*[cell(b, k).alias(f"v{b}_{k}") for b in BUDGETS for k in range(3)])
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("agent_count"), *[F.col(f"v{b}_{k}").alias(f"v{k}") for k in range(3)]) for b in BUDGETS]))
    counted = wide.join(v.notes(spark, d).select("note_id", F.col("true_label_3way").alias("y")), "note_id").select("y", each.alias("b")).select("y", "b.*").where("v0 + v1 + v2 > 0")
    score = F.round((F.col("v1") * 0.5 + F.col("v2")) / (F.col("v0") + F.col("v1") + F.col("v2")), 9)
    counted = counted.withColumns({"vote_only": c.argmax3(F.col("v0"), F.col("v1"), F.col("v2")), "resolved_side": c.resolved_side(F.col("v0"), F.col("v2")), "hybrid_all": c.score_thirds(score)})
    long = counted.select("agent_count", "y", F.expr("stack(3, 'vote_only', vote_only, 'resolved_side', resolved_side, 'hybrid_all', hybrid_all) AS (method, p)"))
    return long.groupBy("method", "agent_count").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


@query(f"WITH {_ABL} SELECT method, agent_count, n, round(accuracy, 6) AS accuracy FROM runs")
def agent_budget(spark, d):
    return runs(spark, d).select("method", "agent_count", "n", c.r6(F.col("accuracy")).alias("accuracy"))


@query(f"WITH {_ABL} SELECT r.method, r.agent_count, round(r.accuracy, 6) AS accuracy, round(r.accuracy - b.accuracy, 6) AS delta_vote_only, round(r.accuracy - h.accuracy, 6) AS delta_hybrid_all FROM runs r LEFT JOIN runs b ON b.agent_count = r.agent_count AND b.method = 'vote_only' LEFT JOIN runs h ON h.agent_count = r.agent_count AND h.method = 'hybrid_all'")
def ablation_deltas(spark, d):
    return models.deltas(runs(spark, d), "agent_count", "method", "accuracy", ["vote_only", "hybrid_all"]).select("method", "agent_count", *rounded(["accuracy", "delta_vote_only", "delta_hybrid_all"]))


@query(f"WITH {_ABL}, ci AS (SELECT *, accuracy - 1.96 * sqrt(accuracy * (1 - accuracy) / n) AS lo, accuracy + 1.96 * sqrt(accuracy * (1 - accuracy) / n) AS hi FROM runs) SELECT method, agent_count, round(accuracy, 6) AS accuracy, round((hi - lo) / (2 * 1.96), 6) AS standard_error, CASE WHEN agent_count <= 24 THEN 'small' ELSE 'large' END AS view FROM ci WHERE method <> 'hybrid_all'")
def ablation_view(spark, d):
    half = 1.96 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    ci = runs(spark, d).withColumns({"lo": F.col("accuracy") - half, "hi": F.col("accuracy") + half})
    return ci.where("method <> 'hybrid_all'").select("method", "agent_count", c.r6(F.col("accuracy")).alias("accuracy"), c.r6((F.col("hi") - F.col("lo")) / (2 * 1.96)).alias("standard_error"), F.when(F.col("agent_count") <= 24, "small").otherwise("large").alias("view"))
