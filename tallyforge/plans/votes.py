"""Vote feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.operators import models
from tallyforge.operators import votes as ops
from tallyforge.plans import views as v
from tallyforge.plans.declare import query

# shared SQL: the base features of every item
FEATURES = """base AS (SELECT note_id, count(*) AS n_votes, count(CASE WHEN raw_label_id = 0 THEN 1 END) AS vote_nh, count(CASE WHEN raw_label_id = 1 THEN 1 END) AS vote_sh, count(CASE WHEN raw_label_id = 2 THEN 1 END) AS vote_h,
  avg(raw_label_id / 2.0) AS mean_score, coalesce(stddev_samp(raw_label_id / 2.0), 0) AS std_score, avg(confidence) AS mean_confidence, coalesce(stddev_samp(confidence), 0) AS std_confidence,
  avg(understanding) AS mean_understanding, coalesce(stddev_samp(understanding), 0) AS std_understanding FROM votes GROUP BY note_id),
shares AS (SELECT *, vote_nh / n_votes AS share_nh, vote_sh / n_votes AS share_sh, vote_h / n_votes AS share_h FROM base),
features AS (SELECT *, -(greatest(share_nh, 1e-9) * ln(greatest(share_nh, 1e-9)) + greatest(share_sh, 1e-9) * ln(greatest(share_sh, 1e-9)) + greatest(share_h, 1e-9) * ln(greatest(share_h, 1e-9))) AS vote_entropy,
  share_h - share_nh AS h_minus_nh, abs(share_h - share_nh) AS h_nh_margin, share_h + share_nh AS resolved_vote_share FROM shares)"""

_COLS = ["n_votes", "vote_nh", "vote_sh", "vote_h"]
_ROUNDED = ["mean_score", "std_score", "mean_confidence", "std_confidence", "mean_understanding", "std_understanding", "share_nh", "share_sh", "share_h", "vote_entropy", "h_minus_nh", "h_nh_margin", "resolved_vote_share"]


def rounded(names, places: int = 6):
    return [F.round(F.col(n), places).alias(n) for n in names]


def sql_rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def features(spark, d, extra=()):
    return ops.vote_features(v.votes(spark, d), extra=extra)


@query(f"WITH {FEATURES} SELECT note_id, {', '.join(_COLS)}, {sql_rounded(_ROUNDED)} FROM features")
def vote_features(spark, d):
    return features(spark, d).select("note_id", *_COLS, *rounded(_ROUNDED))


@query(f"""WITH {FEATURES} SELECT note_id, round(vote_entropy, 6) AS entropy3,
  round(-(greatest(share_h, 1e-6) * ln(greatest(share_h, 1e-6)) + greatest(1 - share_h, 1e-6) * ln(greatest(1 - share_h, 1e-6))), 6) AS entropy2 FROM features""")
def vote_entropy(spark, d):
    h = F.col("share_h")
    return features(spark, d).select("note_id", c.r6(F.col("vote_entropy")).alias("entropy3"), c.r6(c.entropy([h, 1 - h], 1e-6)).alias("entropy2"))


_METRICS = ["confidence", "understanding"]
_COND = ", ".join(f"round(avg(CASE WHEN raw_label_id = {k} THEN {m} END), 6) AS {n}_vote_mean_{m}" for n, k in ops.CLASSES.items() for m in _METRICS)


@query(f"SELECT note_id, {_COND} FROM votes GROUP BY note_id")
def conditional_means(spark, d):
    out = v.votes(spark, d).groupBy("note_id").agg(*ops.conditional_means(_METRICS))
    return out.select("note_id", *rounded(out.columns[1:]))


_W = ", ".join(f"round(sum(CASE WHEN raw_label_id = {k} THEN greatest(confidence, 0) END) / nullif(sum(greatest(confidence, 0)), 0), 6) AS weighted_share_{n}" for n, k in ops.CLASSES.items())


@query(f"SELECT note_id, {_W} FROM votes GROUP BY note_id")
def confidence_weighted_share(spark, d):
    out = v.votes(spark, d).groupBy("note_id").agg(*ops.weighted_shares())
    return out.select("note_id", *rounded(out.columns[1:]))


_PIVOT = ", ".join(f"CAST(coalesce(max(CASE WHEN agent_id = '{a}' AND raw_label_id = {k} THEN 1.0 END), 0.0) AS DOUBLE) AS agent_{a}_is_{n}" for a in v.AGENTS for n, k in ops.CLASSES.items())


@query(f"WITH firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY note_id, agent_id ORDER BY ord1, ord2, ord3) AS k FROM votes) WHERE k = 1) SELECT note_id, {_PIVOT} FROM firsts GROUP BY note_id")
def agent_pivot(spark, d):
    return ops.agent_pivot(v.votes(spark, d), v.AGENTS, ["ord1", "ord2", "ord3"])


_MEANS = ", ".join(f"round(avg(CASE WHEN agent_id = '{a}' THEN raw_label_id END), 6) AS {a}" for a in v.AGENTS)


@query(f"SELECT note_id, {_MEANS} FROM votes GROUP BY note_id")
def agent_mean_pivot(spark, d):
    return ops.agent_means(v.votes(spark, d), v.AGENTS).select("note_id", *rounded(v.AGENTS))


@query("""SELECT note_id, count(*) AS n_votes, count(CASE WHEN confidence >= 0 THEN 1 END) AS valid_votes, round(avg(CASE WHEN confidence >= 0 THEN raw_label_id / 2.0 END), 6) AS mean_rating_score,
  count(CASE WHEN raw_label_id = 2 THEN 1 END) AS vote_helpful, count(CASE WHEN raw_label_id = 1 THEN 1 END) AS vote_somewhat_helpful, count(CASE WHEN raw_label_id = 0 THEN 1 END) AS vote_not_helpful,
  round(avg(CASE WHEN confidence >= 0 THEN confidence END), 6) AS mean_confidence FROM votes GROUP BY note_id""")
def note_vote_summary(spark, d):
    raw, ok = F.col("raw_label_id"), F.col("confidence") >= 0
    return v.votes(spark, d).groupBy("note_id").agg(
        F.count(F.lit(1)).alias("n_votes"),
        F.count_if(ok).alias("valid_votes"),
        c.r6(F.avg(F.when(ok, raw / 2))).alias("mean_rating_score"),
        F.count_if(raw == 2).alias("vote_helpful"),
        F.count_if(raw == 1).alias("vote_somewhat_helpful"),
        F.count_if(raw == 0).alias("vote_not_helpful"),
        c.r6(F.avg(c.indicator(F.col("confidence"), "null"))).alias("mean_confidence"),
    )


@query("""SELECT note_id, agent_id, ord1, ord2, ord3, round((coalesce(CASE WHEN helpful_clear >= 0 THEN helpful_clear END, 0) + coalesce(CASE WHEN helpful_good_sources >= 0 THEN helpful_good_sources END, 0) + helpful_addresses_claim)
  / (1.0 + CAST(helpful_clear >= 0 AS INT) + CAST(helpful_good_sources >= 0 AS INT)), 6) AS helpful_quality, CAST(greatest(helpful_clear, 0) + greatest(helpful_good_sources, 0) + helpful_addresses_claim AS DOUBLE) AS helpful_sum FROM votes""")
def quality_signals(spark, d):
    known = [c.indicator(F.col(h), "null") for h in v.HELPFUL]
    return v.votes(spark, d).select("note_id", "agent_id", "ord1", "ord2", "ord3", c.r6(c.row_mean(known)).alias("helpful_quality"), c.row_sum(known).alias("helpful_sum"))


_CLEAN = {f: f"greatest({f}, 0)" for f in (*v.HELPFUL, *v.NOT_HELPFUL)}
_HS, _NS = (" + ".join(_CLEAN[f] for f in fs) for fs in (v.HELPFUL, v.NOT_HELPFUL))
_RICH = {
    "helpful_reason_count_mean": f"avg({_HS})",
    "not_helpful_reason_count_mean": f"avg({_NS})",
    "helpful_reason_any_rate": f"avg(CASE WHEN {_HS} > 0 THEN 1.0 ELSE 0.0 END)",
    "not_helpful_reason_any_rate": f"avg(CASE WHEN {_NS} > 0 THEN 1.0 ELSE 0.0 END)",
    "contradiction_h_has_nh_rate": f"avg(CASE WHEN raw_label_id = 2 AND {_NS} > 0 THEN 1.0 ELSE 0.0 END)",
    "contradiction_nh_has_h_rate": f"avg(CASE WHEN raw_label_id = 0 AND {_HS} > 0 THEN 1.0 ELSE 0.0 END)",
    "decisive_conf_rate": "avg(CASE WHEN confidence >= 75 THEN 1.0 ELSE 0.0 END)",
    "high_understanding_rate": "avg(CASE WHEN understanding >= 65 THEN 1.0 ELSE 0.0 END)",
    "low_understanding_rate": "avg(CASE WHEN understanding <= 35 THEN 1.0 ELSE 0.0 END)",
}
_RATES = {f"{f}_rate": f"avg({x})" for f, x in _CLEAN.items()}
RICH = f"rich AS (SELECT note_id, {', '.join(f'{x} AS {n}' for n, x in {**_RICH, **_RATES}.items())} FROM votes GROUP BY note_id)"
_RICH_COLS = [*_RICH, *_RATES]


def rich_aggregates():
    return [*ops.reason_rates(v.HELPFUL, v.NOT_HELPFUL), *ops.rates([*v.HELPFUL, *v.NOT_HELPFUL])]


def rich(spark, d, extra=()):
    cleaned = ops.with_cleaned(v.votes(spark, d), [*v.HELPFUL, *v.NOT_HELPFUL])
    return ops.vote_features(cleaned, extra=[*rich_aggregates(), *extra])


@query(f"WITH {RICH} SELECT note_id, {sql_rounded(_RICH_COLS)} FROM rich")
def vote_features_rich(spark, d):
    return rich(spark, d).select("note_id", *rounded(_RICH_COLS))


@query(f"""WITH {FEATURES}, {RICH}, cond AS (SELECT note_id, {_COND}, {_W} FROM votes GROUP BY note_id)
SELECT n.note_id, n.true_label_3way, f.n_votes, {', '.join(f'round(f.{x}, 6) AS {x}' for x in _ROUNDED)}, {', '.join(f'round(r.{x}, 6) AS {x}' for x in _RICH_COLS)}, {', '.join(f'c.{k}_vote_mean_{m}' for k in ops.CLASSES for m in _METRICS)}, {', '.join(f'c.weighted_share_{k}' for k in ops.CLASSES)}
FROM notes n LEFT JOIN features f ON n.note_id = f.note_id LEFT JOIN rich r ON n.note_id = r.note_id LEFT JOIN cond c ON n.note_id = c.note_id""")
def vote_features_full(spark, d):
    more = [*ops.conditional_means(_METRICS), *ops.weighted_shares()]
    cond = [f"{k}_vote_mean_{m}" for k in ops.CLASSES for m in _METRICS] + [f"weighted_share_{k}" for k in ops.CLASSES]
    f = rich(spark, d, more)
    return v.notes(spark, d).select("note_id", "true_label_3way").join(f, "note_id", "left").select("note_id", "true_label_3way", "n_votes", *rounded([*_ROUNDED, *_RICH_COLS, *cond]))


_SUPPORT_SQL = """share_h + 0.25 * share_sh + 0.15 * helpful_reason_any_rate + 0.15 * helpful_clear_rate + 0.15 * helpful_addresses_claim_rate + 0.10 * helpful_good_sources_rate + 0.003 * mean_understanding AS helpful_support,
  share_nh + 0.25 * share_sh + 0.15 * not_helpful_reason_any_rate + 0.15 * not_helpful_missing_key_points_rate + 0.15 * not_helpful_incorrect_rate + 0.003 * (100 - mean_understanding) AS not_helpful_support"""


@query(f"""WITH {FEATURES}, {RICH}, s AS (SELECT f.note_id, {_SUPPORT_SQL}, share_sh * (1 + vote_entropy) AS somewhat_pressure FROM features f JOIN rich r ON f.note_id = r.note_id)
SELECT note_id, round(helpful_support, 6) AS helpful_support, round(not_helpful_support, 6) AS not_helpful_support, round(somewhat_pressure, 6) AS somewhat_pressure, round(helpful_support - not_helpful_support, 6) AS support_margin,
  CASE WHEN round(helpful_support - not_helpful_support, 9) >= 0.18 THEN 2 WHEN round(helpful_support - not_helpful_support, 9) <= -0.18 THEN 0 ELSE 1 END AS pred FROM s""")
def support_scores(spark, d):
    s = ops.support_scores(rich(spark, d))
    m = F.round("support_margin", 9)
    return s.select("note_id", *rounded(["helpful_support", "not_helpful_support", "somewhat_pressure", "support_margin"]), F.when(m >= 0.18, 2).when(m <= -0.18, 0).otherwise(1).alias("pred"))


@query(f"""WITH {FEATURES} SELECT note_id, round(vote_entropy, 6) AS meta_entropy, round(greatest(share_nh, share_sh, share_h) - (1 - greatest(share_nh, share_sh, share_h) - least(share_nh, share_sh, share_h)), 6) AS meta_top_margin,
  round(resolved_vote_share, 6) AS meta_resolved, round(h_minus_nh, 6) AS meta_signed, round(share_sh - greatest(share_nh, share_h), 6) AS meta_nmr_gap FROM features""")
def prob_meta(spark, d):
    meta = models.prob_meta(F.col("share_nh"), F.col("share_sh"), F.col("share_h"))
    return features(spark, d).select("note_id", *[c.r6(x).alias(n) for n, x in meta.items()])


_PC = ", ".join(f"count(CASE WHEN agent_id = '{a}' AND raw_label_id = {k} THEN 1 END) AS {a}_{n}" for a in v.AGENTS for n, k in ops.CLASSES.items())


@query(f"SELECT note_id, {_PC} FROM votes GROUP BY note_id")
def persona_counts(spark, d):
    return ops.class_counts(v.votes(spark, d), "agent_id", v.AGENTS)


_TOPICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT note_id, " + ", ".join(f"CASE WHEN coalesce(primary_topic, 'UNKNOWN') = '{t}' THEN 1 ELSE 0 END AS topic_{i}" for i, t in enumerate([*_TOPICS, "UNKNOWN"])) + " FROM notes")
def meta_onehot(spark, d):
    topic = F.coalesce("primary_topic", F.lit("UNKNOWN"))
    return v.notes(spark, d).select("note_id", *[(topic == t).cast("int").alias(f"topic_{i}") for i, t in enumerate([*_TOPICS, "UNKNOWN"])])


@query("SELECT CASE WHEN confidence <= 20 THEN 0 WHEN confidence <= 40 THEN 1 WHEN confidence <= 60 THEN 2 WHEN confidence <= 80 THEN 3 ELSE 4 END AS bin, count(*) AS n, min(confidence) AS lowest, max(confidence) AS highest FROM votes GROUP BY 1")
def confidence_bins(spark, d):
    b = c.right_closed_bin(F.col("confidence"), [20, 40, 60, 80])
    return v.votes(spark, d).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"))
