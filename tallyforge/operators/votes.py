"""Vote aggregation: per-item features from one shuffle, conditional statistics, pivots, reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import columns as c

CLASSES = {"nh": 0, "sh": 1, "h": 2}


def with_cleaned(votes: DataFrame, flags: Sequence[str], mode: str = "zero") -> DataFrame:
    return votes.withColumns({f: c.indicator(F.col(f), mode) for f in flags})


def core_aggregates(conf: str = "confidence", understanding: str = "understanding") -> list[Column]:
    raw = F.col("raw_label_id")
    score = raw / 2
    spread = lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("n_votes"),
        *[F.count_if(raw == k).alias(f"vote_{n}") for n, k in CLASSES.items()],
        F.avg(score).alias("mean_score"),
        spread(score).alias("std_score"),
        F.avg(conf).alias("mean_confidence"),
        spread(F.col(conf)).alias("std_confidence"),
        F.avg(understanding).alias("mean_understanding"),
        spread(F.col(understanding)).alias("std_understanding"),
    ]


def add_shares(features: DataFrame) -> DataFrame:
    shares = {f"share_{n}": c.share(F.col(f"vote_{n}"), F.col("n_votes")) for n in CLASSES}
    return features.withColumns(shares).withColumns(
        {
            "vote_entropy": c.entropy([F.col("share_nh"), F.col("share_sh"), F.col("share_h")]),
            "h_minus_nh": F.col("share_h") - F.col("share_nh"),
            "h_nh_margin": F.abs(F.col("share_h") - F.col("share_nh")),
            "resolved_vote_share": F.col("share_h") + F.col("share_nh"),
        }
    )


def vote_features(votes: DataFrame, key: str = "note_id", extra: Sequence[Column] = ()) -> DataFrame:
    """One row per item: counts, shares, entropy, margins, score, confidence and understanding statistics.

    An item has few votes, and a vote is far shorter than the sums of all statistics, so votes are
    what is shuffled.
    """
    return add_shares(votes.repartition(key).groupBy(key).agg(*core_aggregates(), *extra))


def rates(flags: Sequence[str]) -> list[Column]:
    return [F.avg(f).alias(f"{f}_rate") for f in flags]


def reason_rates(helpful: Sequence[str], not_helpful: Sequence[str]) -> list[Column]:
    hs, ns = c.row_sum([F.col(x) for x in helpful]), c.row_sum([F.col(x) for x in not_helpful])
    raw = F.col("raw_label_id")
    any_ = lambda x: F.avg(x.cast("double"))
    return [
        F.avg(hs).alias("helpful_reason_count_mean"),
        F.avg(ns).alias("not_helpful_reason_count_mean"),
        any_(hs > 0).alias("helpful_reason_any_rate"),
        any_(ns > 0).alias("not_helpful_reason_any_rate"),
        any_((raw == 2) & (ns > 0)).alias("contradiction_h_has_nh_rate"),
        any_((raw == 0) & (hs > 0)).alias("contradiction_nh_has_h_rate"),
        any_(F.coalesce("confidence", F.lit(0)) >= 75).alias("decisive_conf_rate"),
        any_(F.coalesce("understanding", F.lit(0)) >= 65).alias("high_understanding_rate"),
        any_(F.coalesce("understanding", F.lit(100)) <= 35).alias("low_understanding_rate"),
    ]


def conditional_means(metrics: Sequence[str]) -> list[Column]:
    """Mean of each metric among the votes of each class."""
    return [F.avg(F.when(F.col("raw_label_id") == k, F.col(m))).alias(f"{n}_vote_mean_{m}") for n, k in CLASSES.items() for m in metrics]


def weighted_shares(weight: str = "confidence") -> list[Column]:
    """Weight share of each class; null without a vote of that class, or where all weights are 0."""
    w = F.greatest(F.col(weight), F.lit(0)).cast("double")
    total = F.nullif(F.sum(w), F.lit(0.0))
    return [(F.sum(F.when(F.col("raw_label_id") == k, w)) / total).alias(f"weighted_share_{n}") for n, k in CLASSES.items()]


def agent_pivot(votes: DataFrame, agents: Sequence[str], order: Sequence[str], key: str = "note_id") -> DataFrame:
    """One-hot columns of each agent's first vote; the agents are stated, so no job looks for them."""
    first = F.min_by("raw_label_id", F.struct(*order))
    wide = votes.groupBy(key).pivot("agent_id", list(agents)).agg(first)
    hot = {f"agent_{a}_is_{n}": F.coalesce((F.col(a) == k).cast("double"), F.lit(0.0)) for a in agents for n, k in CLASSES.items()}
    return wide.select(key, *[v.alias(n) for n, v in hot.items()])


def agent_means(votes: DataFrame, agents: Sequence[str], key: str = "note_id") -> DataFrame:
    """Mean class per agent as columns."""
    return votes.groupBy(key).pivot("agent_id", list(agents)).agg(F.avg("raw_label_id"))


def class_counts(votes: DataFrame, by: str, values: Sequence[str], key: str = "note_id") -> DataFrame:
    """Votes per (value of ``by``, class) as columns, 0 where there are none."""
    cells = [F.count_if((F.col(by) == v) & (F.col("raw_label_id") == k)).alias(f"{v}_{n}") for v in values for n, k in CLASSES.items()]
    return votes.groupBy(key).agg(*cells)


def support_scores(f: DataFrame) -> DataFrame:
    """Helpful and not-helpful support from shares, reason rates and understanding."""
    get = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    helpful = F.col("share_h") + 0.25 * F.col("share_sh") + 0.15 * get("helpful_reason_any_rate") + 0.15 * get("helpful_clear_rate") + 0.15 * get("helpful_addresses_claim_rate") + 0.10 * get("helpful_good_sources_rate") + 0.003 * get("mean_understanding")
    against = F.col("share_nh") + 0.25 * F.col("share_sh") + 0.15 * get("not_helpful_reason_any_rate") + 0.15 * get("not_helpful_missing_key_points_rate") + 0.15 * get("not_helpful_incorrect_rate") + 0.003 * (100 - F.coalesce("mean_understanding", F.lit(50.0)))
    return f.withColumns({"helpful_support": helpful, "not_helpful_support": against, "somewhat_pressure": F.col("share_sh") * (1 + F.col("vote_entropy"))}).withColumn("support_margin", F.col("helpful_support") - F.col("not_helpful_support"))


def reliability(votes: DataFrame, truth: DataFrame, alpha: float = 1.0, key: str = "note_id") -> DataFrame:
    """P(true class | agent, raw vote) with additive smoothing."""
    counts = votes.join(truth, key).groupBy("agent_id", "raw_label_id").agg(*[F.count_if(F.col("true_label_3way") == k).alias(f"n{k}") for k in range(3)])
    total = F.col("n0") + F.col("n1") + F.col("n2") + 3 * alpha
    return counts.select("agent_id", "raw_label_id", *[((F.col(f"n{k}") + alpha) / total).alias(f"p{k}") for k in range(3)])


def posterior(votes: DataFrame, table: DataFrame, gamma: float = 1.0, key: str = "note_id") -> DataFrame:
    """Confidence-weighted mean of the reliability rows of an item's votes, normalised."""
    conf = F.when(F.col("confidence").isNull() | (F.col("confidence") < 0), F.lit(1.0)).otherwise(F.greatest(F.col("confidence") / 100, F.lit(0.05)))
    w = F.pow(conf, F.lit(gamma))
    joined = votes.join(table, ["agent_id", "raw_label_id"], "left")
    sums = joined.groupBy(key).agg(*[F.sum(w * F.coalesce(F.col(f"p{k}"), F.lit(1 / 3))).alias(f"s{k}") for k in range(3)])
    total = F.col("s0") + F.col("s1") + F.col("s2")
    return sums.select(key, *[(F.col(f"s{k}") / total).alias(f"q{k}") for k in range(3)])


def reason_sums(votes: DataFrame, helpful: Sequence[str], not_helpful: Sequence[str], key: str = "note_id", helpful_flag: Column | None = None, not_helpful_flag: Column | None = None) -> DataFrame:
    """Reason counts of the two sides: votes that lean helpful, by rating or by their own flag, count helpful reasons, and likewise the others.

    A vote whose flag contradicts its rating stands on both sides.
    """
    h_side, n_side = F.col("raw_label_id") >= 1, F.col("raw_label_id") == 0
    h_side = h_side if helpful_flag is None else h_side | helpful_flag
    n_side = n_side if not_helpful_flag is None else n_side | not_helpful_flag
    sums = [F.sum(F.when(side, F.col(r)).otherwise(0)).cast("long").alias(r) for side, rs in ((h_side, helpful), (n_side, not_helpful)) for r in rs]
    return votes.groupBy(key).agg(F.count_if(h_side).alias("helpful_side_votes"), F.count_if(n_side).alias("not_helpful_side_votes"), *sums)


def ranked_reasons(counts: DataFrame, reasons: Sequence[str], min_votes: int = 2, min_share: float = 0.0, most: int = 3) -> DataFrame:
    """Adds ``reasons``: those with enough votes, most votes first (ties by name), at most ``most``; the top one if none has enough."""
    total = sum((F.col(r) for r in reasons[1:]), F.col(reasons[0]))
    pairs = F.array(*[F.struct((-F.col(r)).alias("n"), F.lit(r).alias("reason")) for r in reasons])
    present = F.array_sort(F.filter(pairs, lambda p: p["n"] < 0))
    good = F.filter(present, lambda p: (-p["n"] >= min_votes) & (-p["n"] / F.greatest(total, F.lit(1)) >= min_share))
    chosen = F.when(F.size(good) > 0, F.slice(good, 1, most)).otherwise(F.slice(present, 1, 1))
    return counts.withColumn("reasons", F.transform(chosen, lambda p: p["reason"]))


def ordered_text(votes: DataFrame, piece: Column, order: Sequence[str], key: str = "note_id", sep: str = " [SEP] ") -> DataFrame:
    """Pieces of each item joined in a stated order."""
    pieces = F.sort_array(F.collect_list(F.struct(*order, piece.alias("piece"))))
    return votes.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), sep).alias("text"))
