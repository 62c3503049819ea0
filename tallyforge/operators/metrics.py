"""Evaluation: three-way, binary, resolved and selective metrics, ranking metrics, confusion tables.

Each is one aggregation; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.relational import counts_up_to, global_rank

NAMES = {0: "not_helpful", 1: "needs_more_ratings", 2: "helpful"}


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def three_way(truth: Column, pred: Column) -> list[Column]:
    """Accuracy, balanced accuracy over the classes present, recalls, class sizes and cross errors."""
    recall = {k: ratio(F.count_if((truth == k) & (pred == k)), F.count_if(truth == k)) for k in NAMES}
    present = sum((F.least(F.count_if(truth == k), F.lit(1)) for k in (1, 2)), F.least(F.count_if(truth == 0), F.lit(1)))
    total = sum((F.coalesce(recall[k], F.lit(0.0)) for k in (1, 2)), F.coalesce(recall[0], F.lit(0.0)))
    h_nh, nh_h = F.count_if((truth == 2) & (pred == 0)), F.count_if((truth == 0) & (pred == 2))
    acc = ratio(F.count_if(truth == pred), F.count(F.lit(1)))
    bal = ratio(total, present)
    return [
        acc.alias("accuracy"),
        bal.alias("balanced_accuracy"),
        ratio(2 * acc * bal, acc + bal).alias("joint"),
        h_nh.alias("h_to_nh"),
        nh_h.alias("nh_to_h"),
        (h_nh + nh_h).alias("cross_error"),
        ratio(F.count_if(pred != 1), F.count(F.lit(1))).alias("resolved_coverage"),
        *[recall[k].alias(f"recall_{n}") for k, n in NAMES.items()],
        *[F.count_if(truth == k).alias(f"n_{n}") for k, n in NAMES.items()],
    ]


def binary(truth: Column, pred: Column) -> list[Column]:
    tn, fp = F.count_if((truth == 0) & (pred == 0)), F.count_if((truth == 0) & (pred == 1))
    fn, tp = F.count_if((truth == 1) & (pred == 0)), F.count_if((truth == 1) & (pred == 1))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    r0, r1 = zero(ratio(tn, tn + fp)), zero(ratio(tp, tp + fn))
    return [
        zero(ratio(tp + tn, tn + fp + fn + tp)).alias("accuracy"),
        ((r0 + r1) / 2).alias("balanced_accuracy"),
        zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
        r0.alias("recall_not_helpful"),
        r1.alias("recall_helpful"),
    ]


def resolved(truth: Column, pred: Column) -> list[Column]:
    """Coverage of decided rows and accuracy on them; -1 and 1 count as undecided."""
    decided, real = pred.isin(0, 2), truth.isin(0, 2)
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        F.count_if(decided).alias("resolved"),
        ratio(F.count_if(decided), n).alias("coverage"),
        ratio(F.count_if(decided & (pred == truth)), F.count_if(decided)).alias("resolved_accuracy_3way"),
        ratio(F.count_if(decided & real & (pred == truth)), F.count_if(decided & real)).alias("resolved_accuracy_binary"),
        ratio(F.count_if(decided & real), F.count_if(real)).alias("true_resolved_coverage"),
    ]


def confusion(df: DataFrame, truth: str, pred: str, order: Sequence[int] = (2, 1, 0)) -> DataFrame:
    """A row per true class and a column per predicted class, zeros included."""
    classes = df.sparkSession.createDataFrame([(k,) for k in order], "true_class int")
    cells = df.groupBy(F.col(truth).cast("int").alias("true_class")).agg(*[F.count_if(F.col(pred) == k).alias(f"pred_{k}") for k in order])
    return classes.join(cells, "true_class", "left").fillna(0)


def crosstab(df: DataFrame, truth: str, pred: str, values: Sequence[int]) -> DataFrame:
    """Cross table with margins, from one cube."""
    cube = df.select(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).cube("t", "p").agg(F.count(F.lit(1)).alias("n"), F.grouping("t").alias("gt"), F.grouping("p").alias("gp"))
    named = cube.select(F.when(F.col("gt") == 1, "All").otherwise(F.col("t")).alias("t"), F.when(F.col("gp") == 1, "All").otherwise(F.col("p")).alias("p"), "n")
    cells = [F.coalesce(F.sum(F.when(F.col("p") == str(v), F.col("n"))), F.lit(0)).alias(f"pred_{v}") for v in [*values, "All"]]
    return named.groupBy(F.col("t").alias("true_class")).agg(*cells)


def roc_auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC by rank sums with tied scores sharing ranks, and average precision.

    Rows are first counted per score, and running sums over the distinct scores go by ranges.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(positive).cast("double").alias("p"), F.count_if(~positive).cast("double").alias("q"))
    w = counts_up_to(per, score, by, ["p", "q"])
    whole = per.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    w = w.join(whole, list(by)) if by else w.crossJoin(F.broadcast(whole))
    w = w.withColumn("below", F.col("upto_q") - F.col("q")).withColumn("tp", F.col("all_p") - F.col("upto_p") + F.col("p")).withColumn("fp", F.col("all_q") - F.col("upto_q") + F.col("q"))
    pos, neg = F.nullif(F.sum("p"), F.lit(0.0)), F.nullif(F.sum("q"), F.lit(0.0))
    auc = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (pos * neg)
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / pos
    return w.groupBy(*by).agg(auc.alias("roc_auc"), ap.alias("average_precision"), F.sum("p").cast("long").alias("positives"))


def coverage_policies(df: DataFrame, score: str, ties: Sequence[Column], correct: Column, target: float) -> DataFrame:
    """Accuracy at a target coverage by three tie policies: round(k), ceil(k), and all tied with the k-th.

    Rows are counted per score; only the rows of the score at which the k-th falls are ordered.
    """
    n = df.count()
    ks = {"round": max(1, round(target * n)), "ceil": max(1, -(-int(target * n * 1_000_000) // 1_000_000))}
    per = df.groupBy((-F.col(score)).alias("s")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(correct).cast("double").alias("good"))
    upto = counts_up_to(per, "s", (), ["n", "good"])
    rows = []
    for name, k in (("exact_round", ks["round"]), ("exact_ceil", ks["ceil"]), ("tie_inclusive", ks["ceil"])):
        cut = upto.where(F.col("upto_n") - F.col("n") < k).agg(F.max(F.struct("s", "n", "good", "upto_n", "upto_good")).alias("c")).first()["c"]
        if cut is None:
            continue
        taken, good = int(cut["upto_n"]), int(cut["upto_good"])
        if name != "tie_inclusive" and taken > k:
            taken, good = k, int(cut["upto_good"] - cut["good"])
            tied = global_rank(df.where(F.col(score) == -cut["s"]), ties, "__k").where(F.col("__k") <= int(k - (cut["upto_n"] - cut["n"])))
            good += tied.agg(F.count_if(correct).alias("g")).first()["g"]
        rows.append((name, taken, taken / n, good, good / taken))
    return df.sparkSession.createDataFrame(rows, "policy string, resolved_notes long, coverage double, resolved_correct long, resolved_accuracy double")


def search(df: DataFrame, grid: DataFrame, predict: Column, metrics: Sequence[Column], key: Sequence[Column], params: Sequence[str]) -> DataFrame:
    """Best grid point: metrics of every point from one aggregation, then the largest key in lexicographic order.

    ``df`` should hold distinct score values with their counts where possible; the grid is small by
    construction and broadcast.
    """
    scored = df.crossJoin(F.broadcast(grid)).withColumn("pred", predict).groupBy(*params).agg(*metrics)
    best = scored.agg(F.max(F.struct(*key, F.struct(*scored.columns).alias("row"))).alias("best"))
    return best.select("best.row.*")
