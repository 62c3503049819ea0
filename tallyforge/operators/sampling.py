"""Stratified allocation, deterministic draws, folds and resampling.

Draws order rows by an arithmetic hash of the id, so they are repeatable, independent of
partitioning, and the same in any SQL engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all():
    """Frame of all rows; used over tables with one row per stratum."""
    return Window.partitionBy()


def hashed(key: Column, seed: int) -> Column:
    return F.pmod(key.cast("long") * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))


def strata_counts(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def allocate(counts: DataFrame, strata: Sequence[str], size: int) -> DataFrame:
    """Largest-remainder allocation of ``size`` over the strata; ties go to the smaller key.

    Windows without keys run over one row per stratum.
    """
    total = F.sum("n").over(_all())
    quota = F.col("n").cast("double") * size / total
    base = counts.withColumn("quota", quota).withColumn("floor", F.floor("quota").cast("long"))
    left = F.lit(size) - F.sum("floor").over(_all())
    order = Window.orderBy(F.desc("frac"), *[F.col(s).asc_nulls_first() for s in strata])
    ranked = base.withColumn("frac", F.round(F.col("quota") - F.col("floor"), 9)).withColumn("left", left).withColumn("k", F.row_number().over(order))
    return ranked.select(*strata, "n", (F.col("floor") + (F.col("k") <= F.col("left")).cast("long")).alias("allocated"))


def check_size(counts: DataFrame, size: int) -> DataFrame:
    have = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if have < size:
        raise ValueError(f"{have} rows cannot give a sample of {size}")
    return counts


def redistribute(allocation: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Caps ``allocated`` at ``available``; the shortfall goes round by round to strata with room, roomiest first.

    A stratum's unit in round r comes after all units of earlier rounds, so the units to hand
    out are the first in the order (round, room descending, key).  How many whole rounds fit
    follows from how many strata have at least r room, so no unit needs a row.
    """
    key = [F.col(s).asc_nulls_first() for s in strata]
    base = allocation.withColumn("given", F.least("allocated", "available")).withColumn("room", F.greatest(F.col("available") - F.col("allocated"), F.lit(0)))
    base = base.withColumn("deficit", F.sum(F.col("allocated") - F.col("given")).over(_all()))
    # with rooms ascending, r whole rounds use sum(min(room, r)) units; find the largest r that fits
    up = Window.orderBy("room", *key)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    used = F.coalesce(F.sum("room").over(before), F.lit(0))
    fits = F.floor((F.col("deficit") - used) / F.count(F.lit(1)).over(rest))
    level = base.withColumn("fits", fits).withColumn("k", F.row_number().over(up))
    rounds = F.coalesce(F.min(F.when(F.col("fits") <= F.col("room"), F.struct("k", "fits"))).over(_all())["fits"], F.max("room").over(_all()))
    level = level.withColumn("rounds", rounds).withColumn("whole", F.least(F.col("room"), F.col("rounds")))
    last = F.col("deficit") - F.sum("whole").over(_all())
    open_ = F.col("room") > F.col("rounds")
    turn = F.row_number().over(Window.orderBy(F.when(open_, 0).otherwise(1), F.desc("room"), *key))
    more = (open_ & (turn <= F.col("last"))).cast("long")
    return level.withColumn("last", last).select(*strata, "allocated", "available", (F.col("given") + F.col("whole") + more).cast("long").alias("final"))


RANGES = 256


def hash_places(df: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """Adds ``__k``: the row's place, from 1, in its stratum in hash order (ties: smaller key).

    Rows are counted per range of the hash; running sums give each range its start, so only the
    rows of one range of one stratum are ordered together.
    """
    h = hashed(F.col(key), seed)
    rows = df.withColumn("__h", h).withColumn("__r", F.coalesce(F.floor(F.col("__h") / (4294967296 // RANGES)), F.lit(-1)).cast("int"))
    counts = rows.groupBy(*strata, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(s).alias(f"__{s}") for s in strata], F.col("__r").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*strata, "__r").orderBy("__h", key)
    placed = rows.withColumn("__place", F.row_number().over(inside)).join(starts, _null_safe(strata) & (F.col("__r") == F.col("__of")))
    return placed.select(*df.columns, (F.col("__start") + F.col("__place")).alias("__k"))


def draw(df: DataFrame, strata: Sequence[str], allocation: DataFrame, key: str, seed: int) -> DataFrame:
    """``allocated`` rows of each stratum, the first in hash order."""
    ranked = hash_places(df, strata, key, seed)
    return ranked.join(allocation.select(*[F.col(s).alias(f"__{s}") for s in strata], "allocated"), _null_safe(strata)).where(F.col("__k") <= F.col("allocated")).select(*df.columns)


def _null_safe(strata: Sequence[str]) -> Column:
    on = F.col(strata[0]).eqNullSafe(F.col(f"__{strata[0]}"))
    for s in strata[1:]:
        on = on & F.col(s).eqNullSafe(F.col(f"__{s}"))
    return on


def balanced(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """As many rows of each class as the smallest class has."""
    least = df.groupBy(label).count().agg(F.min("count").alias("least"))
    return hash_places(df, [label], key, seed).crossJoin(F.broadcast(least)).where("__k <= least").select(*df.columns)


def balanced_of_size(df: DataFrame, label: str, classes: Sequence[object], key: str, seed: int, size: int) -> DataFrame:
    """``size`` rows: equal parts of the classes (the first ones get the remainder), topped up from all other rows."""
    base, rest = divmod(size, len(classes))
    quota = F.lit(0)
    for i, c in enumerate(classes):
        quota = F.when(F.col(label) == F.lit(c), base + (i < rest)).otherwise(quota)
    ranked = hash_places(df, [label], key, seed).withColumn("__in", F.col("__k") <= quota)
    short = F.lit(size) - F.count_if("__in")
    missing = ranked.agg(short.alias("missing"))
    pool = hash_places(ranked.where(~F.col("__in")).drop("__k").withColumn("__all", F.lit(1)), ["__all"], key, seed + 1)
    more = pool.crossJoin(F.broadcast(missing)).where("__k <= missing")
    return ranked.where("__in").select(*df.columns).unionByName(more.select(*df.columns))


def head(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """The first ``size`` rows in a stated order; all of them where ``size`` is not positive."""
    return df if size <= 0 else df.orderBy(*order).limit(size)


def folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """Stratified fold numbers: classes are dealt round in hash order."""
    return hash_places(df, [label], key, seed).withColumn("fold", ((F.col("__k") - 1) % k).cast("int")).drop("__k")


# Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _poly(x: str, coefficients: Sequence[float]) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def normal_sql(u: str) -> str:
    """The standard normal quantile of a number in (0, 1), as SQL text."""
    tail = lambda q: f"({_poly(q, _C)} / ({_poly(q, _D)} * {q} + 1))"
    low, high, r = f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))", f"(({u} - 0.5) * ({u} - 0.5))"
    middle = f"({_poly(r, _A)} * ({u} - 0.5) / ({_poly(r, _B)} * {r} + 1))"
    return f"CASE WHEN {u} < 0.02425 THEN {tail(low)} WHEN {u} > 0.97575 THEN -{tail(high)} ELSE {middle} END"


def binomial_sql(n: str, p: str, z: str) -> str:
    """The binomial quantile at a normal deviate (Cornish-Fisher), as SQL text."""
    return f"least(greatest(round({n} * {p} + {z} * sqrt({n} * {p} * (1 - {p})) + (1 - 2 * {p}) * ({z} * {z} - 1) / 6), 0), {n})"


def uniform_sql(i: str, seed: int) -> str:
    """A number in (0, 1) from an index and a seed, as SQL text."""
    return f"(((({i} * 2654435761 + {seed}) % 4294967296) * 40503 + {seed}) % 4294967296 + 0.5) / CAST(4294967296 AS DOUBLE)"


def bootstrap(counted: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Resampling with replacement of a 0/1 outcome: (round, share) for each row of ``counted`` (n, hits).

    The hits of a resample are binomial, so each round draws that number at once; a round's
    cost does not depend on n.
    """
    draws = counted.crossJoin(F.broadcast(counted.sparkSession.range(rounds).select(F.col("id").alias("round"))))
    draws = draws.withColumn("p", F.col("hits") / F.nullif(F.col("n"), F.lit(0))).withColumn("u", F.expr(uniform_sql("round", seed))).withColumn("z", F.expr(normal_sql("u")))
    return draws.withColumn("share", F.expr(binomial_sql("n", "p", "z")) / F.nullif(F.col("n"), F.lit(0))).drop("p", "u", "z")


def bootstrap_selective(counted: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(round, coverage, accuracy) of resamples from (n, decided, correct): the decided rows first, then the correct among them."""
    first = bootstrap(counted.withColumn("hits", F.col("decided")), rounds, seed).withColumnRenamed("share", "coverage").drop("hits")
    m = first.withColumn("m", F.round(F.col("coverage") * F.col("n"))).withColumn("p", F.col("correct") / F.nullif(F.col("decided"), F.lit(0)))
    m = m.withColumn("u", F.expr(uniform_sql("round", seed + 1))).withColumn("z", F.expr(normal_sql("u")))
    return m.withColumn("accuracy", F.expr(binomial_sql("m", "p", "z")) / F.nullif(F.col("m"), F.lit(0.0))).select("round", "coverage", "accuracy")


#: Distribution of a Poisson number of mean 1 up to 12; more has a chance below 1e-10.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
PER_HASH = 4


def poisson_sql(u: str) -> str:
    """A Poisson number of mean 1 from a uniform one, as SQL text."""
    return " + ".join(f"CASE WHEN {u} >= {limit!r} THEN 1 ELSE 0 END" for limit in POISSON)


def resampled(df: DataFrame, key: str, rounds: int, seed: int) -> DataFrame:
    """Each row once for every round in which a resample holds it: adds ``round`` and ``weight``, how often it does.

    Weights are Poisson numbers of mean 1 from a hash of key, seed and round, so any statistic
    with weights is resampled by one aggregation over (round, ...), whose tasks add up their own
    rows first; a round's total varies by a root of the number of rows.  Four rounds share a hash.
    """
    hashes = F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // PER_HASH))).alias("__chunk")
    hashed = df.select("*", hashes).withColumn("__h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.col("__chunk").cast("string"))))
    part = lambda i: F.conv(F.substring("__h", 1 + 8 * i, 8), 16, 10).cast("double") / float(1 << 32)
    weight = lambda u: sum((F.when(u >= F.lit(x), 1).otherwise(0) for x in POISSON), F.lit(0))
    each = F.explode(F.array(*[F.struct((F.col("__chunk") * PER_HASH + i).alias("round"), part(i).alias("u")) for i in range(PER_HASH)]))
    out = hashed.withColumn("__e", each).withColumn("round", F.col("__e.round")).withColumn("__u", F.col("__e.u"))
    return out.where((F.col("round") < rounds) & (F.col("__u") >= POISSON[0])).withColumn("weight", weight(F.col("__u"))).drop("__chunk", "__h", "__e", "__u")


def intervals(per_round: DataFrame, statistics: Sequence[str], by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(by, metric, mean, low, high) of statistics over rounds; rounds without a value are left out."""
    tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    long = per_round.unpivot([*by, "round"], list(statistics), "metric", "value")
    out = long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.percentile("value", tails).alias("q"))
    return out.select(*by, "metric", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def accuracy_statistics(truth: Column, pred: Column, score: Column, low: float, high: float, weight: Column) -> list[Column]:
    """Accuracy, balanced accuracy of three classes, and selective coverage and accuracy of the decided classes by a score, from weights."""
    total = lambda c: F.sum(F.when(c, weight))
    share = lambda a, b: F.coalesce(total(a), F.lit(0)) / total(b)
    recalls = F.array_compact(F.array(*[share((truth == k) & (pred == k), truth == k) for k in range(3)]))
    decided = truth != 1
    taken = decided & ((score <= low) | (score >= high))
    return [
        share(truth == pred, F.lit(True)).alias("accuracy"),
        (F.aggregate(recalls, F.lit(0.0), lambda a, b: a + b) / F.size(recalls)).alias("balanced_accuracy"),
        share(taken, decided).alias("selective_coverage"),
        share(taken & (((score <= low) & (truth == 0)) | ((score >= high) & (truth == 2))), taken).alias("selective_accuracy"),
    ]
