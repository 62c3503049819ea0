"""Parameter grids that choose: every point is scored, none by a pass over the rows of its own.

Threshold rules.  A rule "all of these hold" is decided, for every point of a grid, by how many
thresholds of each axis a row passes.  Rows are counted per such tuple (at most the size of
the grid, whatever the table), and running sums along each axis give the count of every point.

Other rules are applied to the distinct inputs with their counts, once per point.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.metrics import ratio
from tallyforge.operators.relational import stable


def passed(value: Column, thresholds: Sequence[float], op: str) -> Column:
    """How many thresholds, given from the mildest to the strictest, the value passes; an unknown value passes none."""
    tests = {">=": lambda t: value >= t, ">": lambda t: value > t, "<=": lambda t: value <= t, "<": lambda t: value < t}[op]
    return reduce(lambda a, b: a + b, [F.coalesce(tests(t).cast("int"), F.lit(0)) for t in thresholds])


def counted_cells(df: DataFrame, axes: dict[str, Column], groups: Sequence[str]) -> DataFrame:
    """(groups, axis indices, n), stored: rows per tuple of strictest thresholds that they pass (-1: none), no more than the grid has points."""
    return stable(df.groupBy(*groups, *[(x - 1).cast("int").alias(a) for a, x in axes.items()]).agg(F.count(F.lit(1)).alias("n")))


def orthant_counts(cells: DataFrame, sizes: dict[str, int], groups: Sequence[str], n: str = "n") -> DataFrame:
    """(axis indices, groups, n): rows that pass threshold i of every axis, for all grid points.

    ``cells`` are ``counted_cells``; a row that passes j thresholds of an axis passes those with
    index below j.  Points without rows count 0 for every group value that occurs.
    """
    axes, spark = list(sizes), cells.sparkSession
    lattice = cells.select(*groups).distinct()
    cells = cells.where(reduce(lambda a, b: a & b, [F.col(a) >= 0 for a in axes])).withColumnRenamed("n", n)
    for a in axes:
        lattice = lattice.crossJoin(F.broadcast(spark.range(sizes[a]).select(F.col("id").cast("int").alias(a))))
    keys = [*groups, *axes]
    renamed = cells.select(*[F.col(k).alias(f"__{k}") for k in keys], n)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    out = lattice.join(renamed, on, "left").select(*keys, F.coalesce(n, F.lit(0)).alias(n))
    for a in axes:
        others = [k for k in keys if k != a]
        out = out.withColumn(n, F.sum(n).over(Window.partitionBy(*others).orderBy(F.col(a).desc())))
    return out


def changed_metrics(points: DataFrame, totals: DataFrame, params: Sequence[str], truth: str, base: str, new: str, by: Sequence[str] = ()) -> DataFrame:
    """Three-way metrics of every point from counts of rows whose prediction changes from ``base`` to ``new``.

    ``points``: params, (by), truth, base, new, n (changed rows); ``totals``: (by), truth, base, n
    (all rows).  Gives accuracy, balanced_accuracy, recalls, cross_error, min_recall and change.
    """
    stay = totals.crossJoin(F.broadcast(points.select(*params).distinct())) if not by else totals.join(points.select(*by, *params).distinct(), list(by))
    parts = stay.select(*by, *params, truth, F.col(base).alias("pred"), "n", F.lit(0).alias("moved"))
    parts = parts.unionByName(points.select(*by, *params, truth, F.col(base).alias("pred"), (-F.col("n")).alias("n"), F.lit(0).alias("moved")))
    parts = parts.unionByName(points.select(*by, *params, truth, F.col(new).alias("pred"), "n", F.col("n").alias("moved")))
    return parts.groupBy(*by, *params).agg(*weighted_three_way(F.col(truth), F.col("pred"), F.col("n")), (F.sum("moved") / F.sum("n")).alias("change"))


def weighted_three_way(truth: Column, pred: Column, n: Column) -> list[Column]:
    """Metrics of counted (truth, prediction) pairs."""
    part = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    recall = {k: ratio(part((truth == k) & (pred == k)), part(truth == k)) for k in range(3)}
    present = reduce(lambda a, b: a + b, [F.least(part(truth == k), F.lit(1)) for k in range(3)])
    known = [F.coalesce(r, F.lit(0.0)) for r in recall.values()]
    return [
        ratio(part(truth == pred), F.sum(n)).alias("accuracy"),
        ratio(reduce(lambda a, b: a + b, known), present).alias("balanced_accuracy"),
        recall[0].alias("recall_not_helpful"),
        recall[1].alias("recall_needs_more_ratings"),
        recall[2].alias("recall_helpful"),
        part((truth == 0) & (pred == 2)).alias("nh_to_h"),
        part(F.abs(truth - pred) == 2).alias("cross_error"),
        F.least(*known).alias("min_recall"),
    ]


def _r9(name: str) -> Column:
    return F.round(F.coalesce(F.col(name), F.lit(0.0)), 9)


def _mean(a: str, b: str) -> Column:
    return F.round((F.coalesce(F.col(a), F.lit(0.0)) + F.coalesce(F.col(b), F.lit(0.0))) / 2, 9)


def objective(name: str, target: float = 0.0) -> list[Column]:
    """Columns to be largest in lexicographic order, over the names of ``weighted_three_way``.

    Values are rounded to nine places, so that sums in another order cannot decide.
    """
    balanced, accuracy, cross = _r9("balanced_accuracy"), _r9("accuracy"), -F.col("cross_error").cast("double")
    resolved = _mean("recall_helpful", "recall_not_helpful")
    helpful = _r9("recall_helpful")
    near = F.when(helpful >= target, -F.round(F.abs(helpful - target), 9)).otherwise(helpful - 10)
    return {
        "balanced": [balanced, accuracy, cross],
        "hnh_average": [resolved, balanced, cross],
        "balanced_cross_penalty": [F.round(balanced + 0.0035 * cross, 9), balanced, accuracy],
        "min_resolved": [F.least(helpful, _r9("recall_not_helpful")), balanced, cross],
        "cross_safe": [cross, balanced, accuracy],
        "accuracy": [accuracy, balanced, cross],
        "target_h_balanced": [near, balanced, accuracy, -F.col("nh_to_h").cast("double")],
        "target_h_resolved": [near, resolved, -F.col("nh_to_h").cast("double"), balanced],
        "target_h_safe": [near, -F.col("nh_to_h").cast("double"), cross, balanced],
    }[name]


def best(points: DataFrame, key: Sequence[Column], params: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The point with the largest key, of each ``by``; ties go to the smaller parameters."""
    order = [*[F.col(p).alias(f"p{i}") for i, p in enumerate(params)]]
    ranked = F.min_by(F.struct(*points.columns), F.struct(*[(-k).alias(f"k{i}") for i, k in enumerate(key)], *order))
    return points.groupBy(*by).agg(ranked.alias("__best")).select("__best.*") if by else points.agg(ranked.alias("__best")).where("__best IS NOT NULL").select("__best.*")


def or_fallback(found: DataFrame, fallback: dict[str, float], base: DataFrame) -> DataFrame:
    """``found``, or, where it is empty, the base metrics under the fallback parameters."""
    other = base.withColumns({k: F.lit(v) for k, v in fallback.items()})
    both = found.withColumn("__first", F.lit(0)).unionByName(other.withColumn("__first", F.lit(1)), allowMissingColumns=True)
    return both.agg(F.min_by(F.struct(*found.columns), "__first").alias("r")).select("r.*")


def scored(distinct: DataFrame, grid: DataFrame, pred: Column, params: Sequence[str], truth: str = "y") -> DataFrame:
    """Metrics of every point of ``grid`` on distinct inputs with counts ``n``."""
    return distinct.crossJoin(F.broadcast(grid)).withColumn("__pred", pred).groupBy(*params).agg(*weighted_three_way(F.col(truth), F.col("__pred"), F.col("n")))
