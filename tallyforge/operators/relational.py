"""Relational operators whose semantics need more than one built-in: deduplication, checked joins, audits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in a stated total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_latest(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the latest; a missing time counts as latest of all."""
    return keep_first(df, keys, [F.col(by).desc_nulls_first(), *ties])


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys are not unique: {list(keys)}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), list(keys), how)


def exclude_any(df: DataFrame, others: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose key is in none of the other tables, each with a key of its own."""
    for other, key in others:
        df = df.join(other.select(key), key, "left_anti")
    return df


def tagged_union(tables: dict[str, DataFrame], tag: str = "source_batch") -> DataFrame:
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


BUCKETS = 4096


def _cuts(values: DataFrame, column: str, buckets: int) -> list:
    """At most ``buckets`` - 1 values that deal the column into ranges of about equal numbers of rows."""
    found = values.agg(F.percentile_approx(column, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(4 * buckets)).alias("q")).first()["q"]
    return sorted(set(found or []))


def counts_up_to(df: DataFrame, column: str, partition: Sequence[str] = (), weights: Sequence[str] = ("n",), buckets: int = 64) -> DataFrame:
    """Adds ``upto_<w>``: sums of each weight over the rows with a value of at most this row's, without a window over all rows.

    Values go to ranges between quantiles; sums of whole ranges come from a small table and only
    the rows of one range are ordered together.
    """
    cuts = _cuts(df, column, buckets)
    at = F.lit(0)
    if cuts:
        at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(column)))
    rows = df.withColumn("__b", at)
    per = rows.groupBy(*partition, "__b").agg(*[F.sum(w).alias(f"__{w}") for w in weights])
    before = Window.partitionBy(*partition).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({f"__before_{w}": F.coalesce(F.sum(f"__{w}").over(before), F.lit(0)) for w in weights}).drop(*[f"__{w}" for w in weights])
    named = per.select(*[F.col(p).alias(f"__p_{p}") for p in partition], F.col("__b").alias("__pb"), *[f"__before_{w}" for w in weights])
    on = F.col("__b") == F.col("__pb")
    for p in partition:
        on &= F.col(p).eqNullSafe(F.col(f"__p_{p}"))
    inside = Window.partitionBy(*partition, "__b").orderBy(column)
    joined = rows.join(F.broadcast(named) if not partition else named, on)
    return joined.withColumns({f"upto_{w}": F.col(f"__before_{w}") + F.sum(w).over(inside) for w in weights}).select(*df.columns, *[f"upto_{w}" for w in weights])


def percentile_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the share of known values that are not above this one; null for nulls.  Works on distinct values and their counts."""
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    ranks = counts_up_to(per, "__v").select("__v", (F.col("upto_n") / F.lit(max(total, 1))).alias(name))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")


def exact_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, columns): exact medians of the known values of each group, null where there are none.

    Two quantiles around the middle bracket each median; values inside the bracket are counted
    and ordered, those below it only counted, so no task holds a column.
    """
    e = 0.001
    quantiles = df.groupBy(*by).agg(*[F.percentile_approx(c, F.array(F.lit(0.5 - e), F.lit(0.5 + e)), 10_000).alias(f"__q{i}") for i, c in enumerate(columns)])
    keyed = quantiles.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], *[f"__q{i}" for i in range(len(columns))])
    on = F.lit(True)
    for i, b in enumerate(by):
        on &= F.col(b).eqNullSafe(F.col(f"__b{i}"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v"), F.col(f"__q{i}")[0].alias("lo"), F.col(f"__q{i}")[1].alias("hi")) for i, c in enumerate(columns)]))
    long = df.select(*by, *columns).join(keyed, on).select(*by, each.alias("x")).select(*by, "x.*").where("v IS NOT NULL")
    place = F.when(F.col("v") < F.col("lo"), F.lit(None)).when(F.col("v") > F.col("hi"), F.lit(float("inf"))).otherwise(F.col("v"))
    per = long.groupBy(*by, "i", place.alias("v")).agg(F.count(F.lit(1)).alias("n"))  # what is below or above the bracket is one row each
    w = Window.partitionBy(*by, "i")
    per = per.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy(F.col("v").asc_nulls_first())))
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    at = lambda rank: F.max(F.when(holds(rank), F.col("v")))
    middle = per.groupBy(*by, "i").agg(((at(F.floor((F.col("total") + 1) / 2)) + at(F.ceil((F.col("total") + 1) / 2))) / 2).alias("m"))
    return middle.groupBy(*by).pivot("i", list(range(len(columns)))).agg(F.first("m")).select(*by, *[F.col(str(i)).alias(c) for i, c in enumerate(columns)])


def repair_overlap(df: DataFrame, names: Sequence[str], left: str = "_x", right: str = "_y") -> DataFrame:
    """After a join that suffixed equal columns: one column each, the left value where it is known, else the right one."""
    for n in names:
        have = [c for c in (n + left, n + right) if c in df.columns]
        if have and n not in df.columns:
            df = df.withColumn(n, F.coalesce(*have)).drop(*have)
    return df


def suffixed_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left", left: str = "_x", right: str = "_y") -> DataFrame:
    """Join on ``keys``; other columns that both sides have get a suffix each."""
    both = [c for c in a.columns if c in b.columns and c not in keys]
    return a.withColumnsRenamed({c: c + left for c in both}).join(b.withColumnsRenamed({c: c + right for c in both}), list(keys), how)


def positional_concat(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Columns of both tables side by side, the k-th row of one with the k-th of the other in their stated orders."""
    rank = lambda df, order: global_rank(df, [F.col(c) for c in order], "__k")
    clash = {c: f"{c}_right" for c in b.columns if c in a.columns}
    return rank(a, order_a).join(rank(b, order_b).withColumnsRenamed(clash), "__k", "full").drop("__k")


def ordered_union(*groups: Sequence[str]) -> list[str]:
    """Names in order of first appearance."""
    return list(dict.fromkeys(x for g in groups for x in g))


def ordered_difference(names: Sequence[str], *drop: Sequence[str]) -> list[str]:
    gone = {x for g in drop for x in g}
    return [x for x in dict.fromkeys(names) if x not in gone]


_single: dict[str, str] = {}  # temporary folders of sessions on one machine, by application


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which outlives executors.

    Where the session names none, one on a single machine gets a temporary one; any other is
    refused, as its executors would each write to their own disk.
    """
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {context.master})")
        if context.applicationId not in _single:
            _single[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        folder = _single[context.applicationId]
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stable(df: DataFrame) -> DataFrame:
    """The table as it is now, for several uses, cut in the shared folder."""
    folder, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Numbers all rows from 1 in a total order without bringing them into one task.

    Rows are range-partitioned and sorted, and each gets its place in its partition; partition
    starts come from one small table of counts.  Both uses read one stored table, so a lost
    executor cannot change the cut.
    """
    kept = stable(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return kept.withColumn("__part", part).join(starts, "__part").withColumn(rank, F.col("__start") + row + 1).drop("__at", "__part", "__start")


def distribution(population: DataFrame, sample: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Counts and shares of each value combination in both tables, nulls as values of their own.

    One union and one conditional count; a full join would have to treat nulls apart.
    """
    both = population.select(*columns, F.lit(0).alias("__s")).unionByName(sample.select(*columns, F.lit(1).alias("__s")))
    counted = both.groupBy(*columns).agg(F.count_if(F.col("__s") == 0).alias("population_count"), F.count_if(F.col("__s") == 1).alias("sample_count"))
    everything = Window.partitionBy()
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(everything), F.lit(1))
    out = counted.withColumn("population_prop", share("population_count")).withColumn("sample_prop", share("sample_count"))
    out = out.withColumn("abs_prop_diff", F.abs(F.col("sample_prop") - F.col("population_prop")))
    value = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return out.select(F.lit(name).alias("distribution"), value.alias("value"), "population_count", "sample_count", "population_prop", "sample_prop", "abs_prop_diff")


def distributions(population: DataFrame, sample: DataFrame, groupings: dict[str, Sequence[str]]) -> DataFrame:
    parts = [distribution(population, sample, cols, name) for name, cols in groupings.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def marginals(df: DataFrame, flags: Sequence[str], value: str = "mean_value") -> DataFrame:
    """(flag, mean) rows; one aggregation, then unpivoted."""
    one = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags])
    return one.unpivot([], list(flags), "flag", value)
