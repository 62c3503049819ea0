"""Rater clusters and personas: features, profiles, percentile bands, names and tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.relational import exact_medians, percentile_rank


def rater_features(raters: DataFrame, features: Sequence[str], least: int = 2) -> DataFrame:
    """Rows with at least ``least`` known features; gaps filled with the exact median."""
    known = sum((F.col(f).isNotNull().cast("int") for f in features[1:]), F.col(features[0]).isNotNull().cast("int"))
    kept = raters.where(known >= least)
    found = exact_medians(kept, features).first()
    return kept.withColumns({f: F.coalesce(f, F.lit(float(found[f] or 0.0) if found else 0.0)) for f in features})


def cluster_profile(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Size, means, medians and share of all rows of each cluster."""
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_raters"), *[F.avg(f).alias(f"mean_{f}") for f in features])
    medians = exact_medians(df, features, [cluster]).select(F.col(cluster).alias("__c"), *[F.col(f).alias(f"median_{f}") for f in features])
    out = out.join(medians, F.col(cluster).eqNullSafe(F.col("__c")), "left").drop("__c")
    return out.withColumn("share", F.col("n_raters") / F.sum("n_raters").over(Window.partitionBy()))


#: One test of a rule: statistic, comparison, limit.
Test = tuple[str, str, float]
_COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}

# The names of clusters, in the order in which they are tried: (name, whether any test is enough, tests).
NAMES: list[tuple[str, bool, list[Test]]] = [
    ("low-agreement idiosyncratic rater", True, [("agreement", "<", 0.2)]),
    ("mixed-agreement boundary-case rater", True, [("agreement", "<", 0.65)]),
    ("skeptical low-score rater", True, [("status_gap", "<", -1.0), ("mean_note", "<", 0.02)]),
    ("positive high-context rater", True, [("status_gap", ">", 0.15), ("mean_note", ">", 0.25)]),
    ("high-helpfulness positive-axis rater", False, [("pass_rate", ">=", 0.75), ("axis", ">", 0.30)]),
    ("high-helpfulness negative-axis rater", False, [("pass_rate", ">=", 0.75), ("axis", "<", -0.30)]),
    ("strict unresolved-prone rater", True, [("pass_rate", "<", 0.25)]),
]
NAME_ELSE = "mainstream consensus rater"
# What stands for a statistic that is not known.
NAME_GAPS = {"agreement": 0.5, "pass_rate": 0.5, "mean_note": 0.1, "status_gap": 0.0, "axis": 0.0}

# What is said of the share of Helpful less that of Not Helpful judgments.
TENDENCIES: list[tuple[str, bool, list[Test]]] = [
    ("is strongly tilted toward Helpful judgments", True, [("margin", ">=", 0.35)]),
    ("is mildly tilted toward Helpful judgments", True, [("margin", ">=", 0.15)]),
    ("is strongly tilted toward Not Helpful judgments", True, [("margin", "<=", -0.25)]),
    ("is mildly tilted toward Not Helpful judgments", True, [("margin", "<=", -0.10)]),
]
TENDENCY_ELSE = "is broadly balanced in positive versus negative judgments"

# What is said of recent changes.
DRIFTS: list[tuple[str, bool, list[Test]]] = [
    ("it has recently become more willing to endorse notes", True, [("endorsing", ">=", 0.08)]),
    ("it has recently become less willing to endorse notes", True, [("endorsing", "<=", -0.08)]),
    ("it has recently become more likely to reject notes", True, [("rejecting", ">=", 0.08)]),
    ("its recent rejection tendency has softened", True, [("rejecting", "<=", -0.08)]),
]
DRIFT_ELSE = "its recent behavior is broadly stable"

# What is said of the notes that raters write themselves.
AUTHORINGS: list[tuple[str, bool, list[Test]]] = [
    ("these users almost never write notes themselves and behave more like pure raters", True, [("written", "<", 1)]),
    ("when they write notes, those notes succeed relatively often", True, [("accepted", ">=", 0.20)]),
    ("they do write notes, but their authored notes are rejected fairly often", True, [("refused", ">=", 0.15)]),
]
AUTHORING_ELSE = "they write some notes, but are not especially strong or especially weak as note authors"
AUTHORING_UNKNOWN = "author-side behavior is not explicitly measured here"

# Percentile ranks and the words for them.
BANDS: list[tuple[str, bool, list[Test]]] = [
    ("very {high}", True, [("rank", ">=", 0.8)]),
    ("moderately {high}", True, [("rank", ">=", 0.6)]),
    ("very {low}", True, [("rank", "<=", 0.2)]),
    ("moderately {low}", True, [("rank", "<=", 0.4)]),
]
BAND_ELSE = "middle"


def first_match(rules: Sequence[tuple[str, bool, list[Test]]], values: dict[str, Column], otherwise: str) -> Column:
    """Text of the first rule that holds; a test of an unknown value does not."""
    out = F.lit(otherwise)
    for text, any_is_enough, tests in reversed(rules):
        held = [F.coalesce(_COMPARE[op](values[name], F.lit(limit)), F.lit(False)) for name, op, limit in tests]
        whole = held[0]
        for h in held[1:]:
            whole = whole | h if any_is_enough else whole & h
        out = F.when(whole, text).otherwise(out)
    return out


def band(value: Column, rank: Column, high: str, low: str) -> Column:
    """Words for a percentile rank (share of values not above this one); the middle for nulls."""
    named = [(text.format(high=high, low=low), any_, tests) for text, any_, tests in BANDS]
    return F.when(value.isNull(), BAND_ELSE).otherwise(first_match(named, {"rank": rank}, BAND_ELSE))


def bands(df: DataFrame, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds ``<column>_band`` for each column; nulls are not ranked."""
    for name, (high, low) in specs.items():
        df = percentile_rank(df, name, "__rank").withColumn(f"{name}_band", band(F.col(name), F.col("__rank"), high, low)).drop("__rank")
    return df


def named(statistics: dict[str, Column]) -> Column:
    """Name of a cluster by its first matching rule."""
    return first_match(NAMES, {k: F.coalesce(statistics[k], F.lit(v)) for k, v in NAME_GAPS.items()}, NAME_ELSE)


def tendency(helpful: Column, not_helpful: Column) -> Column:
    return first_match(TENDENCIES, {"margin": helpful - not_helpful}, TENDENCY_ELSE)


def drift(endorsing: Column, rejecting: Column) -> Column:
    known = endorsing.isNotNull() & rejecting.isNotNull()
    return F.when(known, first_match(DRIFTS, {"endorsing": endorsing, "rejecting": rejecting}, DRIFT_ELSE)).otherwise(DRIFT_ELSE)


def authoring(accepted: Column, refused: Column, written: Column) -> Column:
    return F.when(written.isNull(), AUTHORING_UNKNOWN).otherwise(first_match(AUTHORINGS, {"written": written, "accepted": accepted, "refused": refused}, AUTHORING_ELSE))


def profile(lines: Sequence[Column]) -> Column:
    """The lines that are known, one below the other."""
    return F.concat_ws("\n", *lines)


def request(template: str, fields: dict[str, Column]) -> Column:
    """The template with each {name} replaced by the field's trimmed text (empty where it is null)."""
    parts, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [F.lit(before), F.trim(F.coalesce(fields[name].cast("string"), F.lit("")))]
    return F.concat(*parts, F.lit(rest))


def tasks(items: DataFrame, agents: DataFrame, prompt: Column) -> DataFrame:
    """Every item with every agent; agents are a short list and broadcast."""
    return items.crossJoin(F.broadcast(agents)).withColumn("prompt", prompt)


def silhouette(df: DataFrame, cluster: str, vector: str, dim: int) -> DataFrame:
    """(silhouette): mean silhouette on squared distances, from per-cluster sums, so no pairs are formed.

    The mean squared distance of a row to a cluster of n rows with sum S and sum of squared norms
    Q is |x|^2 - 2 x.S/n + Q/n.  A row alone in its cluster counts 0.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    rows = df.select(F.col(cluster).alias("c"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    rows = rows.withColumn("xx", dot(F.col("x"), F.col("x")))
    sums = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("xx").alias("q"), F.array(*[F.sum(F.element_at("x", i + 1)) for i in range(dim)]).alias("s"))
    every = sums.agg(F.collect_list(F.struct("c", "n", "q", "s")).alias("all"))  # one row per cluster
    away = F.transform("all", lambda o: F.struct(o["c"].alias("c"), o["n"].alias("n"), (F.col("xx") - 2 * dot(F.col("x"), o["s"]) / o["n"] + o["q"] / o["n"]).alias("d")))
    seen = rows.crossJoin(F.broadcast(every)).select("c", away.alias("o"))
    own = F.element_at(F.filter("o", lambda o: o["c"] == F.col("c")), 1)
    near = F.array_min(F.transform(F.filter("o", lambda o: o["c"] != F.col("c")), lambda o: o["d"]))
    seen = seen.select(own.alias("own"), near.alias("b")).withColumn("a", F.col("own.d") * F.col("own.n") / F.nullif(F.col("own.n") - 1, F.lit(0)))
    value = F.when(F.col("own.n") == 1, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return seen.agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("silhouette"))


def cluster_quality(df: DataFrame, cluster: str, vector: str, dim: int | None = None) -> DataFrame:
    """Inertia, Calinski-Harabasz and Davies-Bouldin of labelled vectors, from per-cluster sums.

    All components count, or the first ``dim``; one job reads how many the vectors have.
    """
    if dim is None:
        dim = df.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 1
    x = [F.element_at(F.col(vector), i + 1).cast("double") for i in range(dim)]
    df = df.select(F.col(cluster).alias("cluster"), *[x[i].alias(f"x{i}") for i in range(dim)])
    centers = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"c{i}") for i in range(dim)])
    squared = sum(((F.col(f"x{i}") - F.col(f"c{i}")) ** 2 for i in range(1, dim)), (F.col("x0") - F.col("c0")) ** 2)
    per = df.join(F.broadcast(centers), "cluster").withColumn("d2", squared).groupBy("cluster").agg(F.sum("d2").alias("within"), F.avg(F.sqrt("d2")).alias("scatter"))
    c = centers.join(per, "cluster")
    whole = df.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(dim)])
    between = sum(((F.col(f"c{i}") - F.col(f"m{i}")) ** 2 for i in range(1, dim)), (F.col("c0") - F.col("m0")) ** 2)
    ch = c.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * between).alias("b"), F.sum("within").alias("w"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    a, b = c.alias("a"), c.alias("b")
    apart = F.sqrt(sum(((F.col(f"a.c{i}") - F.col(f"b.c{i}")) ** 2 for i in range(1, dim)), (F.col("a.c0") - F.col("b.c0")) ** 2))
    worst = a.join(F.broadcast(b), F.col("a.cluster") != F.col("b.cluster")).groupBy("a.cluster").agg(F.max((F.col("a.scatter") + F.col("b.scatter")) / apart).alias("worst"))
    db = worst.agg(F.avg("worst").alias("davies_bouldin"))
    return ch.crossJoin(db).select("k", "n", F.col("w").alias("inertia"), ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), "davies_bouldin")
