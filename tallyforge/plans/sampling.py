"""Sampling and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.operators import relational as rel
from tallyforge.operators import sampling as ops
from tallyforge.plans import views as v
from tallyforge.plans.declare import query

STRATA = ["created_year", "current_status", "primary_topic"]
_S = ", ".join(STRATA)
SIZE = 200
_HASH = "(note_key * 2654435761 + {seed}) % 4294967296"
COUNTS = f"counts AS (SELECT {_S}, count(*) AS n FROM notes GROUP BY {_S})"
ALLOC = f"""{COUNTS}, quotas AS (SELECT *, CAST(n AS DOUBLE) * {SIZE} / sum(n) OVER () AS quota FROM counts),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, {', '.join(f'{s} ASC NULLS FIRST' for s in STRATA)}) AS k, {SIZE} - sum(CAST(floor(quota) AS BIGINT)) OVER () AS spare FROM quotas),
alloc AS (SELECT {_S}, n, CAST(floor(quota) AS BIGINT) + CASE WHEN k <= spare THEN 1 ELSE 0 END AS allocated FROM ranked)"""
SAMPLE = f"""{ALLOC}, picked AS (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY {_HASH.format(seed=42)}, note_key) AS r FROM notes),
sample AS (SELECT p.* FROM picked p JOIN alloc a ON p.created_year = a.created_year AND p.current_status = a.current_status AND p.primary_topic = a.primary_topic WHERE p.r <= a.allocated)"""


def allocated(spark, d):
    return ops.allocate(ops.strata_counts(v.notes(spark, d), STRATA), STRATA, SIZE)


def sample(spark, d):
    return ops.draw(v.notes(spark, d), STRATA, allocated(spark, d), "note_key", 42)


@query(f"WITH {COUNTS} SELECT * FROM counts")
def strata_counts(spark, d):
    return ops.strata_counts(v.notes(spark, d), STRATA)


@query(f"WITH {ALLOC} SELECT * FROM alloc")
def allocate_strata(spark, d):
    return allocated(spark, d)


@query(f"""WITH RECURSIVE {{with}}, {ALLOC}, avail AS (SELECT {_S}, allocated, CAST(floor(n * 0.012) AS BIGINT) AS available FROM alloc),
base AS (SELECT *, least(allocated, available) AS given, greatest(available - allocated, 0) AS room FROM avail),
units AS (SELECT {_S}, room, unnest(range(1, room + 1)) AS round_no FROM base WHERE room > 0),
turns AS (SELECT *, row_number() OVER (ORDER BY round_no, room DESC, {', '.join(f'{s} ASC NULLS FIRST' for s in STRATA)}) AS turn FROM units),
extra AS (SELECT {_S}, count(*) AS more FROM turns WHERE turn <= (SELECT sum(allocated - given) FROM base) GROUP BY {_S})
SELECT b.created_year, b.current_status, b.primary_topic, b.allocated, b.available, b.given + coalesce(e.more, 0) AS final FROM base b LEFT JOIN extra e ON b.created_year = e.created_year AND b.current_status = e.current_status AND b.primary_topic = e.primary_topic""".replace("WITH RECURSIVE {with}, ", "WITH "))
def redistribute(spark, d):
    # availability is set so that some strata fall short and others have room
    a = allocated(spark, d).withColumn("available", F.floor(F.col("n") * 0.012).cast("long"))
    return ops.redistribute(a, STRATA)


@query(f"WITH {SAMPLE} SELECT row_number() OVER (ORDER BY {_HASH.format(seed=7)}, note_key) AS sample_id, note_id, {_S} FROM sample")
def stratified_sample(spark, d):
    from pyspark.sql import Window

    order = Window.orderBy(ops.hashed(F.col("note_key"), 7), "note_key")  # the sample's size is fixed, so one task orders it
    return sample(spark, d).select(F.row_number().over(order).cast("long").alias("sample_id"), "note_id", *STRATA)


@query(f"SELECT note_id, true_label_3way FROM (SELECT *, row_number() OVER (PARTITION BY true_label_3way ORDER BY {_HASH.format(seed=3)}, note_key) AS k FROM notes) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM notes GROUP BY true_label_3way))")
def balanced_subset(spark, d):
    return ops.balanced(v.notes(spark, d), "true_label_3way", "note_key", 3).select("note_id", "true_label_3way")


GROUPINGS = {"year": ["created_year"], "status": ["current_status"], "topic": ["primary_topic"], "joint": STRATA}
_BOTH = " UNION ALL ".join(
    f"""SELECT '{name}' AS distribution, value, population_count, sample_count, population_count / sum(population_count) OVER () AS population_prop, sample_count / sum(sample_count) OVER () AS sample_prop
FROM (SELECT concat_ws('|', {', '.join(f"coalesce(CAST({x} AS STRING), 'null')" for x in cols)}) AS value, count(CASE WHEN s = 0 THEN 1 END) AS population_count, count(CASE WHEN s = 1 THEN 1 END) AS sample_count FROM tagged GROUP BY {', '.join(cols)})"""
    for name, cols in GROUPINGS.items()
)
DIST = f"{SAMPLE}, tagged AS (SELECT {_S}, 0 AS s FROM notes UNION ALL SELECT {_S}, 1 AS s FROM sample), dist AS ({_BOTH})"


def audit(spark, d):
    return rel.distributions(v.notes(spark, d), sample(spark, d), GROUPINGS)


@query(f"WITH {DIST} SELECT distribution, value, population_count, sample_count, round(population_prop, 6) AS population_prop, round(sample_prop, 6) AS sample_prop, round(abs(sample_prop - population_prop), 6) AS abs_prop_diff FROM dist")
def distribution_check(spark, d):
    return audit(spark, d).select("distribution", "value", "population_count", "sample_count", *[c.r6(F.col(x)).alias(x) for x in ("population_prop", "sample_prop", "abs_prop_diff")])


@query(f"WITH {DIST} SELECT distribution, round(max(abs(sample_prop - population_prop)), 6) AS max_abs_diff FROM dist GROUP BY distribution")
def max_abs_diff(spark, d):
    return audit(spark, d).groupBy("distribution").agg(c.r6(F.max("abs_prop_diff")).alias("max_abs_diff"))


@query("SELECT count(*) AS notes, count(DISTINCT author_id) AS authors, count(DISTINCT primary_topic) AS topics, count(DISTINCT created_year) AS years FROM notes")
def sample_summary(spark, d):
    return v.notes(spark, d).agg(F.count(F.lit(1)).alias("notes"), *[F.count_distinct(x).alias(n) for x, n in (("author_id", "authors"), ("primary_topic", "topics"), ("created_year", "years"))])


@query(f"SELECT note_id, true_label_3way, CAST((row_number() OVER (PARTITION BY true_label_3way ORDER BY {_HASH.format(seed=5)}, note_key) - 1) % 5 AS INT) AS fold FROM notes")
def stratified_folds(spark, d):
    return ops.folds(v.notes(spark, d), "true_label_3way", "note_key", 5, 5).select("note_id", "true_label_3way", "fold")


_STATUSES = ["CURRENTLY_RATED_HELPFUL", "CURRENTLY_RATED_NOT_HELPFUL", "NEEDS_MORE_RATINGS"]
_PICK = 500
_QUOTA = " ".join(f"WHEN current_status = '{x}' THEN {_PICK // 3 + (i < _PICK % 3)}" for i, x in enumerate(_STATUSES))


@query(f"""WITH few AS (SELECT * FROM notes WHERE current_status <> 'CURRENTLY_RATED_NOT_HELPFUL' OR note_key % 40 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY current_status ORDER BY {_HASH.format(seed=3)}, note_key) <= CASE {_QUOTA} END AS chosen FROM few),
pool AS (SELECT *, row_number() OVER (ORDER BY {_HASH.format(seed=4)}, note_key) AS k FROM ranked WHERE NOT chosen)
SELECT note_id, current_status FROM ranked WHERE chosen UNION ALL SELECT note_id, current_status FROM pool WHERE k <= {_PICK} - (SELECT count(*) FROM ranked WHERE chosen)""")
def balanced_selection(spark, d):
    # one class is thinned out, so that the others have to top it up
    few = v.notes(spark, d).where("current_status <> 'CURRENTLY_RATED_NOT_HELPFUL' OR note_key % 40 = 0")
    return ops.balanced_of_size(few, "current_status", _STATUSES, "note_key", 3, _PICK).select("note_id", "current_status")


@query("SELECT 'head' AS mode, note_id FROM (SELECT note_id FROM notes ORDER BY note_key LIMIT 300) UNION ALL SELECT 'whole', note_id FROM notes")
def selection_modes(spark, d):
    n = v.notes(spark, d).select("note_id", "note_key")
    named = lambda df, mode: df.select(F.lit(mode).alias("mode"), "note_id")
    return named(ops.head(n, ["note_key"], 300), "head").unionByName(named(ops.head(n, ["note_key"], 0), "whole"))


_ROUNDS = 200


@query(f"""WITH g AS (SELECT count(*) AS n, count(CASE WHEN true_label_3way = 2 THEN 1 END) AS hits FROM notes), u AS (SELECT n, hits / n AS p, {ops.uniform_sql('range', 9)} AS u FROM range({_ROUNDS}), g),
z AS (SELECT n, p, {ops.normal_sql('u')} AS z FROM u), acc AS (SELECT {ops.binomial_sql('n', 'p', 'z')} / n AS accuracy FROM z)
SELECT round(avg(accuracy), 9) AS mean_accuracy, round(quantile_cont(accuracy, 0.025), 9) AS low, round(quantile_cont(accuracy, 0.975), 9) AS high FROM acc""")
def bootstrap_ci(spark, d):
    counted = v.notes(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("true_label_3way") == 2).alias("hits"))
    rounds = ops.bootstrap(counted, _ROUNDS, 9)
    q = F.percentile("share", F.array(F.lit(0.025), F.lit(0.975)))
    return rounds.agg(F.round(F.avg("share"), 9).alias("mean_accuracy"), q.alias("q")).select("mean_accuracy", F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"))
