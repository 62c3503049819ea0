"""Ingestion and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.operators import relational as rel
from tallyforge.plans import views as v
from tallyforge.plans.declare import query
from tallyforge.sources import files


@query("SELECT note_id, current_status FROM notes WHERE created_year = 1997")
def scan_prune(spark, d):
    return files.scan(v.notes(spark, d), ["note_id", "current_status"], F.col("created_year") == 1997)


@query("SELECT note_id, current_status, price FROM notes WHERE current_status IN ('CURRENTLY_RATED_HELPFUL', 'CURRENTLY_RATED_NOT_HELPFUL') AND price > 0 AND trim(primary_topic) <> ''")
def frame_filter(spark, d):
    ok = F.col("current_status").isin("CURRENTLY_RATED_HELPFUL", "CURRENTLY_RATED_NOT_HELPFUL") & (F.col("price") > 0) & (F.trim("primary_topic") != "")
    return files.scan(v.notes(spark, d), ["note_id", "current_status", "price"], ok)


@query("""SELECT note_id, CASE current_status WHEN 'CURRENTLY_RATED_HELPFUL' THEN 'HELPFUL' WHEN 'NEEDS_MORE_RATINGS' THEN 'NEEDS_MORE_RATINGS' ELSE 'NOT_HELPFUL' END AS label,
  true_label_3way AS class_id, CASE true_label_3way WHEN 2 THEN 1 WHEN 0 THEN 0 END AS binary_id FROM notes""")
def status_label(spark, d):
    s = F.col("current_status")
    return v.notes(spark, d).select("note_id", c.status_label(s).alias("label"), c.status_class(s).alias("class_id"), c.binary_class(c.status_class(s)).alias("binary_id"))


@query("SELECT note_id, TRY_CAST(trim(split_part(primary_topic, '-', 1)) AS DOUBLE) AS level, TRY_CAST(primary_topic AS DOUBLE) AS whole FROM notes")
def coerce_numeric(spark, d):
    t = F.col("primary_topic")
    return v.notes(spark, d).select("note_id", c.coerce_numeric(F.split_part(t, F.lit("-"), F.lit(1))).alias("level"), c.coerce_numeric(t).alias("whole"))


@query("""SELECT agent_id, CAST(sum(CASE WHEN helpful_clear > 0 THEN helpful_clear ELSE 0 END) AS DOUBLE) AS zero_sum,
  CAST(sum(CASE WHEN helpful_clear >= 0 THEN helpful_clear END) AS DOUBLE) AS null_sum, count(CASE WHEN helpful_clear >= 0 THEN 1 END) AS null_n, CAST(sum(helpful_clear) AS DOUBLE) AS raw_sum FROM votes GROUP BY agent_id""")
def clean_indicator(spark, d):
    x = F.col("helpful_clear")
    return v.votes(spark, d).groupBy("agent_id").agg(F.sum(c.indicator(x)).alias("zero_sum"), F.sum(c.indicator(x, "null")).alias("null_sum"), F.count(c.indicator(x, "null")).alias("null_n"), F.sum(c.indicator(x, "raw")).alias("raw_sum"))


_FLAGS = [*v.HELPFUL, *v.NOT_HELPFUL]
_FLAG_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS flag, round(avg(CASE WHEN {f} = 1 THEN 1.0 ELSE 0.0 END), 6) AS population_mean, round(avg(CASE WHEN raw_label_id = 1 THEN CASE WHEN {f} = 1 THEN 1.0 ELSE 0.0 END END), 6) AS sample_mean, "
    f"round(abs(avg(CASE WHEN {f} = 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN raw_label_id = 1 THEN CASE WHEN {f} = 1 THEN 1.0 ELSE 0.0 END END)), 6) AS abs_diff FROM votes"
    for f in _FLAGS
)


@query(_FLAG_SQL)
def flag_marginals(spark, d):
    flags = v.votes(spark, d).withColumns({f: (c.flag(F.col(f)) == 1).cast("int") for f in _FLAGS})
    both = rel.marginals(flags, _FLAGS, "population_mean").join(rel.marginals(flags.where("raw_label_id = 1"), _FLAGS, "sample_mean"), "flag")
    return both.select("flag", c.r6(F.col("population_mean")).alias("population_mean"), c.r6(F.col("sample_mean")).alias("sample_mean"), c.r6(F.abs(F.col("population_mean") - F.col("sample_mean"))).alias("abs_diff"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS created_at, CAST(year(ts) AS INT) AS created_year FROM events", views=False)
def created_year(spark, d):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    at = F.timestamp_millis(millis)
    return files.table(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.year(at).alias("created_year"))


@query("SELECT note_id, agent_id, raw_label_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY note_id, agent_id ORDER BY ord1 DESC, ord2, ord3) AS k FROM votes) WHERE k = 1")
def dedup_latest(spark, d):
    return rel.keep_latest(v.votes(spark, d), ["note_id", "agent_id"], "ord1", [F.col("ord2"), F.col("ord3")]).select("note_id", "agent_id", "raw_label_id", "confidence")


@query("SELECT note_id, agent_id, raw_label_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY note_id, agent_id ORDER BY ord1, ord2, ord3) AS k FROM votes) WHERE k = 1")
def dedup_first(spark, d):
    return rel.keep_first(v.votes(spark, d), ["note_id", "agent_id"], [F.col("ord1"), F.col("ord2"), F.col("ord3")]).select("note_id", "agent_id", "raw_label_id", "confidence")


@query("SELECT n.note_id, n.current_status, s.n_votes FROM notes n JOIN (SELECT note_id, count(*) AS n_votes FROM votes GROUP BY note_id) s ON n.note_id = s.note_id")
def one_to_one_join(spark, d):
    counted = v.votes(spark, d).groupBy("note_id").agg(F.count(F.lit(1)).alias("n_votes"))
    return rel.one_to_one(v.notes(spark, d).select("note_id", "current_status"), counted, ["note_id"])


@query("SELECT note_id, agent_id, raw_label_id, ord1 FROM votes WHERE note_id IN (SELECT note_id FROM notes WHERE true_label_3way = 2)")
def semi_join(spark, d):
    ids = v.notes(spark, d).where("true_label_3way = 2").select("note_id")
    return v.votes(spark, d).join(ids, "note_id", "left_semi").select("note_id", "agent_id", "raw_label_id", "ord1")


@query("SELECT note_id, author_id FROM notes WHERE note_id NOT IN (SELECT note_id FROM votes) AND author_id NOT IN (SELECT rater_id FROM votes WHERE raw_label_id = 2)")
def anti_join(spark, d):
    votes = v.votes(spark, d)
    others = [(votes, "note_id"), (votes.where("raw_label_id = 2").select(F.col("rater_id").alias("author_id")), "author_id")]
    return rel.exclude_any(v.notes(spark, d).select("note_id", "author_id"), others)


@query("SELECT 'base' AS source_batch, note_id, price, CAST(NULL AS INT) AS created_year FROM notes WHERE created_year < 1996 UNION ALL SELECT 'supplement', note_id, NULL, created_year FROM notes WHERE created_year >= 2000")
def union_tag(spark, d):
    n = v.notes(spark, d)
    return rel.tagged_union({"base": n.where("created_year < 1996").select("note_id", "price"), "supplement": n.where("created_year >= 2000").select("note_id", "created_year")}).select("source_batch", "note_id", "price", "created_year")


@query("SELECT CASE WHEN event_type <> 'error' THEN 'success' ELSE 'failed' END AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", views=False)
def split_by_status(spark, d):
    good, bad = files.split_by(files.table(spark, d, "events"), F.col("event_type") != "error")
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.lit(name).alias("part"), "n", "total")
    return total(good, "success").unionByName(total(bad, "failed")).where("n > 0")


@query("SELECT note_id, concat(true_label_3way, '__', CASE WHEN n >= 3 THEN 'high' WHEN n <= 1 THEN 'low' ELSE 'mid' END) AS band FROM (SELECT n.note_id, n.true_label_3way, count(v.agent_id) AS n FROM notes n LEFT JOIN votes v ON n.note_id = v.note_id GROUP BY 1, 2)")
def band_key(spark, d):
    n = v.notes(spark, d).join(v.votes(spark, d).groupBy("note_id").agg(F.count(F.lit(1)).alias("n")), "note_id", "left")
    size = F.coalesce("n", F.lit(0))
    return n.select("note_id", F.concat_ws("__", F.col("true_label_3way").cast("string"), F.when(size >= 3, "high").when(size <= 1, "low").otherwise("mid")).alias("band"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL", views=False)
def json_ingest(spark, d):
    return files.parse_json_lines(files.table(spark, d, "events").select("event_id", "props"), "props", "k bigint").select("event_id", "k")


@query("SELECT note_id, row_number() OVER (ORDER BY created_year DESC, primary_topic, price DESC, note_key) AS rank FROM notes")
def multi_key_sort(spark, d):
    order = [F.col("created_year").desc(), F.col("primary_topic"), F.col("price").desc(), F.col("note_key")]
    return rel.global_rank(v.notes(spark, d).select("note_id", "note_key", "created_year", "primary_topic", "price"), order).select("note_id", "rank")


@query("""WITH a AS (SELECT note_id, CASE WHEN note_key % 3 = 0 THEN NULL ELSE created_year END AS topic_count, price FROM notes), b AS (SELECT note_id, created_year + 1 AS topic_count, current_status FROM notes WHERE note_key % 5 <> 0)
SELECT a.note_id, a.price, b.current_status, coalesce(a.topic_count, b.topic_count) AS topic_count FROM a LEFT JOIN b ON a.note_id = b.note_id""")
def overlap_repair(spark, d):
    n = v.notes(spark, d)
    a = n.select("note_id", F.when(F.col("note_key") % 3 != 0, F.col("created_year")).alias("topic_count"), "price")
    b = n.where("note_key % 5 <> 0").select("note_id", (F.col("created_year") + 1).alias("topic_count"), "current_status")
    return rel.repair_overlap(rel.suffixed_join(a, b, ["note_id"]), ["topic_count"]).select("note_id", "price", "current_status", "topic_count")


@query("""WITH a AS (SELECT note_id, row_number() OVER (ORDER BY note_key) AS k FROM notes), b AS (SELECT author_id, row_number() OVER (ORDER BY price, note_key) AS k FROM notes WHERE note_key % 4 <> 0)
SELECT a.note_id, b.author_id FROM a FULL JOIN b ON a.k = b.k""")
def positional_concat(spark, d):
    n = v.notes(spark, d).select("note_id", "note_key", "author_id", "price")
    return rel.positional_concat(n.select("note_id", "note_key"), n.where("note_key % 4 <> 0").select("author_id", "price", F.col("note_key").alias("k2")), ["note_key"], ["price", "k2"]).select("note_id", "author_id")
