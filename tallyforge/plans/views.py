"""The judged-item views over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources.files import table

NOTES = """SELECT CAST(o_orderkey AS STRING) AS note_id, o_orderkey AS note_key, o_custkey AS author_id,
  CASE o_orderstatus WHEN 'F' THEN 'CURRENTLY_RATED_HELPFUL' WHEN 'O' THEN 'NEEDS_MORE_RATINGS' ELSE 'CURRENTLY_RATED_NOT_HELPFUL' END AS current_status,
  CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS true_label_3way,
  CAST(year(o_orderdate) AS INT) AS created_year, o_orderpriority AS primary_topic, o_totalprice AS price FROM orders"""

VOTES = """SELECT CAST(l_orderkey AS STRING) AS note_id, concat('C', lpad(CAST(l_linenumber AS STRING), 2, '0')) AS agent_id, l_suppkey AS rater_id,
  CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS raw_label_id,
  CASE WHEN l_suppkey % 17 = 0 THEN -1 ELSE CAST(round(l_discount * 1000) AS INT) END AS confidence,
  CAST(l_quantity * 2 AS INT) AS understanding,
  CASE WHEN l_partkey % 11 = 0 THEN -1 WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS helpful_clear,
  CASE WHEN l_partkey % 13 = 0 THEN -1 WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS helpful_good_sources,
  CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS helpful_addresses_claim,
  CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS not_helpful_incorrect,
  CASE WHEN l_partkey % 6 = 0 THEN 1 ELSE 0 END AS not_helpful_missing_key_points,
  l_partkey AS ord1, l_suppkey AS ord2, l_extendedprice AS ord3 FROM lineitem"""

TEXTS = """SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

REPLIES = """SELECT CAST(event_id AS STRING) AS vote_id, user_id,
  concat('{"helpfulnessLevel":"', CASE event_type WHEN 'purchase' THEN 'HELPFUL' WHEN 'click' THEN 'somewhat-helpful' WHEN 'view' THEN 'Not Helpful' WHEN 'signup' THEN 'MAYBE' ELSE '' END,
  '","agree":', CAST(event_id % 2 AS STRING), ',"confidence":', CAST(value AS STRING), ',"props":', props, '}') AS raw_completion FROM events"""

HELPFUL = ("helpful_clear", "helpful_good_sources", "helpful_addresses_claim")
NOT_HELPFUL = ("not_helpful_incorrect", "not_helpful_missing_key_points")
AGENTS = tuple(f"C{i:02d}" for i in range(1, 8))

#: SQL with names for the views, for oracles.
WITH = f"WITH notes AS ({NOTES}), votes AS ({VOTES}), replies AS ({REPLIES}), texts AS ({TEXTS})"


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(NOTES.replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))


def votes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(VOTES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, folder, "lineitem"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(TEXTS.replace("FROM documents", "FROM {documents}").replace("JOIN labels", "JOIN {labels}"), documents=table(spark, folder, "documents"), labels=table(spark, folder, "labels"))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    # braces of the JSON frame would be read as names by spark.sql's formatter, so the view is built by columns
    from pyspark.sql import functions as F

    e = table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "purchase", "HELPFUL").when(F.col("event_type") == "click", "somewhat-helpful").when(F.col("event_type") == "view", "Not Helpful").when(F.col("event_type") == "signup", "MAYBE").otherwise("")
    raw = F.concat(F.lit('{"helpfulnessLevel":"'), kind, F.lit('","agree":'), (F.col("event_id") % 2).cast("string"), F.lit(',"confidence":'), F.col("value").cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}"))
    return e.select(F.col("event_id").cast("string").alias("vote_id"), "user_id", raw.alias("raw_completion"))
