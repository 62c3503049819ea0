"""Vote log as a stream: deduplicated by vote key and kept as running totals per item.

An extension of the append-log and snapshot behaviour; batch and stream share the aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.files import read_progress, write_progress

SCHEMA = "note_id string, agent_id string, raw_label_id int, confidence double, at timestamp"


def vote_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """New files of JSON votes in a folder."""
    return spark.readStream.schema(schema).json(folder)


def running_summary(votes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Totals per item; a vote counts once, and its key is remembered only while it can still be repeated."""
    once = votes.withWatermark("at", late).dropDuplicatesWithinWatermark(["note_id", "agent_id"])
    return once.groupBy("note_id").agg(
        F.count(F.lit(1)).alias("n_votes"),
        F.count_if(F.col("raw_label_id") >= 0).alias("valid_votes"),
        *[F.count_if(F.col("raw_label_id") == k).alias(f"vote_{n}") for n, k in (("nh", 0), ("sh", 1), ("h", 2))],
        F.avg("confidence").alias("mean_confidence"),
    )


def start_snapshots(summary: DataFrame, path: str, checkpoint: str):
    """Writes the running totals of each trigger as a table of its own; the record of the newest one is replaced as a whole."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = read_progress(spark, f"{path}/newest.json")
        batch.withColumn("snapshot", F.lit(number)).write.mode("overwrite").parquet(f"{path}/snapshot-{number}")
        write_progress(spark, f"{path}/newest.json", {"number": number, "folder": f"snapshot-{number}", "before": (last or {}).get("folder")})

    return summary.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole snapshot."""
    return spark.read.parquet(f"{path}/{read_progress(spark, f'{path}/newest.json')['folder']}")
