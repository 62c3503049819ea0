"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next stage's documents; all but the last return the columns of documents.

1. quality_classifier: documents that score under the threshold go.
2. chosen_path_dedup: one document of each near-duplicate class stays, the one whose id names
   the class.
3. benchmark_decontamination: documents that hold a benchmark window go.
4. source_mix: each document occurs as often as the draw takes it (not at all, or up to
   three times, as repeated rows).
5. hilbert_shards: every row gets its shard and its place in it.

Null and empty texts: scored like any text, never near-duplicates, never contaminated, of
size 0 in the mix (so taken as often as their source's certain copies), and sharded.  Texts of
any length pass every stage whole.  Null ids: never near-duplicates of a named row, never
removed for their id.  Repeated rows: one of each stays at stage 2, and stage 4 may repeat it.
Ties in the draw go by a hash of the text, ties on the curve by checksum and id.  Empty tables
give no rows; without labels stage 1 keeps all, without benchmark items stage 3 does.  Extra
columns of the documents pass through the first four stages, whatever their names.

Tables that a stage needs only for itself are deleted once its result is written, and a stage's
result once the next one's is; what is left is the table that run() reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import chosenpath, decontaminate, hilbert, mixing, quality
from tallyforge.llm.queries import shard_digest, table
from tallyforge.llm.shared import delete, temporary, write


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(quality.fit_documents(docs, table(spark, sf_dir, "labels")), docs)


def chosen_path_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosenpath.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def hilbert_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_digest(hilbert.shard(hilbert.metadata(docs)))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("chosen_path_dedup", chosen_path_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("hilbert_shards", hilbert_shards),
]

#: SQL cannot express the classifier or the shingle join; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark):
            path = write(stage(spark, docs, sf_dir), name)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
