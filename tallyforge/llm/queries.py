"""The registered queries of the training-data operators: thin digests over each operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import alignment, ann, chosenpath, decontaminate, hilbert, licences, mixing, pages, pii, quality, secrets, sql, tokenfiles, whitening
from tallyforge.llm.shared import save


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*secrets.BASE))
    counts = [secrets.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    counts = [secrets.count_kind(base, k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        (n_hit := decontaminate.hit_words(F.col("runs"))).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        "permissive",
    )


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(hilbert.shard(hilbert.metadata(table(spark, sf_dir, "documents"))))


def shard_digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op10_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return tokenfiles.summary(spark, tokenfiles.encode_files(table(spark, sf_dir, "documents"), vocabulary))


def op11_alignment(spark: SparkSession, sf_dir: str, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    if byte_path is None or piece_path is None:
        import public_tokenizers

        byte_path, piece_path = byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents"), byte_path, piece_path)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    stored = save(alignment.numbered(found.withColumn("groups_sha256", digest).drop("groups")), "aligned")
    return alignment.link_scores(stored).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "pages")
    text = F.array_join("blocks", "\n\n")
    return pages.extract(given.withColumn("__key", F.struct("page_id", "url")), "__key").select("__key.page_id", "__key.url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


QUERIES = {"op1_secrets": op1_secrets, "op2_pii": op2_pii, "op3_chosen_path": op3_chosen_path, "op4_decontaminate": op4_decontaminate, "op5_multi_index": op5_multi_index, "op6_mix": op6_mix, "op7_quality": op7_quality, "op8_licences": op8_licences, "op9_hilbert_shards": op9_hilbert_shards, "op10_token_files": op10_token_files, "op11_alignment": op11_alignment, "op12_whitening": op12_whitening, "op13_html_text": op13_html_text}
ORACLES: dict[str, str] = {"op3_chosen_path": sql.OP3, "op4_decontaminate": sql.OP4, "op6_mix": sql.OP6}
