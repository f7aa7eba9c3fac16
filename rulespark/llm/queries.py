"""The queries of this package, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm.decontamination import decontaminate
from rulespark.llm.html_blocks import extract
from rulespark.llm.language import identify
from rulespark.llm.minhash import near_duplicates
from rulespark.llm.packing import pack
from rulespark.llm.sharding import shard
from rulespark.llm.suffix_dedup import without_repeats
from rulespark.llm.tokens import token_counts
from rulespark.llm.topk import top_k
from rulespark.llm.toxicity import toxicity

TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), kind="byte")
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), kind="word", window=2048, end_id=1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained where crc32 of the id leaves another remainder than 2 of 4."""
    return identify(_table(spark, sf_dir, "documents"), part=2, of=4).select("doc_id", "held_out", "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items_sha256: of the sorted ids of the items, joined by commas."""
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts stay together; the law is that of near equal bytes."""
    placed = shard(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(_table(spark, sf_dir, "documents"), length=50)
    n_bytes = (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes")
    return kept.select("doc_id", n_bytes, "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, similarity=(80, 100))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned where crc32 of the id leaves another remainder than 1 of 3."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), part=1, of=3, bar=0.7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_top_k": op1_pivot_top_k,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_sharding": op7_sharding,
    "op8_repeated_strings": op8_repeated_strings,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
}
