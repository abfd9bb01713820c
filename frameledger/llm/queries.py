"""The queries of this package: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_templates, mixing, near_dup, secret_scan, sentencepiece_codec, sharding, token_counts, topk_search, toxicity
from .common import digest, table

OVER = 2048


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256")
    )


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.Forest(width=3, percent=85, depth=5, trees=24))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > OVER)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "mix_tokens", "mix_cell", "mix_probability", "mix_sampled")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_topk_search, op3_sharding, op4_secret_scan, op5_near_dedup, op6_token_counts, op7_mixing, op8_line_dedup, op9_exact_dedup, op10_toxicity)}
ORACLES = {"op2_topk_search": topk_search.ORACLE, "op5_near_dedup": near_dup.ORACLE, "op8_line_dedup": line_templates.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
