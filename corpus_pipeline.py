"""A corpus pipeline: toxicity, line dedup, near-duplicates, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every result as Parquet and
reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.llm import line_templates, mixing, near_dup, sentencepiece_codec, toxicity
from frameledger.llm.common import MADE, Scratch, sweep, table, unused
from frameledger.llm.queries import tokenizer

#: Share of tokens that the mixture keeps.
MIX_KEEP = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, with all their columns; fitted on the documents given."""
    score = toxicity.scorer(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) < toxicity.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs; n_chars follows the text."""
    out = line_templates.line_dedup(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns; five words, similarity 0.8."""
    found = near_dup.near_duplicates(docs, near_dup.Forest(width=5, percent=80, depth=4, trees=30))
    name = unused("dropped", docs)
    dropped = found.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col(name), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled to the target weights, with all their columns."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text", "source", "lang")
    return mixing.mixed(whole, mixing.Targets(keep=MIX_KEEP)).where("mix_sampled").select("whole.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text decoded from them."""
    return sentencepiece_codec.encode_decode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("MinHash near-dedup", drop_near_duplicates), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = list(MADE)  # scratch of results that someone else may still read
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
        sweep(spark, besides=[*others, scratch.root])
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs


#: Network scores and sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
