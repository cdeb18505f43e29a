"""A training corpus from raw documents: five stages, each stored as Parquet.

Every stage gets what its predecessor kept and returns the columns of
``documents``; the last one returns token ids. The stages are judged one by one
and in sequence by the tests, since SQL can't express the line labels, the cube
method or the merges.

In every stage null and empty texts are texts without words, a null id is kept
as it is, rows that repeat are rows of their own until a stage removes copies
(exact dedup and the Jaccard join keep one of each), further columns are carried
along, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import byte_bpe, exact_dedup, mixing, ngram_jaccard, quality_rules
from driftline.llm.common import stored

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep; the CRF learns
    from the labelled ones among ``docs``. Rows of one id and equal columns
    share a verdict, and every one of them stays or goes."""
    crf = quality_rules.train_crf(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return quality_rules.keep_rows(rows, crf).select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest id."""
    return exact_dedup.keep_first(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a
    similarity of 0.8 or more."""
    return ngram_jaccard.keep_one(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: token ids as packed 32-bit integers."""
    # Small caches, released after each task: here executors also hold what
    # the stages before shuffled, and a next run starts with its other stages.
    encoded = byte_bpe.encode_documents(docs, cache=100_000, keep=False)
    return encoded.select("doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard", jaccard_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one writes the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
