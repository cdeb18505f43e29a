"""Exact duplicates by whole content: local, salted and global combining.

DataFrame functions only. A group of copies may hold any share of the rows:
copies are combined inside each task (partial aggregate), what is left is
merged in salted digest groups, and the at most ``salts`` winners of a digest
are combined at last. Every stage groups by the digest *and* the full
normalised text, so equal digests of different texts never merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import SPACES, stored


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_winners(rows: DataFrame, salts: int = 32) -> DataFrame:
    """``digest, norm, keep_id, group_size`` per content.

    ``rows``: ``doc_id, digest, norm``.
    """
    salted = rows.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    )
    merged = salted.groupBy("digest", "salt", "norm").agg(
        F.min("doc_id").alias("lo"), F.count("*").alias("n")
    )
    # One shuffle on the digest serves this stage and the one per digest.
    return merged.repartition("digest").groupBy("digest", "norm").agg(
        F.min("lo").alias("keep_id"), F.sum("n").alias("group_size")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    * null text: the empty text; all empty texts are one group
    * null id: never the smallest unless a group has no other id; then
      ``keep_id`` is null and one row of the group is kept
    * repeated rows (same id and text): one of them is kept
    * empty table: empty result; other columns of ``docs`` are not read
    * two different texts with one SHA-256 digest: the job fails with a
      message (the content comparison finds them), it never merges them
    """
    norm = normalised(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), norm.alias("norm")).select(
        "doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest")
    )
    winners = content_winners(rows, salts)
    per_digest = winners.groupBy("digest").agg(
        F.count("*").alias("contents"),
        F.min("keep_id").alias("keep_id"),
        F.min("group_size").alias("group_size"),
    )
    clash = F.raise_error(F.concat(F.lit("texts differ under digest "), F.hex("digest")))
    per_digest = per_digest.select(
        "digest", "keep_id",
        F.when(F.col("contents") == 1, F.col("group_size")).otherwise(clash.cast("long")).alias("group_size"),
    )
    # Narrow rows only. The stored side is dealt out anew for the join, so that
    # the adaptive skew join can split the digest of a hot group.
    per_digest = stored(per_digest, "winners")
    joined = rows.select("doc_id", "digest").join(per_digest, "digest")
    # Rows of one id and text: exactly one is the keeper. They are dealt by id,
    # so that a hot digest is not gathered again; null ids, whose hash is one
    # and the same number, by their digest.
    dealt = joined.withColumn(
        "deal", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_id"))
    ).repartition("deal")
    same = Window.partitionBy("deal", "digest", "doc_id").orderBy("group_size")
    return dealt.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that agree in id and text any one is taken: only such rows share a
    window.
    """
    ids = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("k_id"), F.unhex("text_sha256").alias("k_digest")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("digest"),
    )
    kept = rows.join(
        ids, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest")), "left_semi"
    )
    one = Window.partitionBy("digest", "id").orderBy(F.lit(1))
    return kept.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")
