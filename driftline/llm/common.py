"""Shared helpers: stored intermediate tables and row functions on Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.ordered import scratch_folder, stored  # noqa: F401

# What separates words, as a Java / RE2 class and as bytes.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def map_rows(
    df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` whose function sees plain batches; input columns only."""
    return df.mapInArrow(fn, schema)


def fold(key: Column, modulus: int, held: int) -> Column:
    """Whether crc32 of the key's text falls on ``held``; a null key does not."""
    return F.coalesce(
        F.crc32(key.cast("string").cast("binary")) % modulus == held, F.lit(False)
    )


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest counts, at most ``limit`` of them: all above a
    threshold that a small histogram (16 steps per factor of two) gives. Rows
    of one step stay together, so fewer may come; no task sends more than its
    part of the result."""
    step = F.floor(F.log2(count) * 16).cast("int")
    rows, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):
        rows += r["n"]
        if rows > limit:
            break
        lowest = r["s"]
    return counts.limit(0) if lowest is None else counts.where(step >= lowest)


def row_hash(df: DataFrame) -> Column:
    """A hash of every column that can be hashed, to tell rows of one id apart."""
    usable = [
        F.col(f"`{f.name}`") for f in df.schema.fields
        if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    ]
    return F.xxhash64(*usable) if usable else F.lit(0).cast("long")
