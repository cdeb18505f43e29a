"""Conditions that stop a job, checked inside the plan (no driver pass)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, condition: Column, message) -> DataFrame:
    """Keep all rows; raise as soon as one fails ``condition`` (or it is null).

    ``message`` is text or a Column built from the failing row. The test has a
    non-deterministic (always true) part: the optimizer then moves no later
    filter or null check below it, where the failing row could vanish unseen.
    """
    text = F.lit(message) if isinstance(message, str) else message
    held = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(text).cast("boolean")
    )
    return df.where(held & (F.spark_partition_id() >= 0))
