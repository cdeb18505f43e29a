"""Exact ranks, running sums and quantiles for groups of any size.

A plain window over ``partitionBy(group)`` puts a whole group into one task.
Here the rows are range-partitioned on (group, order), so a large group spans
many partitions; each partition is numbered on its own and shifted by the
totals of the partitions before it. The range-partitioned rows are written to
the checkpoint folder once, because their partition number must not change
between the two passes (also not when an executor is lost).
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# The largest group that one task sorts, and rows dealt to a task.
GROUP_ROWS, TASK_ROWS = 2_000_000, 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; set one only where none is set, and
    only in local mode: on a cluster executors would not see a machine's own
    temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    one_machine = re.fullmatch(r"local(\[.*\])?", sc.master) is not None
    if not configured and not one_machine:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise reliably, so that later stages start from stored rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, removed at the end."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: like
    ``cut_lineage``, but columns are compressed and read one by one."""
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together, in so many partitions that none is large: what
    windows and aggregates by these keys and further ones need no other
    shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-df.count() // TASK_ROWS)), *keys)


def split_by_size(df: DataFrame, keys: list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups that fit one task, rows of larger ones or None)."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (limit or GROUP_ROWS))
    # Few by definition: each has more than ``limit`` rows.
    found = sizes.drop("_n").dropna().collect()
    if not found:
        return df, None
    large = F.broadcast(df.sparkSession.createDataFrame(found, df.select(*keys).schema))
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def tie_totals(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Per row, for each sum over its group: ``<name>_below`` (rows of smaller
    values), ``<name>_tied`` (of its value, itself included), ``<name>_total``.
    One sort in the task; for groups that fit one (see ``split_by_size``)."""
    upto, tied, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value), Window.partitionBy(*keys)
    return df.select(
        "*",
        *[(F.sum(c).over(upto) - F.sum(c).over(tied)).alias(f"{n}_below") for n, c in sums.items()],
        *[F.sum(c).over(tied).alias(f"{n}_tied") for n, c in sums.items()],
        *[F.sum(c).over(whole).alias(f"{n}_total") for n, c in sums.items()],
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions, also when they are few bytes:
    for rows that each start a lot of work (adaptive coalescing would merge
    them into a single task)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def _asc(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def range_blocks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows with ``_block``: blocks follow (keys, order), one per partition."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *_asc(order))
    return stored(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def running_totals(
    df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]
) -> DataFrame:
    """Per row, for each sum: ``<name>_before`` (rows ordered before it) and
    ``<name>_total`` (whole group). Order must be unique within a group, or
    ties get an arbitrary order among themselves."""
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    blocks = range_blocks(df, keys, order)
    per_block = blocks.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*keys)
    # At most one row per partition and group: small even for a huge group.
    offsets = per_block.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_b_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*_asc(order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocks.withColumns(
        {f"_p_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}
    )
    out = local.join(offsets, [*keys, "_block"])
    return out.withColumns(
        {f"{n}_before": F.col(f"_o_{n}") + F.col(f"_p_{n}") for n in sums}
    ).drop("_block", *[f"_{p}_{n}" for p in "vop" for n in sums])


def row_numbers(df: DataFrame, keys: list[str], order: list, name: str = "row_no") -> DataFrame:
    """1, 2, ... within each group by a unique order."""
    out = running_totals(df, keys, order, {"_n": F.lit(1).cast("long")})
    return out.withColumn(name, F.col("_n_before") + 1).drop("_n_before", "_n_total")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct present values per group with ``_count`` and the number of
    present values below (``_below``) and in total (``_present``)."""
    distinct = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_count"))
    )
    out = running_totals(distinct, keys, [value], {"_c": F.col("_count")})
    return out.withColumnsRenamed({"_c_before": "_below", "_c_total": "_present"})


def mid_rank_percentile(
    df: DataFrame, keys: list[str], value: str, name: str = "percentile"
) -> DataFrame:
    """(values below + half the tied ones) / present values; null stays null."""
    counts = value_counts(df.select(*keys, value), keys, value).select(
        *keys,
        value,
        ((F.col("_below") + 0.5 * F.col("_count")) / F.col("_present")).alias(name),
    )
    return df.join(counts, [*keys, value], "left")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks 1..n with ties sharing their mean rank; null stays null."""
    counts = value_counts(df.select(*keys, value), keys, value).select(
        *keys, value, (F.col("_below") + (F.col("_count") + 1) / 2.0).alias(name)
    )
    return df.join(counts, [*keys, value], "left")


def quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact inclusive quantiles (linear between order statistics) with
    ``count``, per group. Groups without a present value are absent."""
    counts = value_counts(df.select(*keys, value), keys, value)
    v, below, here = F.col(value).cast("double"), F.col("_below"), F.col("_count")
    aggregates = [F.max("_present").alias("count")]
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_present") - 1)
        low = F.floor(position)
        high = F.ceil(position)
        holds = lambda rank: (below <= rank) & (rank < below + here)
        aggregates += [
            F.max(F.when(holds(low), v)).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), v)).alias(f"_hi_{name}"),
            F.max(position - low).alias(f"_w_{name}"),
        ]
    out = counts.groupBy(*keys).agg(*aggregates) if keys else counts.agg(*aggregates)
    blend = {
        n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")
        for n in probabilities
    }
    return out.select(*keys, "count", *[c.alias(n) for n, c in blend.items()])


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that comes first by ``order`` (ascending).

    A partial aggregate, not a window: large groups shrink before the shuffle.
    """
    payload = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), rank).alias("_best")
    )
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])
