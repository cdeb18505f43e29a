"""Stored stages bound to their inputs: a field is computed again only when one
of its inputs has changed, and guarded inputs stop at a wrong split or digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.operators.groups import require_split
from driftline.operators.guards import require
from driftline.operators.ordered import cut_lineage
from driftline.sources.tables import verify_digests, write_parts


def input_digests(inputs: DataFrame, key: str = "field_id", name: str = "path") -> DataFrame:
    """``key, sha256``: one digest per field over its inputs' own digests.

    ``inputs``: ``key, name, sha256``, one row per input (a file, a table's
    partition); repeated rows count once, an input without a digest counts as
    unreadable. Only the digests of one field meet in a task.
    """
    line = F.concat(F.col(name).cast("string"), F.lit(" "), F.coalesce("sha256", F.lit("unreadable")))
    lines = F.array_join(F.array_sort(F.collect_set(line)), "\n")
    return inputs.groupBy(key).agg(F.sha2(lines, 256).alias("sha256"))


def _stored(spark, path: str, schema: StructType) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path)


def changed_fields(digests: DataFrame, path: str) -> DataFrame:
    """The fields that are not stored yet, or from other inputs than now."""
    done = _stored(digests.sparkSession, f"{path}/inputs", digests.schema)
    return digests if done is None else digests.join(done, digests.columns, "left_anti")


def materialise_bound(
    digests: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "field_id"
) -> DataFrame:
    """Rows of every field of ``digests`` (``key, sha256``, one row per field).

    ``compute`` maps a DataFrame of fields to their rows and gets only the
    fields whose inputs changed. Rows are stored with the digest they come
    from, and a field counts as done only after its rows are: an interrupted run
    repeats what it hadn't finished, and rows from older inputs are never read
    (also when the new inputs give none). Null fields are an error.
    """
    spark = digests.sparkSession
    digests = require(digests.select(key, "sha256"), F.col(key).isNotNull() & F.col("sha256").isNotNull(), "field without a digest")
    # Read before the folders are written.
    todo = cut_lineage(changed_fields(digests, path))
    rows = compute(todo.select(key)).join(todo, key)
    write_parts(rows, f"{path}/rows", key)
    write_parts(todo, f"{path}/inputs", key)
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").join(digests, [key, "sha256"]).select(rows.columns).drop("sha256")


def guarded_inputs(
    rows: DataFrame, manifest: DataFrame, stage: str, actual: DataFrame, frozen: DataFrame, key: str = "field_id"
) -> DataFrame:
    """Rows that a stage may use: all of its own split, and all from fields
    whose inputs are the frozen ones; any other row or field stops the job.

    ``actual`` and ``frozen``: ``key, sha256``."""
    held = require_split(rows, manifest, stage)
    same = verify_digests(actual, frozen, key).select(key).distinct().withColumn("_frozen", F.lit(True))
    message = F.concat(F.col(key).cast("string"), F.lit(" is no frozen input"))
    return require(held.join(same, key, "left"), F.col("_frozen"), message).drop("_frozen")
