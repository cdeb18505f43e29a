"""Feature tables, stored parts, snapshots and content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.guards import require
from driftline.operators.ordered import first_per_group


def write_csv_table(df: DataFrame, path: str, order: list[str]) -> None:
    """Gzip CSV in a fixed row order; null is written as an empty field."""
    (
        df.orderBy(*order)
        .write.mode("overwrite")
        .option("header", True)
        .option("compression", "gzip")
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nullValue="", emptyValue="")


def write_parts(df: DataFrame, path: str, key: str = "field_id") -> None:
    """Parquet partitioned by field; only the fields present are replaced."""
    (
        df.repartition(key, F.pmod(F.xxhash64(*df.columns), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def todo(fields: DataFrame, done: DataFrame, key: str = "field_id") -> DataFrame:
    """Fields that still have no stored part."""
    return fields.join(done.select(key).distinct(), key, "left_anti")


def materialise(fields: DataFrame, path: str, compute, key: str = "field_id") -> DataFrame:
    """Compute the missing fields, store them, and read all parts back.

    ``compute`` maps a DataFrame of fields to their rows. An interrupted run
    is repeated for the missing fields only.
    """
    spark = fields.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as exc:  # noqa: BLE001  (no part stored yet)
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER" not in str(exc):
            raise
        done = None
    write_parts(compute(fields if done is None else todo(fields, done, key)), path, key)
    return spark.read.parquet(path)


def read_json_rows(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """One row per element of a top-level array of a JSON report."""
    return spark.read.json(path, schema=schema, multiLine=True).select(
        F.explode(rows).alias("_row")
    ).select("_row.*")


def replay(fields: DataFrame, snapshots: dict[str, DataFrame], key: str = "field_id") -> DataFrame:
    """Rows of each field from the first snapshot that holds it; a field in
    none is an error (nothing is looked up live). Order of the dict decides."""
    tagged = None
    for priority, (name, df) in enumerate(snapshots.items()):
        part = df.withColumns({"_priority": F.lit(priority), "source": F.lit(name)})
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.groupBy(key).agg(F.min("_priority").alias("_priority"))
    wanted = fields.select(key).distinct().join(first, key, "left")
    message = F.concat(F.col(key).cast("string"), F.lit(": no stored snapshot"))
    wanted = require(wanted, F.col("_priority").isNotNull(), message)
    return tagged.join(wanted, [key, "_priority"]).drop("_priority")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_digests(actual: DataFrame, frozen: DataFrame, key: str = "path") -> DataFrame:
    """Frozen inputs, failing when one is missing or differs."""
    joined = frozen.join(actual.select(key, F.col("sha256").alias("_now")), key, "left")
    message = F.concat(F.col(key), F.lit(" differs from the frozen input"))
    return require(joined, F.col("_now") == F.col("sha256"), message).drop("_now")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_per_group(df, keys, [-F.col(order)])


def spec_json(spec: DataFrame) -> DataFrame:
    """A frozen specification as one JSON document per row."""
    return spec.select(F.to_json(F.struct("*")).alias("json"))
