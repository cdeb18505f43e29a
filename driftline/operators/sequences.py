"""Choosing exposure sequences from exposure metadata.

Exposures: ``pid, obsjd, obsdate, field, ccdid, qid, filtercode`` and
optionally ``maglimit`` and corners. A group is one quadrant and UTC date; a
night of one quadrant has at most a few hundred exposures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ordered import first_per_group, row_numbers

# The sequence rules.
MAX_SPAN_MIN = 150.0
MIN_GAP_MIN = 15.0
MIN_EXPOSURES = 3

QUADRANT_NIGHT = ["field", "ccdid", "qid", "night"]


def with_night(exposures: DataFrame) -> DataFrame:
    return exposures.withColumn("night", F.date_format("obsdate", "yyyy-MM-dd"))


def first_middle_last(exposures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Earliest group with enough exposures (per key): its first, middle
    ((n-1) div 2) and last exposure."""
    keys = keys or []
    group = [*keys, *QUADRANT_NIGHT]
    numbered = row_numbers(with_night(exposures), group, ["obsjd", "pid"], "n")
    sizes = numbered.groupBy(*group).agg(
        F.count("*").alias("size"), F.min(F.struct("obsjd", "pid")).alias("start")
    ).where(F.col("size") >= MIN_EXPOSURES)
    if keys:
        sizes = first_per_group(sizes, keys, [F.col("start")])
    else:
        sizes = first_per_group(sizes.withColumn("_all", F.lit(1)), ["_all"], [F.col("start")]).drop("_all")
    picked = numbered.join(sizes.drop("start"), group).where(
        "n = 1 OR n = size OR n = (size - 1) div 2 + 1"
    )
    return picked.drop("size")


def pick_triples(exposures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per quadrant and night: the first exposure, the last one within the
    span, and the one nearest their midpoint with gaps on both sides.

    Groups without such a triple are left out. All steps are aggregates.
    """
    group = [*(keys or []), *QUADRANT_NIGHT]
    rows = with_night(exposures)
    first = rows.groupBy(*group).agg(F.min(F.struct("obsjd", "pid")).alias("e1"))
    joined = rows.join(first, group)
    within = "(obsjd - e1.obsjd) * 1440D"
    last = (
        joined.where(f"{within} <= {MAX_SPAN_MIN!r}D AND struct(obsjd, pid) <> e1")
        .groupBy(*group)
        .agg(F.max(F.struct("obsjd", "pid")).alias("e3"))
    )
    middle = (
        joined.join(last, group)
        .where(f"{within} >= {MIN_GAP_MIN!r}D AND (e3.obsjd - obsjd) * 1440D >= {MIN_GAP_MIN!r}D")
        .groupBy(*group, "e1", "e3")
        .agg(
            F.expr(
                "min_by(struct(obsjd, pid), struct(abs(obsjd - (e1.obsjd + e3.obsjd) / 2D), obsjd, pid))"
            ).alias("e2")
        )
    )
    return middle.select(*group, "e1", "e2", "e3")


def usable_exposures(exposures: DataFrame, columns: list[str]) -> DataFrame:
    """Exposures with a depth and all corners."""
    return exposures.dropna(subset=columns)


def sibling_sequences(parents: DataFrame, exposures: DataFrame) -> DataFrame:
    """Other quadrants of the same exposures and CCD, complete ones only.

    ``parents``: ``field_id, expid, ccdid, qid``; ``exposures`` adds ``pid,
    obsjd``. One row per field, sibling quadrant and exposure, in order.
    """
    wanted = parents.groupBy("field_id").agg(F.count_distinct("expid").alias("n_exposures"))
    own = parents.selectExpr("field_id", "expid", "ccdid", "qid AS own_qid").distinct()
    rows = (
        exposures.join(own, ["expid", "ccdid"]).where("qid <> own_qid").join(wanted, "field_id")
    )
    per_quadrant = Window.partitionBy("field_id", "qid")
    order = per_quadrant.orderBy("obsjd", "pid")
    # A quadrant of one sequence holds at most as many rows as exposures.
    return (
        rows.withColumns({"_n": F.count("*").over(per_quadrant), "sequence_no": F.row_number().over(order)})
        .where("_n = n_exposures")
        .drop("_n", "n_exposures", "own_qid")
    )


def without_nights(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """Candidates whose quadrant-night is not excluded."""
    return candidates.join(excluded.select(*QUADRANT_NIGHT).distinct(), QUADRANT_NIGHT, "left_anti")


def available(sequences: DataFrame, inventory: DataFrame, key: str, products: int = 2) -> DataFrame:
    """Sequences whose exposures all have every product. ``inventory``: one
    row per existing ``(pid, product)``."""
    have = inventory.select("pid", "product").distinct().groupBy("pid").agg(F.count("*").alias("_have"))
    rows = sequences.join(have, "pid", "left").groupBy(key).agg(
        F.expr(f"bool_and(coalesce(_have >= {products}, false))").alias("_ok")
    )
    return sequences.join(rows.where("_ok").select(key), key, "left_semi")


def minutes_from_first(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``minutes``: time since the group's first exposure."""
    first = frames.groupBy(*keys).agg(F.min("observed_at").alias("_t0"))
    seconds = (F.unix_micros("observed_at") - F.unix_micros("_t0")) / 1e6
    return frames.join(first, keys).withColumn("minutes", seconds / 60.0).drop("_t0")


def covering(exposures: DataFrame, frames_min: int, key: str) -> DataFrame:
    """Sequences with enough exposures; the count is checked per key."""
    sizes = exposures.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= frames_min)
    return exposures.join(sizes.drop("_n"), key, "left_semi")
