"""Predictions of known objects stored by day and sky area, and cone scans.

A scan reads only the partitions (day, area) that a cone touches: the touched
ones are a small table that prunes the stored one at run time. What is read
meets the cones in cells of their size, at their epoch, and is tested exactly,
cone by cone in numpy: pairs of one cell are never rows until they are a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from driftline.functions.sky import separation
from driftline.operators.celljoin import separations, with_cell, with_touched_cells
from driftline.operators.guards import require
from driftline.operators.identify import covering_cone

# Largest radius, the epoch range of the predictions, and what a
# cone reaches beyond a quadrant's corners.
MAX_RADIUS_DEGREES = 10.0
FIRST_EPOCH_JD, LAST_EPOCH_JD = 2411320.0, 2473540.0
QUADRANT_MARGIN_ARCSEC = 60.0

# Areas of 15 degrees of declination and 30 degrees of right ascension.
_ZONE, _CELL = 15, 30
_ZONES, _CELLS = 180 // _ZONE, 360 // _CELL
# Cones are joined in classes of size, powers of four from a quarter degree to
# 16 degrees: four at most, for each of which a prediction is copied.
_LEAST_REACH_ARCSEC = 900.0
# Rows of a cone scan's result that a task holds at once.
_OUTPUT_ROWS, _BATCH_ROWS = 1_000_000, 200_000
_IN_RANGE = (
    "center_ra >= 0D AND center_ra < 360D AND center_dec BETWEEN -90D AND 90D AND radius_deg > 0D"
    f" AND radius_deg <= {MAX_RADIUS_DEGREES!r}D AND epoch_jd BETWEEN {FIRST_EPOCH_JD!r}D AND {LAST_EPOCH_JD!r}D"
)


def with_partition(ephemerides: DataFrame) -> DataFrame:
    """Adds ``day`` and ``area``; rows without an epoch or a position, which no
    cone can hold, are left out."""
    return ephemerides.where("epoch_jd IS NOT NULL AND predicted_ra IS NOT NULL AND predicted_dec IS NOT NULL").selectExpr(
        "*",
        "CAST(floor(epoch_jd) AS INT) AS day",
        f"CAST(least(floor((predicted_dec + 90D) / {_ZONE}), {_ZONES - 1}) * {_CELLS}"
        f" + least(floor(pmod(predicted_ra, 360D) / {_CELL}), {_CELLS - 1}) AS INT) AS area",
    )


def store_predictions(ephemerides: DataFrame, path: str) -> None:
    """Parquet by day and area, in order of epoch and declination; only the
    partitions present are replaced. A full area is written by up to 16 tasks."""
    (
        with_partition(ephemerides)
        .repartition("day", "area", F.floor("predicted_dec"))
        .sortWithinPartitions("day", "area", "epoch_jd", "predicted_dec")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "area")
        .parquet(path)
    )


def checked_cones(cones: DataFrame) -> DataFrame:
    """Cones, failing at one whose arguments are missing or out of range."""
    message = F.concat(F.lit("cone out of range: "), F.to_json(F.struct("center_ra", "center_dec", "radius_deg", "epoch_jd")))
    return require(cones, F.expr(_IN_RANGE), message)


def touched_partitions(cones: DataFrame) -> DataFrame:
    """Each ``day, area`` that a cone touches, once."""
    polar = "abs(center_dec) + radius_deg >= 89.999D"
    reach = f"if({polar}, 180D, degrees(asin(least(1D, sin(radians(radius_deg)) / cos(radians(center_dec))))) * 1.000001D)"
    zones = (
        f"sequence(CAST(greatest(floor((center_dec - radius_deg + 90D) / {_ZONE}), 0) AS INT),"
        f" CAST(least(floor((center_dec + radius_deg + 90D) / {_ZONE}), {_ZONES - 1}) AS INT))"
    )
    cells = f"sequence(CAST(floor((center_ra - _reach) / {_CELL}) AS INT), CAST(floor((center_ra + _reach) / {_CELL}) AS INT))"
    return (
        cones.selectExpr("*", f"{reach} AS _reach")
        .selectExpr("CAST(floor(epoch_jd) AS INT) AS day", f"explode({zones}) AS _zone", f"{cells} AS _cells")
        .selectExpr("day", "_zone", "explode(_cells) AS _cell")
        .selectExpr("day", f"CAST(_zone * {_CELLS} + pmod(_cell, {_CELLS}) AS INT) AS area")
        .where("area >= 0")
        .distinct()
    )


def _cones_of_cell(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each cone of a cell (its row) with the rows of the predictions inside."""
    place = {c: rows[c].to_numpy() for c in ("_ra", "_dec", "_reach")}
    is_cone = ~np.isnan(place["_reach"])
    at = np.flatnonzero(~is_cone)
    at = at[np.argsort(place["_dec"][at], kind="stable")]

    def vectors(i):
        ra, dec = np.radians(place["_ra"][i]), np.radians(place["_dec"][i])
        return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)

    there, decs = vectors(at), place["_dec"][at]
    cones = np.flatnonzero(is_cone)
    for cone, center in zip(cones, vectors(cones), strict=True):
        reach = place["_reach"][cone]
        near = reach / 3600.0 * (1.0 + 1e-9) + 1e-12
        low, high = np.searchsorted(decs, [place["_dec"][cone] - near, place["_dec"][cone] + near], side="left")
        # Squared chords from cosines: rounding moves them by less than 1e-14.
        chord = 2.0 - 2.0 * (there[low:high] @ center)
        limit = 4.0 * np.sin(np.radians(min(reach / 3600.0, 180.0)) / 2.0) ** 2
        margin = limit * 1e-9 + 1e-14
        inside = chord <= limit - margin
        border = np.flatnonzero((chord <= limit + margin) & ~inside)
        if len(border):
            pair = rows.take(pa.array(at[low + border])), rows.take(pa.array(np.full(len(border), cone)))
            inside[border] = separations(*pair, ("_ra", "_dec"), ("_ra", "_dec")) <= reach
        yield cone, at[low:high][inside]


def _count_in_cell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``applyInArrow``: the cones of a cell and how much of it they hold."""
    rows = pa.Table.from_batches(list(batches))
    found = [(cone, len(inside)) for cone, inside in _cones_of_cell(rows)]
    own = rows["_cone"].combine_chunks().take(pa.array([f[0] for f in found], pa.int64()))
    yield pa.RecordBatch.from_arrays([*own.flatten(), pa.array([f[1] for f in found], pa.int64())], [*[f.name for f in own.type], "objects"])


def _objects_in_cell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``applyInArrow``: each cone of a cell with each prediction inside.

    The cones of a prediction follow one another, so that a stored result repeats
    its values in runs, which compress."""
    rows = pa.Table.from_batches(list(batches))
    cones, objects = rows["_cone"].combine_chunks(), rows["_object"].combine_chunks()
    names = [f.name for f in cones.type] + [f.name for f in objects.type]
    held, size = [], 0

    def out():
        cone = np.repeat([c for c, _ in held], [len(i) for _, i in held])
        inside = np.concatenate([i for _, i in held])
        order = np.argsort(inside, kind="stable")
        cone, inside = cone[order], inside[order]
        for at in range(0, len(inside), _BATCH_ROWS):
            part = slice(at, at + _BATCH_ROWS)
            columns = [*cones.take(pa.array(cone[part])).flatten(), *objects.take(pa.array(inside[part])).flatten()]
            yield pa.RecordBatch.from_arrays(columns, names)

    for cone, inside in _cones_of_cell(rows):
        if len(inside):
            held.append((cone, inside))
            size += len(inside)
            if size >= _OUTPUT_ROWS:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def cone_scan(
    ephemerides: DataFrame, cones: DataFrame, keys: list[str], columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(objects, fields): predictions inside each cone at its epoch, and one
    row per cone with their number, 0 for an empty one. ``columns``: what is
    told of a prediction, everything by default; nothing else is shuffled.

    ``ephemerides``: ``epoch_jd, predicted_ra, predicted_dec`` and any others,
    with ``day, area`` as stored; ``cones``: ``keys`` (which name a cone),
    ``center_ra, center_dec, radius_deg, epoch_jd``. Epochs agree to the
    millisecond. The position error of a prediction doesn't matter here.

    The touched partitions are broadcast: no more than 144 areas on each day
    of the epoch range, whatever the number of cones or predictions.
    """
    clash = (set(keys) | {"center_ra", "center_dec", "radius_deg"}) & set(ephemerides.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    asked = checked_cones(cones).select(*keys, "center_ra", "center_dec", "radius_deg", "epoch_jd")
    payload = [c for c in ephemerides.columns if c not in ("day", "area")] if columns is None else columns
    needed = list(dict.fromkeys([*payload, "epoch_jd", "predicted_ra", "predicted_dec"]))
    # A cone's epoch may be rounded over midnight: the day before or after it.
    step = 1.0 / 86400e3
    # The check below stops wrong cones; inside this plan it would end the pruning.
    around = cones.where(_IN_RANGE).withColumn("epoch_jd", F.explode(F.array(*[F.col("epoch_jd") + d for d in (-step, step)])))
    seen = ephemerides.join(F.broadcast(touched_partitions(around)), ["day", "area"], "left_semi").select(*needed)
    reach = f"greatest({_LEAST_REACH_ARCSEC!r}D, 900D * pow(4D, ceil(log2(radius_deg * 4D) / 2D)))"
    sized = asked.selectExpr(
        *keys, "center_ra", "center_dec", "radius_deg", f"{reach} AS _class", "CAST(round(epoch_jd * 86400e3) AS BIGINT) AS _epoch"
    )
    classes = sorted(r[0] for r in sized.select("_class").distinct().collect())
    sizes = ", ".join(f"{c!r}D" for c in classes) or "1D"
    placed = seen.selectExpr("*", "CAST(round(epoch_jd * 86400e3) AS BIGINT) AS _epoch", f"explode(array({sizes})) AS _class")
    cell = ["_epoch", "_class", "_zone", "_cell"]
    touched = with_touched_cells(sized, "center_ra", "center_dec", "_class", 1.0)
    # Cells that no cone touches would be most of the small ones.
    held = with_cell(placed, "predicted_ra", "predicted_dec", "_class", 1.0).join(touched.select(*cell).distinct(), cell, "left_semi")

    own = asked.select(F.struct(*keys).alias("_cone")).schema["_cone"].dataType
    carried = seen.select(F.struct(*payload).alias("_object")).schema["_object"].dataType
    cone_rows = touched.select(
        *cell, F.expr("CAST(center_ra AS DOUBLE) AS _ra"), F.expr("CAST(center_dec AS DOUBLE) AS _dec"),
        F.expr("CAST(radius_deg * 3600D AS DOUBLE) AS _reach"), F.struct(*keys).alias("_cone"),
    )
    object_rows = held.select(
        *cell, F.expr("CAST(predicted_ra AS DOUBLE) AS _ra"), F.expr("CAST(predicted_dec AS DOUBLE) AS _dec"),
        F.lit(None).cast("double").alias("_reach"), F.lit(None).cast(own).alias("_cone"), F.struct(*payload).alias("_object"),
    )
    per_cell = cone_rows.unionByName(object_rows.drop("_object")).groupBy(*cell).applyInArrow(
        _count_in_cell, StructType([*_nullable(own), StructField("objects", LongType())])
    )
    objects = (
        cone_rows.withColumn("_object", F.lit(None).cast(carried))
        .unionByName(object_rows)
        .groupBy(*cell).applyInArrow(_objects_in_cell, StructType([*_nullable(own), *_nullable(carried)]))
    )
    counts = per_cell.groupBy(*keys).agg(F.sum("objects").alias("objects"))
    return objects, asked.join(counts, keys, "left").fillna(0, ["objects"])


def _nullable(fields: StructType) -> list[StructField]:
    return [StructField(f.name, f.dataType) for f in fields]


def quadrant_cones(metadata: DataFrame, margin_arcsec: float = QUADRANT_MARGIN_ARCSEC) -> DataFrame:
    """A cone over each whole quadrant: ``product_id, epoch_jd`` and the cone.

    ``metadata``: ``product_id, center_ra, center_dec, corners, mid_exposure_jd``.
    """
    far = f"array_max(transform(corners, p -> {separation('center_ra', 'center_dec', 'p.ra', 'p.dec')}))"
    return metadata.selectExpr(
        "product_id", "center_ra", "center_dec", f"({far} + {float(margin_arcsec)!r}D) / 3600D AS radius_deg", "mid_exposure_jd AS epoch_jd"
    )


def tracklet_cones(members: DataFrame, frames: DataFrame, match_radius_arcsec: float) -> DataFrame:
    """One cone per build over all its tracklets' detections and the match
    radius, at the epoch of every frame that a tracklet uses (others none).

    ``members``: ``build_id, frame_no, ra, dec``; ``frames``: ``build_id,
    frame_no, mid_exposure_jd``.
    """
    used = frames.join(members.select("build_id", "frame_no").distinct(), ["build_id", "frame_no"], "left_semi")
    cones = covering_cone(members, ["build_id"], match_radius_arcsec)
    return used.selectExpr("build_id", "frame_no", "mid_exposure_jd AS epoch_jd").join(cones, "build_id")
