"""Exposures by footprint and time: many searches in one join.

A footprint is reduced to a centre and a reach (its radius, rounded up to a
power of two, so that few sizes occur); centres fall into cells and time
buckets, positions are copied to the cells and buckets they may match. What
meets is tested exactly against the polygon and the window. The large side, the
exposures, is never copied where a cell is not crowded, and right ascension wraps
in the cells. Counts and box searches meet their exposures in numpy (``quads``):
no pair of a position and an exposure is a row before it is a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from driftline.functions.sky import footprint_columns, gnomonic, separation, unit_vector, vector_position
from driftline.operators import quads
from driftline.operators.celljoin import cell_groups, cell_join
from driftline.operators.guards import require
from driftline.operators.ordered import cut_lineage, spread, stored
from driftline.operators.stars import quad_contains
from driftline.sources.catalogs import MAX_SEARCH_DAYS, MAX_SEARCH_RADIUS_DEGREES

# The smallest sequence, and the smallest time bucket (a minute).
MIN_FRAMES = 3
MIN_BUCKET_DAYS = 1.0 / 1440.0
# Exposures and positions of a cell that are judged at once.
COUNT_LIMITS, SEARCH_LIMITS = (50_000, 200_000), (10_000, 2_000)
# A box's outer circle, in half sides, with room for rounding.
BOX_ROOM = math.sqrt(2.0) * 1.01


def with_reach(exposures: DataFrame, margin_arcsec: float = 0.0) -> DataFrame:
    """Adds the footprint's plane columns, its outer radius and ``reach`` (arcsec).

    Exposures without a time or without complete corners cover nothing and
    are left out.
    """
    usable = exposures.where(
        "obsjd IS NOT NULL AND size(corners) = 4 AND forall(corners, p -> p.ra IS NOT NULL AND p.dec IS NOT NULL)"
    )
    radius = f"array_max(transform(corners, p -> {separation('fp_ra', 'fp_dec', 'p.ra', 'p.dec')}))"
    return usable.selectExpr("*", *footprint_columns("corners")).selectExpr(
        "*", f"{radius} * 1.001D + 1D AS fp_radius"
    ).selectExpr("*", f"pow(2D, ceil(log2(fp_radius + {float(margin_arcsec)!r}D))) AS reach").drop("fp_plane", "fp_sorted")


def bucket_length(positions: DataFrame, longest: float) -> float:
    """Time bucket (days) for the windows asked for: their mean length, at most
    ``longest``. A position then lies in three buckets on average or, where
    windows are longer, in as many as buckets of ``longest`` give, and meets
    few exposures outside its window."""
    mean = positions.where("start_jd < end_jd").agg(F.avg(F.expr("end_jd - start_jd"))).first()[0]
    return longest if mean is None else min(longest, max(MIN_BUCKET_DAYS, mean))


def _candidates(
    positions: DataFrame, exposures: DataFrame, keys: list[str], carry: list[str], margin_arcsec: float, bucket_days: float,
    within: str,
) -> DataFrame:
    """Exposures no farther than ``within`` (SQL, arcsec, at most the reach)
    from a position, in its window. ``bucket_days``: the longest time bucket."""
    bucket_days = bucket_length(positions, bucket_days)
    # A few large input files would leave footprints and pairs to a few tasks.
    seen = cut_lineage(
        with_reach(spread(exposures, "pid"), margin_arcsec).withColumn("_bucket", F.floor(F.col("obsjd") / bucket_days).cast("long"))
    )
    # Powers of two between arcsec and the sky: at most twenty values.
    reaches = sorted(r["reach"] for r in seen.select("reach").distinct().collect())
    sizes = ", ".join(f"{r!r}D" for r in reaches) or "1D"
    asked = positions.where("ra IS NOT NULL AND dec IS NOT NULL AND start_jd < end_jd").selectExpr(
        *keys, *carry, "ra AS p_ra", "dec AS p_dec", "start_jd", "end_jd", f"explode(array({sizes})) AS reach",
    ).selectExpr(
        "*", f"explode(sequence(CAST(floor(start_jd / {bucket_days!r}D) AS BIGINT), CAST(floor(end_jd / {bucket_days!r}D) AS BIGINT))) AS _bucket"
    )
    near = cell_join(
        seen, asked, "reach", on=["reach", "_bucket"], left_pos=("fp_ra", "fp_dec"), right_pos=("p_ra", "p_dec"),
        cell_factor=1.0,
        extra=f"obsjd >= start_jd AND obsjd < end_jd AND abs(fp_dec - p_dec) * 3600D <= {within}",
    )
    return near.where(f"separation <= {within}").drop("_bucket", "reach", "separation", "fp_radius")


def exposures_at(
    positions: DataFrame, exposures: DataFrame, keys: list[str], bucket_days: float = MAX_SEARCH_DAYS
) -> DataFrame:
    """Exposures whose footprint holds the position, in [start, end).

    ``positions``: keys, ``ra, dec, start_jd, end_jd``; ``exposures``: ``pid,
    obsjd, corners`` (four of ``ra, dec``, in any order) and any others.
    """
    near = _candidates(positions, exposures, keys, [], 0.0, bucket_days, "fp_radius")
    x, y = gnomonic("p_ra", "p_dec", "fp_ra", "fp_dec")
    # A generator, so that the projection is computed once for all edges.
    held = near.selectExpr("*", f"explode(array(named_struct('x', {x}, 'y', {y}))) AS _at").where(quad_contains("_at.x", "_at.y"))
    return held.drop("_at", "p_ra", "p_dec", "fp_ra", "fp_dec", "fp_edges", "start_jd", "end_jd")


def find_sequences(
    positions: DataFrame, exposures: DataFrame, keys: list[str], min_frames: int = MIN_FRAMES,
    bucket_days: float = MAX_SEARCH_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """The exposures of every position with enough of them (``frame_no`` in
    time order from 0), and the positions with too few and their count."""
    covering = cut_lineage(exposures_at(positions, exposures, keys, bucket_days))
    # A position's exposures within its window: as many as a sequence has.
    order = F.array_sort(F.collect_list(F.struct("obsjd", "pid")))
    listed = covering.groupBy(*keys).agg(order.alias("frames"))
    rows = listed.where(F.size("frames") >= min_frames).select(*keys, F.posexplode("frames").alias("frame_no", "f")).select(
        *keys, "frame_no", "f.pid", "f.obsjd"
    )
    short = positions.select(*keys).join(listed, keys, "left").select(
        *keys, F.coalesce(F.size("frames"), F.lit(0)).alias("found")
    ).withColumn("found", F.greatest("found", F.lit(0))).where(F.col("found") < min_frames)
    return rows, short


def _flat(exposures: DataFrame, columns: list[str], margin_arcsec: float) -> DataFrame:
    """``columns``, the time, the corners as columns, centre, radius and reach as in
    ``with_reach``, without arrays."""
    usable = exposures.where(
        "obsjd IS NOT NULL AND size(corners) = 4 AND forall(corners, p -> p.ra IS NOT NULL AND p.dec IS NOT NULL)"
    )
    corners = [f"CAST(corners[{k}].{axis} AS DOUBLE) AS _{axis}{k}" for k in range(4) for axis in ("ra", "dec")]
    flat = spread(usable.selectExpr(*dict.fromkeys(["pid", "obsjd", *columns]), *corners), "pid")
    parts = [unit_vector(f"_ra{k}", f"_dec{k}") for k in range(4)]
    center_ra, center_dec = vector_position("_x", "_y", "_z")
    far = ", ".join(separation("fp_ra", "fp_dec", f"_ra{k}", f"_dec{k}") for k in range(4))
    return (
        flat.selectExpr("*", *[f"{' + '.join(p[i] for p in parts)} AS _{name}" for i, name in enumerate("xyz")])
        .selectExpr("*", f"{center_ra} AS fp_ra", f"{center_dec} AS fp_dec").drop("_x", "_y", "_z")
        .selectExpr("*", f"greatest({far}) * 1.001D + 1D AS fp_radius")
        .selectExpr("*", f"pow(2D, ceil(log2(fp_radius + {float(margin_arcsec)!r}D))) AS reach")
    )


def _judged(
    positions: DataFrame, exposures: DataFrame, keys: list[str], carry: list[str], columns: list[str], margin_arcsec: float,
    bucket_days: float, limits: tuple[int, int], judge, schema: StructType,
) -> DataFrame:
    """What ``judge`` makes of the exposures and positions of a cell and bucket."""
    bucket_days = bucket_length(positions, bucket_days)
    seen = stored(
        _flat(exposures, columns, margin_arcsec).withColumn("_bucket", F.floor(F.col("obsjd") / bucket_days).cast("long")), "exposures"
    )
    # Powers of two between arcsec and the sky: at most twenty values.
    sizes = ", ".join(f"{r['reach']!r}D" for r in seen.select("reach").distinct().collect()) or "1D"
    asked = positions.where("ra IS NOT NULL AND dec IS NOT NULL AND start_jd < end_jd").selectExpr(
        *keys, *carry, "ra AS p_ra", "dec AS p_dec", "start_jd", "end_jd",
        f"explode(sequence(CAST(floor(start_jd / {bucket_days!r}D) AS BIGINT), CAST(floor(end_jd / {bucket_days!r}D) AS BIGINT))) AS _bucket",
    )
    # Most buckets of a long window may hold no exposure.
    asked = asked.join(seen.select("_bucket").distinct(), "_bucket", "left_semi").selectExpr("*", f"explode(array({sizes})) AS reach")
    return cell_groups(
        seen, asked, "reach", ["reach", "_bucket"], judge, schema, ("fp_ra", "fp_dec"), ("p_ra", "p_dec"), 1.0, limits
    )


def coverage_counts(positions: DataFrame, exposures: DataFrame, keys: list[str], bucket_days: float = MAX_SEARCH_DAYS) -> DataFrame:
    """Per position: exposures with a depth that cover it, first and last time.

    Exposures that surely cover a run of neighbouring positions count for the run
    as a whole; only positions near a border are tested one by one.
    """
    deep = exposures.where("maglimit IS NOT NULL")
    own = positions.select(*keys).schema
    sums = ("_n", "_first", "_last", "_deepest")

    def judge(seen: pa.Table, asked: pa.Table) -> pa.Table:
        corners, _, convex = quads.footprints(seen)
        time, depth = quads.column(seen, "obsjd"), quads.column(seen, "maglimit")
        use = np.isfinite(corners).all(axis=(1, 2)) & ~np.isnan(time)
        places = quads.vectors(quads.column(asked, "p_ra"), quads.column(asked, "p_dec"))
        window = quads.column(asked, "start_jd"), quads.column(asked, "end_jd")
        tally = quads.coverage(corners[use], convex[use], time[use], depth[use], places, *window)
        at = np.flatnonzero(tally.count)
        found = asked.select(keys).take(pa.array(at))
        for name, values in zip(sums, (tally.count, tally.first, tally.last, tally.deepest), strict=True):
            found = found.append_column(name, pa.array(values[at]))
        return found

    kinds = [LongType(), DoubleType(), DoubleType(), DoubleType()]
    schema = StructType([*_nullable(own), *[StructField(n, k) for n, k in zip(sums, kinds, strict=True)]])
    parts = _judged(positions, deep, keys, [], ["maglimit"], 0.0, bucket_days, COUNT_LIMITS, judge, schema)
    kind = {f.name: f.dataType for f in exposures.schema}
    return parts.groupBy(*keys).agg(
        F.sum("_n").alias("exposures"), F.min("_first").cast(kind["obsjd"]).alias("first_jd"),
        F.max("_last").cast(kind["obsjd"]).alias("last_jd"), F.max("_deepest").cast(kind["maglimit"]).alias("deepest"),
    )


def _nullable(fields: StructType) -> list[StructField]:
    return [StructField(f.name, f.dataType) for f in fields]


def box_searches(
    searches: DataFrame, exposures: DataFrame, keys: list[str], bucket_days: float = MAX_SEARCH_DAYS,
    columns: list[str] | None = None,
) -> DataFrame:
    """Exposures whose footprint meets the box of side 2·radius around each
    position, in [start, end); boxes lie in the plane tangent at their centre.

    ``searches``: keys, ``ra, dec, radius_deg, start_jd, end_jd``. A radius or
    window beyond the limits of a search stops the job. ``columns``: what is
    told of an exposure, everything by default.
    """
    checked = require(
        searches, F.expr(f"radius_deg > 0 AND radius_deg <= {MAX_SEARCH_RADIUS_DEGREES!r}D"),
        f"radius must be in (0, {MAX_SEARCH_RADIUS_DEGREES}] degrees",
    )
    checked = require(
        checked, F.expr(f"start_jd < end_jd AND end_jd - start_jd <= {MAX_SEARCH_DAYS!r}D"),
        f"the window must be positive and at most {MAX_SEARCH_DAYS:g} days",
    )
    told = [c for c in (exposures.columns if columns is None else columns) if c not in keys]

    def judge(seen: pa.Table, asked: pa.Table) -> pa.Table:
        hits = list(quads.box_hits(seen, quads.column(seen, "fp_radius"), asked, BOX_ROOM))
        row = np.repeat([r for r, _ in hits], [len(i) for _, i in hits]).astype(np.int64)
        found = asked.select(keys).take(pa.array(row))
        own = seen.select(told).take(pa.array(np.concatenate([i for _, i in hits]) if hits else row))
        for name in told:
            found = found.append_column(name, own[name])
        return found

    schema = StructType([*_nullable(searches.select(*keys).schema), *_nullable(exposures.select(*told).schema)])
    margin = MAX_SEARCH_RADIUS_DEGREES * BOX_ROOM * 3600.0
    return _judged(checked, exposures, keys, ["radius_deg"], told, margin, bucket_days, SEARCH_LIMITS, judge, schema)
