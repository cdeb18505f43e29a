"""Known-object targets: selection, outcomes, acceptance and traces.

Keyed by ``build_id``; predictions by (``frame_no``, ``designation``). The
per-frame metadata has ``center_ra, center_dec, corners, maglimit``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT, BuildConfig
from driftline.functions.classify import BAND_OFFSET, first_failure
from driftline.functions.sky import (
    angle_difference,
    baseline_eligible,
    in_offset_footprint,
    offset_footprint_columns,
    pair_separations,
    predicted_motion,
)
from driftline.operators.celljoin import cell_groups, cell_join, within
from driftline.operators.ordered import first_per_group, quantiles, stored

# The target rule and the trace radii.
PRIMARY_MARGIN = 0.5
MARGINAL_MARGIN = 0.5
MAX_POSITION_ERROR = 1.0
NEAREST_RADIUS = 10.0
LOCAL_DEPTH_RADIUS = 60.0
LOCAL_DEPTH_SNR = (3.0, 20.0)
LOCAL_DEPTH_MIN_SOURCES = 5

TARGET = ["build_id", "designation"]
FRAME = ["build_id", "frame_no"]


def select_targets(
    ephemerides: DataFrame, metadata: DataFrame, controls: DataFrame | None = None
) -> DataFrame:
    """Objects predicted in every frame and footprint, with a role.

    ``controls`` (``build_id, designation``) bypass the brightness and error
    cuts. One row per target with its predicted positions in frame order.
    """
    per_build = metadata.groupBy("build_id").agg(
        F.count("*").alias("n_frames"), F.min("maglimit").alias("min_maglimit")
    )
    shapes = metadata.selectExpr(
        *FRAME, "center_ra", "center_dec",
        *offset_footprint_columns("corners", "center_ra", "center_dec"),
    ).drop("of_plane").join(per_build, "build_id")
    inside = in_offset_footprint("predicted_ra", "predicted_dec", "center_ra", "center_dec")
    rows = ephemerides.join(shapes, FRAME).withColumn("_inside", F.expr(inside))
    rate, angle = predicted_motion("f.motion_ra", "f.motion_dec")
    first = (
        "min_by(named_struct('v', v_magnitude, 'object_class', object_class, 'motion_ra', motion_ra,"
        " 'motion_dec', motion_dec), frame_no)"
    )
    grouped = rows.groupBy(*TARGET).agg(
        F.count("*").alias("n"),
        F.first("n_frames").alias("n_frames"),
        F.first("min_maglimit").alias("min_maglimit"),
        F.expr("bool_and(_inside)").alias("inside"),
        F.max("position_error_arcsec").alias("position_error_arcsec"),
        F.expr(first).alias("f"),
        F.expr(
            "array_sort(collect_list(named_struct('frame_no', frame_no, 'ra', predicted_ra,"
            " 'dec', predicted_dec)))"
        ).alias("positions"),
    ).where("n = n_frames AND inside AND f.v IS NOT NULL")
    control = "false"
    if controls is not None:
        grouped = grouped.join(controls.withColumn("_control", F.lit(True)), TARGET, "left")
        control = "coalesce(_control, false)"
    role = (
        f"CASE WHEN {control} THEN 'control' WHEN position_error_arcsec > {MAX_POSITION_ERROR!r}D THEN NULL"
        f" WHEN f.v <= min_maglimit - {PRIMARY_MARGIN!r}D THEN 'primary'"
        f" WHEN f.v <= min_maglimit + {MARGINAL_MARGIN!r}D THEN 'marginal' END"
    )
    return grouped.selectExpr(
        *TARGET, f"{role} AS role", "f.v AS v_magnitude", "f.object_class AS object_class",
        "position_error_arcsec", f"{rate} AS predicted_rate", f"{angle} AS predicted_angle",
        "positions",
    ).where("role IS NOT NULL")


def with_eligibility(targets: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """Rate- and baseline-eligibility, from predictions only."""
    tolerance = config.stationary_tolerance_arcsec
    return targets.selectExpr(
        "*",
        f"predicted_rate <= {config.max_rate_arcsec_per_min!r}D AS rate_eligible",
        f"{baseline_eligible('positions', tolerance)} AS baseline_eligible",
        f"array_min({pair_separations('positions')}) AS min_pair_displacement_arcsec",
    )


def target_positions(targets: DataFrame) -> DataFrame:
    """One row per target and frame."""
    return targets.selectExpr(*TARGET, "explode(positions) AS p").selectExpr(
        *TARGET, "p.frame_no AS frame_no", "p.ra AS t_ra", "p.dec AS t_dec"
    )


def nearest_detections(
    positions: DataFrame, detections: DataFrame, radius: float = NEAREST_RADIUS
) -> DataFrame:
    """The nearest detection of each position's frame, null beyond ``radius``.

    Ties: distance, declination, catalog order.
    """
    payload = [c for c in detections.columns if c not in FRAME]
    close = cell_join(
        detections, positions, radius, on=FRAME, right_pos=("t_ra", "t_dec"), name="nearest_arcsec"
    )
    best = first_per_group(
        close.drop("t_ra", "t_dec"),
        [*TARGET, "frame_no"],
        [F.col("nearest_arcsec"), F.col("dec"), F.col("det_no")],
    )
    keep = best.select(*TARGET, "frame_no", "nearest_arcsec", *payload)
    return positions.join(keep, [*TARGET, "frame_no"], "left")


def detections_near(
    predictions: DataFrame, detections: DataFrame, key: list[str], radius: float
) -> DataFrame:
    """Detections within ``radius`` of each prediction, nearest first.

    ``predictions``: key, build and frame, ``p_ra, p_dec``. The order number
    is taken within one search circle.
    """
    close = cell_join(
        detections, predictions, radius, on=FRAME, right_pos=("p_ra", "p_dec"), name="distance"
    )
    order = Window.partitionBy(*key, *FRAME).orderBy("distance", "det_no")
    return close.withColumn("nearness", F.row_number().over(order))


def frame_traces(
    targets: DataFrame,
    marked: DataFrame,
    metadata: DataFrame,
    config: BuildConfig = DEFAULT,
) -> DataFrame:
    """Target by frame: expected brightness, local depth, nearest source, and
    whether that source is a moving candidate. ``marked`` are detections with
    ``is_stationary``; ``metadata`` adds ``filter_code`` and ``maglimit``."""
    # Stored, because the nearest source and the depth both read them.
    marked = stored(
        marked.select(*FRAME, "det_no", "ra", "dec", "magnitude", "snr", "mask_bits", "is_stationary"), "marked"
    )
    near = nearest_detections(stored(local_depths(target_positions(targets), marked), "depths"), marked)
    offset = "CASE filter_code " + " ".join(
        f"WHEN '{b}' THEN {o!r}D" for b, o in BAND_OFFSET.items()
    ) + " ELSE 0D END"
    found = f"coalesce(nearest_arcsec <= {config.match_radius_arcsec!r}D, false)"
    joined = (
        near.join(metadata.select(*FRAME, "filter_code", "maglimit"), FRAME)
        .join(targets.select(*TARGET, "v_magnitude"), TARGET)
        .selectExpr("*", f"{found} AS detected", f"v_magnitude + {offset} AS expected_mag")
    )
    source = ["det_no", "ra", "dec", "magnitude", "snr", "mask_bits"]
    return joined.selectExpr(
        *TARGET, "frame_no", "t_ra", "t_dec", "nearest_arcsec", "detected",
        *[f"if(detected, {c}, NULL) AS {c}" for c in source],
        "if(detected, NOT is_stationary, NULL) AS candidate",
        "expected_mag", "maglimit - expected_mag AS global_margin_mag",
        "local_depth_mag", "local_depth_mag - expected_mag AS local_margin_mag",
    )


def _depth_in_cell(names: list[str]):
    """Columns ``names`` of each position and the median ``depth`` of the
    sources around it; null below the least number of sources."""

    def judge(positions: pa.Table, sources: pa.Table) -> pa.Table:
        sources = sources.sort_by("depth")
        value = sources["depth"].drop_null().to_numpy()
        found = np.full(positions.num_rows, np.nan)
        none = np.ones(positions.num_rows, bool)
        for rows, close in within(LOCAL_DEPTH_RADIUS, positions, sources, ("t_ra", "t_dec"), ("ra", "dec")):
            upto = close[:, : len(value)].cumsum(axis=1, dtype=np.int32)
            n = upto[:, -1] if len(value) else np.zeros(len(close), np.int32)
            none[rows] = (n == 0) | (close.sum(axis=1) < LOCAL_DEPTH_MIN_SOURCES)
            if len(value):
                low, high = ((upto >= k[:, None]).argmax(axis=1) for k in ((n + 1) // 2, n // 2 + 1))
                found[rows] = 0.5 * value[low] + 0.5 * value[high]
        return positions.select(names).append_column("local_depth_mag", pa.array(found, mask=none))

    return judge


def local_depths(positions: DataFrame, detections: DataFrame) -> DataFrame:
    """Positions with ``local_depth_mag``, the median 5-sigma depth of the
    sources of the SNR window within ``LOCAL_DEPTH_RADIUS`` of each, null below
    ``LOCAL_DEPTH_MIN_SOURCES`` of them."""
    low, high = LOCAL_DEPTH_SNR
    sources = detections.where(f"snr >= {low!r}D AND snr <= {high!r}D").selectExpr(
        *FRAME, "ra", "dec", "magnitude + 2.5D * log10(snr / 5D) AS depth"
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in positions.schema)
    return cell_groups(
        positions, sources, LOCAL_DEPTH_RADIUS, FRAME, _depth_in_cell(positions.columns),
        f"{kinds}, local_depth_mag double", left_pos=("t_ra", "t_dec"), right_pos=("ra", "dec"),
    )


def frame_depths(detections: DataFrame) -> DataFrame:
    """Median 5-sigma depth of whole frames; null below five sources. A frame
    may be huge, so the median comes from distributed ranks."""
    low, high = LOCAL_DEPTH_SNR
    rows = detections.where(f"snr >= {low!r}D AND snr <= {high!r}D").selectExpr(
        *FRAME, "magnitude + 2.5D * log10(snr / 5D) AS depth"
    )
    out = quantiles(rows, FRAME, "depth", {"frame_depth_mag": 0.5})
    return out.selectExpr(
        *FRAME, "count AS sources",
        f"if(count >= {LOCAL_DEPTH_MIN_SOURCES}, frame_depth_mag, NULL) AS frame_depth_mag",
    )


def stationary_matches(
    traces: DataFrame, detections: DataFrame, config: BuildConfig = DEFAULT
) -> DataFrame:
    """What a stationary target source matched in another frame: the target's
    own source there first, then the closest other source."""
    own = traces.where("candidate = false").selectExpr(
        *TARGET, "frame_no AS own_frame", "ra AS own_ra", "dec AS own_dec"
    )
    pairs = cell_join(
        detections.select(*FRAME, "det_no", "ra", "dec", "magnitude"),
        own,
        config.stationary_tolerance_arcsec,
        on=["build_id"],
        right_pos=("own_ra", "own_dec"),
        extra="frame_no <> own_frame",
        cell_factor=8.0,
    )
    sources = traces.where("detected").selectExpr(*TARGET, "frame_no", "det_no AS target_det")
    kinds = pairs.join(sources, [*TARGET, "frame_no"], "left").withColumn(
        "stationary_match", F.expr("if(det_no <=> target_det, 'self', 'other')")
    )
    best = first_per_group(
        kinds.selectExpr(
            *TARGET, "own_frame", "stationary_match", "separation AS stationary_match_arcsec",
            "magnitude AS stationary_match_mag", "frame_no", "dec", "det_no",
        ),
        [*TARGET, "own_frame"],
        [F.expr("stationary_match <> 'self'"), F.col("stationary_match_arcsec"),
         F.col("frame_no"), F.col("dec"), F.col("det_no")],
    )
    return best.select(
        *TARGET, F.col("own_frame").alias("frame_no"), "stationary_match",
        "stationary_match_arcsec", "stationary_match_mag",
    )


def source_tracklets(traces: DataFrame, members: DataFrame, identified: DataFrame) -> DataFrame:
    """Per target: the tracklet holding all its sources (first built one, else
    the first) and the number of tracklets holding only some."""
    sources = traces.where("detected").select(*TARGET, "frame_no", "det_no")
    counts = traces.groupBy(*TARGET).agg(
        F.count("*").alias("n_frames"), F.count_if("detected").alias("n_sources")
    )
    shared = (
        members.select(*FRAME, "det_no", "tracklet_no")
        .join(sources, [*FRAME, "det_no"])
        .groupBy(*TARGET, "tracklet_no")
        .agg(F.count("*").alias("shared"))
        .join(counts, TARGET)
        .withColumn("full", F.expr("n_sources = n_frames AND shared = n_sources"))
    )
    info = identified.select(
        "build_id", "tracklet_no", "tracklet_id", "status", "identification_status", "best_designation"
    )
    best = first_per_group(
        shared.where("full").select(*TARGET, "tracklet_no").join(info, ["build_id", "tracklet_no"]),
        TARGET,
        [F.expr("status <> 'built'"), F.col("tracklet_no")],
    )
    partial = shared.where("NOT full").groupBy(*TARGET).agg(F.count("*").alias("partial_tracklets"))
    return (
        counts.select(*TARGET)
        .join(best, TARGET, "left")
        .join(partial, TARGET, "left")
        .fillna(0, ["partial_tracklets"])
    )


def target_traces(targets: DataFrame, traces: DataFrame, linked: DataFrame) -> DataFrame:
    """Stage-by-stage trace of every target with its first failing stage."""
    counts = traces.groupBy(*TARGET).agg(
        F.count("*").alias("frames"),
        F.count_if("detected").alias("detected_frames"),
        F.count_if(F.coalesce("candidate", F.lit(False))).alias("candidate_frames"),
    )
    full = "(tracklet_no IS NOT NULL)"
    built = "coalesce(status = 'built', false)"
    identified = (
        "coalesce(identification_status = 'known' AND best_designation = designation, false)"
    )
    failure = first_failure("detected_frames", "candidate_frames", "frames", full, built, identified)
    return (
        targets.join(counts, TARGET)
        .join(linked, TARGET, "left")
        .withColumn("first_failure", F.expr(failure))
        .withColumn("recovered", F.col("first_failure").isNull())
    )


def target_outcomes(
    targets: DataFrame, traces: DataFrame, identified: DataFrame
) -> DataFrame:
    """Recovered or not, whichever tracklet was identified as the target: an
    accepted fit first, then the smallest identification residual."""
    counts = traces.groupBy(*TARGET).agg(
        F.array_sort(F.collect_list(F.struct("frame_no", "nearest_arcsec"))).alias("nearest"),
        F.count_if("detected").alias("detected_frames"),
        F.count_if(F.coalesce("candidate", F.lit(False))).alias("candidate_frames"),
    )
    named = identified.where("best_designation IS NOT NULL").selectExpr(
        "build_id", "best_designation AS designation", "tracklet_no", "tracklet_id", "status",
        "identification_status", "best_max_residual_arcsec",
    )
    best = first_per_group(
        named, TARGET,
        [F.expr("status <> 'built'"), F.col("best_max_residual_arcsec"), F.col("tracklet_no")],
    )
    return targets.select(*TARGET, "role").join(counts, TARGET, "left").join(best, TARGET, "left").withColumn(
        "recovered", F.coalesce(F.expr("identification_status = 'known'"), F.lit(False))
    )


def tracklet_motion_features(identified: DataFrame, ephemerides: DataFrame) -> DataFrame:
    """Tracklet motion against the first-frame prediction of its best match."""
    first = ephemerides.join(
        ephemerides.groupBy("build_id").agg(F.min("frame_no").alias("frame_no")), FRAME, "left_semi"
    )
    rate, angle = predicted_motion("motion_ra", "motion_dec")
    predicted = first.selectExpr(
        "build_id", "designation AS best_designation", f"{rate} AS predicted_rate", f"{angle} AS predicted_angle"
    )
    return identified.join(predicted, ["build_id", "best_designation"], "left").selectExpr(
        "*",
        "angular_velocity_arcsec_per_min - predicted_rate AS rate_difference",
        f"{angle_difference('position_angle_deg', 'predicted_angle')} AS angle_difference",
    )


def field_counters(identified: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counters of each build's run."""
    tracks = identified.groupBy("build_id").agg(
        F.count("*").alias("tracklets"),
        F.expr("count_if(status = 'built')").alias("built"),
        F.expr("count_if(identification_status = 'known')").alias("known"),
        F.expr("count_if(identification_status = 'unknown')").alias("unknown"),
        F.expr("count_if(identification_status = 'ambiguous')").alias("ambiguous"),
        F.expr("count_if(identification_status = 'unknown' AND status = 'built')").alias("unknown_built"),
    )
    roles = ("primary", "marginal", "control")
    found = outcomes.groupBy("build_id").agg(
        *[F.expr(f"count_if(role = '{r}')").alias(f"{r}_targets") for r in roles],
        *[F.expr(f"count_if(role = '{r}' AND recovered)").alias(f"{r}_recovered") for r in roles],
    )
    out = tracks.join(found, "build_id", "full_outer")
    return out.fillna(0, [c for c in out.columns if c != "build_id"])


# --- acceptance -----------------------------------------------------------------


def acceptance(
    targets: DataFrame,
    members: DataFrame,
    identified: DataFrame,
    max_position_residual: float = 1.0,
    max_rate_difference: float = 0.02,
    max_angle_difference: float = 2.0,
    config: BuildConfig = DEFAULT,
) -> DataFrame:
    """Levels per target: geometric, astrometric, identification.

    A tracklet counts as the target's when every member lies within the match
    radius of that frame's prediction.
    """
    positions = target_positions(targets)
    sizes = members.groupBy("build_id", "tracklet_no").agg(F.count("*").alias("n_members"))
    near = cell_join(
        positions,
        members.selectExpr(*FRAME, "tracklet_no", "ra AS m_ra", "dec AS m_dec"),
        config.match_radius_arcsec,
        on=FRAME,
        left_pos=("t_ra", "t_dec"),
        right_pos=("m_ra", "m_dec"),
    )
    linked = (
        near.groupBy(*TARGET, "tracklet_no")
        .agg(F.count("*").alias("n"), F.max("separation").alias("max_position_residual"))
        .join(sizes, ["build_id", "tracklet_no"])
        .where("n = n_members")
        .join(
            identified.select(
                "build_id", "tracklet_no", "status", "identification_status", "best_designation",
                "angular_velocity_arcsec_per_min", "position_angle_deg",
            ),
            ["build_id", "tracklet_no"],
        )
    )
    best = first_per_group(
        linked, TARGET,
        [F.expr("status <> 'built'"), F.col("max_position_residual"), F.col("tracklet_no")],
    )
    joined = targets.join(best, TARGET, "left").selectExpr(
        "*",
        "angular_velocity_arcsec_per_min - predicted_rate AS rate_difference",
        f"{angle_difference('position_angle_deg', 'predicted_angle')} AS angle_difference",
    )
    geometric = "coalesce(status = 'built' AND n_members >= 3, false)"
    astrometric = (
        f"coalesce(max_position_residual <= {float(max_position_residual)!r}D"
        f" AND abs(rate_difference) <= {float(max_rate_difference)!r}D"
        f" AND abs(angle_difference) <= {float(max_angle_difference)!r}D, false)"
    )
    named = "coalesce(identification_status = 'known' AND best_designation = designation, false)"
    failed = (
        "CASE WHEN NOT geometric THEN 'geometric' WHEN NOT astrometric THEN 'astrometric'"
        " WHEN NOT identification THEN 'identification' END"
    )
    return joined.selectExpr(
        *TARGET, "role", "tracklet_no", "max_position_residual", "rate_difference", "angle_difference",
        "identification_status", "best_designation AS identified_as",
        f"{geometric} AS geometric", f"{astrometric} AS astrometric", f"{named} AS identification",
    ).selectExpr("*", f"{failed} AS failed_level", f"({failed}) IS NULL AS passed")


def acceptance_verdict(results: DataFrame, keys: list[str], regression_floor: int = 16) -> DataFrame:
    """Pass when enough targets pass, none is taken for another object and
    none is identified outside the tolerances."""
    wrong = "identification_status = 'known' AND identified_as <> designation"
    return results.groupBy(*keys).agg(
        F.count("*").alias("targets"),
        F.count_if("passed").alias("passed_targets"),
        F.expr(f"count_if({wrong})").alias("misidentified_targets"),
        F.expr("count_if(identification AND NOT astrometric)").alias("identified_but_astrometric_fail"),
    ).withColumn(
        "passed",
        (F.col("passed_targets") >= regression_floor)
        & (F.col("misidentified_targets") == 0)
        & (F.col("identified_but_astrometric_fail") == 0),
    )


