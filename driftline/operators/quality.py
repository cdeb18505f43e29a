"""Quality features of tracklets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.sky import array_sum

TRACKLET = ["build_id", "tracklet_no"]
MEMBER = ["build_id", "frame_no", "det_no"]


def members_with_detections(tracklets: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per member with its measurements."""
    members = tracklets.selectExpr(
        "build_id", "tracklet_no", "status", "explode(members) AS m"
    ).selectExpr(
        "build_id", "tracklet_no", "status", "m.frame_no AS frame_no", "m.det_no AS det_no"
    )
    return members.join(detections, MEMBER)


def quality_features(members: DataFrame, with_sharp: bool = True) -> DataFrame:
    """Features per tracklet; a group has at most one row per frame.

    Extremes resolve ties in time order. Without raw sharp values (
    ``with_sharp=False``) availability is ``unavailable``.
    """
    values = (
        "array_sort(collect_list(named_struct('frame_no', frame_no, 'm', magnitude,"
        " 'e', magnitude_error"
    )
    values += ", 's', sharp)))" if with_sharp else ")))"
    grouped = members.groupBy(*TRACKLET).agg(
        F.first("status").alias("status"),
        F.count("*").alias("detection_count"),
        F.min("snr").alias("min_snr"),
        F.median("snr").alias("median_snr"),
        F.expr("min_by(named_struct('m', magnitude, 'e', magnitude_error), struct(magnitude, frame_no))").alias("bright"),
        F.expr("max_by(named_struct('m', magnitude, 'e', magnitude_error), struct(magnitude, -frame_no))").alias("faint"),
        F.expr("count_if(on_image_edge)").alias("edge_detection_count"),
        F.expr("count_if(mask_bits <> 0)").alias("masked_detection_count"),
        F.expr("count_if(on_image_edge OR mask_bits <> 0)").alias("flagged_detection_count"),
        F.expr("bit_or(mask_bits)").alias("mask_bits_union"),
        F.expr("bit_and(mask_bits)").alias("mask_bits_common"),
        F.expr(values).alias("v"),
    )
    rng, err = "(faint.m - bright.m)", "hypot(bright.e, faint.e)"
    weighted = array_sum("transform(v, x -> x.m / (x.e * x.e))")
    weights = array_sum("transform(v, x -> 1D / (x.e * x.e))")
    chi2 = array_sum("transform(v, x -> pow(x.m - w_mean, 2) / (x.e * x.e))")
    usable = "size(v) >= 2 AND forall(v, x -> x.e > 0)"
    if with_sharp:
        complete = "forall(v, x -> x.s IS NOT NULL)"
        sharp = [
            f"if({complete}, 'complete', 'partial') AS sharp_availability",
            "transform(v, x -> x.s) AS sharp_values",
            f"if({complete}, array_min(transform(v, x -> x.s)), NULL) AS sharp_min",
            f"if({complete}, array_max(transform(v, x -> x.s)), NULL) AS sharp_max",
            f"if({complete}, array_max(transform(v, x -> abs(x.s))), NULL) AS sharp_abs_max",
        ]
    else:
        sharp = [
            "'unavailable' AS sharp_availability",
            "CAST(array() AS array<double>) AS sharp_values",
            "CAST(NULL AS DOUBLE) AS sharp_min",
            "CAST(NULL AS DOUBLE) AS sharp_max",
            "CAST(NULL AS DOUBLE) AS sharp_abs_max",
        ]
    return grouped.selectExpr(
        "*", f"CASE WHEN {usable} THEN {weighted} / {weights} END AS w_mean"
    ).selectExpr(
        *TRACKLET,
        "status",
        "detection_count",
        "min_snr",
        "median_snr",
        f"{rng} AS magnitude_range_mag",
        f"CASE WHEN {err} > 0 THEN {rng} / {err} END AS magnitude_range_sigma",
        f"CASE WHEN w_mean IS NOT NULL THEN {chi2} END AS magnitude_chi2",
        "edge_detection_count",
        "masked_detection_count",
        "flagged_detection_count",
        "mask_bits_union",
        "mask_bits_common",
        *sharp,
    )


def shared_detection_counts(tracklets: DataFrame) -> DataFrame:
    """Per built tracklet: how many other built ones share a detection.

    The tracklets around a crowded detection are not paired with each other.
    The number of others in the union of the owners is counted by inclusion
    and exclusion: each tracklet lists the subsets of its shared members, a
    grouped count says how many tracklets hold each subset, and the signed
    counts add up. The work is linear in the number of tracklets.
    """
    members = tracklets.where("status = 'built'").selectExpr(
        *TRACKLET, "explode(members) AS m"
    ).selectExpr(*TRACKLET, "named_struct('f', m.frame_no, 'd', m.det_no) AS d")
    owners = members.groupBy("build_id", "d").agg(F.count("*").alias("n")).where("n > 1")
    shared = members.join(owners.drop("n"), ["build_id", "d"]).groupBy(*TRACKLET).agg(
        F.array_sort(F.collect_list("d")).alias("ds")
    )
    picks = "sequence(1, CAST(shiftleft(1, size(ds)) AS INT) - 1)"
    subset = "filter(ds, (x, i) -> getbit(mask, i) = 1)"
    subsets = shared.selectExpr(*TRACKLET, "ds", f"explode({picks}) AS mask").selectExpr(
        *TRACKLET, f"{subset} AS part", "if(bit_count(mask) % 2 = 1, 1L, -1L) AS sign"
    )
    holders = subsets.groupBy("build_id", "part").agg((F.count("*") - 1).alias("others"))
    counted = (
        subsets.join(holders.where("others > 0"), ["build_id", "part"])
        .groupBy(*TRACKLET)
        .agg(F.sum(F.col("sign") * F.col("others")).alias("shared_detection_tracklets"))
    )
    built = tracklets.where("status = 'built'").select(*TRACKLET)
    return built.join(counted, TRACKLET, "left").fillna(0, ["shared_detection_tracklets"])


def bits_of(mask: str) -> str:
    """Set bits of a mask as an array (SQL)."""
    return f"filter(sequence(0, 31), b -> getbit(CAST({mask} AS BIGINT), b) = 1)"


def mask_state(masked: str, count: str) -> str:
    return (
        f"CASE WHEN {masked} = 0 THEN 'unmasked' WHEN {masked} = {count} THEN 'all_masked'"
        " ELSE 'partially_masked' END"
    )


def detections_per_bit(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Detections per mask bit of each group (for instance each frame)."""
    return (
        detections.selectExpr(*keys, f"explode({bits_of('mask_bits')}) AS bit")
        .groupBy(*keys, "bit")
        .agg(F.count("*").alias("detections"))
    )
