"""Review ranking: percentile-sum score of the built tracklets of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.sky import separation, unit_vector, vector_position
from driftline.operators.ordered import cut_lineage, mid_rank_percentile, row_numbers

# The frozen review score. (feature, direction) in summation
# order; every input has the same weight; a missing value counts as 0.
REVIEW_INPUTS = (
    ("min_snr", 1),
    ("median_snr", 1),
    ("fit_rms_residual_arcsec", -1),
    ("magnitude_range_mag", -1),
    ("flagged_detection_count", -1),
    ("masked_detection_count", -1),
    ("sharp_abs_max", -1),
    ("shared_detection_tracklets", -1),
)
REVIEW_WEIGHT = 0.125
REVIEW_INTERCEPT = 0.0
MISSING_PERCENTILE = 0.0
FEATURE_DECIMALS = 6
VALIDATED_FRAME_COUNT = 3
# The cutout rule of a track (arcsec).
TRACK_MARGIN_ARCSEC = 30.0
MIN_TRACK_WINDOW_ARCSEC = 60.0
REJECTED_REASON = (
    "rejected by the tracklet fit (max residual above the configured limit); outside the"
    " ranked population (only built tracklets are ranked)"
)

TRACKLET = ["build_id", "tracklet_no"]


def review_features(tracklets: DataFrame, quality: DataFrame, shared: DataFrame) -> DataFrame:
    """The eight inputs of every built tracklet, rounded to six decimals.

    Stored: ranks and evidence read them several times.
    """
    fit = tracklets.where("status = 'built'").select(*TRACKLET, "fit_rms_residual_arcsec")
    wide = fit.join(quality.drop("status", "fit_rms_residual_arcsec"), TRACKLET).join(shared, TRACKLET)
    rounded = [
        f"round({name}, {FEATURE_DECIMALS}) AS {name}"
        if name.endswith(("snr", "arcsec", "mag", "max"))
        else name
        for name, _ in REVIEW_INPUTS
    ]
    return cut_lineage(wide.selectExpr(*TRACKLET, *rounded, "sharp_availability"))


def long_features(wide: DataFrame, keys: list[str], inputs) -> DataFrame:
    """One row per key and feature with its direction and value."""
    items = ", ".join(f"'{n}', {d}, CAST({n} AS DOUBLE)" for n, d in inputs)
    return wide.selectExpr(
        *keys, f"stack({len(inputs)}, {items}) AS (feature, direction, value)"
    )


def oriented_percentiles(long: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``percentile``: mid-rank among the group's present values of the
    feature, oriented so that higher is reviewed earlier."""
    oriented = long.withColumn("_oriented", F.col("direction") * F.col("value"))
    return mid_rank_percentile(oriented, [*group, "feature"], "_oriented").drop("_oriented")


def weighted_scores(
    percentiles: DataFrame, keys: list[str], weights: dict[str, float], intercept: float = 0.0
) -> DataFrame:
    """intercept + sum of weight x percentile, added in the given order (a
    plain ``sum`` would add in an arbitrary order and lose exactness)."""
    columns = [
        F.max(F.when(F.col("feature") == n, F.col("percentile"))).alias(f"_p{i}")
        for i, n in enumerate(weights)
    ]
    score = f"{float(intercept)!r}D"
    for i, w in enumerate(weights.values()):
        score = f"({score} + {float(w)!r}D * coalesce(_p{i}, {MISSING_PERCENTILE!r}D))"
    return percentiles.groupBy(*keys).agg(*columns).selectExpr(*keys, f"{score} AS score")


def review_scores(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(score per tracklet, evidence per tracklet and feature)."""
    evidence = oriented_percentiles(long_features(features, TRACKLET, REVIEW_INPUTS), ["build_id"])
    weights = {name: REVIEW_WEIGHT for name, _ in REVIEW_INPUTS}
    scores = weighted_scores(evidence, TRACKLET, weights, REVIEW_INTERCEPT)
    evidence = evidence.selectExpr(
        *TRACKLET,
        "feature",
        "if(direction > 0, 'higher_first', 'lower_first') AS direction",
        "value",
        "percentile",
        f"{REVIEW_WEIGHT!r}D AS weight",
        f"{REVIEW_WEIGHT!r}D * coalesce(percentile, {MISSING_PERCENTILE!r}D) AS contribution",
    )
    return scores, evidence


def review_order(scores: DataFrame) -> DataFrame:
    """``review_rank`` by descending score; equal scores keep build order."""
    return row_numbers(
        scores, ["build_id"], [F.col("score").desc(), F.col("tracklet_no")], "review_rank"
    )


def track_windows(tracklets: DataFrame) -> DataFrame:
    """Centre and square size (arcsec) of a cutout that holds each track."""
    parts = unit_vector("p.ra", "p.dec")
    total = [f"aggregate(transform(members, p -> {v}), 0D, (a, v) -> a + v)" for v in parts]
    ra, dec = vector_position("_x", "_y", "_z")
    extent = f"array_max(transform(members, p -> {separation('center_ra', 'center_dec', 'p.ra', 'p.dec')}))"
    size = (
        f"greatest({MIN_TRACK_WINDOW_ARCSEC!r}D, 10D * ceil((2D * {extent} +"
        f" {2 * TRACK_MARGIN_ARCSEC!r}D) / 10D))"
    )
    return tracklets.selectExpr(
        *TRACKLET,
        "members",
        *[f"{t} AS _{n}" for t, n in zip(total, "xyz")],
        f"{ra} AS center_ra",
        f"{dec} AS center_dec",
    ).selectExpr(*TRACKLET, "center_ra", "center_dec", f"{size} AS size_arcsec")


def review_ranking(tracklets: DataFrame, features: DataFrame) -> DataFrame:
    """Every tracklet: built ones ranked, rejected ones unranked with a reason,
    each with its view window."""
    scores, _ = review_scores(features)
    ranked = review_order(scores).join(features.select(*TRACKLET, "sharp_availability"), TRACKLET)
    views = track_windows(tracklets)
    base = tracklets.select(*TRACKLET, "tracklet_id", "status").join(views, TRACKLET)
    out = base.join(ranked, TRACKLET, "left")
    return out.withColumn(
        "unranked_reason", F.when(F.col("status") != "built", F.lit(REJECTED_REASON))
    )


def domain_notes(frames: DataFrame, features: DataFrame, default_config: bool = True) -> DataFrame:
    """Per build, how it differs from the validated kind of input."""
    seen = frames.groupBy("build_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("field", "ccd_id", "quadrant_id").alias("quadrants"),
        F.count_distinct(F.to_date("observed_at")).alias("nights"),
    )
    missing = features.groupBy("build_id").agg(
        F.count_if(F.col("sharp_abs_max").isNull()).alias("missing")
    )
    v = VALIDATED_FRAME_COUNT
    notes = [
        f"if(n <> {v}, concat(n, ' frames; validated on {v}-exposure sequences'), NULL)",
        "if(quadrants > 1, 'frames from more than one field/CCD/quadrant', NULL)",
        "if(nights > 1, 'frames from more than one UTC night', NULL)",
        "NULL" if default_config else "'pipeline config differs from the default'",
        "if(missing > 0, concat(missing, ' built tracklet(s) without a complete raw sharp:"
        " sharp_abs_max counts as percentile 0'), NULL)",
    ]
    return seen.join(missing, "build_id", "left").selectExpr(
        "build_id", f"array_compact(array({', '.join(notes)})) AS notes"
    )
