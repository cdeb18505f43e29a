"""Whole jobs: build, identify, rank, sweep, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import DEFAULT, BuildConfig
from driftline.functions.classify import population
from driftline.operators import identify, quality, ranking
from driftline.operators.metrics import label_of
from driftline.operators.ordered import cut_lineage, quantiles
from driftline.operators.tracklets import build_tracklets, tracklet_members

SUMMARY_PROBABILITIES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
SUMMARY_FEATURES = (
    "min_snr", "median_snr", "magnitude_range_mag", "magnitude_range_sigma", "sharp_min", "sharp_max",
    "angular_velocity_arcsec_per_min", "fit_rms_residual_arcsec", "fit_max_residual_arcsec",
)


@dataclass(frozen=True)
class Run:
    """Stored results of one job over all builds."""

    tracklets: DataFrame
    identified: DataFrame
    quality: DataFrame
    features: DataFrame
    ranking: DataFrame


def run(
    detections: DataFrame, frames: DataFrame, ephemerides: DataFrame, fields: DataFrame,
    config: BuildConfig = DEFAULT,
) -> Run:
    """Build, identify and rank every build.

    ``fields``: the frames (``build_id, frame_no``) for which predictions were
    made. A field without an object is valid, a frame without a field stops
    the job. ``ephemerides`` keeps the listing order in ``listing_no``.
    """
    tracklets = build_tracklets(detections, frames, config)
    members = identify.require_fields(tracklet_members(tracklets), fields)
    matches = identify.candidate_matches(members, ephemerides, config)
    identified = cut_lineage(identify.identify(tracklets, matches, config))
    features = cut_lineage(
        quality.quality_features(quality.members_with_detections(tracklets, detections))
    )
    shared = quality.shared_detection_counts(tracklets)
    review = ranking.review_features(tracklets, features, shared)
    return Run(tracklets, identified, features, review, ranking.review_ranking(tracklets, review))


def quality_records(result: Run, targets: DataFrame) -> DataFrame:
    """Quality features with identification and population of each tracklet."""
    keys = ["build_id", "tracklet_no"]
    roles = targets.selectExpr("build_id", "designation AS best_designation", "role AS target_role")
    ids = result.identified.select(
        *keys, "tracklet_id", "identification_status", "best_designation",
        "angular_velocity_arcsec_per_min", "fit_rms_residual_arcsec", "fit_max_residual_arcsec",
    )
    rows = ids.join(result.quality, keys).join(roles, ["build_id", "best_designation"], "left")
    return rows.withColumn(
        "population", F.expr(population("identification_status", "target_role"))
    )


def population_summaries(records: DataFrame, keys: list[str], features=SUMMARY_FEATURES) -> DataFrame:
    """Count, missing, extremes and inclusive quantiles of each feature per
    group, exact for groups of any size."""
    items = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    long = cut_lineage(
        records.selectExpr(*keys, f"stack({len(features)}, {items}) AS (feature, value)")
    )
    group = [*keys, "feature"]
    basics = long.groupBy(*group).agg(
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return basics.join(quantiles(long, group, "value", SUMMARY_PROBABILITIES), group, "left").fillna(
        0, ["count"]
    )


def population_histograms(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per group of detection counts, flags, edge hits, mask bits and
    sharp availability, in one long table."""
    parts = (
        "array(concat('detections=', detection_count), concat('flagged=', flagged_detection_count),"
        " concat('edge=', edge_detection_count), concat('sharp=', sharp_availability))"
    )
    bits = f"transform({quality.bits_of('mask_bits_union')}, b -> concat('bit=', b))"
    return (
        records.selectExpr(*keys, f"explode(concat({parts}, {bits})) AS item")
        .groupBy(*keys, "item")
        .agg(F.count("*").alias("tracklets"))
    )


def labelled_rows(records: DataFrame, eligible: DataFrame) -> DataFrame:
    """Feature-table rows with their label. ``eligible``: ``build_id,
    designation`` of the rate- and baseline-eligible targets."""
    wanted = eligible.selectExpr("build_id", "designation AS best_designation").distinct().withColumn(
        "_eligible", F.lit(True)
    )
    joined = records.join(wanted, ["build_id", "best_designation"], "left")
    label = label_of("status", "identification_status", "best_designation", "coalesce(_eligible, false)")
    return joined.withColumn("label", F.expr(label)).drop("_eligible")


def shares_with_positive(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Adds whether a background tracklet shares a detection with a positive
    one."""
    keys = ["build_id", "tracklet_no"]
    detection = ["build_id", "frame_no", "det_no"]
    used = (
        members.join(rows.where("label = 'positive'").select(*keys), keys, "left_semi")
        .select(*detection)
        .distinct()
    )
    sharing = (
        members.join(used, detection, "left_semi").select(*keys).distinct()
        .withColumn("_shares", F.lit(True))
    )
    return rows.join(sharing, keys, "left").withColumn(
        "shares_detection_with_positive",
        F.coalesce("_shares", F.lit(False)) & (F.col("label") == "background"),
    ).drop("_shares")


def presets(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame-sequence presets of the control and primary targets: the window
    around the predicted track and the build's frames in order."""
    sequence = frames.groupBy("build_id").agg(
        F.expr("transform(array_sort(collect_list(struct(frame_no, product_id))), f -> f.product_id)").alias(
            "product_ids"
        )
    )
    chosen = targets.where("role IN ('control', 'primary')")
    windows = ranking.track_windows(
        chosen.selectExpr("build_id", "designation AS tracklet_no", "positions AS members")
    ).withColumnRenamed("tracklet_no", "designation")
    order = "if(role = 'control', 0, 1) AS role_order"
    return (
        chosen.selectExpr("build_id", "designation", "role", order, "v_magnitude", "predicted_rate")
        .join(windows, ["build_id", "designation"])
        .join(sequence, "build_id")
    )


def conditions(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Conditions of each build: filters, times, depth and sources per frame."""
    counts = detections.groupBy("build_id", "frame_no").agg(F.count("*").alias("sources"))
    rows = frames.join(counts, ["build_id", "frame_no"], "left").fillna(0, ["sources"])
    item = "struct(frame_no, filter_code, minutes, maglimit, sources)"
    return rows.groupBy("build_id").agg(
        F.expr(f"array_sort(collect_list({item}))").alias("f")
    ).selectExpr(
        "build_id",
        "transform(f, x -> x.filter_code) AS filters",
        "transform(f, x -> round(x.minutes, 2)) AS minutes_from_first",
        "transform(f, x -> x.maglimit) AS maglimit_per_frame",
        "transform(f, x -> x.sources) AS sources_per_frame",
    )
