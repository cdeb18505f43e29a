"""Matching tracklets with the predicted positions of known objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import DEFAULT, BuildConfig
from driftline.functions.sky import separation, unit_vector, vector_position
from driftline.operators.celljoin import cell_join
from driftline.operators.guards import require

KNOWN, UNKNOWN, AMBIGUOUS = "known", "unknown", "ambiguous"
TRACKLET = ["build_id", "tracklet_no"]
FRAME = ["build_id", "frame_no"]
LISTING = "listing_no"


def last_per_designation(ephemerides: DataFrame, order: str) -> DataFrame:
    """One prediction per object and frame: the last listed one."""
    keys = [*FRAME, "designation"]
    payload = [c for c in ephemerides.columns if c not in keys]
    best = ephemerides.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.col(order)).alias("_last")
    )
    return best.select(*keys, "_last.*")


def require_fields(members: DataFrame, fields: DataFrame) -> DataFrame:
    """Members, failing when a used frame has no prediction field.

    A field may hold no objects; a missing one is an error, never "unknown".
    """
    known = fields.select(*FRAME).distinct().withColumn("_has_field", F.lit(True))
    joined = members.join(known, FRAME, "left")
    message = F.concat(
        F.lit("no known-object field for frame "), F.col("frame_no").cast("string"),
        F.lit(" of build "), F.col("build_id").cast("string"),
    )
    return require(joined, F.col("_has_field"), message).drop("_has_field")


def candidate_matches(
    members: DataFrame, ephemerides: DataFrame, config: BuildConfig = DEFAULT
) -> DataFrame:
    """Objects predicted in every member's frame and within the match radius
    of every member: one row per tracklet and object.

    ``ephemerides`` needs ``listing_no``, the place of a row in its listing: of
    several predictions of an object for one frame only the last one counts.

    The radius join keeps only close (member, prediction) pairs; an object
    that is close in all frames has as many of them as the tracklet has
    members. That count is the whole division, no list of objects is built.
    """
    rows = members if "n_members" in members.columns else members.join(
        members.groupBy(*TRACKLET).agg(F.count("*").alias("n_members")), TRACKLET
    )
    wanted = rows.selectExpr(
        *FRAME, "tracklet_no", "n_members", "minutes", "ra AS m_ra", "dec AS m_dec"
    )
    if LISTING not in ephemerides.columns:
        raise ValueError(f"predictions need their listing order in {LISTING!r}")
    predicted = last_per_designation(ephemerides, LISTING).select(
        *FRAME,
        "designation",
        "object_class",
        "v_magnitude",
        "position_error_arcsec",
        "predicted_ra",
        "predicted_dec",
    )
    close = cell_join(
        predicted,
        wanted,
        config.match_radius_arcsec,
        on=FRAME,
        left_pos=("predicted_ra", "predicted_dec"),
        right_pos=("m_ra", "m_dec"),
        name="residual",
    )
    grouped = close.groupBy("build_id", "tracklet_no", "designation").agg(
        F.first("n_members").alias("n_members"),
        F.count("*").alias("n_close"),
        F.expr("min_by(named_struct('c', object_class, 'v', v_magnitude), minutes)").alias("first"),
        F.max("position_error_arcsec").alias("position_error_arcsec"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms_residual_arcsec"),
        F.max("residual").alias("max_residual_arcsec"),
        F.expr(
            "array_sort(collect_list(named_struct('minutes', minutes, 'frame_no', frame_no,"
            " 'observed_ra', m_ra, 'observed_dec', m_dec, 'predicted_ra', predicted_ra,"
            " 'predicted_dec', predicted_dec, 'residual_arcsec', residual)))"
        ).alias("residuals"),
    )
    return grouped.where("n_close = n_members").selectExpr(
        *TRACKLET,
        "designation",
        "first.c AS object_class",
        "first.v AS v_magnitude",
        "position_error_arcsec",
        "rms_residual_arcsec",
        "max_residual_arcsec",
        "residuals",
    )


def identify(
    tracklets: DataFrame, matches: DataFrame, config: BuildConfig = DEFAULT
) -> DataFrame:
    """Status, reason and best match of every tracklet.

    One match: known (ambiguous when its position error exceeds the radius);
    several: ambiguous; none: unknown. Best = smallest (max, rms) residual.
    """
    r = config.match_radius_arcsec
    best = matches.groupBy(*TRACKLET).agg(
        F.count("*").alias("n_matches"),
        F.expr(
            "min_by(named_struct('designation', designation, 'position_error_arcsec',"
            " position_error_arcsec, 'max_residual_arcsec', max_residual_arcsec,"
            " 'rms_residual_arcsec', rms_residual_arcsec),"
            " struct(max_residual_arcsec, rms_residual_arcsec, designation))"
        ).alias("best"),
    )
    joined = tracklets.join(best, TRACKLET, "left")
    unsure = f"best.position_error_arcsec > {r!r}D"
    return joined.selectExpr(
        *[f"`{c}`" for c in tracklets.columns],
        "coalesce(n_matches, 0L) AS n_matches",
        f"CASE WHEN n_matches IS NULL THEN '{UNKNOWN}' WHEN n_matches > 1 OR {unsure}"
        f" THEN '{AMBIGUOUS}' ELSE '{KNOWN}' END AS identification_status",
        f"CASE WHEN n_matches IS NULL THEN 'no known object predicted within {r} arcsec of every detection'"
        f" WHEN n_matches > 1 THEN concat(n_matches, ' known objects within {r} arcsec of every detection')"
        f" WHEN {unsure} THEN concat('ephemeris position error ', best.position_error_arcsec,"
        f" ' arcsec exceeds the match radius {r} arcsec')"
        f" ELSE 'single known object within {r} arcsec of every detection' END AS identification_reason",
        "best.designation AS best_designation",
        "best.max_residual_arcsec AS best_max_residual_arcsec",
        "best.rms_residual_arcsec AS best_rms_residual_arcsec",
    )


def identification_counts(identified: DataFrame) -> DataFrame:
    """Tracklets per build by status."""
    return identified.groupBy("build_id").agg(
        F.count("*").alias("tracklet_count"),
        *[
            F.count_if(F.col("identification_status") == s).alias(f"{s}_count")
            for s in (KNOWN, UNKNOWN, AMBIGUOUS)
        ],
    )


def objects_per_frame(fields: DataFrame, ephemerides: DataFrame) -> DataFrame:
    """Predicted objects of every field, each once; 0 for an empty one."""
    counts = ephemerides.groupBy(*FRAME).agg(F.countDistinct("designation").alias("known_objects"))
    return (
        fields.select(*FRAME).distinct().join(counts, FRAME, "left").fillna(0, ["known_objects"])
    )


def covering_cone(
    points: DataFrame, keys: list[str], margin_arcsec: float, ra: str = "ra", dec: str = "dec"
) -> DataFrame:
    """Centre (mean direction) and radius in degrees holding all points."""
    x, y, z = unit_vector(ra, dec)
    mean = points.groupBy(*keys).agg(
        F.expr(f"avg({x})").alias("_x"), F.expr(f"avg({y})").alias("_y"), F.expr(f"avg({z})").alias("_z")
    )
    cra, cdec = vector_position("_x", "_y", "_z")
    centre = mean.selectExpr(*keys, f"{cra} AS center_ra", f"{cdec} AS center_dec")
    reach = F.expr(f"max({separation(ra, dec, 'center_ra', 'center_dec')})")
    return (
        points.join(centre, keys)
        .groupBy(*keys, "center_ra", "center_dec")
        .agg(((reach + margin_arcsec) / 3600.0).alias("radius_deg"))
    )


def known_objects_in_cones(
    ephemerides: DataFrame, cones: DataFrame, keys: list[str]
) -> DataFrame:
    """Predictions inside each build's cone (one cone per key)."""
    inside = separation("predicted_ra", "predicted_dec", "center_ra", "center_dec")
    return ephemerides.join(cones, keys).where(f"{inside} <= radius_deg * 3600D").select(
        ephemerides.columns
    )


def check_cone(ra: float, dec: float, radius_deg: float, epoch_jd: float) -> None:
    """Argument ranges of a cone search."""
    # Largest radius and the epoch range of the predictions.
    max_radius, first_epoch, last_epoch = 10.0, 2411320.0, 2473540.0
    if not 0.0 <= ra < 360.0:
        raise ValueError("ra must be in [0, 360)")
    if not -90.0 <= dec <= 90.0:
        raise ValueError("dec must be in [-90, 90]")
    if not 0.0 < radius_deg <= max_radius:
        raise ValueError(f"radius must be in (0, {max_radius}] degrees")
    if not first_epoch <= epoch_jd <= last_epoch:
        raise ValueError("epoch is outside the range of the predictions")


def cone_search(
    ephemerides: DataFrame, ra: float, dec: float, radius_deg: float, epoch_jd: float
) -> DataFrame:
    """Predictions at an epoch inside a cone; empty is a valid answer."""
    check_cone(ra, dec, radius_deg, epoch_jd)
    inside = separation("predicted_ra", "predicted_dec", ra, dec)
    return ephemerides.where(f"epoch_jd = {epoch_jd!r}D").where(
        f"{inside} <= {radius_deg * 3600.0!r}D"
    )
