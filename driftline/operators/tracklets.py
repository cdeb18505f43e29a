"""Stationary separation, seed linking and tracklet fitting.

Input tables (all keyed by ``build_id``):

* detections: ``frame_no, det_no, ra, dec`` and any measurements; ``det_no``
  is the catalog order inside a frame and breaks every tie;
* frames: ``frame_no, minutes`` (from the first exposure).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import DEFAULT, MAX_SEQUENCE_FRAMES, BuildConfig
from driftline.functions.sky import array_sum, bearing, offset_position, sky_offsets, wrap360
from driftline.operators.celljoin import cell_join
from driftline.operators.guards import require
from driftline.operators.ordered import cut_lineage, row_numbers, spread

BUILT = "built"
REJECTED = "rejected"


# --- stationary sources -----------------------------------------------------


def _partners(detections: DataFrame) -> DataFrame:
    # Copies at one position are one partner: they cannot pile up in a cell.
    return detections.select(
        "build_id",
        F.col("frame_no").alias("frame2"),
        F.col("ra").alias("ra2"),
        F.col("dec").alias("dec2"),
    ).distinct()


def moving_candidates(detections: DataFrame, tolerance: float) -> DataFrame:
    """Detections without a partner within ``tolerance`` in another frame."""
    return cell_join(
        detections,
        _partners(detections),
        tolerance,
        on=["build_id"],
        how="left_anti",
        extra="frame_no <> frame2",
        cell_factor=8.0,
    )


def stationary_detections(detections: DataFrame, tolerance: float) -> DataFrame:
    """Detections with a partner within ``tolerance`` in another frame."""
    return cell_join(
        detections,
        _partners(detections),
        tolerance,
        on=["build_id"],
        how="left_semi",
        extra="frame_no <> frame2",
        cell_factor=8.0,
    )


def mark_stationary(detections: DataFrame, tolerance: float) -> DataFrame:
    """All detections with ``is_stationary``; keyed by (build, frame, det)."""
    keys = ["build_id", "frame_no", "det_no"]
    found = stationary_detections(detections, tolerance).select(
        *keys, F.lit(True).alias("is_stationary")
    )
    return detections.join(found, keys, "left").withColumn(
        "is_stationary", F.coalesce("is_stationary", F.lit(False))
    )


def check_frames(frames: DataFrame) -> DataFrame:
    """Frames of every build: two to ten of them, strictly later each time.

    A longer sequence stops the job. Rows per build, members per tracklet and
    their subsets stay small because of this limit.
    """
    per_build = frames.groupBy("build_id").agg(
        F.array_sort(F.collect_list(F.struct("frame_no", "minutes"))).alias("sequence")
    )
    times = "transform(sequence, f -> f.minutes)"
    later = F.expr(
        f"forall(zip_with(slice({times}, 2, size(sequence)), {times}, (b, a) -> b > a), ok -> "
        "coalesce(ok, true))"
    )
    per_build = require(
        per_build, F.size("sequence") >= 2, "stationary matching needs at least two frames"
    )
    per_build = require(
        per_build, F.size("sequence") <= MAX_SEQUENCE_FRAMES,
        f"a sequence has at most {MAX_SEQUENCE_FRAMES} frames",
    )
    return require(per_build, later, "frames must be in strictly increasing time order")


# --- seeds and extension ----------------------------------------------------


def with_sequence(candidates: DataFrame, frames: DataFrame, carry: tuple = ()) -> DataFrame:
    """Candidates with their build's frames (``sequence``), own time and the
    columns of ``carry``.

    Everything the linking needs, so frames are joined once and not again for
    seeds and predictions.
    """
    joined = candidates.select("build_id", "frame_no", "det_no", "ra", "dec", *carry).join(
        check_frames(frames), "build_id"
    )
    own = "filter(sequence, f -> f.frame_no = frame_no)[0].minutes AS minutes"
    return joined.selectExpr("*", own)


SEED_KEY = ["build_id", "frame_a", "det_a", "frame_b", "det_b"]


def _side(sequenced: DataFrame, own: str, other: str, max_rate: float, carry: tuple = ()) -> DataFrame:
    """Candidates once per partner frame: later ones for side a, earlier for b."""
    later = ">" if own == "a" else "<"
    partners = f"filter(sequence, f -> f.frame_no {later} frame_no)"
    wide = sequenced.selectExpr("*", f"explode({partners}) AS p")
    return wide.selectExpr(
        "build_id",
        f"frame_no AS frame_{own}",
        f"p.frame_no AS frame_{other}",
        f"det_no AS det_{own}",
        f"ra AS ra_{own}",
        f"dec AS dec_{own}",
        f"minutes AS minutes_{own}",
        f"abs(p.minutes - minutes) * {float(max_rate)!r}D AS seed_radius",
        *(["sequence"] if own == "a" else []),
        *[f"{c} AS {c}_{own}" for c in carry],
    )


def seed_pairs(
    sequenced: DataFrame, config: BuildConfig = DEFAULT, carry: tuple = (), extra: str | None = None
) -> DataFrame:
    """Candidate pairs of two frames whose implied rate is within the limit.

    A column ``c`` of ``carry`` comes as ``c_a`` and ``c_b``; ``extra`` is a
    further condition on both sides.
    """
    return cell_join(
        _side(sequenced, "a", "b", config.max_rate_arcsec_per_min, carry),
        _side(sequenced, "b", "a", config.max_rate_arcsec_per_min, carry),
        "seed_radius",
        on=["build_id", "frame_a", "frame_b"],
        left_pos=("ra_a", "dec_a"),
        right_pos=("ra_b", "dec_b"),
        cell_factor=2.0,
        extra=extra,
    )


def _member(frame, det, minutes, ra, dec) -> str:
    return (
        f"named_struct('frame_no', {frame}, 'det_no', {det}, 'minutes', {minutes},"
        f" 'ra', {ra}, 'dec', {dec})"
    )


def seed_predictions(seeds: DataFrame, carry: tuple = ()) -> DataFrame:
    """Where each seed should be in every other frame of its build."""
    others = "filter(sequence, f -> f.frame_no <> frame_a AND f.frame_no <> frame_b)"
    wide = seeds.selectExpr(
        *SEED_KEY,
        _member("frame_a", "det_a", "minutes_a", "ra_a", "dec_a") + " AS first",
        _member("frame_b", "det_b", "minutes_b", "ra_b", "dec_b") + " AS second",
        f"{bearing('ra_b', 'dec_b', 'ra_a', 'dec_a')} + pi() AS heading",
        "separation / (minutes_b - minutes_a) AS rate",
        f"explode({others}) AS o",
        *carry,
    )
    wide = wide.selectExpr("*", "rate * (o.minutes - second.minutes) AS distance")
    ra, dec = offset_position("second.ra", "second.dec", "heading", "distance")
    return wide.selectExpr(
        *SEED_KEY,
        "first",
        "second",
        "o.frame_no AS frame_no",
        "o.minutes AS minutes",
        f"{ra} AS pred_ra",
        f"{dec} AS pred_dec",
        *carry,
    )


def extensions(
    seeds: DataFrame, sequenced: DataFrame, config: BuildConfig = DEFAULT
) -> DataFrame:
    """Nearest candidate to each prediction, with the number within reach.

    Ties: distance, then declination, then catalog order. Only (seed, frame)
    pairs with a hit appear. The hits are hashed on the seed alone, so the
    grouping per frame and the later grouping per seed share one shuffle.
    """
    targets = sequenced.select(
        "build_id", "frame_no", "det_no", F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec")
    )
    hits = cell_join(
        seed_predictions(seeds),
        targets,
        config.search_radius_arcsec,
        on=["build_id", "frame_no"],
        left_pos=("pred_ra", "pred_dec"),
        right_pos=("c_ra", "c_dec"),
        cell_factor=8.0,
        name="distance",
    ).repartition(*SEED_KEY)
    nearest = F.expr(
        f"min_by({_member('frame_no', 'det_no', 'minutes', 'c_ra', 'c_dec')},"
        " struct(distance, c_dec, det_no))"
    )
    return hits.groupBy(*SEED_KEY, "frame_no").agg(
        F.first("first").alias("first"),
        F.first("second").alias("second"),
        nearest.alias("nearest"),
        F.count("*").alias("within_reach"),
    )


def linked_sets(extended: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """Time-ordered members of every seed that reaches the minimum size."""
    linked = extended.groupBy(*SEED_KEY).agg(
        F.first("first").alias("first"),
        F.first("second").alias("second"),
        F.collect_list("nearest").alias("found"),
    )
    members = F.array_sort(F.concat("found", F.array("first", "second")))
    return linked.select("build_id", members.alias("members")).where(
        F.size("members") >= config.min_detections
    )


def unique_sets(linked: DataFrame) -> DataFrame:
    """Each member set once, with the number of seeds that led to it."""
    return linked.groupBy("build_id", "members").agg(F.count("*").alias("seeds"))


_IDENTITY = "transform(members, m -> named_struct('frame_no', m.frame_no, 'det_no', m.det_no))"


def drop_subsets(sets: DataFrame) -> DataFrame:
    """Remove member sets that are strict subsets of another set.

    A superset has at least four members and holds the first three members of
    the subset, so supersets are indexed by their member triples. Two sets
    that share three detections are few, unlike two that share one.
    """
    larger = sets.where("size(members) >= 4").selectExpr("build_id AS b2", f"{_IDENTITY} AS other")
    triples = (
        "flatten(flatten(transform(sequence(1, size(other) - 2), i ->"
        " transform(sequence(i + 1, size(other) - 1), j ->"
        " transform(sequence(j + 1, size(other)), k ->"
        " array(other[i - 1], other[j - 1], other[k - 1]))))))"
    )
    index = larger.selectExpr("b2", "other", f"explode({triples}) AS t2")
    inside = F.expr(
        f"build_id = b2 AND slice({_IDENTITY}, 1, 3) = t2 AND size(members) < size(other)"
        f" AND size(array_except({_IDENTITY}, other)) = 0"
    )
    return sets.join(index, inside, "left_anti")


# --- fit --------------------------------------------------------------------


def fit_motion(df: DataFrame, members: str = "members") -> DataFrame:
    """Straight-line fit of the members in sky offsets about the first one.

    Computed inside the row (a set has at most one member per frame), so no
    shuffle is needed. Adds velocity, position angle, RMS and largest residual.
    """
    df = require(df, F.size(members) >= 3, "a tracklet fit needs at least three detections")
    columns = df.columns
    east, north = sky_offsets("m.ra", "m.dec", f"{members}[0].ra", f"{members}[0].dec")
    points = (
        f"transform({members}, m -> named_struct('t', m.minutes - {members}[0].minutes,"
        f" 'e', {east}, 'n', {north}))"
    )

    def slope(v: str) -> str:
        cov = array_sum(f"transform(_pts, p -> (p.t - _mt) * (p.{v} - _m{v}))")
        return f"{cov} / {array_sum('transform(_pts, p -> (p.t - _mt) * (p.t - _mt))')}"

    residual = (
        "hypot(p.e - _me - _se * (p.t - _mt), p.n - _mn - _sn * (p.t - _mt))"
    )
    return df.selectExpr(
        "*",
        f"{points} AS _pts",
        *[f"{array_sum(f'transform(_pts, p -> p.{v})')} / size(_pts) AS _m{v}" for v in "ten"],
        f"{slope('e')} AS _se",
        f"{slope('n')} AS _sn",
        f"transform(_pts, p -> {residual}) AS _res",
    ).selectExpr(
        *columns,
        "hypot(_se, _sn) AS angular_velocity_arcsec_per_min",
        f"{wrap360('degrees(atan2(_se, _sn))')} AS position_angle_deg",
        f"sqrt({array_sum('transform(_res, r -> r * r)')} / size(_res)) AS fit_rms_residual_arcsec",
        "array_max(_res) AS fit_max_residual_arcsec",
    )


def with_status(df: DataFrame, max_residual: float) -> DataFrame:
    """``built`` or ``rejected`` (largest residual above the limit) and why."""
    poor = F.col("fit_max_residual_arcsec") > max_residual
    reason = F.format_string(
        f"max fit residual %.2f arcsec exceeds {max_residual} arcsec",
        F.col("fit_max_residual_arcsec"),
    )
    return df.withColumns(
        {
            "status": F.when(poor, F.lit(REJECTED)).otherwise(F.lit(BUILT)),
            "status_reason": F.when(poor, reason),
        }
    )


# --- whole build ------------------------------------------------------------


def prepare(detections: DataFrame, frames: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """Stored moving candidates of every build, ready for linking.

    They are a small part of the detections and are read three times.
    """
    candidates = moving_candidates(
        detections.select("build_id", "frame_no", "det_no", "ra", "dec"),
        config.stationary_tolerance_arcsec,
    )
    ready = with_sequence(candidates, frames)
    return cut_lineage(spread(ready, "build_id", "frame_no", "det_no"))


def member_sets(sequenced: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """Deduplicated, maximal member sets of every build."""
    linked = linked_sets(extensions(seed_pairs(sequenced, config), sequenced, config), config)
    # Stored, because the subset check reads the sets from both sides.
    return drop_subsets(cut_lineage(unique_sets(linked))).drop("seeds")


def number_tracklets(sets: DataFrame) -> DataFrame:
    """Build order: lexicographic by members; ids ``trk-0001``, ..."""
    numbered = row_numbers(
        sets.withColumn("_order", F.expr(_IDENTITY)),
        ["build_id"],
        ["_order"],
        "tracklet_no",
    ).drop("_order")
    return numbered.withColumn(
        "tracklet_id",
        F.when(
            F.col("tracklet_no") < 10000, F.concat(F.lit("trk-"), F.lpad("tracklet_no", 4, "0"))
        ).otherwise(F.concat(F.lit("trk-"), F.col("tracklet_no"))),
    )


def build_tracklets(
    detections: DataFrame, frames: DataFrame, config: BuildConfig = DEFAULT
) -> DataFrame:
    """Detections to fitted tracklets, all builds in one plan.

    One row per tracklet: ``build_id, tracklet_no, tracklet_id, members``,
    the fit, ``status`` and ``status_reason``. The result is stored, so the
    linking does not run again for the operators that read it.
    """
    fitted = fit_motion(number_tracklets(member_sets(prepare(detections, frames, config), config)))
    return cut_lineage(with_status(fitted, config.max_residual_arcsec))


def tracklet_members(tracklets: DataFrame) -> DataFrame:
    """One row per tracklet and member."""
    return tracklets.select(
        "build_id", "tracklet_no", "tracklet_id", "status", F.explode("members").alias("m")
    ).select("build_id", "tracklet_no", "tracklet_id", "status", "m.*")


def build_diagnostics(
    detections: DataFrame,
    frames: DataFrame,
    config: BuildConfig = DEFAULT,
) -> DataFrame:
    """Counters of each build's stages, one row per build."""
    candidates = prepare(detections, frames, config)
    seeds = cut_lineage(seed_pairs(candidates, config))
    extended = cut_lineage(extensions(seeds, candidates, config))
    unique = cut_lineage(unique_sets(linked_sets(extended, config)))
    tracklets = with_status(fit_motion(drop_subsets(unique)), config.max_residual_arcsec)

    usage = (
        tracklets.select("build_id", F.expr(f"explode({_IDENTITY}) AS m"))
        .groupBy("build_id", "m")
        .agg(F.count("*").alias("uses"))
        .groupBy("build_id")
        .agg(F.count_if(F.col("uses") > 1).alias("detections_in_multiple_tracklets"))
    )
    stages = [
        frames.groupBy("build_id").agg(F.count("*").alias("frame_count")),
        candidates.groupBy("build_id").agg(F.count("*").alias("candidate_count")),
        seeds.groupBy("build_id").agg(F.count("*").alias("seed_pairs")),
        extended.groupBy("build_id").agg(
            F.count_if(F.col("within_reach") > 1).alias("ambiguous_extensions")
        ),
        unique.groupBy("build_id").agg(
            F.sum("seeds").alias("linked_before_dedup"), F.count("*").alias("unique_count")
        ),
        tracklets.groupBy("build_id").agg(
            F.count("*").alias("tracklet_count"),
            F.count_if(F.col("status") == REJECTED).alias("rejected_tracklet_count"),
        ),
        usage,
    ]
    out = stages[0]
    for stage in stages[1:]:
        out = out.join(stage, "build_id", "left")
    counters = [c for c in out.columns if c != "build_id"]
    out = out.fillna(0, counters)
    return out.withColumns(
        {
            "duplicates_removed": F.col("linked_before_dedup") - F.col("unique_count"),
            "subsets_removed": F.col("unique_count") - F.col("tracklet_count"),
        }
    ).drop("unique_count")


