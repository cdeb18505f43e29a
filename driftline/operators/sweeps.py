"""Parameter sweeps on an axis: one build at the widest thresholds, annotated.

A threshold only decides which rows of a wider result count. So every stage
runs once, at the widest value of its thresholds, and keeps what decides: the
distance to the nearest partner in another frame, the separation of a seed,
the distance of a hit, the largest residuals of fit and match. Which
configurations a row belongs to is then a bit mask, computed inside the row.
No stage repeats per configuration, and no row is copied per configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import DEFAULT, BuildConfig
from driftline.operators import identify
from driftline.operators.celljoin import cell_join
from driftline.operators.ordered import cut_lineage, spread
from driftline.operators.tracklets import (
    _IDENTITY,
    SEED_KEY,
    _member,
    _partners,
    fit_motion,
    seed_pairs,
    seed_predictions,
    tracklet_members,
    with_sequence,
)

# One-at-a-time sweep around the defaults.
SWEEP = {
    "stationary_tolerance_arcsec": (0.5, 1.0, 1.5, 2.0, 3.0),
    "max_rate_arcsec_per_min": (0.5, 0.75, 1.0, 1.5, 2.0),
    "search_radius_arcsec": (0.5, 1.0, 2.0, 3.0),
    "max_residual_arcsec": (0.25, 0.5, 1.0, 2.0),
    "match_radius_arcsec": (0.5, 1.0, 2.0, 5.0),
}
# Linking configurations share one 64-bit mask.
MAX_LINKINGS = 62


def sweep_configs(base: BuildConfig = DEFAULT, grid=None) -> dict[str, BuildConfig]:
    """One-at-a-time variations of the base configuration (itself left out)."""
    return {
        f"{name}={value:g}": base.with_value(name, value)
        for name, values in (grid or SWEEP).items()
        for value in values
        if getattr(base, name) != value
    }


def _linking(config: BuildConfig) -> tuple:
    return (
        config.stationary_tolerance_arcsec, config.max_rate_arcsec_per_min,
        config.search_radius_arcsec, config.min_detections,
    )


def nearest_partner(detections: DataFrame, reach: float) -> DataFrame:
    """Adds ``still``: arcsec to the nearest detection of another frame,
    infinite beyond ``reach``. A detection is stationary at a tolerance (up
    to ``reach``) when ``still`` does not exceed it."""
    keys = ["build_id", "frame_no", "det_no"]
    pairs = cell_join(
        detections, _partners(detections), reach, on=["build_id"], extra="frame_no <> frame2", cell_factor=8.0,
    )
    nearest = pairs.groupBy(*keys).agg(F.min("separation").alias("still"))
    return detections.join(nearest, keys, "left").withColumn(
        "still", F.coalesce("still", F.lit(float("inf")))
    )


def _mask(bits: dict[int, str]) -> str:
    """SQL of a mask whose bit k is set when condition k holds."""
    return "(" + " | ".join(f"if({c}, {1 << k}L, 0L)" for k, c in bits.items()) + ")"


def annotated_sets(detections: DataFrame, frames: DataFrame, linkings: list[tuple]) -> DataFrame:
    """``build_id, members, linkings``: every member set that some linking
    configuration keeps; bit k of ``linkings`` stands for the k-th one.

    ``linkings``: (stationary tolerance, largest rate, search radius, smallest
    size) of each.
    """
    if len(linkings) > MAX_LINKINGS:
        raise ValueError(f"at most {MAX_LINKINGS} linking configurations in one sweep")
    tolerances, rates, radii, _ = (sorted(set(v)) for v in zip(*linkings, strict=True))
    marked = nearest_partner(
        detections.select("build_id", "frame_no", "det_no", "ra", "dec"), tolerances[-1]
    )
    moving = with_sequence(marked.where(f"still > {tolerances[0]!r}D"), frames, ("still",))
    moving = cut_lineage(spread(moving, "build_id", "frame_no", "det_no"))
    # A seed belongs to the configurations whose limits both sides keep.
    widest = DEFAULT.with_value("max_rate_arcsec_per_min", rates[-1])
    gap = "(minutes_b - minutes_a)"
    both = "least(still_a, still_b)"
    seeds = seed_pairs(moving, widest, carry=("still",)).withColumn(
        "linkings",
        F.expr(_mask({
            k: f"{both} > {tol!r}D AND separation <= {gap} * {rate!r}D"
            for k, (tol, rate, _, _) in enumerate(linkings)
        })),
    ).where("linkings <> 0")
    # Hits at the largest radius; the nearest one for each pair of tolerance
    # and radius is an aggregate of bounded size.
    targets = moving.select(
        "build_id", "frame_no", "det_no", F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"),
        F.col("still").alias("c_still"),
    )
    hits = cell_join(
        seed_predictions(seeds, ("linkings",)), targets, radii[-1], on=["build_id", "frame_no"],
        left_pos=("pred_ra", "pred_dec"), right_pos=("c_ra", "c_dec"), cell_factor=8.0, name="distance",
    ).repartition(*SEED_KEY)
    reaches = sorted({(tol, radius) for tol, _, radius, _ in linkings})
    member = _member("frame_no", "det_no", "minutes", "c_ra", "c_dec")
    nearest = hits.groupBy(*SEED_KEY, "frame_no").agg(
        F.first("first").alias("first"), F.first("second").alias("second"), F.first("linkings").alias("linkings"),
        *[
            F.expr(
                f"min_by({member}, struct(distance, c_dec, det_no)) FILTER"
                f" (WHERE c_still > {tol!r}D AND distance <= {radius!r}D) AS near_{n}"
            )
            for n, (tol, radius) in enumerate(reaches)
        ],
    )
    linked = nearest.groupBy(*SEED_KEY).agg(
        F.first("first").alias("first"), F.first("second").alias("second"), F.first("linkings").alias("linkings"),
        # A list of at most one member per frame; absent ones are left out.
        *[F.collect_list(f"near_{n}").alias(f"near_{n}") for n in range(len(reaches))],
    )
    options = ", ".join(
        f"named_struct('bit', {1 << k}L, 'least', {least}, 'found', near_{reaches.index((tol, radius))})"
        for k, (tol, _, radius, least) in enumerate(linkings)
    )
    sets = (
        linked.selectExpr("build_id", "first", "second", "linkings", f"inline(array({options}))")
        .where("linkings & bit <> 0 AND size(found) + 2 >= least")
        .selectExpr("build_id", "array_sort(concat(found, array(first, second))) AS members", "bit")
        .groupBy("build_id", "members")
        .agg(F.expr("bit_or(bit)").alias("linkings"))
    )
    return without_subsets(cut_lineage(sets))


def without_subsets(sets: DataFrame) -> DataFrame:
    """Each set without the configurations in which it is a strict subset of
    another set. Supersets are found by the first three members, as a superset
    holds them."""
    larger = sets.where("size(members) >= 4").selectExpr(
        "build_id AS b2", f"{_IDENTITY} AS other", "linkings AS other_linkings"
    )
    triples = (
        "flatten(flatten(transform(sequence(1, size(other) - 2), i ->"
        " transform(sequence(i + 1, size(other) - 1), j ->"
        " transform(sequence(j + 1, size(other)), k ->"
        " array(other[i - 1], other[j - 1], other[k - 1]))))))"
    )
    index = larger.selectExpr("b2", "other", "other_linkings", f"explode({triples}) AS t2")
    inside = F.expr(
        f"build_id = b2 AND slice({_IDENTITY}, 1, 3) = t2 AND size(members) < size(other)"
        f" AND linkings & other_linkings <> 0 AND size(array_except({_IDENTITY}, other)) = 0"
    )
    covered = sets.join(index, inside).groupBy("build_id", "members").agg(
        F.expr("bit_or(other_linkings)").alias("covered")
    )
    left = sets.join(covered, ["build_id", "members"], "left")
    return left.selectExpr(
        "build_id", "members", "linkings & ~coalesce(covered, 0L) AS linkings"
    ).where("linkings <> 0")


def annotated_tracklets(
    detections: DataFrame, frames: DataFrame, ephemerides: DataFrame, configs: dict[str, BuildConfig]
) -> tuple[DataFrame, list[tuple], list[float]]:
    """Fitted tracklets of all configurations, with ``linkings`` and, for the
    n-th match radius, ``matches_n`` and the best match's ``error_n``; then the
    linking configurations and the match radii by their numbers."""
    linkings = sorted({_linking(c) for c in configs.values()})
    radii = sorted({c.match_radius_arcsec for c in configs.values()})
    fitted = fit_motion(annotated_sets(detections, frames, linkings)).withColumns(
        {
            "tracklet_no": F.monotonically_increasing_id(),
            "tracklet_id": F.lit(None).cast("string"),
            "status": F.lit(None).cast("string"),
        }
    )
    # Stored before the numbers are read twice.
    fitted = cut_lineage(fitted)
    matches = identify.candidate_matches(
        tracklet_members(fitted), ephemerides, DEFAULT.with_value("match_radius_arcsec", radii[-1])
    )
    # Within a radius of every member: the largest residual does not exceed it.
    best = matches.groupBy("build_id", "tracklet_no").agg(
        *[F.count_if(F.col("max_residual_arcsec") <= r).alias(f"matches_{n}") for n, r in enumerate(radii)],
        *[
            F.expr(
                "min_by(position_error_arcsec, struct(max_residual_arcsec, rms_residual_arcsec, designation))"
                f" FILTER (WHERE max_residual_arcsec <= {r!r}D) AS error_{n}"
            )
            for n, r in enumerate(radii)
        ],
    )
    return fitted.join(best, ["build_id", "tracklet_no"], "left"), linkings, radii


def sweep(
    detections: DataFrame, frames: DataFrame, ephemerides: DataFrame, configs: dict[str, BuildConfig]
) -> DataFrame:
    """Status counters: ``build_id, tracklets, built, known, unknown_built,
    config``, for every build in which a configuration has tracklets."""
    rows, linkings, radii = annotated_tracklets(detections, frames, ephemerides, configs)
    counters, items = [], []
    for k, (name, config) in enumerate(configs.items()):
        n, r = radii.index(config.match_radius_arcsec), config.match_radius_arcsec
        here = f"linkings & {1 << linkings.index(_linking(config))}L <> 0"
        built = f"{here} AND NOT fit_max_residual_arcsec > {config.max_residual_arcsec!r}D"
        none = f"coalesce(matches_{n}, 0L) = 0"
        conditions = {
            "tracklets": here,
            "built": built,
            "known": f"{here} AND matches_{n} = 1 AND NOT coalesce(error_{n} > {r!r}D, false)",
            "unknown_built": f"{built} AND {none}",
        }
        counters += [F.expr(f"count_if({c})").alias(f"{m}_{k}") for m, c in conditions.items()]
        items.append(f"'{name}', " + ", ".join(f"{m}_{k}" for m in conditions))
    counted = rows.groupBy("build_id").agg(*counters)
    long = counted.selectExpr(
        "build_id", f"stack({len(items)}, {', '.join(items)}) AS (config, tracklets, built, known, unknown_built)"
    )
    return long.where("tracklets > 0").select("build_id", "tracklets", "built", "known", "unknown_built", "config")
