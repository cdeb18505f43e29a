"""Search for objects passing near a star, and budgeted night selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import DEFAULT, BuildConfig
from driftline.functions.sky import baseline_eligible, extrapolate, predicted_motion, separation
from driftline.operators.ordered import cut_lineage, first_per_group, row_numbers, running_totals
from driftline.operators.targets import MARGINAL_MARGIN, MAX_POSITION_ERROR, PRIMARY_MARGIN

# Trigger distance and the two searches' budgets.
TRIGGER_NEAR_ARCSEC = 120.0
TRIGGER_REACH_ARCSEC = (120.0, 60.0)
# ``counts``: what the wanted number refers to; ``max_cones``: lookups.
EXPLORATORY = {
    "max_stars": 60, "max_nights": 15, "per_star": 1, "wanted": 12, "counts": "nights", "max_cones": None,
}
CONFIRMATORY = {
    "max_stars": 300, "max_nights": 20, "per_star": 3, "wanted": 15, "counts": "triggers", "max_cones": 3000,
}


def trigger_objects(passages: DataFrame, config: BuildConfig = DEFAULT) -> DataFrame:
    """Objects of a night's prediction cone that fulfil the trigger rule.

    ``passages``: one row per (star, night, object) with the prediction at the
    middle exposure (``predicted_ra, predicted_dec, motion_ra, motion_dec,
    v_magnitude, position_error_arcsec``), the star position, ``min_maglimit``
    and ``offsets`` (array of minutes of the three exposures from the middle).
    Adds rate, positions, closest approach and whether it is a primary one.
    """
    rate, _ = predicted_motion("motion_ra", "motion_dec")
    ra, dec = extrapolate("predicted_ra", "predicted_dec", "motion_ra", "motion_dec", "m")
    near = separation("p.ra", "p.dec", "star_ra", "star_dec")
    rows = passages.where(
        f"v_magnitude <= min_maglimit + {MARGINAL_MARGIN!r}D"
        f" AND position_error_arcsec <= {MAX_POSITION_ERROR!r}D"
        f" AND {rate} <= {config.max_rate_arcsec_per_min!r}D"
    ).selectExpr(
        "*", f"{rate} AS rate",
        f"transform(offsets, m -> named_struct('ra', {ra}, 'dec', {dec})) AS positions",
    )
    eligible = baseline_eligible("positions", config.stationary_tolerance_arcsec)
    return rows.where(eligible).selectExpr(
        "*",
        f"array_min(transform(positions, p -> {near})) AS closest_approach",
        f"v_magnitude <= min_maglimit - {PRIMARY_MARGIN!r}D AS is_primary",
    ).where(f"closest_approach < {TRIGGER_NEAR_ARCSEC!r}D")


def zone_triggers(triggers: DataFrame) -> DataFrame:
    """Primary passages inside the zone of the star's search class."""
    reach = ", ".join(f"{r!r}D" for r in TRIGGER_REACH_ARCSEC)
    return triggers.where(f"is_primary AND closest_approach < array({reach})[search_class]")


def select_nights(candidates: DataFrame, budget: dict) -> DataFrame:
    """Nights chosen star by star in hash order under a budget per class.

    ``candidates``: one row per star and examined night: ``search_class,
    star_id, star_no`` (1.. in hash order within the class), ``night_index``,
    ``night_key, triggers``. Classes alternate star by star. A star yields at
    most ``per_star`` triggering nights, earliest first; a night already taken
    by an earlier star is skipped; a class stops at its wanted number.

    Whether a night is taken depends on earlier stars only, so the choice is
    found by rounds: assume the current choice of earlier stars, recompute,
    and repeat until nothing changes. Every round settles at least the next
    undecided star, so the rounds end by themselves, mostly after a few.
    """
    wanted, per_star = budget["wanted"], budget["per_star"]
    rows = candidates.where(
        f"star_no <= {budget['max_stars']} AND night_index < {budget['max_nights']}"
    )
    if budget["max_cones"] is not None:
        # Lookups do not depend on the choice: stop at the first star that
        # begins with the budget spent.
        spent = rows.groupBy("search_class", "star_no").agg(F.count("*").alias("_cones"))
        run = running_totals(spent, ["search_class"], ["star_no"], {"_c": F.col("_cones")})
        allowed = run.where(f"_c_before < {budget['max_cones']}").select("search_class", "star_no")
        rows = rows.join(allowed, ["search_class", "star_no"], "left_semi")
    # A night listed twice for a star can only be taken the first time.
    distinct = first_per_group(
        rows.where("triggers > 0"),
        ["search_class", "star_id", "star_no", "night_key"],
        [F.col("night_index")],
    )
    open_rows = cut_lineage(distinct.withColumn("turn", F.struct("star_no", "search_class")))
    weight = F.count("*") if budget["counts"] == "nights" else F.sum("triggers")
    taken = open_rows.select("night_key", "turn", "star_id").limit(0)
    while True:
        first_user = taken.groupBy("night_key").agg(F.min("turn").alias("_by"))
        free = open_rows.join(first_user, "night_key", "left").where("_by IS NULL OR _by >= turn").drop("_by")
        # At most ``per_star`` nights of a star, earliest first.
        chosen = row_numbers(free, ["search_class", "star_id"], ["night_index"], "_n").where(
            F.col("_n") <= per_star
        ).drop("_n")
        # The class is done once earlier stars hold enough.
        per_turn = chosen.groupBy("search_class", "star_no").agg(weight.alias("_got"))
        running = running_totals(per_turn, ["search_class"], ["star_no"], {"_s": F.col("_got")})
        active = running.where(f"_s_before < {wanted}").select("search_class", "star_no")
        chosen = cut_lineage(chosen.join(active, ["search_class", "star_no"], "left_semi"))
        now = chosen.select("night_key", "turn", "star_id")
        changed = now.exceptAll(taken).unionByName(taken.exceptAll(now))
        if changed.isEmpty():
            return chosen.drop("turn")
        taken = now
