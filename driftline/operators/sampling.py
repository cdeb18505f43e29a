"""Deterministic hash-ordered sampling and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.sky import ecliptic_latitude
from driftline.operators.ordered import row_numbers, running_totals

# Selection limits and sample sizes.
SELECTION_MIN_DEC = -25.0
SELECTION_MAX_ECLIPTIC_LATITUDE = 10.0
MASKED_SAMPLE = 8
PARTIAL_SAMPLE = 2
UNMASKED_SAMPLE = 3


def hash_key(salt: str, *parts: str) -> str:
    """SHA-256 hex of ``salt:part[:part]`` (SQL)."""
    joined = ", ':', ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"sha2(concat('{salt}:', {joined}), 256)"


def eligible_stars(stars: DataFrame) -> DataFrame:
    """Stars inside the declination and ecliptic-latitude limits."""
    beta = ecliptic_latitude("star_ra", "star_dec")
    return stars.where(
        f"star_dec >= {SELECTION_MIN_DEC!r}D AND abs({beta}) <= {SELECTION_MAX_ECLIPTIC_LATITUDE!r}D"
    )


def hash_order(df: DataFrame, keys: list[str], salt: str, parts: list[str], name: str = "position") -> DataFrame:
    """1, 2, ... within each group in hash order."""
    keyed = df.withColumn("_hash", F.expr(hash_key(salt, *parts)))
    return row_numbers(keyed, keys, ["_hash"], name).drop("_hash")


def hash_sample(
    df: DataFrame, keys: list[str], salt: str, parts: list[str], quota
) -> DataFrame:
    """The first rows of each group in hash order; ``quota`` is a number or
    the name of a column that is constant per group."""
    limit = F.col(quota) if isinstance(quota, str) else F.lit(quota)
    return hash_order(df, keys, salt, parts, "_position").where(F.col("_position") <= limit).drop(
        "_position"
    )


def labelled_samples(
    df: DataFrame, rules: dict[str, tuple[str, int]], keys: list[str], salt: str, parts: list[str]
) -> DataFrame:
    """Several quota samples in one pass. A rule maps a label to (SQL
    condition, quota); a row may be picked under more than one label."""
    tags = ", ".join(f"if({cond}, '{label}', NULL)" for label, (cond, _) in rules.items())
    quota = "CASE label " + " ".join(f"WHEN '{n}' THEN {q}" for n, (_, q) in rules.items()) + " END"
    tagged = df.selectExpr("*", f"explode(array_compact(array({tags}))) AS label")
    tagged = tagged.selectExpr("*", f"{quota} AS _quota")
    return hash_sample(tagged, [*keys, "label"], salt, parts, "_quota").drop("_quota")


def allocate(sizes: DataFrame, keys: list[str], pattern: str, total: int) -> DataFrame:
    """Sample size per pattern: at least one each, the rest by largest
    remainder; with too few slots the most populated patterns win.

    ``sizes``: keys, pattern, ``size``. Adds ``quota``.
    """
    stats = sizes.groupBy(*keys).agg(
        F.count("*").alias("_patterns"), F.sum(F.col("size") - 1).alias("_spare")
    )
    rows = sizes.join(stats, keys).selectExpr(
        "*",
        f"if({total} > _patterns AND _spare > 0, ({total} - _patterns) * (size - 1) / _spare, 0D) AS _share",
    )
    by_size = row_numbers(rows, keys, [F.col("size").desc(), F.col(pattern)], "_by_size")
    order = [(F.col("_share") - F.floor("_share")).desc(), F.col(pattern)]
    ranked = running_totals(
        by_size, keys, order,
        {"_seen": F.lit(1).cast("long"), "_floor": F.floor("_share").cast("long")},
    )
    left = f"({total} - _patterns - _floor_total)"
    quota = (
        f"CASE WHEN {total} <= _patterns THEN CAST(_by_size <= {total} AS BIGINT)"
        " WHEN _spare <= 0 THEN least(1L, size)"
        f" ELSE least(size, 1 + CAST(floor(_share) AS BIGINT) + CAST(_seen_before < {left} AS BIGINT)) END"
    )
    return ranked.selectExpr(*keys, pattern, "size", f"CAST({quota} AS BIGINT) AS quota")


def stratified_sample(contexts: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """All known, masked by pattern, a few partial and unmasked, hash order.

    ``contexts``: keys, ``tracklet_id, stratum, mask_pattern``.
    """
    parts = [*keys, "tracklet_id"]
    known = contexts.where("stratum = 'known'")
    masked = contexts.where("stratum = 'masked_unknown'")
    sizes = masked.groupBy(*keys, "mask_pattern").agg(F.count("*").alias("size"))
    quotas = allocate(sizes, keys, "mask_pattern", MASKED_SAMPLE).drop("size")
    by_pattern = hash_sample(
        masked.join(quotas, [*keys, "mask_pattern"]), [*keys, "mask_pattern"], salt, parts, "quota"
    ).drop("quota")
    rest = labelled_samples(
        contexts,
        {
            "partial": ("stratum = 'partially_masked_unknown'", PARTIAL_SAMPLE),
            "unmasked": ("stratum = 'unmasked_unknown'", UNMASKED_SAMPLE),
        },
        keys, salt, parts,
    ).drop("label")
    columns = contexts.columns
    return known.unionByName(by_pattern.select(columns)).unionByName(rest.select(columns))


def first_usable(candidates: DataFrame, keys: list[str], order: list, wanted: int, tried: int) -> DataFrame:
    """Walk candidates in order until enough are usable (or tried); every row
    up to the stop with ``selected_no`` for the usable ones.

    ``candidates`` has a boolean ``usable``.
    """
    walked = running_totals(
        candidates, keys, order,
        {"_seen": F.lit(1).cast("long"), "_hits": F.col("usable").cast("long")},
    )
    reached = walked.where(f"_hits_before < {wanted} AND _seen_before < {tried}")
    return reached.withColumn(
        "selected_no", F.when(F.col("usable"), F.col("_hits_before") + 1)
    ).drop("_seen_before", "_seen_total", "_hits_before", "_hits_total")


def in_view(points: DataFrame) -> DataFrame:
    """Tracklets whose detections all lie inside a frame's view, built ones
    first, then by the distance of the mean point from the sequence centre.

    ``points``: ``build_id, tracklet_no, status, px, py`` (null = not visible)
    and the frame's ``width, height, center_x, center_y``.
    """
    inside = (
        "coalesce(px >= -0.5D AND py >= -0.5D AND px <= width - 0.5D AND py <= height - 0.5D, false)"
    )
    rows = points.groupBy("build_id", "tracklet_no", "status").agg(
        F.expr(f"bool_and({inside})").alias("visible"),
        F.expr("hypot(avg(px) - first(center_x), avg(py) - first(center_y))").alias("center_distance"),
    ).where("visible")
    return row_numbers(
        rows.drop("visible"), ["build_id"],
        [F.expr("status <> 'built'"), F.col("center_distance"), F.col("tracklet_no")],
        "view_order",
    )
