"""Lookups and classifications as Spark SQL expressions."""

from __future__ import annotations

import math

# Class edges, distance annuli and bins, zone reach.
MAG_EDGES = (-math.inf, 4.0, 6.0, 8.0, 10.0, 11.0)
ANNULUS_EDGES = (0.0, 15.0, 30.0, 60.0, 120.0, 240.0, 480.0, 900.0)
RADIAL_EDGES = (0.0, 120.0, 240.0, 360.0, 480.0, 600.0, 900.0, math.inf)
DISTANCE_EDGES = (0.0, 30.0, 60.0, 120.0, 240.0)
SEARCH_CLASSES = ((-math.inf, 6.0), (6.0, 8.0))
ZONE_REACH = (120.0, 60.0, 30.0)  # V < 6, 6-8, 8-10
OUTER_ARCSEC = 240.0
CONTROL_V10_ARCSEC = 480.0
CONTROL_V11_ARCSEC = 60.0
DEPTH_BINS = ((-math.inf, 0.5, "<0.5"), (0.5, 1.5, "0.5-1.5"), (1.5, math.inf, ">=1.5"))
CROWDING_BINS = ((0.0, 2e4, "<20k"), (2e4, 8e4, "20-80k"), (8e4, math.inf, ">=80k"))
SPEED_BINS = ((0.0, 0.25, "<0.25"), (0.25, 0.5, "0.25-0.5"), (0.5, math.inf, "0.5-1.0"))
BAND_OFFSET = {"zg": 0.33, "zr": -0.22, "zi": -0.37}


def _between(value: str, low: float, high: float) -> str:
    terms = []
    if math.isfinite(low):
        terms.append(f"{value} >= {low!r}D")
    if math.isfinite(high):
        terms.append(f"{value} < {high!r}D")
    return " AND ".join(terms) or f"{value} IS NOT NULL"


def bin_index(value: str, edges) -> str:
    """Index of the half-open bin [edge, next edge); null outside."""
    cases = " ".join(
        f"WHEN {_between(value, lo, hi)} THEN {i}" for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    )
    return f"(CASE WHEN {value} IS NULL THEN NULL {cases} END)"


def named_bin(value: str, bins) -> str:
    """Name of the bin, ``n/a`` when missing or outside."""
    cases = " ".join(f"WHEN {_between(value, lo, hi)} THEN '{name}'" for lo, hi, name in bins)
    return f"(CASE WHEN {value} IS NULL THEN 'n/a' {cases} ELSE 'n/a' END)"


def lookup(index: str, labels) -> str:
    """Label of an index."""
    items = ", ".join("'" + str(x).replace("'", "\\'") + "'" for x in labels)
    return f"(CASE WHEN {index} IS NOT NULL THEN array({items})[{index}] END)"


def magnitude_class(v: str) -> str:
    """Star class; the faintest one includes its upper edge."""
    inner = " ".join(f"WHEN {v} < {e!r}D THEN {i}" for i, e in enumerate(MAG_EDGES[1:-1]))
    last = len(MAG_EDGES) - 2
    return f"(CASE WHEN {v} IS NULL OR {v} > {MAG_EDGES[-1]!r}D THEN NULL {inner} ELSE {last} END)"


def class_labels() -> list[str]:
    out = []
    for i, (low, high) in enumerate(zip(MAG_EDGES, MAG_EDGES[1:])):
        upper = "<=" if i == len(MAG_EDGES) - 2 else "<"
        out.append(f"V<{high:g}" if math.isinf(low) else f"{low:g}<=V{upper}{high:g}")
    return out


def annulus_labels() -> list[str]:
    return [f'{a:g}-{b:g}"' for a, b in zip(ANNULUS_EDGES, ANNULUS_EDGES[1:])]


def radial_labels() -> list[str]:
    return [
        f"{a / 60:.0f}'-{b / 60:.0f}'" if math.isfinite(b) else f">={a / 60:.0f}'"
        for a, b in zip(RADIAL_EDGES, RADIAL_EDGES[1:])
    ]


def search_class(v: str) -> str:
    cases = " ".join(
        f"WHEN {_between(v, lo, hi)} THEN {i}" for i, (lo, hi) in enumerate(SEARCH_CLASSES)
    )
    return f"(CASE WHEN {v} IS NULL THEN NULL {cases} END)"


def johnson_v(vt: str, bt: str) -> str:
    """V from the two catalog bands; VT alone when BT is missing."""
    return f"(CASE WHEN {vt} IS NULL THEN NULL WHEN {bt} IS NULL THEN {vt} ELSE {vt} - 0.09D * ({bt} - {vt}) END)"


def class_separations(sep: list[str]) -> tuple[str, str, str, str]:
    """The five separations with the two brightest classes taken as one."""
    return f"least({sep[0]}, {sep[1]})", sep[2], sep[3], sep[4]


def proximity_group(sep: list[str]) -> str:
    """zone / outer / control / intermediate from five class separations."""
    v6, v8, v10, v11 = class_separations(sep)
    zone = " OR ".join(f"coalesce({s} < {r!r}D, false)" for s, r in zip((v6, v8, v10), ZONE_REACH))
    nearest = f"least({v6}, {v8}, {v10})"
    return (
        f"(CASE WHEN {zone} THEN 'zone' WHEN {nearest} < {OUTER_ARCSEC!r}D THEN 'outer'"
        f" WHEN coalesce({nearest} >= {CONTROL_V10_ARCSEC!r}D, true) AND"
        f" coalesce({v11} >= {CONTROL_V11_ARCSEC!r}D, true) THEN 'control' ELSE 'intermediate' END)"
    )


def zone_reason(sep: list[str]) -> str:
    """(class, separation) that puts a target into the zone, brightest first."""
    parts = class_separations(sep)[:3]
    cases = " ".join(
        f"WHEN {s} < {r!r}D THEN named_struct('class', {i}, 'separation', {s})"
        for i, (s, r) in enumerate(zip(parts, ZONE_REACH))
    )
    return f"(CASE {cases} END)"


def star_class(sep: list[str]) -> str:
    """Class name of the nearest star down to V < 10."""
    names = ("V<6", "V<6", "6-8", "8-10")
    items = ", ".join(
        f"if({s} IS NULL, NULL, named_struct('s', {s}, 'i', {i}, 'n', '{n}'))"
        for i, (s, n) in enumerate(zip(sep[:4], names))
    )
    return f"coalesce(array_min(array_compact(array({items}))).n, 'none')"


def sample_stratum(status: str, identification: str, masked: str, count: str) -> str:
    return (
        f"(CASE WHEN {status} <> 'built' THEN 'rejected' WHEN {identification} = 'known' THEN 'known'"
        f" WHEN {identification} = 'ambiguous' THEN 'ambiguous' WHEN {masked} = {count} THEN 'masked_unknown'"
        f" WHEN {masked} > 0 THEN 'partially_masked_unknown' ELSE 'unmasked_unknown' END)"
    )


def population(identification: str, role: str) -> str:
    """Population of an identified tracklet, from its identification only."""
    return (
        f"(CASE WHEN {identification} IN ('unknown', 'ambiguous') THEN {identification}"
        f" WHEN {role} = 'primary' THEN 'validation_target' WHEN {role} = 'control' THEN 'control'"
        " ELSE 'other_known' END)"
    )


def loss_stage(recovered: str, detected: str, candidates: str, tracklet: str) -> str:
    """First reason why a target was not recovered (three frames)."""
    return (
        f"(CASE WHEN {recovered} THEN 'recovered' WHEN {detected} < 3 THEN 'not_detected'"
        f" WHEN {candidates} < 3 THEN 'not_candidate' WHEN {tracklet} IS NULL THEN 'not_linked'"
        " ELSE 'not_identified' END)"
    )


def first_failure(detected: str, candidates: str, frames: str, full: str, built: str, identified: str) -> str:
    """First failing stage of a trace; null when recovered."""
    return (
        f"(CASE WHEN {detected} < {frames} THEN 'detection' WHEN {candidates} < {frames} THEN 'stationary'"
        f" WHEN NOT {full} THEN 'association' WHEN NOT {built} THEN 'fit'"
        f" WHEN NOT {identified} THEN 'identification' END)"
    )
