"""Interval and test statistics as Spark SQL expressions."""

from __future__ import annotations

# Fixed value: the normal quantile of the 95 % intervals.
Z95 = 1.959964


def _wilson_parts(k: str, n: str, z: float) -> tuple[str, str]:
    n = f"nullif(CAST({n} AS DOUBLE), 0D)"
    p, zz = f"({k} / {n})", f"{z * z!r}D"
    denominator = f"(1D + {zz} / {n})"
    centre = f"(({p} + {zz} / (2D * {n})) / {denominator})"
    half = f"({z!r}D * sqrt({p} * (1D - {p}) / {n} + {zz} / (4D * {n} * {n})) / {denominator})"
    return centre, half


def wilson(k: str, n: str, z: float = Z95) -> tuple[str, str]:
    """Score interval of k out of n; null without trials."""
    centre, half = _wilson_parts(k, n, z)
    return (
        f"(CASE WHEN {n} > 0 THEN greatest(0D, {centre} - {half}) END)",
        f"(CASE WHEN {n} > 0 THEN least(1D, {centre} + {half}) END)",
    )


def newcombe(k1: str, n1: str, k2: str, n2: str) -> tuple[str, str]:
    """Hybrid score interval of k1/n1 - k2/n2; null without trials."""
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = f"({k1} / nullif({n1}, 0))", f"({k2} / nullif({n2}, 0))"
    ok = f"{n1} > 0 AND {n2} > 0"
    low = f"{p1} - {p2} - sqrt(pow({p1} - {l1}, 2) + pow({u2} - {p2}, 2))"
    high = f"{p1} - {p2} + sqrt(pow({u1} - {p1}, 2) + pow({p2} - {l2}, 2))"
    return f"(CASE WHEN {ok} THEN {low} END)", f"(CASE WHEN {ok} THEN {high} END)"


def fisher_columns(a: str, b: str, c: str, d: str) -> list[str]:
    """``selectExpr`` columns ending in ``fisher_p``: exact two-sided p of
    [[a, b], [c, d]], the sum over tables no likelier than the observed one.

    Each likelihood follows from its neighbour by a ratio, so a pass over the
    possible tables finds the observed and the largest one, and a second one
    adds them up. Both keep three numbers, whatever the counts; working in
    logarithms keeps large counts.
    """
    row1, row2, col1 = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    low, high = f"greatest(0, {col1} - {row2})", f"least({row1}, {col1})"
    step = (
        f"ln(({row1} - x + 1D) * ({col1} - x + 1D)) - ln(x * ({row2} - {col1} + x))"
    )
    tables = f"if({low} < {high}, sequence({low} + 1, {high}), CAST(array() AS array<bigint>))"
    now = f"(s.l + {step})"
    return [
        f"aggregate({tables}, named_struct('l', 0D, 'top', 0D, 'seen', 0D), (s, x) -> named_struct("
        f"'l', {now}, 'top', greatest(s.top, {now}), 'seen', if(x = {a}, {now}, s.seen))) AS fisher_scan",
        f"CASE WHEN {row1} > 0 AND {row2} > 0 THEN least(1D, aggregate({tables},"
        " named_struct('l', 0D, 'part', if(exp(0D - fisher_scan.seen) <= 1D + 1e-9D, exp(0D - fisher_scan.top), 0D),"
        " 'all', exp(0D - fisher_scan.top)),"
        f" (s, x) -> named_struct('l', {now}, 'part', s.part + if(exp({now} - fisher_scan.seen) <= 1D + 1e-9D,"
        f" exp({now} - fisher_scan.top), 0D), 'all', s.all + exp({now} - fisher_scan.top)),"
        " s -> s.part / s.all)) END AS fisher_p",
    ]


def mantel_haenszel(numerator: str, denominator: str) -> str:
    """Common odds ratio of summed a*d/n and b*c/n; null when undefined."""
    return (
        f"(CASE WHEN {denominator} > 0 THEN {numerator} / {denominator}"
        f" WHEN {numerator} > 0 THEN CAST('Infinity' AS DOUBLE) END)"
    )
