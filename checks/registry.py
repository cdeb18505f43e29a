"""Registry of checked queries and the SQL building blocks of their oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Name a common table expression that oracles and other ones may use."""
    CTES[name] = sql.strip()


def with_ctes(final: str) -> str:
    """Put every table expression that ``final`` needs in front of it."""
    names = list(CTES)
    needed: set[str] = set()
    text = final
    # An expression only uses ones named before it.
    for name in reversed(names):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += CTES[name]
    if not needed:
        return final.strip()
    ordered = [f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in names if n in needed]
    return "WITH " + ",\n".join(ordered) + "\n" + final.strip()


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle (None: not practical in SQL)."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL text for the geometry ---------------------------------------------


def sep(ra1, dec1, ra2, dec2) -> str:
    """Great-circle distance in arcsec."""
    d1, d2, dr = f"radians({dec1})", f"radians({dec2})", f"radians(({ra2})-({ra1}))"
    a = f"(cos({d2})*sin({dr}))"
    b = f"(cos({d1})*sin({d2})-sin({d1})*cos({d2})*cos({dr}))"
    c = f"(sin({d1})*sin({d2})+cos({d1})*cos({d2})*cos({dr}))"
    return f"(degrees(atan2(sqrt({a}*{a}+{b}*{b}),{c}))*3.6e3)"


def bearing(ra1, dec1, ra2, dec2) -> str:
    """Bearing from 1 to 2 in radians."""
    d1, d2, dr = f"radians({dec1})", f"radians({dec2})", f"radians(({ra2})-({ra1}))"
    return (
        f"atan2(sin({dr})*cos({d2}), cos({d1})*sin({d2})-sin({d1})*cos({d2})*cos({dr}))"
    )


def pmod(a, b) -> str:
    return f"((({a}) % ({b})) + ({b})) % ({b})"
