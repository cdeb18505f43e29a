"""Angular radius join.

Both sides get a declination zone and a right-ascension cell. One side keeps
its single cell; the other is copied to every cell its search circle touches.
The equi-join on the cells is followed by the exact great-circle test, so the
result has each pair within the radius exactly once, across RA 0/360 and at
the poles.

Cells are wider than the radius by ``cell_factor``: most circles then touch
one or two cells, which keeps the copied side small in the shuffle. Skewed
cells are left to the adaptive skew join, which splits them by map output.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.sky import separation

# Guards the cell arithmetic against rounding at cell borders.
_PAD = "1.000000001D"
# Fixed value: pairs of a cell that are judged at once.
CELL_PAIRS = 2_000_000


def _radius(radius) -> str:
    """The radius as SQL, at least one arcsecond (cells never vanish)."""
    return f"greatest({radius}, 1D)" if isinstance(radius, str) else f"{max(float(radius), 1.0)!r}D"


def _grid(radius, factor: float) -> list[str]:
    """The zone's reach in RA, cell count and cell width. Each is a column of
    its own that the next one refers to, so that expressions do not nest.

    The reach is null where no finite width works (near a pole): one cell.
    """
    r = _radius(radius)
    h = f"({r} * {factor / 3600.0!r}D)"
    limit = f"(greatest(abs(_zone * {h} - 90D), abs((_zone + 1) * {h} - 90D)) + {r} / 3600D)"
    x = f"(sin(radians({r} / 3600D) / 2D) / cos(radians({limit})))"
    cells = f"floor(360D / (_reach * {float(factor)!r}D))"
    return [
        f"CASE WHEN {limit} < 90D AND {x} < 0.5D THEN degrees(2D * asin({x})) * {_PAD} END AS _reach",
        f"CASE WHEN _reach IS NULL OR {cells} < 3 THEN 1L ELSE {cells} END AS _n",
        "360D / _n AS _width",
    ]


# The keys are never null, so that no null check is pushed down through (and
# thereby repeats) the expressions they are made of.


def with_cell(df: DataFrame, ra: str, dec: str, radius, factor: float) -> DataFrame:
    """One zone and cell per row."""
    columns = df.columns
    h = f"({_radius(radius)} * {factor / 3600.0!r}D)"
    return df.selectExpr(
        "*",
        f"coalesce(floor(({dec} + 90D) / {h}), -1L) AS _zone",
        *_grid(radius, factor),
        f"coalesce(least(floor({ra} / _width), _n - 1L), -1L) AS _cell",
    ).select(*columns, "_zone", "_cell")


def with_touched_cells(df: DataFrame, ra: str, dec: str, radius, factor: float) -> DataFrame:
    """One row per zone and cell the circle around the row touches."""
    columns = df.columns
    r = _radius(radius)
    h = f"({r} * {factor / 3600.0!r}D)"
    low = f"floor(({dec} - {r} * {_PAD} / 3600D + 90D) / {h})"
    high = f"floor(({dec} + {r} * {_PAD} / 3600D + 90D) / {h})"
    out = df.selectExpr("*", f"explode(sequence({low}, {high})) AS _zone")
    out = out.selectExpr(
        "*",
        *_grid(radius, factor),
        f"if(_n <= 1, 0L, floor(({ra} - _reach) / _width)) AS _first",
        f"if(_n <= 1, 0L, floor(({ra} + _reach) / _width)) AS _last",
    )
    out = out.selectExpr(*columns, "_zone", "_n", "explode(sequence(_first, _last)) AS _cell")
    return out.selectExpr(
        *columns, "coalesce(_zone, -1L) AS _zone", "coalesce(pmod(_cell, _n), -1L) AS _cell"
    )


def cell_join(
    left: DataFrame,
    right: DataFrame,
    radius,
    on: list[str],
    left_pos: tuple[str, str] = ("ra", "dec"),
    right_pos: tuple[str, str] = ("ra2", "dec2"),
    how: str = "inner",
    extra: str | None = None,
    cell_factor: float = 4.0,
    name: str = "separation",
) -> DataFrame:
    """Pairs within ``radius`` arcsec (inclusive) that agree on ``on``.

    Apart from ``on``, the two sides must not share column names. ``radius``
    is a number or the name of a column of both sides that is fixed by ``on``.
    The right side is copied to its touched cells: give the smaller side
    there. ``extra`` is a further SQL condition on the columns of both sides.
    ``how`` is ``inner``, ``left_semi`` or ``left_anti``.
    """
    lcol = with_cell(left, *left_pos, radius, cell_factor)
    rcol = with_touched_cells(right, *right_pos, radius, cell_factor)
    keys = [*on, "_zone", "_cell"]
    renamed = {k: f"_r_{k}" for k in keys}
    if isinstance(radius, str):
        renamed[radius] = f"_r_{radius}"
    rcol = rcol.withColumnsRenamed(renamed)
    r = radius if isinstance(radius, str) else f"{float(radius)!r}D"
    exact = separation(*left_pos, *right_pos)
    # The declination test is cheap and removes most cell mates.
    terms = [f"{k} = _r_{k}" for k in keys]
    terms.append(f"abs({left_pos[1]} - {right_pos[1]}) * 3600D <= {r} * {_PAD}")
    if extra:
        terms.append(extra)
    terms.append(f"{exact} <= {r}")
    joined = lcol.join(rcol, F.expr(" AND ".join(terms)), how)
    if how != "inner":
        return joined.drop("_zone", "_cell")
    return joined.withColumn(name, F.expr(exact)).drop("_zone", "_cell", *renamed.values())


def cell_groups(
    left: DataFrame,
    right: DataFrame,
    radius,
    on: list[str],
    judge: Callable[[pa.Table, pa.Table], pa.Table],
    schema,
    left_pos: tuple[str, str] = ("ra", "dec"),
    right_pos: tuple[str, str] = ("ra2", "dec2"),
    cell_factor: float = 4.0,
    limits: tuple[int, int] | None = None,
) -> DataFrame:
    """What ``judge`` makes of the left rows of each cell and the right rows
    whose circles touch it, for results per left row that need many pairs: no
    pair becomes a row, so none is sorted or shuffled.

    Every left row is judged once, with all right rows within ``radius`` (and
    others near them). A task holds the rows of one cell, not their pairs.
    ``radius`` is a number or the name of a column of both sides that is in ``on``.

    With ``limits`` (left and right rows) a crowded cell is dealt to several groups,
    in each of which ``judge`` sees a share of the left and a share of the right rows.
    """
    keys = [*on, "_zone", "_cell"]
    # No pair has a null key.
    some = right.dropna(subset=on) if on else right
    lcol = with_cell(left, *left_pos, radius, cell_factor)
    rcol = with_touched_cells(some, *right_pos, radius, cell_factor)
    # Cells without a left row would be most of them where the left side is clustered.
    rcol = rcol.join(lcol.select(*keys).distinct(), keys, "left_semi")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return judge(a, b)

    if limits:
        lcol, rcol = _dealt(lcol, rcol, keys, limits)
        keys += ["_left_part", "_right_part"]
        # So many tasks whatever the bytes: the work grows with the pairs.
        n = int(lcol.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lcol, rcol = lcol.repartition(n, *keys), rcol.repartition(n, *keys)
    return lcol.groupBy(*keys).cogroup(rcol.groupBy(*keys)).applyInArrow(run, schema)


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], limits: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_left_part, _right_part``: each row in one part of its own
    side and, for each part of the other side in its cell, one copy."""
    parts = []
    for df, rows, name in ((left, limits[0], "_left_parts"), (right, limits[1], "_right_parts")):
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
        # Few by definition: each has more than ``rows`` rows.
        parts.append(F.broadcast(sizes.selectExpr(*keys, f"ceil(_n / {rows}) AS {name}")))

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        numbered = df.withColumn("_row", F.xxhash64(*df.columns))
        for p in parts:
            numbered = numbered.join(p, keys, "left")
        return numbered.selectExpr(
            *df.columns,
            f"pmod(_row, coalesce(_{own}_parts, 1L)) AS _{own}_part",
            f"explode(sequence(0L, coalesce(_{other}_parts, 1L) - 1L)) AS _{other}_part",
        )

    return deal(left, "left", "right"), deal(right, "right", "left")


def _angles(table: pa.Table, pos: tuple[str, str]) -> list[np.ndarray]:
    return [np.radians(table[name].to_numpy().astype(float)) for name in pos]


def chords(
    table: pa.Table, others: pa.Table, pos: tuple[str, str], other_pos: tuple[str, str]
) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared chords on the unit sphere between all rows of two tables, in
    blocks of rows of the first one; NaN without a position. They grow with the
    separation and are as exact as it is, also where it is small."""

    def vectors(rows, names):
        ra, dec = _angles(rows, names)
        return np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)

    here, there = vectors(table, pos), vectors(others, other_pos)
    step = max(1, CELL_PAIRS // max(1, others.num_rows))
    for at in range(0, table.num_rows, step):
        rows = slice(at, at + step)
        yield rows, sum(np.square(a[rows, None] - b) for a, b in zip(here, there, strict=True))


def separations(table: pa.Table, others: pa.Table, pos: tuple[str, str], other_pos: tuple[str, str]) -> np.ndarray:
    """Separation (arcsec) of each row of a table from that of another one, as
    ``functions.sky.separation``."""
    (ra1, d1), (ra2, d2) = _angles(table, pos), _angles(others, other_pos)
    along = np.cos(d2) * np.cos(ra2 - ra1)
    across = np.hypot(np.cos(d2) * np.sin(ra2 - ra1), np.cos(d1) * np.sin(d2) - np.sin(d1) * along)
    return np.degrees(np.arctan2(across, np.sin(d1) * np.sin(d2) + np.cos(d1) * along)) * 3600.0


def within(
    radius: float, table: pa.Table, others: pa.Table, pos: tuple[str, str], other_pos: tuple[str, str]
) -> Iterator[tuple[slice, np.ndarray]]:
    """Whether rows of two tables are within ``radius`` arcsec (inclusive), in
    blocks of rows of the first one. Pairs at the border are judged by their
    separation, as a join does."""
    limit = 4.0 * math.sin(math.radians(min(radius / 3600.0, 180.0)) / 2.0) ** 2
    for rows, apart in chords(table, others, pos, other_pos):
        close = apart <= limit * (1.0 + 1e-9)
        i, j = np.nonzero(close & (apart >= limit * (1.0 - 1e-9)))
        if len(i):
            pair = table.take(pa.array(i + rows.start)), others.take(pa.array(j))
            close[i, j] = separations(*pair, pos, other_pos) <= radius
        yield rows, close
