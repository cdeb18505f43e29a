"""Tables derived from the given ones by arithmetic, in Spark and in SQL.

``events`` becomes detections: three consecutive events are one series seen in
three exposures, 400 series are one build. A series is a mover, noise or a
star, so builds keep their density however large ``events`` is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import cte

SERIES_PER_BUILD = 400


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Expressions valid in both engines; DIV and MOD are spelled per engine.
_DX = "(mod({s10},5)-2)*8/3.6e3"
_DY = "(mod({s10},3)+1)*6/3.6e3"


def _detection_exprs(div, frames: int, step: str) -> dict[str, str]:
    s = div("event_id", frames)
    frame = f"mod(event_id,{frames})"
    s10 = div(s, 10)
    dx, dy = _DX.format(s10=s10), _DY.format(s10=s10)
    kind = f"mod({s},10)"
    ra_off = (
        f"CASE WHEN {kind}=0 THEN {frame}*{dx} WHEN {kind}=1 THEN mod(event_id*31,97)*2/3.6e3 "
        f"ELSE {frame}*1e-1/3.6e3 END"
    )
    dec_off = (
        f"CASE WHEN {kind}=0 THEN {frame}*{dy} WHEN {kind}=1 THEN mod(event_id*17,89)*2/3.6e3 "
        "ELSE 0e0 END"
    )
    build = div(s, SERIES_PER_BUILD)
    return {
        "build_id": build,
        "frame_no": f"CAST({frame} AS INT)",
        "det_no": "event_id",
        "series": s,
        "product_id": f"{build}*10+{frame}",
        "source_id": f"concat(CAST({build}*10+{frame} AS STRING),'-',CAST({s} AS STRING))",
        "minutes": f"{frame}*{step}",
        "ra": f"1.2e2+mod({s}*7919,3600)/7.2e4+({ra_off})",
        "dec": f"1e1+mod({s}*104729,3600)/7.2e4+({dec_off})",
        "x": "CAST(mod(event_id*13,3072) AS DOUBLE)",
        "y": "CAST(mod(event_id*29,3080) AS DOUBLE)",
        "magnitude": "2.1e1-value/2e2",
        "magnitude_error": "1e-2+mod(event_id,7)/1e2",
        "snr": "3e0+value/1e1",
        "on_image_edge": "mod(user_id,11)=0",
        "mask_bits": "CASE WHEN mod(user_id,5)=0 THEN 256 WHEN mod(user_id,7)=0 THEN 4097 ELSE 0 END",
        "sharp": "CASE WHEN mod(event_id,50)=7 THEN NULL ELSE (mod(event_id,41)-20)/1e2 END",
    }


def _spark_div(a, b):
    return f"(({a}) div {b})"


def _duck_div(a, b):
    return f"(({a}) // {b})"


def detections(spark: SparkSession, sf: str, frames: int = 3, step: str = "3e1") -> DataFrame:
    exprs = _detection_exprs(_spark_div, frames, step)
    return read(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def _detections_sql(frames: int = 3, step: str = "3e1") -> str:
    exprs = _detection_exprs(_duck_div, frames, step)
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + " FROM events"


def frames_of(dets: DataFrame) -> DataFrame:
    """One row per exposure of the derived builds."""
    return (
        dets.groupBy("build_id", "frame_no")
        .agg(F.min("product_id").alias("product_id"), F.min("minutes").alias("minutes"))
        .withColumns(
            {
                "field": F.expr("CAST(500+mod(build_id,7) AS INT)"),
                "ccd_id": F.expr("CAST(1+mod(build_id,16) AS INT)"),
                "quadrant_id": F.expr("CAST(1+mod(build_id,4) AS INT)"),
                "filter_code": F.expr("CASE frame_no WHEN 0 THEN 'zg' WHEN 1 THEN 'zr' ELSE 'zi' END"),
                "exposure_seconds": F.lit(30.0),
                "observed_at": F.expr(
                    "timestamp_seconds(1704067200 + build_id*86400 + CAST(minutes*60 AS BIGINT))"
                ),
                "maglimit": F.expr("2.05e1 + mod(build_id,3)/1e1 - frame_no/1e1"),
            }
        )
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames_of(detections(spark, sf))


cte("det", _detections_sql())
cte("det5", _detections_sql(5, "2e1"))
cte(
    "frm",
    """
SELECT build_id, frame_no, min(product_id) AS product_id, min(minutes) AS minutes,
  CAST(500+mod(build_id,7) AS INT) AS field, CAST(1+mod(build_id,16) AS INT) AS ccd_id,
  CAST(1+mod(build_id,4) AS INT) AS quadrant_id,
  CASE frame_no WHEN 0 THEN 'zg' WHEN 1 THEN 'zr' ELSE 'zi' END AS filter_code,
  3e1 AS exposure_seconds,
  2.05e1 + mod(build_id,3)/1e1 - frame_no/1e1 AS maglimit
FROM det GROUP BY build_id, frame_no
""",
)


# Footprint of a frame: a tilted quadrilateral that cuts some positions off.
# The corners are listed crosswise, as archives do.
CORNERS = ((120.003, 10.001), (120.058, 10.056), (120.001, 10.058), (120.06, 10.003))


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    points = ", ".join(f"named_struct('ra', {a!r}D, 'dec', {b!r}D)" for a, b in CORNERS)
    ring = [CORNERS[i] for i in (0, 3, 1, 2)]
    ordered = ", ".join(f"named_struct('ra', {a!r}D, 'dec', {b!r}D)" for a, b in ring)
    return frames(spark, sf).selectExpr(
        "*", "120.03D AS center_ra", "10.03D AS center_dec",
        f"array({ordered}) AS corners", f"array({points}) AS crossed_corners",
    )


def inside_sql(ra: str, dec: str) -> str:
    """Even-odd test in the offsets about the frame centre, as SQL text."""

    def offsets(a, d):
        along = (
            f"(cos(radians({d}))*cos(radians({a}-120.03e0))*cos(radians(10.03e0))+sin(radians({d}))*sin(radians(10.03e0)))"
        )
        up = (
            f"(sin(radians({d}))*cos(radians(10.03e0))-cos(radians({d}))*cos(radians({a}-120.03e0))*sin(radians(10.03e0)))"
        )
        return f"atan2(cos(radians({d}))*sin(radians({a}-120.03e0)),{along})", f"asin({up})"

    x, y = offsets(ra, dec)
    ring = [offsets(f"{CORNERS[i][0]!r}e0", f"{CORNERS[i][1]!r}e0") for i in (0, 3, 1, 2)]
    terms = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        terms.append(
            f"CASE WHEN (({y1} > {y}) <> ({y2} > {y})) AND {x} < {x1}+({y}-{y1})*({x2}-{x1})/({y2}-{y1}) THEN 1 ELSE 0 END"
        )
    return f"(({'+'.join(terms)}) % 2 = 1)"


# --- predicted known objects -------------------------------------------------
# Two predicted objects per series and frame: K follows the mover track with
# an offset of 0 to 2.1 arcsec, L with 0 to 4.4 arcsec. Position errors above
# the match radius occur. Every row of events is used.


def _ephemeris_exprs(div, letter: str) -> dict[str, str]:
    s = div("event_id", 3)
    s10 = div(s, 10)
    frame = "mod(event_id,3)"
    dx, dy = _DX.format(s10=s10), _DY.format(s10=s10)
    off = f"mod({s10},4)*7e-1" if letter == "K" else f"mod({div(s, 40)},5)*1.1e0"
    build = div(s, SERIES_PER_BUILD)
    return {
        "build_id": build,
        "frame_no": f"CAST({frame} AS INT)",
        "product_id": f"{build}*10+{frame}",
        "designation": f"concat('{letter}',CAST({s} AS STRING))",
        "object_class": f"CASE WHEN mod({s},3)=0 THEN 'MB>Inner' ELSE 'MB>Outer' END",
        "predicted_ra": f"1.2e2+mod({s}*7919,3600)/7.2e4+{frame}*{dx}",
        "predicted_dec": f"1e1+mod({s}*104729,3600)/7.2e4+{frame}*{dy}+({off}+2e-1*{frame})/3.6e3",
        "v_magnitude": f"CASE WHEN mod({s},17)=3 THEN NULL ELSE 1.6e1+mod({s},60)/1e1 END",
        "position_error_arcsec": f"1e-1+mod({s10},13)*2e-1",
        "motion_ra": f"(mod({s10},5)-2)*16*9.8e-1",
        "motion_dec": f"(mod({s10},3)+1)*12*1e0",
    }


def ephemerides(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select("event_id")
    parts = [
        events.selectExpr(*[f"{e} AS {n}" for n, e in _ephemeris_exprs(_spark_div, k).items()])
        for k in "KL"
    ]
    return parts[0].unionByName(parts[1])


cte(
    "eph",
    " UNION ALL ".join(
        "SELECT "
        + ", ".join(f"{e} AS {n}" for n, e in _ephemeris_exprs(_duck_div, k).items())
        + " FROM events"
        for k in "KL"
    ),
)


# --- listings -----------------------------------------------------------------
# What a prediction service lists: the predictions above, some objects listed
# twice for a frame (the last row counts), objects that miss a frame but are
# listed twice in another, and frames whose field holds no object.


def _listing_parts(div, source: str) -> list[str]:
    s, s10 = div("event_id", 3), div(div("event_id", 3), 10)
    out = []
    for letter in "KL":
        e = _ephemeris_exprs(div, letter)
        columns = ", ".join(f"{x} AS {n}" for n, x in e.items())
        out.append(f"SELECT {columns}, 2 AS listing_no FROM {source}")
        moved = e | {"predicted_dec": f"({e['predicted_dec']})+5e0/3.6e3"}
        columns = ", ".join(f"{x} AS {n}" for n, x in moved.items())
        out.append(f"SELECT {columns}, 1 AS listing_no FROM {source} WHERE mod(event_id,3)=1 AND mod({s},2)=0")
    short = _ephemeris_exprs(div, "K") | {"designation": f"concat('M',CAST({s} AS STRING))"}
    columns = ", ".join(f"{x} AS {n}" for n, x in short.items())
    for listing in (0, 1):
        where = f"mod({s10},4)=1 AND mod(event_id,3) IN ({'0,1' if listing == 0 else '1'})"
        out.append(f"SELECT {columns}, {listing} AS listing_no FROM {source} WHERE {where}")
    return out


_EMPTY_FIELD = "mod(build_id,5)=3 AND frame_no=2"


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with ``listing_no`` and repeated rows."""
    events = read(spark, sf, "events").select("event_id")
    rows = [spark.sql(q, events=events) for q in _listing_parts(_spark_div, "{events}")]
    return reduce(lambda x, y: x.unionByName(y), rows).where(f"NOT ({_EMPTY_FIELD})")


cte(
    "ephl",
    "SELECT * FROM (" + " UNION ALL ".join(_listing_parts(_duck_div, "events")) + f") WHERE NOT ({_EMPTY_FIELD})",
)
cte(
    "ephlast",
    "SELECT * FROM ephl QUALIFY row_number() OVER (PARTITION BY build_id, frame_no, designation ORDER BY listing_no DESC)=1",
)


# --- stars -------------------------------------------------------------------
# Customers become stars around the builds' sky, 180 per field.

_STAR = {
    "field_id": "CAST(c_custkey {div} 180 AS BIGINT)",
    "star_id": "concat('TYC ',CAST(c_custkey AS STRING),'-',CAST(mod(c_custkey,97) AS STRING),'-1')",
    "star_ra": "1.195e2+mod(c_custkey*6007,3600)/3.6e3",
    "star_dec": "9.5e0+mod(c_custkey*7013,3600)/3.6e3",
    "v_mag": "CASE WHEN mod(c_custkey,31)=5 THEN NULL ELSE 3e0+mod(c_custkey*13,90)/1e1 END",
}


def stars(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").selectExpr(
        *[f"{e.format(div='div')} AS {n}" for n, e in _STAR.items()]
    )


cte(
    "star",
    "SELECT " + ", ".join(f"{e.format(div='//')} AS {n}" for n, e in _STAR.items()) + " FROM customer",
)


# --- scored tracklets ---------------------------------------------------------
# Order lines become scored, labelled tracklets: suppliers are fields, nations
# (through the supplier) are independence groups.

_SCORED = {
    "field_id": "concat('F',CAST(l_suppkey AS STRING))",
    "grp": "concat('G-',CAST(mod(l_suppkey,25) AS STRING))",
    "tracklet_no": "(l_orderkey*10+l_linenumber)*100000000+l_partkey",
    "tracklet_id": "concat('trk-',CAST((l_orderkey*10+l_linenumber)*100000000+l_partkey AS STRING))",
    "night": "concat('N',CAST(mod(l_suppkey,40) AS STRING))",
    "designation": "concat('D',CAST(mod(l_partkey,50) AS STRING))",
    "label": "CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'A' THEN 'auxiliary' ELSE 'background' END",
    "score": "CAST(mod(l_orderkey*l_linenumber*31+l_partkey,1009) AS DOUBLE)/1009"
    " + CASE WHEN l_returnflag='R' THEN 2e-1 ELSE 0e0 END",
    "quantity": "l_quantity",
    "price": "CASE WHEN mod(l_partkey,23)=4 THEN NULL ELSE round(l_extendedprice,2) END",
    "discount": "l_discount",
    "tax": "l_tax",
    "role": "CASE WHEN mod(l_partkey,50)<30 THEN 'primary' ELSE 'marginal' END",
    "proximity_group": "CASE mod(l_partkey,50) WHEN 0 THEN 'zone' WHEN 1 THEN 'zone' WHEN 7 THEN 'zone'"
    " WHEN 2 THEN 'outer' WHEN 3 THEN 'intermediate' ELSE 'control' END",
}


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _SCORED.items()])


cte("scored", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SCORED.items()) + " FROM lineitem")


# The scored tracklets with twelve features, and what their strata need.
MORE_FEATURES = {
    "net": "l_extendedprice*(1e0-l_discount)",
    "unit": "CASE WHEN mod(l_partkey,29)=3 THEN NULL ELSE l_extendedprice/l_quantity END",
    "charge": "l_extendedprice*(1e0+l_tax)",
    "line": "CAST(l_linenumber AS DOUBLE)",
    "batch": "CAST(mod(l_orderkey,97) AS DOUBLE)",
    "part": "CAST(mod(l_partkey,89) AS DOUBLE)",
    "gap": "abs(l_discount-l_tax)",
    "blend": "CAST(mod(l_orderkey*7+l_partkey*3,1013) AS DOUBLE)",
}
_CONTEXT = {
    "masked_detection_count": "mod(l_linenumber+l_orderkey,4)",
    "shares_detection_with_positive": "l_returnflag='N' AND mod(l_orderkey,7)=2",
}


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    exprs = {**_SCORED, **MORE_FEATURES, **_CONTEXT}
    return read(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


cte(
    "labelled",
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in {**_SCORED, **MORE_FEATURES, **_CONTEXT}.items()) + " FROM lineitem",
)

# Field conditions from suppliers, targets from the labelled objects.
_FIELD = {
    "field_id": "concat('F',CAST(s_suppkey AS STRING))",
    "population": "CASE WHEN mod(s_suppkey,3)=0 THEN 'sparse' ELSE 'dense' END",
}


def field_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").selectExpr(
        *[f"{e} AS {n}" for n, e in _FIELD.items()],
        "array(1000*mod(s_suppkey,120), 1000*mod(s_suppkey,120)+3000) AS sources_per_frame",
        "if(mod(s_suppkey,4)=0, array('zr','zr'), array('zg','zr')) AS filters",
    )


cte(
    "fcond",
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FIELD.items())
    + ", (2000*mod(s_suppkey,120)+3000)/2e0 AS sources, CASE WHEN mod(s_suppkey,4)=0 THEN 'single' ELSE 'mixed' END AS filters FROM supplier",
)
_TARGET = {
    "role": "any_value(role)",
    "proximity_group": "any_value(proximity_group)",
    "min_global_margin_mag": "CASE WHEN max(mod(tracklet_no,13))=5 THEN NULL ELSE max(mod(tracklet_no,13))/5e0-5e-1 END",
    "rate_arcsec_per_min": "max(mod(tracklet_no,17))/1.5e1-5e-2",
}


def stratum_targets(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).where("label = 'positive'").groupBy("field_id", "designation").agg(
        *[F.expr(e).alias(n) for n, e in _TARGET.items()]
    )


cte(
    "stgt",
    "SELECT field_id, designation, " + ", ".join(f"{e} AS {n}" for n, e in _TARGET.items())
    + " FROM labelled WHERE label='positive' GROUP BY 1,2",
)
