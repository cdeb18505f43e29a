"""Searches by footprint: exposures from orders, positions from suppliers,
all around right ascension zero."""

from checks import data
from checks.registry import cte, query, with_ctes
from driftline.operators import coverage as C

_EXPOSURE = {
    "pid": "o_orderkey",
    "obsjd": "2.458e6+mod(o_orderkey*31,60000)/1e3",
    "ra": "mod(358500+mod(o_orderkey*7919,3000),360000)/1e3",
    "dec": "mod(o_orderkey*104729,2000)/1e3-1e0",
    "half": "2e-1+mod(o_orderkey,5)/1e1",
    "maglimit": "CASE WHEN mod(o_orderkey,11)=3 THEN NULL ELSE 2e1+mod(o_custkey,9)/1e1 END",
}
_POSITION = {
    "star_id": "s_suppkey",
    "ra": "mod(358000+mod(s_suppkey*6007,4000),360000)/1e3+3.7e-4",
    "dec": "mod(s_suppkey*3571,2600)/1e3-1.30029e0",
    "radius_deg": "1e-1+mod(s_suppkey,4)/1e1",
    "start_jd": "2.458e6+mod(s_suppkey*13,50)*1e0",
    "end_jd": "2.458e6+mod(s_suppkey*13,50)+2e-1",
}


def exposures(spark, sf):
    rows = data.read(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _EXPOSURE.items()])
    corner = lambda a, b: f"named_struct('ra', pmod(ra{a}half,360e0), 'dec', dec{b}half)"
    corners = ", ".join(corner(a, b) for a, b in (("-", "-"), ("+", "+"), ("+", "-"), ("-", "+")))
    return rows.selectExpr("pid", "obsjd", "maglimit", f"array({corners}) AS corners")


def positions(spark, sf):
    return data.read(spark, sf, "supplier").selectExpr(*[f"{e} AS {n}" for n, e in _POSITION.items()])


cte("cexp", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EXPOSURE.items()) + " FROM orders")
cte("cposn", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _POSITION.items()) + " FROM supplier")


def _plane(ra, dec, ra0, dec0):
    dr, d, d0 = f"radians(({ra})-({ra0}))", f"radians({dec})", f"radians({dec0})"
    w = f"(sin({d0})*sin({d})+cos({d0})*cos({d})*cos({dr}))"
    return f"degrees(cos({d})*sin({dr})/{w})", f"degrees((cos({d0})*sin({d})-sin({d0})*cos({d})*cos({dr}))/{w})"


_c = [_plane(f"e.ra{a}e.half", f"e.dec{b}e.half", "p.ra", "p.dec") for a, b in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"))]
# Pairs near enough in both coordinates, with the corners about the position.
cte(
    "cpair",
    "SELECT *, abs(mod(CAST(e_ra-p_ra+540 AS DOUBLE),360)-180) AS dra FROM (SELECT p.star_id, p.radius_deg, p.ra AS p_ra, e.ra AS e_ra, e.pid, e.obsjd, e.maglimit, p.start_jd, p.end_jd, "
    + ", ".join(f"{x} AS x{k}, {y} AS y{k}" for k, (x, y) in enumerate(_c))
    + " FROM cposn p JOIN cexp e ON abs(p.dec-e.dec)<2e0 AND abs(mod(CAST(e.ra-p.ra+540 AS DOUBLE),360)-180)<2e0)",
)
_edges = [(k, (k + 1) % 4) for k in range(4)]
_cross = "+".join(f"CASE WHEN (y{a}>0)<>(y{b}>0) AND 0<x{a}-y{a}*(x{b}-x{a})/(y{b}-y{a}) THEN 1 ELSE 0 END" for a, b in _edges)
cte("cin", f"SELECT * FROM cpair WHERE ({_cross})%2=1")
_window = "obsjd>=start_jd AND obsjd<end_jd"


@query(
    "footprint_sequences",
    with_ctes(
        f"""
SELECT star_id, CAST(row_number() OVER (PARTITION BY star_id ORDER BY obsjd, pid)-1 AS INT) AS frame_no, pid, obsjd FROM
(SELECT *, count(*) OVER (PARTITION BY star_id) AS n FROM cin WHERE {_window}) WHERE n>={C.MIN_FRAMES}
"""
    ),
)
def footprint_sequences(spark, sf):
    return C.find_sequences(positions(spark, sf), exposures(spark, sf), ["star_id"])[0].select("star_id", "frame_no", "pid", "obsjd")


@query(
    "insufficient_sequences",
    with_ctes(
        f"SELECT p.star_id, CAST(count(c.pid) AS INT) AS found FROM cposn p LEFT JOIN (SELECT * FROM cin WHERE {_window}) c USING (star_id) GROUP BY 1 HAVING count(c.pid)<{C.MIN_FRAMES}"
    ),
)
def insufficient_sequences(spark, sf):
    return C.find_sequences(positions(spark, sf), exposures(spark, sf), ["star_id"])[1]


@query(
    "star_coverage",
    with_ctes(
        "SELECT star_id, CAST(count(*) AS BIGINT) AS exposures, min(obsjd) AS first_jd, max(obsjd) AS last_jd, max(maglimit) AS deepest FROM cin WHERE maglimit IS NOT NULL GROUP BY 1"
    ),
)
def star_coverage(spark, sf):
    survey = positions(spark, sf).selectExpr("star_id", "ra", "dec", "2.4579e6 AS start_jd", "2.4581e6 AS end_jd")
    return C.coverage_counts(survey, exposures(spark, sf), ["star_id"])


def _axis(a, b):
    n = [f"(x{k}*(y{b}-y{a})-y{k}*(x{b}-x{a}))" for k in range(4)]
    room = f"radius_deg*(abs(y{b}-y{a})+abs(x{b}-x{a}))"
    return f"NOT (least({','.join(n)})>{room} OR greatest({','.join(n)})<-{room})"


@query(
    "box_searches",
    with_ctes(
        f"SELECT star_id, pid FROM cpair WHERE {_window} AND "
        + " AND ".join(f"least({c}0,{c}1,{c}2,{c}3)<=radius_deg AND greatest({c}0,{c}1,{c}2,{c}3)>=-radius_deg" for c in "xy")
        + " AND " + " AND ".join(_axis(a, b) for a, b in _edges)
    ),
)
def box_searches(spark, sf):
    return C.box_searches(positions(spark, sf), exposures(spark, sf), ["star_id"], columns=["pid"]).select("star_id", "pid")
