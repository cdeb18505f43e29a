"""The parameter sweep: every parameter, whole grids, against one build per
configuration in SQL."""

from checks import data
from checks.build import _along, _e, _up, near
from checks.registry import bearing, cte, query, sep, with_ctes
from driftline.operators import sweeps as S

_CONFIGS = S.sweep_configs()
_LINKINGS = sorted({S._linking(c) for c in _CONFIGS.values()})


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


cte(
    "swlink",
    f"SELECT * FROM (VALUES {_values((k, *map(float, lk[:3])) for k, lk in enumerate(_LINKINGS))}) AS v(lid, tol, rate, radius)",
)
cte(
    "swcfg",
    "SELECT * FROM (VALUES "
    + _values(
        (n, _LINKINGS.index(S._linking(c)), float(c.max_residual_arcsec), float(c.match_radius_arcsec))
        for n, c in _CONFIGS.items()
    )
    + ") AS v(config, lid, residual, reach)",
)
_s = sep("a.ra", "a.dec", "b.ra", "b.dec")
cte(
    "swstill",
    f"""
SELECT d.build_id, d.frame_no, d.det_no, d.ra, d.dec, d.minutes, coalesce(n.s, 1e99) AS still FROM det d LEFT JOIN (
 SELECT a.build_id, a.frame_no, a.det_no, min({_s}) AS s FROM det a JOIN det b ON a.build_id=b.build_id AND a.frame_no<>b.frame_no
 AND {near('a.dec','b.dec','3e0')} AND {_s}<=3e0 GROUP BY 1,2,3) n USING (build_id, frame_no, det_no)
""",
)
_dt = "(b.minutes-a.minutes)"
cte(
    "swpair",
    f"""
SELECT a.build_id, a.frame_no AS fa, a.det_no AS da, b.frame_no AS fb, b.det_no AS db, a.ra AS ra_a, a.dec AS dec_a, b.ra AS ra_b, b.dec AS dec_b,
 a.minutes AS minutes_a, b.minutes AS minutes_b, least(a.still,b.still) AS still, {_s} AS separation
FROM swstill a JOIN swstill b ON a.build_id=b.build_id AND a.frame_no<b.frame_no AND a.still>5e-1 AND b.still>5e-1
 AND {near('a.dec','b.dec','2e0*'+_dt)} AND {_s} <= 2e0*{_dt}
""",
)
cte(
    "swseed",
    "SELECT p.*, lid, tol, radius FROM swpair p JOIN swlink l ON p.still>l.tol AND p.separation <= l.rate*(p.minutes_b-p.minutes_a)",
)
_r = "radians(separation*(o.minutes-minutes_b)/(minutes_b-minutes_a)/3.6e3)"
_head = f"({bearing('ra_b','dec_b','ra_a','dec_a')}+pi())"
cte(
    "swhit",
    f"""
SELECT * FROM (SELECT p.build_id, fa, da, fb, db, p.frame_no, c.det_no, c.dec, c.still AS c_still, {sep('p_ra','p_dec','c.ra','c.dec')} AS dist FROM (
 SELECT q.*, degrees(asin(sd)) AS p_dec, ra_b + degrees(atan2(sin(hd)*sin(rr)*cos(radians(dec_b)), cos(rr)-sin(radians(dec_b))*sd)) AS p_ra FROM (
  SELECT s.*, o.frame_no, {_head} AS hd, {_r} AS rr, (sin(radians(dec_b))*cos({_r})+cos(radians(dec_b))*sin({_r})*cos({_head})) AS sd
  FROM swpair s JOIN (SELECT DISTINCT build_id, frame_no, minutes FROM det) o ON s.build_id=o.build_id AND o.frame_no<>fa AND o.frame_no<>fb) q) p
 JOIN swstill c ON p.build_id=c.build_id AND p.frame_no=c.frame_no AND {near('p_dec','c.dec','3e0')}) WHERE dist<=3e0
""",
)
cte(
    "swext",
    """
SELECT lid, build_id, fa, da, fb, db, frame_no, det_no FROM swseed s JOIN swhit h USING (build_id, fa, da, fb, db)
WHERE h.c_still>s.tol AND h.dist<=s.radius
QUALIFY row_number() OVER (PARTITION BY lid, build_id, fa, da, fb, db, frame_no ORDER BY dist, dec, det_no)=1
""",
)
cte(
    "swset",
    """
SELECT DISTINCT lid, build_id, dets FROM (SELECT lid, build_id, fa, da, fb, db, list(d ORDER BY f, d) AS dets FROM (
 SELECT lid, build_id, fa, da, fb, db, frame_no AS f, det_no AS d FROM swext
 UNION SELECT lid, build_id, fa, da, fb, db, fa, da FROM swext UNION SELECT lid, build_id, fa, da, fb, db, fb, db FROM swext)
 GROUP BY lid, build_id, fa, da, fb, db HAVING count(*)>=3)
""",
)
cte("swone", "SELECT build_id, dets, row_number() OVER () AS sid FROM (SELECT DISTINCT build_id, dets FROM swset)")
cte("swmem", "SELECT build_id, sid, unnest(dets) AS det_no, dets[1] AS first_det FROM swone")
cte(
    "swoffs",
    f"""
SELECT m.sid, d.build_id, d.frame_no, d.ra, d.dec, d.minutes-o.minutes AS t, {_e.format(along=_along)} AS e, degrees(asin({_up}))*3.6e3 AS n
FROM swmem m JOIN det d ON d.det_no=m.det_no JOIN det o ON o.det_no=m.first_det
""",
)
cte(
    "swfit",
    """
SELECT o.sid, max(sqrt(pow(e-ie-se*t,2)+pow(n-i_n-sn*t,2))) AS mx, count(*) AS nm FROM swoffs o JOIN (
 SELECT sid, regr_slope(e,t) AS se, regr_intercept(e,t) AS ie, regr_slope(n,t) AS sn, regr_intercept(n,t) AS i_n FROM swoffs GROUP BY 1) g USING (sid) GROUP BY 1
""",
)
cte(
    "swmatch",
    f"""
SELECT sid, designation, mxr, rms, perr FROM (SELECT o.sid, e.designation, count(*) AS n, max({sep('o.ra','o.dec','e.predicted_ra','e.predicted_dec')}) AS mxr,
 sqrt(avg(pow({sep('o.ra','o.dec','e.predicted_ra','e.predicted_dec')},2))) AS rms, max(e.position_error_arcsec) AS perr
 FROM swoffs o JOIN ephlast e ON o.build_id=e.build_id AND o.frame_no=e.frame_no AND abs(o.dec-e.predicted_dec)<=2e-3
 WHERE {sep('o.ra','o.dec','e.predicted_ra','e.predicted_dec')}<=5e0 GROUP BY 1,2) JOIN swfit USING (sid) WHERE n=nm
""",
)


@query(
    "parameter_sweep",
    with_ctes(
        """
SELECT config, build_id, CAST(count(*) AS BIGINT) AS tracklets, CAST(count(*) FILTER (mx<=residual) AS BIGINT) AS built,
 CAST(count(*) FILTER (k=1 AND perr<=reach) AS BIGINT) AS known, CAST(count(*) FILTER (k=0 AND mx<=residual) AS BIGINT) AS unknown_built FROM (
 SELECT c.config, c.residual, c.reach, s.build_id, o.sid, any_value(f.mx) AS mx, count(m.designation) AS k, arg_min(m.perr, (m.mxr, m.rms, m.designation)) AS perr
 FROM swcfg c JOIN swset s USING (lid) JOIN swone o ON o.build_id=s.build_id AND o.dets=s.dets JOIN swfit f ON f.sid=o.sid
 LEFT JOIN swmatch m ON m.sid=o.sid AND m.mxr<=c.reach GROUP BY 1,2,3,4,5) GROUP BY 1,2
"""
    ),
)
def parameter_sweep(spark, sf):
    dets = data.detections(spark, sf)
    return S.sweep(dets, data.frames_of(dets), data.listings(spark, sf), _CONFIGS)
