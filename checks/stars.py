"""Star classes, proximity, density cubes and radial evidence."""

from pyspark.sql import functions as F

from checks import data
from checks.build import tracklets
from checks.registry import cte, query, sep, with_ctes
from checks.review import identified, quality
from driftline.functions import classify as C
from driftline.functions.classify import johnson_v
from driftline.functions.sky import edge_distance, unit_vector, vector_position
from driftline.operators import stars as S
from driftline.operators.ordered import cut_lineage, spread
from driftline.operators.quality import mask_state

# A wide footprint for the stars' sky, corners given crosswise.
WIDE = ((119.7, 9.7), (120.3, 10.31), (119.69, 10.3), (120.31, 9.69))


def hav(ra1, dec1, ra2, dec2):
    h = (
        f"pow(sin((radians({dec2})-radians({dec1}))/2),2)+cos(radians({dec1}))*cos(radians({dec2}))"
        f"*pow(sin(radians(({ra2})-({ra1}))/2),2)"
    )
    return f"(degrees(2*asin(sqrt(least(greatest({h},0e0),1e0))))*3.6e3)"


def shapes(spark, sf):
    points = ", ".join(f"named_struct('ra', {a!r}D, 'dec', {b!r}D)" for a, b in WIDE)
    fields = data.stars(spark, sf).select("field_id").distinct()
    return cut_lineage(S.footprints(fields.selectExpr("field_id", f"array({points}) AS corners")))


cte(
    "fstar",
    f"""
SELECT s.*, CASE WHEN v_mag<4e0 THEN 0 WHEN v_mag<6e0 THEN 1 WHEN v_mag<8e0 THEN 2 WHEN v_mag<1e1 THEN 3 ELSE 4 END AS mag_class,
 NOT EXISTS (SELECT 1 FROM star o WHERE o.field_id=s.field_id AND o.v_mag<s.v_mag AND {hav('s.star_ra','s.star_dec','o.star_ra','o.star_dec')}<9e2) AS isolated
FROM star s WHERE v_mag<=1.1e1
""",
)
_TPOS = """(SELECT build_id, tracklet_no, (degrees(atan2(y,x))%360+360)%360 AS ra, degrees(atan2(z,sqrt(x*x+y*y))) AS dec FROM (
 SELECT build_id, tracklet_no, sum(cos(radians(dec))*cos(radians(ra))) AS x, sum(cos(radians(dec))*sin(radians(ra))) AS y, sum(sin(radians(dec))) AS z FROM memd GROUP BY 1,2))"""
cte("tmean", "SELECT * FROM " + _TPOS)
cte(
    "trow",
    """
SELECT p.*, CASE WHEN i.status='built' AND istat='unknown' THEN 'unknown_built' WHEN i.status='built' AND istat='known' THEN 'known_built'
 WHEN i.status='rejected' AND istat='unknown' THEN 'unknown_rejected' ELSE 'other' END AS grp,
 CASE WHEN masked_detection_count=0 THEN 'unmasked' WHEN masked_detection_count=detection_count THEN 'all_masked' ELSE 'partially_masked' END AS mask_state,
 (mask_bits_common>>12)&1=1 AS halo_bit_all, min_snr
FROM tmean p JOIN ident i USING (build_id, tracklet_no) JOIN qual q USING (build_id, tracklet_no)
""",
)


def tracklet_rows(spark, sf):
    """Mean position, group and mask state of every tracklet."""
    trk = tracklets(spark, sf)
    parts = unit_vector("p.ra", "p.dec")
    ra, dec = vector_position("x", "y", "z")
    mean = trk.selectExpr(
        "build_id", "tracklet_no",
        *[f"aggregate(transform(members, p -> {v}), 0D, (a, v) -> a + v) AS {n}" for v, n in zip(parts, "xyz")],
    ).selectExpr("build_id", "tracklet_no", f"{ra} AS ra", f"{dec} AS dec")
    ids = identified(spark, sf, trk).select("build_id", "tracklet_no", "identification_status")
    group = (
        "CASE WHEN status='built' AND identification_status='unknown' THEN 'unknown_built'"
        " WHEN status='built' AND identification_status='known' THEN 'known_built'"
        " WHEN status='rejected' AND identification_status='unknown' THEN 'unknown_rejected' ELSE 'other' END"
    )
    keys = ["build_id", "tracklet_no"]
    return cut_lineage(
        mean.join(ids, keys).join(quality(spark, sf, trk), keys).selectExpr(
            "build_id AS field_id", "tracklet_no", "ra", "dec", f"{group} AS grp",
            f"{mask_state('masked_detection_count', 'detection_count')} AS mask_state",
            "getbit(CAST(mask_bits_common AS BIGINT), 12)=1 AS halo_bit_all", "min_snr",
        )
    )


def field_stars(spark, sf):
    return cut_lineage(S.field_stars(data.stars(spark, sf), shapes(spark, sf)))


@query(
    "field_stars",
    with_ctes("SELECT field_id, star_id, round(v_mag,3) AS v_mag, mag_class, isolated FROM fstar"),
)
def field_star_query(spark, sf):
    return field_stars(spark, sf).selectExpr("field_id", "star_id", "round(v_mag,3) AS v_mag", "mag_class", "isolated")


cte(
    "sprox",
    "SELECT t.build_id AS field_id, t.tracklet_no, "
    + ", ".join(f"round(min(sp) FILTER (mag_class={c}),2) AS sep_{c}" for c in range(5))
    + ", round(min(sp),2) AS nearest_separation, arg_min(v_mag,(sp,star_id)) AS nearest_v_mag, arg_min(star_id,(sp,star_id)) AS nearest_star FROM tmean t LEFT JOIN ("
    f"SELECT t.build_id, t.tracklet_no, s.*, {sep('t.ra','t.dec','s.star_ra','s.star_dec')} AS sp FROM tmean t JOIN fstar s ON s.field_id=t.build_id) x"
    " ON x.build_id=t.build_id AND x.tracklet_no=t.tracklet_no GROUP BY 1,2",
)


@query(
    "star_proximity",
    with_ctes("SELECT * FROM sprox"),
)
def star_proximity(spark, sf):
    return S.proximity(tracklet_rows(spark, sf), field_stars(spark, sf), ["field_id", "tracklet_no"])


# Predicted positions of an object in all frames: its closest approach to each class.
@query(
    "closest_approach",
    with_ctes(
        "SELECT build_id AS field_id, designation, "
        + ", ".join(f"round(min(sp) FILTER (mag_class={c}),2) AS sep_{c}" for c in range(5))
        + ", round(min(sp),2) AS nearest_separation FROM (SELECT e.build_id, e.designation, s.mag_class, "
        + sep("e.predicted_ra", "e.predicted_dec", "s.star_ra", "s.star_dec")
        + " AS sp FROM eph e LEFT JOIN fstar s ON s.field_id=e.build_id) GROUP BY 1,2"
    ),
)
def closest_approach(spark, sf):
    key = ["field_id", "designation"]
    positions = data.ephemerides(spark, sf).selectExpr(
        "build_id AS field_id", "designation", "frame_no", "predicted_ra AS ra", "predicted_dec AS dec"
    )
    out = S.closest_approach(S.proximity(positions, field_stars(spark, sf), [*key, "frame_no"]), key)
    return out.drop("nearest_v_mag")


def _edge_sql() -> str:
    """Least distance from the star, at the plane's origin, to four segments."""
    order = [WIDE[k] for k in (0, 3, 1, 2)]
    d0 = "radians(star_dec)"
    points = []
    for ra, dec in order:
        d, dr = f"radians({dec!r}e0)", f"radians({ra!r}e0-star_ra)"
        w = f"(sin({d0})*sin({d})+cos({d0})*cos({d})*cos({dr}))"
        points.append((f"(cos({d})*sin({dr})/{w})", f"((cos({d0})*sin({d})-sin({d0})*cos({d})*cos({dr}))/{w})"))
    named = ", ".join(f"{x} AS x{k}, {y} AS y{k}" for k, (x, y) in enumerate(points))
    reach = []
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        dx, dy = f"(x{b}-x{a})", f"(y{b}-y{a})"
        t = f"least(greatest(-(x{a}*{dx}+y{a}*{dy})/({dx}*{dx}+{dy}*{dy}),0),1)"
        reach.append(f"sqrt(pow(x{a}+{t}*{dx},2)+pow(y{a}+{t}*{dy},2))")
    return (
        f"SELECT field_id, star_id, round(degrees(least({', '.join(reach)}))*3.6e3,2) AS edge_arcsec,"
        " round(CASE WHEN k=2 THEN v_mag ELSE v_mag-9e-2*(k/1e1) END,6) AS v"
        f" FROM (SELECT *, mod(CAST(split_part(star_id,'-',2) AS BIGINT),7) AS k, {named} FROM star)"
    )


@query("edge_distances", with_ctes(_edge_sql()))
def edge_distances(spark, sf):
    """Each star's distance from the nearest footprint edge, and V from two
    bands, of which the second is missing for some."""
    points = ", ".join(f"named_struct('ra', {a!r}D, 'dec', {b!r}D)" for a, b in WIDE)
    # A star is few bytes and much work: spread them first.
    rows = spread(data.stars(spark, sf), "star_id").selectExpr(
        "*", f"array({points}) AS corners", "mod(CAST(split(star_id,'-')[1] AS BIGINT),7) AS k"
    ).selectExpr("*", "if(k=2, NULL, v_mag + k/1e1) AS bt_mag")
    return rows.selectExpr(
        "field_id", "star_id", f"round({edge_distance('star_ra', 'star_dec', 'corners')},2) AS edge_arcsec",
        f"round({johnson_v('v_mag', 'bt_mag')},6) AS v",
    )


_SEP = [f"sep_{c}" for c in range(5)]


@query(
    "proximity_groups",
    with_ctes(
        """
SELECT field_id, tracklet_no, CASE WHEN coalesce(least(sep_0,sep_1)<120,false) OR coalesce(sep_2<60,false) OR coalesce(sep_3<30,false) THEN 'zone'
 WHEN least(sep_0,sep_1,sep_2,sep_3)<240 THEN 'outer' WHEN coalesce(least(sep_0,sep_1,sep_2,sep_3)>=480,true) AND coalesce(sep_4>=60,true) THEN 'control'
 ELSE 'intermediate' END AS proximity_group,
 CASE WHEN least(sep_0,sep_1,sep_2,sep_3) IS NULL THEN 'none' WHEN sep_0=least(sep_0,sep_1,sep_2,sep_3) OR sep_1=least(sep_0,sep_1,sep_2,sep_3) THEN 'V<6'
 WHEN sep_2=least(sep_0,sep_1,sep_2,sep_3) THEN '6-8' ELSE '8-10' END AS star_class FROM sprox
"""
    ),
)
def proximity_groups(spark, sf):
    out = S.proximity(tracklet_rows(spark, sf), field_stars(spark, sf), ["field_id", "tracklet_no"])
    return out.selectExpr(
        "field_id", "tracklet_no", f"{C.proximity_group(_SEP)} AS proximity_group", f"{C.star_class(_SEP)} AS star_class"
    )


def _wide_edges():
    """Edges of the wide footprint in the tangent plane of its centre."""
    import math

    def vec(a, d):
        a, d = math.radians(a), math.radians(d)
        return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)

    x, y, z = (sum(v) for v in zip(*(vec(*c) for c in WIDE)))
    ra0, dec0 = math.degrees(math.atan2(y, x)), math.degrees(math.atan2(z, math.hypot(x, y)))

    def gno(a, d):
        a, d, a0, d0 = map(math.radians, (a, d, ra0, dec0))
        w = math.sin(d0) * math.sin(d) + math.cos(d0) * math.cos(d) * math.cos(a - a0)
        return (
            math.cos(d) * math.sin(a - a0) / w,
            (math.cos(d0) * math.sin(d) - math.sin(d0) * math.cos(d) * math.cos(a - a0)) / w,
        )

    pts = [gno(*c) for c in WIDE]
    mx, my = sum(p[0] for p in pts) / 4, sum(p[1] for p in pts) / 4
    pts.sort(key=lambda p: math.atan2(p[1] - my, p[0] - mx))
    return ra0, dec0, list(zip(pts, pts[1:] + pts[:1]))


RA0, DEC0, EDGES = _wide_edges()


def _inside(x, y):
    terms = [
        f"CASE WHEN (({y1!r}>{y})<>({y2!r}>{y})) AND {x}<{x1!r}+({y}-({y1!r}))*({x2!r}-({x1!r}))/({y2!r}-({y1!r})) THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in EDGES
    ]
    return f"(({'+'.join(terms)})%2=1)"


def _gno(ra, dec):
    dr, d, d0 = f"radians({ra}-{RA0!r}e0)", f"radians({dec})", f"radians({DEC0!r}e0)"
    w = f"(sin({d0})*sin({d})+cos({d0})*cos({d})*cos({dr}))"
    return f"cos({d})*sin({dr})/{w}", f"(cos({d0})*sin({d})-sin({d0})*cos({d})*cos({dr}))/{w}"


_gx, _gy = _gno("s_ra", "s_dec")
cte(
    "areas",
    f"""
SELECT field_id, star_id, any_value(mag_class) AS mag_class, any_value(isolated) AS isolated, annulus,
 avg(CASE WHEN {_inside('x','y')} THEN 1e0 ELSE 0e0 END)*pi()*(any_value(r2)*any_value(r2)-any_value(r1)*any_value(r1))/3.6e3 AS area
FROM (SELECT *, {_gx} AS x, {_gy} AS y FROM (SELECT *, star_ra+r*sin(a)/3.6e3/cos(radians(star_dec)) AS s_ra, star_dec+r*cos(a)/3.6e3 AS s_dec FROM (
 SELECT f.*, n.annulus, n.r1, n.r2, sqrt(r1*r1+(i.i+0.5e0)/24*(r2*r2-r1*r1)) AS r, j.j*2*pi()/360 AS a
 FROM fstar f, (VALUES {','.join(f'({i},{a!r}::DOUBLE,{b!r}::DOUBLE)' for i,(a,b) in enumerate(zip(C.ANNULUS_EDGES,C.ANNULUS_EDGES[1:])))}) n(annulus,r1,r2), range(24) i(i), range(360) j(j))))
GROUP BY field_id, star_id, annulus
""",
)


@query(
    "annulus_areas",
    with_ctes("SELECT field_id, star_id, annulus, round(area,3) AS area_arcmin2 FROM areas"),
)
def annulus_areas(spark, sf):
    return S.annulus_areas(field_stars(spark, sf), shapes(spark, sf)).selectExpr(
        "field_id", "star_id", "annulus", "round(area_arcmin2,3) AS area_arcmin2"
    )


cte(
    "pairs",
    f"""
SELECT t.*, s.star_id, s.mag_class, s.isolated, CASE WHEN sp<15 THEN 0 WHEN sp<30 THEN 1 WHEN sp<60 THEN 2 WHEN sp<120 THEN 3 WHEN sp<240 THEN 4 WHEN sp<480 THEN 5 ELSE 6 END AS annulus
FROM (SELECT t.*, s.star_id AS sid, {hav('s.star_ra','s.star_dec','t.ra','t.dec')} AS sp FROM trow t JOIN fstar s ON s.field_id=t.build_id) t
JOIN fstar s ON s.field_id=t.build_id AND s.star_id=t.sid
WHERE sp<9e2 AND EXISTS (SELECT 1 FROM areas a WHERE a.field_id=s.field_id AND a.star_id=s.star_id AND a.area>0)
""",
)
cte(
    "cells",
    """
SELECT * FROM (SELECT field, mag_class, scope, annulus, count(*) AS stars, sum(area) AS area FROM (
  SELECT unnest([CAST(field_id AS VARCHAR),'ALL']) AS field, * FROM (SELECT unnest(CASE WHEN isolated THEN ['isolated','all'] ELSE ['all'] END) AS scope, a.*
   FROM areas a WHERE EXISTS (SELECT 1 FROM areas b WHERE b.field_id=a.field_id AND b.star_id=a.star_id AND b.area>0))) GROUP BY 1,2,3,4) e
LEFT JOIN (SELECT field, mag_class, scope, annulus, count(*) FILTER (grp='unknown_built') AS ub, count(*) FILTER (grp='unknown_rejected') AS ur,
  count(*) FILTER (grp='known_built') AS kb, count(*) FILTER (grp='unknown_built' AND mask_state='partially_masked') AS upm,
  count(*) FILTER (grp='unknown_built' AND halo_bit_all) AS uh FROM (
  SELECT unnest([CAST(build_id AS VARCHAR),'ALL']) AS field, * FROM (SELECT unnest(CASE WHEN isolated THEN ['isolated','all'] ELSE ['all'] END) AS scope, p.* FROM pairs p)) GROUP BY 1,2,3,4) c
USING (field, mag_class, scope, annulus)
""",
)


def cells(spark, sf):
    return S.density_cells(tracklet_rows(spark, sf), field_stars(spark, sf), shapes(spark, sf))


@query(
    "density_cells",
    with_ctes(
        "SELECT field AS field_id, mag_class, scope, annulus, CAST(stars AS BIGINT) AS stars, round(area,2) AS area_arcmin2,"
        " CAST(coalesce(ub,0) AS BIGINT) AS unknown_built, CAST(coalesce(ur,0) AS BIGINT) AS unknown_rejected, CAST(coalesce(kb,0) AS BIGINT) AS known_built,"
        " CAST(coalesce(upm,0) AS BIGINT) AS unknown_partially_masked, CAST(coalesce(uh,0) AS BIGINT) AS unknown_halo_bit FROM cells"
    ),
)
def density_cells(spark, sf):
    return cells(spark, sf).selectExpr(
        "field_id", "mag_class", "scope", "annulus", "stars", "round(area_arcmin2,2) AS area_arcmin2", "unknown_built",
        "unknown_rejected", "known_built", "unknown_partially_masked", "unknown_halo_bit",
    )


@query(
    "density_excess",
    with_ctes(
        """
SELECT c.field AS field_id, c.mag_class, c.scope, c.annulus, round(CASE WHEN c.area>0 THEN coalesce(c.ub,0)/c.area END,5) AS density,
 round(CASE WHEN c.area>0 AND b.area>0 AND b.ub>0 THEN coalesce(c.ub,0)/c.area/(b.ub/b.area) END,4) AS ratio
FROM cells c LEFT JOIN cells b ON b.field=c.field AND b.mag_class=c.mag_class AND b.scope=c.scope AND b.annulus=6
"""
    ),
)
def density_excess(spark, sf):
    return S.excess(cells(spark, sf)).selectExpr(
        "field_id", "mag_class", "scope", "annulus", "round(density,5) AS density", "round(ratio,4) AS ratio"
    )


@query(
    "cell_summaries",
    with_ctes(
        f"""
SELECT field AS field_id, mag_class, scope, annulus, CAST(count(*) AS BIGINT) AS count, round(median(min_snr),5) AS median, round(quantile_cont(min_snr,0.25),5) AS p25 FROM (
 SELECT unnest([CAST(build_id AS VARCHAR),'ALL']) AS field, * FROM (SELECT unnest(CASE WHEN isolated THEN ['isolated','all'] ELSE ['all'] END) AS scope, p.* FROM
 (SELECT t.*, s.mag_class, s.isolated, CASE WHEN sp<15 THEN 0 WHEN sp<30 THEN 1 WHEN sp<60 THEN 2 WHEN sp<120 THEN 3 WHEN sp<240 THEN 4 WHEN sp<480 THEN 5 ELSE 6 END AS annulus
  FROM (SELECT t.*, s.star_id AS sid, {hav('s.star_ra','s.star_dec','t.ra','t.dec')} AS sp FROM trow t JOIN fstar s ON s.field_id=t.build_id WHERE t.grp='unknown_built') t
  JOIN fstar s ON s.field_id=t.build_id AND s.star_id=t.sid WHERE sp<9e2) p)) GROUP BY 1,2,3,4
"""
    ),
)
def cell_summaries(spark, sf):
    return S.cell_summaries(tracklet_rows(spark, sf), field_stars(spark, sf), "min_snr").selectExpr(
        "field_id", "mag_class", "scope", "annulus", "count", "round(median,5) AS median", "round(p25,5) AS p25"
    )


_BIN = "CASE WHEN sp<120 THEN 0 WHEN sp<240 THEN 1 WHEN sp<360 THEN 2 WHEN sp<480 THEN 3 WHEN sp<600 THEN 4 WHEN sp<900 THEN 5 ELSE 6 END"


def radial_rows(spark, sf):
    bright = S.bright(data.stars(spark, sf))
    return S.nearest_star(tracklet_rows(spark, sf), bright, ["field_id", "tracklet_no"])


@query(
    "radial_counts",
    with_ctes(
        f"""
SELECT field_id, bin, CAST(count(*) AS BIGINT) AS tracklets, CAST(count(*) FILTER (grp='unknown_built') AS BIGINT) AS unknown_built FROM (
SELECT build_id AS field_id, grp, {_BIN} AS bin FROM (SELECT t.build_id, t.tracklet_no, t.grp, min({sep('t.ra','t.dec','s.star_ra','s.star_dec')}) AS sp
 FROM trow t JOIN star s ON s.field_id=t.build_id AND s.v_mag<=6.5e0 GROUP BY 1,2,3)) GROUP BY 1,2
"""
    ),
)
def radial_counts(spark, sf):
    rows = radial_rows(spark, sf).where("separation IS NOT NULL").withColumn(
        "bin", F.expr(C.bin_index("separation", C.RADIAL_EDGES))
    )
    return rows.groupBy("field_id", "bin").agg(
        F.count("*").alias("tracklets"), F.expr("count_if(grp = 'unknown_built')").alias("unknown_built")
    )


@query("radial_bins")
def radial_bins(spark, sf):
    areas = S.bin_areas(shapes(spark, sf), S.bright(data.stars(spark, sf)), grid=S.AREA_GRID)
    return S.radial_bins(radial_rows(spark, sf), areas)


def halos(spark, sf):
    """The brightest star with a magnitude of each field."""
    return data.stars(spark, sf).where("v_mag IS NOT NULL").groupBy("field_id").agg(
        F.min_by("star_ra", F.struct("v_mag", "star_id")).alias("star_ra"),
        F.min_by("star_dec", F.struct("v_mag", "star_id")).alias("star_dec"),
    )


cte(
    "hstar",
    "SELECT field_id, arg_min(star_ra,(v_mag,star_id)) AS star_ra, arg_min(star_dec,(v_mag,star_id)) AS star_dec FROM star WHERE v_mag IS NOT NULL GROUP BY 1",
)
cte(
    "hrad",
    f"""
SELECT h.*, r.halo_radius, r.unflagged FROM hstar h JOIN (SELECT build_id, any_value(hr) AS halo_radius, count(*) FILTER (a<=hr AND (mask_bits>>12)&1=0) AS unflagged FROM (
 SELECT *, max(a) FILTER ((mask_bits>>12)&1=1) OVER (PARTITION BY build_id) AS hr FROM (SELECT d.build_id, d.mask_bits, {sep('d.ra','d.dec','h.star_ra','h.star_dec')} AS a
 FROM det d JOIN hstar h ON h.field_id=d.build_id)) GROUP BY 1) r ON r.build_id=h.field_id
""",
)


def halo_radii(spark, sf):
    dets = data.detections(spark, sf).withColumnRenamed("build_id", "field_id")
    return S.halo_radius(dets, halos(spark, sf))


@query(
    "halo_radius",
    with_ctes("SELECT field_id, round(halo_radius,3) AS halo_radius, CAST(unflagged AS BIGINT) AS unflagged_inside FROM hrad"),
)
def halo_radius(spark, sf):
    return halo_radii(spark, sf).selectExpr("field_id", "round(halo_radius,3) AS halo_radius", "unflagged_inside")


@query(
    "halo_strata",
    with_ctes(
        f"""
SELECT field_id, stratum, CAST(count(*) AS BIGINT) AS tracklets, CAST(count(*) FILTER (ih) AS BIGINT) AS inside_halo, CAST(count(*) FILTER (hb) AS BIGINT) AS halo_bit_all,
 CAST(count(*) FILTER (tb) AS BIGINT) AS track_bit_any, CAST(count(*) FILTER (sd>0) AS BIGINT) AS with_shared_detection FROM (
SELECT m.build_id AS field_id, m.tracklet_no, bool_and({sep('m.ra','m.dec','h.star_ra','h.star_dec')}<=h.halo_radius) AS ih, bool_and((m.mask_bits>>12)&1=1) AS hb,
 bool_or(m.mask_bits&1=1) AS tb, count(*) FILTER (u.uses>1) AS sd,
 CASE WHEN any_value(i.status)<>'built' THEN 'rejected' WHEN any_value(i.istat)='known' THEN 'known' WHEN any_value(i.istat)='ambiguous' THEN 'ambiguous'
  WHEN count(*) FILTER (m.mask_bits<>0)=count(*) THEN 'masked_unknown' WHEN count(*) FILTER (m.mask_bits<>0)>0 THEN 'partially_masked_unknown' ELSE 'unmasked_unknown' END AS stratum
FROM memd m JOIN hrad h ON h.field_id=m.build_id JOIN ident i ON i.build_id=m.build_id AND i.tracklet_no=m.tracklet_no
JOIN (SELECT det_no, count(*) AS uses FROM mem GROUP BY 1) u ON u.det_no=m.det_no GROUP BY 1,2) GROUP BY 1,2
"""
    ),
)
def halo_strata(spark, sf):
    return S.stratum_counts(contexts(spark, sf), ["field_id"])


def contexts(spark, sf):
    from driftline.operators import quality as Q

    trk = tracklets(spark, sf)
    members = Q.members_with_detections(trk, data.detections(spark, sf)).withColumnRenamed("build_id", "field_id")
    ctx = S.halo_contexts(members, halo_radii(spark, sf))
    ids = identified(spark, sf, trk).select("build_id", "tracklet_no", "tracklet_id", "identification_status")
    q = quality(spark, sf, trk)
    joined = ids.join(q, ["build_id", "tracklet_no"]).withColumnRenamed("build_id", "field_id")
    stratum = C.sample_stratum("status", "identification_status", "masked_detection_count", "detection_count")
    return cut_lineage(
        ctx.join(joined, ["field_id", "tracklet_no"]).selectExpr(
            *[c for c in ctx.columns], "tracklet_id", "mask_bits_union AS mask_pattern", f"{stratum} AS stratum"
        )
    )


