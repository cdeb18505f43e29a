"""Stationary separation, linking and fitting."""

from pyspark.sql import functions as F

from checks import data
from checks.registry import bearing, cte, query, sep, with_ctes
from driftline.config import DEFAULT
from driftline.operators import tracklets as T


def near(a, b, r):
    """Cheap declination test in front of the exact one."""
    return f"abs({a}-{b}) <= ({r})/3.5e3"


cte(
    "stat",
    f"""
SELECT DISTINCT a.build_id, a.frame_no, a.det_no FROM det a JOIN det b
ON a.build_id=b.build_id AND a.frame_no<>b.frame_no AND {near('a.dec','b.dec','1.5e0')}
AND {sep('a.ra','a.dec','b.ra','b.dec')} <= 1.5e0
""",
)
cte("cand", "SELECT * FROM det ANTI JOIN stat USING (build_id, frame_no, det_no)")


def linking_ctes(suffix: str, det: str, cand: str) -> None:
    """Seeds, extensions, member lists of one set of detections."""
    dt = "(b.minutes-a.minutes)"
    cte(
        f"seed{suffix}",
        f"""
SELECT a.build_id, a.frame_no AS fa, a.det_no AS da, b.frame_no AS fb, b.det_no AS db,
 a.ra AS ra_a, a.dec AS dec_a, b.ra AS ra_b, b.dec AS dec_b,
 a.minutes AS minutes_a, b.minutes AS minutes_b,
 {sep('a.ra','a.dec','b.ra','b.dec')} AS separation
FROM {cand} a JOIN {cand} b ON a.build_id=b.build_id AND a.frame_no<b.frame_no
 AND {near('a.dec','b.dec',dt)} AND {sep('a.ra','a.dec','b.ra','b.dec')} <= 1e0*{dt}
""",
    )
    r = "radians(separation*(o.minutes-minutes_b)/(minutes_b-minutes_a)/3.6e3)"
    head = f"({bearing('ra_b','dec_b','ra_a','dec_a')}+pi())"
    sin_dec = f"(sin(radians(dec_b))*cos({r})+cos(radians(dec_b))*sin({r})*cos({head}))"
    cte(
        f"pred{suffix}",
        f"""
SELECT p.*, degrees(asin(sd)) AS p_dec,
 ra_b + degrees(atan2(sin(hd)*sin(rr)*cos(radians(dec_b)), cos(rr)-sin(radians(dec_b))*sd)) AS p_ra
FROM (SELECT s.*, o.frame_no, o.minutes, {head} AS hd, {r} AS rr, {sin_dec} AS sd
 FROM seed{suffix} s JOIN (SELECT DISTINCT build_id, frame_no, minutes FROM {det}) o
 ON s.build_id=o.build_id AND o.frame_no<>fa AND o.frame_no<>fb) p
""",
    )
    cte(
        f"ext{suffix}",
        f"""
SELECT * FROM (SELECT p.build_id, fa, da, fb, db, p.frame_no, c.det_no,
 count(*) OVER w AS within_reach,
 row_number() OVER (w ORDER BY {sep('p_ra','p_dec','c.ra','c.dec')}, c.dec, c.det_no) AS rn
 FROM pred{suffix} p JOIN {cand} c ON p.build_id=c.build_id AND p.frame_no=c.frame_no
 AND {near('p_dec','c.dec','2e0')} AND {sep('p_ra','p_dec','c.ra','c.dec')} <= 2e0
 WINDOW w AS (PARTITION BY p.build_id, fa, da, fb, db, p.frame_no)) WHERE rn=1
""",
    )
    cte(
        f"linked{suffix}",
        f"""
SELECT build_id, fa, da, fb, db, list(d ORDER BY f, d) AS dets FROM (
 SELECT build_id, fa, da, fb, db, frame_no AS f, det_no AS d FROM ext{suffix}
 UNION SELECT build_id, fa, da, fb, db, fa, da FROM ext{suffix}
 UNION SELECT build_id, fa, da, fb, db, fb, db FROM ext{suffix})
GROUP BY build_id, fa, da, fb, db HAVING count(*)>=3
""",
    )
    cte(
        f"uniq{suffix}",
        f"""
SELECT build_id, dets, count(*) AS seeds FROM linked{suffix} GROUP BY build_id, dets
""",
    )


linking_ctes("", "det", "cand")
# The same events as five-frame builds: exercises gaps and subset removal.
cte(
    "stat5",
    f"""
SELECT DISTINCT a.build_id, a.frame_no, a.det_no FROM det5 a JOIN det5 b
ON a.build_id=b.build_id AND a.frame_no<>b.frame_no AND {near('a.dec','b.dec','1.5e0')}
AND {sep('a.ra','a.dec','b.ra','b.dec')} <= 1.5e0
""",
)
cte("cand5", "SELECT * FROM det5 ANTI JOIN stat5 USING (build_id, frame_no, det_no)")
linking_ctes("5", "det5", "cand5")
cte("maxi", "SELECT build_id, dets FROM uniq")
cte(
    "trk",
    """
SELECT build_id, dets, CAST(row_number() OVER (PARTITION BY build_id ORDER BY
 [(d % 3) * 100000000000 + d FOR d IN dets]) AS BIGINT) AS tracklet_no FROM maxi
""",
)
_e = "degrees(atan2(cos(radians(d.dec))*sin(radians(d.ra-o.ra)), {along}))*3.6e3"
_along = (
    "cos(radians(d.dec))*cos(radians(d.ra-o.ra))*cos(radians(o.dec))+sin(radians(d.dec))*sin(radians(o.dec))"
)
_up = (
    "sin(radians(d.dec))*cos(radians(o.dec))-cos(radians(d.dec))*cos(radians(d.ra-o.ra))*sin(radians(o.dec))"
)
cte("mem", "SELECT build_id, tracklet_no, unnest(dets) AS det_no, dets[1] AS first_det FROM trk")
cte(
    "offs",
    f"""
SELECT m.build_id, m.tracklet_no, d.minutes-o.minutes AS t,
 {_e.format(along=_along)} AS e, degrees(asin({_up}))*3.6e3 AS n
FROM mem m JOIN det d ON d.det_no=m.det_no JOIN det o ON o.det_no=m.first_det
""",
)
cte(
    "fit",
    """
SELECT o.build_id, o.tracklet_no, any_value(se) AS se, any_value(sn) AS sn,
 sqrt(avg(pow(e-ie-se*t,2)+pow(n-i_n-sn*t,2))) AS rms,
 max(sqrt(pow(e-ie-se*t,2)+pow(n-i_n-sn*t,2))) AS mx
FROM offs o JOIN (SELECT build_id, tracklet_no, regr_slope(e,t) AS se, regr_intercept(e,t) AS ie,
 regr_slope(n,t) AS sn, regr_intercept(n,t) AS i_n FROM offs GROUP BY build_id, tracklet_no) g
 ON o.build_id=g.build_id AND o.tracklet_no=g.tracklet_no
GROUP BY o.build_id, o.tracklet_no
""",
)
cte(
    "tracklet",
    """
SELECT t.build_id, t.tracklet_no, t.dets, 'trk-' || lpad(CAST(t.tracklet_no AS VARCHAR), 4, '0') AS tracklet_id,
 sqrt(se*se+sn*sn) AS velocity, ((degrees(atan2(se,sn)) % 360)+360) % 360 AS pa, rms, mx,
 CASE WHEN mx > 5e-1 THEN 'rejected' ELSE 'built' END AS status
FROM trk t JOIN fit f ON t.build_id=f.build_id AND t.tracklet_no=f.tracklet_no
""",
)


def tracklets(spark, sf):
    dets = data.detections(spark, sf)
    return T.build_tracklets(dets, data.frames_of(dets))


@query(
    "stationary_counts",
    with_ctes(
        """
SELECT d.build_id, d.frame_no, CAST(count(*) AS BIGINT) AS detections,
 CAST(count(s.det_no) AS BIGINT) AS stationary, CAST(count(*)-count(s.det_no) AS BIGINT) AS candidates
FROM det d LEFT JOIN stat s USING (build_id, frame_no, det_no) GROUP BY d.build_id, d.frame_no
"""
    ),
)
def stationary_counts(spark, sf):
    marked = T.mark_stationary(data.detections(spark, sf), 1.5)
    return marked.groupBy("build_id", "frame_no").agg(
        F.count("*").alias("detections"),
        F.count_if("is_stationary").alias("stationary"),
        F.count_if(~F.col("is_stationary")).alias("candidates"),
    )


@query(
    "moving_candidates",
    with_ctes("SELECT build_id, frame_no, det_no, source_id, round(ra,6) AS ra, round(dec,6) AS dec FROM cand"),
)
def moving_candidates(spark, sf):
    out = T.moving_candidates(data.detections(spark, sf), 1.5)
    return out.select(
        "build_id", "frame_no", "det_no", "source_id",
        F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"),
    )


@query(
    "seed_pairs",
    with_ctes(
        "SELECT build_id, fa AS frame_a, da AS det_a, fb AS frame_b, db AS det_b,"
        " round(separation,4) AS separation FROM seed"
    ),
)
def seed_pairs(spark, sf):
    dets = data.detections(spark, sf)
    seeds = T.seed_pairs(T.prepare(dets, data.frames_of(dets)))
    return seeds.select(*T.SEED_KEY, F.round("separation", 4).alias("separation"))


@query(
    "seed_extensions",
    with_ctes(
        "SELECT build_id, fa AS frame_a, da AS det_a, fb AS frame_b, db AS det_b, frame_no,"
        " det_no AS nearest_det, CAST(within_reach AS BIGINT) AS within_reach FROM ext"
    ),
)
def seed_extensions(spark, sf):
    dets = data.detections(spark, sf)
    cand = T.prepare(dets, data.frames_of(dets))
    ext = T.extensions(T.seed_pairs(cand), cand)
    return ext.select(
        *T.SEED_KEY, "frame_no", F.col("nearest.det_no").alias("nearest_det"), "within_reach"
    )


@query(
    "build_tracklets",
    with_ctes(
        """
SELECT build_id, tracklet_no, tracklet_id, array_to_string(dets, ',') AS members,
 round(velocity,5) AS velocity, round(pa,3) AS position_angle, round(rms,4) AS fit_rms,
 round(mx,4) AS fit_max, status FROM tracklet
"""
    ),
)
def build_tracklets(spark, sf):
    return tracklets(spark, sf).select(
        "build_id",
        "tracklet_no",
        "tracklet_id",
        F.array_join(F.transform("members", lambda m: m["det_no"].cast("string")), ",").alias("members"),
        F.round("angular_velocity_arcsec_per_min", 5).alias("velocity"),
        F.round("position_angle_deg", 3).alias("position_angle"),
        F.round("fit_rms_residual_arcsec", 4).alias("fit_rms"),
        F.round("fit_max_residual_arcsec", 4).alias("fit_max"),
        "status",
    )


@query(
    "build_five_frames",
    with_ctes(
        """
SELECT build_id, CAST(row_number() OVER (PARTITION BY build_id ORDER BY [(d % 5) * 100000000000 + d FOR d IN dets]) AS BIGINT) AS tracklet_no,
 array_to_string(dets, ',') AS members, CAST(len(dets) AS INT) AS size FROM uniq5 u
WHERE NOT EXISTS (SELECT 1 FROM uniq5 o WHERE o.build_id=u.build_id AND len(o.dets)>len(u.dets) AND list_has_all(o.dets, u.dets))
"""
    ),
)
def build_five_frames(spark, sf):
    dets = data.detections(spark, sf, 5, "2e1")
    out = T.build_tracklets(dets, data.frames_of(dets))
    return out.selectExpr(
        "build_id", "tracklet_no", "array_join(transform(members, m -> CAST(m.det_no AS STRING)), ',') AS members",
        "size(members) AS size",
    )


@query(
    "build_diagnostics",
    with_ctes(
        """
SELECT f.build_id, f.frame_count, coalesce(c.n,0) AS candidate_count, coalesce(s.n,0) AS seed_pairs,
 coalesce(e.n,0) AS ambiguous_extensions, coalesce(u.n,0) AS linked_before_dedup,
 coalesce(u.n-u.k,0) AS duplicates_removed, coalesce(u.k-t.n,0) AS subsets_removed,
 coalesce(t.n,0) AS tracklet_count, coalesce(t.r,0) AS rejected_tracklet_count,
 coalesce(m.n,0) AS detections_in_multiple_tracklets
FROM (SELECT build_id, CAST(count(*) AS BIGINT) AS frame_count FROM frm GROUP BY 1) f
LEFT JOIN (SELECT build_id, CAST(count(*) AS BIGINT) AS n FROM cand GROUP BY 1) c USING (build_id)
LEFT JOIN (SELECT build_id, CAST(count(*) AS BIGINT) AS n FROM seed GROUP BY 1) s USING (build_id)
LEFT JOIN (SELECT build_id, CAST(count(*) FILTER (within_reach>1) AS BIGINT) AS n FROM ext GROUP BY 1) e USING (build_id)
LEFT JOIN (SELECT build_id, CAST(sum(seeds) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS k FROM uniq GROUP BY 1) u USING (build_id)
LEFT JOIN (SELECT build_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status='rejected') AS BIGINT) AS r FROM tracklet GROUP BY 1) t USING (build_id)
LEFT JOIN (SELECT build_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT build_id, det_no FROM mem GROUP BY 1,2 HAVING count(*)>1) GROUP BY 1) m USING (build_id)
"""
    ),
)
def build_diagnostics(spark, sf):
    dets = data.detections(spark, sf)
    return T.build_diagnostics(dets, data.frames_of(dets), DEFAULT)
