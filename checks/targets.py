"""Target selection, traces, outcomes and acceptance."""

from checks import data
from checks.build import near, tracklets
from checks.registry import cte, query, sep, with_ctes
from checks.review import identified
from driftline.operators import targets as G
from driftline.operators import tracklets as T
from driftline.operators.ordered import cut_lineage

cte(
    "targ",
    f"""
SELECT * FROM (SELECT build_id, designation,
 CASE WHEN max(position_error_arcsec)>1e0 THEN NULL WHEN arg_min(vm,frame_no)<=mm-5e-1 THEN 'primary'
  WHEN arg_min(vm,frame_no)<=mm+5e-1 THEN 'marginal' END AS role,
 arg_min(vm,frame_no) AS v_magnitude, max(position_error_arcsec) AS perr,
 arg_min(sqrt(pow(motion_ra,2)+pow(motion_dec,2))/6e1, frame_no) AS prate,
 arg_min(((degrees(atan2(motion_ra,motion_dec))%360)+360)%360, frame_no) AS pangle
FROM (SELECT e.*, coalesce(e.v_magnitude, 99e0) AS vm, m.n, m.mm, {data.inside_sql('predicted_ra','predicted_dec')} AS ins FROM eph e
 JOIN (SELECT build_id, count(*) AS n, min(maglimit) AS mm FROM frm GROUP BY 1) m ON m.build_id=e.build_id)
GROUP BY build_id, designation, n, mm HAVING count(*)=n AND bool_and(ins) AND arg_min(vm,frame_no)<90) WHERE role IS NOT NULL
""",
)
cte(
    "tpos",
    "SELECT t.build_id, t.designation, t.v_magnitude, e.frame_no, e.predicted_ra AS t_ra, e.predicted_dec AS t_dec FROM targ t JOIN eph e USING (build_id, designation)",
)
cte(
    "telig",
    f"""
SELECT t.build_id, t.designation, t.prate<=1e0 AS rate_eligible, x.mind>=3e0 AS baseline_eligible, x.mind FROM targ t LEFT JOIN
(SELECT a.build_id, a.designation, min({sep('a.t_ra','a.t_dec','b.t_ra','b.t_dec')}) AS mind FROM tpos a JOIN tpos b
 ON a.build_id=b.build_id AND a.designation=b.designation AND a.frame_no<b.frame_no GROUP BY 1,2) x USING (build_id, designation)
""",
)
cte(
    "ftrace",
    f"""
SELECT p.*, n.det_no, n.dist, coalesce(n.dist<=2e0,false) AS detected, n.magnitude, c.det_no IS NOT NULL AS is_cand,
 p.v_magnitude + CASE f.filter_code WHEN 'zg' THEN 0.33e0 WHEN 'zr' THEN -0.22e0 ELSE -0.37e0 END AS expected, f.maglimit, l.depth
FROM tpos p JOIN frm f ON f.build_id=p.build_id AND f.frame_no=p.frame_no
LEFT JOIN (SELECT * FROM (SELECT p.build_id, p.designation, p.frame_no, d.det_no, d.dec, d.magnitude, {sep('d.ra','d.dec','p.t_ra','p.t_dec')} AS dist
  FROM tpos p JOIN det d ON d.build_id=p.build_id AND d.frame_no=p.frame_no AND {near('d.dec','p.t_dec','1e1')})
  WHERE dist<=1e1 QUALIFY row_number() OVER (PARTITION BY build_id, designation, frame_no ORDER BY dist, dec, det_no)=1) n
 ON n.build_id=p.build_id AND n.designation=p.designation AND n.frame_no=p.frame_no
LEFT JOIN cand c ON c.det_no=n.det_no
LEFT JOIN (SELECT p.build_id, p.designation, p.frame_no, CASE WHEN count(*)>=5 THEN median(d.magnitude+2.5e0*log10(d.snr/5e0)) END AS depth
  FROM tpos p JOIN det d ON d.build_id=p.build_id AND d.frame_no=p.frame_no AND {near('d.dec','p.t_dec','6e1')}
  WHERE d.snr BETWEEN 3e0 AND 2e1 AND {sep('d.ra','d.dec','p.t_ra','p.t_dec')}<=6e1 GROUP BY 1,2,3) l
 ON l.build_id=p.build_id AND l.designation=p.designation AND l.frame_no=p.frame_no
""",
)
cte(
    "srcs",
    "SELECT build_id, designation, count(*) AS n_frames, count(*) FILTER (detected) AS n_src, count(*) FILTER (detected AND is_cand) AS n_cand FROM ftrace GROUP BY 1,2",
)
cte(
    "shsrc",
    """
SELECT f.build_id, f.designation, m.tracklet_no, count(*) AS shared, any_value(s.n_frames) AS n_frames, any_value(s.n_src) AS n_src
FROM ftrace f JOIN mem m ON m.build_id=f.build_id AND m.det_no=f.det_no JOIN srcs s ON s.build_id=f.build_id AND s.designation=f.designation
WHERE f.detected GROUP BY 1,2,3
""",
)
cte(
    "ttrace",
    """
SELECT t.build_id, t.designation, t.role, s.n_src, s.n_cand, x.tracklet_no, coalesce(p.n,0) AS partial_tracklets,
 CASE WHEN s.n_src<s.n_frames THEN 'detection' WHEN s.n_cand<s.n_frames THEN 'stationary' WHEN x.tracklet_no IS NULL THEN 'association'
  WHEN x.status<>'built' THEN 'fit' WHEN NOT (x.istat='known' AND x.best=t.designation) THEN 'identification' END AS first_failure
FROM targ t JOIN srcs s USING (build_id, designation)
LEFT JOIN (SELECT a.build_id, a.designation, i.tracklet_no, i.status, i.istat, i.best FROM shsrc a JOIN ident i ON i.build_id=a.build_id AND i.tracklet_no=a.tracklet_no
  WHERE shared=n_src AND n_src=n_frames QUALIFY row_number() OVER (PARTITION BY a.build_id, a.designation ORDER BY i.status<>'built', i.tracklet_no)=1) x USING (build_id, designation)
LEFT JOIN (SELECT build_id, designation, count(*) AS n FROM shsrc WHERE NOT (shared=n_src AND n_src=n_frames) GROUP BY 1,2) p USING (build_id, designation)
""",
)


def targets(spark, sf):
    return cut_lineage(G.select_targets(data.ephemerides(spark, sf), data.metadata(spark, sf)))


def frame_traces(spark, sf, tgt):
    marked = T.mark_stationary(data.detections(spark, sf), 1.5)
    return cut_lineage(G.frame_traces(tgt, marked, data.metadata(spark, sf)))


@query(
    "select_targets",
    with_ctes(
        "SELECT build_id, designation, role, round(v_magnitude,4) AS v_magnitude, round(perr,4) AS position_error, round(prate,6) AS rate,"
        " round(pangle,4) AS angle, rate_eligible, baseline_eligible, round(mind,3) AS min_displacement FROM targ JOIN telig USING (build_id, designation)"
    ),
)
def select_targets(spark, sf):
    return G.with_eligibility(targets(spark, sf)).selectExpr(
        "build_id", "designation", "role", "round(v_magnitude,4) AS v_magnitude",
        "round(position_error_arcsec,4) AS position_error", "round(predicted_rate,6) AS rate",
        "round(predicted_angle,4) AS angle", "rate_eligible", "baseline_eligible",
        "round(min_pair_displacement_arcsec,3) AS min_displacement",
    )


@query(
    "frame_traces",
    with_ctes(
        "SELECT build_id, designation, frame_no, round(dist,4) AS nearest, detected, CASE WHEN detected THEN det_no END AS det_no,"
        " CASE WHEN detected THEN is_cand END AS candidate, round(expected,4) AS expected_mag, round(maglimit-expected,4) AS global_margin,"
        " round(depth,4) AS local_depth FROM ftrace"
    ),
)
def frame_trace_query(spark, sf):
    return frame_traces(spark, sf, targets(spark, sf)).selectExpr(
        "build_id", "designation", "frame_no", "round(nearest_arcsec,4) AS nearest", "detected", "det_no", "candidate",
        "round(expected_mag,4) AS expected_mag", "round(global_margin_mag,4) AS global_margin",
        "round(local_depth_mag,4) AS local_depth",
    )


@query(
    "frame_depths",
    with_ctes(
        "SELECT build_id, frame_no, CAST(count(*) AS BIGINT) AS sources, round(CASE WHEN count(*)>=5 THEN median(magnitude+2.5e0*log10(snr/5e0)) END,6) AS frame_depth_mag"
        " FROM det WHERE snr BETWEEN 3e0 AND 2e1 GROUP BY 1,2"
    ),
)
def frame_depths(spark, sf):
    return G.frame_depths(data.detections(spark, sf)).selectExpr(
        "build_id", "frame_no", "sources", "round(frame_depth_mag,6) AS frame_depth_mag"
    )


@query(
    "stationary_matches",
    with_ctes(
        f"""
SELECT build_id, designation, frame_no, kind AS stationary_match, round(s,4) AS arcsec FROM (SELECT a.build_id, a.designation, a.frame_no,
 CASE WHEN o.det_no IS NOT NULL THEN 'self' ELSE 'other' END AS kind, {sep('x.ra','x.dec','d.ra','d.dec')} AS s, d.frame_no AS fn, d.dec AS dd, d.det_no AS dn
FROM ftrace a JOIN det x ON x.det_no=a.det_no JOIN det d ON d.build_id=a.build_id AND d.frame_no<>a.frame_no AND {near('x.dec','d.dec','1.5e0')}
LEFT JOIN ftrace o ON o.build_id=a.build_id AND o.designation=a.designation AND o.frame_no=d.frame_no AND o.detected AND o.det_no=d.det_no
WHERE a.detected AND NOT a.is_cand AND {sep('x.ra','x.dec','d.ra','d.dec')}<=1.5e0)
QUALIFY row_number() OVER (PARTITION BY build_id, designation, frame_no ORDER BY kind<>'self', s, fn, dd, dn)=1
"""
    ),
)
def stationary_matches(spark, sf):
    traces = frame_traces(spark, sf, targets(spark, sf))
    return G.stationary_matches(traces, data.detections(spark, sf)).selectExpr(
        "build_id", "designation", "frame_no", "stationary_match", "round(stationary_match_arcsec,4) AS arcsec"
    )


@query(
    "target_traces",
    with_ctes(
        "SELECT build_id, designation, role, CAST(n_src AS BIGINT) AS detected_frames, CAST(n_cand AS BIGINT) AS candidate_frames,"
        " tracklet_no, CAST(partial_tracklets AS BIGINT) AS partial_tracklets, first_failure, first_failure IS NULL AS recovered FROM ttrace"
    ),
)
def target_traces(spark, sf):
    trk = tracklets(spark, sf)
    tgt = targets(spark, sf)
    traces = frame_traces(spark, sf, tgt)
    linked = G.source_tracklets(traces, T.tracklet_members(trk), identified(spark, sf, trk))
    return G.target_traces(tgt, traces, linked).select(
        "build_id", "designation", "role", "detected_frames", "candidate_frames", "tracklet_no",
        "partial_tracklets", "first_failure", "recovered",
    )


cte(
    "outc",
    """
SELECT t.build_id, t.designation, t.role, s.n_src, s.n_cand, b.tracklet_no, b.istat, coalesce(b.istat='known',false) AS recovered
FROM targ t LEFT JOIN srcs s USING (build_id, designation) LEFT JOIN (SELECT build_id, best AS designation, tracklet_no, istat FROM ident
 WHERE best IS NOT NULL QUALIFY row_number() OVER (PARTITION BY build_id, best ORDER BY status<>'built', best_mx, tracklet_no)=1) b USING (build_id, designation)
""",
)


@query(
    "target_outcomes",
    with_ctes(
        "SELECT build_id, designation, role, CAST(n_src AS BIGINT) AS detected_frames, CAST(n_cand AS BIGINT) AS candidate_frames, tracklet_no, istat AS identification_status, recovered FROM outc"
    ),
)
def target_outcomes(spark, sf):
    tgt = targets(spark, sf)
    return G.target_outcomes(tgt, frame_traces(spark, sf, tgt), identified(spark, sf)).select(
        "build_id", "designation", "role", "detected_frames", "candidate_frames", "tracklet_no",
        "identification_status", "recovered",
    )


@query(
    "field_counters",
    with_ctes(
        """
SELECT build_id, coalesce(tracklets,0) AS tracklets, coalesce(built,0) AS built, coalesce(known,0) AS known, coalesce(unknown,0) AS unknown,
 coalesce(ambiguous,0) AS ambiguous, coalesce(unknown_built,0) AS unknown_built, coalesce(primary_targets,0) AS primary_targets,
 coalesce(marginal_targets,0) AS marginal_targets, coalesce(primary_recovered,0) AS primary_recovered, coalesce(marginal_recovered,0) AS marginal_recovered
FROM (SELECT build_id, CAST(count(*) AS BIGINT) AS tracklets, CAST(count(*) FILTER (status='built') AS BIGINT) AS built,
 CAST(count(*) FILTER (istat='known') AS BIGINT) AS known, CAST(count(*) FILTER (istat='unknown') AS BIGINT) AS unknown,
 CAST(count(*) FILTER (istat='ambiguous') AS BIGINT) AS ambiguous, CAST(count(*) FILTER (istat='unknown' AND status='built') AS BIGINT) AS unknown_built
 FROM ident GROUP BY 1) a FULL JOIN
(SELECT build_id, CAST(count(*) FILTER (role='primary') AS BIGINT) AS primary_targets, CAST(count(*) FILTER (role='marginal') AS BIGINT) AS marginal_targets,
 CAST(count(*) FILTER (role='primary' AND recovered) AS BIGINT) AS primary_recovered, CAST(count(*) FILTER (role='marginal' AND recovered) AS BIGINT) AS marginal_recovered
 FROM outc GROUP BY 1) b USING (build_id)
"""
    ),
)
def field_counters(spark, sf):
    tgt, ids = targets(spark, sf), identified(spark, sf)
    out = G.field_counters(ids, G.target_outcomes(tgt, frame_traces(spark, sf, tgt), ids))
    return out.drop("control_targets", "control_recovered")


cte(
    "accept",
    f"""
SELECT t.build_id, t.designation, t.role, l.tracklet_no, l.mxs, l.velocity-t.prate AS dr, ((l.pa-t.pangle+180)%360+360)%360-180 AS da,
 l.status, l.istat, l.best FROM targ t LEFT JOIN (
 SELECT x.*, i.status, i.istat, i.best, i.velocity, i.pa FROM (SELECT build_id, designation, tracklet_no, count(*) AS n, max(s) AS mxs FROM (
   SELECT p.build_id, p.designation, m.tracklet_no, {sep('p.t_ra','p.t_dec','m.ra','m.dec')} AS s FROM tpos p JOIN memd m
   ON m.build_id=p.build_id AND m.frame_no=p.frame_no AND {near('m.dec','p.t_dec','2e0')}) WHERE s<=2e0 GROUP BY 1,2,3) x
 JOIN (SELECT build_id, tracklet_no, count(*) AS nm FROM mem GROUP BY 1,2) y USING (build_id, tracklet_no)
 JOIN ident i USING (build_id, tracklet_no) WHERE x.n=y.nm
 QUALIFY row_number() OVER (PARTITION BY build_id, designation ORDER BY i.status<>'built', mxs, tracklet_no)=1) l USING (build_id, designation)
""",
)
_LEVELS = """SELECT *, coalesce(status='built',false) AS geometric, coalesce(mxs<=1e0 AND abs(dr)<=2e-2 AND abs(da)<=2e0,false) AS astrometric,
 coalesce(istat='known' AND best=designation,false) AS identification FROM accept"""


@query(
    "acceptance_levels",
    with_ctes(
        f"""
SELECT build_id, designation, role, tracklet_no, round(mxs,4) AS max_residual, round(dr,5) AS rate_difference, geometric, astrometric, identification,
 CASE WHEN NOT geometric THEN 'geometric' WHEN NOT astrometric THEN 'astrometric' WHEN NOT identification THEN 'identification' END AS failed_level
FROM ({_LEVELS})
"""
    ),
)
def acceptance_levels(spark, sf):
    return accepted(spark, sf).selectExpr(
        "build_id", "designation", "role", "tracklet_no", "round(max_position_residual,4) AS max_residual",
        "round(rate_difference,5) AS rate_difference", "geometric", "astrometric", "identification", "failed_level",
    )


def accepted(spark, sf):
    ids = identified(spark, sf)
    return G.acceptance(targets(spark, sf), T.tracklet_members(ids), ids)


@query(
    "acceptance_verdict",
    with_ctes(
        f"""
SELECT role, CAST(count(*) AS BIGINT) AS targets, CAST(count(*) FILTER (geometric AND astrometric AND identification) AS BIGINT) AS passed_targets,
 CAST(count(*) FILTER (istat='known' AND best<>designation) AS BIGINT) AS misidentified_targets,
 CAST(count(*) FILTER (identification AND NOT astrometric) AS BIGINT) AS identified_but_astrometric_fail,
 count(*) FILTER (geometric AND astrometric AND identification)>=16 AND count(*) FILTER (istat='known' AND best<>designation)=0
  AND count(*) FILTER (identification AND NOT astrometric)=0 AS passed
FROM ({_LEVELS}) GROUP BY role
"""
    ),
)
def acceptance_verdict(spark, sf):
    return G.acceptance_verdict(accepted(spark, sf), ["role"])


@query(
    "tracklet_motion_features",
    with_ctes(
        """
SELECT i.build_id, i.tracklet_no, i.best AS best_designation, round(i.velocity-e.r,5) AS rate_difference,
 round(((i.pa-e.a+180)%360+360)%360-180,3) AS angle_difference FROM ident i LEFT JOIN
(SELECT build_id, designation, sqrt(pow(motion_ra,2)+pow(motion_dec,2))/6e1 AS r, ((degrees(atan2(motion_ra,motion_dec))%360)+360)%360 AS a
 FROM eph WHERE frame_no=0) e ON e.build_id=i.build_id AND e.designation=i.best
"""
    ),
)
def tracklet_motion_features(spark, sf):
    out = G.tracklet_motion_features(identified(spark, sf), data.ephemerides(spark, sf))
    return out.selectExpr(
        "build_id", "tracklet_no", "best_designation", "round(rate_difference,5) AS rate_difference",
        "round(angle_difference,3) AS angle_difference",
    )
