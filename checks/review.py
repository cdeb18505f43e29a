"""Identification, quality features and review ranking."""

from pyspark.sql import functions as F

from checks import data
from checks.build import tracklets
from checks.registry import cte, query, sep, with_ctes
from driftline.operators import identify as I
from driftline.operators import quality as Q
from driftline.operators import ranking as R
from driftline.operators import tracklets as T


cte("memd", "SELECT m.build_id, m.tracklet_no, d.* EXCLUDE (build_id) FROM mem m JOIN det d ON d.det_no=m.det_no")


def matches_sql(radius: str) -> str:
    """Objects within ``radius`` arcsec of every member."""
    return f"""
SELECT * FROM (SELECT m.build_id, m.tracklet_no, e.designation,
 arg_min(e.object_class, m.frame_no) AS object_class, max(e.position_error_arcsec) AS position_error_arcsec,
 count(*) AS n, sqrt(avg(pow(residual,2))) AS rms, max(residual) AS mx
FROM (SELECT m.*, e.designation, e.object_class, e.position_error_arcsec,
  {sep('m.ra','m.dec','e.predicted_ra','e.predicted_dec')} AS residual
  FROM memd m JOIN ephlast e ON m.build_id=e.build_id AND m.frame_no=e.frame_no
  AND abs(m.dec-e.predicted_dec)<={radius}*3e-4) m
 JOIN (SELECT DISTINCT build_id, frame_no, designation, object_class, position_error_arcsec FROM ephlast) e
 ON e.build_id=m.build_id AND e.frame_no=m.frame_no AND e.designation=m.designation
WHERE residual <= {radius} GROUP BY m.build_id, m.tracklet_no, e.designation) x
JOIN (SELECT build_id, tracklet_no, count(*) AS nm FROM mem GROUP BY 1,2) y USING (build_id, tracklet_no)
WHERE n = nm
"""


def ident_sql(matches: str, radius: str) -> str:
    return f"""
SELECT t.*, coalesce(k.n_matches,0) AS n_matches, k.best, k.best_mx, k.best_rms,
 CASE WHEN k.n_matches IS NULL THEN 'unknown' WHEN k.n_matches>1 OR k.perr>{radius} THEN 'ambiguous' ELSE 'known' END AS istat
FROM tracklet t LEFT JOIN (SELECT build_id, tracklet_no, count(*) AS n_matches,
 arg_min(designation, (mx, rms, designation)) AS best, min(mx) AS best_mx,
 arg_min(rms, (mx, rms, designation)) AS best_rms,
 arg_min(position_error_arcsec, (mx, rms, designation)) AS perr
 FROM {matches} GROUP BY 1,2) k USING (build_id, tracklet_no)
"""


cte("matches", matches_sql("2e0"))
cte("ident", ident_sql("matches", "2e0"))
cte(
    "qual",
    """
SELECT build_id, tracklet_no, count(*) AS detection_count, min(snr) AS min_snr, median(snr) AS median_snr,
 max(magnitude)-min(magnitude) AS magnitude_range_mag,
 sqrt(pow(arg_min(magnitude_error,(magnitude,frame_no)),2)+pow(arg_max(magnitude_error,(magnitude,-frame_no)),2)) AS rerr,
 count(*) FILTER (on_image_edge) AS edge_detection_count, count(*) FILTER (mask_bits<>0) AS masked_detection_count,
 count(*) FILTER (on_image_edge OR mask_bits<>0) AS flagged_detection_count, bit_or(mask_bits) AS mask_bits_union,
 bit_and(mask_bits) AS mask_bits_common, count(sharp)=count(*) AS complete,
 min(sharp) AS smin, max(sharp) AS smax, max(abs(sharp)) AS sabs
FROM memd GROUP BY 1,2
""",
)
cte(
    "chi2",
    """
SELECT m.build_id, m.tracklet_no, sum(pow(magnitude-wm,2)/pow(magnitude_error,2)) AS chi2 FROM memd m JOIN
(SELECT build_id, tracklet_no, sum(magnitude/pow(magnitude_error,2))/sum(1/pow(magnitude_error,2)) AS wm FROM memd GROUP BY 1,2) w
 ON m.build_id=w.build_id AND m.tracklet_no=w.tracklet_no GROUP BY 1,2
""",
)
cte(
    "shr",
    """
SELECT t.build_id, t.tracklet_no, count(DISTINCT o.tracklet_no) AS shared
FROM tracklet t LEFT JOIN mem a ON a.build_id=t.build_id AND a.tracklet_no=t.tracklet_no
LEFT JOIN (SELECT m.* FROM mem m JOIN tracklet u USING (build_id, tracklet_no) WHERE u.status='built') o
 ON o.build_id=a.build_id AND o.det_no=a.det_no AND o.tracklet_no<>a.tracklet_no
WHERE t.status='built' GROUP BY 1,2
""",
)
cte(
    "feats",
    """
SELECT t.build_id, t.tracklet_no, round(min_snr,6) AS min_snr, round(median_snr,6) AS median_snr,
 round(rms,6) AS fit_rms_residual_arcsec, round(magnitude_range_mag,6) AS magnitude_range_mag,
 flagged_detection_count, masked_detection_count, CASE WHEN complete THEN round(sabs,6) END AS sharp_abs_max,
 shared AS shared_detection_tracklets, complete
FROM tracklet t JOIN qual q USING (build_id, tracklet_no) JOIN shr s USING (build_id, tracklet_no) WHERE t.status='built'
""",
)
cte(
    "evid",
    " UNION ALL ".join(
        f"""
SELECT build_id, tracklet_no, '{n}' AS feature, CAST({n} AS DOUBLE) AS value,
 CASE WHEN {n} IS NULL THEN NULL ELSE
 (rank() OVER (PARTITION BY build_id ORDER BY {d}*{n} NULLS LAST) - 1
  + 5e-1*count(*) OVER (PARTITION BY build_id, {n}))/count({n}) OVER (PARTITION BY build_id) END AS percentile
FROM feats"""
        for n, d in R.REVIEW_INPUTS
    ),
)
cte(
    "rscore",
    "SELECT build_id, tracklet_no, 0e0"
    + "".join(
        f"+1.25e-1*coalesce(max(percentile) FILTER (feature='{n}'),0e0)" for n, _ in R.REVIEW_INPUTS
    )
    + " AS score FROM evid GROUP BY 1,2",
)


def identified(spark, sf, trk=None):
    trk = tracklets(spark, sf) if trk is None else trk
    # Fields exist for all frames, also for those without a single object.
    members = I.require_fields(T.tracklet_members(trk), data.frames(spark, sf))
    return I.identify(trk, I.candidate_matches(members, data.listings(spark, sf)))


def quality(spark, sf, trk):
    return Q.quality_features(Q.members_with_detections(trk, data.detections(spark, sf)))


def features(spark, sf, trk):
    return R.review_features(trk, quality(spark, sf, trk), Q.shared_detection_counts(trk))


@query(
    "known_object_matches",
    with_ctes(
        "SELECT build_id, tracklet_no, designation, object_class, round(position_error_arcsec,4) AS position_error,"
        " round(rms,4) AS rms, round(mx,4) AS max_residual, CAST(n AS BIGINT) AS residuals FROM matches"
    ),
)
def known_object_matches(spark, sf):
    trk = tracklets(spark, sf)
    m = I.candidate_matches(T.tracklet_members(trk), data.listings(spark, sf))
    return m.selectExpr(
        "build_id", "tracklet_no", "designation", "object_class",
        "round(position_error_arcsec,4) AS position_error", "round(rms_residual_arcsec,4) AS rms",
        "round(max_residual_arcsec,4) AS max_residual", "CAST(size(residuals) AS BIGINT) AS residuals",
    )


@query(
    "identify_tracklets",
    with_ctes(
        "SELECT build_id, tracklet_no, status, istat AS identification_status, CAST(n_matches AS BIGINT) AS n_matches,"
        " best AS best_designation, round(best_mx,4) AS best_max FROM ident"
    ),
)
def identify_tracklets(spark, sf):
    return identified(spark, sf).selectExpr(
        "build_id", "tracklet_no", "status", "identification_status", "n_matches",
        "best_designation", "round(best_max_residual_arcsec,4) AS best_max",
    )


@query(
    "identification_counts",
    with_ctes(
        "SELECT build_id, CAST(count(*) AS BIGINT) AS tracklet_count,"
        + ",".join(
            f" CAST(count(*) FILTER (istat='{s}') AS BIGINT) AS {s}_count" for s in ("known", "unknown", "ambiguous")
        )
        + " FROM ident GROUP BY build_id"
    ),
)
def identification_counts(spark, sf):
    return I.identification_counts(identified(spark, sf))


@query(
    "objects_per_frame",
    with_ctes(
        "SELECT f.build_id, f.frame_no, CAST(count(DISTINCT e.designation) AS BIGINT) AS known_objects"
        " FROM frm f LEFT JOIN ephl e ON e.build_id=f.build_id AND e.frame_no=f.frame_no GROUP BY 1,2"
    ),
)
def objects_per_frame(spark, sf):
    return I.objects_per_frame(data.frames(spark, sf), data.listings(spark, sf))


@query(
    "quality_features",
    with_ctes(
        """
SELECT q.build_id, q.tracklet_no, CAST(detection_count AS BIGINT) AS detection_count, round(min_snr,6) AS min_snr,
 round(median_snr,6) AS median_snr, round(magnitude_range_mag,6) AS magnitude_range,
 round(magnitude_range_mag/rerr,4) AS magnitude_range_sigma, round(c.chi2,4) AS magnitude_chi2,
 CAST(edge_detection_count AS BIGINT) AS edge, CAST(masked_detection_count AS BIGINT) AS masked,
 CAST(flagged_detection_count AS BIGINT) AS flagged, CAST(mask_bits_union AS BIGINT) AS mask_bits_union,
 CASE WHEN complete THEN 'complete' ELSE 'partial' END AS sharp_availability,
 CASE WHEN complete THEN smin END AS sharp_min, CASE WHEN complete THEN smax END AS sharp_max,
 CASE WHEN complete THEN sabs END AS sharp_abs_max
FROM qual q JOIN chi2 c USING (build_id, tracklet_no)
"""
    ),
)
def quality_features(spark, sf):
    return quality(spark, sf, tracklets(spark, sf)).selectExpr(
        "build_id", "tracklet_no", "detection_count", "round(min_snr,6) AS min_snr",
        "round(median_snr,6) AS median_snr", "round(magnitude_range_mag,6) AS magnitude_range",
        "round(magnitude_range_sigma,4) AS magnitude_range_sigma", "round(magnitude_chi2,4) AS magnitude_chi2",
        "edge_detection_count AS edge", "masked_detection_count AS masked", "flagged_detection_count AS flagged",
        "CAST(mask_bits_union AS BIGINT) AS mask_bits_union", "sharp_availability", "sharp_min", "sharp_max",
        "sharp_abs_max",
    )


@query(
    "shared_detections",
    with_ctes("SELECT build_id, tracklet_no, CAST(shared AS BIGINT) AS shared_detection_tracklets FROM shr"),
)
def shared_detections(spark, sf):
    return Q.shared_detection_counts(tracklets(spark, sf))


@query(
    "review_evidence",
    with_ctes(
        "SELECT build_id, tracklet_no, feature, value, round(percentile,9) AS percentile FROM evid"
    ),
)
def review_evidence(spark, sf):
    _, evidence = R.review_scores(features(spark, sf, tracklets(spark, sf)))
    return evidence.selectExpr(
        "build_id", "tracklet_no", "feature", "value", "round(percentile,9) AS percentile"
    )


@query(
    "review_ranking",
    with_ctes(
        """
SELECT t.build_id, t.tracklet_no, t.status, round(s.score,9) AS score,
 CASE WHEN s.score IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY t.build_id ORDER BY s.score DESC NULLS LAST, t.tracklet_no) AS BIGINT) END AS review_rank
FROM tracklet t LEFT JOIN rscore s USING (build_id, tracklet_no)
"""
    ),
)
def review_ranking(spark, sf):
    trk = tracklets(spark, sf)
    return R.review_ranking(trk, features(spark, sf, trk)).selectExpr(
        "build_id", "tracklet_no", "status", "round(score,9) AS score", "review_rank"
    )


@query(
    "domain_notes",
    with_ctes(
        """
SELECT f.build_id, concat_ws('|', CASE WHEN n<>3 THEN n || ' frames; validated on 3-exposure sequences' END,
 CASE WHEN m>0 THEN m || ' built tracklet(s) without a complete raw sharp: sharp_abs_max counts as percentile 0' END) AS notes
FROM (SELECT build_id, count(*) AS n FROM frm GROUP BY 1) f
LEFT JOIN (SELECT build_id, count(*) FILTER (NOT complete) AS m FROM feats GROUP BY 1) x USING (build_id)
"""
    ),
)
def domain_notes(spark, sf):
    trk = tracklets(spark, sf)
    notes = R.domain_notes(data.frames(spark, sf), features(spark, sf, trk))
    return notes.select("build_id", F.array_join("notes", "|").alias("notes"))


@query(
    "detections_per_bit",
    with_ctes(
        "SELECT build_id, frame_no, CAST(b AS INT) AS bit, CAST(count(*) AS BIGINT) AS detections FROM det,"
        " range(0,32) r(b) WHERE (mask_bits >> b) & 1 = 1 GROUP BY 1,2,3"
    ),
)
def detections_per_bit(spark, sf):
    return Q.detections_per_bit(data.detections(spark, sf), ["build_id", "frame_no"])


@query(
    "covering_cones",
    with_ctes(
        f"""
WITH c AS (SELECT build_id, (degrees(atan2(y,x))%360+360)%360 AS cra, degrees(atan2(z,sqrt(x*x+y*y))) AS cdec FROM
(SELECT build_id, avg(cos(radians(dec))*cos(radians(ra))) AS x, avg(cos(radians(dec))*sin(radians(ra))) AS y,
 avg(sin(radians(dec))) AS z FROM det GROUP BY 1))
SELECT build_id, round(cra,6) AS center_ra, round(cdec,6) AS center_dec,
 round((max({sep('d.ra','d.dec','cra','cdec')})+2e0)/3.6e3,7) AS radius_deg
FROM det d JOIN c USING (build_id) GROUP BY 1,2,3
""".replace("WITH c AS", "SELECT * FROM (WITH c AS")
        + ")"
    ),
)
def covering_cones(spark, sf):
    return I.covering_cone(data.detections(spark, sf), ["build_id"], 2.0).selectExpr(
        "build_id", "round(center_ra,6) AS center_ra", "round(center_dec,6) AS center_dec",
        "round(radius_deg,7) AS radius_deg",
    )
