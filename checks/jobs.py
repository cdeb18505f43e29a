"""Whole jobs, rankers, triggers and scalar geometry."""

from pyspark.sql import functions as F

from checks import data
from checks.build import near, tracklets
from checks.metrics import FEATURES
from checks.registry import bearing, cte, query, sep, with_ctes
from checks.review import identified, quality
from checks.stars import field_stars
from checks.targets import targets
from driftline.config import DEFAULT
from driftline.functions.sky import display_pixel, motion_vector, predict
from driftline.operators import groups as N
from driftline.operators import metrics as M
from driftline.operators import rankers as A
from driftline.operators import sampling as P
from driftline.operators import targets as G
from driftline.operators import tracklets as T
from driftline.operators import triggers as X
from driftline.operators.celljoin import cell_join
from driftline.operators.ordered import cut_lineage
from driftline.plans import jobs as J

# --- scalar geometry ------------------------------------------------------------

cte("ser", "SELECT a.series, a.build_id, a.ra AS ra1, a.dec AS dec1, b.ra AS ra2, b.dec AS dec2, c.ra AS ra3, c.dec AS dec3 FROM det a JOIN det b ON b.det_no=a.det_no+1 AND b.frame_no=1 JOIN det c ON c.det_no=a.det_no+2 AND c.frame_no=2 WHERE a.frame_no=0")
_r = "radians(d12*2e0/3.6e3)"
_hd = f"({bearing('ra2','dec2','ra1','dec1')}+pi())"


@query(
    "motion_predictions",
    with_ctes(
        f"""
SELECT series, round(d12,4) AS separation, round(d12/3e1,5) AS rate, round(pred_ra,6) AS pred_ra, round(pred_dec,6) AS pred_dec FROM (
SELECT *, degrees(asin(sd)) AS pred_dec, ra2+degrees(atan2(sin(hd)*sin(rr)*cos(radians(dec2)),cos(rr)-sin(radians(dec2))*sd)) AS pred_ra FROM (
SELECT *, sin(radians(dec2))*cos(rr)+cos(radians(dec2))*sin(rr)*cos(hd) AS sd FROM (SELECT *, {_hd} AS hd, {_r} AS rr FROM (
SELECT *, {sep('ra1','dec1','ra2','dec2')} AS d12 FROM ser))))
"""
    ),
)
def motion_predictions(spark, sf):
    rows = data.detections(spark, sf).groupBy("series").agg(
        *[
            F.max(F.when(F.col("frame_no") == i, F.col(c))).alias(f"{c}{i + 1}")
            for i in range(3)
            for c in ("ra", "dec")
        ]
    ).where("ra3 IS NOT NULL")
    motion = motion_vector("ra1", "dec1", "ra2", "dec2", 30.0)
    ra, dec = predict("ra1", "dec1", "ra2", "dec2", 30.0, 60.0)
    return rows.selectExpr(
        "series", f"round({motion['separation_arcsec']},4) AS separation",
        f"round({motion['rate_arcsec_per_min']},5) AS rate", f"round({ra},6) AS pred_ra", f"round({dec},6) AS pred_dec",
    )


_GEO = dict(
    crval1=120.03, crval2=10.03, crpix1=150.0, crpix2=160.0, cd11=-2.8e-4, cd12=1e-6, cd21=1e-6, cd22=2.8e-4,
    width=300.0, height=320.0, transposed=False, flip_x=True, flip_y=False,
)
_dr = "radians(ra-120.03e0)"
_w = f"(sin(radians(10.03e0))*sin(radians(dec))+cos(radians(10.03e0))*cos(radians(dec))*cos({_dr}))"
_xi = f"degrees(cos(radians(dec))*sin({_dr})/{_w})"
_eta = f"degrees((cos(radians(10.03e0))*sin(radians(dec))-sin(radians(10.03e0))*cos(radians(dec))*cos({_dr}))/{_w})"
_det = "(-2.8e-4*2.8e-4-1e-6*1e-6)"
cte(
    "pix",
    f"SELECT *, 299e0-((2.8e-4*{_xi}-1e-6*{_eta})/{_det}+149e0) AS px, (-2.8e-4*{_eta}-1e-6*{_xi})/{_det}+159e0 AS py FROM det",
)


@query("display_pixels", with_ctes("SELECT det_no, round(px,3) AS px, round(py,3) AS py FROM pix"))
def display_pixels(spark, sf):
    x, y = display_pixel("ra", "dec", _GEO)
    return data.detections(spark, sf).selectExpr("det_no", f"round({x},3) AS px", f"round({y},3) AS py")


@query(
    "tracks_in_view",
    with_ctes(
        """
SELECT build_id, tracklet_no, CAST(row_number() OVER (PARTITION BY build_id ORDER BY status<>'built', cd, tracklet_no) AS BIGINT) AS view_order FROM (
SELECT m.build_id, m.tracklet_no, any_value(t.status) AS status, sqrt(pow(avg(px)-1.5e2,2)+pow(avg(py)-1.6e2,2)) AS cd FROM mem m JOIN pix p ON p.det_no=m.det_no
JOIN tracklet t ON t.build_id=m.build_id AND t.tracklet_no=m.tracklet_no GROUP BY 1,2
HAVING bool_and(px>=-0.5 AND py>=-0.5 AND px<=299.5 AND py<=319.5))
"""
    ),
)
def tracks_in_view(spark, sf):
    x, y = display_pixel("ra", "dec", _GEO)
    points = T.tracklet_members(tracklets(spark, sf)).selectExpr(
        "build_id", "tracklet_no", "status", f"{x} AS px", f"{y} AS py",
        "300D AS width", "320D AS height", "150D AS center_x", "160D AS center_y",
    )
    return P.in_view(points).select("build_id", "tracklet_no", "view_order")


@query(
    "detections_near_predictions",
    with_ctes(
        f"""
SELECT designation, build_id, frame_no, det_no, round(s,4) AS distance, CAST(row_number() OVER (PARTITION BY designation, build_id, frame_no ORDER BY s, det_no) AS INT) AS nearness
FROM (SELECT e.designation, d.build_id, d.frame_no, d.det_no, {sep('d.ra','d.dec','e.predicted_ra','e.predicted_dec')} AS s FROM eph e JOIN det d
 ON d.build_id=e.build_id AND d.frame_no=e.frame_no AND {near('d.dec','e.predicted_dec','5e0')}) WHERE s<=5e0
"""
    ),
)
def detections_near_predictions(spark, sf):
    wanted = data.ephemerides(spark, sf).selectExpr(
        "designation", "build_id", "frame_no", "predicted_ra AS p_ra", "predicted_dec AS p_dec"
    )
    dets = data.detections(spark, sf).select("build_id", "frame_no", "det_no", "ra", "dec")
    return G.detections_near(wanted, dets, ["designation"], 5.0).selectExpr(
        "designation", "build_id", "frame_no", "det_no", "round(distance,4) AS distance", "nearness"
    )


# --- populations and labels --------------------------------------------------------


def records(spark, sf):
    trk = tracklets(spark, sf)
    ids = identified(spark, sf, trk)
    result = J.Run(trk, ids, quality(spark, sf, trk), None, None)
    return trk, cut_lineage(J.quality_records(result, targets(spark, sf)))


cte(
    "rec",
    """
SELECT i.build_id, i.tracklet_no, i.status, i.istat, i.best, t.role, CASE WHEN istat IN ('unknown','ambiguous') THEN istat WHEN t.role='primary' THEN 'validation_target'
 WHEN t.role='control' THEN 'control' ELSE 'other_known' END AS population, q.* EXCLUDE (build_id, tracklet_no), i.rms
FROM ident i JOIN qual q USING (build_id, tracklet_no) LEFT JOIN targ t ON t.build_id=i.build_id AND t.designation=i.best
""",
)


@query(
    "population_summaries",
    with_ctes(
        " UNION ALL ".join(
            f"""SELECT population, '{f}' AS feature, CAST(count({e}) AS BIGINT) AS count, CAST(count(*)-count({e}) AS BIGINT) AS missing,
 round(min({e}),5) AS min, round(quantile_cont({e},0.1),5) AS p10, round(median({e}),5) AS median, round(quantile_cont({e},0.9),5) AS p90, round(max({e}),5) AS max FROM rec GROUP BY population"""
            for f, e in (("min_snr", "min_snr"), ("sharp_max", "CASE WHEN complete THEN smax END"), ("fit_rms_residual_arcsec", "rms"))
        ).replace("round(", "round(", 1)
    ),
)
def population_summaries(spark, sf):
    _, rows = records(spark, sf)
    out = J.population_summaries(rows, ["population"], ("min_snr", "sharp_max", "fit_rms_residual_arcsec"))
    return out.selectExpr(
        "population", "feature", "count", "missing", *[f"round({c},5) AS {c}" for c in ("min", "p10", "median", "p90", "max")]
    )


@query(
    "population_histograms",
    with_ctes(
        """
SELECT population, item, CAST(count(*) AS BIGINT) AS tracklets FROM (SELECT population, unnest(['detections=' || detection_count, 'flagged=' || flagged_detection_count,
 'edge=' || edge_detection_count, 'sharp=' || CASE WHEN complete THEN 'complete' ELSE 'partial' END]) AS item FROM rec
UNION ALL SELECT population, 'bit=' || b FROM rec, range(32) r(b) WHERE (mask_bits_union>>b)&1=1) GROUP BY 1,2
"""
    ),
)
def population_histograms(spark, sf):
    _, rows = records(spark, sf)
    return J.population_histograms(rows, ["population"])


cte(
    "lab",
    """
SELECT r.*, CASE WHEN status<>'built' THEN 'not_ranked' WHEN istat='unknown' THEN 'background' WHEN istat='known' AND e.designation IS NOT NULL THEN 'positive'
 ELSE 'auxiliary' END AS label FROM rec r LEFT JOIN telig e ON e.build_id=r.build_id AND e.designation=r.best AND e.rate_eligible AND e.baseline_eligible
""",
)


@query(
    "labelled_tracklets",
    with_ctes(
        """
SELECT l.build_id, l.tracklet_no, l.label, l.label='background' AND EXISTS (SELECT 1 FROM mem a JOIN mem b ON b.det_no=a.det_no JOIN lab p ON p.build_id=b.build_id AND p.tracklet_no=b.tracklet_no
 WHERE a.build_id=l.build_id AND a.tracklet_no=l.tracklet_no AND p.label='positive') AS shares_detection_with_positive FROM lab l
"""
    ),
)
def labelled_tracklets(spark, sf):
    trk, rows = records(spark, sf)
    eligible = G.with_eligibility(targets(spark, sf)).where("rate_eligible AND baseline_eligible")
    labelled = cut_lineage(J.labelled_rows(rows, eligible))
    return J.shares_with_positive(labelled, T.tracklet_members(trk)).select(
        "build_id", "tracklet_no", "label", "shares_detection_with_positive"
    )


@query(
    "presets",
    with_ctes(
        f"""
SELECT m.build_id, m.designation, round(cra,6) AS center_ra, round(cdec,6) AS center_dec, greatest(6e1, 1e1*ceil((2*max({sep('cra','cdec','t_ra','t_dec')})+6e1)/1e1)) AS size_arcsec,
 string_agg(CAST(m.build_id*10+frame_no AS VARCHAR), ',' ORDER BY frame_no) AS products
FROM (SELECT *, (degrees(atan2(y,x))%360+360)%360 AS cra, degrees(atan2(z,sqrt(x*x+y*y))) AS cdec FROM (SELECT p.build_id, p.designation, sum(cos(radians(t_dec))*cos(radians(t_ra))) AS x,
 sum(cos(radians(t_dec))*sin(radians(t_ra))) AS y, sum(sin(radians(t_dec))) AS z FROM tpos p JOIN targ t USING (build_id, designation) WHERE t.role='primary' GROUP BY 1,2)) m
JOIN tpos p ON p.build_id=m.build_id AND p.designation=m.designation GROUP BY 1,2,3,4
"""
    ),
)
def presets(spark, sf):
    return J.presets(targets(spark, sf), data.frames(spark, sf)).selectExpr(
        "build_id", "designation", "round(center_ra,6) AS center_ra", "round(center_dec,6) AS center_dec", "size_arcsec",
        "array_join(transform(product_ids, p -> CAST(p AS STRING)), ',') AS products",
    )


@query(
    "field_conditions",
    with_ctes(
        """
SELECT f.build_id, string_agg(filter_code, ',' ORDER BY f.frame_no) AS filters, string_agg(CAST(coalesce(n,0) AS VARCHAR), ',' ORDER BY f.frame_no) AS sources
FROM frm f LEFT JOIN (SELECT build_id, frame_no, count(*) AS n FROM det GROUP BY 1,2) c ON c.build_id=f.build_id AND c.frame_no=f.frame_no GROUP BY 1
"""
    ),
)
def field_conditions(spark, sf):
    out = J.conditions(data.detections(spark, sf), data.frames(spark, sf))
    return out.selectExpr(
        "build_id", "array_join(filters, ',') AS filters",
        "array_join(transform(sources_per_frame, s -> CAST(s AS STRING)), ',') AS sources",
    )


# --- rankers -------------------------------------------------------------------------


def table(spark, sf):
    carry = ["grp", "night", "tracklet_id", "designation", "label", "role", "proximity_group"]
    return A.percentile_table(data.scored(spark, sf), FEATURES, carry)


cte(
    "ptab",
    "SELECT field_id, tracklet_no, tracklet_id, label, night, designation, role, "
    + ", ".join(
        f"CASE WHEN {n} IS NULL THEN 0e0 ELSE (rank() OVER (PARTITION BY field_id ORDER BY {d}*{n} NULLS LAST)-1 + 5e-1*count(*) OVER (PARTITION BY field_id, {n}))"
        f"/count({n}) OVER (PARTITION BY field_id) END AS {n}"
        for n, d in FEATURES
    )
    + " FROM scored",
)


_HASH = f"CAST(CAST('0x' || substr(sha256('{M.METRIC_SALT}:' || field_id || ':' || tracklet_id),1,15) AS UBIGINT) AS DOUBLE)/{16.0**15!r}"


@query(
    "ranker_scores",
    with_ctes(
        " UNION ALL ".join(
            [f"SELECT field_id, tracklet_no, 'B1:{n}' AS ranker, round({n},9) AS score FROM ptab" for n, _ in FEATURES]
            + ["SELECT field_id, tracklet_no, 'M1', round((quantity+price+discount+tax)/4,9) FROM ptab"]
            + [f"SELECT field_id, tracklet_no, 'B0', round({_HASH},9) FROM ptab"]
        )
    ),
)
def ranker_scores(spark, sf):
    out = A.fixed_scores(table(spark, sf), FEATURES)
    return out.selectExpr("field_id", "tracklet_no", "ranker", "round(score,9) AS score")


@query(
    "training_weights",
    with_ctes(
        "SELECT field_id, label, round(sum(w),9) AS total FROM (SELECT field_id, label, 1e0/count(*) OVER (PARTITION BY field_id) AS w FROM scored WHERE label IN ('positive','background')) GROUP BY 1,2"
    ),
)
def training_weights(spark, sf):
    return A.training_set(data.scored(spark, sf)).groupBy("field_id", "label").agg(
        F.round(F.sum("sample_weight"), 9).alias("total")
    )


@query(
    "score_equivalence",
    with_ctes(
        """
SELECT field_id, CAST(count(*) AS BIGINT) AS tracklets, bool_and(s1 IS NOT DISTINCT FROM s2) AS scores_equal,
 bool_and(r1 IS NOT DISTINCT FROM r2) AS order_equal, round(max(abs(s1-s2)),9) AS max_difference,
 CAST(count(*) FILTER (s1 IS NULL OR s2 IS NULL) AS BIGINT) AS unmatched FROM
(SELECT field_id, tracklet_no, s1, row_number() OVER (PARTITION BY field_id ORDER BY s1 DESC, tracklet_no) AS r1 FROM
 (SELECT field_id, tracklet_no, round((quantity+price+discount+tax)/4,6) AS s1 FROM ptab)) a FULL JOIN
(SELECT field_id, tracklet_no, s2, row_number() OVER (PARTITION BY field_id ORDER BY s2 DESC, tracklet_no) AS r2 FROM
 (SELECT field_id, tracklet_no, round((quantity+price+discount+tax)/4,6)+CASE WHEN mod(tracklet_no,997)=0 THEN 1e-2 ELSE 0e0 END AS s2
  FROM ptab WHERE mod(tracklet_no,991)<>5)) b USING (field_id, tracklet_no) GROUP BY 1
"""
    ),
)
def score_equivalence(spark, sf):
    """A second list with planted differences: some scores are higher, some
    tracklets are missing; fields without either must compare as equal."""
    from driftline.operators.ordered import row_numbers

    t = table(spark, sf)
    a = A.fixed_scores(t, FEATURES).where("ranker = 'M1'")
    b = A.frozen_scores(t, {n: 0.25 for n, _ in FEATURES}, 0.0, "frozen").where("mod(tracklet_no, 991) <> 5")
    planted = "if(mod(tracklet_no, 997) = 0, 1e-2D, 0D)"
    order = [F.col("score").desc(), F.col("tracklet_no")]
    ranked = [
        row_numbers(x.selectExpr("field_id", "tracklet_no", f"round(score, 6) + {add} AS score"), ["field_id"], order, "review_rank")
        for x, add in ((a, "0D"), (b, planted))
    ]
    return A.compare_scores(*ranked).withColumn("max_difference", F.round("max_difference", 9))


cte(
    "kscored",
    " UNION ALL ".join(
        f"SELECT '{ranker}' AS ranker, field_id, tracklet_no, night, designation, label, {score} AS score FROM ptab"
        for ranker, score in [
            ("B0", _HASH), *[(f"B1:{n}", n) for n, _ in FEATURES], ("M1", "(quantity+price+discount+tax)/4"),
        ]
    ),
)
cte(
    "kpos",
    """
SELECT b.*, 1e0/count(*) OVER (PARTITION BY ranker, designation, night) AS weight FROM (
SELECT s.*, CASE WHEN c.n=0 THEN 0e0 ELSE (c.above+5e-1*c.tied)/c.n END AS q, 1+c.above+5e-1*c.tied AS place FROM (
  SELECT * FROM kscored WHERE label='positive' QUALIFY row_number() OVER (PARTITION BY ranker, field_id, designation ORDER BY score DESC, tracklet_no)=1) s
 JOIN (SELECT ranker, field_id, score, tied, sum(tied) OVER (PARTITION BY ranker, field_id) AS n,
   coalesce(sum(tied) OVER (PARTITION BY ranker, field_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS above
   FROM (SELECT ranker, field_id, score, count(*) FILTER (label='background') AS tied FROM kscored GROUP BY 1,2,3)) c
 ON c.ranker=s.ranker AND c.field_id=s.field_id AND c.score=s.score) b
""",
)


def _share(hit: str) -> str:
    return f"coalesce(sum(weight) FILTER ({hit}),0)/sum(weight)"


_FRACTIONS = (M.PRIMARY_FRACTION, *M.SECONDARY_FRACTIONS)


@query(
    "ranker_evaluation",
    with_ctes(
        "SELECT ranker, round(sum(weight),6) AS objects, count(DISTINCT field_id) AS fields_with_positive,"
        " round(sum(weight*(1-q))/sum(weight),9) AS auc, "
        + ", ".join(f"round({_share(f'q<={f!r}')},9) AS recall_{f:g}".replace("recall_0.", "recall_0_") for f in _FRACTIONS)
        + ", "
        + ", ".join(f"round({_share(f'q<={f!r}')}/{f!r},6) AS enrichment_{f:g}".replace("enrichment_0.", "enrichment_0_") for f in _FRACTIONS)
        + ", "
        + ", ".join(f"round({_share(f'place<={k}')},9) AS recall_k{k}" for k in M.SECONDARY_BUDGETS)
        + " FROM kpos GROUP BY ranker"
    ),
)
def ranker_evaluation(spark, sf):
    scored = A.fixed_scores(table(spark, sf), FEATURES)
    out = M.recall_metrics(M.rank_positives(scored, ["ranker"]), ["ranker"])
    digits = lambda c: 6 if c == "objects" or c.startswith("enrichment") else 9
    return out.selectExpr(
        "ranker", "fields_with_positive",
        *[f"round({c},{digits(c)}) AS {c}" for c in out.columns if c not in ("ranker", "fields_with_positive")],
    )


@query("logistic_cross_validation")
def logistic_cross_validation(spark, sf):
    t = table(spark, sf)
    folds = N.fold_of_groups(t.select("grp"))
    scored = A.cross_validated(t, [n for n, _ in FEATURES], folds)
    return M.recall_metrics(M.rank_positives(scored, ["ranker"]), ["ranker"])


# --- triggers -------------------------------------------------------------------------


def passages(spark, sf):
    """Objects of the middle frame within the cone around each field star."""
    middle = data.ephemerides(spark, sf).where("frame_no = 1").drop("frame_no", "product_id")
    middle = middle.withColumnRenamed("build_id", "field_id")
    stars = field_stars(spark, sf).where("v_mag < 8").selectExpr(
        "field_id", "star_id", "star_ra", "star_dec", "if(v_mag < 6, 0, 1) AS search_class"
    )
    pairs = cell_join(
        middle, stars, 300.0, on=["field_id"], left_pos=("predicted_ra", "predicted_dec"), right_pos=("star_ra", "star_dec"),
        cell_factor=1.0,
    )
    depth = data.frames(spark, sf).groupBy(F.col("build_id").alias("field_id")).agg(F.min("maglimit").alias("min_maglimit"))
    return pairs.drop("separation").join(depth, "field_id").selectExpr("*", "array(-30D, 0D, 30D) AS offsets")


def _at(m):
    return (
        f"(predicted_ra+motion_ra*({m})/6e1/3.6e3/cos(radians(predicted_dec)))",
        f"(predicted_dec+motion_dec*({m})/6e1/3.6e3)",
    )


_p = [_at(m) for m in ("-3e1", "0e0", "3e1")]
cte(
    "trig",
    f"""
SELECT * FROM (SELECT e.*, s.star_id, CASE WHEN s.v_mag<6 THEN 0 ELSE 1 END AS search_class, m.mm, sqrt(pow(motion_ra,2)+pow(motion_dec,2))/6e1 AS rate,
 least({','.join(sep(a, d, 's.star_ra', 's.star_dec') for a, d in _p)}) AS closest,
 least({sep(*_p[0], *_p[1])},{sep(*_p[0], *_p[2])},{sep(*_p[1], *_p[2])}) AS mind
FROM eph e JOIN fstar s ON s.field_id=e.build_id AND s.v_mag<8 AND {near('e.predicted_dec','s.star_dec','3e2')} AND {sep('e.predicted_ra','e.predicted_dec','s.star_ra','s.star_dec')}<=3e2
JOIN (SELECT build_id, min(maglimit) AS mm FROM frm GROUP BY 1) m ON m.build_id=e.build_id WHERE e.frame_no=1)
WHERE v_magnitude<=mm+5e-1 AND position_error_arcsec<=1e0 AND rate<=1e0 AND mind>=3e0 AND closest<1.2e2
""",
)


@query(
    "trigger_objects",
    with_ctes(
        "SELECT build_id AS field_id, star_id, designation, round(rate,4) AS rate, round(closest,2) AS closest, v_magnitude<=mm-5e-1 AS is_primary FROM trig"
    ),
)
def trigger_objects(spark, sf):
    return X.trigger_objects(passages(spark, sf)).selectExpr(
        "field_id", "star_id", "designation", "round(rate,4) AS rate", "round(closest_approach,2) AS closest", "is_primary"
    )


@query(
    "zone_triggers",
    with_ctes(
        "SELECT build_id AS field_id, star_id, designation FROM trig WHERE v_magnitude<=mm-5e-1 AND closest < CASE search_class WHEN 0 THEN 120 ELSE 60 END"
    ),
)
def zone_triggers(spark, sf):
    return X.zone_triggers(X.trigger_objects(passages(spark, sf))).select("field_id", "star_id", "designation")


@query("select_nights")
def select_nights(spark, sf):
    """Orders as (star, night) candidates with 0 to 2 triggers."""
    rows = data.read(spark, sf, "orders").selectExpr(
        "CAST(mod(o_custkey,2) AS INT) AS search_class", "concat('S', o_custkey) AS star_id",
        "1 + o_custkey div 2 AS star_no", "mod(o_orderkey,20) AS night_index", "mod(o_orderkey,997) AS night_key",
        "greatest(0, mod(o_orderkey,7)-4) AS triggers",
    ).groupBy("search_class", "star_id", "star_no", "night_index").agg(
        F.min("night_key").alias("night_key"), F.max("triggers").alias("triggers")
    )
    return X.select_nights(rows, X.CONFIRMATORY)


