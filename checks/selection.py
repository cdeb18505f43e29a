"""Sampling, sequences, independence groups and sources."""

from pyspark.sql import functions as F

from checks import data
from checks.registry import cte, query, with_ctes
from checks.stars import contexts
from driftline.operators import groups as N
from driftline.operators import sampling as P
from driftline.operators import sequences as Q
from driftline.sources import bundles as B
from driftline.sources import catalogs as K

# --- orders become exposures: a quadrant-night per (customer, day) --------------

_EXPOSURE = {
    "pid": "o_orderkey",
    "obsjd": "2458000e0 + mod(o_orderkey*7,{days}) + mod(o_orderkey*37,400)/1.44e3",
    "day": "mod(o_orderkey*7,{days})",
    "field": "CAST(mod(o_custkey,50) AS INT)",
    "ccdid": "CAST(1+mod(o_custkey,2) AS INT)",
    "qid": "CAST(1+mod(o_orderkey,4) AS INT)",
    "filtercode": "CASE mod(o_orderkey,3) WHEN 0 THEN 'zg' WHEN 1 THEN 'zr' ELSE 'zi' END",
    "expid": "o_orderkey {div} 4",
    "maglimit": "CASE WHEN mod(o_orderkey,29)=3 THEN NULL ELSE 1.9e1+mod(o_orderkey,20)/1e1 END",
}


def exposures(spark, sf):
    return (
        data.read(spark, sf, "orders")
        .selectExpr(*[f"{e.format(div='div', days=10)} AS {n}" for n, e in _EXPOSURE.items()])
        .withColumn("obsdate", F.expr("date_add(DATE'2017-09-04', CAST(day AS INT))"))
        .drop("day")
    )


cte(
    "expo",
    "SELECT *, strftime(DATE '2017-09-04' + CAST(day AS INTEGER), '%Y-%m-%d') AS night FROM (SELECT "
    + ", ".join(f"{e.format(div='//', days=10)} AS {n}" for n, e in _EXPOSURE.items())
    + " FROM orders)",
)


@query(
    "first_middle_last",
    with_ctes(
        """
SELECT e.ccdid AS sky, e.pid FROM (SELECT *, row_number() OVER (PARTITION BY field,ccdid,qid,night ORDER BY obsjd,pid) AS n,
 count(*) OVER (PARTITION BY field,ccdid,qid,night) AS c, min((obsjd,pid)) OVER (PARTITION BY field,ccdid,qid,night) AS st FROM expo) e
JOIN (SELECT ccdid, min(st) AS st FROM (SELECT ccdid, min((obsjd,pid)) AS st FROM expo GROUP BY field,ccdid,qid,night HAVING count(*)>=3) GROUP BY 1) s
 ON s.ccdid=e.ccdid AND s.st=e.st WHERE n=1 OR n=c OR n=(c-1)//2+1
"""
    ),
)
def first_middle_last(spark, sf):
    df = exposures(spark, sf).withColumn("sky", F.col("ccdid"))
    return Q.first_middle_last(df, ["sky"]).select("sky", "pid")


cte(
    "trip",
    """
SELECT field,ccdid,qid,night,e1,e3,arg_min((obsjd,pid),(abs(obsjd-(e1[1]+e3[1])/2),obsjd,pid)) AS e2 FROM (
 SELECT e.*, f.e1, l.e3 FROM expo e JOIN (SELECT field,ccdid,qid,night,min((obsjd,pid)) AS e1 FROM expo GROUP BY 1,2,3,4) f USING (field,ccdid,qid,night)
 JOIN (SELECT field,ccdid,qid,night,max((obsjd,pid)) AS e3 FROM (SELECT *, min((obsjd,pid)) OVER (PARTITION BY field,ccdid,qid,night) AS m FROM expo)
  WHERE (obsjd-m[1])*1.44e3<=1.5e2 AND (obsjd,pid)<>m GROUP BY 1,2,3,4) l USING (field,ccdid,qid,night))
WHERE (obsjd-e1[1])*1.44e3>=1.5e1 AND (e3[1]-obsjd)*1.44e3>=1.5e1 GROUP BY 1,2,3,4,5,6
""",
)


@query(
    "pick_triples",
    with_ctes("SELECT field, ccdid, qid, night, e1[2] AS pid1, e2[2] AS pid2, e3[2] AS pid3 FROM trip"),
)
def pick_triples(spark, sf):
    return Q.pick_triples(exposures(spark, sf)).selectExpr(
        "field", "ccdid", "qid", "night", "e1.pid AS pid1", "e2.pid AS pid2", "e3.pid AS pid3"
    )


@query(
    "excluded_nights",
    with_ctes(
        "SELECT t.field, t.ccdid, t.qid, t.night FROM trip t ANTI JOIN (SELECT DISTINCT field,ccdid,qid,night FROM expo WHERE maglimit IS NULL) x USING (field,ccdid,qid,night)"
    ),
)
def excluded_nights(spark, sf):
    df = exposures(spark, sf)
    bad = Q.with_night(df).where("maglimit IS NULL")
    return Q.without_nights(Q.pick_triples(df), bad).select(*Q.QUADRANT_NIGHT)


@query(
    "sibling_sequences",
    with_ctes(
        """
SELECT f AS field_id, qid, pid, CAST(row_number() OVER (PARTITION BY f, qid ORDER BY obsjd, pid) AS INT) AS sequence_no FROM (
SELECT o.f, e.qid, e.pid, e.obsjd, o.n, count(*) OVER (PARTITION BY o.f, e.qid) AS c FROM expo e JOIN
 (SELECT DISTINCT CAST(expid//2 AS BIGINT) AS f, expid, ccdid, qid AS own, count(DISTINCT expid) OVER (PARTITION BY expid//2) AS n FROM expo WHERE qid=1) o
 ON o.expid=e.expid AND o.ccdid=e.ccdid AND e.qid<>o.own) WHERE c=n
"""
    ),
)
def sibling_sequences(spark, sf):
    df = exposures(spark, sf)
    parents = df.where("qid = 1").selectExpr("expid div 2 AS field_id", "expid", "ccdid", "qid")
    return Q.sibling_sequences(parents, df).select("field_id", "qid", "pid", "sequence_no")


# --- hash sampling ----------------------------------------------------------------


@query(
    "hash_sample",
    with_ctes(
        """
SELECT s_suppkey AS field_id, c_custkey AS item FROM (SELECT c_nationkey AS s_suppkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('AS-032:' || c_nationkey || ':' || c_custkey)) AS n FROM customer) WHERE n<=8
"""
    ),
)
def hash_sample(spark, sf):
    df = data.read(spark, sf, "customer").selectExpr("c_nationkey AS field_id", "c_custkey AS item")
    return P.hash_sample(df, ["field_id"], "AS-032", ["field_id", "item"], 8)


# Customers as tracklets of a nation, in strata and mask patterns.
_CONTEXT = {
    "field_id": "c_nationkey",
    "tracklet_id": "c_custkey",
    "stratum": "CASE WHEN mod(c_custkey,37)=5 THEN 'known' WHEN mod(c_custkey,4)=1 THEN 'masked_unknown' WHEN mod(c_custkey,4)=2 THEN 'partially_masked_unknown' ELSE 'unmasked_unknown' END",
    "mask_pattern": "CASE WHEN mod(c_custkey,7)<4 THEN 256 WHEN mod(c_custkey,7)<6 THEN 4097 ELSE c_nationkey END",
}
cte("ctx", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CONTEXT.items()) + " FROM customer")
cte("ctxh", "SELECT *, sha256('AS-032:' || field_id || ':' || tracklet_id) AS h FROM ctx")
# Shares of the slots that are left after one for each pattern.
cte(
    "ctxq",
    f"""
SELECT field_id, mask_pattern, CASE WHEN {P.MASKED_SAMPLE}<=np THEN CASE WHEN by_size<={P.MASKED_SAMPLE} THEN 1 ELSE 0 END WHEN spare<=0 THEN least(1,size)
 ELSE least(size, 1+floor(share)+CASE WHEN row_number() OVER (PARTITION BY field_id ORDER BY share-floor(share) DESC, mask_pattern)-1
  < {P.MASKED_SAMPLE}-np-sum(floor(share)) OVER (PARTITION BY field_id) THEN 1 ELSE 0 END) END AS quota FROM (
 SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY size DESC, mask_pattern) AS by_size,
  CASE WHEN {P.MASKED_SAMPLE}>np AND spare>0 THEN ({P.MASKED_SAMPLE}-np)*(size-1)/spare ELSE 0e0 END AS share FROM (
  SELECT *, count(*) OVER (PARTITION BY field_id) AS np, sum(size-1) OVER (PARTITION BY field_id) AS spare FROM (
   SELECT field_id, mask_pattern, count(*) AS size FROM ctx WHERE stratum='masked_unknown' GROUP BY 1,2)))
""",
)


@query(
    "stratified_sample",
    with_ctes(
        f"""
SELECT field_id, tracklet_id, stratum, mask_pattern FROM ctxh WHERE stratum='known' UNION ALL
SELECT field_id, tracklet_id, stratum, mask_pattern FROM (SELECT *, row_number() OVER (PARTITION BY field_id, mask_pattern ORDER BY h) AS n FROM ctxh WHERE stratum='masked_unknown')
 JOIN ctxq USING (field_id, mask_pattern) WHERE n<=quota UNION ALL
SELECT field_id, tracklet_id, stratum, mask_pattern FROM (SELECT *, row_number() OVER (PARTITION BY field_id, stratum ORDER BY h) AS n FROM ctxh)
 WHERE stratum='partially_masked_unknown' AND n<={P.PARTIAL_SAMPLE} OR stratum='unmasked_unknown' AND n<={P.UNMASKED_SAMPLE}
"""
    ),
)
def stratified_sample(spark, sf):
    contexts = data.read(spark, sf, "customer").selectExpr(*[f"{e} AS {n}" for n, e in _CONTEXT.items()])
    return P.stratified_sample(contexts, ["field_id"], "AS-032")


@query(
    "selection_order",
    with_ctes(
        """
SELECT star_id, CAST(row_number() OVER (ORDER BY sha256('AS-033:' || star_id)) AS BIGINT) AS position FROM star
WHERE v_mag<=6.5e0 AND star_dec>=-25 AND abs(degrees(asin(sin(radians(star_dec))*0.9174821430652418e0-cos(radians(star_dec))*sin(radians(star_ra))*0.3977769969112606e0)))<=1e1
"""
    ),
)
def selection_order(spark, sf):
    stars = P.eligible_stars(data.stars(spark, sf).where("v_mag <= 6.5D")).withColumn("_all", F.lit(1))
    return P.hash_order(stars, ["_all"], "AS-033", ["star_id"]).select("star_id", "position")


@query(
    "allocate_sample",
    with_ctes(
        """
WITH z AS (SELECT c_nationkey AS field_id, c_mktsegment AS pattern, count(*) AS size FROM customer GROUP BY 1,2),
q AS (SELECT *, (8-p)*(size-1)/spare AS share FROM (SELECT *, count(*) OVER (PARTITION BY field_id) AS p, sum(size-1) OVER (PARTITION BY field_id) AS spare FROM z))
SELECT field_id, pattern, CAST(size AS BIGINT) AS size, CAST(least(size, 1+floor(share)+CASE WHEN row_number() OVER (PARTITION BY field_id ORDER BY share-floor(share) DESC, pattern)
 <= 8-p-sum(floor(share)) OVER (PARTITION BY field_id) THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM q
""".replace("WITH z AS", "SELECT * FROM (WITH z AS")
        + ")"
    ),
)
def allocate_sample(spark, sf):
    sizes = data.read(spark, sf, "customer").groupBy(
        F.col("c_nationkey").alias("field_id"), F.col("c_mktsegment").alias("pattern")
    ).agg(F.count("*").alias("size"))
    return P.allocate(sizes, ["field_id"], "pattern", 8)


@query("halo_sample")
def halo_sample(spark, sf):
    ctx = contexts(spark, sf).select("field_id", "tracklet_no", "tracklet_id", "stratum", "mask_pattern")
    return P.stratified_sample(ctx, ["field_id"], "AS-032")


@query(
    "first_usable_stars",
    with_ctes(
        """
SELECT field_id, star_id, CASE WHEN usable THEN CAST(hits AS BIGINT) END AS selected_no FROM (SELECT field_id, star_id, usable,
 row_number() OVER w AS n, sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER w AS hits FROM (SELECT *, coalesce(v_mag<5,false) AS usable, sha256('AS-033:' || star_id) AS h FROM star)
 WINDOW w AS (PARTITION BY field_id ORDER BY h)) WHERE hits-CASE WHEN usable THEN 1 ELSE 0 END<4 AND n<=40
"""
    ),
)
def first_usable_stars(spark, sf):
    stars = data.stars(spark, sf).selectExpr(
        "field_id", "star_id", "coalesce(v_mag < 5, false) AS usable", f"{P.hash_key('AS-033', 'star_id')} AS h"
    )
    return P.first_usable(stars, ["field_id"], ["h"], 4, 40).select("field_id", "star_id", "selected_no")


# --- independence groups: suppliers as quadrant-nights -----------------------------

_NIGHT = {
    "field_id": "concat('Q', CAST(s_suppkey AS STRING))",
    "night": "CAST(DATE'2020-01-01' + CAST(mod(s_suppkey*17,90) AS INT) AS STRING)",
    "ztf_field": "mod(s_suppkey,60)",
    "star": "concat('TYC ', CAST(mod(s_suppkey*29,70) AS STRING))",
    "population": "CASE WHEN mod(s_suppkey,9)=0 THEN 'R' WHEN mod(s_suppkey,9)=1 THEN 'N' ELSE 'C' END",
}


def nights(spark, sf):
    return data.read(spark, sf, "supplier").selectExpr(
        *[f"{e} AS {n}" for n, e in _NIGHT.items() if n != "star"], f"array({_NIGHT['star']}) AS stars"
    )


cte("qn", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _NIGHT.items()) + " FROM supplier")
cte(
    "qlink",
    """
SELECT a.field_id AS a, b.field_id AS b FROM qn a JOIN qn b ON a.field_id<>b.field_id AND (a.night=b.night OR a.star=b.star
 OR (a.ztf_field=b.ztf_field AND abs(datediff('day', CAST(a.night AS DATE), CAST(b.night AS DATE)))<=3))
""",
)


@query(
    "link_pairs",
    with_ctes(
        """
SELECT a.field_id AS a, b.field_id AS b, r.reason FROM qn a JOIN qn b ON a.field_id<b.field_id, LATERAL (
 SELECT 'same night' AS reason WHERE a.night=b.night UNION ALL SELECT 'same star ' || a.star WHERE a.star=b.star
 UNION ALL SELECT 'field ' || a.ztf_field || ' ' || abs(datediff('day', CAST(a.night AS DATE), CAST(b.night AS DATE))) || ' d apart'
 WHERE a.ztf_field=b.ztf_field AND a.night<>b.night AND abs(datediff('day', CAST(a.night AS DATE), CAST(b.night AS DATE)))<=3) r
"""
    ),
)
def link_pairs(spark, sf):
    return N.link_reasons(nights(spark, sf))


_COMPONENTS = """
WITH RECURSIVE r AS (SELECT field_id AS node, field_id AS reached FROM qn UNION SELECT r.node, l.b FROM r JOIN qlink l ON l.a=r.reached)
SELECT node AS field_id, 'G-' || min(reached) AS grp FROM r GROUP BY node
"""
cte("qcomp", f"SELECT * FROM ({_COMPONENTS.strip()})")


@query(
    "independence_groups",
    with_ctes(
        "SELECT q.field_id, c.grp, CASE WHEN bool_or(q.population IN ('R','N')) OVER (PARTITION BY c.grp) THEN 'development' ELSE 'validation' END AS split FROM qn q JOIN qcomp c USING (field_id)"
    ),
)
def independence_groups(spark, sf):
    return N.manifest(nights(spark, sf), ["R", "N"]).select("field_id", "grp", "split")


@query(
    "split_digest",
    with_ctes(
        "SELECT split, sha256(string_agg(field_id, chr(10) ORDER BY field_id)) AS digest FROM (SELECT q.field_id, CASE WHEN bool_or(q.population IN ('R','N')) OVER (PARTITION BY c.grp) THEN 'development' ELSE 'validation' END AS split FROM qn q JOIN qcomp c USING (field_id)) GROUP BY split"
    ),
)
def split_digest(spark, sf):
    return N.split_digest(N.manifest(nights(spark, sf), ["R", "N"]))


@query(
    "group_folds",
    with_ctes(
        "SELECT grp, CAST((row_number() OVER (ORDER BY sha256('AS-037:' || grp))-1)%5 AS INT) AS fold FROM (SELECT DISTINCT grp FROM qcomp)"
    ),
)
def group_folds(spark, sf):
    return N.fold_of_groups(N.independence_groups(nights(spark, sf)))


# --- sources -----------------------------------------------------------------------

_PSF = {
    "product_id": "event_id {div} 300",
    "row_index": "mod(event_id,300)",
    "sourceid": "event_id",
    "xpos": "CAST(mod(event_id*13,3072) AS DOUBLE)",
    "ypos": "CAST(mod(event_id*29,3080) AS DOUBLE)",
    "ra": "CASE WHEN mod(event_id,97)=5 THEN 3.7e2 WHEN mod(event_id,89)=7 THEN NULL ELSE mod(event_id*7919,36000)/1e2 END",
    "dec": "CASE WHEN mod(event_id,83)=11 THEN 9.5e1 ELSE mod(event_id*31,1800)/1e1-9e1 END",
    "flux": "value",
    "sigflux": "value/1e1",
    "mag": "-value/1e2",
    "sigmag": "CASE WHEN mod(event_id,79)=3 THEN -1e-1 ELSE 1e-2 END",
    "snr": "CASE WHEN mod(user_id,37)=2 THEN -2e0 ELSE value END",
    "chi": "1e0",
    "sharp": "CASE WHEN mod(event_id,41)=9 THEN CAST('NaN' AS DOUBLE) ELSE mod(event_id,100)/1e2 END",
    "flags": "CAST(CASE WHEN mod(user_id,11)=0 THEN -1 WHEN mod(user_id,5)=0 THEN 256 ELSE 0 END AS INT)",
}


def normalised(spark, sf):
    rows = data.read(spark, sf, "events").selectExpr(*[f"{e.format(div='div')} AS {n}" for n, e in _PSF.items()])
    zero = rows.groupBy("product_id").agg((26.0 + F.col("product_id") % 5 / 10.0).alias("magzp"))
    return K.normalise_psf(rows, zero)


cte(
    "psf",
    "SELECT *, 26e0+mod(product_id,5)/1e1 AS magzp FROM (SELECT "
    + ", ".join(f"{e.format(div='//')} AS {n}" for n, e in _PSF.items())
    + " FROM events)",
)
cte(
    "psfn",
    """
SELECT product_id, row_index, concat(product_id,'-',sourceid) AS source_id, ra, dec, mag+magzp AS magnitude, flags=-1 AS on_image_edge,
 greatest(flags,0) AS mask_bits, CASE WHEN isnan(sharp) THEN NULL ELSE sharp END AS sharp,
 concat_ws('; ', CASE WHEN ra IS NULL THEN 'ra: must be a finite number' WHEN NOT (ra>=0 AND ra<360) THEN 'ra: must be in [0, 360)' END,
  CASE WHEN NOT (dec>=-90 AND dec<=90) THEN 'dec: must be in [-90, 90]' END,
  CASE WHEN sigmag<0 THEN 'magnitude_error: must not be negative' END, CASE WHEN snr<0 THEN 'snr: must not be negative' END) AS reason
FROM psf
""",
)


@query(
    "normalise_catalog",
    with_ctes(
        "SELECT product_id, row_index, source_id, ra, round(dec,6) AS dec, round(magnitude,6) AS magnitude, on_image_edge, mask_bits, sharp FROM psfn WHERE reason=''"
    ),
)
def normalise_catalog(spark, sf):
    return K.valid_rows(normalised(spark, sf)).selectExpr(
        "product_id", "row_index", "source_id", "ra", "round(dec,6) AS dec", "round(magnitude,6) AS magnitude",
        "on_image_edge", "mask_bits", "sharp",
    )


@query("rejected_rows", with_ctes("SELECT product_id, row_index, reason FROM psfn WHERE reason<>''"))
def rejected_rows(spark, sf):
    return K.rejected_rows(normalised(spark, sf))


@query(
    "negative_flags",
    with_ctes("SELECT product_id, flags, CAST(count(*) AS BIGINT) AS rows FROM psf WHERE flags<0 GROUP BY 1,2"),
)
def negative_flags(spark, sf):
    rows = data.read(spark, sf, "events").selectExpr(*[f"{e.format(div='div')} AS {n}" for n, e in _PSF.items()])
    return K.negative_flag_counts(rows)


_RAW = {
    "num": "CASE WHEN mod(p_partkey,3)=0 THEN '-' WHEN mod(p_partkey,101)=7 THEN 'x1' ELSE CAST(p_partkey AS STRING) END",
    "name": "concat(' ', p_name)",
    "h": "mod(p_partkey*7,24)",
    "m": "mod(p_partkey*11,60)",
    "s": "mod(p_partkey*13,60)",
    "dg": "mod(p_partkey*3,90)",
    "neg": "mod(p_partkey,2)=1",
    "v": "CASE WHEN mod(p_partkey,5)=1 THEN '-' ELSE CAST(1e1+p_size/1e1 AS STRING) END",
    "size": "p_size",
    "key": "p_partkey",
}


@query(
    "normalise_known_objects",
    "SELECT key AS row_index, CASE WHEN num='-' THEN trim(name) ELSE num END AS designation,"
    " round((h+m/6e1+s/3.6e3)*15,6) AS predicted_ra, round(CASE WHEN neg THEN -1 ELSE 1 END*(dg+m/6e1+s/3.6e3),6) AS predicted_dec,"
    " CASE WHEN v<>'-' THEN CAST(v AS DOUBLE) END AS v_magnitude, CAST(size AS DOUBLE) AS position_error_arcsec FROM (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _RAW.items())
    + " FROM part) WHERE num<>'x1'",
)
def normalise_known_objects(spark, sf):
    raw = data.read(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in _RAW.items()]).selectExpr(
        "0L AS product_id", "key AS row_index", "num", "name", "'MB' AS class",
        "format_string('%02d %02d %02d', h, m, s) AS ra_hms",
        "concat(if(neg, '-', '+'), format_string('%02d %02d %02d', dg, m, s)) AS dec_dms",
        "v AS v_mag", "CAST(size AS STRING) AS err", "'1.5' AS d", "'2.5' AS dra", "'-3' AS ddec", "'-' AS dg", "'' AS dh",
    )
    good, _ = K.normalise_known_objects(raw)
    return good.selectExpr(
        "row_index", "designation", "round(predicted_ra,6) AS predicted_ra", "round(predicted_dec,6) AS predicted_dec",
        "v_magnitude", "position_error_arcsec",
    )


@query(
    "mid_exposure",
    with_ctes(
        "SELECT product_id, round(2460310.5e0 + build_id + (minutes*60+15)/8.64e4, 8) AS mid_exposure_jd FROM frm"
    ),
)
def mid_exposure(spark, sf):
    return K.mid_exposure(data.frames(spark, sf)).selectExpr(
        "product_id", "round(mid_exposure_jd,8) AS mid_exposure_jd"
    )


@query(
    "product_paths",
    with_ctes(
        "SELECT product_id, '2018/0411/467847/ztf_20180411467847_' || lpad(CAST(field AS VARCHAR),6,'0') || '_' || filter_code || '_c' || lpad(CAST(ccd_id AS VARCHAR),2,'0') || '_o_q' || quadrant_id || '_psfcat.fits' AS path FROM frm"
    ),
)
def product_paths(spark, sf):
    frames = data.frames(spark, sf).selectExpr("*", "field AS field_no", "'20180411467847' AS file_frac_day")
    return K.product_path(frames, K.PSF_SUFFIX).select("product_id", "path")


@query(
    "input_digests",
    "SELECT field_id, sha256(string_agg(l, chr(10) ORDER BY l)) AS sha256 FROM (SELECT DISTINCT o_custkey AS field_id,"
    " CAST(o_orderkey AS VARCHAR)||' '||CASE WHEN o_orderkey%13=0 THEN 'unreadable' ELSE sha256(o_orderstatus) END AS l FROM orders) GROUP BY 1",
)
def input_digests(spark, sf):
    orders = data.read(spark, sf, "orders").selectExpr(
        "o_custkey AS field_id", "o_orderkey AS path", "if(o_orderkey % 13 = 0, NULL, sha2(o_orderstatus, 256)) AS sha256"
    )
    return B.input_digests(orders)
