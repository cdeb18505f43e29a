"""Background-rank metrics, bootstrap, correlation and decisions."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from checks import data
from checks.draws import intervals_sql
from checks.registry import cte, query, with_ctes
from driftline.functions.stats import newcombe, wilson
from driftline.operators import decisions as D
from driftline.operators import metrics as M
from driftline.operators import ordered as O
from driftline.operators import ranking as R

cte(
    "rpos",
    """
SELECT b.*, 1e0/count(*) OVER (PARTITION BY designation, night) AS weight FROM (
SELECT p.*, CASE WHEN g.n IS NULL THEN 0e0 ELSE (above+5e-1*tied)/g.n END AS q, 1+above+5e-1*tied AS rank FROM (
 SELECT s.*, coalesce(c.above,0) AS above, coalesce(c.tied,0) AS tied FROM (
  SELECT * FROM scored WHERE label='positive' QUALIFY row_number() OVER (PARTITION BY field_id, designation ORDER BY score DESC, tracklet_no)=1) s
 LEFT JOIN (SELECT field_id, score, count(*) FILTER (label='background') AS tied,
   coalesce(sum(count(*) FILTER (label='background')) OVER (PARTITION BY field_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS above
   FROM scored GROUP BY field_id, score) c ON c.field_id=s.field_id AND c.score=s.score) p
LEFT JOIN (SELECT field_id, count(*) AS n FROM scored WHERE label='background' GROUP BY 1) g ON g.field_id=p.field_id) b
""",
)
_MCOLS = {
    "objects": "sum(weight)",
    "fields_with_positive": "CAST(count(DISTINCT field_id) AS BIGINT)",
    "auc": "sum(weight*(1-q))/sum(weight)",
    **{
        f"recall_{f:g}".replace(".", "_"): f"sum(weight) FILTER (q<={f!r})/sum(weight)"
        for f in (0.05, 0.01, 0.02, 0.1, 0.2)
    },
    **{f"recall_k{k}": f"sum(weight) FILTER (rank<={k})/sum(weight)" for k in (10, 25, 50)},
}


def _round(cols, keep=(), n=9):
    return [c if c in keep else f"round({c},{n}) AS {c}" for c in cols]


def positives(spark, sf):
    return M.rank_positives(data.scored(spark, sf))


@query(
    "background_ranks",
    with_ctes(
        "SELECT field_id, designation, tracklet_id, round(q,9) AS q, round(rank,3) AS rank, round(weight,9) AS weight FROM rpos"
    ),
)
def background_ranks(spark, sf):
    return positives(spark, sf).selectExpr(
        "field_id", "designation", "tracklet_id", "round(q,9) AS q", "round(rank,3) AS rank", "round(weight,9) AS weight"
    )


@query(
    "recall_metrics",
    with_ctes(
        "SELECT grp, "
        + ", ".join(
            e + f" AS {n}" if n == "fields_with_positive" else f"round(coalesce({e},0),9) AS {n}" for n, e in _MCOLS.items()
        )
        + " FROM rpos GROUP BY grp"
    ),
)
def recall_metrics(spark, sf):
    out = M.recall_metrics(positives(spark, sf), ["grp"])
    return out.selectExpr("grp", *_round(_MCOLS, keep=("fields_with_positive",)))


@query(
    "strata_metrics",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{k}' AS key, {k} AS value, round(sum(weight),9) AS objects, round(sum(weight*(1-q))/sum(weight),9) AS auc,"
            f" round(coalesce(sum(weight) FILTER (q<=0.05),0)/sum(weight),9) AS recall_5 FROM rpos GROUP BY {k}"
            for k in ("role", "proximity_group")
        )
    ),
)
def strata_metrics(spark, sf):
    return M.strata_metrics(positives(spark, sf), [], ["role", "proximity_group"]).selectExpr(
        "key", "value", *_round(["objects", "auc", "recall_5"])
    )


@query(
    "weighted_median_q",
    with_ctes(
        """
SELECT grp, round(min(q),9) AS median_q FROM (SELECT grp, q, sum(w) OVER (PARTITION BY grp ORDER BY q) AS run,
 sum(w) OVER (PARTITION BY grp) AS total FROM (SELECT grp, q, sum(weight) AS w FROM rpos GROUP BY 1,2))
WHERE run >= total/2 - 1e-12 GROUP BY grp
"""
    ),
)
def weighted_median_q(spark, sf):
    return M.weighted_median(positives(spark, sf), ["grp"]).selectExpr("grp", "round(median_q,9) AS median_q")


FEATURES = (("quantity", 1), ("price", 1), ("discount", -1), ("tax", -1))


def feature_scores(spark, sf):
    """The scored table once per feature, oriented; ranker = feature."""
    items = ", ".join(f"'{n}', {M.oriented_score(n, d)}" for n, d in FEATURES)
    return data.scored(spark, sf).drop("score").selectExpr(
        "*", f"stack({len(FEATURES)}, {items}) AS (ranker, score)"
    )


cte(
    "fscored",
    " UNION ALL ".join(
        f"SELECT '{n}' AS ranker, field_id, grp, tracklet_no, night, designation, label, role, proximity_group,"
        f" coalesce({d}*{n}, CAST('-inf' AS DOUBLE)) AS score FROM scored"
        for n, d in FEATURES
    ),
)
cte(
    "fpos",
    """
SELECT b.*, 1e0/count(*) OVER (PARTITION BY ranker, designation, night) AS weight FROM (
SELECT s.*, CASE WHEN c.n=0 THEN 0e0 ELSE (c.above+5e-1*c.tied)/c.n END AS q FROM (
  SELECT * FROM fscored WHERE label='positive' QUALIFY row_number() OVER (PARTITION BY ranker, field_id, designation ORDER BY score DESC, tracklet_no)=1) s
 JOIN (SELECT ranker, field_id, score, tied, sum(tied) OVER (PARTITION BY ranker, field_id) AS n,
   coalesce(sum(tied) OVER (PARTITION BY ranker, field_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS above
   FROM (SELECT ranker, field_id, score, count(*) FILTER (label='background') AS tied FROM fscored GROUP BY 1,2,3)) c
 ON c.ranker=s.ranker AND c.field_id=s.field_id AND c.score=s.score) b
""",
)


@query(
    "feature_evaluation",
    with_ctes(
        "SELECT ranker, round(sum(weight),6) AS objects, round(sum(weight*(1-q))/sum(weight),9) AS auc,"
        " round(coalesce(sum(weight) FILTER (q<=0.05),0)/sum(weight),9) AS recall_5,"
        " round(coalesce(sum(weight*(1-q)) FILTER (role='marginal'),0)/sum(weight) FILTER (role='marginal'),9) AS marginal_auc"
        " FROM fpos GROUP BY ranker"
    ),
)
def feature_evaluation(spark, sf):
    pos = M.rank_positives(feature_scores(spark, sf), ["ranker"])
    overall = M.recall_metrics(pos, ["ranker"])
    marginal = M.recall_metrics(pos.where("role = 'marginal'"), ["ranker"]).selectExpr(
        "ranker", "auc AS marginal_auc"
    )
    return overall.join(marginal, "ranker").selectExpr(
        "ranker", "round(objects,6) AS objects", "round(auc,9) AS auc", "round(recall_0_05,9) AS recall_5",
        "round(marginal_auc,9) AS marginal_auc",
    )


@query(
    "feature_missing_rates",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{n}' AS feature, l AS label, CAST(count(*) AS BIGINT) AS ranked, CAST(count(*)-count({n}) AS BIGINT) AS missing,"
            f" round((count(*)-count({n}))/count(*),9) AS missing_rate FROM (SELECT *, unnest(['all',label]) AS l FROM scored) GROUP BY l"
            for n, _ in FEATURES
        )
    ),
)
def feature_missing_rates(spark, sf):
    items = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n, _ in FEATURES)
    long = data.scored(spark, sf).selectExpr("label", f"stack({len(FEATURES)}, {items}) AS (feature, value)")
    return M.missing_rates(long, ["feature"]).selectExpr(
        "feature", "label", "ranked", "missing", "round(missing_rate,9) AS missing_rate"
    )


cte(
    "rparts",
    "SELECT 'scored/recall5' AS label, grp, sum(CASE WHEN q<=5e-2 THEN weight ELSE 0e0 END) AS numerator, sum(weight) AS denominator FROM rpos GROUP BY grp"
    " UNION ALL SELECT 'scored/auc', grp, sum(weight*(1-q)), sum(weight) FROM rpos GROUP BY grp",
)


@query(
    "bootstrap_intervals",
    with_ctes(
        "SELECT label, round(point,9) AS point, round(lower,9) AS lower, round(upper,9) AS upper FROM ("
        + intervals_sql("SELECT * FROM rparts", ["scored/recall5", "scored/auc"]) + ")"
    ),
)
def bootstrap_intervals(spark, sf):
    pos = positives(spark, sf)
    parts = M.ratio_parts(pos, "'scored/'", {"recall5": "q <= 0.05D", "auc": "1D - q"})
    return M.group_bootstrap(parts).selectExpr(
        "label", "round(point,9) AS point", "round(lower,9) AS lower", "round(upper,9) AS upper"
    )


_PAIR = (
    "SELECT 'quantity-price' AS label, a.grp, sum(a.weight*(CASE WHEN a.q<=5e-2 THEN 1 ELSE 0 END-CASE WHEN b.q<=5e-2 THEN 1 ELSE 0 END)) AS numerator,"
    " sum(a.weight) AS denominator FROM fpos a JOIN fpos b USING (field_id, designation) WHERE a.ranker='quantity' AND b.ranker='price' GROUP BY a.grp"
)


@query(
    "paired_difference",
    with_ctes(
        "SELECT label, round(point,9) AS point, round(lower,9) AS lower, round(upper,9) AS upper FROM ("
        + intervals_sql(_PAIR, ["quantity-price"]) + ")"
    ),
)
def paired_difference(spark, sf):
    pos = M.rank_positives(feature_scores(spark, sf), ["ranker"])
    a, b = pos.where("ranker = 'quantity'"), pos.where("ranker = 'price'")
    out = M.group_bootstrap(M.paired_difference_parts(a, b, "quantity-price"))
    return out.selectExpr("label", *_round(["point", "lower", "upper"]))


_TWELVE = [*[n for n, _ in FEATURES], *data.MORE_FEATURES]
_BG = "labelled WHERE label='background'"
cte(
    "rho",
    " UNION ALL ".join(
        f"""
SELECT '{a}' AS a, '{b}' AS b, {f} AS field_id, CASE WHEN count(*)>=3 AND stddev_pop(rx)>0 AND stddev_pop(ry)>0 THEN corr(rx,ry) END AS rho FROM (SELECT field_id,
 rank() OVER ({w} ORDER BY {a}) + (count(*) OVER (PARTITION BY {c}{a})-1)/2e0 AS rx,
 rank() OVER ({w} ORDER BY {b}) + (count(*) OVER (PARTITION BY {c}{b})-1)/2e0 AS ry
 FROM {_BG} AND {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY {f}"""
        for i, a in enumerate(_TWELVE)
        for b in _TWELVE[i + 1 :]
        for f, w, c in (("'all'", "", ""), ("field_id", "PARTITION BY field_id", "field_id, "))
    ),
)


@query(
    "spearman_matrix",
    with_ctes(
        f"""
SELECT a, b, round(any_value(rho) FILTER (field_id='all'),6) AS pooled, round(median(rho) FILTER (field_id<>'all' AND n>=10),6) AS field_median
FROM rho LEFT JOIN (SELECT field_id, count(*) AS n FROM {_BG} GROUP BY 1) USING (field_id) GROUP BY a, b
"""
    ),
)
def spearman_matrix(spark, sf):
    bg = data.labelled(spark, sf).where("label = 'background'")
    return M.spearman_matrices(bg, _TWELVE).selectExpr(
        "a", "b", "round(pooled,6) AS pooled", "round(field_median,6) AS field_median"
    )


@query(
    "within_field_percentiles",
    with_ctes(
        " UNION ALL ".join(
            f"""
SELECT field_id, tracklet_no, '{n}' AS feature, CASE WHEN {n} IS NULL THEN NULL ELSE
 round((rank() OVER (PARTITION BY field_id ORDER BY {d}*{n} NULLS LAST)-1 + 5e-1*count(*) OVER (PARTITION BY field_id, {n}))
 /count({n}) OVER (PARTITION BY field_id),9) END AS percentile FROM scored"""
            for n, d in FEATURES
        )
    ),
)
def within_field_percentiles(spark, sf):
    long = R.long_features(data.scored(spark, sf), ["field_id", "tracklet_no"], FEATURES)
    out = R.oriented_percentiles(long, ["field_id"])
    return out.selectExpr("field_id", "tracklet_no", "feature", "round(percentile,9) AS percentile")


_PROBS = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


@query(
    "numeric_summary",
    with_ctes(
        "SELECT label, CAST(count(price) AS BIGINT) AS count, "
        + ", ".join(f"round(quantile_cont(price,{p}),6) AS {n}" for n, p in _PROBS.items())
        + " FROM scored GROUP BY label"
    ),
)
def numeric_summary(spark, sf):
    out = O.quantiles(data.scored(spark, sf), ["label"], "price", _PROBS)
    return out.selectExpr("label", "count", *[f"round({n},6) AS {n}" for n in _PROBS])


@query(
    "shortlist_background",
    with_ctes(
        """
SELECT field_id, tracklet_no, round(q,9) AS q FROM (SELECT field_id, tracklet_no,
 (rank() OVER (PARTITION BY field_id ORDER BY score DESC)-1+5e-1*count(*) OVER (PARTITION BY field_id, score))
 /count(*) OVER (PARTITION BY field_id) AS q FROM scored WHERE label='background') WHERE q<=0.05
"""
    ),
)
def shortlist_background(spark, sf):
    return M.shortlist_background(data.scored(spark, sf)).selectExpr("field_id", "tracklet_no", "round(q,9) AS q")


@query(
    "missed_positives",
    with_ctes(
        "SELECT p.field_id, p.designation, p.tracklet_no, round(p.q,9) AS q, round(c.q,9) AS comparator_q FROM rpos p"
        " JOIN fpos c ON c.ranker='quantity' AND c.field_id=p.field_id AND c.designation=p.designation WHERE p.q>0.05"
    ),
)
def missed_positives(spark, sf):
    comparator = M.rank_positives(feature_scores(spark, sf).where("ranker = 'quantity'"), ["ranker"])
    return M.missed_positives(positives(spark, sf), comparator).selectExpr(
        "field_id", "designation", "tracklet_no", "round(q,9) AS q", "round(comparator_q,9) AS comparator_q"
    )


@query(
    "ranker_disagreements",
    with_ctes(
        "SELECT p.field_id, p.designation, CASE WHEN p.q<=0.05 THEN 'ranker' ELSE 'comparator' END AS only FROM rpos p"
        " JOIN fpos c ON c.ranker='quantity' AND c.field_id=p.field_id AND c.designation=p.designation WHERE (p.q<=0.05)<>(c.q<=0.05)"
    ),
)
def ranker_disagreements(spark, sf):
    comparator = M.rank_positives(feature_scores(spark, sf).where("ranker = 'quantity'"), ["ranker"])
    return M.disagreements(positives(spark, sf), comparator).select("field_id", "designation", "only")


@query(
    "weak_fields",
    with_ctes(
        "SELECT field_id, round(sum(weight),9) AS positives, round(sum(weight*(1-q))/sum(weight),9) AS auc FROM fpos WHERE ranker='tax' GROUP BY 1"
        " HAVING sum(weight)>=3 AND sum(weight*(1-q))/sum(weight)<0.5"
    ),
)
def weak_fields(spark, sf):
    pos = M.rank_positives(feature_scores(spark, sf).where("ranker = 'tax'"), ["ranker"])
    return M.weak_fields(pos, []).selectExpr("field_id", *_round(["positives", "auc"]))


@query(
    "bottom_half_positives",
    with_ctes("SELECT field_id, designation, round(q,9) AS q FROM rpos WHERE q>0.5"),
)
def bottom_half_positives(spark, sf):
    return M.bottom_half(positives(spark, sf)).selectExpr("field_id", "designation", "round(q,9) AS q")


# Targets: every (field, object, night) of the scored table.
cte(
    "tgt",
    "SELECT field_id, designation, any_value(night) AS night, any_value(proximity_group) AS proximity_group, any_value(role) AS role FROM scored GROUP BY 1,2",
)


def targets(spark, sf):
    return data.scored(spark, sf).groupBy("field_id", "designation").agg(
        *[F.first(c).alias(c) for c in ("night", "proximity_group", "role", "grp")]
    )


@query(
    "end_to_end_recall",
    with_ctes(
        """
SELECT m AS members, round(sum(w),6) AS eligible, round(sum(w*hit),6) AS top, round(sum(w*hit)/sum(w),9) AS recall FROM (
SELECT unnest(['all',proximity_group,role]) AS m, w, hit FROM (SELECT t.*, 1e0/count(*) OVER (PARTITION BY t.designation, t.night) AS w,
 CASE WHEN p.q<=0.05 THEN 1e0 ELSE 0e0 END AS hit FROM tgt t LEFT JOIN rpos p ON p.field_id=t.field_id AND p.designation=t.designation)) GROUP BY m
"""
    ),
)
def end_to_end_recall(spark, sf):
    out = M.end_to_end_recall(targets(spark, sf), positives(spark, sf))
    return out.selectExpr(
        "members", "round(eligible_object_nights,6) AS eligible", "round(top_object_nights,6) AS top", "round(recall,9) AS recall"
    )


@query(
    "hash_scores",
    with_ctes(
        "SELECT field_id, tracklet_id, round(CAST(('0x' || substr(sha256('AS-037:' || field_id || ':' || tracklet_id),1,15)) AS BIGINT)"
        " / 1152921504606846976e0, 9) AS score FROM scored"
    ),
)
def hash_scores(spark, sf):
    return data.scored(spark, sf).selectExpr(
        "field_id", "tracklet_id", f"round({M.hash_score('field_id', 'tracklet_id')},9) AS score"
    )


# --- decisions ----------------------------------------------------------------


@query(
    "recall_guards",
    with_ctes(
        " UNION ALL ".join(
            f"""
SELECT '{name}' AS guard, round(np,6) AS protected_n, round(nr,6) AS reference_n, round(hp/np,9) AS protected_recall,
 round(hr/nr,9) AS reference_recall, round(hp/np-hr/nr,9) AS difference, np>={least} AND nr>0 AS evaluable,
 CASE WHEN np>={least} AND nr>0 THEN hp/np-hr/nr>=-0.2 END AS passed FROM (SELECT
 coalesce(sum(weight) FILTER ({p}),0) AS np, coalesce(sum(weight) FILTER (({p}) AND q<=0.05),0) AS hp,
 coalesce(sum(weight) FILTER ({r}),0) AS nr, coalesce(sum(weight) FILTER (({r}) AND q<=0.05),0) AS hr FROM rpos)"""
            for name, (p, r, least) in {**D.DECIDING_GUARDS, **D.DESCRIPTIVE_GUARDS}.items()
        )
    ),
)
def recall_guards(spark, sf):
    rules = {**D.DECIDING_GUARDS, **D.DESCRIPTIVE_GUARDS}
    return D.guards(positives(spark, sf), [], rules).selectExpr(
        "guard", "round(protected_n,6) AS protected_n", "round(reference_n,6) AS reference_n",
        *_round(["protected_recall", "reference_recall", "difference"]), "evaluable", "passed",
    )


def _guard(rule: tuple) -> str:
    p, r, least = rule
    return (
        f"SELECT coalesce(sum(weight) FILTER ({p}),0)>={least} AND coalesce(sum(weight) FILTER ({r}),0)>0 AS evaluable,"
        f" coalesce(sum(weight) FILTER (({p}) AND q<=0.05),0)/sum(weight) FILTER ({p})"
        f" - coalesce(sum(weight) FILTER (({r}) AND q<=0.05),0)/sum(weight) FILTER ({r}) >= -{D.PROTECTION_MARGIN} AS held FROM rpos"
    )


_useful = f"recall>={D.USEFUL_RECALL} AND lower>={D.USEFUL_LOWER}"


@query(
    "usefulness_decision",
    with_ctes(
        f"""
SELECT 'scored' AS ranker, round(objects,6) AS objects, fields_with_positive, round(recall,9) AS recall, round(lower,9) AS lower, round(upper,9) AS upper,
 CASE WHEN objects<{D.MIN_POSITIVE_OBJECTS} OR fields_with_positive<{D.MIN_POSITIVE_FIELDS} OR recall IS NULL OR lower IS NULL THEN 'INCONCLUSIVE'
 WHEN upper<{D.USEFUL_RECALL} THEN 'NOT USEFUL' WHEN {_useful} AND failed>0 THEN 'USEFUL, NOT PROTECTED' WHEN {_useful} AND sure THEN 'USEFUL, PROTECTED'
 WHEN {_useful} THEN 'USEFUL, PROTECTION UNVERIFIED' ELSE 'INCONCLUSIVE' END AS verdict
FROM (SELECT sum(weight) AS objects, CAST(count(DISTINCT field_id) AS BIGINT) AS fields_with_positive, coalesce(sum(weight) FILTER (q<=5e-2),0)/sum(weight) AS recall FROM rpos),
 ({intervals_sql("SELECT * FROM rparts WHERE label='scored/recall5'", ["scored/recall5"])}) i,
 (SELECT count(*) FILTER (evaluable AND NOT held) AS failed, bool_and(evaluable) AS sure FROM ({" UNION ALL ".join(_guard(r) for r in D.DECIDING_GUARDS.values())}))
"""
    ),
)
def usefulness_decision(spark, sf):
    pos = positives(spark, sf).withColumn("ranker", F.lit("scored"))
    ci = M.group_bootstrap(M.ratio_parts(pos, "concat(ranker, '/')", {"recall5": "q <= 0.05D"}))
    metrics = M.recall_metrics(pos, ["ranker"]).selectExpr(
        "ranker", "objects", "fields_with_positive", "recall_0_05 AS recall", "concat(ranker, '/recall5') AS label"
    ).join(ci.select("label", "lower", "upper"), "label")
    rows = D.guards(pos, ["ranker"], D.DECIDING_GUARDS)
    return D.usefulness(metrics, rows, ["ranker"]).select(
        "ranker", F.round("objects", 6).alias("objects"), "fields_with_positive",
        *[F.round(c, 9).alias(c) for c in ("recall", "lower", "upper")], "verdict",
    )


# Traces: every target of the scored table; recovered when in the top fifth.
cte(
    "trace",
    """
SELECT t.field_id, t.designation, t.role, t.proximity_group, t.night, coalesce(p.q<=0.2,false) AS recovered,
 mod(CAST(substr(t.designation,2) AS BIGINT),7)<>3 AS rate_eligible, mod(CAST(substr(t.designation,2) AS BIGINT),11)<>5 AS baseline_eligible,
 CASE WHEN mod(CAST(substr(t.field_id,2) AS BIGINT),3)=0 THEN 'validation' ELSE 'development' END AS split,
 concat('TYC ',CAST(mod(CAST(substr(t.field_id,2) AS BIGINT),9) AS VARCHAR)) AS star
FROM tgt t LEFT JOIN rpos p ON p.field_id=t.field_id AND p.designation=t.designation
""",
)


def traces(spark, sf):
    hit = positives(spark, sf).selectExpr("field_id", "designation", "q <= 0.2D AS _hit")
    d, f = "CAST(substring(designation,2) AS BIGINT)", "CAST(substring(field_id,2) AS BIGINT)"
    return targets(spark, sf).join(hit, ["field_id", "designation"], "left").selectExpr(
        "field_id", "designation", "role", "proximity_group", "night", "coalesce(_hit,false) AS recovered",
        f"mod({d},7)<>3 AS rate_eligible", f"mod({d},11)<>5 AS baseline_eligible",
        f"if(mod({f},3)=0,'validation','development') AS split", f"concat('TYC ',mod({f},9)) AS star",
    )


@query(
    "positive_availability",
    with_ctes(
        """
SELECT split, CAST(count(*) AS BIGINT) AS positive_tracklet_targets, CAST(count(DISTINCT (designation,night)) AS BIGINT) AS positive_object_nights,
 CAST(count(DISTINCT field_id) AS BIGINT) AS fields_with_positive, CAST(count(*) FILTER (proximity_group='zone') AS BIGINT) AS zone,
 CAST(count(*) FILTER (proximity_group IN ('zone','outer')) AS BIGINT) AS zone_or_outer,
 CAST(count(*) FILTER (role='marginal') AS BIGINT) AS marginal
FROM trace WHERE rate_eligible AND baseline_eligible AND recovered GROUP BY split
"""
    ),
)
def positive_availability(spark, sf):
    return M.positive_availability(traces(spark, sf))


@query(
    "reconcile_labels",
    with_ctes(
        """
SELECT field_id, designation, CASE WHEN a IS NULL THEN 'traced_not_labelled' ELSE 'labelled_not_traced' END AS side FROM
(SELECT field_id, designation, 1 AS a FROM rpos) x FULL JOIN (SELECT field_id, designation, 1 AS b FROM trace WHERE recovered) y
USING (field_id, designation) WHERE a IS NULL OR b IS NULL
"""
    ),
)
def reconcile_labels(spark, sf):
    return M.reconcile(positives(spark, sf), traces(spark, sf).where("recovered"))


_ZONE = """
SELECT {scope} AS scope, CAST(sum(a+b) AS BIGINT) AS zone_n, CAST(sum(a) AS BIGINT) AS zone_recovered,
 CAST(sum(c+d) AS BIGINT) AS control_n, CAST(sum(c) AS BIGINT) AS control_recovered,
 round(sum(a*d/(a+b+c+d)) FILTER (a+b>0 AND c+d>0)/sum(b*c/(a+b+c+d)) FILTER (a+b>0 AND c+d>0),6) AS mh_odds_ratio,
 round(sum(a)/sum(a+b)-sum(c)/sum(c+d),9) AS difference
FROM (SELECT split, star, field_id, count(*) FILTER (proximity_group='zone' AND recovered) AS a, count(*) FILTER (proximity_group='zone' AND NOT recovered) AS b,
 count(*) FILTER (proximity_group='control' AND recovered) AS c, count(*) FILTER (proximity_group='control' AND NOT recovered) AS d
 FROM trace WHERE role='primary' AND rate_eligible AND baseline_eligible GROUP BY 1,2,3) GROUP BY 1
"""


@query("zone_contrast", with_ctes(_ZONE.format(scope="split")))
def zone_contrast(spark, sf):
    out = D.zone_contrast(traces(spark, sf), ["split"])
    return out.selectExpr(
        "split AS scope", "zone_n", "zone_recovered", "control_n", "control_recovered",
        "round(mh_odds_ratio,6) AS mh_odds_ratio", "round(difference,9) AS difference",
    )


def fisher_sql(source: str, key: str, a: str, b: str, c: str, d: str) -> str:
    """Exact two-sided p per row of ``source``, from log factorials."""
    fact = (
        "-(lgamma(x+1)+lgamma(fa+fb-x+1)+lgamma(fa+fc-x+1)+lgamma(fd-fa+x+1))"
    )
    rows = f"SELECT {key}, CAST({a} AS DOUBLE) AS fa, CAST({b} AS DOUBLE) AS fb, CAST({c} AS DOUBLE) AS fc, CAST({d} AS DOUBLE) AS fd FROM {source}"
    tables = (
        f"SELECT r.*, CAST(unnest(range(CAST(greatest(0, fa-fd) AS BIGINT), CAST(least(fa+fb, fa+fc) AS BIGINT)+1)) AS DOUBLE) AS x FROM ({rows}) r"
    )
    logs = f"SELECT *, {fact} AS l, {fact.replace('x', 'fa')} AS seen FROM ({tables})"
    return (
        f"SELECT {key}, CASE WHEN any_value(fa+fb)>0 AND any_value(fc+fd)>0 THEN"
        " least(1e0, sum(CASE WHEN exp(l-seen)<=1e0+1e-9 THEN exp(l-seen) ELSE 0e0 END)/sum(exp(l-seen))) END AS fisher_p"
        f" FROM ({logs}) GROUP BY 1"
    )


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = 1.959964
    centre = f"(({k}/{n}+{z * z!r}/(2e0*{n}))/(1e0+{z * z!r}/{n}))"
    half = f"({z!r}*sqrt(({k}/{n})*(1e0-{k}/{n})/{n}+{z * z!r}/(4e0*{n}*{n}))/(1e0+{z * z!r}/{n}))"
    return f"greatest(0e0,{centre}-{half})", f"least(1e0,{centre}+{half})"


cte(
    "ztab",
    """
SELECT split, CAST(sum(a+b) AS DOUBLE) AS zn, CAST(sum(a) AS DOUBLE) AS zk, CAST(sum(c+d) AS DOUBLE) AS cn, CAST(sum(c) AS DOUBLE) AS ck,
 coalesce(sum(a*d/(a+b+c+d)) FILTER (a+b>0 AND c+d>0),0e0) AS num, coalesce(sum(b*c/(a+b+c+d)) FILTER (a+b>0 AND c+d>0),0e0) AS den,
 count(*) FILTER (a+b>0 AND c+d>0) AS quadrants
FROM (SELECT split, field_id, CAST(count(*) FILTER (proximity_group='zone' AND recovered) AS DOUBLE) AS a, CAST(count(*) FILTER (proximity_group='zone' AND NOT recovered) AS DOUBLE) AS b,
 CAST(count(*) FILTER (proximity_group='control' AND recovered) AS DOUBLE) AS c, CAST(count(*) FILTER (proximity_group='control' AND NOT recovered) AS DOUBLE) AS d
 FROM trace WHERE role='primary' AND rate_eligible AND baseline_eligible AND proximity_group IN ('zone','control') GROUP BY 1,2) GROUP BY 1
""",
)
(_L1, _U1), (_L2, _U2) = _wilson_sql("zk", "zn"), _wilson_sql("ck", "cn")
_SIGNIFICANT = f"coalesce(fisher_p<{D.CLAIM_ALPHA!r},false)"
_ODDS = "(mh IS NULL OR mh<1e0)"
_CLAIM = f"(zn>={D.CLAIM_MIN_ZONE} AND {_SIGNIFICANT} AND coalesce(diff<0,false) AND {_ODDS})"


@query(
    "zone_decision",
    with_ctes(
        f"""
SELECT split, CAST(zn AS BIGINT) AS zone_n, CAST(zk AS BIGINT) AS zone_recovered, CAST(cn AS BIGINT) AS control_n,
 CAST(ck AS BIGINT) AS control_recovered, round(fisher_p,9) AS fisher_p, round(mh,9) AS mh_odds_ratio, CAST(quadrants AS BIGINT) AS mh_quadrants,
 round(diff,9) AS difference, round(lo,9) AS newcombe_low, round(hi,9) AS newcombe_high, {_CLAIM} AS claimed,
 CASE WHEN {_CLAIM} THEN 'penalty claimed' WHEN zn<{D.CLAIM_MIN_ZONE} THEN 'not demonstrated: ' || CAST(zn AS BIGINT) || ' zone targets < {D.CLAIM_MIN_ZONE}'
  WHEN fisher_p IS NULL OR fisher_p>={D.CLAIM_ALPHA!r} THEN 'not demonstrated: no significant zone/control difference'
  ELSE 'not demonstrated: difference not lower in zone or not in shared quadrants' END AS verdict,
 CASE WHEN zn<{D.CONFIRM_MIN_ZONE} OR cn<{D.CONFIRM_MIN_CONTROL} THEN 'INCONCLUSIVE' WHEN diff<0 AND {_SIGNIFICANT} AND {_ODDS} THEN 'CONFIRMED'
  WHEN lo>-{D.NOT_REPRODUCED_MARGIN!r} THEN 'NOT REPRODUCED' ELSE 'INCONCLUSIVE' END AS classification
FROM (SELECT z.*, f.fisher_p, CASE WHEN den>0 THEN num/den WHEN num>0 THEN CAST('Infinity' AS DOUBLE) END AS mh,
 zk/nullif(zn,0)-ck/nullif(cn,0) AS diff,
 CASE WHEN zn>0 AND cn>0 THEN zk/zn-ck/cn-sqrt(pow(zk/zn-{_L1},2)+pow({_U2}-ck/cn,2)) END AS lo,
 CASE WHEN zn>0 AND cn>0 THEN zk/zn-ck/cn+sqrt(pow({_U1}-zk/zn,2)+pow(ck/cn-{_L2},2)) END AS hi
 FROM ztab z JOIN ({fisher_sql("ztab", "split", "zk", "zn-zk", "ck", "cn-ck")}) f USING (split))
"""
    ),
)
def zone_decision(spark, sf):
    out = D.zone_contrast(traces(spark, sf), ["split"])
    rounded = {"fisher_p", "mh_odds_ratio", "difference", "newcombe_low", "newcombe_high"}
    return out.selectExpr(*[f"round({c},9) AS {c}" if c in rounded else c for c in out.columns])


cte(
    "loo",
    """
SELECT s.star, CAST(sum(CASE WHEN proximity_group='zone' THEN 1 ELSE 0 END) AS BIGINT) AS zone_n,
 CAST(sum(CASE WHEN proximity_group='zone' AND recovered THEN 1 ELSE 0 END) AS BIGINT) AS zone_recovered,
 CAST(sum(CASE WHEN proximity_group='control' THEN 1 ELSE 0 END) AS BIGINT) AS control_n,
 CAST(sum(CASE WHEN proximity_group='control' AND recovered THEN 1 ELSE 0 END) AS BIGINT) AS control_recovered
FROM (SELECT DISTINCT star FROM trace) s JOIN trace t ON t.star<>s.star
WHERE role='primary' AND rate_eligible AND baseline_eligible GROUP BY 1
""",
)


@query(
    "leave_one_star_out",
    with_ctes(
        "SELECT l.*, round(f.fisher_p,9) AS fisher_p FROM loo l JOIN ("
        + fisher_sql("loo", "star", "zone_recovered", "zone_n-zone_recovered", "control_recovered", "control_n-control_recovered")
        + ") f USING (star)"
    ),
)
def leave_one_star_out(spark, sf):
    t = traces(spark, sf)
    stars = t.select("field_id", "star").distinct()
    return D.leave_one_out(t.drop("star"), stars).withColumn("fisher_p", F.round("fisher_p", 9))


@query(
    "recovery_rates",
    with_ctes(
        """
SELECT split, proximity_group, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (recovered) AS BIGINT) AS k FROM trace GROUP BY 1,2
""".replace(
            "SELECT split",
            "SELECT split, proximity_group, n, k, round(greatest(0,(k/n+3.841458881296/(2*n))/(1+3.841458881296/n)"
            "-1.959964*sqrt(k/n*(1-k/n)/n+3.841458881296/(4*n*n))/(1+3.841458881296/n)),6) AS low,"
            " round(least(1,(k/n+3.841458881296/(2*n))/(1+3.841458881296/n)+1.959964*sqrt(k/n*(1-k/n)/n+3.841458881296/(4*n*n))/(1+3.841458881296/n)),6) AS high FROM (SELECT split",
        ).strip()
        + ")"
    ),
)
def recovery_rates(spark, sf):
    low, high = wilson("k", "n")
    return (
        traces(spark, sf)
        .groupBy("split", "proximity_group")
        .agg(F.count("*").alias("n"), F.count_if("recovered").alias("k"))
        .selectExpr("split", "proximity_group", "n", "k", f"round({low},6) AS low", f"round({high},6) AS high")
    )
