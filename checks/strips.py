"""Samples for looking at, compact reports, populations and field names."""

from checks import data
from checks.metrics import _L1, _L2, _ODDS, _SIGNIFICANT, _U2, feature_scores, fisher_sql, positives, traces
from checks.registry import cte, query, sep, with_ctes
from checks.review import identified
from checks.selection import exposures
from checks.stars import _BIN, field_stars, radial_rows, tracklet_rows
from checks.targets import frame_traces, targets
from driftline.functions import classify as C
from driftline.operators import decisions as D
from driftline.operators import metrics as M
from driftline.operators import samples as V
from driftline.operators import stars as S
from driftline.operators import targets as G
from driftline.operators.ordered import cut_lineage
from driftline.plans import evidence

_SEP = [f"sep_{i}" for i in range(5)]


def sample_sql(parts: list[tuple[str, int, str]], keys: str, salt: str, ids: str) -> str:
    """``parts``: label, quota, FROM and WHERE of the rows; ``ids``: the hashed columns."""
    rows = " UNION ALL ".join(f"SELECT {keys}, '{n}' AS label, {q} AS quota, {ids} AS ids, {g} AS grp FROM {t}" for n, q, t, g in parts)
    return (
        f"SELECT {keys}, label FROM (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY sha256('{salt}:' || ids)) AS n"
        f" FROM ({rows})) WHERE n<=quota"
    )


# --- tracklets around the bright star of their field ---

cte(
    "brow",
    f"""
SELECT field_id, tracklet_id, status, identification, sp AS separation, CASE WHEN sp IS NOT NULL THEN {_BIN} END AS bin FROM (
 SELECT t.build_id AS field_id, t.build_id || '.' || t.tracklet_no AS tracklet_id, i.status, i.istat AS identification,
  min({sep('t.ra','t.dec','s.star_ra','s.star_dec')}) AS sp
 FROM tmean t JOIN ident i USING (build_id, tracklet_no) LEFT JOIN star s ON s.field_id=t.build_id AND s.v_mag<=6.5e0 GROUP BY 1,2,3,4)
""",
)
cte(
    "bsamp",
    sample_sql(
        [
            ("near_unknown", 6, "brow WHERE status='built' AND identification='unknown' AND separation<600", "field_id"),
            ("control_unknown", 2, "brow WHERE status='built' AND identification='unknown' AND bin=6", "field_id"),
            ("known", 2, "brow WHERE status='built' AND identification='known'", "field_id"),
        ],
        "field_id, tracklet_id", "AS-032", "field_id || ':' || tracklet_id",
    ),
)


def bright_rows(spark, sf):
    ids = identified(spark, sf).selectExpr(
        "build_id AS field_id", "tracklet_no", "status", "identification_status AS identification"
    )
    bin_no = f"CASE WHEN separation IS NOT NULL THEN {C.bin_index('separation', C.RADIAL_EDGES)} END"
    rows = radial_rows(spark, sf).select("field_id", "tracklet_no", "separation").join(ids, ["field_id", "tracklet_no"])
    return cut_lineage(
        rows.selectExpr(
            "field_id", "concat(field_id, '.', tracklet_no) AS tracklet_id", "status", "identification", "separation",
            f"{bin_no} AS bin",
        )
    )


@query("bright_star_sample", with_ctes("SELECT * FROM bsamp"))
def bright_star_sample(spark, sf):
    return V.bright_star_sample(bright_rows(spark, sf)).select("field_id", "tracklet_id", "label")


@query(
    "compact_report",
    with_ctes(
        "SELECT field_id, tracklet_id, split_part(tracklet_id,'.',-1) AS short_id, status, identification FROM brow b WHERE identification='known'"
        " OR EXISTS (SELECT 1 FROM bsamp s WHERE s.field_id=b.field_id AND s.tracklet_id=b.tracklet_id)"
    ),
)
def compact_report(spark, sf):
    rows = bright_rows(spark, sf)
    return V.compact(rows, V.bright_star_sample(rows)).selectExpr(
        "field_id", "tracklet_id", f"{V.short_id('tracklet_id')} AS short_id", "status", "identification"
    )


# --- known and unknown tracklets by star class ---

cte(
    "crow",
    "SELECT p.*, p.field_id || '.' || p.tracklet_no AS item_id, i.istat FROM sprox p JOIN ident i ON i.build_id=p.field_id AND i.tracklet_no=p.tracklet_no WHERE i.status='built'",
)


@query(
    "class_sample",
    with_ctes(
        sample_sql(
            [
                ("known_near", 12, "crow WHERE istat='known' AND least(sep_0,sep_1,sep_2,sep_3)<120", "1"),
                ("unknown_near_6-8", 3, "crow WHERE istat='unknown' AND sep_2<60", "1"),
                ("unknown_near_8-10", 3, "crow WHERE istat='unknown' AND sep_3<60", "1"),
                ("unknown_near_10-11", 3, "crow WHERE istat='unknown' AND sep_4<60", "1"),
                ("unknown_background", 4, "crow WHERE istat='unknown' AND (nearest_separation IS NULL OR nearest_separation>=240)", "1"),
            ],
            "field_id, item_id", "AS-034", "field_id || ':' || item_id",
        )
    ),
)
def class_sample(spark, sf):
    near = S.proximity(tracklet_rows(spark, sf), field_stars(spark, sf), ["field_id", "tracklet_no"])
    ids = identified(spark, sf).selectExpr("build_id AS field_id", "tracklet_no", "status", "identification_status")
    rows = cut_lineage(
        near.join(ids.where("status = 'built'"), ["field_id", "tracklet_no"]).selectExpr(
            "field_id", "concat(field_id, '.', tracklet_no) AS item_id", *_SEP, "nearest_separation", "identification_status"
        )
    )
    return V.class_sample(rows.where("identification_status = 'known'"), rows.where("identification_status = 'unknown'"))


# --- targets by outcome ---

_GROUP = """CASE WHEN coalesce(least(sep_0,sep_1)<120,false) OR coalesce(sep_2<60,false) OR coalesce(sep_3<30,false) THEN 'zone'
 WHEN least(sep_0,sep_1,sep_2,sep_3)<240 THEN 'outer' WHEN coalesce(least(sep_0,sep_1,sep_2,sep_3)>=480,true) AND coalesce(sep_4>=60,true) THEN 'control'
 ELSE 'intermediate' END"""
# Two names stand for the ones that are looked at again.
REVISITS = ("K7", "K11")
cte(
    "vtrace",
    "SELECT *, " + _GROUP + " AS grp FROM (SELECT o.build_id AS field_id, o.designation, o.role, o.recovered, e.rate_eligible, e.baseline_eligible,"
    " CASE WHEN ascii(right(o.designation,1))%2=1 THEN 'R' ELSE 'N' END AS population, "
    + ", ".join(f"round(min(sp) FILTER (mag_class={c}),2) AS sep_{c}" for c in range(5))
    + ", round(min(sp),2) AS nearest_separation FROM outc o JOIN telig e USING (build_id, designation) JOIN (SELECT e.build_id, e.designation, s.mag_class, "
    + sep("e.predicted_ra", "e.predicted_dec", "s.star_ra", "s.star_dec")
    + " AS sp FROM eph e LEFT JOIN fstar s ON s.field_id=e.build_id) x USING (build_id, designation) GROUP BY 1,2,3,4,5,6,7)",
)
_ELIGIBLE = "vtrace WHERE rate_eligible AND baseline_eligible"
_NEAR = "least(sep_0,sep_1,sep_2,sep_3)<120"
cte(
    "rsamp",
    sample_sql(
        [
            ("near_recovered", 8, f"{_ELIGIBLE} AND {_NEAR} AND recovered", "1"),
            ("near_lost", 8, f"{_ELIGIBLE} AND {_NEAR} AND NOT recovered", "1"),
            ("control_recovered", 2, f"{_ELIGIBLE} AND grp='control' AND recovered", "1"),
            ("control_lost", 2, f"{_ELIGIBLE} AND grp='control' AND NOT recovered", "1"),
        ],
        "field_id, designation", "AS-035", "field_id || ':' || designation",
    ),
)


def outcomes(spark, sf):
    """Targets with outcome, eligibility, population and proximity group."""
    tgt = targets(spark, sf)
    out = G.target_outcomes(tgt, frame_traces(spark, sf, tgt), identified(spark, sf)).selectExpr(
        "build_id AS field_id", "designation", "role", "recovered"
    )
    able = G.with_eligibility(tgt).selectExpr("build_id AS field_id", "designation", "rate_eligible", "baseline_eligible")
    key = ["field_id", "designation"]
    spots = data.ephemerides(spark, sf).selectExpr(
        "build_id AS field_id", "designation", "frame_no", "predicted_ra AS ra", "predicted_dec AS dec"
    )
    near = S.closest_approach(S.proximity(spots, field_stars(spark, sf), [*key, "frame_no"]), key)
    return cut_lineage(
        out.join(able, key).join(near, key).selectExpr(
            *key, "role", "recovered", "rate_eligible", "baseline_eligible", *_SEP, "nearest_separation",
            "IF(ascii(right(designation, 1)) % 2 = 1, 'R', 'N') AS population", f"{C.proximity_group(_SEP)} AS proximity_group",
        )
    )


@query(
    "recovery_sample",
    with_ctes(
        "SELECT * FROM rsamp UNION ALL SELECT field_id, designation, 'revisit' AS label FROM vtrace v WHERE population='R' AND designation IN "
        + str(REVISITS) + " AND NOT EXISTS (SELECT 1 FROM rsamp r WHERE r.field_id=v.field_id AND r.designation=v.designation)"
    ),
)
def recovery_sample(spark, sf):
    return V.recovery_sample(outcomes(spark, sf), REVISITS)


@query(
    "confirmation_sample",
    with_ctes(
        sample_sql(
            [
                (f"{g}_{n}", q, f"{_ELIGIBLE} AND role='primary' AND grp='{g}' AND {c}", "1")
                for g, q in (("zone", 6), ("control", 2))
                for n, c in (("recovered", "recovered"), ("lost", "NOT recovered"))
            ],
            "field_id, designation", "AS-036", "field_id || ':' || designation",
        )
    ),
)
def confirmation_sample(spark, sf):
    return V.confirmation_sample(outcomes(spark, sf))


# An object whose passage comes within the trigger's reach of a star selects its field.
@query(
    "trigger_members",
    with_ctes("SELECT field_id, designation, role='primary' AND coalesce(nearest_separation<120,false) AS is_trigger FROM vtrace"),
)
def trigger_members(spark, sf):
    rows = outcomes(spark, sf)
    passages = rows.where("role = 'primary' AND nearest_separation < 120D").select("field_id", "designation")
    # One row per exposure of the passage.
    triggers = passages.selectExpr("*", "explode(sequence(1, 3)) AS exposure")
    return V.trigger_members(rows, triggers).select("field_id", "designation", "is_trigger")


# --- missed positives and background of the shortlist ---

_SHORT = """(SELECT field_id, tracklet_id, (rank() OVER (PARTITION BY field_id ORDER BY score DESC)-1+5e-1*count(*) OVER (PARTITION BY field_id, score))
 /count(*) OVER (PARTITION BY field_id) AS q FROM scored WHERE label='background') WHERE q<=0.05"""


@query(
    "sealed_sample",
    with_ctes(
        sample_sql([("missed_positive", 12, "(SELECT field_id, designation AS item_id FROM rpos p WHERE q>0.05)", "1"),
                    ("shortlist_background", 20, f"(SELECT field_id, tracklet_id AS item_id FROM {_SHORT})", "1")],
                   "field_id, item_id", "AS-040", "field_id || ':' || item_id")
    ),
)
def sealed_sample(spark, sf):
    comparator = M.rank_positives(feature_scores(spark, sf).where("ranker = 'quantity'"), ["ranker"])
    missed = M.missed_positives(positives(spark, sf), comparator)
    shortlist = data.scored(spark, sf).transform(M.shortlist_background)
    ids = data.scored(spark, sf).select("field_id", "tracklet_no", "tracklet_id").distinct()
    return V.sealed_sample(missed, shortlist.select("field_id", "tracklet_no").join(ids, ["field_id", "tracklet_no"]))


# --- fields of two populations, named by night, survey field, chip and quadrant ---


@query(
    "population_fields",
    with_ctes(
        """
SELECT *, split_part(field_id,'-',1) AS prefix FROM (SELECT DISTINCT CASE filtercode WHEN 'zg' THEN 'N' ELSE 'R' END AS population, CAST(CASE filtercode WHEN 'zg' THEN 0 ELSE 1 END AS INTEGER) AS position,
 'P' || filtercode || '-' || night || '-' || field || '-c' || ccdid || '-q' || qid AS field_id, CASE filtercode WHEN 'zg' THEN 'search zg' ELSE 'earlier (zr)' END AS origin,
 night, CAST(field AS INTEGER) AS survey_field, CAST(ccdid AS INTEGER) AS ccd, CAST(qid AS INTEGER) AS quadrant FROM expo WHERE filtercode<>'zi')
"""
    ),
)
def population_fields(spark, sf):
    named = exposures(spark, sf).selectExpr(
        "filtercode", "concat('P', filtercode, '-', CAST(obsdate AS STRING), '-', field, '-c', ccdid, '-q', qid) AS field_id"
    ).distinct()
    both = V.populations(
        {"N": named.where("filtercode = 'zg'"), "R": named.where("filtercode = 'zr'")},
        {"N": "concat('search ', filtercode)", "R": "concat('earlier (', filtercode, ')')"},
    )
    return V.parse_field_names(both).selectExpr("*", "split_part(field_id, '-', 1) AS prefix")


# --- a confirmation run: new fields are the validation split, earlier ones the others ---

_NO = "CAST(substr(t.{},2) AS BIGINT)"
cte(
    "ctrace",
    f"""
SELECT t.*, u.scope FROM trace t JOIN (VALUES ('validation','new fields'), ('validation','trigger objects'), ('validation','class'), ('validation','pooled'),
 ('development','earlier fields'), ('development','pooled')) AS u(split, scope) ON u.split=t.split
WHERE u.scope<>'trigger objects' OR proximity_group='control' OR mod({_NO.format('designation')},5)=0
""",
)
cte(
    "cfield",
    f"""
SELECT scope, field_id, {", ".join(f"CAST(count(*) FILTER (proximity_group='{g}' AND {r} recovered) AS DOUBLE) AS {n}" for n, g, r in (("a", "zone", ""), ("b", "zone", "NOT"), ("c", "control", ""), ("d", "control", "NOT")))}
FROM (SELECT t.* REPLACE (CASE WHEN scope='class' THEN 'search class ' || mod({_NO.format('field_id')},2) ELSE scope END AS scope) FROM ctrace t
 WHERE role='primary' AND rate_eligible AND baseline_eligible AND proximity_group IN ('zone','control')) GROUP BY 1,2
""",
)
cte(
    "czone",
    """
SELECT scope, sum(a+b) AS zn, sum(a) AS zk, sum(c+d) AS cn, sum(c) AS ck, count(*) FILTER (a+b>0 AND c+d>0) AS quadrants,
 coalesce(sum(a*d/(a+b+c+d)) FILTER (a+b>0 AND c+d>0),0e0) AS num, coalesce(sum(b*c/(a+b+c+d)) FILTER (a+b>0 AND c+d>0),0e0) AS den FROM cfield GROUP BY 1
""",
)


def confirmation(spark, sf):
    rows = cut_lineage(traces(spark, sf))
    field, name = "CAST(substring(field_id,2) AS BIGINT)", "CAST(substring(designation,2) AS BIGINT)"
    new, earlier = rows.where("split = 'validation'"), rows.where("split = 'development'")
    fields = new.selectExpr("field_id", "star", f"CAST(mod({field},2) AS STRING) AS search_class").distinct()
    return evidence.confirmation(new.drop("star"), new.where(f"mod({name},5) = 0"), fields, earlier)


@query(
    "confirmation_decisions",
    with_ctes(
        f"""
SELECT scope, scope='new fields' AS deciding, CAST(zn AS BIGINT) AS zone_n, CAST(zk AS BIGINT) AS zone_recovered, CAST(cn AS BIGINT) AS control_n,
 CAST(ck AS BIGINT) AS control_recovered, CAST(quadrants AS BIGINT) AS mh_quadrants, round(fisher_p,9) AS fisher_p, round(mh,9) AS mh_odds_ratio,
 round(diff,9) AS difference, round(lo,9) AS newcombe_low, CASE WHEN scope<>'new fields' THEN NULL
  WHEN zn<{D.CONFIRM_MIN_ZONE} OR cn<{D.CONFIRM_MIN_CONTROL} THEN 'INCONCLUSIVE' WHEN diff<0 AND {_SIGNIFICANT} AND {_ODDS} THEN 'CONFIRMED'
  WHEN lo>-{D.NOT_REPRODUCED_MARGIN!r} THEN 'NOT REPRODUCED' ELSE 'INCONCLUSIVE' END AS classification
FROM (SELECT z.*, f.fisher_p, CASE WHEN den>0 THEN num/den WHEN num>0 THEN CAST('Infinity' AS DOUBLE) END AS mh, zk/nullif(zn,0)-ck/nullif(cn,0) AS diff,
 CASE WHEN zn>0 AND cn>0 THEN zk/zn-ck/cn-sqrt(pow(zk/zn-{_L1},2)+pow({_U2}-ck/cn,2)) END AS lo
 FROM czone z JOIN ({fisher_sql("czone", "scope", "zk", "zn-zk", "ck", "cn-ck")}) f USING (scope))
"""
    ),
)
def confirmation_decisions(spark, sf):
    out = confirmation(spark, sf).decisions
    rounded = {"fisher_p", "mh_odds_ratio", "difference", "newcombe_low"}
    names = [c for c in out.columns if c not in ("claimed", "verdict", "newcombe_high")]
    return out.selectExpr(*[f"round({c},9) AS {c}" if c in rounded else c for c in names])
