"""Cone scans: predictions from orders, cones from suppliers, over the whole
sky with both poles and right ascension zero."""

from checks import data
from checks.registry import cte, query, sep, with_ctes
from driftline.sources import ephemerides as E

_PREDICTION = {
    "designation": "o_orderkey",
    "epoch_jd": "2.458e6+mod(o_custkey,7)/1e1",
    "predicted_ra": "mod(o_orderkey*7919,360000)/1e3",
    "predicted_dec": "mod(o_orderkey*104729,180000)/1e3-9e1",
}
_CONE = {
    "cone_id": "s_suppkey",
    "center_ra": "CASE WHEN mod(s_suppkey,3)=0 THEN mod(359000+mod(s_suppkey*173,2000),360000)/1e3 ELSE mod(s_suppkey*6007,360000)/1e3 END",
    "center_dec": "CASE WHEN mod(s_suppkey,5)=0 THEN 8.8e1 WHEN mod(s_suppkey,5)=1 THEN -8.95e1 ELSE mod(s_suppkey*3571,160000)/1e3-8e1 END",
    "radius_deg": "1.00037e-1+mod(s_suppkey*7,90)/1e1",
    "epoch_jd": "2.458e6+mod(s_suppkey,9)/1e1",
}


def scan(spark, sf, columns=None):
    predictions = data.read(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _PREDICTION.items()])
    cones = data.read(spark, sf, "supplier").selectExpr(*[f"{e} AS {n}" for n, e in _CONE.items()])
    return E.cone_scan(E.with_partition(predictions), cones, ["cone_id"], columns)


cte("kpred", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PREDICTION.items()) + " FROM orders")
cte("kcone", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CONE.items()) + " FROM supplier")
cte(
    "kin",
    "SELECT c.cone_id, p.designation FROM kcone c JOIN kpred p ON round(c.epoch_jd*8.64e7)=round(p.epoch_jd*8.64e7)"
    f" AND {sep('predicted_ra', 'predicted_dec', 'center_ra', 'center_dec')}<=radius_deg*3.6e3",
)


@query("known_objects_in_cones", with_ctes("SELECT cone_id, designation FROM kin"))
def known_objects_in_cones(spark, sf):
    return scan(spark, sf, ["designation"])[0].select("cone_id", "designation")


@query(
    "cone_fields",
    with_ctes("SELECT c.cone_id, count(k.designation) AS objects FROM kcone c LEFT JOIN kin k USING (cone_id) GROUP BY 1"),
)
def cone_fields(spark, sf):
    return scan(spark, sf)[1].select("cone_id", "objects")
