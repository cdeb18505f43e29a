"""The confirmation job against plain counts."""

import random

from driftline.plans import evidence

SCHEMA = (
    "field_id string, designation string, role string, rate_eligible boolean, baseline_eligible boolean,"
    " proximity_group string, recovered boolean"
)


def rows_of(prefix, fields, n, seed):
    rng = random.Random(seed)
    return [
        (f"{prefix}{i % fields}", f"{prefix}-{i}", rng.choice(["primary", "primary", "marginal"]), rng.random() < 0.9,
         rng.random() < 0.9, rng.choice(["zone", "control", "outer"]), rng.random() < 0.6)
        for i in range(n)
    ]


def counts(rows):
    good = [r for r in rows if r[2] == "primary" and r[3] and r[4]]
    return tuple(
        sum(1 for r in good if r[5] == g and (not hit or r[6])) for g in ("zone", "control") for hit in (False, True)
    )


def test_confirmation(spark):
    new, old = rows_of("n", 6, 300, 1), rows_of("o", 4, 200, 2)
    triggers = [(f, d) for f, d, *_ in new[::7]]
    fields = [(f"n{i}", f"star {i // 2}", "V<6" if i < 3 else "6-8") for i in range(6)]
    job = evidence.confirmation(
        spark.createDataFrame(new, SCHEMA), spark.createDataFrame(triggers * 2, "field_id string, designation string"),
        spark.createDataFrame(fields, "field_id string, star string, search_class string"), spark.createDataFrame(old, SCHEMA),
    )
    got = {r.scope: r for r in job.decisions.collect()}
    kind = {f: c for f, _, c in fields}
    want = {
        "new fields": new, "earlier fields": old, "pooled": new + old,
        "trigger objects": [r for r in new if r[:2] in set(triggers) or r[5] == "control"],
        **{f"search class {c}": [r for r in new if kind[r[0]] == c] for c in ("V<6", "6-8")},
    }
    assert set(got) == set(want)
    for scope, members in want.items():
        r = got[scope]
        assert (r.zone_n, r.zone_recovered, r.control_n, r.control_recovered) == counts(members)
        assert r.deciding == (scope == "new fields") and (r.classification is not None) == r.deciding
    for r in job.leave_one_out.collect():
        rest = [x for x in new if f"star {int(x[0][1:]) // 2}" != r.star]
        assert (r.zone_n, r.zone_recovered, r.control_n, r.control_recovered) == counts(rest)
    assert job.traces.where("is_trigger").count() == len(triggers)
    labels = {r.label: r["count"] for r in job.sample.groupBy("label").count().collect()}
    assert labels == {"zone_recovered": 6, "zone_lost": 6, "control_recovered": 2, "control_lost": 2}


def test_confirmation_without_earlier_fields_or_rows(spark):
    new = spark.createDataFrame(rows_of("n", 2, 40, 3), SCHEMA)
    fields = spark.createDataFrame([("n0", "s", "V<6")], "field_id string, star string, search_class string")
    none = spark.createDataFrame([], "field_id string, designation string")
    got = {r.scope: r.zone_n for r in evidence.confirmation(new, none, fields).decisions.collect()}
    # A field without a search is in no class, but among all fields.
    assert set(got) == {"new fields", "trigger objects", "search class V<6"} and got["trigger objects"] == 0
    assert got["search class V<6"] < got["new fields"]
    empty = evidence.confirmation(new.limit(0), none, fields)
    assert empty.decisions.count() == 0 and empty.sample.count() == 0
