"""Samples, compact reports, populations and field names on small tables."""

import hashlib

import pytest

from driftline.operators import samples as V

SEPS = "sep_0 double, sep_1 double, sep_2 double, sep_3 double, sep_4 double, nearest_separation double"


def first(salt, rows, quota):
    return sorted(rows, key=lambda r: hashlib.sha256(":".join([salt, *r]).encode()).hexdigest())[:quota]


def labelled(df, item):
    out = {}
    for r in df.collect():
        out.setdefault(r.label, set()).add((r.field_id, r[item]))
    return out


def test_bright_star_sample_and_compact(spark):
    rows = [("f", f"f.{i}", "built", "unknown", 10.0 * i, 6 if i > 90 else 0) for i in range(100)]
    rows += [("f", f"f.k{i}", "built", "known", None, None) for i in range(5)]
    rows += [("g", "g.1", "rejected", "known", 5.0, 0), ("g", "g.2", None, None, None, None)]
    df = spark.createDataFrame(
        rows, "field_id string, tracklet_id string, status string, identification string, separation double, bin int"
    ).repartition(7)
    sample = V.bright_star_sample(df)
    got = labelled(sample, "tracklet_id")
    assert got == {
        "near_unknown": set(first("AS-032", [r[:2] for r in rows if r[3] == "unknown" and r[4] < 600], 6)),
        "control_unknown": set(first("AS-032", [r[:2] for r in rows if r[5] == 6], 2)),
        "known": set(first("AS-032", [r[:2] for r in rows if r[2] == "built" and r[3] == "known"], 2)),
    }
    kept = {r.tracklet_id for r in V.compact(df, sample).collect()}
    assert kept == {r[1] for r in rows if r[3] == "known"} | {t for s in got.values() for _, t in s}
    assert V.compact(df, sample.limit(0)).count() == 6
    assert V.bright_star_sample(df.limit(0)).count() == 0


def test_ranks_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("CAST(id % 2 AS STRING) AS field_id", "CAST(id AS STRING) AS tracklet_id")
    sample = V.quota_sample(df, {"a": ("true", 3)}, ["field_id"], "s", ["tracklet_id"])
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sample.count() == 6


def test_class_sample_labels(spark):
    far = (None,) * 5
    rows = [("f", "a", 100.0, None, 300.0, None, None, 100.0), ("f", "b", *far, None), ("f", "c", None, None, 50.0, 40.0, None, 40.0)]
    df = spark.createDataFrame(rows, f"field_id string, item_id string, {SEPS}")
    got = labelled(V.class_sample(df, df), "item_id")
    assert got == {
        "known_near": {("f", "a"), ("f", "c")}, "unknown_near_6-8": {("f", "c")}, "unknown_near_8-10": {("f", "c")},
        "unknown_background": {("f", "b")},
    }


def traces(spark):
    rows = []
    for i in range(40):
        near, recovered = i % 2 == 0, i % 4 < 2
        rows.append(
            ("f", str(i), "R" if i % 5 == 0 else "N", "primary" if i < 36 else "marginal", i != 0, True, recovered,
             "zone" if near else "control", 100.0 if near else None, None, None, None, None, None)
        )
    schema = (
        "field_id string, designation string, population string, role string, rate_eligible boolean,"
        f" baseline_eligible boolean, recovered boolean, proximity_group string, {SEPS}"
    )
    return rows, spark.createDataFrame(rows, schema)


def test_recovery_and_confirmation_samples(spark):
    rows, df = traces(spark)

    def pick(salt, quota, group, recovered, primary=False):
        members = [r[:2] for r in rows if r[4] and r[7] == group and r[6] is recovered and (not primary or r[3] == "primary")]
        return set(first(salt, members, quota))

    got = labelled(V.recovery_sample(df, ("0", "5", "1")), "designation")
    again = got.pop("revisit")
    for group, name, quota in (("zone", "near", 8), ("control", "control", 2)):
        assert got[f"{name}_recovered"] == pick("AS-035", quota, group, True)
        assert got[f"{name}_lost"] == pick("AS-035", quota, group, False)
    # "1" is of the other population; "0" was not eligible, but is looked at again.
    assert again == {("f", d) for d in ("0", "5")} - set().union(*got.values())
    got = labelled(V.confirmation_sample(df), "designation")
    assert got == {
        f"{g}_{n}": pick("AS-036", q, g, n == "recovered", True)
        for g, q in (("zone", 6), ("control", 2)) for n in ("recovered", "lost")
    }


def test_sealed_sample(spark):
    missed = spark.createDataFrame([("f", str(i)) for i in range(20)], "field_id string, designation string")
    short = spark.createDataFrame([("f", f"f.{i}") for i in range(5)], "field_id string, tracklet_id string")
    got = labelled(V.sealed_sample(missed, short), "item_id")
    assert got["missed_positive"] == set(first("AS-040", [("f", str(i)) for i in range(20)], 12))
    assert len(got["shortlist_background"]) == 5


def test_repeated_rows_and_null_names(spark):
    df = spark.createDataFrame(
        [("f", "a", 1), ("f", "a", 1), ("f", "a", 2), (None, None, 3), (None, None, 3)], "field_id string, x string, label_no int"
    )
    got = V.quota_sample(df, {"all": ("true", 2)}, ["field_id"], "s", ["field_id", "x"])
    assert sorted(map(str, got.collect())) == sorted(
        map(str, V.quota_sample(df.repartition(4), {"all": ("true", 2)}, ["field_id"], "s", ["field_id", "x"]).collect())
    )
    assert got.count() == 4


def test_trigger_members_and_populations(spark):
    rows, df = traces(spark)
    triggers = spark.createDataFrame([("f", "3"), ("f", "3"), ("g", "4"), (None, "5")], "field_id string, designation string")
    got = {r.designation: r.is_trigger for r in V.trigger_members(df, triggers).collect()}
    assert len(got) == len(rows) and [d for d, t in got.items() if t] == ["3"]
    fields = spark.createDataFrame([("a",), ("b",)], "field_id string")
    both = V.populations({"N": fields, "R": fields.limit(0)}, {"N": "concat('search ', field_id)", "R": "'stored'"})
    assert [tuple(r) for r in both.orderBy("field_id").collect()] == [("N", 0, "a", "search a"), ("N", 0, "b", "search b")]


def test_field_names(spark):
    df = spark.createDataFrame([("AS-x-2019-03-04-604-c07-q3",), ("2019-03-04-1-c1-q4",)], "field_id string")
    got = [tuple(r)[1:] for r in V.parse_field_names(df).collect()]
    assert got == [("2019-03-04", 604, 7, 3), ("2019-03-04", 1, 1, 4)]
    for bad in ("2019-03-04-1-c1-q44", "604-c1-q2", None):
        broken = V.parse_field_names(spark.createDataFrame([(bad,)], "field_id string"))
        with pytest.raises(Exception, match="another form"):
            broken.where("quadrant > 99").collect()
    assert V.parse_field_names(df.limit(0)).count() == 0
    ids = spark.createDataFrame([("b.1",), ("b.c.2",), ("x",)], "t string").selectExpr(V.short_id("t") + " AS s")
    assert [r.s for r in ids.collect()] == ["1", "2", "x"]
