"""Cone scans: pruned partitions, poles, empty cones, argument ranges."""

import math
import random

import pytest

from driftline.sources import ephemerides as E

EPHEMERIS = "designation string, epoch_jd double, predicted_ra double, predicted_dec double, position_error_arcsec double"
CONE = "cone_id long, center_ra double, center_dec double, radius_deg double, epoch_jd double"
JD = 2458000.0


def distance(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x, y = math.sin((b - d) / 2), math.sin((a - c) / 2)
    return math.degrees(2 * math.asin(math.sqrt(min(1.0, x * x + math.cos(b) * math.cos(d) * y * y))))


@pytest.fixture(scope="module")
def predictions():
    rng = random.Random(4)
    rows = [(f"o{k}", JD + rng.randrange(4) / 2, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1))), 1.0) for k in range(3000)]
    return rows + [("none", None, 1.0, 1.0, 1.0), ("nowhere", JD, None, 1.0, 1.0), ("pole", JD, 77.0, 90.0, 9e9), ("wrap", JD, 359.99, 0.0, None)]


def test_cones_hold_what_plain_distances_hold(spark, predictions):
    rng = random.Random(5)
    cones = [(k, rng.uniform(0, 360), rng.uniform(-90, 90), rng.uniform(0.1, 10.0), JD + rng.randrange(4) / 2) for k in range(60)]
    cones += [(100, 0.0, 90.0, 0.5, JD), (101, 0.01, 0.0, 0.1, JD), (102, 10.0, 10.0, 5.0, JD + 0.123), (103, 200.0, -90.0, 10.0, JD + 0.5), (104, 0.0, 79.99, 10.0, JD)]
    table = E.with_partition(spark.createDataFrame(predictions, EPHEMERIS))
    objects, fields = E.cone_scan(table, spark.createDataFrame(cones, CONE), ["cone_id"])
    want = {
        (c, o) for c, ra, dec, r, t in cones for o, jd, a, d, _ in predictions
        if jd == t and a is not None and distance(ra, dec, a, d) <= r
    }
    got = objects.collect()
    assert {(r.cone_id, r.designation) for r in got} == want and len(got) == len(want)
    assert {(100, "pole"), (101, "wrap")} <= want
    assert {r.cone_id: r.objects for r in fields.collect()} == {c[0]: sum(w[0] == c[0] for w in want) for c in cones}
    # Empty on either side.
    objects, fields = E.cone_scan(table.limit(0), spark.createDataFrame(cones, CONE), ["cone_id"])
    assert objects.count() == 0 and fields.where("objects = 0").count() == len(cones)
    objects, fields = E.cone_scan(table, spark.createDataFrame([], CONE), ["cone_id"])
    assert objects.count() == fields.count() == 0


def test_stored_predictions_are_pruned(spark, predictions, tmp_path):
    path = str(tmp_path / "eph")
    E.store_predictions(spark.createDataFrame(predictions, EPHEMERIS), path)
    E.store_predictions(spark.createDataFrame(predictions, EPHEMERIS).where("epoch_jd < 2458001"), path)  # an attempt again
    stored = spark.read.parquet(path)
    assert stored.count() == len(predictions) - 2
    objects, _ = E.cone_scan(stored, spark.createDataFrame([(1, 0.0, 0.0, 2.0, JD)], CONE), ["cone_id"])
    assert "wrap" in {r.designation for r in objects.collect()}
    plan = objects._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


@pytest.mark.parametrize(
    "bad", [(360.0, 0.0, 1.0, JD), (1.0, 90.5, 1.0, JD), (1.0, 0.0, 0.0, JD), (1.0, 0.0, 10.5, JD), (1.0, 0.0, 1.0, 1.0), (None, 0.0, 1.0, JD), (1.0, 0.0, 1.0, None)]
)
def test_arguments_out_of_range_stop(spark, predictions, bad):
    table = E.with_partition(spark.createDataFrame(predictions[:5], EPHEMERIS))
    with pytest.raises(Exception, match="cone out of range"):
        E.cone_scan(table, spark.createDataFrame([(1, *bad)], CONE), ["cone_id"])[0].collect()


def test_cones_of_quadrants_and_tracklets(spark):
    corners = [{"ra": 10.4, "dec": 0.4}, {"ra": 9.6, "dec": 0.4}, {"ra": 9.6, "dec": -0.4}, {"ra": 10.4, "dec": -0.4}]
    frames = spark.createDataFrame(
        [(7, 10.0, 0.0, corners, JD)],
        "product_id long, center_ra double, center_dec double, corners array<struct<ra:double,dec:double>>, mid_exposure_jd double",
    )
    (row,) = E.quadrant_cones(frames).collect()
    assert row.radius_deg == pytest.approx(distance(10.0, 0.0, 10.4, 0.4) + 60 / 3600)
    members = spark.createDataFrame([(1, 0, 10.0, 0.0), (1, 2, 10.2, 0.0)], "build_id long, frame_no int, ra double, dec double")
    times = spark.createDataFrame([(1, 0, JD), (1, 1, JD + 0.1), (1, 2, JD + 0.2), (2, 0, JD)], "build_id long, frame_no int, mid_exposure_jd double")
    got = E.tracklet_cones(members, times, 3.0).orderBy("frame_no").collect()
    assert [(r.build_id, r.frame_no, r.epoch_jd) for r in got] == [(1, 0, JD), (1, 2, JD + 0.2)]
    assert got[0].radius_deg == pytest.approx(0.1 + 3 / 3600)


def test_pairs_of_a_cell_are_no_rows_before_they_are_a_result(spark, predictions):
    table = E.with_partition(spark.createDataFrame(predictions, EPHEMERIS))
    found = E.cone_scan(table, spark.createDataFrame([(1, 0.0, 0.0, 2.0, JD)], CONE), ["cone_id"])
    for df in found:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" not in plan and "FlatMapGroupsInArrow" in plan


def test_many_objects_around_one_cone_come_in_blocks(spark):
    """More than one block of rows; objects on the border count."""
    rows = [(f"o{k}", JD, 10.0 + k / 1e5, 0.0, None) for k in range(E._OUTPUT_ROWS // 400)]
    rows += [("border", JD, 9.0, 0.0, None), ("outside", JD, 8.9999999, 0.0, None)]
    table = E.with_partition(spark.createDataFrame(rows, EPHEMERIS)).crossJoin(spark.range(450).withColumnRenamed("id", "copy"))
    cones = spark.createDataFrame([(1, 10.0, 0.0, 1.0, JD), (2, 190.0, 0.0, 1.0, JD)], CONE)
    objects, fields = E.cone_scan(table, cones, ["cone_id"])
    names = {r.designation: r["count"] for r in objects.groupBy("designation").count().collect()}
    assert set(names) == {r[0] for r in rows} - {"outside"} and set(names.values()) == {450}
    assert {r.cone_id: r.objects for r in fields.collect()} == {1: 450 * (len(rows) - 1), 2: 0}


def test_a_scan_tells_what_is_asked_in_runs(spark):
    """Only the named columns travel, the sizes of cones copy a prediction four times
    at most, and the cones of a prediction follow one another."""
    predictions = spark.createDataFrame([(f"o{k}", JD, 10.0 + k / 1e3, 0.0, f"long text {k}") for k in range(50)], "designation string, epoch_jd double, predicted_ra double, predicted_dec double, note string")
    radii = (0.1, 0.26, 0.6, 1.1, 2.1, 4.1, 9.0)
    cones = spark.createDataFrame([(c, 10.0 + c / 1e4, 0.0, radii[c % 7], JD) for c in range(70)], "cone_id long, center_ra double, center_dec double, radius_deg double, epoch_jd double")
    objects, fields = E.cone_scan(E.with_partition(predictions), cones, ["cone_id"], ["designation"])
    assert objects.columns == ["cone_id", "designation"]
    plan = objects._jdf.queryExecution().optimizedPlan().toString()
    assert "note#" not in plan.split("FlatMapGroupsInArrow")[0] and "14400.0" in plan and "1800.0" not in plan
    whole = E.cone_scan(E.with_partition(predictions), cones, ["cone_id"])[0]
    got = [tuple(r) for r in objects.collect()]
    assert sorted(got) == sorted((r.cone_id, r.designation) for r in whole.collect()) and len(got) == 70 * 50
    assert sum(r.objects for r in fields.collect()) == len(got)
    # One cell of the largest cones: each prediction's cones in one run.
    large = E.cone_scan(E.with_partition(predictions), cones.where("radius_deg > 4"), ["cone_id"], ["designation"])[0].coalesce(1).collect()
    assert sum(a.designation != b.designation for a, b in zip(large, large[1:])) < len(large) / 5
