"""Footprint searches: wrap, corner order, gaps in the input, limits."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.operators import coverage as C
from driftline.operators import quads

EXPOSURE = "pid long, obsjd double, maglimit double, corners array<struct<ra:double,dec:double>>"
POSITION = "star_id long, ra double, dec double, radius_deg double, start_jd double, end_jd double"


def square(ra, dec, half, order=(0, 1, 2, 3)):
    corners = [((ra - half) % 360, dec - half), ((ra + half) % 360, dec - half), ((ra + half) % 360, dec + half), ((ra - half) % 360, dec + half)]
    return [{"ra": corners[k][0], "dec": corners[k][1]} for k in order]


@pytest.fixture(scope="module")
def exposures(spark):
    rows = [
        (1, 100.0, 20.0, square(0.1, 0.0, 0.4)), (2, 100.5, 20.5, square(359.9, 0.0, 0.4, (0, 2, 1, 3))), (3, 101.0, None, square(0.0, 0.0, 0.4)),
        (4, 140.0, 21.0, square(0.0, 0.0, 0.4)), (5, None, 21.0, square(0.0, 0.0, 0.4)), (6, 100.2, 21.0, None),
        (7, 100.3, 21.0, [*square(0.0, 0.0, 0.4)[:3], {"ra": None, "dec": 0.0}]), (8, 100.4, 21.0, square(10.0, 0.0, 6.0)), (9, 100.1, 20.0, square(0.9, 0.0, 0.4)),
    ]
    return spark.createDataFrame(rows, EXPOSURE)


def test_positions_meet_footprints(spark, exposures):
    rows = [(1, 359.8, 0.1, 0.1, 99.0, 102.0), (2, 0.0, 0.0, 0.1, 100.5, 200.0), (3, 12.0, 1.0, 0.1, 99.0, 102.0), (4, None, 0.0, 0.1, 99.0, 102.0), (5, 0.0, 0.0, 0.1, 102.0, 99.0), (6, 180.0, 5.0, 0.1, 99.0, 102.0)]
    asked = spark.createDataFrame(rows, POSITION)
    for days in (31.0, 0.7):
        got = {(r.star_id, r.pid) for r in C.exposures_at(asked, exposures, ["star_id"], days).collect()}
        assert got == {(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 8)}
    frames, short = C.find_sequences(asked, exposures, ["star_id"], 3)
    assert [(r.star_id, r.frame_no, r.pid) for r in frames.orderBy("star_id", "frame_no").collect()] == [
        (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 4)
    ]
    assert {r.star_id: r.found for r in short.collect()} == {3: 1, 4: 0, 5: 0, 6: 0}
    counts = {r.star_id: (r.exposures, r.deepest) for r in C.coverage_counts(asked, exposures, ["star_id"]).collect()}
    assert counts == {1: (2, 20.5), 2: (2, 21.0), 3: (1, 21.0)}
    assert C.exposures_at(asked, exposures.limit(0), ["star_id"]).count() == 0


def test_boxes_meet_footprints(spark, exposures):
    asked = spark.createDataFrame([(1, 0.0, 0.55, 0.2, 99.0, 102.0), (2, 0.0, 0.65, 0.2, 99.0, 102.0), (3, 0.6, 0.0, 0.15, 99.0, 102.0)], POSITION)
    got = {(r.star_id, r.pid) for r in C.box_searches(asked, exposures, ["star_id"]).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (3, 1), (3, 9)}


@pytest.mark.parametrize("row", [(1, 0.0, 0.0, 2.5, 99.0, 102.0), (1, 0.0, 0.0, 0.5, 99.0, 140.0), (1, 0.0, 0.0, 0.5, 102.0, 102.0)])
def test_limits_stop_a_search(spark, exposures, row):
    with pytest.raises(Exception, match="radius must be|window must be"):
        C.box_searches(spark.createDataFrame([row], POSITION), exposures, ["star_id"]).collect()


def test_buckets_follow_the_windows(spark, exposures):
    short = spark.createDataFrame([(1, 0.0, 0.0, 0.1, 100.4, 100.6), (2, 0.0, 0.0, 0.1, 100.9, 101.1)], POSITION)
    assert abs(C.bucket_length(short, 31.0) - 0.2) < 1e-9
    assert C.bucket_length(short.withColumn("end_jd", F.lit(900.0)), 31.0) == 31.0
    assert C.bucket_length(short.limit(0), 31.0) == 31.0
    assert {(r.star_id, r.pid) for r in C.exposures_at(short, exposures, ["star_id"]).collect()} == {(1, 2), (2, 3)}


def crowd(n, p, seed=1):
    """Footprints about the pole and RA 0 (rotated, dented, doubled) and positions."""
    rng = np.random.default_rng(seed)
    exposures, places = [], []
    for k in range(n):
        ra, dec = (rng.uniform(0, 360), 90 - rng.uniform(0, 1.0)) if k % 3 == 0 else (rng.uniform(-1, 1) % 360, rng.uniform(-1, 1))
        turn, size = rng.uniform(0, 6.3), rng.uniform(0.2, 0.7)
        reach = [size, size, size, size * (0.2 if k % 7 == 0 else rng.uniform(0.8, 1.2))]
        corners = []
        for j in rng.permutation(4):
            a = turn + j * math.pi / 2
            x, y = math.radians(reach[j] * math.cos(a)), math.radians(reach[j] * math.sin(a))
            r, d = math.radians(ra), math.radians(dec)
            depth = math.cos(d) - y * math.sin(d)
            corners.append({"ra": math.degrees(r + math.atan2(x, depth)) % 360, "dec": math.degrees(math.atan2(math.sin(d) + y * math.cos(d), math.hypot(x, depth)))})
        if k % 11 == 0:
            corners[1] = corners[0]
        exposures.append((k, 100.0 + float(rng.integers(0, 40)), None if k % 13 == 0 else float(rng.uniform(20, 22)), corners))
    for k in range(p):
        ra, dec = (rng.uniform(0, 360), 90 - rng.uniform(0, 1.2)) if k % 3 == 0 else (rng.uniform(-1.3, 1.3) % 360, rng.uniform(-1.3, 1.3))
        start = 90.0 if k % 2 else float(rng.integers(98, 130))
        places.append((k, ra, dec, 0.1 + 0.05 * (k % 5), start, 200.0 if k % 2 else start + float(rng.integers(1, 20))))
    return exposures, places


@pytest.mark.parametrize("limits", [None, (40, 30)])
def test_counts_and_boxes_agree_with_pairs(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(C, "COUNT_LIMITS", limits)
        monkeypatch.setattr(C, "SEARCH_LIMITS", limits)
    seen, places = crowd(400, 300)
    exposures, asked = spark.createDataFrame(seen, EXPOSURE), spark.createDataFrame(places, POSITION)
    pairs = C.exposures_at(asked, exposures.where("maglimit IS NOT NULL"), ["star_id"])
    want = pairs.groupBy("star_id").agg(F.count("*"), F.min("obsjd"), F.max("obsjd"), F.max("maglimit"))
    got = C.coverage_counts(asked, exposures, ["star_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # What a box holds, and what lies far outside of it, is known without its borders.
    searches = asked.where("end_jd - start_jd <= 31")
    hits = {(r.star_id, r.pid): len(r.corners) for r in C.box_searches(searches, exposures, ["star_id"]).collect()}
    assert set(hits.values()) == {4}
    held = C.exposures_at(searches, exposures, ["star_id"]).select("star_id", "pid").collect()
    assert held and {tuple(r) for r in held} <= set(hits)
    assert {(r.star_id, r.pid) for r in C.box_searches(searches, exposures, ["star_id"], columns=["pid"]).collect()} == set(hits)


@pytest.mark.parametrize("p", [3, 2000])
def test_runs_of_positions_count_as_pairs_do(p):
    """Numpy alone: many footprints and positions, so that strips are used."""
    rng = np.random.default_rng(p)
    n = 3000
    ra, dec, half, turn = rng.uniform(-2, 2, n), rng.uniform(58, 62, n), rng.uniform(0.1, 0.8, n), rng.uniform(0, 6.3, n)
    turn[::3] = 0.0
    a = turn[:, None] + np.arange(4) * np.pi / 2
    r, d = ra[:, None] + half[:, None] * np.cos(a) * 2, dec[:, None] + half[:, None] * np.sin(a)
    table = pa.table({c: v for k in range(4) for c, v in ((f"_ra{k}", r[:, k]), (f"_dec{k}", d[:, k]))})
    corners, _, convex = quads.footprints(table)
    time, depth = np.sort(rng.integers(0, 500, n) / 10.0), rng.uniform(20, 22, n)
    places = quads.vectors(rng.uniform(-3, 3, p), rng.uniform(57, 63, p))
    start = np.where(np.arange(p) % 2, -1.0, rng.integers(0, 50, p))
    end = np.where(np.arange(p) % 2, 99.0, start + rng.integers(1, 30, p))
    tally = quads.coverage(corners, convex, time, depth, places, start, end)
    normal = np.cross(corners, np.roll(corners, -1, axis=1))
    held = ((np.einsum("nkc,pc->pnk", normal, places) > 0).all(axis=2)) & (time >= start[:, None]) & (time < end[:, None])
    assert convex.all() and (tally.count == held.sum(axis=1)).all() and tally.count.max() > 50
    for values, want in ((tally.first, np.where(held, time, np.inf).min(axis=1)), (tally.last, np.where(held, time, -np.inf).max(axis=1)), (tally.deepest, np.where(held, depth, -np.inf).max(axis=1))):
        assert (values == want).all()


def test_pairs_are_no_rows(spark, exposures):
    asked = spark.createDataFrame([(1, 0.0, 0.0, 0.1, 99.0, 102.0)], POSITION)
    for out in (C.coverage_counts(asked, exposures, ["star_id"]), C.box_searches(asked, exposures, ["star_id"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in plan and "separation" not in plan and "fp_ra#" not in plan.split("CoGroup")[0]
