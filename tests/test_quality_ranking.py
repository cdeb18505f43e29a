import pytest
from builders import detections, frames
from pyspark.sql import functions as F
from test_tracklets import MIN, mover

from driftline.operators import quality as Q
from driftline.operators import ranking as R
from driftline.operators import tracklets as T


def features(spark, changes, with_sharp=True):
    """Features of one three-frame tracklet; ``changes``: column -> 3 values."""
    dets = detections(spark, [[p] for p in mover(MIN)])
    for name, values in changes.items():
        kind = dict(dets.dtypes)[name]
        pick = F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("frame_no") + 1)
        dets = dets.withColumn(name, pick)
    trk = T.build_tracklets(dets, frames(spark, MIN))
    return Q.quality_features(Q.members_with_detections(trk, dets), with_sharp).first()


def test_plain_values(spark):
    row = features(spark, {"snr": (5, 9, 7), "magnitude": (19.0, 19.5, 19.2), "magnitude_error": (0.3, 0.4, 0.1)})
    assert (row.min_snr, row.median_snr) == (5, 7)
    assert row.magnitude_range_mag == pytest.approx(0.5)
    assert row.magnitude_range_sigma == pytest.approx(1.0)


def test_equal_extremes_take_the_first_in_time(spark):
    row = features(spark, {"magnitude": (19.0, 19.0, 19.0), "magnitude_error": (0.0, 0.4, 0.3)})
    assert row.magnitude_range_sigma is None and row.magnitude_chi2 is None


def test_edge_and_mask_on_one_detection_flag_it_once(spark):
    row = features(spark, {"on_image_edge": (True, False, False), "mask_bits": (256, 0, 4096)})
    assert (row.edge_detection_count, row.masked_detection_count, row.flagged_detection_count) == (1, 2, 2)
    assert row.mask_bits_union == 4352


@pytest.mark.parametrize(
    "sharp, with_sharp, expected",
    [
        ((0.1, -0.4, 0.2), True, ("complete", -0.4, 0.2, 0.4)),
        ((0.1, None, 0.2), True, ("partial", None, None, None)),
        ((0.1, 0.1, 0.2), False, ("unavailable", None, None, None)),
    ],
)
def test_sharp(spark, sharp, with_sharp, expected):
    row = features(spark, {"sharp": sharp}, with_sharp)
    assert (row.sharp_availability, row.sharp_min, row.sharp_max, row.sharp_abs_max) == expected


def test_chi_square(spark):
    row = features(spark, {"magnitude": (1.0, 2.0, 4.0), "magnitude_error": (1.0, 0.5, 2.0)})
    w = (1, 4, 0.25)
    mean = (1 + 8 + 1) / 5.25
    assert row.magnitude_chi2 == pytest.approx(sum(a * (m - mean) ** 2 for a, m in zip(w, (1, 2, 4))))


def tracklet_table(spark, sets, statuses=None):
    member = "array<struct<frame_no:int,det_no:long,minutes:double,ra:double,dec:double>>"
    rows = [
        (1, n, f"trk-{n:04d}", [(f, d, 0.0, 10.0, 0.0) for f, d in s], (statuses or {}).get(n, "built"))
        for n, s in enumerate(sets, start=1)
    ]
    return spark.createDataFrame(rows, f"build_id long, tracklet_no long, tracklet_id string, members {member}, status string")


def test_shared_detections_count_distinct_other_built_tracklets(spark):
    sets = [
        [(0, 1), (1, 1), (2, 1)], [(0, 1), (1, 1), (2, 2)], [(0, 1), (1, 3), (2, 1)],
        [(0, 4), (1, 4), (2, 4)], [(0, 1), (1, 9), (2, 9)], [(0, 4), (1, 8), (2, 8)],
    ]
    statuses = {6: "rejected"}
    got = {
        r.tracklet_no: r.shared_detection_tracklets
        for r in Q.shared_detection_counts(tracklet_table(spark, sets, statuses)).collect()
    }
    expected = {}
    built = {n: set(s) for n, s in enumerate(sets, start=1) if n not in statuses}
    for n, s in built.items():
        expected[n] = sum(1 for m, o in built.items() if m != n and s & o)
    assert got == expected


def test_shared_count_of_a_crowd_is_not_quadratic(spark):
    """Hundreds of tracklets through one detection."""
    sets = [[(0, 1), (1, 10 + i), (2, 10 + i)] for i in range(300)]
    out = Q.shared_detection_counts(tracklet_table(spark, sets))
    assert {r.shared_detection_tracklets for r in out.collect()} == {299}


def test_score_adds_eight_weighted_percentiles(spark):
    names = [n for n, _ in R.REVIEW_INPUTS]
    rows = [(1, i, *[float(i)] * 8) for i in range(1, 5)]
    rows[0] = (1, 1, *[1.0] * 6, None, 1.0)
    df = spark.createDataFrame(rows, "build_id long, tracklet_no long, " + ", ".join(f"{n} double" for n in names))
    scores, evidence = R.review_scores(df)
    got = {r.tracklet_no: r.score for r in scores.collect()}
    n = 4
    up = {i: (i - 0.5) / n for i in range(1, 5)}
    down = {i: (n - i + 0.5) / n for i in range(1, 5)}
    partial = {1: None, 2: 2.5 / 3, 3: 1.5 / 3, 4: 0.5 / 3}
    for i in range(1, 5):
        total = 0.0
        for name, direction in R.REVIEW_INPUTS:
            p = partial[i] if name == "sharp_abs_max" else (up if direction > 0 else down)[i]
            total = total + 0.125 * (p or 0.0)
        assert got[i] == total
    assert evidence.count() == 32
    order = {r.tracklet_no: r.review_rank for r in R.review_order(scores).collect()}
    assert sorted(order, key=order.get) == sorted(got, key=lambda i: (-got[i], i))


def test_track_window_is_rounded_up(spark):
    df = tracklet_table(spark, [[(0, 1), (1, 1), (2, 1)]])
    assert R.track_windows(df).first().size_arcsec == 60.0
