import itertools
import random

import pytest
from builders import detections, frames, member_ids, sky

from driftline.config import DEFAULT, BuildConfig
from driftline.operators import tracklets as T

MIN = (0.0, 30.0, 60.0)


def mover(minutes, ra0=120.0, dec0=10.0, east=0.8, north=0.3):
    return [sky(ra0, dec0, east * m, north * m) for m in minutes]


def build(spark, points, minutes, config=DEFAULT):
    return T.build_tracklets(detections(spark, points), frames(spark, minutes), config)


def diagnostics(spark, points, minutes, config=DEFAULT):
    return T.build_diagnostics(detections(spark, points), frames(spark, minutes), config).first()


def test_linear_mover(spark):
    out = build(spark, [[p] for p in mover(MIN)], MIN)
    row = out.first()
    assert member_ids(out) == [((0, 0), (1, 0), (2, 0))]
    assert (row.tracklet_id, row.status, row.status_reason) == ("trk-0001", "built", None)
    assert row.angular_velocity_arcsec_per_min == pytest.approx((0.64 + 0.09) ** 0.5, abs=1e-3)
    assert row.position_angle_deg == pytest.approx(69.44, abs=0.05)
    assert row.fit_max_residual_arcsec < 0.01


def test_four_frames_count_duplicates(spark):
    minutes = (0.0, 20.0, 40.0, 60.0)
    d = diagnostics(spark, [[p] for p in mover(minutes)], minutes)
    assert (d.seed_pairs, d.linked_before_dedup, d.duplicates_removed, d.subsets_removed) == (6, 6, 5, 0)
    assert d.tracklet_count == 1


def test_empty_frame_is_skipped(spark):
    minutes = (0.0, 20.0, 40.0, 60.0)
    points = [[p] for p in mover(minutes)]
    points[2] = []
    assert member_ids(build(spark, points, minutes)) == [((0, 0), (1, 0), (3, 0))]


def test_too_fast_is_not_linked(spark):
    assert build(spark, [[p] for p in mover(MIN, east=1.2)], MIN).count() == 0


def test_ambiguous_extension_gives_two_tracklets(spark):
    points = [[p] for p in mover(MIN)]
    ra, dec = points[2][0]
    points[2] = [sky(ra, dec, 0, 0.7), sky(ra, dec, 0, -0.8)]
    d = diagnostics(spark, points, MIN)
    assert d.ambiguous_extensions >= 1
    assert d.tracklet_count == 2 and d.detections_in_multiple_tracklets == 2


def test_poor_fit_is_rejected(spark):
    points = [[p] for p in mover(MIN)]
    points[1] = [sky(*points[1][0], 0, 1.5)]
    row = build(spark, points, MIN).first()
    assert row.status == "rejected"
    assert row.status_reason.startswith("max fit residual 1.00 arcsec exceeds 0.5")


def test_stationary_sources_are_removed_across_ra_zero(spark):
    points = [[(359.99999, 5.0)], [(0.00001, 5.0)], [(120.0, 5.0)]]
    marked = T.mark_stationary(detections(spark, points), 1.5).orderBy("frame_no").collect()
    assert [r.is_stationary for r in marked] == [True, True, False]


def test_copies_in_one_frame_are_not_partners(spark):
    points = [[(10.0, 5.0), (10.0, 5.0)], [(11.0, 5.0)]]
    assert T.moving_candidates(detections(spark, points), 1.5).count() == 3


def test_single_frame_build_is_an_error(spark):
    with pytest.raises(Exception, match="at least two frames"):
        build(spark, [[(10.0, 5.0)]], (0.0,)).count()


def test_unordered_frames_are_an_error(spark):
    with pytest.raises(Exception, match="increasing time order"):
        build(spark, [[p] for p in mover(MIN)], (0.0, 30.0, 30.0)).count()


def test_strict_subsets_are_removed(spark):
    schema = (
        "build_id long, members array<struct<frame_no:int,det_no:long,minutes:double,ra:double,dec:double>>"
    )
    def member(ids):
        return [(f, d, 0.0, 0.0, 0.0) for f, d in ids]
    sets = [
        [(0, 1), (1, 1), (2, 1), (3, 1)], [(0, 1), (2, 1), (3, 1)], [(1, 1), (2, 1), (3, 1)],
        [(0, 1), (1, 2), (2, 1)], [(0, 1), (1, 1), (2, 2), (3, 1)],
    ]
    df = spark.createDataFrame([(1, member(s)) for s in sets] + [(2, member(sets[1]))], schema)
    kept = T.drop_subsets(df)
    expected = [s for s in sets if not any(set(s) < set(o) for o in sets)]
    assert sorted(member_ids(kept.where("build_id = 1"))) == sorted(tuple(s) for s in expected)
    assert kept.where("build_id = 2").count() == 1


def test_noise_and_movers_do_not_depend_on_partitioning(spark):
    rng = random.Random(7)
    points = [
        [(120 + rng.uniform(0, 0.1), 10 + rng.uniform(0, 0.1)) for _ in range(40)] for _ in range(3)
    ]
    for start in ((120.02, 10.02), (120.07, 10.06)):
        for frame, p in zip(points, mover(MIN, *start)):
            frame.append(p)
    dets, frm = detections(spark, points), frames(spark, MIN)
    first = T.build_tracklets(dets, frm).orderBy("tracklet_no")
    other = T.build_tracklets(dets.repartition(7, "dec"), frm).orderBy("tracklet_no")
    assert member_ids(first) == member_ids(other)
    found = {m for m in member_ids(first)}
    assert {((0, 40), (1, 40), (2, 40)), ((0, 41), (1, 41), (2, 41))} <= found


def test_many_copies_stay_whole(spark):
    """k x m copies of one track give all their combinations, none dropped."""
    a, b, c = mover(MIN)
    out = build(spark, [[a] * 3, [b] * 4, [c]], MIN)
    pairs = {(m[0][1], m[1][1]) for m in member_ids(out)}
    assert {p for p in itertools.product(range(3), range(4))} <= pairs


@pytest.mark.parametrize("name", ["stationary_tolerance_arcsec", "max_rate_arcsec_per_min", "match_radius_arcsec"])
def test_config_must_be_positive(name):
    with pytest.raises(ValueError, match=name):
        BuildConfig(**{name: 0.0})


def test_config_needs_three_detections():
    with pytest.raises(ValueError, match="min_detections"):
        BuildConfig(min_detections=2)
