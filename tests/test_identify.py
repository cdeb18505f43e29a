import pytest
from builders import detections, frames, sky
from test_tracklets import MIN, mover

from driftline.operators import identify as I
from driftline.operators import tracklets as T
from driftline.plans import jobs

EPH = (
    "build_id long, frame_no int, designation string, object_class string, v_magnitude double,"
    " position_error_arcsec double, predicted_ra double, predicted_dec double, listing_no int"
)


@pytest.fixture(scope="module")
def track(spark):
    points = [[p] for p in mover(MIN)]
    return T.build_tracklets(detections(spark, points), frames(spark, MIN))


def predictions(spark, *objects):
    """objects: (designation, north offsets per frame or None, error)."""
    rows = []
    for name, offsets, error in objects:
        for f, (p, off) in enumerate(zip(mover(MIN), offsets)):
            if off is not None:
                ra, dec = sky(*p, 0, off)
                rows.append((1, f, name, "MB", 18.0, error, ra, dec, len(rows)))
    return spark.createDataFrame(rows, EPH)


def status(spark, track, *objects):
    eph = predictions(spark, *objects)
    return I.identify(track, I.candidate_matches(T.tracklet_members(track), eph)).first()


def test_known(spark, track):
    row = status(spark, track, ("A", (0.5, 1.0, 1.5), 0.1), ("far", (50, 50, 50), 0.1))
    assert (row.identification_status, row.best_designation) == ("known", "A")
    assert row.best_max_residual_arcsec == pytest.approx(1.5, abs=1e-3)


def test_every_detection_must_match(spark, track):
    assert status(spark, track, ("A", (0.5, 0.5, 2.5), 0.1)).identification_status == "unknown"
    assert status(spark, track, ("A", (0.5, None, 0.5), 0.1)).identification_status == "unknown"


def test_two_objects_are_ambiguous_and_the_closer_is_best(spark, track):
    row = status(spark, track, ("B", (1, 1, 1), 0.1), ("A", (0.2, 0.2, 0.3), 0.1))
    assert (row.identification_status, row.best_designation, row.n_matches) == ("ambiguous", "A", 2)
    assert row.identification_reason.startswith("2 known objects")


def test_large_position_error_is_ambiguous(spark, track):
    row = status(spark, track, ("A", (0, 0, 0), 3.5))
    assert row.identification_status == "ambiguous"
    assert "position error 3.5" in row.identification_reason


def test_missing_field_is_an_error_but_an_empty_one_is_not(spark, track):
    members = T.tracklet_members(track)
    fields = frames(spark, MIN)
    assert I.require_fields(members, fields).count() == 3
    # A later filter on the joined columns must not hide the missing field.
    with pytest.raises(Exception, match="no known-object field"):
        short = I.require_fields(members, fields.where("frame_no < 2"))
        short.join(fields.select("build_id", "frame_no"), ["build_id", "frame_no"]).where("frame_no < 2").collect()
    with pytest.raises(Exception, match="no known-object field"):
        I.require_fields(members, fields.where("frame_no < 2")).count()


def run_status(spark, fields, *objects):
    """Status through the whole job."""
    points = [[p] for p in mover(MIN)]
    result = jobs.run(detections(spark, points), frames(spark, MIN), predictions(spark, *objects), fields)
    return result.identified.first().identification_status


def test_job_counts_a_repeated_prediction_once(spark):
    fields = frames(spark, MIN)
    # Near in frames 0 and 1 only, frame 1 listed twice.
    assert run_status(spark, fields, ("A", (0.5, 0.5, None), 0.1), ("A", (None, 0.6, None), 0.1)) == "unknown"
    # Near everywhere, frame 1 listed twice.
    assert run_status(spark, fields, ("A", (0.5, 0.5, 0.5), 0.1), ("A", (None, 0.6, None), 0.1)) == "known"
    # The last row of a frame counts, not the nearest.
    assert run_status(spark, fields, ("A", (0.5, 0.5, 0.5), 0.1), ("A", (None, 30.0, None), 0.1)) == "unknown"


def test_job_with_an_empty_and_a_missing_field(spark):
    fields = frames(spark, MIN)
    assert run_status(spark, fields, ("A", (0.5, 0.5, None), 0.1)) == "unknown"
    with pytest.raises(Exception, match="no known-object field"):
        run_status(spark, fields.where("frame_no < 2"), ("A", (0.5, 0.5, 0.5), 0.1))


def test_predictions_need_their_order(spark, track):
    with pytest.raises(ValueError, match="listing"):
        I.candidate_matches(T.tracklet_members(track), predictions(spark, ("A", (0, 0, 0), 0.1)).drop("listing_no"))


def test_last_listed_prediction_wins(spark):
    eph = predictions(spark, ("A", (0, 0, 0), 0.1), ("A", (9, 9, 9), 0.1)).selectExpr("*", "predicted_dec AS row_no")
    last = I.last_per_designation(eph, "row_no")
    assert last.count() == 3
    assert last.where("frame_no = 0").first().predicted_dec == pytest.approx(10 + 9 / 3600)


@pytest.mark.parametrize("args", [(360, 0, 1, 2458000), (0, 91, 1, 2458000), (0, 0, 0, 2458000), (0, 0, 11, 2458000), (0, 0, 1, 1)])
def test_cone_arguments(args):
    with pytest.raises(ValueError):
        I.check_cone(*args)


def test_cone_search_may_be_empty(spark):
    eph = predictions(spark, ("A", (0, 0, 0), 0.1)).selectExpr("*", "2458000D AS epoch_jd")
    assert I.cone_search(eph, 120.0, 10.0, 0.5, 2458000.0).count() == 3
    assert I.cone_search(eph, 200.0, 10.0, 0.5, 2458000.0).count() == 0
