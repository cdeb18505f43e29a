import pytest
from pyspark.sql import functions as F

from driftline.functions import sky


def one(spark, *exprs, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_one"))
    row = df.selectExpr(*[f"{e} AS x{i}" for i, e in enumerate(exprs)]).first()
    return row[0] if len(exprs) == 1 else tuple(row)


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ((10.0, 20.0), (10.0, 20.0), 0.0),
        ((359.9999, 0.0), (0.0001, 0.0), 0.72),
        ((0.0, 89.9999), (180.0, 89.9999), 0.72),
        ((0.0, -90.0), (123.0, -89.0), 3600.0),
        ((0.0, 0.0), (180.0, 0.0), 648000.0),
    ],
)
def test_separation(spark, a, b, expected):
    assert one(spark, sky.separation(*a, *b)) == pytest.approx(expected, abs=1e-6)
    assert one(spark, sky.separation_haversine(*a, *b)) == pytest.approx(expected, abs=1e-2)


def test_motion_and_prediction(spark):
    m = sky.motion_vector(10.0, 0.0, 10.0 + 30 / 3600, 0.0, 30.0)
    rate, angle = one(spark, m["rate_arcsec_per_min"], m["position_angle_deg"])
    assert rate == pytest.approx(1.0) and angle == pytest.approx(90.0)
    ra, dec = sky.predict(359.999, 0.0, 0.0, 0.0, 10.0, 10.0)
    assert one(spark, ra) == pytest.approx(0.001, abs=1e-9)
    back = sky.predict(10.0, 5.0, 10.01, 5.02, 10.0, -10.0)
    assert one(spark, *back) == pytest.approx((10.0, 5.0), abs=1e-9)
    assert one(spark, *sky.predict(10.0, 5.0, 10.0, 5.0, 10.0, 10.0)) == pytest.approx((10.0, 5.0))


def test_time_order_is_required(spark):
    m = sky.motion_vector(10.0, 0.0, 10.1, 0.0, "0D")
    with pytest.raises(Exception, match="later than the first"):
        one(spark, m["rate_arcsec_per_min"])


def test_offsets_and_tangent_plane(spark):
    east, north = one(spark, *sky.sky_offsets(10.001, 60.0, 10.0, 60.0))
    assert east == pytest.approx(1.8, abs=1e-4) and abs(north) < 1e-4
    x, y = sky.gnomonic(10.3, 60.2, 10.0, 60.0)
    xi, eta = one(spark, x, y)
    assert one(spark, *sky.gnomonic_inverse(xi, eta, 10.0, 60.0)) == pytest.approx((10.3, 60.2))
    assert one(spark, *sky.gnomonic_inverse(0.0, 0.0, 10.0, -89.0)) == pytest.approx((10.0, -89.0))


def test_mean_position_across_zero(spark):
    points = "array(named_struct('ra', 359.9D, 'dec', 0D), named_struct('ra', 0.3D, 'dec', 0D))"
    assert one(spark, *sky.mean_position_array(points)) == pytest.approx((0.1, 0.0), abs=1e-9)


def test_footprint_ignores_corner_order(spark):
    corners = [(10.0, 0.0), (11.0, 1.0), (10.0, 1.0), (11.0, 0.0)]
    text = ", ".join(f"named_struct('ra', {a}D, 'dec', {d}D)" for a, d in corners)
    df = spark.sql(f"SELECT array({text}) AS corners")
    df = df.selectExpr("*", *sky.footprint_columns("corners"))
    row = df.selectExpr(sky.in_footprint(10.5, 0.5), sky.in_footprint(10.5, 1.1), sky.in_footprint(9.9, 0.5)).first()
    assert tuple(row) == (True, False, False)
    area = df.selectExpr(f"{sky.polygon_area('fp_edges')} * pow(180 / pi(), 2)").first()[0]
    assert area == pytest.approx(1.0, rel=1e-3)
    edge = df.selectExpr(sky.edge_distance(10.5, 0.1, "corners")).first()[0]
    assert edge == pytest.approx(360.0, rel=1e-3)


def test_baseline(spark):
    points = "array(named_struct('ra', 0D, 'dec', 0D), named_struct('ra', 0.001D, 'dec', 0D), named_struct('ra', 0.0015D, 'dec', 0D))"
    assert one(spark, sky.baseline_eligible(points, 0.9)) is True
    assert one(spark, sky.baseline_eligible(points, 1.0)) is False


def test_ecliptic_latitude(spark):
    assert one(spark, sky.ecliptic_latitude(90.0, sky.OBLIQUITY_J2000)) == pytest.approx(0.0, abs=1e-9)
    pole = one(spark, sky.ecliptic_latitude(270.0, 90 - sky.OBLIQUITY_J2000))
    assert pole == pytest.approx(90.0, abs=1e-4)


def test_edge_distance_projects_the_corners_once():
    text = sky.edge_distance("ra", "dec", "corners")
    assert text.count(sky.project_points("corners", "ra", "dec")) == 1
