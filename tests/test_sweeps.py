"""The annotated sweep against one whole build per configuration."""

import random

import pytest
from builders import detections, frames, sky

from driftline.config import DEFAULT
from driftline.operators import identify, sweeps
from driftline.operators.tracklets import build_tracklets, tracklet_members


def crowded(rng, n_frames=5):
    out = []
    stars = [(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(25)]
    movers = [(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(-1.2, 1.2), rng.uniform(-1.2, 1.2)) for _ in range(6)]
    for f in range(n_frames):
        points = [(x + rng.gauss(0, 0.4), y + rng.gauss(0, 0.4)) for x, y in stars if rng.random() < 0.9]
        points += [(x + u * 10 * f + rng.gauss(0, 0.3), y + v * 10 * f + rng.gauss(0, 0.3)) for x, y, u, v in movers if rng.random() < 0.95]
        points += [(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(6)]
        out.append([sky(150.0, 20.0, *p) for p in points])
    return out, movers


def test_sweep_equals_one_build_per_configuration(spark):
    rng = random.Random(12)
    points, movers = crowded(rng)
    dets = detections(spark, points).unionByName(detections(spark, points[:3], build=2))
    seq = frames(spark, [0, 10, 20, 30, 40]).unionByName(frames(spark, [0, 10, 20], build=2))
    rows = []
    for b, n in ((1, 5), (2, 3)):
        for k, (x, y, u, v) in enumerate(movers):
            for f in range(n):
                ra, dec = sky(150.0, 20.0, x + u * 10 * f + 0.4 * (k % 3), y + v * 10 * f)
                rows.append((b, f, f"o{k}", "MB", 19.0, 0.3 + 1.2 * (k % 2), ra, dec, k))
    eph = spark.createDataFrame(
        rows,
        "build_id long, frame_no int, designation string, object_class string, v_magnitude double,"
        " position_error_arcsec double, predicted_ra double, predicted_dec double, listing_no int",
    )
    configs = {
        "base": DEFAULT, "tol": DEFAULT.with_value("stationary_tolerance_arcsec", 0.7), "rate": DEFAULT.with_value("max_rate_arcsec_per_min", 2.0),
        "radius": DEFAULT.with_value("search_radius_arcsec", 0.8), "fit": DEFAULT.with_value("max_residual_arcsec", 0.25),
        "match": DEFAULT.with_value("match_radius_arcsec", 1.0), "four": DEFAULT.with_value("min_detections", 4),
    }
    got = {(r.config, r.build_id): (r.tracklets, r.built, r.known, r.unknown_built) for r in sweeps.sweep(dets, seq, eph, configs).collect()}
    want = {}
    for name, config in configs.items():
        tracklets = build_tracklets(dets, seq, config)
        found = identify.identify(tracklets, identify.candidate_matches(tracklet_members(tracklets), eph, config), config)
        for r in found.collect():
            n = want.setdefault((name, r.build_id), [0, 0, 0, 0])
            n[0] += 1
            n[1] += r.status == "built"
            n[2] += r.identification_status == "known"
            n[3] += r.identification_status == "unknown" and r.status == "built"
    assert got == {k: tuple(v) for k, v in want.items()}
    assert len({v for (c, b), v in got.items() if b == 1}) >= 5


def test_whole_grid_and_its_limit(spark):
    configs = sweeps.sweep_configs()
    assert len(configs) == 17 and "search_radius_arcsec=3" in configs
    many = [(float(k), 1.0, 1.0, 3) for k in range(1, sweeps.MAX_LINKINGS + 2)]
    with pytest.raises(ValueError, match="linking configurations"):
        sweeps.annotated_sets(None, None, many)
