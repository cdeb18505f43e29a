"""Depths around targets: against brute force, and without a row per pair."""

import math
import random
import statistics

import pytest

from driftline.operators import targets as G


def test_local_depths_make_no_row_per_pair(spark, monkeypatch):
    monkeypatch.setattr(G, "cell_join", lambda *a, **k: pytest.fail("a row per pair"))
    rng = random.Random(4)
    spot = lambda: (rng.choice([0.0, 359.96]) + rng.uniform(0, 0.04), rng.uniform(-0.03, 0.03))
    sources = [(1, k % 2, *spot(), None if k % 9 == 0 else rng.uniform(18, 21), rng.uniform(1, 25)) for k in range(300)]
    # At the border, a frame with four sources and one with five, of which one has no magnitude.
    sources += [(1, 0, 120.0, 10.0 + 1 / 60, 20.0 + k, 5.0) for k in range(5)]
    sources += [(2, f, 50.0, 20.0, None if k == 4 else 19.0 + k, 5.0) for f in (0, 1) for k in range(4 + f)]
    places = [(1, f"t{k}", k % 2, *spot()) for k in range(40)] + [(1, "border", 0, 120.0, 10.0), (1, "lost", 0, None, 1.0), (3, "none", 0, 1.0, 1.0)]
    places += [(2, "four", 0, 50.0, 20.0), (2, "five", 1, 50.0, 20.0)]
    dets = spark.createDataFrame(sources, "build_id long, frame_no int, ra double, dec double, magnitude double, snr double")
    positions = spark.createDataFrame(places, "build_id long, designation string, frame_no int, t_ra double, t_dec double")

    def away(a, d, b, e):
        a, d, b, e = map(math.radians, (a, d, b, e))
        x = math.hypot(math.cos(e) * math.sin(b - a), math.cos(d) * math.sin(e) - math.sin(d) * math.cos(e) * math.cos(b - a))
        return math.degrees(math.atan2(x, math.sin(d) * math.sin(e) + math.cos(d) * math.cos(e) * math.cos(b - a))) * 3600

    got = {r.designation: r.local_depth_mag for r in G.local_depths(positions, dets).collect()}
    assert len(got) == len(places)
    for build, name, frame, ra, dec in places:
        near = [] if ra is None else [
            (m, s) for b, f, x, y, m, s in sources if (b, f) == (build, frame) and 3 <= s <= 20 and away(ra, dec, x, y) <= 60
        ]
        known = [m + 2.5 * math.log10(s / 5) for m, s in near if m is not None]
        want = statistics.median(known) if len(near) >= 5 and known else None
        assert got[name] == (want if want is None else pytest.approx(want, abs=1e-9)), name
    assert got["four"] is None and got["five"] == pytest.approx(20.5) and got["none"] is None
