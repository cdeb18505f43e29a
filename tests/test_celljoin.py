import math
import random

import pytest

from driftline.operators.celljoin import cell_join

SCHEMA = "id long, ra double, dec double"


def separation(a, b):
    ra1, d1, ra2, d2 = map(math.radians, (*a, *b))
    x = math.hypot(
        math.cos(d2) * math.sin(ra2 - ra1),
        math.cos(d1) * math.sin(d2) - math.sin(d1) * math.cos(d2) * math.cos(ra2 - ra1),
    )
    y = math.sin(d1) * math.sin(d2) + math.cos(d1) * math.cos(d2) * math.cos(ra2 - ra1)
    return math.degrees(math.atan2(x, y)) * 3600


def cloud(rng, ra0, dec0, size, n):
    out = []
    for _ in range(n):
        dec = max(-90.0, min(90.0, dec0 + rng.uniform(-size, size)))
        width = min(180.0, size / max(math.cos(math.radians(dec)), 1e-6))
        out.append(((ra0 + rng.uniform(-width, width)) % 360.0, dec))
    return out


@pytest.mark.parametrize("dec0", [0.0, 30.0, -60.0, 89.0, 89.99, -89.95, 90.0])
@pytest.mark.parametrize("radius, factor", [(1.5, 8.0), (60.0, 2.0), (900.0, 1.0)])
def test_equals_brute_force(spark, dec0, radius, factor):
    rng = random.Random(repr((dec0, radius)))
    size = radius / 3600 * 8
    left, right = cloud(rng, 0.0, dec0, size, 120), cloud(rng, 0.0, dec0, size, 120)
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(left)], SCHEMA)
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(right)], SCHEMA)
    b = b.withColumnsRenamed({"id": "id2", "ra": "ra2", "dec": "dec2"})
    pairs = cell_join(a, b, radius, on=[], cell_factor=factor).collect()
    found = [(r.id, r.id2) for r in pairs]
    expected = {
        (i, j) for i, p in enumerate(left) for j, q in enumerate(right) if separation(p, q) <= radius
    }
    assert len(found) == len(set(found))
    assert set(found) == expected


def test_semi_and_anti_split_the_left_side(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], SCHEMA)
    b = spark.createDataFrame([(0.0001, 0.0)], "ra2 double, dec2 double")
    semi = cell_join(a, b, 1.0, on=[], how="left_semi").collect()
    anti = cell_join(a, b, 1.0, on=[], how="left_anti").collect()
    assert [r.id for r in semi] == [1] and [r.id for r in anti] == [2]
    assert semi[0].asDict().keys() == {"id", "ra", "dec"}
