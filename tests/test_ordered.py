import bisect
import random
import statistics

import pytest
from pyspark.sql import functions as F

from driftline.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, with heavy ties and missing values."""
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        group = 0 if i % 10 < 8 else i % 7
        value = None if i % 37 == 0 else float(rng.randrange(60)) if i % 2 else rng.random() * 60
        rows.append((i, group, value))
    return rows, spark.createDataFrame(rows, "id long, g long, v double").repartition(6)


def by_group(rows):
    out = {}
    for i, g, v in rows:
        out.setdefault(g, []).append((i, v))
    return out


def test_row_numbers(skewed):
    rows, df = skewed
    got = {r.id: r.n for r in O.row_numbers(df, ["g"], [F.col("v").desc(), F.col("id")], "n").collect()}
    for items in by_group(rows).values():
        items.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        assert [got[i] for i, _ in items] == list(range(1, len(items) + 1))


def test_mid_rank_percentile(skewed):
    rows, df = skewed
    got = {r.id: r.percentile for r in O.mid_rank_percentile(df, ["g"], "v").collect()}
    for items in by_group(rows).values():
        present = sorted(v for _, v in items if v is not None)
        for i, v in items:
            if v is None:
                assert got[i] is None
                continue
            below = bisect.bisect_left(present, v)
            tied = bisect.bisect_right(present, v) - below
            assert got[i] == (below + 0.5 * tied) / len(present)


def test_quantiles_are_inclusive(skewed):
    rows, df = skewed
    got = {r.g: r for r in O.quantiles(df, ["g"], "v", {"p25": 0.25, "p50": 0.5, "p90": 0.9}).collect()}
    for g, items in by_group(rows).items():
        present = [v for _, v in items if v is not None]
        q = statistics.quantiles(present, n=20, method="inclusive")
        assert got[g]["count"] == len(present)
        assert (got[g].p25, got[g].p50, got[g].p90) == pytest.approx((q[4], q[9], q[17]))


def test_single_value_quantile(spark):
    df = spark.createDataFrame([(1, 5.0)], "g long, v double")
    row = O.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.75}).first()
    assert (row.a, row.b) == (5.0, 5.0)


def test_average_ranks(spark):
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0])], "id long, g long, v double")
    got = {r.id: r["rank"] for r in O.average_ranks(df, ["g"], "v").collect()}
    assert got == {0: 3.5, 1: 1.0, 2: 3.5, 3: 2.0}


def test_checkpoint_dir_is_set_once(spark):
    O.ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    O.ensure_checkpoint_dir(spark)
    assert before and spark.sparkContext.getCheckpointDir() == before
