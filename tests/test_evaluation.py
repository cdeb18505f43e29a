"""A sealed run on a small table: metrics, intervals, difference, verdict."""

import math
import random

import pytest

from driftline.operators import metrics as M
from driftline.plans import evaluation as E

STRATA = "field_id string, designation string, role string, near_star string, proximity_group string, depth_margin string, crowding string, filters string, speed string, mask_state string, population string, star_class string"


def test_sealed_run(spark):
    rng = random.Random(9)
    rows, strata = [], []
    for f in range(6):
        for n in range(40):
            label = "positive" if n < 4 else "background"
            for ranker, lift in (("M1", 0.6), ("B1:x", 0.0)):
                score = rng.random() + (lift if label == "positive" else 0.0)
                rows.append((ranker, f"F{f}", f"G{f % 3}", f"N{f}", n, f"t{n}", f"D{f}-{n}" if label == "positive" else None, label, score))
        for n in range(4):
            strata.append((f"F{f}", f"D{f}-{n}", "primary" if n % 2 else "marginal", "zone+outer", "zone", "<0.5", "<20k", "single", "<0.25", "all", "p", "none"))
    scored = spark.createDataFrame(
        rows, "ranker string, field_id string, grp string, night string, tracklet_no long, tracklet_id string, designation string, label string, score double"
    )
    run = E.evaluate_sealed(scored, spark.createDataFrame(strata, STRATA), "M1", "B1:x", resamples=60)
    want = {}
    for ranker in ("M1", "B1:x"):
        hits = []
        for f in range(6):
            own = [(r[7], r[8]) for r in rows if r[0] == ranker and r[1] == f"F{f}"]
            back = [s for label, s in own if label == "background"]
            hits += [sum(b > s for b in back) / len(back) <= 0.05 for label, s in own if label == "positive"]
        want[ranker] = sum(hits) / len(hits)
    summary = {r.ranker: r for r in run.summary.collect()}
    assert {k: r.recall for k, r in summary.items()} == {k: pytest.approx(v) for k, v in want.items()}
    assert all(r.verdict == "INCONCLUSIVE" and r.objects == 24 for r in summary.values())
    ci = {(r.ranker, r.statistic): r for r in run.intervals.collect()}
    assert ci["M1", "recall@0.05"].lower <= want["M1"] <= ci["M1", "recall@0.05"].upper
    assert ci["M1", "minus B1:x"].point == pytest.approx(want["M1"] - want["B1:x"])
    assert len([k for k in ci if k[0] == "M1"]) == 1 + 5 + 3 + 1
    found = {(r.ranker, r.key, r.value) for r in run.strata.collect()}
    assert ("M1", "star_class", "none") in found and ("B1:x", "role", "marginal") in found
    assert run.fields.count() == 12 and run.guards.count() == 4


@pytest.mark.parametrize("limit", [None, 1])
def test_features_ranked_by_field_equal_the_long_table(spark, limit):
    """Ties, missing values, NaN, fields without background or positives, copies of an object."""
    rng = random.Random(3)
    rows = [
        (f"F{n % 4}", n // 2, rng.choice(["D1", "D2", None]), "positive" if n % 4 == 3 else rng.choice(["positive", "background", "auxiliary"]) if n % 4 else "background",
         f"N{n % 3}", rng.choice([None, 1.0, 2.0, -0.0, 0.0, math.nan]), rng.random(), rng.choice([True, False, None]))
        for n in range(300)
    ]
    t = spark.createDataFrame(rows, "field_id string, tracklet_no long, designation string, label string, night string, a double, b double, flag boolean")
    features = [("a", 1), ("b", -1)]
    scored = E.long_scores(t, features)
    got = M.ranked_features(t, scored, features, {"alone": "flag"}, limit)
    want = M.ranked_best(scored, ["ranker", "field_id"], {"alone": "flag"})
    shown = ["ranker", "field_id", "designation", "score", "rank", "q", "q_alone"]
    as_rows = lambda df: sorted(map(str, df.selectExpr(*shown[:3], *[f"round({c}, 12) AS {c}" for c in shown[3:]]).collect()))
    assert as_rows(got) == as_rows(want) and set(got.columns) == set(want.columns) and got.count() > 10


def test_features_of_a_run_are_no_rows_when_ranked(spark):
    t = spark.createDataFrame([("F", 1, "D", "positive", "N", 1.0)], "field_id string, tracklet_no long, designation string, label string, night string, a double")
    plan = M._ranked_features_in_task(t, [("a", 1)], {"bg": "true"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "FlatMapGroupsInArrow" in plan
