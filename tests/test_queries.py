"""Registered queries against their SQL on the smallest scale."""

import pathlib

import pytest

import __spark_entry__ as entry
from checks.compare import connect, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
FAST = [
    "moving_candidates", "seed_pairs", "build_tracklets", "build_five_frames", "review_ranking",
    "target_traces", "recall_guards", "numeric_summary", "pick_triples", "independence_groups",
    "normalise_known_objects", "star_proximity", "frame_depths", "sealed_sample", "population_fields",
    "confirmation_decisions", "recovery_sample",
]


@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = connect(SF).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["missed_positives", "ranker_disagreements", "sealed_sample", "weak_fields"])
def test_lists_rank_no_ranker_that_they_do_not_use(spark, monkeypatch, name):
    from driftline.operators import metrics

    rank, seen = metrics.rank_positives, []

    def spied(scored, rankers=None):
        out = rank(scored, rankers)
        if rankers:
            seen.append({r.ranker for r in out.select("ranker").distinct().collect()})
        return out

    monkeypatch.setattr(metrics, "rank_positives", spied)
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert [len(s) for s in seen] == [1]
    cursor = connect(SF).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())
