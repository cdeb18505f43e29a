"""Stages bound to their inputs: what is computed again, and what stops."""

import pytest
from pyspark.sql import functions as F

from driftline.operators.groups import STAGE_SPLITS
from driftline.sources import bundles as B

DIGEST = "field_id string, sha256 string"


def test_only_changed_fields_are_computed_again(spark, tmp_path):
    path, asked = str(tmp_path / "stage"), []

    def stage(version, empty=()):
        def compute(fields):
            asked.append({r.field_id for r in fields.collect()})
            return fields.where(~F.col("field_id").isin(*empty, "")).selectExpr("field_id", f"'{version}' AS version", "explode(sequence(1, 2)) AS n")

        return compute

    def run(rows, compute):
        got = B.materialise_bound(spark.createDataFrame(rows, DIGEST), path, compute)
        assert got.columns == ["field_id", "version", "n"]
        return sorted((r.field_id, r.version, r.n) for r in got.collect())

    assert run([("07", "a"), ("8", "b"), ("9", "c")], stage("x", ["9"])) == [("07", "x", 1), ("07", "x", 2), ("8", "x", 1), ("8", "x", 2)]
    # Nothing changed, also the field without rows; then one changed, one is new.
    assert run([("07", "a"), ("8", "b"), ("9", "c")], stage("y")) == [("07", "x", 1), ("07", "x", 2), ("8", "x", 1), ("8", "x", 2)]
    assert run([("07", "a"), ("8", "b2"), ("10", "d")], stage("z")) == [(f, v, n) for f, v in (("07", "x"), ("10", "z"), ("8", "z")) for n in (1, 2)]
    # New inputs that give no rows leave none of the old ones.
    assert run([("07", "a2"), ("8", "b2")], stage("w", ["07"])) == [("8", "z", 1), ("8", "z", 2)]
    assert asked == [{"07", "8", "9"}, set(), {"8", "10"}, {"07"}]
    assert run([], stage("v")) == []


def test_interrupted_stage_is_repeated(spark, tmp_path):
    path = str(tmp_path / "stage")
    digests = spark.createDataFrame([("1", "a")], DIGEST)
    with pytest.raises(Exception, match="no luck"):
        B.materialise_bound(digests, path, lambda f: f.select("field_id", F.raise_error(F.lit("no luck")).cast("int").alias("n")))
    assert B.materialise_bound(digests, path, lambda f: f.select("field_id", F.lit(3).alias("n"))).collect() == [("1", 3)]
    with pytest.raises(Exception, match="without a digest"):
        B.materialise_bound(spark.createDataFrame([(None, "a")], DIGEST), path, lambda f: f.select("field_id", F.lit(3).alias("n")))


def test_digest_of_inputs(spark):
    schema = "field_id string, path string, sha256 string"
    one = B.input_digests(spark.createDataFrame([("1", "a", "x"), ("1", "b", "y"), ("1", "b", "y"), ("2", "a", None)], schema))
    two = B.input_digests(spark.createDataFrame([("1", "b", "y"), ("1", "a", "x"), ("2", "a", "x")], schema))
    a, b = ({r.field_id: r.sha256 for r in d.collect()} for d in (one, two))
    assert a["1"] == b["1"] and a["2"] != b["2"]


def test_guarded_inputs_stop(spark):
    stage, split = next(iter(STAGE_SPLITS.items()))
    other = next(s for s in (*STAGE_SPLITS.values(), "other") if s != split)
    rows = spark.createDataFrame([("1", 5), ("2", 6)], "field_id string, v int")
    manifest = spark.createDataFrame([("1", split), ("2", split), ("3", other)], "field_id string, split string")
    frozen = spark.createDataFrame([("1", "a"), ("2", "b")], DIGEST)
    assert sorted(B.guarded_inputs(rows, manifest, stage, frozen, frozen).collect()) == [("1", 5), ("2", 6)]
    changed = spark.createDataFrame([("1", "a"), ("2", "c")], DIGEST)
    wrong = rows.unionByName(spark.createDataFrame([("3", 7)], "field_id string, v int"))
    for args, text in (
        ((rows, manifest, stage, changed, frozen), "2 differs from the frozen input"),
        ((rows, manifest, stage, frozen, frozen.where("field_id = 1")), "2 is no frozen input"),
        ((wrong, manifest, stage, frozen, frozen), "3 is"),
    ):
        with pytest.raises(Exception, match=text):
            B.guarded_inputs(*args).collect()
