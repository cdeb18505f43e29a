import pytest
from pyspark.sql import functions as F

from driftline.operators import sequences as Q
from driftline.sources import catalogs as K
from driftline.sources import tables as B


def metadata(spark, rows):
    return spark.createDataFrame(rows, K.METADATA_SCHEMA)


GOOD = ("7", "2018-04-11 10:00:00+00", 2458219.9, "535", "zr", "11", "3", "20180411467847", "o", "30.0")


def changed(**values):
    names = [c.split(" ")[0] for c in K.METADATA_SCHEMA.replace("\n", " ").split(", ")]
    return tuple(values.get(n.strip(), v) for n, v in zip(names, GOOD))


def test_observation_mapping(spark):
    rows = [GOOD, changed(pid=""), changed(pid="x"), changed(exptime=""), changed(exptime="-1"), changed(obsdate="?")]
    good, bad = K.map_observations(metadata(spark, rows))
    assert sorted(r.exposure_seconds is None for r in good.collect()) == [False, True]
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["invalid field(s): exposure_seconds", "invalid field(s): observed_at", "invalid field(s): product_id", "missing required field(s): pid"]


def test_metadata_csv_and_window(spark, tmp_path):
    path = str(tmp_path / "m")
    metadata(spark, [GOOD, changed(pid="8", obsjd=2458220.5)]).coalesce(1).write.csv(path, header=True)
    rows = K.in_window(K.read_metadata(spark, path), 2458219.5, 2458220.5)
    assert [r.pid for r in rows.collect()] == ["7"]
    with pytest.raises(ValueError):
        K.in_window(rows, 2.0, 1.0)


def test_unknown_product_id_is_an_error(spark):
    good, _ = K.map_observations(metadata(spark, [GOOD]))
    ids = spark.createDataFrame([(7,), (8,)], "product_id long")
    assert K.observations_by_id(good, ids.where("product_id = 7")).count() == 1
    with pytest.raises(Exception, match="no metadata for product id 8"):
        K.observations_by_id(good, ids).collect()


def test_mid_exposure_and_path(spark):
    good, _ = K.map_observations(metadata(spark, [GOOD]))
    row = K.mid_exposure(good).selectExpr("date_format(mid_exposure_at, 'HH:mm:ss') AS t", "mid_exposure_jd").first()
    assert row.t == "10:00:15" and row.mid_exposure_jd == pytest.approx(2458219.916840, abs=1e-6)
    assert K.product_path(good, K.PSF_SUFFIX).first().path == (
        "2018/0411/467847/ztf_20180411467847_000535_zr_c11_o_q3_psfcat.fits"
    )
    with pytest.raises(Exception, match="14 digits"):
        K.product_path(good.withColumn("file_frac_day", F.lit("2018")), K.PSF_SUFFIX).collect()


@pytest.mark.parametrize("kwargs", [dict(ra=360.0), dict(dec=91.0), dict(radius_deg=0.0), dict(radius_deg=3.0), dict(end_jd=100.0)])
def test_box_search_limits(spark, kwargs):
    good, _ = K.map_observations(metadata(spark, [GOOD]))
    frame = good.selectExpr("*", "359.99D AS center_ra", "10D AS center_dec")
    args = dict(ra=0.01, dec=10.0, radius_deg=0.1, start_jd=2458219.5, end_jd=2458220.5)
    assert K.box_search(frame, **args).count() == 1
    with pytest.raises(ValueError):
        K.box_search(frame, **{**args, **kwargs})


def test_request_ids(spark):
    df = spark.createDataFrame([(1, [1, 2, 3])], "build_id long, product_ids array<long>")
    assert K.check_request_ids(df).count() == 1
    for ids in ([1, 2], [1, 2, 2], list(range(11))):
        with pytest.raises(Exception, match="different product ids"):
            K.check_request_ids(spark.createDataFrame([(1, ids)], df.schema)).collect()


PSF = dict(product_id=5, row_index=0, sourceid=3, xpos=1.0, ypos=2.0, ra=10.0, dec=20.0, flux=1.0, sigflux=1.0,
           mag=-7.0, sigmag=0.1, snr=9.0, chi=1.0, sharp=0.2, flags=0)


def psf(spark, *changes):
    rows = [tuple({**PSF, "row_index": i, **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, K.PSF_SCHEMA)


def zero(spark, value=26.3084802135098):
    return spark.createDataFrame([(5, value)], "product_id long, magzp double")


def test_normalised_row_and_flags(spark):
    rows = psf(spark, {}, {"flags": -1}, {"flags": 256}, {"sharp": float("inf")})
    out = K.valid_rows(K.normalise_psf(rows, zero(spark))).orderBy("row_index").collect()
    assert out[0].source_id == "5-3" and out[0].magnitude == pytest.approx(19.3084802135098)
    assert [(r.on_image_edge, r.mask_bits) for r in out] == [(False, 0), (True, 0), (False, 256), (False, 0)]
    assert [r.sharp for r in out] == [0.2, 0.2, 0.2, None]
    assert [tuple(r) for r in K.negative_flag_counts(rows).collect()] == [(5, -1, 1)]


def test_bad_rows_are_rejected_with_reasons(spark):
    rows = psf(spark, {}, {"ra": float("nan")}, {"dec": 95.0}, {"snr": -2.0, "ra": 360.0}, {"mag": float("inf")}, {"flags": None})
    normalised = K.normalise_psf(rows, zero(spark))
    assert [r.row_index for r in K.valid_rows(normalised).collect()] == [0]
    reasons = {r.row_index: r.reason for r in K.rejected_rows(normalised).collect()}
    assert reasons[1].startswith("ra:") and reasons[2].startswith("dec:") and reasons[4].startswith("magnitude:")
    assert reasons[3] == "ra: must be in [0, 360); snr: must not be negative"
    assert reasons[5] == "unreadable row"


def test_missing_zero_point_fails_the_frame(spark):
    with pytest.raises(Exception, match="no MAGZP"):
        K.normalise_psf(psf(spark, {}), zero(spark, None)).collect()


def test_normalisation_runs_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "psf")
    psf(spark, {}, {"dec": 95.0}).write.parquet(path)
    stream = spark.readStream.schema(K.PSF_SCHEMA).parquet(path)
    out = K.valid_rows(K.normalise_psf(stream, zero(spark)))
    query = out.writeStream.format("memory").queryName("psf_stream").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("psf_stream").count() == 1


def test_missing_catalog_column_is_an_error(spark, tmp_path):
    path = str(tmp_path / "bad")
    psf(spark, {}).drop("sharp").write.parquet(path)
    with pytest.raises(Exception, match="sharp"):
        K.read_psf_rows(spark, path)


RAW = "product_id long, row_index long, num string, name string, class string, ra_hms string, dec_dms string, v_mag string, err string, d string, dra string, ddec string, dg string, dh string"


def test_known_object_rows(spark):
    base = (1, 0, "48606", "1995 DH", "MB", "17 02 18.5", "+12 17 01.0", "17.3", "0.1", "5", "10", "-3", "1.2", "2.2")
    def row(i, **c):
        names = [x.split(" ")[0] for x in RAW.split(", ")]
        return tuple({**dict(zip(names, base)), "row_index": i, **c}.values())
    rows = [row(0), row(1, num="-", dec_dms="-00 30 00"), row(2, v_mag="-", dg=""), row(3, ra_hms="bad"), row(4, err=None), row(5, num="x")]
    good, bad = K.normalise_known_objects(spark.createDataFrame(rows, RAW))
    out = {r.row_index: r for r in good.collect()}
    assert out[0].designation == "48606" and out[0].predicted_ra == pytest.approx(255.577083, abs=1e-6)
    assert out[1].designation == "1995 DH" and out[1].predicted_dec == pytest.approx(-0.5)
    assert out[2].v_magnitude is None and out[2].observer_distance_au is None
    assert sorted(r.row_index for r in bad.collect()) == [3, 4, 5]


def test_star_tsv(spark, tmp_path):
    head = "TYC1\tTYC2\tTYC3\tRAmdeg\tDEmdeg\tRA(ICRS)\tDE(ICRS)\tBTmag\tVTmag"
    lines = ["# comment", head, " \t \t \tdeg\tdeg\tdeg\tdeg\tmag\tmag", "----\t-----\t-\t---\t---\t---\t---\t---\t---",
             "1\t 22\t1\t10.5\t-3.0\t10.4\t-3.1\t6.0\t5.0", "2\t33\t1\t\t\t11.0\t4.0\t\t7.0", "3\t44\t1\t\t\t\t\t\t7.0"]
    path = tmp_path / "stars.tsv"
    path.write_text("\n".join(lines) + "\n")
    out = {r.star_id: r for r in K.read_star_tsv(spark, str(path)).collect()}
    assert set(out) == {"TYC 1-22-1", "TYC 2-33-1"}
    assert out["TYC 1-22-1"].v_mag == pytest.approx(4.91) and out["TYC 1-22-1"].star_ra == 10.5
    assert out["TYC 2-33-1"].v_mag == 7.0 and out["TYC 2-33-1"].position_source.startswith("observed")


def test_feature_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("F2", 1, None), ("F1", 2, 0.25)], "field_id string, n int, v double")
    path = str(tmp_path / "t")
    B.write_csv_table(df, path, ["field_id", "n"])
    back = B.read_csv_table(spark, path, "field_id string, n int, v double")
    assert [tuple(r) for r in back.orderBy("field_id").collect()] == [("F1", 2, 0.25), ("F2", 1, None)]


def test_materialise_computes_only_missing_fields(spark, tmp_path):
    seen = []
    def compute(fields):
        seen.append(sorted(r.field_id for r in fields.collect()))
        return fields.withColumn("v", F.length("field_id"))
    path = str(tmp_path / "parts")
    fields = spark.createDataFrame([("A",), ("BB",)], "field_id string")
    assert B.materialise(fields.where("field_id = 'A'"), path, compute).count() == 1
    assert B.materialise(fields, path, compute).count() == 2
    assert seen == [["A"], ["BB"]]


def test_replay_takes_the_first_snapshot(spark):
    a = spark.createDataFrame([("F1", 1)], "field_id string, v int")
    b = spark.createDataFrame([("F1", 9), ("F2", 2)], "field_id string, v int")
    fields = spark.createDataFrame([("F1",), ("F2",)], "field_id string")
    got = {r.field_id: (r.v, r.source) for r in B.replay(fields, {"a": a, "b": b}).collect()}
    assert got == {"F1": (1, "a"), "F2": (2, "b")}
    with pytest.raises(Exception, match="no stored snapshot"):
        B.replay(fields, {"a": a}).collect()


def test_digests(spark, tmp_path):
    import hashlib

    path = tmp_path / "x.txt"
    path.write_text("hello")
    out = B.file_digests(spark, str(path))
    assert out.first().sha256 == hashlib.sha256(b"hello").hexdigest()
    frozen = out.select("path", F.lit("0").alias("sha256"))
    with pytest.raises(Exception, match="differs from the frozen input"):
        B.verify_digests(out, frozen).collect()


def test_json_rows(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{\n "targets": [{"designation": "A"}, {"designation": "B"}]\n}')
    schema = "targets array<struct<designation:string>>"
    assert B.read_json_rows(spark, str(path), schema, "targets").count() == 2


EXP = "pid long, obsjd double, obsdate string, field int, ccdid int, qid int"


def exposures(spark, rows):
    return spark.createDataFrame([(p, 2458000.0 + m / 1440.0, d, 1, 1, q) for p, m, d, q in rows], EXP)


def test_triple(spark):
    rows = [(i, m, "2017-09-04", 1) for i, m in enumerate((0, 10, 40, 70, 100, 140, 160))]
    row = Q.pick_triples(exposures(spark, rows)).first()
    assert (row.e1.pid, row.e2.pid, row.e3.pid) == (0, 3, 5)
    close = [(i, m, "2017-09-04", 1) for i, m in enumerate((0, 10, 20))]
    assert Q.pick_triples(exposures(spark, close)).count() == 0


def test_first_middle_last_of_the_earliest_group(spark):
    rows = [(i, 500 + i, "2017-09-05", 1) for i in range(3)] + [(10 + i, i, "2017-09-04", 2) for i in range(4)]
    rows += [(30, 0, "2017-09-03", 3), (31, 1, "2017-09-03", 3)]
    out = Q.first_middle_last(exposures(spark, rows))
    assert sorted(r.pid for r in out.collect()) == [10, 11, 13]


def test_strict_stops_at_a_reject(spark):
    rows = spark.createDataFrame([(1, 2.0)], "product_id long, ra double")
    none = spark.createDataFrame([], "pid string, reason string")
    assert K.strict(rows, none).collect() == rows.collect()
    with pytest.raises(Exception, match="rejected row: missing ra"):
        K.strict(rows, spark.createDataFrame([("7", "missing ra")], none.schema)).collect()
