"""Exposure metadata, source catalogs and prediction rows: read and normalise.

The row functions are projections, so they also run on streaming DataFrames.
Bad rows go to a reject table with a reason; ``strict`` fails instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import MAX_SEQUENCE_FRAMES, MIN_SEQUENCE_FRAMES
from driftline.functions.sky import separation
from driftline.operators.guards import require

# Catalog columns, flag and URL layout of the archive.
PSF_SCHEMA = (
    "product_id long, row_index long, sourceid long, xpos double, ypos double, ra double, dec double,"
    " flux double, sigflux double, mag double, sigmag double, snr double, chi double, sharp double, flags int"
)
METADATA_SCHEMA = (
    "pid string, obsdate string, obsjd double, field string, filtercode string, ccdid string, qid string,"
    " filefracday string, imgtypecode string, exptime string"
)
EDGE_FLAG = -1
MAX_RESULTS = 10
MAX_SEARCH_RADIUS_DEGREES = 2.0
MAX_SEARCH_DAYS = 31.0
PSF_SUFFIX, IMAGE_SUFFIX = "psfcat.fits", "sciimg.fits"


# --- exposure metadata ------------------------------------------------------------


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Exposure metadata CSV with a header."""
    return spark.read.csv(path, header=True, schema=METADATA_SCHEMA)


def in_window(metadata: DataFrame, start_jd: float, end_jd: float) -> DataFrame:
    """Exposures with start <= jd < end (pushed down to the scan)."""
    if not start_jd < end_jd:
        raise ValueError("start_jd must be earlier than end_jd")
    return metadata.where((F.col("obsjd") >= start_jd) & (F.col("obsjd") < end_jd))


def map_observations(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects). Missing or ill-typed required fields reject
    the row; a missing exposure time is null."""
    required = ["pid", "obsdate", "field", "filtercode", "ccdid", "qid", "filefracday"]
    missing = ", ".join(f"if(coalesce(trim({c}), '') = '', '{c}', NULL)" for c in required)
    typed = {
        "product_id": "try_cast(pid AS BIGINT)",
        "observed_at": "try_to_timestamp(obsdate)",
        "field_no": "try_cast(field AS INT)",
        "ccd_id": "try_cast(ccdid AS INT)",
        "quadrant_id": "try_cast(qid AS INT)",
    }
    bad = ", ".join(f"if({e} IS NULL, '{n}', NULL)" for n, e in typed.items())
    exposure = "try_cast(nullif(trim(exptime), '') AS DOUBLE)"
    rows = metadata.selectExpr(
        "*",
        f"array_compact(array({missing})) AS _missing",
        f"array_compact(array({bad}, if(coalesce(trim(exptime), '') <> '' AND coalesce({exposure} <= 0, true),"
        " 'exposure_seconds', NULL))) AS _bad",
    )
    good = rows.where("size(_missing) = 0 AND size(_bad) = 0").selectExpr(
        *[f"{e} AS {n}" for n, e in typed.items()],
        "filtercode AS filter_code", "filefracday AS file_frac_day", f"{exposure} AS exposure_seconds",
        "obsjd",
    )
    rejects = rows.where("size(_missing) > 0 OR size(_bad) > 0").selectExpr(
        "pid",
        "if(size(_missing) > 0, concat('missing required field(s): ', array_join(_missing, ', ')),"
        " concat('invalid field(s): ', array_join(_bad, ', '))) AS reason",
    )
    return good, rejects


def observations_by_id(observations: DataFrame, ids: DataFrame) -> DataFrame:
    """Observations of the given product ids in time order; an unknown id is
    an error."""
    joined = ids.select("product_id").distinct().join(
        observations.withColumn("_found", F.lit(True)), "product_id", "left"
    )
    message = F.concat(F.lit("no metadata for product id "), F.col("product_id").cast("string"))
    return require(joined, F.col("_found"), message).drop("_found").orderBy("observed_at", "product_id")


def first_observations(observations: DataFrame, n: int = MAX_RESULTS) -> DataFrame:
    """The first n observations by time and id."""
    return observations.orderBy("observed_at", "product_id").limit(n)


def box_search(
    observations: DataFrame, ra: float, dec: float, radius_deg: float, start_jd: float, end_jd: float
) -> DataFrame:
    """Exposures whose centre lies in the box of side 2·radius, time ordered.

    ``observations`` has ``center_ra, center_dec, obsjd``.
    """
    if not 0.0 <= ra < 360.0:
        raise ValueError("ra must be in [0, 360)")
    if not -90.0 <= dec <= 90.0:
        raise ValueError("dec must be in [-90, 90]")
    if not 0.0 < radius_deg <= MAX_SEARCH_RADIUS_DEGREES:
        raise ValueError(f"radius must be in (0, {MAX_SEARCH_RADIUS_DEGREES}] degrees")
    if end_jd - start_jd > MAX_SEARCH_DAYS:
        raise ValueError(f"the window may be at most {MAX_SEARCH_DAYS:g} days")
    dra = f"abs(pmod(center_ra - {ra!r}D + 180D, 360D) - 180D) * cos(radians({dec!r}D))"
    return (
        in_window(observations, start_jd, end_jd)
        .where(f"{dra} <= {radius_deg!r}D AND abs(center_dec - {dec!r}D) <= {radius_deg!r}D")
        .orderBy("observed_at", "product_id")
    )


def strict(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """``rows`` of a normalisation that must not reject any: the job stops at
    the first reject with its ``reason``."""
    message = F.concat(F.lit("rejected row: "), F.coalesce(F.col("reason"), F.lit("no reason given")))
    failed = require(rejects, F.col("reason").isNull() & F.col("reason").isNotNull(), message)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.unionByName(failed.select(*nothing))


def check_request_ids(
    requests: DataFrame, low: int = MIN_SEQUENCE_FRAMES, high: int = MAX_SEQUENCE_FRAMES
) -> DataFrame:
    """``build_id, product_ids``: 3 to 10 distinct ids per build, else error."""
    n = F.size("product_ids")
    ok = (n >= low) & (n <= high) & (F.size(F.array_distinct("product_ids")) == n)
    return require(requests, ok, f"a build needs {low} to {high} different product ids")


def mid_exposure(observations: DataFrame) -> DataFrame:
    """Adds ``mid_exposure_at`` and its Julian day; no exposure is an error."""
    rows = require(
        observations, F.col("exposure_seconds").isNotNull(), "exposure time is needed for the mid time"
    )
    micros = F.unix_micros("observed_at") + F.round(F.col("exposure_seconds") * 5e5).cast("long")
    rows = rows.withColumn("mid_exposure_at", F.timestamp_micros(micros))
    return rows.withColumn(
        "mid_exposure_jd", F.unix_micros("mid_exposure_at") / 86400e6 + 2440587.5
    )


def product_path(observations: DataFrame, suffix: str, name: str = "path") -> DataFrame:
    """Archive path of an exposure's product; the fractional day needs 14
    digits."""
    rows = require(
        observations, F.col("file_frac_day").rlike("^[0-9]{14}$"), "file_frac_day must contain 14 digits"
    )
    d = F.col("file_frac_day")
    file = F.format_string(
        f"ztf_%s_%06d_%s_c%02d_o_q%d_{suffix}", d, "field_no", "filter_code", "ccd_id", "quadrant_id"
    )
    return rows.withColumn(
        name,
        F.concat_ws("/", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 6), file),
    )


# --- source catalogs ---------------------------------------------------------------


def read_psf_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Catalog rows; a missing column is an error, others are not read."""
    wanted = [c.strip().split(" ")[0] for c in PSF_SCHEMA.split(",")]
    reader = spark.read.schema(PSF_SCHEMA) if fmt in ("csv", "json") else spark.read
    rows = reader.format(fmt).option("header", True).load(path)
    return rows.select(*wanted)


_RULES = (
    ("ra", "ra >= 0 AND ra < 360", "must be in [0, 360)"),
    ("dec", "dec >= -90 AND dec <= 90", "must be in [-90, 90]"),
    ("x", "true", ""),
    ("y", "true", ""),
    ("magnitude", "true", ""),
    ("magnitude_error", "magnitude_error >= 0", "must not be negative"),
    ("snr", "snr >= 0", "must not be negative"),
)


def _finite(c: str) -> str:
    return f"({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < CAST('Infinity' AS DOUBLE))"


def normalise_psf(rows: DataFrame, zero_points: DataFrame) -> DataFrame:
    """Detections with calibrated magnitudes and the reasons against each row.

    ``zero_points``: one row per frame (``product_id, magzp``). A frame
    without zero point fails. ``reasons`` is empty for a valid detection;
    flags never reject. ``sharp`` is null when not finite.
    """
    joined = rows.join(zero_points, "product_id", "left")
    message = F.concat(
        F.lit("no MAGZP for product "), F.col("product_id").cast("string"),
        F.lit(": magnitudes cannot be calibrated"),
    )
    joined = require(joined, F.col("magzp").isNotNull(), message)
    mapped = joined.selectExpr(
        "product_id",
        "row_index",
        "concat(product_id, '-', sourceid) AS source_id",
        "ra",
        "dec",
        "xpos AS x",
        "ypos AS y",
        "mag + magzp AS magnitude",
        "sigmag AS magnitude_error",
        "snr",
        f"flags = {EDGE_FLAG} AS on_image_edge",
        "greatest(flags, 0) AS mask_bits",
        f"if({_finite('sharp')}, sharp, NULL) AS sharp",
        "sourceid IS NULL OR flags IS NULL AS _unreadable",
    )
    reasons = ["if(_unreadable, 'unreadable row', NULL)"]
    for name, rule, text in _RULES:
        reasons.append(
            f"CASE WHEN NOT {_finite(name)} THEN '{name}: must be a finite number'"
            f" WHEN NOT ({rule}) THEN '{name}: {text}' END"
        )
    return mapped.selectExpr(
        *[c for c in mapped.columns if c != "_unreadable"],
        f"array_compact(array({', '.join(reasons)})) AS reasons",
    )


def valid_rows(normalised: DataFrame) -> DataFrame:
    return normalised.where(F.size("reasons") == 0).drop("reasons")


def rejected_rows(normalised: DataFrame) -> DataFrame:
    """Rejected rows with their reasons in field order."""
    return normalised.where(F.size("reasons") > 0).select(
        "product_id", "row_index", F.array_join("reasons", "; ").alias("reason")
    )


def negative_flag_counts(rows: DataFrame) -> DataFrame:
    """Raw negative flags per frame and value."""
    return rows.where("flags < 0").groupBy("product_id", "flags").agg(F.count("*").alias("rows"))


def frame_metadata(metadata: DataFrame, ids: DataFrame) -> DataFrame:
    """Centre, corners, depth, seeing and airmass of frames; unknown ids fail."""
    points = ", ".join(f"named_struct('ra', ra{i}, 'dec', dec{i})" for i in range(1, 5))
    rows = ids.select("product_id").distinct().join(
        metadata.withColumn("_found", F.lit(True)), "product_id", "left"
    )
    message = F.concat(F.lit("no metadata for product id "), F.col("product_id").cast("string"))
    return require(rows, F.col("_found"), message).selectExpr(
        "product_id", "center_ra", "center_dec", f"array({points}) AS corners", "maglimit", "seeing", "airmass"
    )


# --- known-object rows -------------------------------------------------------------


def _optional(c: str) -> str:
    return f"try_cast(nullif(nullif(trim({c}), ''), '-') AS DOUBLE)"


def _sexagesimal(c: str) -> str:
    """Sexagesimal text to units of its first part; the sign may be on zero."""
    parts = f"split(regexp_replace(trim({c}), '^[+-]', ''), '[ :]+')"
    size = " + ".join(f"try_cast({parts}[{i}] AS DOUBLE) / {k}D" for i, k in enumerate((1, 60, 3600)))
    return f"(if(trim({c}) LIKE '-%', -1D, 1D) * ({size}))"


def normalise_known_objects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ephemerides, rejects) of raw prediction rows.

    ``rows``: ``product_id, row_index, num, name, class, ra_hms, dec_dms,
    v_mag, err, d, dra, ddec, dg, dh`` (text). The designation is the number
    where there is one, else the name; "-" and "" mean missing.
    """
    number = "try_cast(nullif(nullif(trim(num), ''), '-') AS INT)"
    values = {
        "designation": f"coalesce(CAST({number} AS STRING), trim(name))",
        "number": number,
        "name": "trim(name)",
        "object_class": "class",
        "predicted_ra": f"pmod({_sexagesimal('ra_hms')} * 15D, 360D)",
        "predicted_dec": _sexagesimal("dec_dms"),
        "v_magnitude": _optional("v_mag"),
        "position_error_arcsec": "try_cast(err AS DOUBLE)",
        "d_arcsec": "try_cast(d AS DOUBLE)",
        "motion_ra": "try_cast(dra AS DOUBLE)",
        "motion_dec": "try_cast(ddec AS DOUBLE)",
        "observer_distance_au": _optional("dg"),
        "heliocentric_distance_au": _optional("dh"),
    }
    needed = ["name", "object_class", "predicted_ra", "predicted_dec", "position_error_arcsec",
              "d_arcsec", "motion_ra", "motion_dec"]
    mapped = rows.selectExpr(
        "product_id", "row_index", *[f"{e} AS {n}" for n, e in values.items()],
        f"coalesce(trim(num), '') NOT IN ('', '-') AND {number} IS NULL AS _bad_number",
        f"coalesce(trim(v_mag), '') NOT IN ('', '-') AND {_optional('v_mag')} IS NULL AS _bad_v",
    )
    checks = ["if(_bad_number, 'number', NULL)", "if(_bad_v, 'v_magnitude', NULL)"]
    checks += [f"if({n} IS NULL, '{n}', NULL)" for n in needed]
    checks.append("if(abs(predicted_dec) > 90 OR position_error_arcsec < 0, 'range', NULL)")
    mapped = mapped.withColumn("_bad", F.expr(f"array_compact(array({', '.join(checks)}))"))
    good = mapped.where("size(_bad) = 0").drop("_bad", "_bad_number", "_bad_v")
    rejects = mapped.where("size(_bad) > 0").selectExpr(
        "product_id", "row_index", "concat('unreadable: ', array_join(_bad, ', ')) AS reason"
    )
    return good, rejects


# --- star catalog ------------------------------------------------------------------


def read_star_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Star catalog TSV: comment lines, header, a unit and a dash line."""
    rows = spark.read.csv(path, sep="\t", comment="#", header=True)
    return parse_stars(rows)


def parse_stars(rows: DataFrame) -> DataFrame:
    """Stars from raw text rows; without any position a row is dropped. The
    unit and dash lines have no numeric catalog id and drop out as well."""
    from driftline.functions.classify import johnson_v

    def number(c: str) -> str:
        return f"try_cast(nullif(trim(`{c}`), '') AS DOUBLE)"

    mean = f"{number('RAmdeg')} IS NOT NULL AND {number('DEmdeg')} IS NOT NULL"
    return rows.where("try_cast(trim(TYC1) AS INT) IS NOT NULL").selectExpr(
        "concat('TYC ', trim(TYC1), '-', trim(TYC2), '-', trim(TYC3)) AS star_id",
        f"if({mean}, {number('RAmdeg')}, {number('RA(ICRS)')}) AS star_ra",
        f"if({mean}, {number('DEmdeg')}, {number('DE(ICRS)')}) AS star_dec",
        f"{number('VTmag')} AS vt_mag",
        f"{number('BTmag')} AS bt_mag",
        f"if({mean}, 'mean J2000', 'observed ~J1991.25') AS position_source",
    ).where("star_ra IS NOT NULL AND star_dec IS NOT NULL").selectExpr(
        "*", f"{johnson_v('vt_mag', 'bt_mag')} AS v_mag"
    )


def star_cone(stars: DataFrame, ra: float, dec: float, radius_deg: float, vt_max: float) -> DataFrame:
    inside = separation("star_ra", "star_dec", ra, dec)
    return stars.where(f"vt_mag < {vt_max!r}D").where(f"{inside} <= {radius_deg * 3600.0!r}D")
