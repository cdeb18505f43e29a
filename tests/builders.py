"""Small hand-made inputs."""

from pyspark.sql import functions as F

DETECTION = (
    "build_id long, frame_no int, det_no long, ra double, dec double, magnitude double,"
    " magnitude_error double, snr double, on_image_edge boolean, mask_bits int, sharp double"
)


def sky(ra0, dec0, east, north):
    """Position at small offsets in arcsec."""
    import math

    return ra0 + east / 3600.0 / math.cos(math.radians(dec0)), dec0 + north / 3600.0


def detections(spark, frames, build=1, **values):
    """``frames``: list of lists of (ra, dec), one list per frame."""
    base = dict(magnitude=19.0, magnitude_error=0.05, snr=20.0, on_image_edge=False, mask_bits=0, sharp=0.1)
    base.update(values)
    rows = [
        (build, f, i, float(ra), float(dec), *base.values())
        for f, points in enumerate(frames)
        for i, (ra, dec) in enumerate(points)
    ]
    return spark.createDataFrame(rows, DETECTION)


def frames(spark, minutes, build=1):
    rows = [(build, i, float(m)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "build_id long, frame_no int, minutes double")


def member_ids(df):
    """Sets of (frame, det) of a tracklet table."""
    rows = df.select(F.expr("transform(members, m -> struct(m.frame_no, m.det_no))").alias("m")).collect()
    return [tuple((x[0], x[1]) for x in r.m) for r in rows]
