"""WARC archives with a zstandard dictionary of their own.

An archive is one file: a skippable frame that holds the dictionary, then one
independently compressed frame per record, so that any record can be read
with the dictionary alone. The dictionary is trained on records of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, scratch_folder, stored

# Frame magics and the revisit profile of the published formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_FROM_BYTES = 1000
ARCHIVE_BYTES = 24 << 20
# Bounds of the records a dictionary is trained on and of its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 48 << 10
COLUMNS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


# --- one record ---


def _uri(url: str | None) -> str:
    """A header value holds no white space or control characters."""
    return "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The bytes of one response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Truncated: length"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; of a response its payload is measured anew, of a
    revisit the headers speak for the payload that it refers to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    else:
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        digest = stated
    number = lambda name: int(n) if (n := fields.get(name, "")[10:-1]) else None
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI", ""), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload,
    }


# --- one archive ---


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from evenly spaced records; of few or tiny records, whose
    training fails, their plain content."""
    total = sum(map(len, records))
    every = max(1, -(-total // SAMPLE_BYTES))
    samples = records[::every]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    """Skippable frame with the dictionary, then one frame per record."""
    dictionary = build_dictionary(records)
    out = io.BytesIO()
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
    for r in records:
        out.write(compressor.compress(r))
    return out.getvalue()


def read_archive(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """Records of an archive, one at a time."""
    at, view, shared = 0, memoryview(data), None
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if magic == DICTIONARY_MAGIC and size:
                shared = zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size])
            at += 8 + size
            continue
        frame, parts = zstandard.ZstdDecompressor(dict_data=shared).decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(view[at : at + step]))
            at += min(step, len(data) - at)
        at -= len(frame.unused_data)
        yield b"".join(parts)


# --- tables ---


def _put(filesystem: fs.FileSystem, path: str, data: bytes) -> None:
    """Whole files only: a lost or repeated task leaves no half of one."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part) as out:
        out.write(data)
    filesystem.move(part, path)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, url, payload, revisit, refers_to``: which records revisit.

    Of equal payloads of at least 1000 bytes the largest id answers; rows that
    repeat that id answer too, all others revisit it. Null ids never answer
    for others unless all are null, then all answer.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{body_col}`"), F.lit("")).cast("binary").alias("payload"),
    )
    # Small payloads never revisit: a short hash of the row deals them out evenly.
    own = F.unhex(F.hex(F.xxhash64("page_id", "url")))
    rows = rows.withColumn(
        "digest", F.when(F.length("payload") >= REVISIT_FROM_BYTES, F.unhex(F.sha2("payload", 256))).otherwise(own)
    )
    groups = rows.where(F.length("payload") >= REVISIT_FROM_BYTES).groupBy("digest").agg(F.max("page_id").alias("answer"), F.count("*").alias("n"))
    # Stored, so that the join deals both sides out and can split a hot payload.
    repeated = stored(groups.where("n > 1 AND answer IS NOT NULL").select("digest", "answer"), "payloads")
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload",
        (F.col("answer").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("answer"))).alias("revisit"),
        F.col("answer").alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``*.warc.zst`` files below ``folder`` (a URI that all executors
    share) and return ``archive, records, bytes``, one row per file.

    Null html is an empty payload, null or odd URLs are percent-encoded, null
    ids give records without a number, an empty table no file. Rows of an archive
    beyond ``archive_bytes`` go to its next file, so a task holds one file's
    records whatever shares a key.
    """
    planned = plan_records(pages, id_col, url_col, body_col)
    total = pages.agg(F.sum(F.octet_length(F.col(f"`{body_col}`")) + 512)).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        held, size, at, part = [], 0, None, 0

        def close():
            name = f"{at:06d}-{part:04d}.warc.zst"
            data = write_archive(held)
            _put(filesystem, f"{base}/{name}", data)
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())],
                ["archive", "records", "bytes"],
            )

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                archive, page_id, url, payload, revisit, refers_to = (v.as_py() for v in row)
                if held and (archive != at or size >= archive_bytes):
                    yield close()
                    part = part + 1 if archive == at else 0
                    held, size = [], 0
                at = archive
                held.append(record(page_id, url, payload, refers_to, revisit, date))
                size += len(held[-1])
        if held:
            yield close()

    dealt = planned.select(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(archives)).alias("archive"),
        "page_id", "url", "payload", "revisit", "refers_to",
    )
    ordered = dealt.repartition(archives, "archive").sortWithinPartitions("archive", "page_id", "url")
    return map_rows(ordered, run, "archive string, records bigint, bytes bigint")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``folder``; ``payload`` if wanted (empty
    for revisits)."""
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["payload"] * payloads
    schema = COLUMNS + ", payload binary" * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: dict[str, list] = {n: [] for n in names}
                size = 0
                for data in read_archive(content.as_py()):
                    found = parse(data)
                    for n in names:
                        rows[n].append(found[n])
                    size += len(data)
                    if payloads and size > ARCHIVE_BYTES // 4:
                        yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.string())) for n in names], names)
                        rows, size = {n: [] for n in names}, 0
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.string())) for n in names], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return map_rows(files, run, schema)


def archive_and_read(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write the archives of ``pages`` (to a scratch folder if none is named)
    and read them back, without payloads."""
    spark = pages.sparkSession
    folder = folder or scratch_folder(spark, "warc")
    written = write_archives(pages, folder, **columns)
    if not written.agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], COLUMNS)
    return read_archives(spark, folder, payloads=False)
