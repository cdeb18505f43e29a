"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of similar size. A block is a matrix of bits
with a column for each document; a term sets the rows its hashes name, once for
each step of its number of occurrences. The rows are stored as bitmaps over the documents
(slices), so the documents that may hold a term so often are the intersection of
a few slices. It holds all that do and few others.

A search adds, for each term of an item, its weight times the largest share that the
step allows for the document's length: an upper bound of the score. The documents with the
highest bounds are scored exactly from their texts; the fiftieth of these scores is a
threshold that no document below can pass. Then every document whose bound reaches
the threshold is scored exactly, and the best are returned. Bounds are sums of
whole numbers below 2^53, so they are exact too.

Items come in blocks of bounded text, and each block is held against all
documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, stored

# Fixed values of the score, and how many documents an item gets.
TOP = 50
WEIGHT_SCALE, SHARE_SCALE, TF_SCALE, LENGTH_SCALE = 1000, 1_000_000_000, 1000, 20
LENGTH_BASE, LENGTH_PART = 50, 50
# A term has one entry for each of these numbers of occurrences that it reaches.
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 1024)
# Slices of a term; bits of a document for each entry; size of a block.
HASHES, BITS_PER_ENTRY = 8, 16
BLOCK_DOCS, BLOCK_BITS = 2048, 1 << 23
HELD_TERMS = 300_000
# A block of items has about so many characters; cells and terms worked on at once.
ITEM_CHARS = 1 << 18
CELLS, TERMS = 1 << 21, 4096


def _classes() -> bytes:
    """Bytes of terms to themselves (only A-Z lower-cased), the rest to space."""
    keep = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in keep else 32 for b in range(256))


TABLE = _classes()


def term_counts(text: str | None) -> Counter:
    """Terms (UTF-8 bytes) with their occurrences."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(TABLE).split())


# --- index ---

BLOCK_SCHEMA = (
    "width int, ids array<long>, hashes array<long>, sizes array<long>, slices binary,"
    " docs long, terms long, term string, df long"
)
_BLOCK_TYPES = pa.schema([
    ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("slices", pa.binary()), ("docs", pa.int64()), ("terms", pa.int64()), ("term", pa.string()), ("df", pa.int64()),
])


def _rows(places: np.ndarray, width: int) -> np.ndarray:
    """The slices of each hash: (entries, HASHES) for a power of two ``width``."""
    step = (places >> np.uint64(32)) | np.uint64(1)
    spread = places[..., None] + step[..., None] * np.arange(HASHES, dtype=np.uint64)
    return (spread & np.uint64(width - 1)).astype(np.int64)


def _entries(hashes: np.ndarray, step: int) -> np.ndarray:
    """The hashes of terms at a step of their number of occurrences."""
    mixed = (hashes + np.uint64(step)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


class Block:
    """Documents of one width that wait to be written."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.most = min(BLOCK_DOCS, max(8, BLOCK_BITS // width))
        self.docs: list[tuple] = []

    def add(self, doc: tuple) -> bool:
        self.docs.append(doc)
        return len(self.docs) >= self.most

    def batch(self) -> pa.RecordBatch:
        n = len(self.docs)
        bits = np.zeros((self.width, -(-n // 8) * 8), dtype=bool)
        counts = [len(d[3]) for d in self.docs]
        owner = np.repeat(np.arange(n), counts)
        hashes, tfs = np.concatenate([d[3] for d in self.docs]), np.concatenate([d[4] for d in self.docs])
        for s, least in enumerate(STEPS):
            reach = tfs >= least
            if not reach.any():
                break
            hashes, tfs, owner = hashes[reach], tfs[reach], owner[reach]
            bits[_rows(_entries(hashes, s), self.width), owner[:, None]] = True
        ids, texts, sizes = ([d[k] for d in self.docs] for k in range(3))
        row = [self.width, ids, texts, sizes, np.packbits(bits, axis=1, bitorder="little").tobytes(), n, sum(sizes), None, None]
        self.docs = []
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _BLOCK_TYPES, strict=True)], schema=_BLOCK_TYPES)


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, and partial document counts of terms."""
    digest = xxhash.xxh64_intdigest
    blocks: dict[int, Block] = {}
    held: Counter = Counter()

    def frequencies() -> pa.RecordBatch:
        none = [pa.nulls(len(held), f.type) for f in list(_BLOCK_TYPES)[:-2]]
        words = pa.array([t.decode("utf-8", "replace") for t in held], pa.string())
        return pa.RecordBatch.from_arrays([*none, words, pa.array(list(held.values()), pa.int64())], schema=_BLOCK_TYPES)

    for batch in batches:
        for key, h, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            counts = term_counts(text.as_py())
            if not counts:
                continue
            held.update(counts.keys())
            hashes = np.fromiter(map(digest, counts), np.uint64, len(counts))
            tfs = np.fromiter(counts.values(), np.int64, len(counts))
            entries = sum(int((tfs >= least).sum()) for least in STEPS[:8])
            width = max(256, 1 << (BITS_PER_ENTRY * entries - 1).bit_length())
            block = blocks.setdefault(width, Block(width))
            if block.add((key.as_py(), h.as_py(), int(tfs.sum()), hashes, tfs)):
                yield block.batch()
            if len(held) >= HELD_TERMS:
                yield frequencies()
                held.clear()
    for block in blocks.values():
        if block.docs:
            yield block.batch()
    if held:
        yield frequencies()


def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, text``: rows of one id are told apart by a hash of the text."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")
    )


class SearchIndex:
    """Signatures of all documents and the document counts of all terms."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.rows = document_rows(docs, id_col, text_col)
        parts = stored(map_rows(self.rows, index_rows, BLOCK_SCHEMA), "signatures")
        self.blocks = parts.where("width IS NOT NULL").select("width", "ids", "hashes", "sizes", "slices")
        self.frequencies = parts.where("term IS NOT NULL").select("term", "df")
        total = parts.where("width IS NOT NULL").agg(F.sum("docs"), F.sum("terms")).first()
        self.documents, self.terms = total[0] or 0, total[1] or 0

    def length_factor(self, size: np.ndarray | int):
        return LENGTH_BASE + LENGTH_PART * size * self.documents // max(self.terms, 1)

    def weight(self, df: int) -> int:
        return math.floor(WEIGHT_SCALE * math.log((2 * self.documents + 2) / (2 * df + 1)))


# --- search ---


class ItemBlock:
    """Items with the weights of their terms: bounded by the text of a block."""

    def __init__(self, items: list[tuple[int, list[bytes]]], df: dict[bytes, int], index: SearchIndex) -> None:
        self.documents, self.terms = index.documents, index.terms
        known = sorted(df)
        place = {t: n for n, t in enumerate(known)}
        self.keys = [key for key, _ in items]
        self.known = known
        self.weights = np.array([index.weight(df[t]) for t in known], dtype=np.int64)
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in known], dtype=np.uint64)
        self.members = [np.array(sorted(place[t] for t in terms if t in place), dtype=np.int64) for _, terms in items]

    def length_factor(self, size):
        return LENGTH_BASE + LENGTH_PART * size * self.documents // max(self.terms, 1)

    def share(self, tf, m):
        return SHARE_SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m)

    def bounds(self, width: int, sizes: np.ndarray, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(first column, upper bounds of (items, columns)) of a block."""
        docs = len(sizes)
        matrix = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
        m = self.length_factor(sizes)
        shares = []  # the largest share a document's term may have at a step
        for s in range(len(STEPS)):
            roof = np.minimum(STEPS[s + 1] - 1, sizes) if s + 1 < len(STEPS) else sizes
            shares.append(self.share(roof, m).astype(np.float64))
        # Slices of the terms, step by step: only terms that some document holds go on.
        steps, alive = [], np.arange(len(self.known))
        found = None
        for s in range(len(STEPS)):
            rows = _rows(_entries(self.hashes[alive], s), width)
            here = np.concatenate([
                np.bitwise_and.reduce(matrix[rows[at : at + TERMS]], axis=1) for at in range(0, len(rows), TERMS)
            ])
            if found is not None:
                here &= found
            some = here.any(axis=1)
            alive, found = alive[some], here[some]
            if not len(alive):
                break
            steps.append((alive, found))
        columns = max(8, CELLS // len(self.known) // 8 * 8)
        for start in range(0, docs, columns):
            stop = min(docs, start + columns)
            parts = np.zeros((len(self.known), stop - start))
            for s, (terms, bits) in enumerate(steps):
                on = np.unpackbits(bits[:, start // 8 : -(-stop // 8)], axis=1, bitorder="little")[:, : stop - start]
                more = shares[s][start:stop] - (shares[s - 1][start:stop] if s else 0.0)
                parts[terms] += on * more
            parts *= self.weights[:, None]
            yield start, np.stack([parts[own].sum(axis=0) for own in self.members])

    def score(self, counts: Counter, item: int) -> int:
        m = self.length_factor(counts.total())
        return sum(
            int(self.weights[t]) * int(self.share(counts[self.known[t]], m))
            for t in self.members[item].tolist() if self.known[t] in counts
        )


BOUND_SCHEMA = "item int, id long, h long, bound double"
_BOUND_NAMES = ["item", "id", "h", "bound"]


def _bound_batch(item, ids, hashes, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(bound, pa.float64())],
        names=_BOUND_NAMES,
    )


def _blocks(batches: Iterator[pa.RecordBatch], query: ItemBlock):
    for batch in batches:
        for width, ids, hashes, sizes, slices in zip(*batch.columns, strict=True):
            sizes = sizes.values.to_numpy()
            for start, bound in query.bounds(width.as_py(), sizes, slices.as_py()):
                yield ids.values, hashes.values, start, bound


def best_bounds(query: ItemBlock, top: int):
    """The documents with the highest bounds of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(query.keys)
        bounds, ids, hashes = [np.zeros(0)] * items, [[]] * items, [[]] * items
        least = np.zeros(items)
        for own_ids, own_hashes, start, bound in _blocks(batches, query):
            for i in np.flatnonzero(bound.max(axis=1) > least).tolist():
                new = np.flatnonzero(bound[i] > least[i])
                both = np.concatenate([bounds[i], bound[i][new]])
                at = (new + start).tolist()
                all_ids = ids[i] + [own_ids[k].as_py() for k in at]
                all_hashes = hashes[i] + [own_hashes[k].as_py() for k in at]
                order = np.argsort(-both, kind="stable")[:top].tolist()
                bounds[i], ids[i], hashes[i] = both[order], [all_ids[k] for k in order], [all_hashes[k] for k in order]
                if len(order) == top:
                    least[i] = bounds[i][-1]
        for i in range(items):
            if len(bounds[i]):
                yield _bound_batch([i] * len(bounds[i]), ids[i], hashes[i], bounds[i])

    return run


def open_bounds(query: ItemBlock, thresholds: np.ndarray):
    """Every document that an item's threshold does not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.maximum(thresholds, 1)[:, None]
        for ids, hashes, start, bound in _blocks(batches, query):
            item, at = np.nonzero(bound >= floor)
            if len(item):
                place = pa.array(at + start)
                yield _bound_batch(item, ids.take(place), hashes.take(place), bound[item, at])

    return run


def exact_rows(query: ItemBlock):
    """``item, id, score`` of documents with the items to score them for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, items in zip(*batch.columns, strict=True):
                counts = term_counts(text.as_py())
                for item in items.as_py():
                    out.append((item, key.as_py(), query.score(counts, item)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "id", "score"]
            )

    return run


def _first(df: DataFrame, value: str, top: int) -> DataFrame:
    """The best rows of each item, with ``rank``; ids ascend among equals."""
    order = Window.partitionBy("item").orderBy(F.desc(value), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _scored(index: SearchIndex, query: ItemBlock, wanted: DataFrame) -> DataFrame:
    """Exact scores of ``wanted`` (``item, id, h``): each text is read once."""
    by_doc = stored(
        wanted.groupBy("id", "h").agg(F.collect_set("item").alias("items")).withColumnsRenamed({"id": "w_id", "h": "w_h"}),
        "wanted",
    )
    found = index.rows.join(by_doc, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    return map_rows(found.select("id", "text", "items"), exact_rows(query), "item int, id long, score long").where("score > 0")


def search_block(index: SearchIndex, query: ItemBlock, top: int = TOP) -> DataFrame:
    """``item, id, score, rank`` for the items of a block."""
    likely = map_rows(index.blocks, best_bounds(query, top), BOUND_SCHEMA)
    first = _first(_scored(index, query, _first(likely, "bound", top).select("item", "id", "h")), "score", top)
    thresholds = np.zeros(len(query.keys))
    for item, n, least in first.groupBy("item").agg(F.count("*"), F.min("score")).collect():
        thresholds[item] = least if n >= top else 0
    left = map_rows(index.blocks, open_bounds(query, thresholds), BOUND_SCHEMA)
    return _first(_scored(index, query, left.select("item", "id", "h")), "score", top)


def item_blocks(items: DataFrame, chars: int = ITEM_CHARS) -> Iterator[list[tuple]]:
    """Rows ``key, text`` in blocks of about ``chars`` characters of text; one
    block at a time comes to the driver."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / chars))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        if rows := own.collect():
            yield [(r["key"], r["text"]) for r in rows]


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", top: int = TOP, item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's best documents.

    * null or empty text, text without terms: neither a document nor a query
    * null doc_id: a document like others, last among equal scores
    * repeated document rows: each is a document of its own
    * repeated items (equal id and text) count once; of equal ids with several
      texts each text has its own ranks; a null item_id stays null
    * very long text: its block has fewer documents and more slices
    * empty tables: empty result; other columns are not read
    """
    index = SearchIndex(docs, id_col, text_col)
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("key"), F.col(f"`{item_text}`").alias("text"))
    asked = stored(asked.where("text IS NOT NULL").distinct(), "items")
    out = None
    for rows in item_blocks(asked, item_chars):
        terms = [(key, sorted(term_counts(text))) for key, text in rows]
        names = sorted({t for _, own in terms for t in own})
        names = docs.sparkSession.createDataFrame([(t.decode("utf-8", "replace"),) for t in names], "name string")
        counted = index.frequencies.join(names, F.col("term") == F.col("name")).groupBy("term").agg(F.sum("df").alias("df"))
        df = {r["term"].encode(): r["df"] for r in counted.collect()}
        query = ItemBlock(terms, df, index)
        if not df:
            continue
        best = search_block(index, query, top)
        keys = docs.sparkSession.createDataFrame(list(enumerate(query.keys)), "number int, item_id long")
        found = best.join(keys, F.col("item") == F.col("number")).select(
            "item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
