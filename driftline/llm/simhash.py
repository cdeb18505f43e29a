"""Near duplicates by SimHash, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is four segments of 16 bits. The perfect binary Golay code
of length 23 assigns every word a nearest codeword at distance three or less,
and every codeword has a 12-bit index. Of two words that differ in one bit, the
nearest codeword of the first is at distance four or less from the second; such
codewords are one (the nearest is at distance two or less) or six (at three).
So one side gives one index, the other one to six, and the two meet.

At most three errors leave one segment whole (pigeonhole), and of any two others
at least one holds at most one error: two with two or more each would be four.
The keys of a fingerprint are therefore (whole segment i, index of segment i+1)
and (whole segment i, index of segment i+2) for each i: 28 bits, 8 keys on one
side and about 42 on the other.

Distinct fingerprints meet by key in sorted partitions, and only pairs that are
verified there leave a task, as a forest, so a dense cluster gives as many links
as it has members. A key with very many comparisons is not worked through: its
fingerprints get further keys (a quarter of the bits not yet equal, again by
pigeonhole) and meet in a next round, until no such key is left. Every round
fixes more bits, so they end, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import SPACE_BYTES, map_rows, stored
from driftline.operators.groups import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
# Seed of the shingle hash; generator polynomial and sizes of the code.
SEED = 42
GOLAY = 0b110001110101
LENGTH, CHECK_BITS = 23, 11
SEGMENTS, SEGMENT_BITS = 4, 16
# Texts are read in pieces, hashes are summed in blocks.
PIECE_BYTES, BLOCK_HASHES = 1 << 20, 500_000
# A key with more comparisons than this is split further.
HOT_COMPARISONS = 1 << 22
COMPARISONS = 1 << 20
LANES = np.uint64(0x0101010101010101)


# --- fingerprints ---


def word_pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about ``size`` bytes; each starts with
    the last two words of the one before."""
    start, words = 0, []
    while True:
        end = start + size
        while end < len(data) and data[end] not in SPACE_BYTES:
            end += 1
        words = words[-(SHINGLE_WORDS - 1) :] + data[start:end].split()
        yield words
        start = end
        if start >= len(data):
            return


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        return np.array([digest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    offsets = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=offsets[1:])
    pairs = zip(offsets[:-SHINGLE_WORDS].tolist(), (offsets[SHINGLE_WORDS:] - 1).tolist(), strict=True)
    return np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype=np.uint64)


def text_hashes(data: bytes) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, piece by piece."""
    some = False
    for words in word_pieces(data):
        if len(words) >= SHINGLE_WORDS:
            some = True
            yield shingle_hashes(words)
    if not some:
        yield shingle_hashes(data.split())


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set among each document's hashes.

    Eight bits at a time are added in the byte lanes of one 64-bit number, at
    most 255 hashes together.
    """
    out = np.zeros((len(counts), 64), dtype=np.int64)
    if not len(hashes):
        return out
    pieces = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), pieces)
    first = np.cumsum(counts) - counts
    starts = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sums = np.empty((len(owner), 8, 8), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts)
        sums[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    np.add.at(out, owner, sums.reshape(-1, 64))
    return out


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, counts, owners, held = [], [], [], 0
        sums = np.zeros((batch.num_rows, 64), dtype=np.int64)
        totals = np.zeros(batch.num_rows, dtype=np.int64)

        def flush():
            n = np.array(counts, dtype=np.int64)
            some = n > 0
            if some.any():
                at = np.array(owners)[some]
                np.add.at(sums, at, bit_counts(np.concatenate(hashes), n[some]))  # noqa: B023
                np.add.at(totals, at, n[some])  # noqa: B023

        for row, text in enumerate(batch.column(1)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
            for h in text_hashes(data):
                hashes.append(h)
                counts.append(len(h))
                owners.append(row)
                held += len(h)
                if held >= BLOCK_HASHES:
                    flush()
                    hashes, counts, owners, held = [], [], [], 0
        if owners:
            flush()
        bits = 2 * sums > totals[:, None]
        prints = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(rows, fingerprint_rows, "doc_id long, fp long")


# --- the code ---


class Golay:
    """Syndrome tables, built from the generator polynomial."""

    def __init__(self) -> None:
        remainder = np.zeros(1 << LENGTH - CHECK_BITS, dtype=np.int64)
        for high in range(len(remainder)):
            left = high << CHECK_BITS
            for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
                if left >> bit & 1:
                    left ^= GOLAY << bit - CHECK_BITS
            remainder[high] = left
        self.remainder = remainder
        # Error patterns by syndrome: the leader, then those of weight four.
        found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
        for weight in range(5):
            for bits in combinations(range(LENGTH), weight):
                pattern = sum(1 << b for b in bits)
                at = found[int(self.syndromes(np.array([pattern]))[0])]
                if weight < 4 or len(at) and at[0].bit_count() == 3:
                    at.append(pattern)
        self.patterns = np.full((len(found), 6), -1, dtype=np.int64)
        for s, own in enumerate(found):
            self.patterns[s, : len(own)] = own

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        return (words & (1 << CHECK_BITS) - 1) ^ self.remainder[words >> CHECK_BITS]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index of the codeword at distance three or less."""
        return (words ^ self.patterns[self.syndromes(words), 0]) >> CHECK_BITS

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``words`` and indices of all codewords at distance four
        or less."""
        patterns = self.patterns[self.syndromes(words)]
        at, which = np.nonzero(patterns >= 0)
        return at, (words[at] ^ patterns[at, which]) >> CHECK_BITS


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``k, fp``: twice the key, plus one on the side with several indices."""
    code = Golay()
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for start in range(0, len(whole), 20_000):
            fp = whole[start : start + 20_000]
            bits = fp.view(np.uint64)
            segments = [((bits >> np.uint64(SEGMENT_BITS * s)) & np.uint64(0xFFFF)).astype(np.int64) for s in range(SEGMENTS)]
            single = [code.nearest(s) for s in segments]
            several = [code.near(s) for s in segments]
            keys, prints = [], []
            for i in range(SEGMENTS):
                for step in (1, 2):
                    j = (i + step) % SEGMENTS
                    kind = (2 * i + step - 1) << 28
                    keys.append((kind | segments[i] << 12 | single[j]) << 1)
                    prints.append(fp)
                    at, index = several[j]
                    keys.append((kind | segments[i][at] << 12 | index) << 1 | 1)
                    prints.append(fp[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(prints))], names=["k", "fp"]
            )


def first_open(keys: np.ndarray) -> np.ndarray:
    """Bits that fingerprints of a first key need not share."""
    segment = (keys >> 29).astype(np.uint64)
    return ~(np.uint64(0xFFFF) << segment * np.uint64(SEGMENT_BITS))


def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot keys with further keys: a quarter of the open bits each."""
    for batch in batches:
        k, fp, open_bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for mask in np.unique(open_bits).tolist():
            own = open_bits == mask
            bits = [b for b in range(64) if mask >> b & 1]
            for quarter in range(SEGMENTS):
                part = 0
                for b in bits[quarter::SEGMENTS]:
                    part |= 1 << b
                if not part:
                    continue
                mixed = np.array(
                    [xxhash.xxh64_intdigest(b"%d %d %d" % (key >> 1, quarter, f & part)) for key, f in zip(k[own].tolist(), fp[own].tolist(), strict=True)],
                    dtype=np.uint64,
                )
                keys = ((mixed >> np.uint64(2)) << np.uint64(1)).astype(np.int64) | k[own] & 1
                left = np.array([mask & ~part & (1 << 64) - 1], dtype=np.uint64).view(np.int64)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(fp[own]), pa.array(np.full(own.sum(), left))], names=["k", "fp", "open"]
                )


# --- join and verify ---


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links as connect what all of them connect."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    keep = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(n)
    return a[keep], b[keep]


def compare_runs(k: np.ndarray, fp: np.ndarray, hot_limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among rows sorted by ``k``, and which rows belong to hot keys."""
    key, many = k >> 1, (k & 1).astype(bool)
    new = np.ones(len(k), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    ones = np.add.reduceat((~many).astype(np.int64), starts)
    work = ones * (np.diff(np.append(starts, len(k))) - ones)
    hot = (work > hot_limit)[run]
    asks = np.flatnonzero(many & ~hot & (ones[run] > 0))
    found_a, found_b = [], []
    ends = np.cumsum(ones[run[asks]])
    done = 0
    while done < len(asks):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + COMPARISONS, "right")))
        own = asks[done:upto]
        n = ones[run[own]]
        left = np.repeat(own, n)
        right = np.repeat(starts[run[own]], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        a, b = fp[left], fp[right]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_DISTANCE) & (a != b)
        a, b = a[near], b[near]
        found_a.append(np.minimum(a, b))
        found_b.append(np.maximum(a, b))
        done = upto
    empty = np.zeros(0, dtype=np.int64)
    a = np.concatenate(found_a) if found_a else empty
    b = np.concatenate(found_b) if found_b else empty
    return (*forest(a, b), hot)


def scan_rows(hot_limit: int):
    """Over rows sorted by ``k``: verified links (``a, b``) and rows of hot
    keys (``k, fp, open``)."""

    def out(k, fp, open_bits) -> Iterator[pa.RecordBatch]:
        a, b, hot = compare_runs(k, fp, hot_limit)
        if hot.any():
            left = first_open(k >> 1).view(np.int64) if open_bits is None else open_bits
        n, m = len(a), int(hot.sum())
        if n + m == 0:
            return
        none = lambda size: pa.nulls(size, pa.int64())
        join = lambda x, y: pa.concat_arrays([x, y])
        held = [pa.array(c[hot]) for c in ((k, fp, left) if m else (k, k, k))]
        yield pa.RecordBatch.from_arrays(
            [join(pa.array(a), none(m)), join(pa.array(b), none(m)), *[join(none(n), c) for c in held]],
            names=["a", "b", "k", "fp", "open"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            parts.append(new)
            # Runs before the last one are complete.
            if parts[0][0][0] >> 1 == new[0][-1] >> 1:
                continue
            rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1] >> 1 << 1))
            yield from out(*[c[:cut] for c in rows[:2]], rows[2][:cut] if len(rows) > 2 else None)
            parts = [[c[cut:] for c in rows]]
        if parts:
            rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield from out(*rows[:2], rows[2] if len(rows) > 2 else None)

    return scan


def fingerprint_links(prints: DataFrame, hot_limit: int = HOT_COMPARISONS) -> DataFrame:
    """``a, b``: links that connect all distinct ``fp`` of ``prints`` that
    differ in at most three bits."""
    rows = map_rows(prints.select("fp"), key_rows, "k long, fp long")
    links = None
    while True:
        dealt = rows.withColumn("deal", F.shiftright("k", 1)).repartition("deal").sortWithinPartitions("k").drop("deal")
        found = stored(
            map_rows(dealt, scan_rows(hot_limit), "a long, b long, k long, fp long, open long"), "simhash-links"
        )
        own = found.where("a IS NOT NULL").select("a", "b")
        links = own if links is None else links.unionByName(own)
        hot = found.where("k IS NOT NULL").select("k", "fp", "open")
        if hot.isEmpty():
            return links
        rows = map_rows(hot, split_rows, "k long, fp long, open long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_limit: int = HOT_COMPARISONS
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    * null text, no word: fingerprint zero, linked like any other
    * fewer than three words: the whole sequence is one shingle
    * very long text: hashed in pieces, in bounded memory
    * null id: takes part in links but never names a group; a group without
      any id has a null ``component_id``
    * repeated rows: each keeps its own row, all have one fingerprint
    * a tie (a bit set in exactly half the hashes) gives 0
    * empty table: empty result; other columns of ``docs`` are not read
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("lo")), "distinct")
    links = stored(fingerprint_links(distinct, hot_limit).distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    classes = connected_components(nodes, links)
    linked = classes.join(distinct, F.col("node") == F.col("fp"))
    lowest = linked.groupBy("component").agg(F.min("lo").alias("root"))
    named = linked.join(lowest, "component").select(F.col("node").alias("n"), "root")
    # A stored table by distinct fingerprint: the join below deals both sides
    # anew, so that the adaptive skew join can split a hot fingerprint.
    labels = stored(
        distinct.join(named, F.col("fp") == F.col("n"), "left").select(
            F.col("fp").alias("f"), F.coalesce("root", "lo").alias("component_id")
        ),
        "labels",
    )
    return rows.join(labels, F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
