"""Exact Jaccard join on word shingles with a token-group matrix.

Sets are hashed shingles, ordered by one global order: tokens known to be
frequent last, the rarer ones of them first, all others by hash. Two sets that link share a token among the first
``n - ceil(t n) + 1`` of both (the prefix), so only prefixes are compared.

1. Sets are partitioned into groups of similar ones: those with the same
   smallest hash (a min-hash), a large group in bounded parts. Groups with
   several members are opened: what links inside becomes one unit.
2. The matrix holds each unit's union of prefix tokens. The overlap of two
   units' unions bounds the overlap of any two of their members; pairs of units
   below what their sizes demand are never opened.
3. Qualifying units are opened: the sets of the smaller one are held against
   the union and then the members of the larger one.
4. Components of the links give the classes. Tokens of very many units only
   link each unit with one hub at first. What is still apart afterwards meets
   where two sets agree in a part of all tokens: sets that link differ in so
   few tokens that one of the parts has none of them, so no link is lost.

Shingles, and sets by their members, are named by 64-bit hashes (equal names
of different ones: about 1 in 10^19 per pair). Copies of a set are one set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, most_frequent, row_hash, stored
from driftline.operators.groups import connected_components

# A bit table for tokens has so many bits (8 MB), whatever the input's size.
TABLE_BITS = 26
# At most so many frequent tokens are known to the tasks (1.6 MB).
FREQUENT_TOKENS, FREQUENT_FROM = 200_000, 32
# Members of a group that are opened together; units of a token that are paired.
GROUP_MEMBERS, TOKEN_UNITS = 256, 64
# Units that agree in a part are paired up to this many, more are parted again.
PART_UNITS = 16
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64,
)


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes (64 bits)."""

    def __init__(self, n: int):
        if not 1 <= n <= len(MULTIPLIERS):
            raise ValueError(f"1 to {len(MULTIPLIERS)} words a shingle")
        self.n = n

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        n = self.n
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], dtype=np.uint64)
        h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
        m = len(h) - n + 1
        s = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            s += h[j : j + m] * MULTIPLIERS[j]
        s ^= s >> np.uint64(32)
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(29)
        s.sort()
        fresh = np.ones(m, dtype=bool)
        np.not_equal(s[1:], s[:-1], out=fresh[1:])
        return s[fresh]


def set_name(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def counted_length(n: int, percent: int) -> int:
    """So many of the lowest hashes of a set are counted: 9/4 of the prefix."""
    return min(n, (9 * prefix_length(n, percent) + 3) // 4)


def unshared_length(n: int, percent: int) -> int:
    """Ranks below which a token that was counted once is shared with no set
    that links. A token of rank r here has a rank of at most r + p - 1 in a
    linked set of prefix length p, which counts it if that is below its
    counted length; the smallest possible partner decides."""
    least = (percent * n + 99) // 100
    return (9 * prefix_length(least, percent) + 3) // 4 - prefix_length(least, percent) + 1


def bit_table(values: DataFrame, column: str) -> np.ndarray:
    """Which low bits occur among ``column``: a table of fixed size, filled by
    a grouped OR."""
    low = F.col(column).bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    words = values.select(
        F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))").alias("m")
    ).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy().astype(np.int64).view(np.uint64)
    return table


def in_table(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    low = tokens & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


# --- passes over the texts ---


def profiles(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """``doc_id, h, sid, n_shingles``; an empty set has no ``sid``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([set_name(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64())],
                ["doc_id", "h", "sid", "n_shingles"],
            )

    return map_rows(rows, run, f"doc_id {kind}, h bigint, sid bigint, n_shingles bigint")


def _new_sets(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Names and tokens of the sets of a task; copies mostly once."""
    shingle, seen = Shingler(n), set()
    for batch in batches:
        for text in batch.column(0):
            tokens = shingle(text.as_py())
            if len(tokens):
                sid = set_name(tokens)
                if sid not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sid)
                    yield sid, tokens


def token_counts(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``token, c``: in how many sets a token stands among the lowest hashes
    (``counted_length``), counted over all sets; tokens of one set are left out.

    Higher hashes come late in the order anyway; the counts decide the order
    and what need not be compared, never what links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(tokens), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[at : at + 200_000].view(np.int64)), pa.array(times[at : at + 200_000].astype(np.int64))],
                    ["token", "n"],
                )

        for _, tokens in _new_sets(batches, n):
            held.append(tokens[: counted_length(len(tokens), percent)])
            size += len(held[-1])
            if size > 2_000_000:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return map_rows(texts, run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("c")).where("c > 1")


def prefixes(
    texts: DataFrame, n: int, percent: int, frequent: np.ndarray, rank: np.ndarray, shared: np.ndarray
) -> DataFrame:
    """``sid, n, gid, prefix``: sets that share a prefix token with another.

    ``frequent``: the known frequent tokens, sorted; ``rank``: their order.

    ``gid``: the smallest hash, which names the group. A token that was counted
    in one set alone is left out of the prefix, where no partner can have it
    without counting it (``unshared_length``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], []]

        def out():
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sid", "n", "gid", "prefix"]
            )

        for sid, tokens in _new_sets(batches, n):
            size = prefix_length(len(tokens), percent)
            place = np.searchsorted(frequent, tokens)
            late = place < len(frequent)
            late[late] = frequent[place[late]] == tokens[late]
            last = np.flatnonzero(late)
            last = last[np.argsort(rank[place[last]])]
            order = np.concatenate([np.flatnonzero(~late), last])[:size]
            first = tokens[order]
            first = first[in_table(shared, first) | (order >= unshared_length(len(tokens), percent))]
            if len(first):
                for c, v in zip(columns, (sid, len(tokens), int(tokens[0].astype(np.int64)), first.view(np.int64)), strict=True):
                    c.append(v)
                if len(columns[0]) >= 2000:
                    yield out()
                    columns = [[], [], [], []]
        yield out()

    found = map_rows(texts, run, "sid bigint, n bigint, gid bigint, prefix array<bigint>")
    return found.groupBy("sid").agg(F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("prefix").alias("prefix"))


def bodies(texts: DataFrame, n: int, wanted: np.ndarray, by_group: bool) -> DataFrame:
    """``sid, gid, tokens`` (packed) of the sets whose name (or group) is in a
    bit table; a few others pass as well."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary())], ["sid", "gid", "tokens"],
            )

        for sid, tokens in _new_sets(batches, n):
            key = tokens[:1] if by_group else np.array([sid], dtype=np.int64).view(np.uint64)
            if in_table(wanted, key)[0]:
                rows.append((sid, int(tokens[0].astype(np.int64)), tokens.tobytes()))
                size += 8 * len(tokens)
                if size > 4_000_000:
                    yield out()
                    rows, size = [], 0
        yield out()

    return map_rows(texts, run, "sid bigint, gid bigint, tokens binary")


# --- opening groups ---


class Roots:
    """Union-find over a few members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def union_matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The union of tokens, and each set's places in it."""
    union, place = np.unique(np.concatenate(sets), return_inverse=True)
    return union, np.split(place, np.cumsum([len(s) for s in sets])[:-1])


def overlaps_with(places: list[np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """Tokens that a set (places ``at`` of the union) shares with each member."""
    mark = np.zeros(size, dtype=bool)
    mark[at] = True
    return np.array([np.count_nonzero(mark[p]) for p in places])


def open_group(percent: int):
    """For ``applyInArrow``: units inside one group, as ``sid, unit``."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for sid, tokens in zip(batch.column("sid").to_pylist(), batch.column("tokens"), strict=True):
                if sid not in found:
                    found[sid] = np.frombuffer(tokens.as_py(), dtype=np.uint64)
        names = sorted(found)
        sets = [found[s] for s in names]
        roots = Roots(len(names))
        if len(names) > 1:
            union, places = union_matrix(sets)
            sizes = np.array([len(s) for s in sets])
            for i in range(1, len(names)):
                apart = [j for j in range(i) if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])]
                if apart:
                    both = overlaps_with([places[j] for j in apart], places[i], len(union))
                    for j, o in zip(apart, both, strict=True):
                        if 100 * o >= percent * (sizes[i] + sizes[j] - o):
                            roots.join(i, j)
        moved = [(names[i], names[roots.find(i)]) for i in range(len(names)) if roots.find(i) != i]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in moved], pa.int64()), pa.array([m[1] for m in moved], pa.int64())], ["sid", "unit"]
        )

    return run


def open_pairs(percent: int):
    """For ``applyInArrow``: which smaller units link with the larger one."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large: dict[int, np.ndarray] = {}
        small: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("unit", "sid", "is_large")]
            for unit, sid, is_large, tokens in zip(*columns, batch.column("tokens"), strict=True):
                into = large if is_large else small.setdefault(unit, {})
                if sid not in into:
                    into[sid] = np.frombuffer(tokens.as_py(), dtype=np.uint64)
        done = []
        if large and small:
            union, places = union_matrix(list(large.values()))
            sizes = np.array([len(p) for p in places])
            for unit, members in small.items():
                for tokens in members.values():
                    n = len(tokens)
                    at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                    at = at[union[at] == tokens]
                    # What the query shares with the union bounds every member.
                    if 100 * len(at) < percent * n:
                        continue
                    both = overlaps_with(places, at, len(union))
                    if (100 * both >= percent * (n + sizes - both)).any():
                        done.append(unit)
                        break
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()] * len(done), pa.int64()), pa.array(done, pa.int64())], ["a", "b"]
        )

    return run


def least_overlap(percent: int, lo: str = "lo", hi: str = "hi") -> str:
    """SQL: prefix tokens that two linked sets share at least, if both have
    ``lo`` to ``hi`` tokens.

    Sets of a and b >= a tokens share CEIL(t' (a + b)) - CEIL(t b) + 1 prefix
    tokens at least, t' = t / (1 + t), which goes up and down with b. It is more
    than t' (a + b) - t b, which grows with a and falls with b, so its value at
    the extremes holds for every pair between them; in whole numbers it is
    percent (100 a - percent b) / (100 (100 + percent))."""
    return f"GREATEST(1, {percent} * (100 * {lo} - {percent} * {hi}) DIV {100 * (100 + percent)} + 1)"


def compare_units(pool: DataFrame, percent: int, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links ``a, b`` among candidate ``pairs`` (``u, v``) of units; ``pool``
    has ``sid, tokens`` of their sets.

    The sets of the unit with fewer members travel to the other one, whose
    partners are dealt into chunks of bounded size."""
    sizes = members.groupBy("unit").agg(F.count("*").alias("m"))
    sized = pairs.join(sizes.withColumnsRenamed({"unit": "u", "m": "mu"}), "u").join(
        sizes.withColumnsRenamed({"unit": "v", "m": "mv"}), "v"
    )
    first = (F.col("mu") > F.col("mv")) | ((F.col("mu") == F.col("mv")) & (F.col("u") < F.col("v")))
    turned = stored(
        sized.select(
            F.when(first, F.col("u")).otherwise(F.col("v")).alias("large"),
            F.when(first, F.col("v")).otherwise(F.col("u")).alias("small"), F.least("mu", "mv").alias("m"),
        ), "candidates",
    )
    chunks = turned.groupBy("large").agg(F.ceil(F.sum("m") / (2 * GROUP_MEMBERS)).alias("chunks"))
    dealt = turned.join(chunks, "large").select(
        "large", "small", F.pmod(F.xxhash64("small"), F.col("chunks")).alias("chunk")
    )
    wanted = dealt.select("large", "chunk", F.col("small").alias("unit"), F.lit(False).alias("is_large")).unionByName(
        dealt.select("large", "chunk").distinct().select("*", F.col("large").alias("unit"), F.lit(True).alias("is_large"))
    )
    rows = stored(wanted.join(members, "unit"), "openings")
    loaded = rows.join(pool, "sid")
    return loaded.groupBy("large", "chunk").applyInArrow(open_pairs(percent), "a bigint, b bigint")


# --- what common tokens hold apart ---


def size_classes(percent: int, largest: int) -> list[int]:
    """Smallest sizes of the classes up to ``largest`` and two further ones:
    sets that link are of one class or of two neighbours."""
    borders = [1, 2]
    while borders[-3 if len(borders) > 2 else 0] <= largest:
        borders.append(max(borders[-1] + 1, 100 * (borders[-1] - 1) // percent + 1))
    return borders


def part_count(percent: int, borders: list[int], size_class: int) -> int:
    """One more than the tokens in which two linked sets of this class or the
    one below may differ: one part at least has none of them."""
    return 2 * (borders[size_class + 1] - 1) * (100 - percent) // (100 + percent) + 1


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    x = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_parts(tokens: np.ndarray, m: int, seed: int) -> np.ndarray:
    """A name for what a set holds of each of ``m`` parts of all tokens."""
    h = _mixed(tokens, 2 * seed)
    content = np.zeros(m, dtype=np.uint64)
    np.add.at(content, (h % np.uint64(m)).astype(np.int64), _mixed(h, 2 * seed + 1))
    return _mixed(content + np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), m)


PART_SCHEMA = "key bigint, size_class int, up boolean, n bigint, sid bigint, unit bigint, component bigint"


def part_keys(rows: DataFrame, percent: int, seed: int) -> DataFrame:
    """A row for each part of a set (``tokens, sid, unit, component``): in its
    own size class, and (``up``) in the next one, to meet larger sets.

    With ``key`` and ``size_class`` in ``rows``: its parts within that key."""
    again = "key" in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = size_classes(percent, 1)
        names, keys, size = [], [], 0

        def out():
            times = [len(k) for k in keys]
            columns = [
                pa.array(np.repeat(np.array([r[c] for r in names], dtype=t), times))
                for c, t in enumerate((np.int32, bool, np.int64, np.int64, np.int64, np.int64))
            ]
            key = pa.array(np.concatenate(keys).view(np.int64))
            return pa.RecordBatch.from_arrays([key, *columns], ["key", "size_class", "up", "n", "sid", "unit", "component"])

        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "tokens"}
            for i, packed in enumerate(batch.column("tokens")):
                tokens = np.frombuffer(packed.as_py(), dtype=np.uint64)
                n = len(tokens)
                if borders[-3] <= n:
                    borders = size_classes(percent, n)
                own = int(np.searchsorted(borders, n, side="right")) - 1
                for c in [of["size_class"][i]] if again else [own, own + 1]:
                    parts = set_parts(tokens, part_count(percent, borders, c), seed)
                    parent = np.uint64(of["key"][i] % 2**64 if again else c)
                    keys.append(_mixed(parts ^ _mixed(np.array([parent], dtype=np.uint64), seed), seed))
                    names.append((c, c > own, n, of["sid"][i], of["unit"][i], of["component"][i]))
                    size += len(parts)
                    if size > 100_000:
                        yield out()
                        names, keys, size = [], [], 0
        if names:
            yield out()

    return map_rows(rows, run, PART_SCHEMA)


def agreeing_pairs(pool: DataFrame, percent: int, apart: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of units (``apart``: ``unit, component``) of different
    components that agree in a part; all that link are among them.

    Units of a part with many of them must agree in a part of a second
    division of the tokens as well, and so on: sets that differ in more than
    linked ones may hardly ever do. Only if a division no longer halves those
    rows, which takes many pairs just beyond the threshold, they are paired."""
    rows = apart.join(members, "unit").join(pool, "sid").select("sid", "unit", "component", "tokens")
    pairs, before, seed = [], None, 0
    while True:
        keyed = stored(part_keys(rows, percent, seed), "parts")
        held = keyed.groupBy("key", "unit").agg(
            F.first("component").alias("component"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.bool_and("up").alias("up")
        )
        per_key = held.groupBy("key").agg(
            F.count("*").alias("units"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.bool_and("up").alias("idle")
        ).where("c0 <> c1 AND NOT idle").select("key", "units")
        per_key = stored(per_key, "part_units")
        crowded = per_key.where(F.col("units") > PART_UNITS).agg(F.sum("units")).first()[0] or 0
        last = before is not None and 2 * crowded > before
        near = stored(held.join(per_key if last else per_key.where(F.col("units") <= PART_UNITS), "key"), "agreeing")
        pairs.append(
            near.alias("x").join(near.alias("y"), F.expr(
                "x.key = y.key AND x.unit < y.unit AND x.component <> y.component AND NOT (x.up AND y.up) "
                f"AND {percent} * y.lo <= 100 * x.hi AND {percent} * x.lo <= 100 * y.hi"
            )).select(F.expr("x.unit AS u"), F.expr("y.unit AS v"))
        )
        if last or not crowded:
            break
        before, seed = crowded, seed + 1
        rows = keyed.join(per_key.where(F.col("units") > PART_UNITS).select("key"), "key").join(pool, "sid")
    found = pairs[0]
    for p in pairs[1:]:
        found = found.unionByName(p)
    return found.distinct()


# --- the join ---


def set_links(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges ``a, b`` between set names whose components are those of all
    links."""
    counted = stored(token_counts(texts, n, percent), "tokens")
    top = most_frequent(counted.where(F.col("c") >= FREQUENT_FROM), "c", FREQUENT_TOKENS).toArrow()
    frequent = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    by_token = np.argsort(frequent)
    # The rank of a frequent token: by its count, then by its hash.
    rank = np.argsort(np.lexsort((frequent, top.column("c").to_numpy())))[by_token]
    sets = stored(prefixes(texts, n, percent, frequent[by_token], rank, bit_table(counted, "token")), "sets")

    # 1. groups
    groups = sets.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1")
    groups = stored(groups.select("gid", F.ceil(F.col("m") / GROUP_MEMBERS).cast("long").alias("parts")), "groups")
    inside = bodies(texts, n, bit_table(groups, "gid"), by_group=True).join(groups, "gid").select(
        "gid", F.pmod(F.xxhash64("sid"), F.col("parts")).alias("part"), "sid", "tokens"
    )
    moved = stored(inside.groupBy("gid", "part").applyInArrow(open_group(percent), "sid bigint, unit bigint"), "units")

    # 2. matrix and bounds
    placed = stored(
        sets.select("sid", "n", "prefix").join(moved.withColumnRenamed("sid", "s"), F.col("sid") == F.col("s"), "left")
        .select("sid", "n", "prefix", F.coalesce("unit", "sid").alias("unit")), "placed",
    )
    members = placed.select("unit", "sid")
    matrix = placed.select("unit", "n", F.explode("prefix").alias("token")).groupBy("token", "unit").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi")
    )
    matrix = stored(matrix, "matrix")
    per_token = stored(
        matrix.groupBy("token").agg(F.count("*").alias("units"), F.min("unit").alias("hub")).where("units > 1"), "columns"
    )
    few = matrix.join(per_token.where(F.col("units") <= TOKEN_UNITS).select("token"), "token")
    many = matrix.join(per_token.where(F.col("units") > TOKEN_UNITS).select("token", "hub"), "token")
    common = stored(many.groupBy("unit").agg(F.count("*").alias("k")), "common_counts")
    many = stored(many.join(common, "unit"), "common")
    fits = f"{percent} * y.lo <= 100 * x.hi AND {percent} * x.lo <= 100 * y.hi"
    counts = few.alias("x").join(few.alias("y"), F.expr(f"x.token = y.token AND x.unit < y.unit AND {fits}")).groupBy(
        F.expr("x.unit").alias("u"), F.expr("y.unit").alias("v")
    ).agg(
        F.count("*").alias("o"), F.min(F.expr("least(x.lo, y.lo)")).alias("lo"), F.max(F.expr("greatest(x.hi, y.hi)")).alias("hi")
    )
    bounded = (
        counts.join(common.withColumnsRenamed({"unit": "u", "k": "ku"}), "u", "left")
        .join(common.withColumnsRenamed({"unit": "v", "k": "kv"}), "v", "left")
        # Tokens of many units weren't counted: they may all be shared.
        .where(f"o + least(coalesce(ku, 0), coalesce(kv, 0)) >= {least_overlap(percent)}")
        .select("u", "v")
    )
    # Pairs that share no other token must share enough common ones: no more
    # than either of them has.
    enough = f"least(k, k2) >= {least_overlap(percent, 'least(lo, lo2)', 'greatest(hi, hi2)')}"
    other = many.select(*[F.col(c).alias(f"{c}2") for c in ("token", "unit", "lo", "hi", "k")])
    star = many.join(other, (F.col("token") == F.col("token2")) & (F.col("hub") == F.col("unit2"))).where(
        f"unit <> hub AND {enough}"
    ).select(F.least("unit", "hub").alias("u"), F.greatest("unit", "hub").alias("v"))
    tried = stored(bounded.unionByName(star).distinct(), "pairs")

    # 3. open, 4. what common tokens still hold apart
    edges = moved.select(F.col("sid").alias("a"), F.col("unit").alias("b"))

    # The sets of this and of all further rounds are read from the texts once.
    open_units = tried.select(F.col("u").alias("unit")).unionByName(tried.select(F.col("v").alias("unit"))).unionByName(
        many.select("unit")
    ).distinct()
    wanted = bit_table(members.join(open_units, "unit").select("sid"), "sid")
    pool = bodies(texts, n, wanted, by_group=False).groupBy("sid").agg(F.first("tokens").alias("tokens"))
    pool = stored(pool, "pool")
    found = stored(compare_units(pool, percent, members, tried), "links")
    edges = edges.unionByName(found)
    if many.isEmpty():
        return edges
    through_hubs = True
    while True:
        nodes = many.select(F.col("unit").alias("node")).distinct()
        ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node")))
        labels = stored(connected_components(nodes.unionByName(ends).distinct(), edges_between_units(edges, moved)), "labels")
        held = stored(many.join(labels, F.col("unit") == F.col("node")).select("token", "unit", "lo", "hi", "k", "component"), "apart")
        open_tokens = held.groupBy("token").agg(
            F.min("component").alias("c0"), F.max("component").alias("c1"),
            F.min_by(F.struct(F.col("unit").alias("unit2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("k").alias("k2")), "component").alias("hub"),
        ).where("c0 <> c1")
        x = stored(held.join(open_tokens.select("token", "hub", "c0"), "token"), "open")
        sizes_fit = f"{percent} * lo2 <= 100 * hi AND {percent} * lo <= 100 * hi2"
        if through_hubs:
            next_pairs = x.select("*", "hub.*").where(f"component <> c0 AND {sizes_fit} AND {enough}").select(
                F.least("unit", "unit2").alias("u"), F.greatest("unit", "unit2").alias("v")
            )
        else:
            next_pairs = agreeing_pairs(pool, percent, x.select("unit", "component").distinct(), members)
        next_pairs = stored(next_pairs.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        if not next_pairs.isEmpty():
            tried = tried.unionByName(next_pairs)
            found = stored(compare_units(pool, percent, members, next_pairs), "links")
            edges = edges.unionByName(found)
        elif through_hubs:
            found = found.limit(0)
        # Hubs as long as they join something, then all that agree in a part.
        if not through_hubs:
            return edges
        through_hubs = not found.isEmpty()


def edges_between_units(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges of the graph of units: those found between units."""
    return edges.join(moved.select(F.col("sid").alias("a"), F.col("unit").alias("b")), ["a", "b"], "left_anti")


def classified(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Per row: ``doc_id, h, n_shingles, label, component_id``; ``h`` is a hash
    of the whole row, ``label`` names the component (null: an empty set)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), row_hash(docs).alias("h")
    )
    profile = stored(profiles(rows, n, kind), "profiles")
    sets = profile.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    edges = set_links(rows.select("text"), n, percent)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = connected_components(nodes, edges).withColumnRenamed("node", "s")
    named = stored(
        sets.join(labels, F.col("sid") == F.col("s"), "left").select("sid", "rep", F.coalesce("component", "sid").alias("label")),
        "named",
    )
    least = named.groupBy(F.col("label").alias("c")).agg(F.min("rep").alias("component_id"))
    # Stored, so that the last join deals both sides out and can split a hot set.
    classes = stored(
        named.join(least, F.col("label") == F.col("c")).select(F.col("sid").alias("s"), "label", "component_id"), "classes"
    )
    return profile.join(classes, F.col("sid") == F.col("s"), "left").select(
        "doc_id", "h", "n_shingles", "label",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    A set is the distinct ``n``-word shingles of the text in lower case (A-Z);
    with fewer words the whole sequence is the one shingle. Two sets link when
    ``100 * intersection >= percent * union``. ``component_id``: the smallest
    id reachable by links.

    * null, empty or blank text: an empty set, linked with nothing, a
      component of its own
    * copies and repeated rows: equal sets are linked (their Jaccard is 1)
    * null id: never the smallest; ``component_id`` is null only if no row
      of the component has an id
    * empty table: empty result; other columns are not read
    """
    return classified(docs, id_col, text_col, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each
    component the row with the smallest id (a null id only if there is no
    other; of several rows with that id the one with the smallest row hash).
    Empty sets form no component and all stay."""
    found = stored(classified(docs, id_col, text_col, n, percent), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("h").alias("k"))
    best = found.where("label IS NOT NULL").groupBy("label").agg(F.min(rank).alias("b")).select("b.i", "b.k")
    stay = best.withColumn("one", F.lit(True)).unionByName(
        found.where("label IS NULL").select(F.col("doc_id").alias("i"), F.col("h").alias("k"), F.lit(False).alias("one")).distinct()
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), row_hash(docs).alias("h")
    )
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")))
    same = Window.partitionBy("h", "id").orderBy(F.lit(1))
    return kept.withColumn("n", F.row_number().over(same)).where("n = 1 OR NOT one").select("row.*")
