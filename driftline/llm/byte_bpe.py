"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

A tokenisation is the BPE result exactly if every token encodes to itself and
every neighbouring pair of tokens encodes to that pair. So the merges compile
to a nondeterministic transducer whose states are (last token, bytes of an
unfinished token). Its subsets are determinised on demand: a state of the
deterministic machine is the set of live hypotheses, each with the tokens it
still holds back; tokens that all hypotheses agree on are emitted at once, so
the lookahead is bounded by the longest token. States and transitions are
built when first met and forgotten together when there are too many.
"""

from __future__ import annotations

import array
import base64
import ctypes
import functools
import gc
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import map_rows


def load_ranks(path: str) -> dict[bytes, int]:
    """``token bytes -> rank`` of a rank file (one base64 token and rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}

NEVER = 1 << 62
# Entries of each cache: about 350 MB a worker at most, and in proportion.
CACHE = 400_000


class State:
    """A set of live hypotheses: (last token, tokens held back, unfinished
    bytes); ``moves``: byte -> (next state, emitted tokens)."""

    __slots__ = ("hypotheses", "moves", "rest")

    def __init__(self, hypotheses: tuple):
        self.hypotheses, self.moves, self.rest = hypotheses, {}, None


class MergeTransducer:
    """Bytes in, token ids out, for one vocabulary of ranks.

    Every single byte must be a token (true for byte-level vocabularies).
    """

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = 400_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing[:5]}")
        self.ranks = ranks
        self.words = {r: t for t, r in ranks.items()}
        # Prefixes of tokens, numbered so that those which go on come first.
        inner = sorted({t[:i] for t in ranks for i in range(len(t))}, key=lambda p: (len(p), p))
        seen = set(inner)
        nodes = {p: i for i, p in enumerate(inner + [t for t in ranks if t not in seen])}
        self._inner = len(inner)
        self._child = {nodes[p[:-1]] << 8 | p[-1]: i for p, i in nodes.items() if p}
        self._histories: dict[int, tuple[bool, list, list]] = {}
        self._pair: dict[int, bool] = {}
        # Tokens that never arise from their own bytes can't occur at all.
        self._token_at = [ranks[p] if p in ranks and self._valid(ranks[p]) else -1 for p in nodes]
        self.max_transitions = max_transitions
        self._states: dict[tuple, State] = {}
        self._reset()

    # --- what the merges allow ---

    def _history(self, token: int) -> tuple[bool, list, list]:
        """How the bytes of a token merge on their own, lowest rank first and
        leftmost among equals: whether they become that token, and before each
        merge its rank with the rightmost (leftmost) part."""
        known = self._histories.get(token)
        if known is None:
            data = self.words[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            right, left = [], []
            while len(parts) > 1:
                pairs = [self.ranks.get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
                best = min(pairs)
                if best == NEVER:
                    break
                right.append((best, parts[-1]))
                left.append((best, parts[0]))
                at = pairs.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            right.append((NEVER, parts[-1]))
            left.append((NEVER, parts[0]))
            known = self._histories[token] = (len(parts) == 1, right, left)
        return known

    def _valid(self, token: int) -> bool:
        return self._history(token)[0]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two stay apart when merged together: at no moment may
        the parts on both sides of the border be the next pair to merge."""
        if len(self._pair) > 4 * self.max_transitions:
            self._pair.clear()
        a, b = self._history(left)[1], self._history(right)[2]
        ranks, i, j, fits = self.ranks, 0, 0, True
        (next_a, part_a), (next_b, part_b) = a[0], b[0]
        while True:
            across = ranks.get(part_a + part_b)
            if across is not None and across < next_a and across <= next_b:
                fits = False
                break
            if next_a <= next_b:
                if next_a == NEVER:
                    break
                i += 1
                next_a, part_a = a[i]
            else:
                j += 1
                next_b, part_b = b[j]
        self._pair[left << 20 | right] = fits
        return fits

    # --- the lazily determinised machine ---

    def _state(self, hypotheses: tuple) -> State:
        known = self._states.get(hypotheses)
        if known is None:
            known = self._states[hypotheses] = State(hypotheses)
        return known

    def _reset(self) -> None:
        for state in self._states.values():
            state.moves.clear()  # moves form cycles
        self._states.clear()
        # Nothing read: no last token, nothing held back, root of the prefixes.
        self._start, self._built = self._state(((-1, (), 0),)), 0

    def _advance(self, state: State, byte: int) -> tuple[State, tuple]:
        """Build the move on ``byte``: the next subset of hypotheses and the
        tokens that all of them agree on."""
        after, child, token_at, pair = [], self._child, self._token_at, self._pair
        inner, held_back = self._inner, []
        for last, held, node in state.hypotheses:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if token >= 0:
                fits = pair.get(last << 20 | token) if last >= 0 else True
                if fits is None:
                    fits = self._fits(last, token)
                if fits:
                    after.append((token, (*held, token), 0))
                    held_back.append(after[-1][1])
            if node < inner:
                after.append((last, held, node))
                held_back.append(held)
        same, n = 0, len(after)
        for column in zip(*held_back, strict=False):
            if column.count(column[0]) < n:
                break
            same += 1
        self._built += 1
        first = held_back[0][:same]
        if same:
            after = [(last, held[same:], node) for last, held, node in after]
        move = self._state(tuple(after)), first
        state.moves[byte] = move
        return move

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if self._built > self.max_transitions:
            self._reset()
        out: list[int] = []
        state = self._start
        for byte in data:
            move = state.moves.get(byte) or self._advance(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        # The end of the piece: the one hypothesis without unfinished bytes.
        if state.rest is None:
            state.rest = next(h for _, h, node in state.hypotheses if not node)
        return out + list(state.rest)


class PieceCache(dict):
    """Piece of text -> packed ids (little-endian, 32 bits each).

    Two generations of bounded size: when the young one is full it replaces
    the old one, so pieces in use stay and the rest is forgotten.
    """

    def __init__(self, machine: MergeTransducer, limit: int = 400_000):
        self.machine, self.limit, self.old = machine, limit, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.machine.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Utf8Stream:
    """Incremental UTF-8: feed bytes, get the text that is complete so far.

    State: the bytes of an unfinished character (at most three). Bytes that
    can't belong to a character become U+FFFD, as ``errors="replace"`` does.
    """

    def __init__(self):
        self.pending = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """How many bytes at the end may still become one character."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:  # a lead byte: does its character end later?
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need and _possible(data[-back:]) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        tail = self._open_tail(data)
        self.pending = data[len(data) - tail :]
        return data[: len(data) - tail].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def _possible(start: bytes) -> bool:
    """Whether these bytes can begin a character (ranges of the standard)."""
    lead = start[0]
    if not 0xC2 <= lead <= 0xF4:
        return False
    if len(start) > 1:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
        return low <= start[1] <= high
    return True


class UnitCache(dict):
    """Text between single spaces (its leading space included) -> packed ids."""

    def __init__(self, pieces: PieceCache, split, limit: int = 300_000):
        self.pieces, self.split, self.limit, self.old = pieces, split, limit, {}

    def __missing__(self, unit: str) -> bytes:
        packed = self.old.get(unit)
        if packed is None:
            packed = b"".join(map(self.pieces.__getitem__, self.split(" " + unit)))
        if len(unit) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[unit] = packed
        return packed


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        self.machine = MergeTransducer(load_ranks(path), cache)
        self.pieces = PieceCache(self.machine, cache)
        self.split = regex.compile(pattern).findall
        # In the published pattern a match never goes on past a space that
        # stands between two characters that aren't white space, and looks at
        # nothing before its start. There the text is cut without the pattern.
        self.at_spaces = pattern == public_tokenizers.PATTERN
        self.units = UnitCache(self.pieces, self.split, cache * 3 // 4)
        self.crowded = re.compile(r"\s |^ | \s| \Z").search
        words = self.machine.words
        self.bytes_of = [words.get(i, b"") for i in range(max(words) + 1)]

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; no special tokens."""
        if not self.at_spaces or self.crowded(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *units = text.split(" ")
        head = b"".join(map(self.pieces.__getitem__, self.split(first)))
        return head + b"".join(map(self.units.__getitem__, units))

    def rest(self) -> None:
        """Between tasks only what was used last is remembered, so that a worker
        that goes on to other work holds less."""
        self.machine._reset()
        self.pieces.old, self.units.old = {}, {}

    def decode(self, packed: bytes, block: int = 1 << 16) -> Iterator[str]:
        """Text in blocks of so many ids; a character never spans two."""
        stream, ids = Utf8Stream(), array.array("I", packed)
        for at in range(0, len(ids), block):
            yield stream.feed(b"".join(map(self.bytes_of.__getitem__, ids[at : at + block])))
        yield stream.close()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, cache: int = CACHE) -> ByteBpe:
    """One codec per worker process: tables and caches are built once."""
    bpe = ByteBpe(path, pattern, cache)
    gc.freeze()
    gc.set_threshold(1_000_000, 50, 50)  # the caches hold no garbage to look for
    return bpe


def release_codecs() -> None:
    """Give the memory of a worker's codecs back to the system."""
    codec.cache_clear()
    gc.unfreeze()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    cache: int = CACHE,
    keep: bool = True,
) -> DataFrame:
    """``doc_id, ids`` (packed 32-bit little-endian) of every whole text.
    ``cache``: entries of a worker's caches; fewer take less memory, more time.
    ``keep``: whether a worker process holds its tables for the next task;
    otherwise they are built anew and leave room for other stages.

    Null and empty texts have no ids; a null id is carried; repeated rows give
    repeated rows; other columns are not read. ``path``: the rank file, which
    must lie at the same place on every executor.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern, cache)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        bpe.rest()
        if not keep:
            del bpe
            release_codecs()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(rows, run, f"doc_id {kind}, ids binary")


def decode_documents(
    encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = ["".join(bpe.decode(p or b"")) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def round_trip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode
    the ids, in one pass so that the ids never leave the task.

    Cases are those of ``encode_documents``; the decoded text of a null is
    empty, so its digest is that of no bytes.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        bpe = codec(path, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1):
                packed = bpe.encode(text.as_py() or "")
                digest = hashlib.sha256()
                for part in bpe.decode(packed):
                    digest.update(part.encode())
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names,
            )
        bpe.rest()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(rows, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
