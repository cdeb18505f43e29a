"""Token counts of whole texts, equal to the tokenizer library's own.

Huge texts are encoded in overlapping chunks with offsets and spliced where
two encodings meet. A splice point is proven, not guessed: it is a position
where both chunks start a token, with ASCII white space just before it. The
library takes added tokens out of the raw text first (their strings hold no
white space), normalises characters without reaching across white space,
and merges inside pieces that hold none; so what stands before and after such a
position is encoded independently, and counts add up. Where an overlap
holds no such position it is widened, at last to the end of the text.

The same proof lets other texts be counted by their words: each word is
encoded by the library once per worker and remembered.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import map_rows

# The white space at which counts add up.
STABLE_SPACES = frozenset(" \t\n\x0b\x0c\r")
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256


class TokenCounter:
    """Counts tokens with a ``tokenizers`` file; no begin, end or added special
    tokens, no truncation or padding; special strings as the library does."""

    def __init__(self, path: str, memory: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory, self.young, self.old = memory, {}, {}

    # --- huge texts: chunks that overlap ---

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Offsets in the whole text at which the tokens of a chunk start."""
        encoded = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return [begin + o[0] for o in encoded.offsets]

    def count_overlapping(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        """Tokens of a text of any length; memory is that of one chunk, as long
        as overlaps hold a splice point."""
        total, begin, wide, settled = 0, 0, overlap, 0
        here = self.starts(text, 0, min(len(text), chunk + wide))
        while begin + chunk + wide < len(text):
            end = begin + chunk + wide
            follow = begin + chunk
            there = self.starts(text, follow, min(len(text), follow + chunk + overlap))
            border = self._splice(text, here, there, follow, end)
            if border is None:  # widen: encode this chunk again, further on
                wide *= 2
                again = self.starts(text, begin, min(len(text), begin + chunk + wide))
                here = [s for s in again if s >= settled]
                continue
            total += sum(1 for s in here if s < border)
            begin, wide, settled = follow, overlap, border
            here = [s for s in there if s >= border]
        return total + len(here)

    @staticmethod
    def _splice(text: str, here: list[int], there: list[int], low: int, high: int) -> int | None:
        """A start of tokens that both chunks see inside their overlap, right
        after white space; the latest, so that both have settled."""
        both = set(there)
        for at in reversed(here):
            if at <= low:
                return None
            if at < high and at in both and text[at - 1] in STABLE_SPACES:
                return at
        return None

    # --- other texts: words, each encoded once ---

    def learn(self, words: set[bytes]) -> None:
        """Remember the counts of words; two generations of bounded size."""
        todo = []
        for w in words:
            if w not in self.young:
                known = self.old.get(w)
                if known is None:
                    todo.append(w)
                else:
                    self.young[w] = known
        for at in range(0, len(todo), 256):
            part = todo[at : at + 256]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.young.update(zip(part, map(len, found), strict=True))

    def forget(self) -> None:
        if len(self.young) > self.memory:
            self.old, self.young = self.young, {}

    def count(self, text: str) -> int:
        if len(text) > CHUNK_CHARS:
            return self.count_overlapping(text)
        words = text.encode().split()
        counts = list(map(self.young.get, words))
        if None in counts:
            self.learn({w for w, n in zip(words, counts, strict=True) if n is None})
            counts = map(self.young.__getitem__, words)
        total = sum(counts)
        self.forget()
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One counter per worker process."""
    return TokenCounter(path)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    limit: int = 2048,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Null counts as empty: 0 bytes, 0 tokens. A null id is carried, repeated
    rows give repeated rows, an empty table an empty result; other columns are
    not read. ``path``: a ``tokenizers`` JSON file at the same place on every
    executor, whose pieces must not reach across ASCII white space (see above).
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            counts = [tokens.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = map_rows(rows, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
