"""Language by compression: the dictionary that shortens a text most wins.

Each learned language has a raw-content zstandard dictionary of bounded size,
cut from labelled texts. A text is compressed with every dictionary, in
blocks, so that a long text is judged by the dictionary and not by its own
beginning; the sizes of all its blocks are added. Languages with less text have
shorter dictionaries, which shorten no other one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import map_rows

UNDETERMINED = "und"
# ASCII that is no letter becomes a space, A-Z becomes a-z; other bytes stay.
LETTERS = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    """What is compressed: lower-case words without ASCII signs and digits."""
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def training_pieces(
    docs: DataFrame, train: Column, text_col: str, lang_col: str, id_col: str, per_language: int, piece_chars: int
) -> dict[str, tuple[int, list[str]]]:
    """Per language its number of rows and a bounded sample of pieces, the same
    at every run.

    About ``2 * per_language`` rows per language pass a hash filter whose rate
    follows from the language's count; of those, the first ``per_language`` by
    hash are used. A piece starts at a place drawn by the hash.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    rows = docs.select(
        text.alias("text"), lang.cast("string").alias("lang"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("h"), train.alias("train"),
    ).where("train AND lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rate = F.lit(0.0)
    for name, n in counts.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * per_language / n))).otherwise(rate)
    start = F.pmod(F.shiftright("h", 8), F.greatest(F.length("text") - piece_chars, F.lit(1))) + 1
    picked = rows.where(F.pmod("h", F.lit(1 << 20)) < rate * (1 << 20)).select(
        "lang", "h", F.substring(F.col("text"), start.cast("int"), F.lit(piece_chars)).alias("piece")
    ).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"], r["piece"])):
        if len(found.setdefault(r["lang"], [])) < per_language:
            found[r["lang"]].append(r["piece"])
    return {name: (counts[name], p) for name, p in found.items()}


class CompressionClassifier:
    """Per language a raw-content dictionary; smallest compressed size wins.

    A dictionary is as long as its language's pieces give, up to
    ``dictionary_bytes``. Two languages are compared at the length of the shorter
    dictionary, as a longer one has an advantage. Below ``least_bytes`` and a
    quarter of the other's length a dictionary says too little for that: it is
    held against the other's whole one, so a tiny label costs the others
    nothing and wins where it shortens more than they do. Languages are
    compared from the longest dictionary down, the winner so far with the next.
    Labels whose pieces hold no letter learn nothing and are never predicted.
    """

    def __init__(
        self, pieces: dict[str, tuple[int, list[str]]], dictionary_bytes: int = 96 << 10, block: int = 4096,
        level: int = 6, narrow: float = 0.02, least_bytes: int = 4096, shortened: int = 32,
    ):
        """``shortened``: so many shortened dictionaries are kept at a time."""
        self.block, self.level, self.narrow, self.least_bytes = block, level, narrow, least_bytes
        # The most frequent language first: it wins ties, as in texts of a word.
        self.languages, self.contents = [], []
        for name in sorted(pieces, key=lambda name: (-pieces[name][0], name)):
            # Whole pieces, dealt evenly: every piece gives its share.
            share = max(64, dictionary_bytes // max(1, len(pieces[name][1])))
            content = b" ".join(letters(p)[:share] for p in pieces[name][1])[:dictionary_bytes]
            if content.strip():
                # A dictionary has eight bytes at least.
                self.languages.append(name)
                self.contents.append(content if len(content) >= 8 else (content + b" ") * 8)
        self.lengths = [len(c) for c in self.contents]
        self.order = sorted(range(len(self.languages)), key=lambda i: (-self.lengths[i], i))
        self.whole = [self._compressor(i, n) for i, n in enumerate(self.lengths)]
        self.cut = functools.lru_cache(maxsize=shortened)(self._compressor)

    def _compressor(self, i: int, length: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(self.contents[i][:length], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False)

    def _compared(self, i: int, j: int) -> tuple[int, int]:
        """The lengths at which two dictionaries are compared."""
        a, b = self.lengths[i], self.lengths[j]
        low, high = min(a, b), max(a, b)
        return (low, low) if low >= self.least_bytes or 4 * low >= high else (a, b)

    def compare(self, data: bytes) -> tuple[int, float]:
        """The winning language's place and its saving over the best other."""
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        known: dict[tuple[int, int], int] = {}

        def size(i: int, length: int) -> int:
            if (i, length) not in known:
                c = self.whole[i] if length == self.lengths[i] else self.cut(i, length)
                known[i, length] = sum(map(len, map(c.compress, blocks)))
            return known[i, length]

        def sizes(i: int, j: int) -> tuple[int, int]:
            a, b = self._compared(i, j)
            return size(i, a), size(j, b)

        best = self.order[0]
        for j in self.order[1:]:
            a, b = sizes(best, j)
            if (b, j) < (a, best):
                best = j
        margin = 1.0
        for j in self.order:
            if j != best:
                a, b = sizes(best, j)
                margin = min(margin, (b - a) / b)
        return best, max(0.0, margin)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1) and whether the margin is wide enough.

        Ties go to the language with the most learned rows. The score compares the saving
        of the winner with the runner-up's: 0.5 if both are equal, towards 1 as
        the runner-up needs more.
        """
        if not text or not self.languages or LETTER.search(text) is None:
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, True
        best, margin = self.compare(letters(text))
        return self.languages[best], 0.5 + 0.5 * min(1.0, margin / 0.25), margin >= self.narrow


def fit(
    docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    per_language: int = 256, piece_chars: int = 1024, **options,
) -> CompressionClassifier:
    """Dictionaries from the rows where ``train`` holds; ``per_language`` bounds
    the labelled sample of each language."""
    pieces = training_pieces(docs, train, text_col, lang_col, id_col, per_language, piece_chars)
    return CompressionClassifier(pieces, **options)


def identify(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> DataFrame:
    """``doc_id, train, lang_pred, score, accepted`` of every whole text.

    ``accepted`` is false where the two best languages lie too close. Null
    texts and texts without a letter are ``und`` with score 0, and so is every
    text if nothing was learned; a language without a letter to learn from is
    never predicted; rows without a language are predicted but
    never learned from; a null id is carried; repeated rows give repeated
    rows; an empty table gives an empty result. Only the text is an input of a
    prediction.
    """
    pieces = training_pieces(docs, train, text_col, lang_col, id_col, options.pop("per_language", 256), options.pop("piece_chars", 1024))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(pieces, **options)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_()),
                ],
                ["doc_id", "train", "lang_pred", "score", "accepted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), train.alias("train"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(rows, run, f"doc_id {kind}, train boolean, lang_pred string, score double, accepted boolean")
