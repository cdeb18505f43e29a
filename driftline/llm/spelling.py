"""Spelling variants by permuterm rotations.

Every word is marked with a terminator and written in all its rotations. A word
that has the character x at some place reads, from after that place on and
round to it, as a prefix followed by x: all words that differ from it in this
character only have the same prefix, and the word without the character has this
prefix as a whole rotation. So the rotations that share a prefix up to the edited
character are the neighbours: at most one word without it and one for each letter
of the alphabet. Rotations are dealt by that prefix and sorted; each group is
scanned once and emits, per word, how many neighbours it has there and the best one.

Each near pair meets in one group only: a pair of equal length has one
differing place, and of a run of equal characters only the first counts as the
one left out.

Words stand for themselves up to ``LONG_WORD`` code points. The rotations of a
longer word would take the square of its length, so their prefixes are named by
two 61-bit polynomial hashes each, computed from running hashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, stored
from driftline.operators.ordered import row_numbers

# What makes a run, which occurrences lose a code point, which words count.
LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)])
DROP_EVERY, LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 97, 5, 3, 2
TERMINATOR = "$"
LONG_WORD = 64
HELD_WORDS = 300_000
PRIMES = ((1 << 61) - 1, (1 << 61) - 1)
BASES = (0x1F3D5B79A2C4E6, 0x2A4C6E8091B3D5)


# --- counting ---


def _classes() -> bytes:
    """Latin-1 letters to themselves (only A-Z lower-cased), the rest to space."""
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in LETTERS else 32 for b in range(256))


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts ``word, n`` of a task, in bounded memory."""
    table = _classes()
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            # One byte per code point; what Latin-1 lacks becomes a question mark.
            runs = Counter(text.as_py().encode("latin-1", "replace").translate(table).split())
            start = zlib.crc32(f"{key.as_py()}:".encode()) if key.is_valid else None
            for run, n in runs.items():
                if start is not None:
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % DROP_EVERY == 0:
                        place = h % len(run)
                        run = run[:place] + run[place + 1 :]
                if len(run) >= LEAST_LENGTH:
                    held[run] += n
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words that count."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counts = map_rows(rows, word_rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(f"n >= {LEAST_COUNT}")


# --- rotations ---


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, whole, first, id, n`` for words of bounded length.

    ``whole``: the prefix is a whole rotation (the word lacks the edited
    character); else the rotation's last character is cut, and ``first`` says
    that the character before it is another one.
    """
    length = F.length("word")
    spun = words.select("id", "n", "word", F.explode(F.sequence(F.lit(0), 2 * length)).alias("r"))
    spun = spun.withColumn("whole", F.col("r") <= length)
    at = F.when(F.col("whole"), F.col("r")).otherwise(F.col("r") - length)
    spun = spun.withColumn("at", at)
    head = F.when(F.col("whole"), F.col("at")).otherwise(F.col("at") - 1)
    cut = lambda start, n: F.substring(F.col("word"), start, n)
    return spun.select(
        F.concat(cut(F.col("at") + 1, length), F.lit(TERMINATOR), cut(F.lit(1), head)).alias("prefix"),
        "whole",
        (F.col("whole") | (F.col("at") == 1) | (cut(F.col("at"), F.lit(1)) != cut(F.col("at") - 1, F.lit(1)))).alias("first"),
        "id",
        "n",
    )


def rotation_names(word: str) -> Iterator[tuple[str, bool, bool]]:
    """The same rows for one long word, prefixes named by hashes."""
    codes = [ord(c) for c in word]
    size, stop = len(codes), ord(TERMINATOR)
    tables = []
    for base, prime in zip(BASES, PRIMES, strict=True):
        powers, sums = [1], [0]
        for c in codes:
            powers.append(powers[-1] * base % prime)
            sums.append((sums[-1] * base + c) % prime)
        tables.append((base, prime, powers, sums))

    def name(at: int, head: int) -> str:
        """Of word[at:] + terminator + word[:head]."""
        parts = []
        for base, prime, powers, sums in tables:
            tail = (sums[size] - sums[at] * powers[size - at]) % prime
            parts.append(((tail * base + stop) * powers[head] + sums[head]) % prime)
        return f"{TERMINATOR}{size - at + 1 + head}:{parts[0]:x}:{parts[1]:x}"

    for at in range(size + 1):
        yield name(at, at), True, True
        if at:
            yield name(at, at - 1), False, at == 1 or codes[at - 1] != codes[at - 2]


def long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["prefix", "whole", "first", "id", "n"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            rows: list[tuple] = []
            for name, whole, first in rotation_names(r["word"]):
                # Of the longest short words: what longer ones without a character read.
                if whole or len(r["word"]) > LONG_WORD:
                    rows.append((name, whole, first, r["id"], r["n"]))
                if len(rows) >= 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def neighbours(words: DataFrame) -> DataFrame:
    """``id, n_near, best_n, best_id`` of words that have a near word.

    ``words``: ``id, word, n``; ids follow the code-point order of the words.
    The best near word has the largest ``n``, then the smallest id.
    """
    short = rotations(words.where(F.length("word") <= LONG_WORD))
    long = map_rows(
        words.where(F.length("word") >= LONG_WORD).select("id", "n", "word"),
        long_rows, "prefix string, whole boolean, first boolean, id long, n long",
    )
    group = Window.partitionBy("prefix")
    scan = group.orderBy("whole", "id")
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    after = scan.rowsBetween(1, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("minus_n"), F.col("id").alias("id"))
    cut, whole = ~F.col("whole"), F.col("whole")
    seen = short.unionByName(long).select(
        "id", "n", "whole", "first",
        F.count(F.when(cut, True)).over(group).alias("cuts"),
        F.count(F.when(cut & F.col("first"), True)).over(group).alias("firsts"),
        F.count(F.when(whole, True)).over(group).alias("wholes"),
        F.least(F.min(F.when(cut, own)).over(before), F.min(F.when(cut, own)).over(after)).alias("best_cut"),
        F.min(F.when(cut & F.col("first"), own)).over(group).alias("best_first"),
        F.min(F.when(whole, own)).over(group).alias("best_whole"),
    )
    emitted = seen.where("cuts + wholes > 1").select(
        "id",
        F.when(whole, F.col("firsts")).otherwise(
            F.col("cuts") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(F.lit(0).cast("long"))
        ).alias("near"),
        F.when(whole, F.col("best_first")).otherwise(
            F.least("best_cut", F.when(F.col("first"), F.col("best_whole")))
        ).alias("best"),
    ).where("near > 0")
    found = emitted.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("id", "n_near", (-F.col("best.minus_n")).alias("best_n"), F.col("best.id").alias("best_id"))


# --- forms ---


def roots_of(forms: DataFrame) -> DataFrame:
    """``id, root`` from ``id, up``: chains followed to their end. Counts at
    least double from word to form, so there are no circles, and a chain is
    as long as the logarithm of the largest count; each round halves it."""
    ways = stored(forms.select("id", F.col("up").alias("root")), "forms")
    while True:
        onward = ways.select(F.col("id").alias("via"), F.col("root").alias("next"))
        jumped = stored(
            ways.join(onward, F.col("root") == F.col("via"), "left").select(
                "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        ways = jumped.select("id", "root")
        if jumped.where("moved").isEmpty():
            return ways


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    * null text, text without letters: no words
    * null id: the row's runs stay as they are (no hash, nothing deleted)
    * repeated rows: each counts
    * ties for the form: the smallest word in code-point order
    * very long runs: named by hashes instead of whole rotations
    * empty table: empty result; other columns of ``docs`` are not read
    """
    counted = stored(vocabulary(docs, id_col, text_col).withColumn("all", F.lit(1)), "vocabulary")
    words = stored(row_numbers(counted, ["all"], ["word"], "id").select("id", "word", "n"), "words")
    near = stored(neighbours(words), "neighbours")
    forms = near.join(words.select("id", "n"), "id").where(f"best_n >= {FORM_FACTOR} * n").select(
        "id", F.col("best_id").alias("up")
    )
    ends = roots_of(forms).withColumnRenamed("id", "r_id")
    linked = near.withColumnRenamed("id", "n_id")
    name = lambda i, w: words.select(F.col("id").alias(i), F.col("word").alias(w))
    return (
        words.join(linked, F.col("id") == F.col("n_id"), "left")
        .join(ends, F.col("id") == F.col("r_id"), "left")
        .withColumn("f_id", F.when(F.col("best_n") >= FORM_FACTOR * F.col("n"), F.col("best_id")))
        .join(name("f_key", "form"), F.col("f_id") == F.col("f_key"), "left")
        .join(name("r_key", "root_word"), F.col("root") == F.col("r_key"), "left")
        .select(
            "word", "form", F.coalesce("root_word", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("f_id").isNotNull(), F.col("best_n")).alias("form_n"),
        )
    )
