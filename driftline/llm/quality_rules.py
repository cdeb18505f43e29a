"""Quality rules and a linear-chain CRF over the lines of a document.

Every line is labelled content or boilerplate by Viterbi decoding; a document
is kept if the content lines hold at least half of its word characters and
the base rules do not fail it. The CRF is trained in numpy by maximum
likelihood (forward-backward) on a bounded sample of labelled documents, whose
lines all carry the document's quality label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import SPACE_BYTES, map_rows

# The signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = bytes(range(0x30, 0x3A))
ENDS = (b".", b"!", b"?", b":", b";", b'"')
BOILERPLATE, CONTENT = 0, 1
# Bound of the training sample: so many lines of one labelled document.
SAMPLE_LINES = 4096
FEATURES = [
    "bias", "one_word", "few_words", "many_words", "symbols", "dense_symbols", "capitals", "digits", "no_end",
    "exclaims", "repeats_line", "long_words", "few_letters", "same_words",
]


def line_features(lines: list[bytes], repeated: list[bool]) -> np.ndarray:
    """One row of features per line (``FEATURES``), each within 0 and 1."""
    out = np.zeros((len(lines), len(FEATURES)), dtype=np.float64)
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        chars = sum(map(len, words)) or 1
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        upper = len(line) - len(line.translate(None, UPPER))
        lower = len(line) - len(line.translate(None, LOWER))
        digits = len(line) - len(line.translate(None, DIGITS))
        ascii_letters = upper + lower
        high = len(line) - len(line.translate(None, LOWER + UPPER + bytes(range(0x80))))
        row = out[i]
        row[0] = 1.0
        row[1] = n <= 1
        row[2] = 1 < n <= 4
        row[3] = n >= 12
        row[4] = min(1.0, 5.0 * symbols / chars)
        row[5] = symbols * 10 > chars
        row[6] = upper * 2 > ascii_letters and ascii_letters >= 4
        row[7] = min(1.0, 4.0 * digits / chars)
        row[8] = not line.rstrip().endswith(ENDS)
        row[9] = min(1.0, 4.0 * line.count(b"!!") / max(1, n))
        row[10] = repeated[i]
        row[11] = chars > 14 * max(1, n)
        row[12] = (ascii_letters + high) * 10 < 6 * chars
        row[13] = n >= 6 and len(set(words)) * 2 < n
    return out


def lines_of(text: str | None) -> tuple[list[bytes], list[bool]]:
    """Lines that hold a word, and whether each equals an earlier one."""
    lines, repeated, seen = [], [], set()
    for line in (text or "").encode().split(b"\n"):
        if not line.strip(SPACE_BYTES):
            continue
        repeated.append(line in seen)
        seen.add(line)
        lines.append(line)
    return lines, repeated


class LineCrf:
    """A linear chain with two labels: ``weights`` (features x 2) for a label
    given a line, ``moves`` (2 x 2) from a line's label to the next one's."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((len(FEATURES), 2)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves
        if weights is None:  # nothing learned: everything is content
            self.weights[0, CONTENT] = 1.0

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best label sequence (Viterbi); ties prefer content."""
        n = len(features)
        emit = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        b, c = emit[0] if n else (0.0, 0.0)
        back = []
        for e0, e1 in emit[1:]:
            f0, f1 = c + m10 >= b + m00, c + m11 >= b + m01
            back.append((f0, f1))
            b, c = (c + m10 if f0 else b + m00) + e0, (c + m11 if f1 else b + m01) + e1
        labels = np.empty(n, dtype=np.int8)
        if n:
            label = int(c >= b)
            labels[-1] = label
            for i in range(n - 2, -1, -1):
                label = int(back[i][label])
                labels[i] = label
        return labels

    def likelihood(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log likelihood of label sequences (padded arrays: documents x
        lines) and its gradients, by forward-backward."""
        docs, length, _ = x.shape
        emit = x @ self.weights
        alpha = np.empty((docs, length, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, length):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + self.moves, axis=1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        beta = np.zeros((docs, length, 2))
        for t in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(self.moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        single = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        gold = np.eye(2)[y] * mask[..., None]
        pairs = np.exp(
            alpha[:, :-1, :, None] + self.moves + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]
        ) * mask[:, 1:, None, None]
        gold_pairs = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        lines = mask.sum()
        score = (emit * gold).sum() + (gold_pairs * self.moves).sum() - total.sum()
        grad_w = np.einsum("dtf,dtl->fl", x, gold - single) / lines
        grad_m = (gold_pairs - pairs).sum(axis=(0, 1)) / lines
        return score / lines, grad_w, grad_m

    def fit(self, sequences: list[np.ndarray], labels: list[int], rounds: int = 100, l2: float = 1e-4, longest: int = 32):
        """Gradient ascent with Adam steps; long documents are cut into
        sequences of ``longest`` lines, none of their lines is left out."""
        parts = [(s[i : i + longest], y) for s, y in zip(sequences, labels, strict=True) for i in range(0, len(s), longest)]
        if not parts or len({y for _, y in parts}) < 2:
            return self
        length = max(len(p) for p, _ in parts)
        x = np.zeros((len(parts), length, len(FEATURES)))
        mask = np.zeros((len(parts), length), dtype=bool)
        y = np.zeros((len(parts), length), dtype=np.int64)
        for k, (p, label) in enumerate(parts):
            x[k, : len(p)], mask[k, : len(p)], y[k] = p, True, label
        self.weights[:] = 0.0
        state = [np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros((2, 2)), np.zeros((2, 2))]
        for step in range(1, rounds + 1):
            _, gw, gm = self.likelihood(x, mask, y)
            for k, (param, grad) in enumerate(((self.weights, gw), (self.moves, gm))):
                grad = grad - l2 * param
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
                state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * grad**2
                hat = state[2 * k] / (1 - 0.9**step)
                param += 0.1 * hat / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
        return self


def repeated_window_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur at least twice.

    Windows are numbered exactly: equal numbers mean equal words (pairs of
    words, pairs of pairs, then the last word; no hash is trusted)."""
    n = len(words)
    if n <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == n:
        return 0
    pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    if pair.max() + 1 == len(pair):
        return 0
    four = np.unique(pair[:-2] * n + pair[2:], return_inverse=True)[1]
    _, window, times = np.unique(four[:-1] * n + ids[4:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = text or ""
    data = text.encode()
    words = data.split()
    spaces = len(data) - len(data.translate(None, SPACE_BYTES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    duplicates = 0
    if b"\n" in data:
        lines = Counter(line for line in data.split(b"\n") if line.strip(SPACE_BYTES))
        duplicates = sum(lines.values()) - len(lines)
    return len(words), len(text) - spaces, symbols, duplicates, repeated_window_words(words)


def content_share(crf: LineCrf, text: str | None) -> tuple[float, list[int]]:
    """Share of word bytes in content lines, and the label of each line."""
    lines, repeated = lines_of(text)
    if not lines:
        return 0.0, []
    labels = crf.decode(line_features(lines, repeated))
    sizes = np.array([len(x.translate(None, SPACE_BYTES)) for x in lines])
    return float(sizes[labels == CONTENT].sum() / sizes.sum()), labels.tolist()


def train_crf(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2000,
    sample_lines: int = SAMPLE_LINES,
) -> LineCrf:
    """A CRF from at most ``max_docs`` labelled documents, half of each class
    where there are enough, chosen by the hash of their id, and of each its first
    ``sample_lines`` lines: both bound what the driver fits. Verdicts always
    read all lines.

    Without labelled documents of both classes everything is content.
    """
    picked = []
    for quality in (0, 1):
        picked.append(
            labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("y"))
            .orderBy(F.xxhash64("key"), "key").limit(max_docs // 2)
        )
    wanted = picked[0].unionByName(picked[1]).distinct()
    rows = (
        docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
        .where("text IS NOT NULL")
        # At most max_docs rows of two numbers.
        .join(F.broadcast(wanted), "key")
        .groupBy("key").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    )
    features = rows.select("y", "text").mapInArrow(_feature_batches(sample_lines), "y int, n int, x binary").collect()
    sequences = [np.frombuffer(r["x"], dtype=np.float32).reshape(r["n"], -1).astype(float) for r in features]
    order = sorted(range(len(sequences)), key=lambda i: (features[i]["y"], bytes(features[i]["x"])))
    return LineCrf().fit([sequences[i] for i in order], [features[i]["y"] for i in order])


def _feature_batches(sample_lines: int):
    """Line features of labelled texts: what the driver gets instead of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, ns, xs = [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines, repeated = lines_of(text.as_py())
                if lines:
                    x = line_features(lines, repeated)[:sample_lines].astype(np.float32)
                    ys.append(y), ns.append(len(x)), xs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array(ns, pa.int32()), pa.array(xs, pa.binary())], ["y", "n", "x"]
            )

    return run


def verdicts(crf: LineCrf, min_words: int = 10, max_repeat_percent: int = 20, min_content: float = 0.5):
    """A function from a text to its five base figures, ``base_failed``,
    ``kept`` and ``content_share``."""

    def judge(text: str | None) -> tuple:
        figures = base_figures(text)
        n, repeats = figures[0], figures[4]
        failed = n < min_words or 100 * repeats > max_repeat_percent * n
        share, _ = content_share(crf, text)
        return (*figures, failed, not failed and share >= min_content, share)

    return judge


def apply_rules(
    docs: DataFrame,
    crf: LineCrf,
    id_col: str = "doc_id",
    text_col: str = "text",
    **limits,
) -> DataFrame:
    """Per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, content_share``.

    Null, empty and blank texts have no words, so the base rules fail them; a
    null id is carried; repeated rows give repeated rows; an empty table gives
    an empty result; other columns are not read. A text of any length is
    labelled whole. Equal scores count as content.
    """
    names = [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "content_share",
    ]
    judge = verdicts(crf, **limits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(text.as_py()) for text in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(
        rows, run,
        f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, base_failed boolean, kept boolean, content_share double",
    )


def keep_rows(rows: DataFrame, crf: LineCrf, text_col: str = "text", **limits) -> DataFrame:
    """The rows that ``apply_rules`` keeps, with all their columns, in one pass:
    the text of a row is judged next to the row, without a join."""
    judge = verdicts(crf, **limits)

    @F.pandas_udf("boolean")
    def stays(texts: pd.Series) -> pd.Series:
        return pd.Series([judge(t)[6] for t in texts], dtype=bool)

    return rows.where(stays(F.col(f"`{text_col}`")))
