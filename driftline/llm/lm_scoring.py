"""Log-bilinear language model over word classes, trained with NCE in numpy.

A frequent word is a class of its own, any other word belongs to the class
of its ending. The model gives P(class | two classes before) as a softmax over
all classes of ``(A[c1] + B[c2]) . R[class] + b[class]``; inside a class words
have add-one unigram probabilities, with one more share for a word never seen.
Both are normalised, so the product is a probability of the token.

Counts cover all training text and stay distributed: only a bounded head of
frequent words is known to the tasks, rarer words are joined with the counts.
Every task trains on all its training text by noise-contrastive
estimation; the parameters are averaged, weighted by tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import map_rows, most_frequent, stored

OTHER = b""
# A task hands on its word counts whenever it holds so many words.
FLUSH_WORDS = 300_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), without the end."""
    return (text or "").encode().lower().split()


@dataclass
class Lexicon:
    """What every task knows of the corpus; all parts have fixed bounds."""

    total: int  # training tokens, ends included
    distinct: int  # distinct training tokens, the end included
    ends: int  # training documents
    head: dict[bytes, int]  # the most frequent words -> their place
    head_count: np.ndarray
    head_class: np.ndarray
    endings: dict[bytes, int]  # word ending -> class of the other words
    class_mass: np.ndarray  # sum of (c + 1) of a class's words, and 1
    class_count: np.ndarray  # training tokens of a class
    own: int  # classes below this number are single words; 0 is the end

    @property
    def classes(self) -> int:
        return len(self.class_mass)


# --- counts ---


def word_counts(docs: DataFrame, text: Column, train: Column) -> DataFrame:
    """``word, c`` over all training texts; combined in each task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens_of(text.as_py()))
                if len(counts) > FLUSH_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.where(train).select(text.alias("text"))
    return map_rows(rows, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def build_lexicon(counts: DataFrame, ends: int, head_words: int, own_classes: int, ending_classes: int) -> Lexicon:
    """Totals, the head, and the classes. The driver gets up to ``head_words`` words
    and at most 65,793 endings of up to two bytes."""
    size = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = most_frequent(counts, "c", head_words).toArrow().sort_by([("c", "descending"), ("word", "ascending")]).to_pylist()
    ending = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    found = counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    mass = {bytes(r["e"]): [r["c"], r["n"]] for r in found}
    own = [(bytes(r["word"]), r["c"]) for r in top[:own_classes]]
    for word, c in own:  # words with a class of their own leave their ending
        mass[word[-2:]][0] -= c
        mass[word[-2:]][1] -= 1
    ranked = sorted((e for e in mass if mass[e][1] > 0), key=lambda e: (-mass[e][0], e))
    base = 1 + len(own)
    endings = {e: base + 1 + i for i, e in enumerate(ranked[: ending_classes - 1])}
    n = base + 1 + len(endings)
    class_mass, class_count = np.ones(n), np.zeros(n)
    class_count[0] = ends
    for i, (_, c) in enumerate(own):
        class_count[1 + i] = c
    for e in ranked:
        k = endings.get(e, base)
        class_mass[k] += mass[e][0] + mass[e][1]
        class_count[k] += mass[e][0]
    head = {bytes(r["word"]): i for i, r in enumerate(top)}
    head_class = [1 + i if i < len(own) else endings.get(w[-2:], base) for w, i in head.items()]
    return Lexicon(
        size[1] + ends, size[0] + (ends > 0), ends, head, np.array([r["c"] for r in top], dtype=float),
        np.array(head_class, dtype=np.int32), endings, class_mass, class_count, base,
    )


# --- the model ---


class LogBilinear:
    """Parameters: context vectors ``a``, ``b`` (last, last but one), target
    vectors ``r``, biases. Untrained it is the unigram model of the classes."""

    def __init__(self, class_count: np.ndarray, dim: int, seed: int = 7):
        n = len(class_count)
        self.noise = (class_count + 1.0) / (class_count + 1.0).sum()
        rng = np.random.default_rng(seed)
        self.a = rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        self.b = rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        self.r = rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.a.ravel(), self.b.ravel(), self.r.ravel(), self.bias])

    def load(self, flat: np.ndarray) -> None:
        n, dim = self.a.shape
        parts = np.split(flat.astype(np.float32), [n * dim, 2 * n * dim, 3 * n * dim])
        self.a, self.b, self.r = (p.reshape(n, dim) for p in parts[:3])
        self.bias = parts[3]

    def train(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, batch: int = 8192, noise: int = 32,
              rate: float = 0.15, least_steps: int = 400, seed: int = 11) -> None:
        """NCE with noise shared by a batch, Adagrad steps. Passes over the
        positions are repeated until there were ``least_steps`` batches."""
        rng, n = np.random.default_rng(seed), len(w)
        tables = [self.a, self.b, self.r, self.bias]
        power = [np.full(t.shape, 1e-3, dtype=np.float32) for t in tables]
        log_noise = np.log(self.noise).astype(np.float32)
        k, dim = self.a.shape
        steps = 0
        cumulative = np.cumsum(self.noise)

        def scatter(index, values):
            return np.stack([np.bincount(index, values[:, j], minlength=k) for j in range(dim)], axis=1)

        while True:
            order = rng.permutation(n)
            for at in range(0, n, batch):
                pick = order[at : at + batch]
                x, y, t = c1[pick], c2[pick], w[pick]
                false = np.minimum(np.searchsorted(cumulative, rng.random(noise)), k - 1)
                q = self.a[x] + self.b[y]
                # Log odds that a word is data, against ``noise`` false ones.
                own = (q * self.r[t]).sum(axis=1) + self.bias[t] - log_noise[t] - np.log(noise)
                others = q @ self.r[false].T + (self.bias[false] - log_noise[false] - np.log(noise))
                g_own = 1.0 / (1.0 + np.exp(np.clip(own, -30, 30)))
                g_others = -1.0 / (1.0 + np.exp(np.clip(-others, -30, 30)))
                g_q = g_own[:, None] * self.r[t] + g_others @ self.r[false]
                g_r = scatter(t, g_own[:, None] * q)
                np.add.at(g_r, false, g_others.T @ q)
                g_bias = np.bincount(t, g_own, minlength=k)
                np.add.at(g_bias, false, g_others.sum(axis=0))
                scale = 1.0 / len(pick)
                for table, past, g in zip(tables, power, (scatter(x, g_q), scatter(y, g_q), g_r, g_bias), strict=True):
                    g = (g * scale).astype(np.float32)
                    past += g * g
                    table += rate * g / np.sqrt(past)
                steps += 1
            if steps >= least_steps:
                return

    def log_probs(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, block: int = 2048) -> np.ndarray:
        """Natural logs of P(w | c1, c2), normalised over all classes: one
        matrix product per block of distinct contexts."""
        k = len(self.bias)
        contexts, place = np.unique(c1.astype(np.int64) * k + c2, return_inverse=True)
        log_z = np.empty(len(contexts), dtype=np.float64)
        for at in range(0, len(contexts), block):
            c = contexts[at : at + block]
            logits = (self.a[c // k] + self.b[c % k]) @ self.r.T + self.bias
            top = logits.max(axis=1)
            log_z[at : at + block] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1, dtype=np.float64))
        own = np.einsum("ij,ij->i", self.a[c1] + self.b[c2], self.r[w]) + self.bias[w]
        return own - log_z[place]


def class_rows(lexicon: Lexicon, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place in the head (-1: not in it) and class of each word."""
    head, endings, other = lexicon.head.get, lexicon.endings.get, lexicon.own
    place = np.array([head(w, -1) for w in words], dtype=np.int64)
    classes = np.empty(len(words), dtype=np.int64)
    inside = place >= 0
    classes[inside] = lexicon.head_class[place[inside]]
    for i in np.flatnonzero(~inside):
        classes[i] = endings(words[i][-2:], other)
    return place, classes


def contexts_of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``c1, c2, w`` of documents' classes, each followed by the end (class 0);
    before the first word of a document stand two ends."""
    w = np.concatenate([x for p in parts for x in (p, [0])]).astype(np.int64)
    c1 = np.concatenate([[0], w[:-1]])
    c2 = np.concatenate([[0, 0], w[:-2]])[: len(w)]
    c2[c1 == 0] = 0
    return c1, c2, w


def train_model(docs: DataFrame, text: Column, train: Column, lexicon: Lexicon, dim: int) -> LogBilinear:
    """Parameters averaged over the tasks that read the training texts."""
    start = LogBilinear(lexicon.class_count, dim)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = LogBilinear(lexicon.class_count, dim), 0
        parts: list[np.ndarray] = []
        size = 0

        def learn():
            c1, c2, w = contexts_of(parts)
            model.train(c1, c2, w, least_steps=400 if tokens == len(w) else 1)

        for batch in batches:
            for text in batch.column(0):
                parts.append(class_rows(lexicon, tokens_of(text.as_py()))[1].astype(np.int16))
                size += len(parts[-1]) + 1
                if size > 4_000_000:  # bounded memory: learn, then read on
                    tokens += size
                    learn()
                    parts, size = [], 0
        if parts:
            tokens += size
            learn()
        if tokens:
            flat = model.vector().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.array([flat.tolist()])], ["n", "flat"])

    rows = docs.where(train).select(text.alias("text"))
    sums = (
        map_rows(rows, run, "n double, flat array<double>")
        .select("n", F.posexplode("flat").alias("i", "v"))
        .groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
        .collect()
    )
    if sums:
        flat = np.empty(len(sums))
        for r in sums:
            flat[r["i"]] = r["v"]
        start.load(flat)
    return start


# --- scores ---


def score(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_words: int = 200_000,
    own_classes: int = 255,
    ending_classes: int = 256,
    dim: int = 16,
) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``.

    Scores are log10 probabilities of the whole text and its end. A null or
    empty text is its end alone; rows for which ``train`` is null or false are
    only scored; with no training row at all every probability is 1 (the
    one share of unseen words). A null id is carried, repeated rows give
    repeated rows, an empty table an empty result; other columns are not read.
    """
    train = F.coalesce(train, F.lit(False))
    text = F.col(f"`{text_col}`")
    counts = stored(word_counts(docs, text, train), "counts")
    ends = docs.where(train).count()
    lexicon = build_lexicon(counts, ends, head_words, own_classes, ending_classes)
    model = train_model(docs, text, train, lexicon, dim)
    log_end = np.log10(lexicon.ends + 1.0)
    log_mass = np.log10(lexicon.class_mass)
    trained = lexicon.total > 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "train", "n_tokens", "n_known", "log_counts", "log_score", "rare", "times"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        log_head = np.log10(lexicon.head_count + 1.0)
        for batch in batches:
            ids, flags, texts = batch.columns
            at = 0
            while at < len(texts):
                places, classes, rare, size, first = [], [], [], 0, at
                while at < len(texts) and size < 1_000_000:
                    words = tokens_of(texts[at].as_py())
                    place, cls = class_rows(lexicon, words)
                    rare.append(Counter(words[i] for i in np.flatnonzero(place < 0)))
                    places.append(place)
                    classes.append(cls)
                    size += len(words) + 1
                    at += 1
                c1, c2, w = contexts_of(classes)
                log_p = model.log_probs(c1, c2, w) / np.log(10.0) if trained else np.zeros(len(w))
                # Inside a class: (c + 1) / mass; the rare words' c comes later.
                inside = np.where(w >= lexicon.own, -log_mass[w], 0.0) if trained else np.zeros(len(w))
                lengths = np.array([len(p) + 1 for p in places])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                per_doc = np.add.reduceat(log_p + inside, starts)
                rows: list[list] = [[], [], [], [], [], []]
                for k, place in enumerate(places):
                    known = place[place >= 0]
                    logs = log_head[known]
                    shared = logs[lexicon.head_class[known] >= lexicon.own].sum() if len(known) else 0.0
                    for column, v in zip(
                        rows,
                        (
                            len(place) + 1, len(known) + (lexicon.ends > 0), float(logs.sum() + log_end),
                            float(per_doc[k] + shared), list(rare[k].keys()), list(rare[k].values()),
                        ),
                        strict=True,
                    ):
                        column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, at - first), flags.slice(first, at - first),
                     *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), train.alias("train"), text.alias("text"))
    passed = map_rows(
        rows, run,
        f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, log_counts double, log_score double,"
        " rare array<binary>, times array<int>",
    )
    passed = stored(passed.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = passed.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    per_doc = rare.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("log_rare"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_rare"),
    )
    norm = float(np.log10(lexicon.total + lexicon.distinct + 1.0))
    out = passed.drop("rare", "times").join(per_doc, "uid", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return out.select(
        "doc_id", "train", "n_tokens",
        (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + log_rare - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("log_score") + log_rare).alias("score"),
    )
