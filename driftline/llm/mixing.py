"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a share of all words; a document of a source is taken
``floor(r)`` times for the ratio ``r`` of target and source size, and once more
with the remaining probability. Which ones is decided by the cube method: the
probabilities walk through the null space of the constraints (words taken and
documents taken), a unit drops out whenever its probability reaches 0 or 1,
and at most two units of a block stay undecided. Every step is drawn so that
a unit's chance stays what it was, so long and short documents are taken alike. The
undecided meet in the next round's blocks, until one block per source is left,
whose last dozen units are the landing problem: only there nearness to the target
comes before the chances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import WORD, row_hash, stored
from driftline.operators.ordered import row_numbers

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
LANDING_UNITS = 12
# So many times the mean size makes a unit large.
LARGE = 4


# --- targets ---


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, null last, have the weights in turn. The
    total is shared by weight; a target stops at ``most`` times its source's
    size and the excess is shared again. Each step needs only two sums, and
    the targets of a step are a function of those.
    """
    keyed = sizes.withColumns({"all": F.lit(1), "last": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    ranked = row_numbers(keyed, ["all"], ["last", "name"], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(
        ranked.select(
            "source", "source_size", F.get(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")).alias("w")
        ),
        "sources",
    )
    roof = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate = None  # words per weight of the sources that are not capped
    while True:
        if rate is None:
            capped = F.lit(False)
        else:
            capped = F.col("w") * rate >= roof
        fixed, open_weight = ranked.agg(
            F.sum(F.when(capped, roof)), F.sum(F.when(~capped, F.col("w")))
        ).first()
        if not open_weight:
            return ranked.select("source", "source_size", roof.alias("target"))
        new = max(0.0, float(total) - (fixed or 0.0)) / open_weight
        if rate is not None and new <= rate:
            target = F.when(F.col("w") * rate >= roof, roof).otherwise(F.col("w") * rate)
            return ranked.select("source", "source_size", target.alias("target"))
        rate = new


# --- the cube method ---


def _choose(up: float, down: float, draw: float) -> float:
    """A signed step: up or down with the odds that leave the expectation as it is."""
    return up if draw * (up + down) < down else -down


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1.0 - 1e-9 else p


def _settle_large(p: np.ndarray, sizes: np.ndarray, draws) -> None:
    """Decide the units of ``LARGE`` times the mean size, in place, while all
    open smaller ones together make up for them.

    The smaller units move by ``w * (a + b * size)`` with ``w = p * (1 - p)``;
    ``a`` and ``b`` follow from the two sums that must stay. Where that cannot
    carry the large unit to 0 and to 1 in one step, the sum of documents is let
    go and they move by ``w * b * size``, so that the words stay. A large unit
    without open smaller ones stays open.
    """
    large = sizes >= LARGE * sizes.mean()
    for lead in np.flatnonzero(large & (p > 0) & (p < 1)):
        while 0.0 < p[lead] < 1.0:
            rest = np.flatnonzero(~large & (p > 0) & (p < 1))
            if not len(rest):
                break
            q, s = p[rest], sizes[rest]
            w = q * (1.0 - q)
            s0, s1, s2 = w.sum(), (w * s).sum(), (w * s * s).sum()
            det = s0 * s2 - s1 * s1
            ways = [w * s * sizes[lead] / s2]
            if det > 1e-9 * s0 * s2:
                ways.insert(0, w * ((s2 - s1 * sizes[lead]) + (s0 * sizes[lead] - s1) * s) / det)
            for v in ways:
                room, load = np.where(v > 0, q, 1.0 - q), np.maximum(np.abs(v), 1e-300)
                up = min(1.0 - p[lead], (room / load).min())
                down = min(p[lead], ((1.0 - room) / load).min())
                if up == 1.0 - p[lead] and down == p[lead]:
                    break
            t = _choose(up, down, next(draws))
            p[lead] = _snap(p[lead] + t)
            q = q - t * v
            p[rest] = np.where(q < 1e-9, 0.0, np.where(q > 1.0 - 1e-9, 1.0, q))


def flight(p: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase: all but at most two are 0 or 1,
    the sum of ``p * sizes`` is what it was, and so is the sum of ``p`` unless a
    large unit needed it.

    Large units go first, against all smaller ones together. Then three
    undecided units at a time: the null vector of their 2 x 3 matrix (ones and
    sizes) is a direction in which both sums stay. A step goes as far as the
    unit cube allows, forward with the odds (way back) : (way forward), so that
    the expectation of every probability is what it was, whatever the size. A
    step decides a unit at least and takes one of ``draws`` (uniform in 0 to
    1, independent), so as many as units are enough.
    """
    left = iter(np.asarray(draws).tolist())
    q = p.astype(float)
    _settle_large(q, sizes.astype(float), left)
    p = q.tolist()
    size = sizes.astype(float).tolist()
    active: list[int] = []
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)  # equal sizes: move mass between two
            moving = [(p[i], v) for i, v in zip(active, u, strict=True) if v]
            up = min((1.0 - x) / v if v > 0 else x / -v for x, v in moving)
            down = min(x / v if v > 0 else (1.0 - x) / -v for x, v in moving)
            t = _choose(up, down, next(left))
            for i, v in zip(active, u, strict=True):
                p[i] = _snap(p[i] + t * v)
            active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.array(p)


def landing(p: np.ndarray, sizes: np.ndarray, draw: float) -> np.ndarray:
    """Decide the last units, at most ``LANDING_UNITS``.

    Of all roundings those qualify whose words are within half a mean document of
    the words expected (or the nearest one, if none is), a document too many or too few
    counting as a few words; among them one is drawn by the odds of independent
    draws with the given probabilities.
    """
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        words = np.abs(choices @ sizes[left] - (p[left] * sizes[left]).sum())
        docs = np.abs(choices.sum(axis=1) - p[left].sum())
        cost = words + 0.02 * sizes[left].mean() * docs
        near = cost <= max(cost.min(), 0.5 * sizes[left].mean())
        odds = np.cumsum(np.where(near, np.where(choices > 0, p[left], 1.0 - p[left]).prod(axis=1), 0.0))
        p[left] = choices[np.searchsorted(odds, draw * odds[-1], side="right")]
    return p


def settle(p: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight, with the last units left as they are to land with, then landing."""
    order = np.argsort(sizes < LARGE * sizes.mean(), kind="stable")  # large units fly
    p, sizes = p[order], sizes[order]
    fly = max(0, len(p) - (LANDING_UNITS - 2))
    if fly:
        p[:fly] = flight(p[:fly], sizes[:fly], draws[:fly])
    out = np.empty_like(p)
    out[order] = landing(p, sizes, draws[-1])
    return out


def cube_rounds(units: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """``source, unit, sub, taken`` (0 or 1) for ``source, unit, sub, size, p``.

    A block holds about ``block_rows`` units of one source, chosen by hash, so
    a hot source is many blocks; each round leaves at most two undecided units
    per block. ``(unit, sub)`` must be unique within a source.
    """
    decided = []
    todo = units
    schema = "source string, unit bigint, sub bigint, size bigint, p double"
    level = 0
    while True:
        counts = todo.groupBy("source").agg(F.count("*").alias("n"))
        blocks = counts.select(
            F.col("source").alias("s"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")
        )
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        last = most == 1
        if last:
            todo = todo.withColumn("block", F.lit(0).cast("long"))
        else:
            todo = todo.join(blocks, F.col("source").eqNullSafe(F.col("s"))).select(
                *units.columns, F.pmod(F.xxhash64("unit", "sub", F.lit(level)), F.col("blocks")).alias("block")
            )

        def run(block: pa.Table) -> pa.Table:
            t = block.sort_by([("unit", "ascending"), ("sub", "ascending")])
            sizes = t.column("size").to_numpy()
            # A stream of the block's own: units are hashes, and a block has them in one order.
            own = np.bitwise_xor.reduce(t.column("unit").to_numpy().astype(np.uint64))
            draws = np.random.default_rng([level, len(sizes), int(own)]).random(len(sizes) + 1)
            p = (settle if last else flight)(t.column("p").to_numpy(), sizes, draws)
            return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).drop_columns(["block"])

        moved = stored(todo.groupBy("source", "block").applyInArrow(run, schema), "cube")
        if last:
            decided.append(moved)
            break
        decided.append(moved.where("p = 0 OR p = 1"))
        todo = moved.where("p > 0 AND p < 1")
        level += 1
    out = decided[0] if decided else units
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.selectExpr("source", "unit", "sub", "CAST(p AS BIGINT) AS taken")


# --- the operator ---


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, most: int = MAX_REPEATS, block_rows: int = 2_000,
) -> DataFrame:
    """Per row: ``unit, doc_id, source, size, source_size, target, copies``.

    ``copies`` is how often the document is taken, ``copies * size`` its words
    in the mix. ``unit`` names the row: a hash of all its columns.

    * rows equal in every column share one unit and are taken alike
    * null source: a source of its own, the last one; null text: size 0
    * documents without words are never taken more than the ratio says, and
      weigh nothing; if no document has a word, nothing is taken
    * empty table: empty result; further columns only enter the unit's hash
    """
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        row_hash(docs).alias("unit"), F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"),
        word_count(text_col).alias("size"),
    )
    rows = stored(rows.withColumn("sub", F.xxhash64("doc_id", "size")), "sizes")
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most
    ).withColumnRenamed("source", "s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = stored(targets.withColumn("ratio", F.least(ratio, F.lit(float(most)))), "targets")
    # A weight per row, a unit per distinct row: both keys are narrow.
    units = rows.groupBy("source", "unit", "sub").agg(F.sum("size").alias("size"))
    joined = units.join(targets, F.col("source").eqNullSafe(F.col("s")))
    base = F.floor("ratio")
    open_units = joined.select(
        "source", "unit", "sub", "size", (F.col("ratio") - base).alias("p")
    ).where("p > 0 AND size > 0")
    taken = cube_rounds(stored(open_units, "units"), block_rows).select(
        F.col("unit").alias("u"), F.col("sub").alias("v"), "taken"
    )
    full = rows.join(targets, F.col("source").eqNullSafe(F.col("s")))
    return full.join(taken, (F.col("unit") == F.col("u")) & (F.col("sub") == F.col("v")), "left").select(
        "unit", "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, base.cast("long") + F.coalesce("taken", F.lit(0).cast("long")))
        .otherwise(F.round(F.col("ratio")).cast("long")).alias("copies"),
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: every row as often as it is taken, same columns."""
    decided = mix(docs, id_col, text_col, source_col, **options).groupBy("unit", "doc_id").agg(
        F.max("copies").alias("copies")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(docs).alias("h"),
        F.col(f"`{id_col}`").alias("id"),
    )
    found = rows.join(decided, (F.col("h") == F.col("unit")) & F.col("id").eqNullSafe(F.col("doc_id")))
    return found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
