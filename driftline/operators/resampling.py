"""Grouped bootstrap, dealt out by label, resample range and block of groups.

The published draws come from one generator per label, whose stream serves the
resamples one after another. The state at the start of each range of resamples
is found once per label; then every (range, block of groups) is a task of its
own that continues the stream from there and weighs the totals of its block.
A task holds one block of totals and one block of draws, however many groups,
resamples or labels there are.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordered import cut_lineage, running_totals

# The pre-registered resampling.
BOOTSTRAP_RESAMPLES = 2000
CI_LEVEL = 0.95
METRIC_SALT = "AS-037"
# Draws held at a time, draws of one task, groups of one block.
DRAW_BLOCK, TASK_DRAWS, GROUP_BLOCK = 1_000_000, 20_000_000, 50_000


def bootstrap_seed(label: str, salt: str = METRIC_SALT) -> int:
    return int(hashlib.sha256(f"{salt}:{label}".encode()).hexdigest()[:16], 16)


def label_stream(label: str, salt: str = METRIC_SALT) -> np.random.RandomState:
    """The stream of the standard library's generator, continued by numpy."""
    state = random.Random(bootstrap_seed(label, salt)).getstate()[1]
    stream = np.random.RandomState()
    stream.set_state(("MT19937", np.array(state[:-1], dtype=np.uint32), state[-1]))
    return stream


def _range_states(salt: str, resamples: int, task_draws: int):
    """The stream's state at the start of each range of a label's resamples."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                stream, n = label_stream(row.label, salt), int(row.n)
                size = max(1, min(resamples, task_draws // n))
                for start in range(0, resamples, size):
                    keys, place = stream.get_state()[1:3]
                    own = min(size, resamples - start)
                    yield pd.DataFrame(
                        {"label": [row.label], "n": [n], "start": [start], "size": [own], "state": [keys.tobytes()], "place": [place]}
                    )
                    left = own * n if start + own < resamples else 0
                    while left:
                        step = min(left, DRAW_BLOCK)
                        stream.random_sample(step)
                        left -= step

    return run


def multiplicities(stream: np.random.RandomState, n: int, resamples: int, low: int, high: int):
    """(first resample, counts of the groups low..high-1) in bounded blocks."""
    block = max(1, DRAW_BLOCK // n)
    for start in range(0, resamples, block):
        own = min(block, resamples - start)
        counts = np.zeros(own * (high - low), dtype=np.int64)
        for done in range(0, own * n, DRAW_BLOCK):
            draws = min(DRAW_BLOCK, own * n - done)
            picked = np.floor(stream.random_sample(draws) * n).astype(np.int64)
            of = (done + np.arange(draws)) // n
            here = (picked >= low) & (picked < high)
            counts += np.bincount(of[here] * (high - low) + picked[here] - low, minlength=len(counts))
        yield start, counts.reshape(own, high - low)


def _weighted_totals(batches):
    for batch in batches:
        for row in batch.itertuples(index=False):
            stream = np.random.RandomState()
            stream.set_state(("MT19937", np.frombuffer(row.state, dtype=np.uint32), int(row.place)))
            totals = np.stack([np.asarray(row.numerators, dtype=float), np.asarray(row.denominators, dtype=float)], axis=1)
            low = int(row.low)
            for start, counts in multiplicities(stream, int(row.n), int(row.size), low, low + len(totals)):
                sums = counts @ totals
                yield pd.DataFrame(
                    {"label": row.label, "resample": int(row.start) + start + np.arange(len(sums)), "n": sums[:, 0], "d": sums[:, 1]}
                )


def resample_sums(
    parts: DataFrame, resamples: int = BOOTSTRAP_RESAMPLES, salt: str = METRIC_SALT,
    task_draws: int = TASK_DRAWS, group_block: int = GROUP_BLOCK,
) -> DataFrame:
    """``label, resample, n, d``: numerator and denominator of each resample.

    ``parts``: one row per ``label`` and ``grp`` with ``numerator`` and
    ``denominator``; a null counts as nothing.
    """
    placed = running_totals(
        parts.select("label", "grp", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("numerator", "denominator")]),
        ["label"], ["grp"], {"g": F.lit(1).cast("long")},
    )
    placed = placed.withColumn("low", F.col("g_before") - F.col("g_before") % group_block)
    rows = "array_sort(collect_list(struct(g_before, numerator, denominator)))"
    blocks = cut_lineage(
        placed.groupBy("label", "low").agg(F.max("g_total").alias("n"), F.expr(rows).alias("r")).selectExpr(
            "label", "low", "n", "transform(r, x -> x.numerator) AS numerators", "transform(r, x -> x.denominator) AS denominators"
        )
    )
    parallel = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = blocks.where("low = 0").select("label", "n").repartition(parallel, "label").mapInPandas(
        _range_states(salt, resamples, task_draws), "label string, n long, start long, size long, state binary, place int"
    )
    tasks = states.join(blocks.drop("n"), "label").repartition(parallel, "label", "start", "low")
    sums = tasks.mapInPandas(_weighted_totals, "label string, resample long, n double, d double")
    return sums.groupBy("label", "resample").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def group_bootstrap(
    parts: DataFrame, resamples: int = BOOTSTRAP_RESAMPLES, level: float = CI_LEVEL, salt: str = METRIC_SALT, **sizes
) -> DataFrame:
    """``label, point, lower, upper``: percentile intervals of ratios,
    resampling whole groups. Resamples without weight are left out.

    ``parts`` has the totals of each group, so the resamples touch totals, not
    rows. The interval's ends are order statistics of the at most
    ``resamples`` values of a label.
    """
    parts = cut_lineage(parts)
    alpha = (1 - level) / 2
    values = resample_sums(parts, resamples, salt, **sizes).where("d <> 0").groupBy("label").agg(
        F.array_sort(F.expr("collect_list(n / d)")).alias("v")
    )
    ci = values.selectExpr(
        "label",
        f"v[CAST(greatest(0, floor({alpha!r}D * size(v))) AS INT)] AS lower",
        f"v[CAST(least(size(v) - 1, ceil({1 - alpha!r}D * size(v)) - 1) AS INT)] AS upper",
    )
    points = parts.groupBy("label").agg(F.expr("sum(numerator) / nullif(sum(denominator), 0D)").alias("point"))
    return points.join(ci, "label", "left")
