"""Rankers over within-field percentiles: fixed, single-feature and fitted.

A percentile table is wide: ``field_id, tracklet_no, label, ...`` and one
column per feature (missing = 0).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.metrics import BACKGROUND, POSITIVE, hash_score
from driftline.operators.ordered import placed, split_by_size, stored, tie_totals
from driftline.operators.ranking import MISSING_PERCENTILE, long_features, oriented_percentiles

# The ranker family.
LOGISTIC_C_GRID = (0.01, 0.1, 1.0, 10.0)
CV_FOLDS = 5

KEY = ["field_id", "tracklet_no"]


def _percentiles_in_task(rows: DataFrame, features, carry: list[str]) -> DataFrame:
    """Percentiles of all features by sorts of each field in its task: the rows
    are shuffled once, and neither repeated per feature nor joined."""
    names = [n for n, _ in features]
    out = placed(rows.select(*KEY, *carry, *[(d * F.col(n).cast("double")).alias(f"_v_{n}") for n, d in features]), "field_id")
    for n in names:
        value = f"_v_{n}"
        counted = tie_totals(out, ["field_id"], value, {"_c": F.col(value).isNotNull().cast("long")})
        out = counted.withColumn(
            n,
            F.when(F.col(value).isNotNull(), (F.col("_c_below") + 0.5 * F.col("_c_tied")) / F.col("_c_total"))
            .otherwise(F.lit(MISSING_PERCENTILE)),
        ).drop(value, "_c_below", "_c_tied", "_c_total")
    return out.select(*KEY, *carry, *names)


def _percentiles_over_tasks(rows: DataFrame, features, carry: list[str]) -> DataFrame:
    """The same for fields of any size."""
    long = oriented_percentiles(long_features(rows, KEY, features), ["field_id"])
    wide = long.groupBy(*KEY).agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("feature") == n, F.col("percentile"))), F.lit(MISSING_PERCENTILE)
            ).alias(n)
            for n, _ in features
        ]
    )
    return rows.select(*KEY, *carry).join(wide, KEY)


def percentile_table(rows: DataFrame, features, carry: list[str], limit: int | None = None) -> DataFrame:
    """Oriented within-field percentiles, one column per feature, label-free.
    Stored, because every ranker reads it. Fields of more than ``limit`` rows
    are spread over several tasks."""
    small, large = split_by_size(rows, ["field_id"], limit)
    table = _percentiles_in_task(small, features, carry)
    if large is not None:
        table = table.unionByName(_percentiles_over_tasks(large, features, carry))
    return stored(table.dropna(subset=KEY), "percentiles")


def fixed_items(features, tracklet: str = "tracklet_id") -> list[str]:
    """Name and score SQL of the parameter-free rankers: hash order, each
    feature alone, and the unweighted mean of all."""
    names = [n for n, _ in features]
    items = [f"'B0', {hash_score('field_id', tracklet)}"]
    items += [f"'B1:{n}', {n}" for n in names]
    return [*items, f"'M1', ({' + '.join(names)}) / {len(names)}D"]


def stacked(table: DataFrame, features: list[str], items: list[str]) -> DataFrame:
    """Long scores: the row once per ranker of ``items``, without the features."""
    others = [c for c in table.columns if c not in features]
    return table.selectExpr(*others, f"stack({len(items)}, {', '.join(items)}) AS (ranker, score)")


def fixed_scores(table: DataFrame, features, tracklet: str = "tracklet_id") -> DataFrame:
    """Long scores of the parameter-free rankers."""
    return stacked(table, [n for n, _ in features], fixed_items(features, tracklet))


def frozen_scores(table: DataFrame, weights: dict[str, float], intercept: float, name: str) -> DataFrame:
    """intercept + sum of weight x percentile, added in the given order."""
    others = [c for c in table.columns if c not in weights]
    return table.selectExpr(*others, f"'{name}' AS ranker", f"{linear_sql(weights, intercept)} AS score")


def training_set(table: DataFrame) -> DataFrame:
    """Positive against background; each field has total weight 1."""
    rows = table.where(F.col("label").isin(POSITIVE, BACKGROUND))
    sizes = rows.groupBy("field_id").agg((1.0 / F.count("*")).alias("sample_weight"))
    return rows.join(sizes, "field_id").withColumn(
        "target", (F.col("label") == POSITIVE).cast("double")
    )


# --- logistic models: all penalties and folds in one scan per step ------------


def _row_sums(features: list[str], models: list[tuple[float, int | None]], weights: np.ndarray):
    """Per task and model: loss, gradient and upper half of the Hessian."""
    upper = np.triu_indices(len(features) + 1)

    def run(batches):
        sums = np.zeros((len(models), 1 + len(features) + 1 + len(upper[0])))
        for batch in batches:
            x = np.column_stack([*[batch[f].to_numpy(dtype=float) for f in features], np.ones(len(batch))])
            target, weight = batch["target"].to_numpy(dtype=float), batch["sample_weight"].to_numpy(dtype=float)
            fold = batch["fold"].to_numpy()
            for m, (_, out) in enumerate(models):
                use = slice(None) if out is None else fold != out
                xm, ym, wm = x[use], target[use], weight[use]
                z = xm @ weights[m]
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                loss = (wm * (np.logaddexp(0.0, z) - ym * z)).sum()
                hessian = (xm * (wm * p * (1.0 - p))[:, None]).T @ xm
                sums[m] += np.concatenate([[loss], xm.T @ (wm * (p - ym)), hessian[upper]])
        yield pd.DataFrame({"model": np.arange(len(models)), "sums": list(sums)})

    return run


def fit_models(
    training: DataFrame, features: list[str], models: list[tuple[float, int | None]],
    tolerance: float = 1e-9, max_steps: int = 60,
) -> list[tuple[dict[str, float], float]]:
    """(weights, intercept) of every model (c, fold left out or None).

    A model minimises 0.5 |w|^2 + c * sum(weight * loss) with an unpenalised
    intercept. Newton's method for all of them at once: a step is one scan of
    ``training`` (``target, sample_weight, fold`` and features), in which every
    task adds up losses, gradients and Hessians; a few numbers per model come
    to the driver. A step that does not lower the objective is halved.
    """
    size = len(features) + 1
    upper = np.triu_indices(size)
    weights = np.zeros((len(models), size))
    best, loss = weights.copy(), np.full(len(models), np.inf)
    step = np.zeros_like(weights)
    width = 1 + size + len(upper[0])
    rows = training.select(*[F.col(f).cast("double").alias(f) for f in features], "target", "sample_weight", "fold")
    for _ in range(max_steps):
        parts = rows.mapInPandas(_row_sums(features, models, weights), "model int, sums array<double>")
        total = parts.groupBy("model").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
        found = {r["model"]: np.array(r["sums"]) for r in total.collect()}
        open_models = False
        for m, (c, _) in enumerate(models):
            sums = found.get(m, np.zeros(width))
            slope = np.append(weights[m][:-1], 0.0) + c * sums[1 : 1 + size]
            value = 0.5 * (weights[m][:-1] ** 2).sum() + c * sums[0]
            if value > loss[m] + 1e-12 * abs(loss[m]):
                step[m] /= 2.0
                weights[m] = best[m] - step[m]
                open_models = True
                continue
            best[m], loss[m] = weights[m], value
            if np.abs(slope).max() <= tolerance * max(1.0, c):
                continue
            hessian = np.zeros((size, size))
            hessian[upper] = c * sums[1 + size :]
            hessian = hessian + np.triu(hessian, 1).T
            hessian[np.arange(size - 1), np.arange(size - 1)] += 1.0
            step[m] = np.linalg.lstsq(hessian, slope, rcond=None)[0]
            weights[m] = best[m] - step[m]
            open_models = True
        if not open_models:
            return [(dict(zip(features, map(float, w[:-1]), strict=True)), float(w[-1])) for w in best]
    raise RuntimeError("a logistic model did not converge")


def logistic_fit(training: DataFrame, features: list[str], c: float):
    """Weights and intercept of one model on all rows of ``training``."""
    return fit_models(training.withColumn("fold", F.lit(0)), features, [(c, None)])[0]


def linear_sql(weights: dict[str, float], intercept: float) -> str:
    """intercept + sum of weight x percentile, added in the given order."""
    score = f"{float(intercept)!r}D"
    for feature, weight in weights.items():
        score = f"({score} + {float(weight)!r}D * {feature})"
    return score


def cross_validated_items(
    table: DataFrame, features: list[str], folds: DataFrame, cs=LOGISTIC_C_GRID
) -> tuple[DataFrame, list[str]]:
    """(rows with ``fold``, name and score SQL of every penalty). ``folds``:
    ``grp, fold``. All models are fitted together; a row's score is that of
    the model that left its fold out."""
    rows = table.join(stored(folds, "folds"), "grp")
    models = [(c, fold) for c in cs for fold in range(CV_FOLDS)]
    training = training_set(rows).select(*features, "target", "sample_weight", "fold")
    fits = fit_models(stored(training, "training"), features, models)
    items = []
    for c in cs:
        cases = " ".join(
            f"WHEN {fold} THEN {linear_sql(*fit)}"
            for (own, fold), fit in zip(models, fits, strict=True) if own == c
        )
        items.append(f"'M2:C={c:g}', CASE fold {cases} END")
    return rows, items


def cross_validated(
    table: DataFrame, features: list[str], folds: DataFrame, cs=LOGISTIC_C_GRID
) -> DataFrame:
    """Out-of-fold linear scores of every penalty, long."""
    rows, items = cross_validated_items(table, features, folds, cs)
    return stacked(rows, features, items)


def compare_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per field: are scores and order of two rankings identical, and how far
    apart. ``a``, ``b``: ``field_id, tracklet_no, score, review_rank``."""
    right = b.select(*KEY, F.col("score").alias("_score"), F.col("review_rank").alias("_rank"))
    joined = a.select(*KEY, "score", "review_rank").join(right, KEY, "full_outer")
    return joined.groupBy("field_id").agg(
        F.count("*").alias("tracklets"),
        F.expr("bool_and(score <=> _score)").alias("scores_equal"),
        F.expr("bool_and(review_rank <=> _rank)").alias("order_equal"),
        F.expr("max(abs(score - _score))").alias("max_difference"),
        F.expr("count_if(score IS NULL OR _score IS NULL)").alias("unmatched"),
    )
