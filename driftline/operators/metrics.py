"""Background-rank metrics of scored, labelled tracklets.

A scored table has ``field_id, grp, night, tracklet_no`` (input order),
``designation, label, score`` and, for several rankers or features at once, a
``ranker`` column that is simply one more key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.ordered import (
    average_ranks,
    first_per_group,
    placed,
    quantiles,
    running_totals,
    split_by_size,
    stored,
    tie_totals,
)
from driftline.operators.resampling import (  # noqa: F401
    BOOTSTRAP_RESAMPLES,
    CI_LEVEL,
    METRIC_SALT,
    bootstrap_seed,
    group_bootstrap,
)

POSITIVE, AUXILIARY, BACKGROUND, NOT_RANKED = "positive", "auxiliary", "background", "not_ranked"

# The pre-registered metric and decision parameters.
PRIMARY_FRACTION = 0.05
SECONDARY_FRACTIONS = (0.01, 0.02, 0.10, 0.20)
SECONDARY_BUDGETS = (10, 25, 50)


def oriented_score(value: str, direction: int) -> str:
    """Higher is reviewed earlier; a missing value ranks after every other."""
    return f"coalesce({direction} * {value}, CAST('-Infinity' AS DOUBLE))"


def hash_score(field: str, tracklet: str, salt: str = METRIC_SALT) -> str:
    """A feature-independent order in [0, 1)."""
    digest = f"sha2(concat('{salt}:', {field}, ':', {tracklet}), 256)"
    return f"(CAST(conv(substring({digest}, 1, 15), 16, 10) AS DOUBLE) / {16.0**15!r}D)"


def label_of(status: str, identification: str, best: str, eligible: str) -> str:
    """Label of a tracklet. ``eligible``: the best match is an eligible
    target of the field. An unidentified built tracklet is an error."""
    return (
        f"CASE WHEN {status} <> 'built' THEN '{NOT_RANKED}'"
        f" WHEN {identification} IS NULL THEN raise_error('unidentified tracklet: a failed"
        " lookup is never unknown')"
        f" WHEN {identification} = 'unknown' THEN '{BACKGROUND}'"
        f" WHEN {identification} = 'known' AND {best} IS NOT NULL AND {eligible} THEN '{POSITIVE}'"
        f" WHEN {identification} IN ('known', 'ambiguous') THEN '{AUXILIARY}'"
        f" ELSE raise_error(concat('unexpected identification status ', {identification})) END"
    )


def best_positives(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The best-scored positive tracklet of each object of a field; equal
    scores keep the first in input order."""
    positives = scored.where(F.col("label") == POSITIVE)
    return first_per_group(
        positives, [*keys, "designation"], [-F.col("score"), F.col("tracklet_no")]
    )


def background_ranks(scored: DataFrame, keys: list[str], chosen: DataFrame) -> DataFrame:
    """``q`` and ``rank`` of the chosen rows against their field's background.

    q = share of background scored above, ties half; 0 without background.
    Scores are counted per distinct value first, so ties cost one row.
    """
    counts = (
        scored.select(*keys, "score", (F.col("label") == BACKGROUND).cast("long").alias("_bg"))
        .groupBy(*keys, "score")
        .agg(F.sum("_bg").alias("_bg"))
    )
    above = running_totals(counts, keys, [F.col("score").desc()], {"bg": F.col("_bg")})
    weight = "(bg_before + 0.5D * _bg)"
    ranks = above.selectExpr(
        *keys,
        "score",
        f"if(bg_total = 0, 0D, {weight} / bg_total) AS q",
        f"1 + {weight} AS rank",
    )
    return chosen.join(ranks, [*keys, "score"])


def object_weights(positives: DataFrame, keys: list[str]) -> DataFrame:
    """Weight 1 per object and night, split over its copies."""
    copies = positives.groupBy(*keys, "designation", "night").agg(
        (1.0 / F.count("*")).alias("weight")
    )
    return positives.join(copies, [*keys, "designation", "night"])


def _ranked_in_task(scored: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """Best positives with their ranks, by one sort of each group in its task.
    Background rows travel as flags; rows of other labels do not."""
    others = [c for c in scored.columns if c not in (*keys, "score")]
    slim = scored.where(F.col("label").isin(POSITIVE, BACKGROUND)).select(
        *keys, "score", F.when(F.col("label") == POSITIVE, F.struct(*others)).alias("_own"),
        *[F.expr(f"CAST(label = '{BACKGROUND}' AND coalesce({c}, false) AS BIGINT)").alias(f"_s_{n}") for n, c in kinds.items()],
    )
    totals = tie_totals(slim, keys, "score", {f"_{n}": F.col(f"_s_{n}") for n in kinds}).where("_own IS NOT NULL")
    above = {n: f"(_{n}_total - _{n}_below - 0.5D * _{n}_tied)" for n in kinds}
    rows = totals.selectExpr(
        *keys, "score", "_own.*", f"1 + {above['bg']} AS rank",
        *[f"if(_{n}_total = 0, 0D, {above[n]} / _{n}_total) AS {'q' if n == 'bg' else 'q_' + n}" for n in kinds],
    )
    return first_per_group(rows, [*keys, "designation"], [-F.col("score"), F.col("tracklet_no")])


def _ranked_over_tasks(scored: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """The same for groups of any size: scores counted per distinct value,
    running sums over ranges."""
    is_background = F.col("label") == BACKGROUND
    counts = scored.groupBy(*keys, "score").agg(
        *[F.count_if(is_background & F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in kinds.items()]
    )
    above = running_totals(counts, keys, [F.col("score").desc()], {f"s_{n}": F.col(n) for n in kinds})
    place = {n: f"(s_{n}_before + 0.5D * {n})" for n in kinds}
    ranks = above.selectExpr(
        *keys, "score", f"1 + {place['bg']} AS rank",
        *[f"if(s_{n}_total = 0, 0D, {place[n]} / s_{n}_total) AS {'q' if n == 'bg' else 'q_' + n}" for n in kinds],
    )
    return best_positives(scored, keys).join(ranks, [*keys, "score"])


def ranked_best(
    scored: DataFrame, keys: list[str], variants: dict[str, str] | None = None, limit: int | None = None
) -> DataFrame:
    """The best positive of every object with ``q, rank`` and, for each
    variant, ``q_<name>`` against the background rows that its SQL condition
    keeps. Stored.

    A group's rows are shuffled once and sorted in a task; only groups of more
    than ``limit`` rows are spread over several.
    """
    kinds = {"bg": "true", **(variants or {})}
    small, large = split_by_size(scored, keys, limit)
    best = _ranked_in_task(small, keys, kinds)
    if large is not None:
        best = best.unionByName(_ranked_over_tasks(large, keys, kinds).select(*best.columns))
    return stored(best.dropna(subset=[*keys, "score"]), "positives")


def _ranked_features_in_task(rows: DataFrame, features: list[tuple[str, int]], kinds: dict[str, str]) -> DataFrame:
    """``_ranked_in_task`` of all features of a field at once, in numpy: a row is
    shuffled once and not repeated for each feature. Background rows travel as
    scores and flags."""
    names = [n for n, _ in features]
    others = [c for c in rows.columns if c not in names and c not in ("field_id", "score")]
    flags = list(kinds)
    slim = placed(rows.where(F.col("label").isin(POSITIVE, BACKGROUND)), "field_id").select(
        "field_id", F.when(F.col("label") == POSITIVE, F.struct(*others)).alias("_own"),
        *[F.expr(f"CAST({oriented_score(n, d)} AS DOUBLE)").alias(f"_f{k}") for k, (n, d) in enumerate(features)],
        *[F.expr(f"label = '{BACKGROUND}' AND coalesce({c}, false)").alias(f"_s{k}") for k, c in enumerate(kinds.values())],
    )
    own = slim.schema["_own"].dataType
    numbers = ["score", "rank", *["q" if n == "bg" else f"q_{n}" for n in flags]]

    def judge(group: pa.Table) -> pa.Table:
        payload = group["_own"].combine_chunks()
        at = np.flatnonzero(payload.is_valid().to_numpy(zero_copy_only=False))
        positives = payload.take(pa.array(at))
        # Of an object's copies the best score counts, then the first in input order.
        objects = positives.field("designation").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        listed = pc.rank(positives.field("tracklet_no"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        behind = [group[f"_s{k}"].to_numpy() for k in range(len(flags))]
        taken, columns = [], [[] for _ in numbers]
        for f in range(len(names)):
            scores = group[f"_f{f}"].to_numpy()
            own_scores = scores[at]
            order = np.lexsort((listed, -own_scores, objects))
            first = np.ones(len(order), bool)
            first[1:] = objects[order[1:]] != objects[order[:-1]]
            best = order[first]
            taken.append(best)
            score = own_scores[best]
            columns[0].append(score)
            for k, keep in enumerate(behind):
                others_sorted = np.sort(scores[keep])
                upto, below = (np.searchsorted(others_sorted, score, side=side) for side in ("right", "left"))
                above = len(others_sorted) - upto + 0.5 * (upto - below)
                columns[2 + k].append(above / max(len(others_sorted), 1))
                if k == 0:
                    columns[1].append(1.0 + above)
        rows_ = pa.array(np.concatenate(taken))
        ranker = pa.array(np.repeat(np.arange(len(names)), [len(t) for t in taken]))
        field = group["field_id"].combine_chunks().take(pa.array(np.zeros(len(rows_), np.int64)))
        return pa.table(
            [pa.array(names, pa.string()).take(ranker), field, *positives.take(rows_).flatten(), *[pa.array(np.concatenate(c)) for c in columns]],
            ["ranker", "field_id", *others, *numbers],
        )

    schema = T.StructType([
        T.StructField("ranker", T.StringType()), T.StructField("field_id", slim.schema["field_id"].dataType),
        *[T.StructField(f.name, f.dataType) for f in own], *[T.StructField(n, T.DoubleType()) for n in numbers],
    ])
    return slim.groupBy("field_id").applyInArrow(judge, schema)


def ranked_features(
    rows: DataFrame, scored: DataFrame, features: list[tuple[str, int]], variants: dict[str, str] | None = None, limit: int | None = None
) -> DataFrame:
    """``ranked_best`` of a table whose features are the rankers. ``scored`` is the
    same table with a row per feature, of which only fields of more than ``limit``
    rows are read."""
    kinds = {"bg": "true", **(variants or {})}
    small, large = split_by_size(rows, ["field_id"], limit)
    best = _ranked_features_in_task(small, features, kinds)
    if large is not None:
        long = scored.join(F.broadcast(large.select("field_id").distinct()), "field_id", "left_semi")
        best = best.unionByName(_ranked_over_tasks(long, ["ranker", "field_id"], kinds).select(*best.columns))
    return stored(best.dropna(subset=["field_id", "score"]), "positives")


def rank_positives(scored: DataFrame, rankers: list[str] | None = None) -> DataFrame:
    """Every positive object of every field, ranked against its background."""
    rankers = rankers or []
    return stored(object_weights(ranked_best(scored, [*rankers, "field_id"]), rankers), "ranked")


# --- shares -----------------------------------------------------------------


def weighted_share(hit: str):
    """Share of weight with a hit; null when there is no weight."""
    return F.expr(f"sum(if({hit}, weight, 0D)) / nullif(sum(weight), 0D)")


def metric_columns() -> list:
    fractions = (PRIMARY_FRACTION, *SECONDARY_FRACTIONS)
    return [
        F.sum("weight").alias("objects"),
        F.count_distinct("field_id").alias("fields_with_positive"),
        F.expr("sum(weight * (1D - q)) / nullif(sum(weight), 0D)").alias("auc"),
        *[weighted_share(f"q <= {f!r}D").alias(f"recall_{f:g}".replace(".", "_")) for f in fractions],
        *[
            (weighted_share(f"q <= {f!r}D") / f).alias(f"enrichment_{f:g}".replace(".", "_"))
            for f in fractions
        ],
        *[weighted_share(f"rank <= {k}").alias(f"recall_k{k}") for k in SECONDARY_BUDGETS],
    ]


def recall_metrics(positives: DataFrame, keys: list[str]) -> DataFrame:
    return positives.groupBy(*keys).agg(*metric_columns())


def strata_metrics(positives: DataFrame, keys: list[str], strata: list[str]) -> DataFrame:
    """The same per value of every stratum column, in one pass."""
    pairs = ", ".join(f"'{s}', CAST({s} AS STRING)" for s in strata)
    long = positives.selectExpr(
        *keys, "field_id", "q", "rank", "weight", f"stack({len(strata)}, {pairs}) AS (key, value)"
    )
    return long.groupBy(*keys, "key", "value").agg(
        F.sum("weight").alias("objects"),
        F.expr("sum(weight * (1D - q)) / nullif(sum(weight), 0D)").alias("auc"),
        weighted_share(f"q <= {PRIMARY_FRACTION!r}D").alias("recall_5"),
    )


def weighted_median(positives: DataFrame, keys: list[str], value: str = "q") -> DataFrame:
    """Smallest value at which the running weight reaches half the total."""
    distinct = positives.groupBy(*keys, value).agg(F.sum("weight").alias("_w"))
    run = running_totals(distinct, keys, [value], {"w": F.col("_w")})
    reached = run.where("w_before + _w >= w_total / 2D - 1e-12D")
    agg = F.min(value).alias(f"median_{value}")
    return reached.groupBy(*keys).agg(agg) if keys else reached.agg(agg)


def missing_rates(long: DataFrame, keys: list[str]) -> DataFrame:
    """Missing share of each feature, over all rows and per label."""
    cube = long.selectExpr(*keys, "explode(array('all', label)) AS label", "value")
    return cube.groupBy(*keys, "label").agg(
        F.count("*").alias("ranked"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"),
    )


# --- group totals for the bootstrap -------------------------------------------


def ratio_parts(
    positives: DataFrame, label: str, statistics: dict[str, str], keys: list[str] | None = None
) -> DataFrame:
    """Group totals for ``group_bootstrap``. ``statistics`` maps a name to the
    SQL of the per-row numerator factor; ``label`` is a SQL prefix."""
    items = ", ".join(f"'{n}', CAST({s} AS DOUBLE)" for n, s in statistics.items())
    long = positives.selectExpr(
        "*", f"stack({len(statistics)}, {items}) AS (_stat, _hit)"
    )
    return long.groupBy(F.expr(f"concat({label}, _stat)").alias("label"), "grp").agg(
        F.sum(F.col("weight") * F.col("_hit")).alias("numerator"),
        F.sum("weight").alias("denominator"),
    )


def paired_difference_parts(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Group totals of recall(a) - recall(b) on the same objects."""
    other = b.select("field_id", "designation", F.col("q").alias("_q2"))
    f = PRIMARY_FRACTION
    both = a.join(other, ["field_id", "designation"])
    return both.groupBy(F.lit(label).alias("label"), "grp").agg(
        F.expr(f"sum(weight * (CAST(q <= {f!r}D AS INT) - CAST(_q2 <= {f!r}D AS INT)))").alias("numerator"),
        F.sum("weight").alias("denominator"),
    )


# --- correlation --------------------------------------------------------------


def spearman(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation over pairwise complete rows with average ranks; null
    below three rows or without spread."""
    complete = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(complete, keys, x, "_rx"), keys, y, "_ry")
    out = ranked.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.expr(
            "if(count(*) >= 3, covar_pop(_rx, _ry) / nullif(stddev_pop(_rx) * stddev_pop(_ry), 0D), NULL)"
        ).alias("rho"),
    )
    return out


def _feature_ranks(rows: DataFrame, keys: list[str], features: list[str], gaps: list[str]) -> DataFrame:
    """``_row``, keys and for every feature an array of its average ranks: the
    first among all present values, the others among the rows in which a
    feature of ``gaps`` is present too.

    One pass over the distinct values of all features: a running count of all
    rows and one of the rows that lack each gap feature; their difference is
    the running count of the others.
    """
    items = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    lacks = [f"CAST({g} IS NULL AS LONG) AS _lack_{g}" for g in gaps]
    long = rows.selectExpr("_row", *keys, *lacks, f"stack({len(features)}, {items}) AS (feature, value)").where(
        "value IS NOT NULL"
    )
    group = [*keys, "feature"]
    counts = long.groupBy(*group, "value").agg(
        F.count("*").alias("_n"), *[F.sum(f"_lack_{g}").alias(f"_n_{g}") for g in gaps]
    )
    run = running_totals(counts, group, ["value"], {"all": F.col("_n"), **{f"lack_{g}": F.col(f"_n_{g}") for g in gaps}})
    ranks = ["all_before + (_n + 1) / 2D"] + [
        f"all_before - lack_{g}_before + (_n - _n_{g} + 1) / 2D" for g in gaps
    ]
    placed = run.selectExpr(*group, "value", f"array({', '.join(ranks)}) AS ranks")
    return long.select("_row", *group, "value").join(placed, [*group, "value"]).groupBy("_row", *keys).agg(
        *[F.first(F.when(F.col("feature") == f, F.col("ranks")), ignorenulls=True).alias(f"_r_{f}") for f in features]
    )


def group_ranks(values: np.ndarray, present: np.ndarray, kinds: list[np.ndarray]) -> np.ndarray:
    """Average ranks (kind, row, feature) of the present values (row, feature): of
    each kind among the rows it keeps. Absent values have no meaning."""
    order = np.argsort(values, axis=0, kind="stable")
    ordered = np.take_along_axis(values, order, 0)
    at = np.broadcast_to(np.arange(len(values))[:, None], values.shape)
    new = np.ones(values.shape, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=0)
    ends = np.ones(values.shape, bool)
    ends[:-1] = new[1:]
    last = np.minimum.accumulate(np.where(ends, at, len(values))[::-1], axis=0)[::-1]
    out = np.empty((len(kinds), *values.shape))
    for ranks, kind in zip(out, kinds, strict=True):
        count = np.zeros((len(values) + 1, values.shape[1]))
        np.cumsum(np.take_along_axis(present & kind[:, None], order, 0), axis=0, out=count[1:])
        below, upto = np.take_along_axis(count, first, 0), np.take_along_axis(count, last + 1, 0)
        np.put_along_axis(ranks, order, below + (upto - below + 1.0) / 2.0, 0)
    return out


def _rho(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlations of the columns of two matrices; NaN without a spread."""
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    spread_ = np.sqrt(np.square(x).sum(axis=0))[:, None] * np.sqrt(np.square(y).sum(axis=0))
    return np.divide(x.T @ y, spread_, out=np.full(spread_.shape, np.nan), where=spread_ > 0.0)


def group_correlations(values: np.ndarray, present: np.ndarray, gaps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each pair of features and its rank correlation (feature, feature),
    pairwise complete, NaN where there is none. Only ``gaps`` have absent values."""
    size = values.shape[1]
    values = np.where(present, values, np.inf)
    for f in np.flatnonzero(np.isnan(values).any(axis=0)):
        # NaN is a value, above all others.
        values[:, f] = np.where(present[:, f], np.unique(values[:, f], return_inverse=True)[1], np.inf)
    ranks = group_ranks(values, present, [np.ones(len(values), bool), *[present[:, g] for g in gaps]])
    n = present.T.astype(np.int64) @ present.astype(np.int64)
    rho = np.full((size, size), np.nan)
    full = [f for f in range(size) if f not in gaps]
    if len(values):
        rho[np.ix_(full, full)] = _rho(ranks[0][:, full], ranks[0][:, full])
    for k, g in enumerate(gaps):
        own = present[:, g]
        if own.any():
            rho[g, full] = rho[full, g] = _rho(ranks[0][own][:, [g]], ranks[k + 1][own][:, full])[0]
        for j, h in enumerate(gaps[:k]):
            both = own & present[:, h]
            if both.any():
                rho[g, h] = rho[h, g] = _rho(ranks[j + 1][both][:, [g]], ranks[k + 1][both][:, [h]])[0, 0]
    return n, np.where(n >= 3, rho, np.nan)


def _correlations_in_task(rows: DataFrame, keys: list[str], features: list[str], gaps: list[str]) -> DataFrame:
    """``_pair_correlations`` of groups that fit one task: ranks and products in
    numpy; rows are shuffled once, and neither repeated nor joined."""
    slim = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    first, second = np.triu_indices(len(features), 1)
    holes = [features.index(g) for g in gaps]
    names = [pa.array([features[k] for k in ks], pa.string()) for ks in (first, second)]

    def judge(group: pa.Table) -> pa.Table:
        columns = [group[f].combine_chunks() for f in features]
        present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], axis=1)
        values = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(float)
        n, rho = (v[first, second] for v in group_correlations(values, present, holes))
        at = np.flatnonzero(n)
        own = group.select(keys).take(pa.array(np.zeros(len(at), np.int64)))
        found = [*[v.take(pa.array(at)) for v in names], pa.array(n[at]), pa.array(rho[at], from_pandas=True)]
        return pa.table([*own.columns, *found], [*keys, "a", "b", "n", "rho"])

    kinds = [("a", T.StringType()), ("b", T.StringType()), ("n", T.LongType()), ("rho", T.DoubleType())]
    schema = T.StructType([*[T.StructField(k, slim.schema[k].dataType) for k in keys], *[T.StructField(n, t) for n, t in kinds]])
    return placed(slim, *keys).groupBy(*keys).applyInArrow(judge, schema)


def _pair_correlations(
    rows: DataFrame, keys: list[str], features: list[str], gaps: list[str], limit: int | None = None
) -> DataFrame:
    """``a, b, n, rho`` of all pairs a < b, pairwise complete. Every feature is
    ranked once; groups of more than ``limit`` rows are ranked over several tasks
    and correlated by one aggregate of the rank arrays."""
    if keys:
        small, large = split_by_size(rows, keys, limit)
        found = _correlations_in_task(small, keys, features, gaps)
        return found if large is None else found.unionByName(_correlations_over_tasks(large, keys, features, gaps))
    return _correlations_over_tasks(rows, keys, features, gaps)


def _correlations_over_tasks(rows: DataFrame, keys: list[str], features: list[str], gaps: list[str]) -> DataFrame:
    """The same for groups of any size."""
    ranked = _feature_ranks(rows, keys, features, gaps)
    place = {f: gaps.index(f) + 1 if f in gaps else 0 for f in features}
    # Pairs are dealt inside the row and combined in the task: what is shuffled
    # is one row per pair and key. (An aggregate with columns for each pair
    # would be too large to compile.)
    items = [
        f"'{a}', '{b}', _r_{a}[{place[b]}], _r_{b}[{place[a]}]"
        for i, a in enumerate(features) for b in features[i + 1 :]
    ]
    pairs = ranked.selectExpr(*keys, f"stack({len(items)}, {', '.join(items)}) AS (a, b, x, y)")
    return pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "a", "b").agg(
        F.count("*").alias("n"),
        F.expr("if(count(*) >= 3, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0D), NULL)").alias("rho"),
    )


def spearman_matrices(wide: DataFrame, features: list[str], min_rows: int = 10) -> DataFrame:
    """Pooled correlation and the median over fields with enough rows."""
    names = ", ".join(f"'{a}', '{b}'" for i, a in enumerate(features) for b in features[i + 1 :])
    every = wide.sparkSession.range(1).selectExpr(f"stack({len(features) * (len(features) - 1) // 2}, {names}) AS (a, b)")
    rows = stored(wide.select("field_id", *features).withColumn("_row", F.monotonically_increasing_id()), "values")
    nulls = rows.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    gaps = [f for f in features if nulls[f]]
    found = _pair_correlations(rows, [], features, gaps).select("a", "b", F.col("rho").alias("pooled"))
    pooled = every.join(found, ["a", "b"], "left")
    fields = _pair_correlations(rows, ["field_id"], features, gaps)
    sizes = wide.groupBy("field_id").agg(F.count("*").alias("_all")).where(F.col("_all") >= min_rows)
    usable = fields.join(sizes, "field_id")
    per_field = quantiles(usable, ["a", "b"], "rho", {"field_median": 0.5}).drop("count")
    return pooled.join(per_field, ["a", "b"], "left")


# --- lists of interest --------------------------------------------------------


def missed_positives(positives: DataFrame, comparator: DataFrame) -> DataFrame:
    """Positives outside the primary fraction, with the comparator's q."""
    other = comparator.select("field_id", "designation", F.col("q").alias("comparator_q"))
    return positives.where(f"q > {PRIMARY_FRACTION!r}D").join(other, ["field_id", "designation"])


def disagreements(positives: DataFrame, comparator: DataFrame) -> DataFrame:
    """Objects in the top fraction of exactly one of two rankers."""
    other = comparator.select("field_id", "designation", F.col("q").alias("comparator_q"))
    f = f"{PRIMARY_FRACTION!r}D"
    both = positives.join(other, ["field_id", "designation"])
    return both.where(f"(q <= {f}) <> (comparator_q <= {f})").withColumn(
        "only", F.expr(f"if(q <= {f}, 'ranker', 'comparator')")
    )


def bottom_half(positives: DataFrame) -> DataFrame:
    return positives.where("q > 0.5D")


def weak_fields(positives: DataFrame, keys: list[str], min_positives: float = 3.0) -> DataFrame:
    """Fields with enough positives whose AUC is below one half."""
    per_field = positives.groupBy(*keys, "field_id").agg(
        F.sum("weight").alias("positives"),
        F.expr("sum(weight * (1D - q)) / sum(weight)").alias("auc"),
    )
    return per_field.where((F.col("positives") >= min_positives) & (F.col("auc") < 0.5))


def shortlist_background(scored: DataFrame) -> DataFrame:
    """Background tracklets inside their own field's primary fraction."""
    background = scored.where(F.col("label") == BACKGROUND)
    ranked = background_ranks(background, ["field_id"], background)
    return ranked.where(f"q <= {PRIMARY_FRACTION!r}D")


def end_to_end_recall(targets: DataFrame, positives: DataFrame) -> DataFrame:
    """Eligible targets whose object is in the top fraction, by group/role.

    ``targets``: ``field_id, designation, night, proximity_group, role``.
    """
    top = positives.where(f"q <= {PRIMARY_FRACTION!r}D").select("field_id", "designation")
    top = top.distinct().withColumn("_hit", F.lit(1.0))
    copies = targets.groupBy("designation", "night").agg((1.0 / F.count("*")).alias("weight"))
    rows = targets.join(copies, ["designation", "night"]).join(
        top, ["field_id", "designation"], "left"
    )
    return (
        rows.selectExpr(
            "explode(array('all', proximity_group, role)) AS members",
            "weight",
            "coalesce(_hit, 0D) AS hit",
        )
        .groupBy("members")
        .agg(
            F.sum("weight").alias("eligible_object_nights"),
            F.expr("sum(weight * hit)").alias("top_object_nights"),
            F.expr("sum(weight * hit) / nullif(sum(weight), 0D)").alias("recall"),
        )
    )


def positive_availability(traces: DataFrame) -> DataFrame:
    """Usable positives per split: objects, fields and strata.

    ``traces``: ``split, field_id, night, designation, role, proximity_group,
    rate_eligible, baseline_eligible, recovered``.
    """
    rows = traces.where("rate_eligible AND baseline_eligible AND recovered")
    return rows.groupBy("split").agg(
        F.count("*").alias("positive_tracklet_targets"),
        F.count_distinct("designation", "night").alias("positive_object_nights"),
        F.count_distinct("field_id").alias("fields_with_positive"),
        F.expr("count_if(proximity_group = 'zone')").alias("zone"),
        F.expr("count_if(proximity_group IN ('zone', 'outer'))").alias("zone_or_outer"),
        F.expr("count_if(role = 'marginal')").alias("marginal"),
    )


def reconcile(labelled: DataFrame, traced: DataFrame) -> DataFrame:
    """Objects labelled positive but not traced as recovered, and reverse."""
    keys = ["field_id", "designation"]
    a = labelled.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = traced.select(*keys).distinct().withColumn("_b", F.lit(True))
    return (
        a.join(b, keys, "full_outer")
        .where("_a IS NULL OR _b IS NULL")
        .selectExpr(*keys, "if(_b IS NULL, 'labelled_not_traced', 'traced_not_labelled') AS side")
    )


def compare_metrics(development: DataFrame, validation: DataFrame, keys: list[str]) -> DataFrame:
    """Metric by metric: development, validation and their difference. Both
    tables are long: keys, ``metric``, ``value``."""
    a = development.withColumnRenamed("value", "development")
    b = validation.withColumnRenamed("value", "validation")
    return a.join(b, [*keys, "metric"], "full_outer").withColumn(
        "difference", F.col("validation") - F.col("development")
    )
