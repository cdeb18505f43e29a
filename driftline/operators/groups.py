"""Independence groups of quadrant-nights: links, components, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.guards import require
from driftline.operators.ordered import cut_lineage

# Link rule and the split each stage may use.
LINK_SAME_FIELD_DAYS = 3
DEVELOPMENT, VALIDATION = "development", "validation"
STAGE_SPLITS = {
    "feature_evaluation": DEVELOPMENT,
    "ranking_construction": DEVELOPMENT,
    "validation": VALIDATION,
}


def star_edges(nights: DataFrame, key: str, node: str = "field_id") -> DataFrame:
    """Edges that connect all nodes sharing a key value, through the value's
    smallest node. The pairs of a large group are never listed."""
    hub = nights.groupBy(key).agg(F.min(node).alias("a"))
    return nights.join(hub, key).where(F.col("a") != F.col(node)).select(
        "a", F.col(node).alias("b")
    )


def field_edges(nights: DataFrame) -> DataFrame:
    """Same sky field at most a few days apart: chaining neighbouring nights
    connects exactly what the pairwise rule connects. Each (field, night) is
    joined with the next days by an equi-join on the shifted day."""
    days = nights.groupBy("ztf_field", "night").agg(F.min("field_id").alias("hub"))
    days = days.withColumn("day", F.datediff(F.to_date("night"), F.to_date(F.lit("1970-01-01"))))
    later = days.selectExpr(
        "ztf_field", "hub AS a", f"explode(sequence(day + 1, day + {LINK_SAME_FIELD_DAYS})) AS day"
    )
    return later.join(days.select("ztf_field", "day", F.col("hub").alias("b")), ["ztf_field", "day"]).select("a", "b")


def link_edges(nights: DataFrame) -> DataFrame:
    """Edges whose components are those of the pairwise link rule: same
    night, shared star, same field within a few days.

    ``nights``: ``field_id, night, ztf_field, stars``.
    """
    stars = nights.select("field_id", F.explode("stars").alias("star"))
    same_field_night = nights.withColumn("_fn", F.struct("ztf_field", "night"))
    parts = [
        star_edges(nights, "night"),
        star_edges(stars, "star"),
        star_edges(same_field_night, "_fn"),
        field_edges(nights),
    ]
    return reduce(lambda x, y: x.unionByName(y), parts).distinct()


def link_reasons(nights: DataFrame) -> DataFrame:
    """Every linked pair with its reasons (a report; one row per pair and
    reason, as the reference report lists them)."""
    a = nights.selectExpr("field_id AS a", "night AS na", "ztf_field AS fa", "stars AS sa")
    b = nights.selectExpr("field_id AS b", "night AS nb", "ztf_field AS fb", "stars AS sb")
    same_night = a.join(b, (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))).select(
        "a", "b", F.lit("same night").alias("reason")
    )
    sa = a.select("a", F.explode("sa").alias("star"))
    sb = b.select("b", F.explode("sb").alias("star"))
    same_star = sa.join(sb, "star").where("a < b").groupBy("a", "b").agg(
        F.concat(F.lit("same star "), F.array_join(F.array_sort(F.collect_set("star")), ", ")).alias("reason")
    )
    gap = F.abs(F.datediff(F.to_date("na"), F.to_date("nb")))
    same_field = (
        a.join(b, (F.col("fa") == F.col("fb")) & (F.col("a") < F.col("b")))
        .withColumn("gap", gap)
        .where(f"na <> nb AND gap <= {LINK_SAME_FIELD_DAYS}")
        .selectExpr("a", "b", "concat('field ', fa, ' ', gap, ' d apart') AS reason")
    )
    return same_night.unionByName(same_star).unionByName(same_field)


def _to_roots(hooks: DataFrame) -> DataFrame:
    """``a, p`` with every chain of hooks shortened to its end (log n steps)."""
    hooks = cut_lineage(hooks)
    while True:
        onward = hooks.selectExpr("a AS via", "p AS next")
        jumped = cut_lineage(
            hooks.join(onward, F.col("p") == F.col("via")).selectExpr("a", "next AS p", "p <> next AS moved")
        )
        hooks = jumped.select("a", "p")
        if jumped.where("moved").isEmpty():
            return hooks


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node id of the component).

    Each round hooks every label to its smallest neighbouring label, follows
    the hooks to their roots, and replaces the edges by edges between roots.
    A label with a smaller neighbour never stays, so every component with
    edges left shrinks in every round: the rounds need no limit, a path of any
    order takes one, a star two. Each round is stored: the plan stays
    short and a lost executor costs at most one round.
    """
    graph = cut_lineage(
        edges.selectExpr("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b"))
        .where("a <> b")
        .distinct()
    )
    labels = nodes.selectExpr("node", "node AS component").distinct()
    while not graph.isEmpty():
        hooks = _to_roots(graph.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        labels = cut_lineage(
            labels.join(hooks, F.col("component") == F.col("a"), "left").selectExpr(
                "node", "coalesce(p, component) AS component"
            )
        )
        to = hooks.selectExpr("a AS c", "p AS q")
        graph = cut_lineage(
            graph.join(hooks.withColumnRenamed("a", "h"), F.col("a") == F.col("h"))
            .selectExpr("p AS a", "b")
            .join(to, F.col("b") == F.col("c"))
            .selectExpr("a", "q AS b")
            .where("a <> b")
            .distinct()
        )
    return labels


def independence_groups(nights: DataFrame) -> DataFrame:
    """Adds ``grp`` = ``G-<smallest member>``."""
    found = connected_components(
        nights.select(F.col("field_id").alias("node")), link_edges(nights)
    )
    groups = found.selectExpr("node AS field_id", "concat('G-', component) AS grp")
    return nights.join(groups, "field_id")


def assign_splits(grouped: DataFrame, explored: list[str]) -> DataFrame:
    """A group with any explored population is development, else validation."""
    names = ", ".join(f"'{p}'" for p in explored)
    seen = grouped.groupBy("grp").agg(F.expr(f"bool_or(population IN ({names}))").alias("_dev"))
    return grouped.join(seen, "grp").withColumn(
        "split", F.when(F.col("_dev"), F.lit(DEVELOPMENT)).otherwise(F.lit(VALIDATION))
    ).drop("_dev")


def require_split(rows: DataFrame, manifest: DataFrame, stage: str) -> DataFrame:
    """Rows of a stage; a row of another split or an unknown field aborts."""
    if stage not in STAGE_SPLITS:
        raise ValueError(f"unknown stage {stage!r}")
    splits = manifest.select("field_id", F.col("split").alias("_split"))
    joined = rows.join(splits, "field_id", "left")
    message = F.concat(
        F.col("field_id").cast("string"), F.lit(" is "),
        F.coalesce("_split", F.lit("not in the manifest")), F.lit(f"; stage {stage} may not use it"),
    )
    return require(joined, F.col("_split") == STAGE_SPLITS[stage], message).drop("_split")


def split_digest(manifest: DataFrame) -> DataFrame:
    """Digest of each split's field ids (sorted, one per line).

    A digest of a list is one value over the whole list: only the short ids
    of a manifest are gathered, never rows of data.
    """
    ids = manifest.groupBy("split").agg(F.array_sort(F.collect_set("field_id")).alias("ids"))
    return ids.select("split", F.sha2(F.array_join("ids", "\n"), 256).alias("digest"))


def cross_split_designations(traces: DataFrame) -> DataFrame:
    """Objects that are targets in both splits."""
    dev = traces.where(F.col("split") == DEVELOPMENT).select("designation")
    return dev.intersect(traces.where(F.col("split") == VALIDATION).select("designation"))


def fold_of_groups(groups: DataFrame, folds: int = 5, salt: str = "AS-037") -> DataFrame:
    """Folds round-robin in hash order of the group id."""
    from driftline.operators.sampling import hash_order

    ordered = hash_order(
        groups.select("grp").distinct().withColumn("_all", F.lit(1)), ["_all"], salt, ["grp"]
    )
    return ordered.selectExpr("grp", f"CAST((position - 1) % {folds} AS INT) AS fold")


def manifest(nights: DataFrame, explored: list[str]) -> DataFrame:
    """Quadrant-nights with group and split."""
    return assign_splits(independence_groups(nights), explored)
