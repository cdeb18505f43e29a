"""Evidence of a confirmation run as one job over all fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import decisions as D
from driftline.operators import samples as V
from driftline.operators.ordered import cut_lineage

DECIDING = "new fields"


@dataclass
class Confirmation:
    """``traces`` are the new ones with ``is_trigger``, stored once for all parts."""

    traces: DataFrame
    decisions: DataFrame
    leave_one_out: DataFrame
    sample: DataFrame


def scoped(traces: DataFrame, fields: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Every trace under each ``scope`` it counts in, at most four.

    New traces: all (the deciding scope), the trigger objects with all controls,
    their field's search class, and pooled with the earlier ones if ``prior`` is given.
    """
    key = ["field_id", "designation", "role", "rate_eligible", "baseline_eligible", "proximity_group", "recovered"]
    new = traces.join(fields.select("field_id", "search_class"), "field_id", "left").selectExpr(
        *key,
        f"array_compact(array('{DECIDING}', if(is_trigger OR proximity_group = 'control', 'trigger objects', NULL),"
        f" concat('search class ', search_class){', ' + repr('pooled') if prior is not None else ''})) AS scopes",
    )
    if prior is not None:
        new = new.unionByName(prior.selectExpr(*key, "array('earlier fields', 'pooled') AS scopes"))
    return new.select(*key, F.explode("scopes").alias("scope"))


def confirmation(
    traces: DataFrame, triggers: DataFrame, fields: DataFrame, prior: DataFrame | None = None
) -> Confirmation:
    """The zone/control decision on new fields with everything that goes along.

    ``traces``: ``field_id, designation, role, rate_eligible, baseline_eligible,
    proximity_group, recovered``; ``triggers``: ``field_id, designation``;
    ``fields``: one row per field, ``field_id, star, search_class``.

    All scopes are one aggregate, first per field, so no scope reads the traces
    again. Only the deciding scope is classified; the others describe. A scope
    without an eligible target in zone or control has no row; a field without
    a search counts in the scopes of all fields.
    """
    stored = cut_lineage(V.trigger_members(traces, triggers))
    contrast = D.zone_contrast(scoped(stored, fields, prior), ["scope"])
    deciding = F.col("scope") == DECIDING
    decisions = contrast.withColumns(
        {"deciding": deciding, "classification": F.when(deciding, F.col("classification"))}
    )
    return Confirmation(
        stored,
        decisions,
        D.leave_one_out(stored, fields.select("field_id", "star")),
        V.confirmation_sample(stored),
    )
