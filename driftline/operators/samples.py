"""Samples of an evidence run for looking at, populations and field names.

A sample is a set of rules over one table: label, SQL condition, quota. All
rules of a sample are one pass, and a row may be picked under several labels.
Order within a label is by hash, so a sample depends on no feature and no run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.classify import class_separations
from driftline.operators.guards import require
from driftline.operators.sampling import hash_key

# Salt of the hash order, then label, condition and quota.
BRIGHT_STAR_SALT = "AS-032"
BRIGHT_STAR = {
    "near_unknown": ("status = 'built' AND identification = 'unknown' AND separation < 600D", 6),
    "control_unknown": ("status = 'built' AND identification = 'unknown' AND bin = 6", 2),
    "known": ("status = 'built' AND identification = 'known'", 2),
}
CLASS_SALT = "AS-034"
CLASS_KNOWN = {"known_near": ("least(sep_0, sep_1, sep_2, sep_3) < 120D", 12)}
CLASS_UNKNOWN = {
    "unknown_near_6-8": ("sep_2 < 60D", 3),
    "unknown_near_8-10": ("sep_3 < 60D", 3),
    "unknown_near_10-11": ("sep_4 < 60D", 3),
    "unknown_background": ("coalesce(nearest_separation >= 240D, true)", 4),
}
RECOVERY_SALT = "AS-035"
_NEAR = "least({}) < 120D".format(", ".join(class_separations([f"sep_{i}" for i in range(5)])[:3]))
RECOVERY = {
    "near_recovered": (f"{_NEAR} AND recovered", 8),
    "near_lost": (f"{_NEAR} AND NOT recovered", 8),
    "control_recovered": ("proximity_group = 'control' AND recovered", 2),
    "control_lost": ("proximity_group = 'control' AND NOT recovered", 2),
}
RECOVERY_REVISITS = ("288181", "408599")
CONFIRMATION_SALT = "AS-036"
CONFIRMATION = {
    "zone_recovered": ("proximity_group = 'zone' AND recovered", 6),
    "zone_lost": ("proximity_group = 'zone' AND NOT recovered", 6),
    "control_recovered": ("proximity_group = 'control' AND recovered", 2),
    "control_lost": ("proximity_group = 'control' AND NOT recovered", 2),
}
SEALED_SALT = "AS-040"
SEALED_MISSED, SEALED_BACKGROUND = 12, 20
# Night, field, chip and quadrant at the end of a field's name.
FIELD_NAME = r"(\d{4}-\d{2}-\d{2})-(\d+)-c(\d+)-q(\d)$"


def quota_sample(
    df: DataFrame, rules: dict[str, tuple[str, int]], keys: list[str], salt: str, parts: list[str]
) -> DataFrame:
    """The first rows of every (``keys``, ``label``) in hash order; adds ``label``.

    A condition that is null does not hold. Each task keeps at most the
    largest quota of rows per group before the shuffle (the limit is a constant,
    so the rank is cut in every task), whatever a group's size. Rows that are
    alike in ``parts`` are taken in the order of their other columns.
    """
    names = list(df.columns)
    tags = ", ".join(f"if({cond}, named_struct('label', '{n}', '_quota', {q}), NULL)" for n, (cond, q) in rules.items())
    tagged = df.selectExpr("*", f"inline(array_compact(array({tags})))")
    tagged = tagged.withColumns({"_hash": F.expr(hash_key(salt, *parts)), "_rest": F.to_json(F.struct(*names))})
    order = Window.partitionBy(*keys, "label").orderBy("_hash", "_rest")
    most = max(q for _, q in rules.values())
    first = tagged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return first.where("_n <= _quota").select(*names, "label")


def bright_star_sample(tracklets: DataFrame) -> DataFrame:
    """Per field: unknown tracklets near the bright star and far from it, known ones.

    ``tracklets``: ``field_id, tracklet_id, status, identification, separation, bin``.
    """
    return quota_sample(tracklets, BRIGHT_STAR, ["field_id"], BRIGHT_STAR_SALT, ["field_id", "tracklet_id"])


def class_sample(known: DataFrame, unknown: DataFrame) -> DataFrame:
    """Known objects near a bright star, and unknown tracklets near a star of each
    class or away from all, over all fields: ``field_id, item_id, label``.

    Both: ``field_id, item_id, sep_0 .. sep_4, nearest_separation``.
    """
    parts = ["field_id", "item_id"]
    picked = [
        quota_sample(df, rules, [], CLASS_SALT, parts).select(*parts, "label")
        for df, rules in ((known, CLASS_KNOWN), (unknown, CLASS_UNKNOWN))
    ]
    return picked[0].unionByName(picked[1])


def recovery_sample(traces: DataFrame, revisits: tuple[str, ...] = RECOVERY_REVISITS) -> DataFrame:
    """Eligible targets near a star and in the control group by outcome, then the
    named ones of population R that are not among them, as ``revisit``.

    ``traces``: ``field_id, designation, population, rate_eligible,
    baseline_eligible, recovered, proximity_group, sep_0 .. sep_4``.
    """
    key = ["field_id", "designation"]
    picked = quota_sample(
        traces.where("rate_eligible AND baseline_eligible"), RECOVERY, [], RECOVERY_SALT, key
    ).select(*key, "label")
    named = traces.where((F.col("population") == "R") & F.col("designation").isin(*revisits))
    again = named.join(picked, key, "left_anti").select(*key, F.lit("revisit").alias("label"))
    return picked.unionByName(again)


def confirmation_sample(traces: DataFrame) -> DataFrame:
    """Eligible primary targets of zone and control by outcome."""
    rows = traces.where("role = 'primary' AND rate_eligible AND baseline_eligible")
    key = ["field_id", "designation"]
    return quota_sample(rows, CONFIRMATION, [], CONFIRMATION_SALT, key).select(*key, "label")


def sealed_sample(missed: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Positives outside the shortlist and background inside it.

    ``missed``: ``field_id, designation``; ``shortlist``: ``field_id, tracklet_id``.
    Result: ``field_id, item_id, label``.
    """
    tables = (
        (missed, "designation", "missed_positive", SEALED_MISSED),
        (shortlist, "tracklet_id", "shortlist_background", SEALED_BACKGROUND),
    )
    picked = [
        quota_sample(
            df.selectExpr("field_id", f"{item} AS item_id"), {label: ("true", quota)}, [], SEALED_SALT,
            ["field_id", "item_id"],
        )
        for df, item, label, quota in tables
    ]
    return picked[0].unionByName(picked[1])


def compact(tracklets: DataFrame, sample: DataFrame) -> DataFrame:
    """A report's tracklets without the ones nobody looks at: known ones and
    those of the sample stay.

    ``tracklets`` as for ``bright_star_sample``. Known rows do not take part in the join.
    """
    key = ["field_id", "tracklet_id"]
    known = F.col("identification").eqNullSafe("known")
    picked = sample.select(*key).distinct()
    return tracklets.where(known).unionByName(tracklets.where(~known).join(picked, key, "left_semi"))


def populations(parts: dict[str, DataFrame], origins: dict[str, str]) -> DataFrame:
    """Fields of several populations as one table, ``position`` giving the order
    of the populations; ``origins`` has the SQL text of where a field is from."""
    tables = [
        df.selectExpr(f"'{name}' AS population", f"{i} AS position", "field_id", f"{origins[name]} AS origin")
        for i, (name, df) in enumerate(parts.items())
    ]
    return reduce(DataFrame.unionByName, tables)


def trigger_members(traces: DataFrame, triggers: DataFrame) -> DataFrame:
    """Traces with ``is_trigger``: did the object's passage select its field?

    ``triggers``: ``field_id, designation``, any number of rows each. A null
    name is no trigger.
    """
    key = ["field_id", "designation"]
    hit = triggers.select(*key).distinct().withColumn("_hit", F.lit(True))
    return traces.join(hit, key, "left").withColumn("is_trigger", F.coalesce("_hit", F.lit(False))).drop("_hit")


def parse_field_names(df: DataFrame, field: str = "field_id") -> DataFrame:
    """Adds ``night, survey_field, ccd, quadrant`` from the end of a field's name.

    A name of another form, or none, stops the job: rows must not lose their
    independence group silently.
    """
    text = F.col(field)
    checked = require(df, text.rlike(FIELD_NAME), F.concat(F.lit("field name of another form: "), F.coalesce(text, F.lit("null"))))
    return checked.withColumns(
        {
            "night": F.regexp_extract(text, FIELD_NAME, 1),
            "survey_field": F.regexp_extract(text, FIELD_NAME, 2).cast("int"),
            "ccd": F.regexp_extract(text, FIELD_NAME, 3).cast("int"),
            "quadrant": F.regexp_extract(text, FIELD_NAME, 4).cast("int"),
        }
    )


def short_id(tracklet_id: str) -> str:
    """The part of a tracklet's name after its last dot (SQL)."""
    return f"substring_index({tracklet_id}, '.', -1)"
