"""Ordered value lists as small tables, and labels from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabularies of stored columns.
CHANNELS = [
    ("foundation", "Foundation & Family Trust"),
    ("regranting", "Regranting Ministry"),
    ("christian_business", "Christian Business"),
    ("denomination", "Denomination & Network Fund"),
    ("church", "Individual Church"),
    ("daf", "Donor-Advised Fund (DAF)"),
    ("major_donor", "Major Donor"),
]
STAGES = [(s, s.capitalize()) for s in ("discovery", "outreach", "proposal", "decision", "awarding", "stewardship")]
IMPORTANCE = [(1, "Nice to have"), (3, "Important"), (5, "Critical")]
DRAFT_KINDS = [("intro_email", "Intro Email"), ("call_prep", "Call Prep Notes")]
ORG_TYPES = [
    ("public_charity", "501(c)(3) Public Charity"),
    ("private_foundation", "501(c)(3) Private Foundation"),
    ("fiscally_sponsored", "Fiscally Sponsored"),
    ("church_religious_org", "Church / Religious Organization"),
    ("other", "Other"),
]
CRITERION_FIELDS = ("channel", "organization", "notes", "website", "contact_name", "contact_email", "name")


def dimension(spark: SparkSession, values: list[tuple[str, str]]) -> DataFrame:
    """(ord, value, label) of a fixed list."""
    return spark.createDataFrame([(i, v, label) for i, (v, label) in enumerate(values)], "ord int, value string, label string")


def with_label(df: DataFrame, dim: DataFrame, column: str, out: str) -> DataFrame:
    """The label of a value, or the value itself if the list lacks it."""
    d = dim.select(F.col("value").alias("_v"), F.col("label").alias("_l"))
    return df.join(F.broadcast(d), F.col(column) == F.col("_v"), "left").withColumn(out, F.coalesce("_l", column)).drop("_v", "_l")


def tier_label(tier: Column) -> Column:
    return F.when(tier == 1, "Tier 1 — Strong fit").when(tier == 2, "Tier 2 — Possible").otherwise("Tier 3 — Unlikely")


def fit_bucket(share: Column) -> Column:
    return F.when(share >= F.lit(0.7), "high").when(share >= F.lit(0.4), "medium").when(share.isNotNull(), "low")


def importance_label(weight: Column) -> Column:
    out = F.concat(F.lit("Weight "), weight.cast("string"))
    for value, label in IMPORTANCE:
        out = F.when(weight == value, label).otherwise(out)
    return out


def nearest_importance(weight: Column) -> Column:
    """The closest level; of two equally close ones the first."""
    levels = F.array(*[F.struct(F.abs(F.lit(v) - weight).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, (v, _) in enumerate(IMPORTANCE)])
    return F.array_min(levels)["v"]


def known_or(value: str | None, allowed: list[str], default: str | None = None) -> str | None:
    """A parameter if it is one of the allowed ones, else the default."""
    return value if value in allowed else default


def listed_or(c: Column, allowed: list[str], default: str | None = None) -> Column:
    """The same for a column."""
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def described(dim: DataFrame) -> DataFrame:
    """One row: a line '- value: label -- description' for each value of the list, in order."""
    line = F.concat(F.lit("- "), "value", F.lit(": "), "label", F.lit(" -- "), F.coalesce("description", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    return dim.agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
