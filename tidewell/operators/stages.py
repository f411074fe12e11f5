"""Records that move through ordered stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.dates import days_between
from tidewell.functions.numbers import share_of_max
from tidewell.operators.latest import latest_matching, latest_per_key


def days_in_stage(records: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """With ``days``: since the latest change if that led to the current stage, else since creation (the board's rule)."""
    last = latest_per_key(changes.select("id", "prospect_id", "to_stage", "created_at"), ["prospect_id"])
    last = last.select(F.col("prospect_id").alias("_pid"), F.col("to_stage").alias("_to"), F.col("created_at").alias("_at"))
    joined = records.join(last, F.col("id") == F.col("_pid"), "left")
    since = F.when(F.col("_to") == F.col("stage"), F.col("_at")).otherwise(F.col("created_at"))
    return joined.withColumn("days", days_between(since, as_of)).drop("_pid", "_to", "_at")


def days_since_entry(records: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """With ``days``: since the latest change into the current stage, whatever came later (the detail page's rule)."""
    moved = changes.select("id", "prospect_id", "to_stage", "created_at").join(
        records.select(F.col("id").alias("_pid"), F.col("stage").alias("_stage")), F.col("prospect_id") == F.col("_pid")
    )
    entry = latest_matching(moved, ["prospect_id"], F.col("to_stage") == F.col("_stage"))
    entry = entry.select(F.col("prospect_id").alias("_p"), F.col("created_at").alias("_at"))
    joined = records.join(entry, F.col("id") == F.col("_p"), "left")
    return joined.withColumn("days", days_between(F.coalesce("_at", "created_at"), as_of)).drop("_p", "_at")


def zero_filled(dim: DataFrame, agg: DataFrame, column: str, fill: dict) -> DataFrame:
    """Every value of the list, in its order column, with the group's aggregates or the fill values."""
    out = dim.join(agg, dim["value"] == agg[column], "left").drop(agg[column])
    return out.fillna(fill)


def stage_stats(records: DataFrame, changes: DataFrame, stages: DataFrame, as_of: Column) -> DataFrame:
    """For each stage of the list: records, mean days there, and what they may bring; rows in other stages count nowhere."""
    aged = days_in_stage(records, changes, as_of)
    agg = aged.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("days"), 4).alias("avg_days"), F.sum(F.coalesce("ask_amount", F.lit(0.0)).cast("decimal(18,2)")).cast("double").alias("potential"))
    return zero_filled(stages.select("ord", "value", "label"), agg, "stage", {"n": 0, "avg_days": 0.0, "potential": 0.0})


def stage_shares(records: DataFrame, stages: DataFrame) -> DataFrame:
    """For each stage of the list its potential and whole percent of the largest potential of any stage, listed or not."""
    agg = records.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("ask_amount", F.lit(0.0)).cast("decimal(18,2)")).cast("double").alias("potential"))
    most = agg.agg(F.max("potential").alias("most"))
    out = zero_filled(stages.select("ord", "value"), agg, "stage", {"n": 0, "potential": 0.0}).crossJoin(F.broadcast(most))  # one row
    return out.withColumn("share", share_of_max(F.col("potential"), F.coalesce("most", F.lit(0.0)))).drop("most")


def with_next_stage(records: DataFrame, stages: DataFrame) -> DataFrame:
    """With ``stage_ord`` (-1 for an unlisted stage) and ``next_stage``: an unlisted stage is followed by the first one."""
    first = Window.orderBy("ord")
    dim = stages.select(F.col("value").alias("_v"), F.col("ord").alias("_o"), F.lead("value").over(first).alias("_n"))
    head = stages.orderBy("ord").limit(1).select(F.col("value").alias("_first"))
    out = records.join(F.broadcast(dim), F.col("stage") == F.col("_v"), "left").crossJoin(F.broadcast(head))  # one row
    out = out.withColumn("stage_ord", F.coalesce("_o", F.lit(-1))).withColumn("next_stage", F.when(F.col("_v").isNull(), F.col("_first")).otherwise(F.col("_n")))
    return out.drop("_v", "_o", "_n", "_first")


def listed(records: DataFrame, wanted: str | None = None, channel: str | None = None) -> DataFrame:
    """Records whose name has the wanted text, without regard to case, and that are in the channel; either may be absent or empty."""
    from tidewell.functions.text import contains_ignoring_case

    if wanted and wanted.strip():
        records = records.where(contains_ignoring_case(F.col("name"), F.lit(wanted.strip())))
    return records.where(F.col("channel") == channel) if channel else records


def stuck_longest(aged: DataFrame, k: int = 3, least_days: float = 1.0) -> DataFrame:
    """The k records with the most days, of which those under ``least_days`` then drop out."""
    return aged.orderBy(F.col("days").desc(), "id").limit(k).where(F.col("days") >= least_days)


def priorities(records: DataFrame, health: Column, first: int = 10, k: int = 3) -> DataFrame:
    """Of the ``first`` records with the nearest dates, those that are stalled or due soon, k at most.

    The limit comes before the filter, so later dates can't move up.
    """
    near = records.where(F.col("next_action_due").isNotNull()).orderBy("next_action_due", "id").limit(first)
    return near.withColumn("health", health).where(F.col("health").isin("due_soon", "stalled")).orderBy("next_action_due", "id").limit(k)


def budgeted(df: DataFrame, amount: str, order: list[str], budget: int, key: str | None = None) -> DataFrame:
    """Rows in order while the total before them is under the budget, of each ``key`` if one is named.

    The row that reaches the budget counts whole. ``order`` tells rows (of a key) apart. Sums are made in two levels over ranges, so that a key may have
    any number of rows; what lies before a key is the least sum of its rows.
    """
    from tidewell.operators.ordering import sums_before

    out = sums_before(df, [*([key] if key else []), *order], F.col(amount), "_before")
    if key:
        start = out.groupBy(F.col(key).alias("_key")).agg(F.min("_before").alias("_start"))
        out = out.join(start, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_before", F.col("_before") - F.col("_start")).drop("_key", "_start")
    return out.where(F.col("_before") < budget).drop("_before")
