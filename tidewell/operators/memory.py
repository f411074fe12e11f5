"""What is remembered of each record: one timeline of all that happened, and which refusals are due to be looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a slice of one record's time; a record with very many entries is dealt by its slices.
SLICE_DAYS = 28


def with_state_then(touches: DataFrame, changes: DataFrame, key: str = "prospect_id", ts: str = "occurred_at", state: str = "to_stage", changed: str = "created_at", tie: str = "id") -> DataFrame:
    """``touches`` with ``stage_then`` and ``entered_at``: the state that the record's last change up to then led to, and when; null before the first.

    A backward as-of join. A change counts from its own time on; of changes at one time the one with the greatest ``tie`` counts. Touches and changes are put
    in one order within a slice of a record's time; what holds at a slice's start comes from the last change of each slice before,
    a row for each slice. So a record with a third of all rows is many small windows, and the rows are shuffled once by
    record and slice.
    """
    slice_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(SLICE_DAYS * 86_400_000_000)).cast("long")
    c = changes.where(F.col(key).isNotNull() & F.col(changed).isNotNull()).select(F.col(key).alias("_key"), F.col(changed).cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.col(state).alias("_state"), slice_of(changed).alias("_slice"))
    t = touches.select(F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_at"), F.lit(1).alias("_kind"), slice_of(ts).alias("_slice"), F.struct(*touches.columns).alias("_row"))
    both = t.unionByName(c, allowMissingColumns=True)
    hit = F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("at"), F.col("_state").alias("state")))
    order = F.struct("_at", "_tie")
    ends = c.groupBy("_key", "_slice").agg(F.max_by(F.struct(F.col("_at").alias("at"), F.col("_state").alias("state")), order).alias("_end"))
    starts = both.select("_key", "_slice").distinct().join(ends, ["_key", "_slice"], "left")
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_key", "_slice", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy("_key", "_slice").orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last(hit, ignorenulls=True).over(inside)).where("_kind = 1")
    out = seen.join(starts, seen["_key"].eqNullSafe(starts["_key"]) & seen["_slice"].eqNullSafe(starts["_slice"]), "left").withColumn("_seen", F.coalesce("_seen", "_start"))
    return out.select("_row.*", F.col("_seen.state").alias("stage_then"), F.col("_seen.at").alias("entered_at"))


def timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """All entries of records: kind, prospect_id, id, at, what. ``parts``: a DataFrame of the last four for each kind."""
    out = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind"), "prospect_id", "id", F.col("at").cast("timestamp").alias("at"), "what")
        out = one if out is None else out.unionByName(one)
    return out


def revisit_due(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Refusals (result 'no') whose revisit_on is due and that no later outcome of the record supersedes: the outcome's row, with ``days_due``.

    ``outcomes``: id, prospect_id, result, revisit_on, created_at and others. The latest outcome of a record, of equal times the one with the greatest id, counts; each
    record has one row in the shuffle, as the latest is found before.
    """
    last = outcomes.groupBy("prospect_id").agg(F.max_by(F.struct(*[c for c in outcomes.columns if c != "prospect_id"]), F.struct("created_at", "id")).alias("_o"))
    due = last.select("prospect_id", "_o.*").where((F.col("result") == "no") & (F.col("revisit_on") <= as_of.cast("date")))
    return due.withColumn("days_due", F.datediff(as_of.cast("date"), F.col("revisit_on")))
