"""Weighted rules as data: each rule tests one field; the share of points gives a tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIER_1, TIER_2 = 0.7, 0.4
#: Active rules that are sent to all tasks, at most; some 2 MB.
MOST_RULES = 10_000


def criterion(field: Column, operator: Column, value: Column) -> Column:
    """Whether a field's value passes, without regard to case; null counts as empty and an unknown operator fails."""
    a, b = F.lower(F.coalesce(field, F.lit(""))), F.lower(F.coalesce(value, F.lit("")))
    set_ = F.length(F.regexp_replace(a, r"^\s+|\s+$", "")) > 0
    return (
        F.when(operator == "equals", a == b)
        .when(operator == "not_equals", a != b)
        .when(operator == "contains", F.contains(a, b))
        .when(operator == "not_contains", ~F.contains(a, b))
        .when(operator == "is_set", set_)
        .when(operator == "is_not_set", ~set_)
        .otherwise(F.lit(False))
    )


def tier(share: Column) -> Column:
    """1 from 70 %, 2 from 40 % or without a share, else 3."""
    return F.when(share.isNull(), 2).when(share >= F.lit(TIER_1), 1).when(share >= F.lit(TIER_2), 2).otherwise(3)


def active_rules(rules: DataFrame) -> DataFrame:
    """One row with all active rules as an array in their order; an error if there are more than ``MOST_RULES``.

    ``rules``: rule_id, ord, label, channel, weight, field, operator, value, active, a settings table written by hand.
    """
    r = F.struct("ord", "rule_id", "label", "weight", F.col("channel").alias("of"), "field", "operator", "value")
    one = rules.where("active").agg(F.sort_array(F.collect_list(r)).alias("_rules"), F.count(F.lit(1)).alias("_n"))
    return one.select(F.when(F.col("_n") <= MOST_RULES, F.col("_rules")).otherwise(F.raise_error(F.lit("too many rules"))).alias("_rules"))


def screened(entities: DataFrame, rules: DataFrame, fields: list[str], id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep``, score, max_possible, share, tier and the breakdown (ord, rule_id, label, weight, passed).

    A rule applies to its channel or, without one, to all. Entities are rows: none is shuffled, and equal ids stay apart.
    """
    known = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    mine = F.filter("_rules", lambda r: r["of"].isNull() | F.coalesce(r["of"] == F.col("channel"), F.lit(False)))

    def judged(r: Column) -> Column:
        passed = criterion(F.element_at(known, r["field"]), r["operator"], r["value"])
        return F.struct(*[r[c].alias(c) for c in ("ord", "rule_id", "label", "weight")], passed.alias("passed"))

    out = entities.crossJoin(F.broadcast(active_rules(rules))).select(id_col, *keep, F.transform(mine, judged).alias("breakdown"))  # one row
    points = lambda some: F.aggregate(F.filter("breakdown", some), F.lit(0).cast("long"), lambda n, r: n + F.coalesce(r["weight"], F.lit(0)))
    out = out.withColumn("score", points(lambda r: r["passed"])).withColumn("max_possible", points(lambda r: F.lit(True)))
    out = out.withColumn("share", F.when(F.col("max_possible") > 0, F.col("score") / F.col("max_possible")))
    return out.select(id_col, *keep, "score", "max_possible", "breakdown", "share", tier(F.col("share")).alias("tier"))


def channel_summary(channels: DataFrame, rules: DataFrame) -> DataFrame:
    """Of each channel of the list: how many active rules apply, their points, and the points that each tier takes."""
    counts = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("points"))
    active = rules.where("active")
    own = counts(active.where("channel is not null").groupBy(F.col("channel").alias("_of")))
    every = counts(active.where("channel is null")).select(F.col("n").alias("all_n"), F.col("points").alias("all_points"))
    joined = channels.select("value").join(own, F.col("value") == F.col("_of"), "left").crossJoin(F.broadcast(every))  # one row
    points = F.coalesce("points", F.lit(0)) + F.col("all_points")
    return joined.select(
        F.col("value").alias("channel"), (F.coalesce("n", F.lit(0)) + F.col("all_n")).alias("active_rules"), points.cast("long").alias("max_points"),
        F.ceil(points * F.lit(TIER_1)).cast("long").alias("tier1_points"), F.ceil(points * F.lit(TIER_2)).cast("long").alias("tier2_points"),
    )
