"""Running sums and numbers over a whole ordered table, in two levels, so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.scratch import kept, shared_folder


def sums_before(df: DataFrame, order: list[str], amount: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows that come before; null amounts count as 0.

    ``order``: names of columns, a descending one after a minus sign, which together tell rows apart; nulls are the least. Rows are dealt by ranges of
    the order, as many as the session has shuffle partitions, and written; each range has its total, one row with a number for each range gives what lies
    before a range, and a window within the range does the rest. The sum has the type that Spark gives to sums of the amount. An empty table gives none.
    """
    folder = shared_folder(df.sparkSession, "sums")
    key = lambda c: F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc()
    by = [key(c) for c in order]
    rows = df.withColumn("_amount", F.coalesce(amount, F.lit(0))).repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    rows = kept(rows, folder, "rows")
    totals = rows.groupBy("_part").agg(F.sum("_amount").alias("t")).agg(F.collect_list(F.struct("_part", "t")).alias("_totals"))
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.sum("_amount").over(inside)).crossJoin(F.broadcast(totals))  # one row
    kind = rows.select(F.sum("_amount").alias("t")).schema["t"].dataType
    earlier = F.aggregate(F.filter("_totals", lambda x: x["_part"] < F.col("_part")), F.lit(0).cast(kind), lambda s, x: (s + x["t"]).cast(kind))
    return summed.withColumn(name, (earlier + F.coalesce("_inside", F.lit(0))).cast(kind)).drop("_amount", "_part", "_inside", "_totals")


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's number in ``order``, from 1."""
    return sums_before(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)
