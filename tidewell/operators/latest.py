"""Newest rows of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], ts: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key; of equally new ones the one with the greatest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_matching(df: DataFrame, keys: list[str], condition: Column, ts: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key among those that match; not the newest row if it matches."""
    return latest_per_key(df.where(condition), keys, ts, tie)


def ranked(df: DataFrame, keys: list[str], ts: str = "created_at", tie: str = "id") -> DataFrame:
    """With ``rn``, 1 for the newest row of its key, to tell it from the history."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("rn", F.row_number().over(w))


def keep_newest(df: DataFrame, keys: list[Column], among: Column, ts: str = "created_at", tie: str = "id") -> DataFrame:
    """Of the rows in ``among`` only the newest of each key; the others all stay."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    inside = df.where(among).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return inside.unionByName(df.where(~F.coalesce(among, F.lit(False))))
