"""Reads of single rows, and what becomes of none or several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted_matches(requests: DataFrame, asked: str, rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each request, which asks for a key by its column ``asked``, with ``matches``, ``single`` (the value, or null with ``single_error`` unless exactly one row matches) and ``maybe``
    (null for none, ``maybe_error`` for several). Rows are counted by key before they meet the requests."""
    found = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_v"))
    out = requests.join(found, F.col(asked) == F.col("_k"), "left").withColumn("matches", F.coalesce("_n", F.lit(0)))
    one = F.when(F.col("matches") == 1, F.col("_v"))
    return out.select(*requests.columns, "matches", one.alias("single"), (F.col("matches") != 1).alias("single_error"), one.alias("maybe"), (F.col("matches") > 1).alias("maybe_error"))


def exactly_one(rows: DataFrame) -> DataFrame:
    """The rows, which must be exactly one; reads two at most."""
    n = len(rows.limit(2).take(2))
    if n != 1:
        raise LookupError("no row" if n == 0 else "several rows")
    return rows


def at_most_one(rows: DataFrame) -> DataFrame:
    """The rows, which must be one or none."""
    if len(rows.limit(2).take(2)) > 1:
        raise LookupError("several rows")
    return rows


def singleton(rows: DataFrame, order: str = "id") -> DataFrame:
    """The first row of a table that should have one."""
    return rows.orderBy(order).limit(1)


def top_hit_details(hits: DataFrame, details: DataFrame, query: str, rank: str, key: str) -> DataFrame:
    """For each query the details of its best hit, null ones if the hit has none. Hits are cut to one before the join."""
    best = hits.groupBy(query).agg(F.min_by(key, F.struct(rank, key)).alias("_hit"))
    return best.join(details, F.col("_hit") == F.col(key), "left").drop("_hit")


def newest_list(rows: DataFrame, key: str, value: str, order: list[str], k: int) -> DataFrame:
    """key, total and the k newest values, newest first. Only k rows of a key are gathered.

    ``order``: columns whose greatest values are newest and which tell the rows of a key apart.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    cells = F.sort_array(F.collect_list(F.when(F.col("_rn") <= k, F.struct("_rn", F.col(value).alias("v")))))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.transform(cells, lambda c: c["v"]).alias("newest"))
