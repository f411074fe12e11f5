"""Short test items inside long documents, with DataFrame functions only.

Containment search by MinHash for sets of very different sizes: an item keeps the least of its hashed
five-word shingles, as many as its size class asks for, and a document is a candidate if it has enough of
them. The document's set is never cut down, so its length costs no recall. Candidates are then counted on all
shingles of the item.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Least size of an item in each class, and how many hashes an item of that class keeps.
SIZE_CLASSES = ((1, 16), (32, 24), (256, 32))
#: The most shingles of items for which they are broadcast, 16 bytes each.
BROADCAST_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingles(word_list: Column, n: int = 5) -> Column:
    """Hashes of all runs of n words; none if there are fewer than n."""
    last = F.size(word_list) - F.lit(n)
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(word_list, i + F.lit(j)) for j in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def least_hits(kept: int, threshold: float, miss: float) -> int:
    """The most hits that an item of this containment has, but for a chance of ``miss``, among ``kept`` hashes."""
    below, hits = 0.0, 0
    while hits < kept:
        below += math.comb(kept, hits) * threshold**hits * (1 - threshold) ** (kept - hits)
        if below > miss:
            break
        hits += 1
    return max(1, hits)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    miss: float = 1e-6,
    broadcast_shingles: int = BROADCAST_SHINGLES,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Pairs of a document and an item of whose shingles the document has at least the share ``threshold``.

    Returns doc_key, text_hash (tells rows of one doc_key apart), item_key, item_shingles, found, containment.

    A null text counts as empty. Items of fewer than ``n`` words have no shingle and match nothing, and
    so do such documents. A repeated document is reported once; texts under one number are reported each. Items with
    one number count as one item with the shingles of all its texts. Null numbers are kept as they are. Empty tables
    give no pairs. Other columns of either table are ignored.
    """
    full = items.select(F.col(item_key).alias("item"), F.explode(shingles(words(F.col(text)), n)).alias("h")).distinct()
    hint = F.broadcast if full.count() <= broadcast_shingles else (lambda df: df)
    by_rank = Window.partitionBy("item").orderBy(F.xxhash64(F.lit(29), "h"), "h")
    budget = F.lit(SIZE_CLASSES[0][1])
    for least, kept in SIZE_CLASSES[1:]:
        budget = F.when(F.col("q") >= least, F.lit(kept)).otherwise(budget)
    need = F.array(*[F.lit(least_hits(k, threshold, miss)) for k in range(1, SIZE_CLASSES[-1][1] + 1)])
    sized = (
        full.withColumn("q", F.count(F.lit(1)).over(Window.partitionBy("item")))
        .withColumn("rank", F.row_number().over(by_rank))
        .withColumn("kept", F.least(F.col("q"), budget.cast("long")).cast("int"))
    )
    sketch = sized.where(F.col("rank") <= F.col("kept")).select("h", "item", F.element_at(need, F.col("kept")).alias("need"), "q")

    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.col(doc_key).alias("doc"), F.xxhash64(body).alias("text_hash"), words(body).alias("w"))
    every = hashed.select("doc", "text_hash", (F.size("w") - n + 1).alias("n_doc"), F.explode(shingles(F.col("w"), n)).alias("h"))
    # What a document shares with any item: few rows, as most shingles are in no item.
    shared = every.join(hint(full.select("h").distinct()), "h", "left_semi").distinct()
    candidates = (
        shared.join(hint(sketch), "h")
        .where(F.col("n_doc") >= F.lit(threshold) * F.col("q"))
        .groupBy("doc", "text_hash", "item", "need")
        .agg(F.count(F.lit(1)).alias("sketch_hits"))
        .where(F.col("sketch_hits") >= F.col("need"))
        .select(F.col("doc").alias("d"), F.col("text_hash").alias("t"), F.col("item").alias("i"))
    )
    hits = shared.join(hint(sized.select("h", "item", "q")), "h")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & F.col("item").eqNullSafe(F.col("i"))
    # Only candidates are counted on all shingles.
    counted = hits.join(candidates, same, "left_semi").groupBy("doc", "text_hash", "item", "q").agg(F.count(F.lit(1)).alias("found"))
    return (
        counted.where(F.col("found") >= F.lit(threshold) * F.col("q"))
        .select(
            F.col("doc").alias(doc_key),
            "text_hash",
            F.col("item").alias(item_key),
            F.col("q").cast("long").alias("item_shingles"),
            F.col("found").cast("long").alias("found"),
            (F.col("found") / F.col("q")).alias("containment"),
        )
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Null and empty texts hold none. Repeated rows stay or go together, null numbers are judged by their text, and
    empty tables of either kind remove nothing.
    """
    key = options.get("doc_key", "doc_id")
    text = options.get("text", "text")
    bad = contained_items(docs, items, **options).select(F.col(key).alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    same = bad["_doc"].eqNullSafe(docs[key]) & (bad["_hash"] == F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    return docs.join(bad, same, "left_anti")
