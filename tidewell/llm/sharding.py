"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one counts the rows of each bucket; pass two scatters the records into the same buckets by
seeded hashes and shuffles each bucket with Spark's ``shuffle``, which is a Fisher-Yates shuffle.
The number of buckets follows from the bytes of the input, so a bucket has a bounded size at any scale.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidewell.llm.common import Scratch

RECORD_BYTES = 16
BUCKET_BYTES = 32 << 20


def _weights(key: Column, seed: int, n_shards: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key, F.lit(j)) for j in range(n_shards)]


def shard_of(key: Column, n_shards: int, seed: int = 17) -> Column:
    """The shard with the greatest weight for this key.

    The key and the number of shards decide. With one more shard a row either stays or goes to the
    new one, as only one weight is added.
    """
    weights = F.array(*_weights(key, seed, n_shards))
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def shuffle_into_shards(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
    key: str = "doc_id",
    text: str = "text",
    payload: list[str] | None = None,
) -> DataFrame:
    """Every row with its shard, its slot there and its shard if there were one more.

    Returns key, size, text_crc32, law, shard, slot, grown_shard and, in the struct ``record``, the
    payload columns (all columns of ``docs`` by default). Slots of a shard are gapless from 0.

    A null text counts as empty; rows with a null key are one key. Repeated rows keep their number and
    each gets a slot of its own. Rows of one key with other texts share the shard but are spread
    over its buckets; a row that is repeated is in one bucket as often, so what one task holds is bounded by the
    bucket's size and the copies of one row. Ties of the seeded order are broken by key, size and checksum, and the
    result depends on the rows, the seed and the number of shards, not on how the input or the shuffles are split. An empty table gives an empty result.
    """
    payload = docs.columns if payload is None else payload
    body = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(body) + F.lit(RECORD_BYTES))).first()[0] or 0
    per_shard = max(1, math.ceil(total / (n_shards * bucket_bytes)))
    crc = F.crc32(body.cast("binary"))
    weights = F.array(*_weights(F.col(key), seed, n_shards))
    rows = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(body) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        crc.alias("crc"),
        weights.alias("weights"),
        F.struct(*[F.col(c) for c in payload]).alias("record") if payload else F.lit(None).cast("struct<x:int>").alias("record"),
    ).withColumn("top", F.array_max("weights"))
    rows = rows.select(
        "k", "size", "crc", "record",
        (F.array_position("weights", F.col("top")) - 1).cast("int").alias("shard"),
        (F.xxhash64(F.lit(seed), F.col("k"), F.lit(n_shards)) > F.col("top")).alias("moves"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col("k"), F.col("crc")), F.lit(per_shard)).cast("int").alias("bucket"),
        F.xxhash64(F.lit(seed + 2), F.col("k"), F.col("crc")).alias("seeded"),
    )

    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    cells = ["seeded", "k", "size", "crc", "moves", "record"]
    # Spark seeds ``shuffle`` by the partition as well and goes on from row to row, so both must follow from the rows alone:
    # the number of a bucket is that of its partition, whatever the session's settings.
    # A bucket's start comes to it as one more row, so that its records aren't shuffled again for a join.
    number = F.col("shard") * per_shard + F.col("bucket")
    buckets = (
        rows.withColumn("number", number)
        .unionByName(starts.select("start", number.alias("number")), allowMissingColumns=True)
        .repartitionById(n_shards * per_shard, "number")
        .groupBy("number")
        .agg(F.sort_array(F.collect_list(F.when(F.col("start").isNull(), F.struct(*cells)))).alias("recs"), F.max("start").alias("start"))
        .select(F.floor(F.col("number") / per_shard).cast("int").alias("shard"), "start", F.shuffle("recs", F.lit(seed)).alias("recs"))
    )
    out = buckets.select("shard", "start", F.posexplode("recs").alias("pos", "r"))
    return out.select(
        F.col("r.k").alias(key),
        F.col("r.size").alias("size"),
        F.col("r.crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("pos")).cast("long").alias("slot"),
        F.when(F.col("r.moves"), F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("grown_shard"),
        F.col("r.record").alias("record"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, **options) -> None:
    """Write each shard's records, in slot order within a file, to ``path/shard=<n>/``."""
    out = shuffle_into_shards(docs, n_shards, **options)
    out.select("record.*", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def written_shards(docs: DataFrame, n_shards: int = 40, seed: int = 17, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of ``shuffle_into_shards`` but the record, as read back from shards that hold the whole records.

    Size, checksum and slot are those of what was written. Columns of ``docs`` may have any name.
    """
    path = f"{Scratch(docs.sparkSession, 'shards').root}/shards"
    whole = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in docs.columns if c not in (key, text)]).alias("rest"))
    if len(docs.columns) == len({key, text}):
        whole = whole.drop("rest")
    write_shards(whole, path, n_shards, seed=seed, key="key", text="text", **options)
    schema = StructType([*whole.schema, StructField("shard", IntegerType()), StructField("slot", LongType())])
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.sparkSession.read.schema(schema).parquet(path).select(
        F.col("key").alias(key),
        (F.octet_length(body) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("key"), n_shards + 1, seed).alias("grown_shard"),
    )
