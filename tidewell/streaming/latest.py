"""The newest change of each record, kept up to date from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def change_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The newest (created_at, id) of each record and its stage, as a streaming aggregate."""
    order = F.struct("created_at", "id")
    return changes.groupBy("prospect_id").agg(F.max_by("to_stage", order).alias("to_stage"), F.max(order).alias("at"))


def start(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the records that each batch changed to a folder of its own under ``path``; a batch that is run again replaces its folder.

    So a batch costs what it changed, and no key is held by the driver. ``current`` reads the newest of each record.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return latest_changes(changes).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each record that ``start`` wrote."""
    newest = Window.partitionBy("prospect_id").orderBy(F.col("batch").desc())
    return spark.read.parquet(path).withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", "batch")
