"""Tables of keyed rows that can be changed in place: upserts, updates and deletes rewrite only the files that hold their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

#: Folders of a table unless told otherwise. A change rewrites whole folders, so large tables need many.
BUCKETS = 64


class StoredTable:
    """Rows with a key, in Parquet folders by a hash of the key.

    A change finds the folders of its keys and replaces those by Spark's dynamic partition overwrite; other folders keep their files. All changes
    may be run again with the same result. If a job dies while folders are being replaced, some have the change and some don't:
    running it again completes it. One writer at a time. Each folder holds a marker row, so that one whose rows all go is replaced too.

    Keys are unique and not null: of writes with one key the last by ``seq`` counts, and rows without a key are left out. A column ``_bucket`` or ``_row`` is taken for the table's own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self.columns = [f.name for f in schema]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("_row", BooleanType()), StructField("_bucket", IntegerType())])).parquet(self.path)

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        """Replace the folders of ``touched`` by ``rows``."""
        marks = self.spark.createDataFrame([(b,) for b in touched], "_bucket int")
        whole = rows.select(*self.columns, F.lit(True).alias("_row"), self._bucket(F.col(self.key))).unionByName(marks.withColumn("_row", F.lit(False)), allowMissingColumns=True)
        whole.repartition(len(touched), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def _touched(self, keys: DataFrame) -> list[int]:
        """Folders that hold some of the keys; as many numbers as there are folders at most."""
        return sorted(r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self._bucket(F.col(self.key))).distinct().collect())

    def create(self, rows: DataFrame) -> None:
        """Write the first rows; of equal keys any one counts, so they should be unique."""
        self._put(rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]), list(range(self.buckets)))

    def read(self) -> DataFrame:
        return self._all().where("_row").select(*self.columns)

    def lookup(self, keys: list) -> DataFrame:
        """Rows of some keys; only their folders are read."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        return self._all().where(F.col("_bucket").isin(self._touched(wanted)) & F.col(self.key).isin(keys) & F.col("_row")).select(*self.columns)

    def _last(self, writes: DataFrame, seq: str | None) -> DataFrame:
        writes = writes.where(F.col(self.key).isNotNull())
        if seq is None:
            return writes
        others = [c for c in writes.columns if c not in (self.key, seq)]
        return writes.groupBy(self.key).agg(F.max_by(F.struct(*others), seq).alias("_w")).select(self.key, "_w.*")

    def upsert(self, writes: DataFrame, seq: str | None = None, at: Column | None = None, add: bool = True) -> None:
        """Set the columns that ``writes`` has for its keys, nulls too, and add rows for new keys unless told not to.

        Columns that a write lacks stay as they are, and are null in a new row. Written rows get ``at`` as updated_at.
        """
        last = self._last(writes, seq)
        touched = self._touched(last)
        if not touched:
            return
        given = [c for c in last.columns if c in self.columns and c != self.key]
        new = last.select(F.col(self.key).alias("_key"), F.struct(*[F.col(c) for c in given]).alias("_new") if given else F.lit(None).alias("_new"))
        old = self._all().where(F.col("_bucket").isin(touched) & F.col("_row")).select(*self.columns)
        both = old.join(new, F.col(self.key) == F.col("_key"), "full_outer" if add else "left")
        hit = F.col("_key").isNotNull()

        def cell(c: str) -> Column:
            if c == self.key:
                return F.coalesce(F.col(c), F.col("_key")).alias(c)
            if c == "updated_at" and at is not None:
                return F.when(hit, at).otherwise(F.col(c)).alias(c)
            return F.when(hit, F.col("_new")[c].cast(self.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in given else F.col(c)

        self._put(both.select(*[cell(c) for c in self.columns]), touched)

    def update(self, writes: DataFrame, seq: str | None = None, at: Column | None = None) -> None:
        """Like ``upsert`` for keys that are there; others are no rows."""
        self.upsert(writes, seq, at, add=False)

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of the keys (the column of that name)."""
        touched = self._touched(keys)
        if not touched:
            return
        gone = keys.select(F.col(self.key).alias("_key")).distinct()
        old = self._all().where(F.col("_bucket").isin(touched) & F.col("_row")).select(*self.columns)
        self._put(old.join(gone, F.col(self.key) == F.col("_key"), "left_anti"), touched)

    def delete_where_parent_in(self, parent: str, keys: DataFrame) -> None:
        """Remove the rows whose column ``parent`` is one of ``keys`` (one column): what a deleted parent takes along."""
        gone = keys.select(F.col(keys.columns[0]).alias("_parent")).distinct()
        self.delete(self.read().join(gone, F.col(parent) == F.col("_parent"), "left_semi").select(self.key))


def insert_with_ids(rows: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with new keys after the greatest of ``existing``, in ``order``; the largest key is one number, and the rows are numbered in ranges."""
    from tidewell.operators.ordering import numbered

    most = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_most"))
    out = numbered(rows, order, "_place").crossJoin(F.broadcast(most))  # one row
    return out.select((F.col("_most") + F.col("_place")).alias(key), *[c for c in rows.columns if c != key])
