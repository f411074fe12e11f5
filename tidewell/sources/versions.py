"""Tables whose files were written under several versions of a schema, read as the newest one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Added:
    """A new column, by default null; ``default`` is an SQL expression over the columns before the step."""

    column: str
    kind: str
    default: str = "NULL"


@dataclass(frozen=True)
class Renamed:
    column: str
    to: str


@dataclass(frozen=True)
class Retyped:
    """A column of another type; ``using`` is an SQL expression over the columns before the step."""

    column: str
    kind: str
    using: str


@dataclass(frozen=True)
class Dropped:
    column: str


Step = Added | Renamed | Retyped | Dropped


def after(df: DataFrame, steps: list[Step]) -> DataFrame:
    """``df`` after ``steps``. Each is a projection, so filters and column choices still reach the files where a column was only renamed or kept."""
    for s in steps:
        if isinstance(s, Added):
            df = df.withColumn(s.column, F.expr(s.default).cast(s.kind))
        elif isinstance(s, Renamed):
            if s.to in df.columns:
                raise ValueError(f"there is a column {s.to} already")
            df = df.withColumnRenamed(s.column, s.to)
        elif isinstance(s, Retyped):
            df = df.withColumn(s.column, F.expr(s.using).cast(s.kind))
        else:
            df = df.drop(s.column)
    return df


class VersionedTable:
    """Files of version v lie in ``path/version=<v>``; ``first`` is the schema of version 0, and step i leads from version i to i + 1."""

    def __init__(self, spark: SparkSession, path: str, first: StructType, steps: list[Step | list[Step]]):
        self.spark, self.path = spark, path
        self.steps = [s if isinstance(s, list) else [s] for s in steps]
        self.schemas = [first]
        for s in self.steps:
            self.schemas.append(after(spark.createDataFrame([], self.schemas[-1]), s).schema)

    def write(self, rows: DataFrame, version: int | None = None) -> None:
        """Add rows under a version, the newest by default; they need its columns, in any order."""
        version = len(self.steps) if version is None else version
        names = [f.name for f in self.schemas[version]]
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[version]] or names).write.mode("append").parquet(f"{self.path}/version={version}")

    def read(self) -> DataFrame:
        """All rows in the newest schema; a version that was never written has no rows."""
        newest = [f.name for f in self.schemas[-1]]
        out = None
        for version, schema in enumerate(self.schemas):
            if not self._written(version):
                continue
            rows = after(self.spark.read.schema(schema).parquet(f"{self.path}/version={version}"), [s for some in self.steps[version:] for s in some]).select(*newest)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schemas[-1]) if out is None else out

    def _written(self, version: int) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={version}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
