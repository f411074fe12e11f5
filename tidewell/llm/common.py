"""What the operators of this package share: reading tables, scratch tables and row keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let_workers_import(spark: SparkSession) -> None:
    """Let the Python workers import this library, wherever the driver was started.

    Threads and processes of this machine get the library's folder on their path. Workers elsewhere get its modules as one archive from the driver,
    once for each Spark context.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if sc.master.startswith("local"):
        env = sc.environment
        known = env.get("PYTHONPATH", "").split(os.pathsep)
        if str(root) not in known:
            env["PYTHONPATH"] = os.pathsep.join([str(root), *filter(None, known)])
    elif sc.applicationId not in _SHIPPED:
        sc.addPyFile(library_archive())
        _SHIPPED.add(sc.applicationId)


#: Applications that have the archive.
_SHIPPED: set[str] = set()


def library_archive() -> str:
    """The library's modules as a zip file on the driver, from which Spark hands it out."""
    root = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='library-')}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one that ``spark.checkpoint.dir`` names. Only a session on a local master, where all
    threads share one machine, gets a temporary folder if that setting is missing.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: Whether Spark frees a query's shuffle files as soon as the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut lineage, so that a lost executor costs a read and not a recomputation.

    What follows reads the table, so the shuffle files behind it are freed once it is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        let_workers_import(spark)
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write ``df`` as Parquet and return it as read from there. zstd is for large texts: it takes less disk and more memory."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(FREE_SHUFFLES)
            else:
                self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out_fold(doc_id: Column | str) -> Column:
    """crc32 of the document's number, written as text, modulo 5; null numbers count as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5


def text_hash(text: Column | str) -> Column:
    """64 bits that tell apart rows of one doc_id with other texts."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
