"""From raw documents to packed sequences, in stages that are each written and read again.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table, text_hash
from tidewell.llm.decontamination import remove_contaminated
from tidewell.llm.near_join import near_classes
from tidewell.llm.packing import pack
from tidewell.llm.quality import keep_good
from tidewell.llm.repeats import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least number.

    Rows that repeat number and text are one document: one of them stays.
    """
    heads = near_classes(docs).where("class_rank = 0").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    same = docs["doc_id"].eqNullSafe(heads["_doc"]) & (text_hash(docs["text"]) == heads["_hash"])
    if not heads.where("_n > 1").head(1):
        return docs.join(heads, same, "left_semi")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    kept = docs.join(heads, same).select(row, heads["_hash"].alias("h")).withColumn("k", F.col("row.doc_id"))
    return kept.groupBy("k", "h").agg(F.first("row").alias("row")).select("row.*")


#: Bytes of the shortest passage that counts as repeated, some 50 words of four letters and a space.
PASSAGE_BYTES = 256
#: Bytes by which such passages find each other.
PASSAGE_GRAM = 64


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``PASSAGE_BYTES`` that occur elsewhere, in the same text or another; n_chars follows the text.

    Every document stays. Texts without repeats stay as they are, null ones included; repeated rows of such length lose
    their whole text. An empty table gives an empty result.
    """
    out = remove_repeats(docs, PASSAGE_BYTES, PASSAGE_GRAM)
    if "n_chars" in docs.columns:
        changed = F.char_length("text").cast(out.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the classifier.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else scratch.keep(out)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
