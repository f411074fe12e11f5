"""Reading tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\x01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_fields(line: Column) -> Column:
    """The fields of a line. A quote opens anywhere in a field, and a doubled one inside quotes is a quote.

    Between quotes the parts are alternately outside and inside; an empty part outside, between two inside,
    is a doubled quote.
    """
    parts = F.split(line, '"')
    last = F.size(parts) - 1

    def part(x: Column, i: Column) -> Column:
        doubled = (x == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, x).when(doubled, '"').otherwise(F.replace(x, F.lit(","), F.lit(SEPARATOR)))

    return F.split(F.array_join(F.transform(parts, part), ""), SEPARATOR)


def read_csv_rows(lines: DataFrame, header: str, columns: list[str]) -> DataFrame:
    """Rows of a file whose lines are in the column ``value``, with the wanted columns, trimmed; missing cells are empty.

    ``header`` is the file's first line. Names are trimmed and in lower case, and of equal names the last counts.
    Blank lines and the header are left out.
    """
    spark = lines.sparkSession
    names = [n.strip().lower() for n in spark.range(1).select(csv_fields(F.lit(header))).first()[0]]
    place = {n: i for i, n in enumerate(names)}
    body = lines.where((F.trim(F.regexp_replace("value", r"\s+", " ")) != "") & (F.col("value") != header))
    cells = body.select("*", csv_fields(F.regexp_replace("value", "\r$", "")).alias("_f"))
    cell = lambda c: F.regexp_replace(F.coalesce(F.get("_f", F.lit(place[c])), F.lit("")), r"^\s+|\s+$", "") if c in place else F.lit("")
    return cells.select(*[c for c in lines.columns if c != "value"], *[cell(c).alias(c) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """The wanted columns of one or many CSV files, without the files' names; see ``read_csv_files``."""
    return read_csv_files(spark, path, columns).drop("file")


def read_csv_files(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Rows of one or many CSV files with ``file`` and the wanted columns, as texts, trimmed; missing cells are empty.

    Each file has its own header, the first line that isn't blank, and its cells are placed by that: files may have other orders, other columns, or
    columns in capitals. Of equal names the last counts. A data line that equals the header is data. Lines end by \\n or \\r\\n, inside quotes too.
    A file without any line gives no rows. Lines are told apart by the part of the file and their place in it, so large files are split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("_line")
    )
    lines = lines.where(F.regexp_replace("value", r"\s+", "") != "")
    place = F.struct("_block", "_line")
    heads = lines.groupBy("file").agg(F.min_by("value", place).alias("_header"), F.min(place).alias("_first"))
    heads = heads.select("file", "_first", F.transform(csv_fields(F.col("_header")), lambda n: F.lower(_stripped(n))).alias("_names"))
    rows = lines.join(heads, "file").where(place != F.col("_first")).withColumn("_f", csv_fields(F.col("value")))

    def cell(c: str) -> Column:
        back = F.array_position(F.reverse("_names"), c.lower())  # the last of equal names
        at = (F.size("_names") - back).cast("int")
        return F.coalesce(F.when(back > 0, _stripped(F.get("_f", at))), F.lit("")).alias(c)

    return rows.sortWithinPartitions("file", "_block", "_line").select("file", *[cell(c) for c in columns])


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def import_counts(rows: DataFrame) -> DataFrame:
    """file, imported, errors of rows with ``file`` and ``valid``."""
    return rows.groupBy("file").agg(F.count_if("valid").alias("imported"), F.count_if(~F.col("valid")).alias("errors"))


def checked_import(rows: DataFrame, channels: list[str]) -> DataFrame:
    """With ``valid`` (a name and a known channel), null for empty cells, and the list of focus areas."""
    from tidewell.functions.text import comma_list

    valid = (F.col("name") != "") & F.col("channel").isin(*channels)
    others = [c for c in rows.columns if c not in ("name", "channel", "focus_areas")]
    return rows.select("name", "channel", *[F.nullif(F.col(c), F.lit("")).alias(c) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in others], comma_list(F.col("focus_areas")).alias("focus_areas"), valid.alias("valid"))


def append_only(df: DataFrame, path: str) -> None:
    """Add rows to a log."""
    df.write.mode("append").parquet(path)
