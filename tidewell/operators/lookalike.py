"""Lookups by patterns with wildcards, without regard to case, as joins.

``%`` stands for any characters and ``_`` for one; a backslash takes away the meaning of what follows. Nothing is compared all with all: a
pattern without wildcards meets equal names; one with literal pieces meets the names that have the rarest of the pieces' grams; one of wildcards only
meets names by their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram. A pattern whose longest literal is shorter meets names by grams of that length.
GRAM = 3
ANY, ONE, MARK = "\x01", "\x02", "\x03"


def tokens(pattern: Column) -> Column:
    """The pattern in lower case with its wildcards as control characters and its escapes resolved."""
    kept = F.replace(F.lower(pattern), F.lit("\\\\"), F.lit(MARK))
    for c, to in (("%", "\x04"), ("_", "\x05")):
        kept = F.replace(kept, F.lit("\\" + c), F.lit(to))
    kept = F.translate(F.replace(kept, F.lit("\\"), F.lit("")), "%_", ANY + ONE)
    return F.translate(kept, MARK + "\x04\x05", "\\%_")


def _grams(text: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, size))


def _as_regex(t: Column) -> Column:
    """A regular expression for tokens: literals quoted, wildcards as dots that take line ends too."""
    quoted = F.regexp_replace(t, r"([^\p{L}\p{N}\s\x01\x02])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit(ANY), F.lit(".*")), F.lit(ONE), F.lit(".")), F.lit("$"))


def pattern_matches(patterns: DataFrame, names: DataFrame, pattern: str = "pattern", name: str = "name", key: str = "id") -> DataFrame:
    """pattern, matches (how many rows of ``names`` match it) and first (the least key among them); patterns without a match are left out.

    Patterns and names are made distinct before they meet, and rows of one name are counted first, so repeats cost nothing. Null patterns and names match
    nothing. The name must match from its start to its end.
    """
    p = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("_p")).distinct().withColumn("_t", tokens(F.col("_p")))
    n = names.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("_n")).agg(F.count(F.lit(1)).alias("_c"), F.min(key).alias("_k"))
    wild = F.col("_t").rlike("[\x01\x02]")
    pieces = F.filter(F.split("_t", "[\x01\x02]+"), lambda x: x != "")
    longest = F.array_max(F.transform(pieces, lambda x: F.length(x)))

    equal = p.where(~wild).join(n, F.col("_t") == F.col("_n")).select("_p", "_c", "_k")

    sized = p.where(wild).withColumn("_g", F.least(F.coalesce(longest, F.lit(0)), F.lit(GRAM)))
    own = sized.where("_g > 0").withColumn("_gram", F.explode(F.array_distinct(F.flatten(F.transform(F.filter(pieces, lambda x: F.length(x) >= F.col("_g")), lambda x: _grams(x, F.col("_g")))))))
    sizes = F.array(*[F.lit(i) for i in range(1, GRAM + 1)])
    of_names = n.select("_n", F.explode(F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda s: s <= F.length("_n")), lambda s: _grams(F.col("_n"), s))))).alias("_gram"))
    of_names = of_names.join(own.select("_gram").distinct(), "_gram", "left_semi")
    counts = of_names.groupBy("_gram").agg(F.count(F.lit(1)).alias("_m"))
    rarest = own.join(counts, "_gram", "left").groupBy("_p", "_t").agg(F.min_by("_gram", F.struct(F.coalesce("_m", F.lit(0)), "_gram")).alias("_gram"))
    literal = rarest.join(of_names, "_gram").where(F.regexp_like("_n", _as_regex(F.col("_t")))).select("_p", "_n").join(n, "_n").select("_p", "_c", "_k")

    # wildcards only: so many characters, or so many and more
    lengths = n.groupBy(F.length("_n").alias("_l")).agg(F.sum("_c").alias("_c"), F.min("_k").alias("_k"))
    least = F.length(F.replace("_t", F.lit(ANY), F.lit("")))
    blank = sized.where("_g = 0").select("_p", least.alias("_l"), F.contains("_t", F.lit(ANY)).alias("_open"))
    exact = blank.where("not _open").join(lengths, "_l").select("_p", "_c", "_k")
    up_to = lengths.select(F.explode(F.sequence(F.lit(0), "_l")).alias("_l"), "_c", "_k").groupBy("_l").agg(F.sum("_c").alias("_c"), F.min("_k").alias("_k"))
    more = blank.where("_open").join(up_to, "_l").select("_p", "_c", "_k")
    found = equal.unionByName(literal).unionByName(exact).unionByName(more)
    return found.groupBy(F.col("_p").alias(pattern)).agg(F.sum("_c").alias("matches"), F.min("_k").alias("first"))


def looked_up(rows: DataFrame, by: str, names: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """``rows`` with ``first`` (the least key of the names that its column ``by`` matches, null if none), ``only`` (that key if exactly one
    row matches) and ``matches``."""
    found = pattern_matches(rows, names, by, name, key).withColumnRenamed(by, "_by")
    out = rows.join(found, F.col(by) == F.col("_by"), "left").drop("_by").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("only", F.when(F.col("matches") == 1, F.col("first")))
