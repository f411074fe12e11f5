"""Organizations that are the same under other names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import org_key
from tidewell.sources.scratch import kept, shared_folder

LEAST_CONTAINED = 4


def same_key(a: Column, b: Column) -> Column:
    """Two normalised names: equal, or one in the other if both have four characters or more; empty ones never."""
    long = (F.length(a) >= LEAST_CONTAINED) & (F.length(b) >= LEAST_CONTAINED)
    return (a != "") & (b != "") & ((a == b) | (long & (F.contains(a, b) | F.contains(b, a))))


def same_org(a: Column, b: Column) -> Column:
    return same_key(org_key(a), org_key(b))


def _pieces(name: Column, size: int = LEAST_CONTAINED) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - size + 1, F.lit(1))), lambda i: F.substring(name, i, size))


def _rarest_piece(names: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each (kind, key) with that ``piece`` of it which is in the fewest rows of ``pieces`` (kind, piece); those of which a piece is in none drop out."""
    counts = pieces.groupBy(F.col("kind").alias("_k"), F.col("piece").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    own = names.select("kind", "key").distinct().withColumn("piece", F.explode(F.array_distinct(_pieces(F.col("key")))))
    n = F.coalesce("_n", F.lit(0))
    met = own.join(counts, (F.col("kind") == F.col("_k")) & (F.col("piece") == F.col("_p")), "left")
    return met.groupBy("kind", "key").agg(F.min_by("piece", F.struct(n, "piece")).alias("piece"), F.min(n).alias("_least")).where("_least > 0").drop("_least")


def fuzzy_anti_join(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``found`` (id, name, organization) that match no known one by name or, where both have one, by organization.

    Equal names meet by the name. A contained one meets those that contain it by the rarest of its pieces of four
    characters, all of which the longer one has. So frequent pieces form no pairs, and none is formed that shares nothing.
    """

    def keys(rows: DataFrame, *others: str) -> DataFrame:
        both = F.array(F.struct(F.lit("n").alias("kind"), org_key(F.col("name")).alias("key")), F.struct(F.lit("o").alias("kind"), org_key(F.col("organization")).alias("key")))
        return rows.select(*others, F.explode(both).alias("k")).select(*others, "k.kind", "k.key").where("key != ''")

    def in_pieces(names: DataFrame) -> DataFrame:
        return names.withColumn("piece", F.explode(F.array_distinct(_pieces(F.col("key")))))

    f, k = keys(found, "id"), keys(known).distinct()
    equal = f.join(k, ["kind", "key"], "left_semi").select("id")
    f_long, k_long = f.where(F.length("key") >= LEAST_CONTAINED), k.where(F.length("key") >= LEAST_CONTAINED)
    f_pieces, k_pieces = in_pieces(f_long), in_pieces(k_long)
    side = lambda names: names.select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.col("piece").alias("_piece"))
    meet = (F.col("kind") == F.col("_kind")) & (F.col("piece") == F.col("_piece"))
    inner = f_pieces.join(side(_rarest_piece(k_long, f_pieces)), meet & F.contains("key", F.col("_key")), "left_semi").select("id")
    contained = _rarest_piece(f_long, k_pieces).join(side(k_pieces), meet & F.contains("_key", F.col("key")), "left_semi")
    outer = f_long.join(contained.select("kind", "key"), ["kind", "key"], "left_semi").select("id")
    return found.join(equal.union(inner).union(outer).distinct(), "id", "left_anti")


def _related(keys: DataFrame) -> DataFrame:
    """Pairs (kind, key, other) of the distinct ``keys`` (kind, key) of one kind of which one has the other in it, both ways round.

    The contained one meets the longer ones by its rarest piece.
    """
    long = keys.where(F.length("key") >= LEAST_CONTAINED)
    pieces = long.withColumn("piece", F.explode(F.array_distinct(_pieces(F.col("key")))))
    longer = pieces.select(F.col("kind").alias("_kind"), F.col("key").alias("other"), F.col("piece").alias("_piece"))
    meet = (F.col("kind") == F.col("_kind")) & (F.col("piece") == F.col("_piece")) & (F.length("other") > F.length("key")) & F.contains("other", F.col("key"))
    pairs = _rarest_piece(long, pieces).join(longer, meet).select("kind", "key", "other")
    return pairs.unionByName(pairs.select("kind", F.col("other").alias("key"), F.col("key").alias("other")))


def greedy_distinct(found: DataFrame, group: str, order: str = "ord") -> DataFrame:
    """Of each group's rows in order (ties by id), those that match no row accepted before, by name or by organization.

    Decided in rounds, for all groups at once. A row without an undecided earlier row that it matches is kept, and those that match a kept row are
    dropped. The first row of a group is always decided, so it ends; the rounds are as many as the longest chain of rows that hang on
    each other's fate. Rows meet by their keys: each key has the earliest of its undecided rows, so equal names form no
    pairs, and the pairs of keys that contain each other are found once. Each round is written and read again.

    Rows without a name and organization match none. A null group is a group. An empty table gives none; ids tell rows apart.
    """
    folder = shared_folder(found.sparkSession, "greedy")
    place = F.struct(F.col(order).alias("o"), F.col("id").alias("id"))
    rows = kept(found.select("id", place.alias("place"), F.col(group).alias("g"), org_key(F.col("name")).alias("n"), org_key(F.col("organization")).alias("o")), folder, "rows")

    def keyed(some: DataFrame) -> DataFrame:
        both = F.array(*[F.struct(F.struct(F.col("g").alias("g"), F.lit(c).alias("of")).alias("kind"), F.col(c).alias("key")) for c in ("n", "o")])
        return some.select("id", "place", F.explode(both).alias("k")).select("id", "place", "k.kind", "k.key").where("key != ''")

    edges = kept(_related(keyed(rows).select("kind", "key").distinct()), folder, "edges")
    near = lambda keys: edges.join(keys.withColumnRenamed("key", "other"), ["kind", "other"]).drop("other")
    done = []
    while True:
        own = keyed(rows)
        least = own.groupBy("kind", "key").agg(F.min("place").alias("first"))
        reach = least.unionByName(near(least)).groupBy("kind", "key").agg(F.min("first").alias("first"))
        before = own.join(reach, ["kind", "key"]).groupBy("id").agg(F.min("first").alias("_first"))
        judged = rows.join(before, "id", "left").withColumn("keep", F.coalesce(F.col("_first") == F.col("place"), F.lit(True))).drop("_first")
        judged = kept(judged, folder, f"round-{len(done)}")
        done.append(judged.where("keep").select("id"))
        rest = judged.where("not keep").drop("keep")
        if not rest.head(1):
            break
        taken = keyed(judged.where("keep")).select("kind", "key").distinct()
        lost = keyed(rest).join(taken.unionByName(near(taken)).distinct(), ["kind", "key"], "left_semi").select("id").distinct()
        rows = rest.join(lost, "id", "left_anti")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return found.join(out, "id", "left_semi")


def enriched(rows: DataFrame, cache: DataFrame, cache_columns: list[str]) -> DataFrame:
    """The cached values for a name, without regard to case; null if there is none. Of several the first key counts."""
    one = cache.groupBy(F.lower("name").alias("_key")).agg(F.min_by(F.struct(*cache_columns), "id").alias("_hit"))
    return rows.join(one, F.lower(rows["name"]) == F.col("_key"), "left").select(*rows.columns, *[F.col("_hit")[c].alias(c) for c in cache_columns])
