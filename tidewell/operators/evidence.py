"""Which items of an evidence library a draft may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.scratch import kept, shared_folder

# Who may see an item, from all to none. An audience sees items of its own level and of those before.
PERMISSIONS = ("public", "partners_only", "internal", "do_not_share")


def level(permission: Column) -> Column:
    """The place of a permission, from 1; an unknown or missing one is that of the last, which nobody may use."""
    place = F.array_position(F.array(*[F.lit(p) for p in PERMISSIONS]), permission)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(PERMISSIONS)).otherwise(place)


def selectable(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """draft_id, item_id of the items whose permission allows the draft's audience and that have all tags which the draft asks for.

    ``drafts``: draft_id, audience, tags; ``items``: item_id, permission, tags. Items that may not be shared are for no draft, and an audience that isn't one of
    the first three sees public items only. A draft without tags, or with null ones, matches no item: there is nothing to look up. Each draft meets the items by the
    rarest of its tags, so a tag that most items have forms no pairs unless a draft has no other; what it meets is then held against the item's tags. Repeated tags
    count once; repeated or null ids are rows of their own. The items are read once: those of their tags that drafts ask for are written, a row for each tag, and an
    item's tags meet again in one row only once for all its drafts.
    """
    audience = F.when(F.col("audience").isin(*PERMISSIONS[1:3]), level(F.col("audience"))).otherwise(1)
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    i = items.select("item_id", level(F.col("permission")).alias("_level"), clean("tags").alias("_has")).where(F.col("_level") < len(PERMISSIONS))
    d = drafts.select("draft_id", audience.alias("_may"), F.array_sort(clean("tags")).alias("_wants")).where(F.size("_wants") > 0)
    asked = d.select("_wants").distinct().select("_wants", F.explode("_wants").alias("tag"))
    tagged = i.withColumn("_row", F.monotonically_increasing_id()).select("_row", "item_id", "_level", F.explode("_has").alias("tag"))
    tagged = kept(tagged.join(asked.select("tag").distinct(), "tag", "left_semi"), shared_folder(items.sparkSession, "evidence"), "tagged")
    counts = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    # a tag that no item has makes the draft's set impossible: it is the rarest and meets nothing
    rarest = asked.join(counts, "tag", "left").groupBy("_wants").agg(F.min_by("tag", F.struct(F.coalesce("n", F.lit(0)), "tag")).alias("tag"))
    met = d.join(rarest, "_wants").join(tagged, "tag").where(F.col("_level") <= F.col("_may")).select("draft_id", "item_id", "_row", "_wants")
    has = tagged.groupBy("_row").agg(F.collect_list("tag").alias("_has"))
    return met.join(has, "_row").where(F.size(F.array_except("_wants", "_has")) == 0).select("draft_id", "item_id")
