"""What a search for new organizations adds: rows that aren't known, with gaps filled from a cache, judged, and their contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import null_if_empty, plural
from tidewell.operators import matching, screening

# What a candidate of a search says of itself.
SEARCH_SOURCE, SEARCH_STATUS = "ai_search", "pending"
FILED = "Nonprofit organization (per IRS filing)"
GIFTS = "Annual contributions/gifts made: ~$"


def _gifts(raw: Column) -> Column:
    """The first filing's contributions as a sentence; null without a filing or an amount."""
    amount = F.get_json_object(raw, "$.filings_with_data[0].totcntrbgfts").try_cast("double")
    return F.concat(F.lit(GIFTS), F.regexp_replace(F.call_function("format_number", F.round(amount, 3), F.lit("#,##0.###")), r"\.$", ""))


def search_candidates(found: DataFrame, known: DataFrame, cache: DataFrame, rules: DataFrame, fields: list[str], batch: str = "batch") -> DataFrame:
    """The candidates that searches add, each as a whole row.

    ``found``: id, ord, batch, channel, name, organization, website, contact_name, contact_email, location, rationale; ``known``:
    name, organization; ``cache``: ein, name, city, raw (JSON). Rows without a name are left out, then those that match a known one, then those that
    match a row of their batch that was added before. A cached entry of the name gives the city where no location is, the type and
    the size of gifts; of several the least ein counts. Each row has its tier.
    """
    valid = found.where(F.coalesce(F.col("name"), F.lit("")) != "")
    new = matching.greedy_distinct(matching.fuzzy_anti_join(valid, known), batch)
    with_cache = matching.enriched(new, cache.select(F.col("ein").alias("id"), "name", "ein", "city", "raw"), ["ein", "city", "raw"])
    kept = ("name", "organization", "website", "contact_name", "contact_email")
    empty = lambda c: null_if_empty(F.col(c)).alias(c)
    rows = with_cache.select(
        "id", batch, "channel", "name", *[empty(c) for c in kept[1:]],
        F.coalesce(null_if_empty(F.col("location")), null_if_empty(F.col("city"))).alias("location"),
        F.when(F.col("ein").isNotNull(), FILED).alias("funder_type"),
        _gifts(F.col("raw")).alias("typical_grant_size"),
        F.to_json(F.struct("rationale", F.col("ein").alias("propublica_ein")), {"ignoreNullFields": "false"}).alias("raw"),
    )
    keep = tuple(c for c in rows.columns if c != "id")
    judged = screening.screened(rows, rules, fields, keep=keep)
    return judged.select("id", *keep, F.col("tier").alias("suggested_tier"), F.lit(SEARCH_SOURCE).alias("source"), F.lit(SEARCH_STATUS).alias("status"))


def contact_writes(candidates: DataFrame, seq: str = "id") -> DataFrame:
    """What the candidates' contacts write to the directory."""
    none = F.lit(None).cast(dict(candidates.dtypes)[seq])
    return candidates.select(F.col(seq).alias("seq"), F.col("contact_name").alias("name"), F.col("contact_email").alias("email"), "organization", none.alias("source_prospect_id"), F.col("id").alias("source_candidate_id"))


def search_counts(found: DataFrame, added: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, inserted, skipped and the message that says so; rows without a name count nowhere."""
    valid = found.where(F.coalesce(F.col("name"), F.lit("")) != "")
    n = valid.join(added.select("id", F.lit(1).alias("_new")), "id", "left").groupBy(batch).agg(F.count("_new").alias("inserted"), (F.count(F.lit(1)) - F.count("_new")).alias("skipped"))
    skipped = F.when(F.col("skipped") > 0, F.concat(F.lit(" ("), F.col("skipped").cast("string"), F.lit(" already known, skipped)"))).otherwise("")
    return n.select(batch, "inserted", "skipped", F.concat(F.lit("Found "), plural(F.col("inserted"), "candidate"), skipped).alias("message"))
