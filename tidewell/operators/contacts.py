"""A directory of contacts with one row for each address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import null_if_empty, strip


def clean_email(c: Column) -> Column:
    return null_if_empty(F.lower(strip(c)))


def display_name(name: Column, organization: Column, email: Column) -> Column:
    """The name, else the organization, else the address; null if all are empty."""
    return F.coalesce(null_if_empty(strip(name)), null_if_empty(strip(organization)), clean_email(email))


def upserted(contacts: DataFrame, writes: DataFrame) -> DataFrame:
    """Contacts after writes with an address (name, email, organization, source_prospect_id, source_candidate_id, seq).

    The last write of an address wins and overwrites all but id and created_at; other addresses are added with the
    id of the write. Writes without any name are skipped.
    """
    w = writes.select("*", clean_email(F.col("email")).alias("_e")).withColumn("_n", display_name(F.col("name"), F.col("organization"), F.col("email"))).where("_e is not null and _n is not null")
    last = Window.partitionBy("_e").orderBy(F.col("seq").desc())
    w = w.withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
    w = w.select("_e", F.col("_n").alias("w_name"), F.col("organization").alias("w_org"), F.col("source_prospect_id").alias("w_p"), F.col("source_candidate_id").alias("w_c"), F.col("seq").alias("w_seq"))
    both = contacts.join(w, contacts["email"] == w["_e"], "full_outer")
    new = F.col("_e").isNotNull()
    pick = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b))
    return both.select(
        F.coalesce("id", "w_seq").alias("id"), pick("w_name", "name").alias("name"), F.coalesce("_e", "email").alias("email"), pick("w_org", "organization").alias("organization"),
        pick("w_p", "source_prospect_id").alias("source_prospect_id"), pick("w_c", "source_candidate_id").alias("source_candidate_id"),
    )


def merged(contacts: DataFrame, writes: DataFrame, at: Column) -> DataFrame:
    """The directory after ``writes`` (seq, name, email, organization, source_prospect_id, source_candidate_id) in the order of seq.

    ``contacts``: id, name, email, organization, source_prospect_id, source_candidate_id, created_at, updated_at. A write with an
    address goes to the contact of that address, which takes over all it says, nulls too; the last one wins. A write without one goes to the newest contact
    without an address that has its name, without regard to case, and its organization; it only sets the source links that it has. If there is none, the
    first such write adds a contact with its seq as the id. Written contacts get ``at`` as updated_at, new ones as created_at too. Writes without any name are skipped.
    """
    links = ("source_prospect_id", "source_candidate_id")
    w = writes.select(
        "seq", display_name(F.col("name"), F.col("organization"), F.col("email")).alias("w_name"), clean_email(F.col("email")).alias("w_email"), F.col("organization").alias("w_org"), *[F.col(c).alias(f"w_{c}") for c in links],
    ).where("w_name is not null")
    cells = F.struct("w_name", "w_org", *[f"w_{c}" for c in links])
    last = w.where("w_email is not null").groupBy("w_email").agg(F.max_by(cells, "seq").alias("w"), F.min("seq").alias("w_seq")).select("w_email", "w.*", "w_seq")
    mailed = contacts.where("email is not null").join(last, F.col("email") == F.col("w_email"), "full_outer")
    hit = F.col("w_seq").isNotNull()
    new = lambda written, c: F.when(hit, F.col(written)).otherwise(F.col(c)).alias(c)
    stamp = [F.when(F.col("id").isNull(), at).otherwise(F.col("created_at")).alias("created_at"), F.when(hit, at).otherwise(F.col("updated_at")).alias("updated_at")]
    ids = F.coalesce("id", "w_seq").alias("id")
    mailed = mailed.select(ids, new("w_name", "name"), F.coalesce("w_email", "email").alias("email"), new("w_org", "organization"), *[new(f"w_{c}", c) for c in links], *stamp)

    # one row for each name and organization: its last links that aren't null
    key = F.struct(F.lower("w_name").alias("n"), F.col("w_org").alias("o")).alias("w_key")
    named = w.where("w_email is null").groupBy(key).agg(
        F.min("seq").alias("w_seq"), F.min_by("w_name", "seq").alias("w_name"), F.min_by("w_org", "seq").alias("w_org"), *[F.max_by(f"w_{c}", F.when(F.col(f"w_{c}").isNotNull(), F.col("seq"))).alias(f"w_{c}") for c in links],
    )
    newest = Window.partitionBy("_key").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    without = contacts.where("email is null").withColumn("_key", F.struct(F.lower("name").alias("n"), F.col("organization").alias("o"))).withColumn("_rn", F.row_number().over(newest))
    unmailed = without.join(named, (F.col("_rn") == 1) & F.col("_key").eqNullSafe(F.col("w_key")), "full_outer")
    unmailed = unmailed.select(ids, F.coalesce("name", "w_name").alias("name"), "email", F.coalesce("organization", "w_org").alias("organization"), *[F.coalesce(f"w_{c}", c).alias(c) for c in links], *stamp)
    return mailed.unionByName(unmailed)


def matched_without_email(contacts: DataFrame, writes: DataFrame) -> DataFrame:
    """For writes without an address the newest contact of that name and organization without one; null if none."""
    w = writes.where(clean_email(F.col("email")).isNull()).withColumn("_n", display_name(F.col("name"), F.col("organization"), F.lit(None).cast("string"))).where("_n is not null")
    c = contacts.where("email is null").select(F.col("id").alias("contact_id"), F.lower("name").alias("_cn"), F.col("organization").alias("_co"), F.col("created_at").alias("_at"))
    joined = w.join(c, (F.lower("_n") == F.col("_cn")) & F.col("organization").eqNullSafe(F.col("_co")), "left")
    newest = Window.partitionBy("seq").orderBy(F.col("_at").desc_nulls_last(), F.col("contact_id").desc_nulls_last())
    return joined.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select("seq", F.col("_n").alias("name"), "organization", "contact_id")


def backfilled(sources: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New contacts from (priority, id, contact_name, contact_email, organization): the first source of an address counts,
    addresses of ``existing`` contacts are left out, and rows without an address are all added."""
    email = null_if_empty(F.lower(F.trim("contact_email")))
    named = sources.select("priority", "id", F.coalesce(null_if_empty(F.trim("contact_name")), F.lower(F.trim("contact_email"))).alias("name"), email.alias("email"), "organization")
    named = named.where(F.coalesce(null_if_empty(F.trim("name")), F.col("email")).isNotNull())
    first = Window.partitionBy("email").orderBy("priority", "id")
    ranked = named.withColumn("_rn", F.when(F.col("email").isNotNull(), F.row_number().over(first)).otherwise(1))
    new = ranked.where("_rn = 1").drop("_rn")
    if existing is None:
        return new
    taken = existing.where("email is not null").select(F.col("email").alias("_taken")).distinct()
    return new.join(taken, F.col("email") == F.col("_taken"), "left_anti")


def shown_organization(name: Column, organization: Column) -> Column:
    """The organization unless it is the name itself."""
    return F.when(organization.isNotNull() & ~organization.eqNullSafe(name), organization)


def renamed(contacts: DataFrame) -> DataFrame:
    """Where the name is only the address and there is an organization, its name takes over."""
    only = (F.trim("organization") != "") & F.col("email").isNotNull() & (F.lower(F.trim("name")) == F.lower(F.trim("email")))
    return contacts.withColumn("name", F.when(only, F.col("organization")).otherwise(F.col("name")))
