"""Writes as transformations: states, claims, deletions and checks of constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns that an accepted candidate takes along.
ACCEPTED = ("name", "channel", "organization", "contact_name", "contact_email", "website", "location", "funder_type", "geographic_focus", "typical_grant_size", "focus_areas")


def move_stages(records: DataFrame, commands: DataFrame, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Each command (record_id, from_stage, to_stage and the columns of ``order``) with ``accepted``.

    A command is accepted if the record is in its ``from_stage`` and no earlier command of the batch moved the record:
    the first success makes the others fail, as they name a stage that the record has left. So a record moves once in a batch.
    ``order`` must tell the commands of a record apart.
    """
    state = records.select(F.col("id").alias("_id"), F.col("stage").alias("_stage"))
    place = F.struct(*order)
    fits = commands.join(state, (F.col("record_id") == F.col("_id")) & (F.col("from_stage") == F.col("_stage")), "left_semi")
    first = fits.groupBy(F.col("record_id").alias("_r")).agg(F.min(place).alias("_first"))
    joined = commands.join(first, (F.col("record_id") == F.col("_r")) & (place == F.col("_first")), "left")
    return joined.withColumn("accepted", F.col("_r").isNotNull()).drop("_r", "_first")


def apply_moves(records: DataFrame, accepted: DataFrame, at: Column | None = None) -> DataFrame:
    """Records with the stages of accepted commands, one row for each record; with ``at`` moved ones get it as updated_at."""
    moves = accepted.select(F.col("record_id").alias("_id"), F.col("to_stage").alias("_to"))
    out = records.join(moves, F.col("id") == F.col("_id"), "left")
    if at is not None:
        was = F.col("updated_at") if "updated_at" in records.columns else F.lit(None).cast("timestamp")
        out = out.withColumn("updated_at", F.when(F.col("_id").isNotNull(), at).otherwise(was))
    return out.withColumn("stage", F.coalesce("_to", "stage")).drop("_id", "_to")


def updated(rows: DataFrame, changes: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows with the columns that ``changes`` (one row for each key) has for their key, null ones too, stamped with updated_at."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    out = rows.join(new, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    was = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None).cast("timestamp")
    cells = [F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns if c != "updated_at"]
    return out.select(*cells, F.when(hit, at).otherwise(was).alias("updated_at"))


def singleton_upsert(rows: DataFrame, values: DataFrame) -> DataFrame:
    """A table of one row after a write of one: the given columns go into that row, nulls too, and its others stay; without a row the write is the first."""
    own = rows.orderBy("id").limit(1).select(F.struct(*rows.columns).alias("_own"))
    given = [c for c in values.columns if c != "id"]
    out = values.join(own, F.lit(True), "left")
    others = [F.col("_own")[c].alias(c) for c in rows.columns if c not in values.columns]
    return out.select(F.coalesce(F.col("_own")["id"], "id").alias("id"), *given, *others)


# The message of a run that starts when a candidate is accepted, around the name.
RUN_MESSAGE = ("Researching ", " and drafting a strategy...")


def accepted(candidates: DataFrame, first_stage: str, actor: Column | None = None, at: Column | None = None) -> dict[str, DataFrame]:
    """What accepting candidates writes: 'prospects' in the first stage, with the columns that both tables have, 'runs' of research
    for them, 'contacts', the writes to the directory, which link to the prospects, and 'candidates', the accepted rows with status, reviewed_by and updated_at.
    A prospect has its candidate's id."""
    copied = [c for c in ACCEPTED if c in candidates.columns]
    return {
        "prospects": candidates.select("id", *copied, F.lit(first_stage).alias("stage")),
        "runs": candidates.select(F.col("id").alias("prospect_id"), F.lit("researching").alias("status"), F.concat(F.lit(RUN_MESSAGE[0]), "name", F.lit(RUN_MESSAGE[1])).alias("status_message")),
        "contacts": candidates.select(F.col("id").alias("seq"), F.col("contact_name").alias("name"), F.col("contact_email").alias("email"), "organization", F.col("id").alias("source_prospect_id"), F.lit(None).cast(dict(candidates.dtypes)["id"]).alias("source_candidate_id")),
        "candidates": candidates.withColumns({"status": F.lit("accepted"), "reviewed_by": F.lit(None).cast("string") if actor is None else actor, "updated_at": F.lit(None).cast("timestamp") if at is None else at}),
    }


def first_claims(claims: DataFrame, run: str = "run_id", ts: str = "claimed_at", tie: str = "id") -> DataFrame:
    """Each claim with ``won``: the first of its run."""
    w = Window.partitionBy(run).orderBy(ts, tie)
    return claims.withColumn("won", F.row_number().over(w) == 1)


def delete_with_children(parents: DataFrame, children: DataFrame, doomed: DataFrame, parent_id: str, child_fk: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed parents (``doomed`` has parent_id) and their children."""
    gone = doomed.select(F.col(parent_id).alias("_gone"))
    return parents.join(gone, F.col(parent_id) == F.col("_gone"), "left_anti"), children.join(gone, F.col(child_fk) == F.col("_gone"), "left_anti")


def unlink_missing(children: DataFrame, parents: DataFrame, child_fk: str, parent_id: str) -> DataFrame:
    """Children whose parent is gone keep their row without the link."""
    alive = parents.select(F.col(parent_id).alias("_p")).distinct()
    return children.join(alive, F.col(child_fk) == F.col("_p"), "left").withColumn(child_fk, F.col("_p")).drop("_p")


def orphans(children: DataFrame, parents: DataFrame, child_fk: str, parent_id: str) -> DataFrame:
    alive = parents.select(F.col(parent_id).alias("_p"))
    return children.where(F.col(child_fk).isNotNull()).join(alive, F.col(child_fk) == F.col("_p"), "left_anti")


def transitions_checked(log: DataFrame, allowed: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Each logged state with the one before and ``valid``; a first state is always valid."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = log.withColumn("from_state", F.lag(state).over(w))
    ok = allowed.select(F.col("from_state").alias("_a"), F.col("to_state").alias("_b"), F.lit(True).alias("_ok"))
    joined = steps.join(F.broadcast(ok), (F.col("from_state") == F.col("_a")) & (F.col(state) == F.col("_b")), "left")
    return joined.withColumn("valid", F.col("from_state").isNull() | F.coalesce("_ok", F.lit(False))).drop("_a", "_b", "_ok")


def last_write_wins(rows: DataFrame, writes: DataFrame, key: str, seq: str) -> DataFrame:
    """Upsert: the last write of a key replaces its row or adds one."""
    w = Window.partitionBy(key).orderBy(F.col(seq).desc())
    last = writes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", seq)
    return rows.join(last.select(key), key, "left_anti").unionByName(last)


def missing_values(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: how many rows lack each required column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])


def gate(enabled: Column, actor: Column, ready: Column, threshold: Column) -> Column:
    """Whether the nightly search runs, or why not."""
    return F.when(~enabled, "disabled").when(actor.isNull(), "no actor").when(ready >= threshold, "queue full").otherwise("run")
