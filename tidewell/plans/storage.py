"""Queries over stored tables, files, streams, patterns, timelines and evidence. They join those of ``tidewell.plans.queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.functions import arrays
from tidewell.operators import evidence, lookalike, lookups, memory, profile, stages
from tidewell.plans import adapters as ad
from tidewell.plans.adapters import sql
from tidewell.plans.queries import _profiles, query
from tidewell.sources.scratch import shared_folder
from tidewell.sources.stored import StoredTable, insert_with_ids
from tidewell.sources.tables import checked_import, import_counts, read_csv_files, table
from tidewell.sources.versions import Added, Dropped, Renamed, Retyped, VersionedTable
from tidewell.streaming import runs

# --- stored tables ------------------------------------------------------------

def _stored_contacts(spark, d) -> StoredTable:
    """Customers as a stored table after an upsert of names, an update of balances and a delete."""
    t = StoredTable(spark, shared_folder(spark, "stored"), StructType.fromDDL("id long, name string, balance double, updated_at timestamp"), "id", 16)
    t.create(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(None).cast("timestamp").alias("updated_at")))
    t.upsert(table(spark, d, "supplier").select((F.col("s_suppkey") * 13 % 2000).alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq")), "seq", ad.as_of())
    t.update(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("balance")), at=ad.as_of())
    t.delete(table(spark, d, "nation").select((F.col("n_nationkey") * 7).cast("long").alias("id")))
    return t


STORED = f"""s0 AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS updated FROM customer), w1 AS (SELECT s_suppkey * 13 % 2000 AS id, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1),
s1 AS (SELECT coalesce(s0.id, w1.id) AS id, coalesce(w1.name, s0.name) AS name, balance, CASE WHEN w1.id IS NOT NULL THEN '{ad.AS_OF}' ELSE updated END AS updated FROM s0 FULL JOIN w1 ON w1.id = s0.id),
s2 AS (SELECT s1.id, s1.name, CASE WHEN p_partkey IS NULL THEN balance WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS balance, CASE WHEN p_partkey IS NOT NULL THEN '{ad.AS_OF}' ELSE updated END AS updated FROM s1 LEFT JOIN part ON p_partkey = s1.id),
s3 AS (SELECT * FROM s2 WHERE id NOT IN (SELECT n_nationkey * 7 FROM nation))"""


@query(f"WITH {STORED} SELECT * FROM s3")
def stored_contacts(spark, d):
    """A stored table after writes of all kinds, as read from its files."""
    return _stored_contacts(spark, d).read().select("id", "name", "balance", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(f"WITH {STORED} SELECT event_id AS id, user_id AS contact, event_type AS kind FROM events WHERE user_id NOT IN (SELECT n_nationkey * 7 FROM nation)")
def stored_cascade(spark, d):
    """A stored log after its records' contacts were deleted."""
    t = StoredTable(spark, shared_folder(spark, "stored"), StructType.fromDDL("id long, contact long, kind string"), "id", 16)
    t.create(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("contact"), F.col("event_type").alias("kind")))
    t.delete_where_parent_in("contact", table(spark, d, "nation").select((F.col("n_nationkey") * 7).cast("long").alias("gone")))
    return t.read()


@query("""SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name) AS id, s_name AS name FROM supplier""")
def inserted_ids(spark, d):
    """New rows with the ids that they get after those of a table."""
    return insert_with_ids(table(spark, d, "supplier").select(F.col("s_name").alias("name")), table(spark, d, "customer"), "c_custkey", ["name"]).withColumnRenamed("c_custkey", "id")


# --- files --------------------------------------------------------------------


@query("""WITH f AS (SELECT *, p_partkey % 3 AS file, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' "' || p_size || '", x' END AS n FROM part)
SELECT file, p_partkey AS id, n AS name, p_type AS channel, CASE WHEN file <> 2 THEN p_brand END AS organization, n <> '' AND p_type <> 'SMALL' AS valid, CASE WHEN file = 0 THEN 'a|b' END AS focus_areas FROM f""")
def csv_folder(spark, d):
    """Rows of many files, each with a header of its own: other orders, other columns, capitals, and a name twice."""
    return _csv_rows(spark, d).select("file", F.col("website").cast("long").alias("id"), "name", "channel", "organization", "valid", F.array_join("focus_areas", "|").alias("focus_areas"))


@query("""WITH f AS (SELECT *, p_partkey % 3 AS file, p_partkey % 11 <> 0 AND p_type <> 'SMALL' AS valid FROM part) SELECT file, count(*) FILTER (WHERE valid) AS imported, count(*) FILTER (WHERE NOT valid) AS errors FROM f GROUP BY file""")
def csv_folder_counts(spark, d):
    return import_counts(_csv_rows(spark, d))


def _csv_rows(spark, d) -> DataFrame:
    root, k = shared_folder(spark, "csv"), F.col("p_partkey")
    p = table(spark, d, "part").select("*", F.when(k % 11 == 0, "").otherwise(F.concat("p_name", F.lit(' "'), F.col("p_size").cast("string"), F.lit('", x'))).alias("n"))
    save = lambda part, columns: p.where(k % 3 == part).select(*columns).write.option("header", True).option("escape", '"').option("quoteAll", part == 0).csv(f"{root}/{part}")
    save(0, [F.col("n").alias("name"), F.col("p_type").alias("channel"), F.col("p_brand").alias("organization"), F.lit(" a, b,").alias("focus_areas"), k.alias("website")])
    save(1, [k.alias(" WEBSITE"), F.col("p_brand").alias("Organization "), F.col("p_type").alias("Channel"), F.col("n").alias("NAME"), F.lit("x").alias("other")])
    save(2, [F.lit("no").alias("name"), F.col("p_type").alias("channel"), F.col("n").alias("Name "), k.alias("website")])
    rows = read_csv_files(spark, [f"{root}/{i}" for i in range(3)], ["name", "channel", "organization", "website", "focus_areas"])
    known = [t for t in ("ECONOMY", "STANDARD", "MEDIUM", "LARGE", "PROMO")]
    return checked_import(rows.withColumn("file", F.regexp_extract("file", r"/([0-2])/[^/]*$", 1)), known).withColumn("file", F.col("file").cast("int"))


@query("""SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS areas, CASE c_custkey % 3 WHEN 2 THEN c_nationkey WHEN 1 THEN 0 ELSE 0 END AS score FROM customer WHERE c_nationkey < 20""")
def versioned_profiles(spark, d):
    """Rows written under three versions of a schema, read as the newest: a text became a list, a name changed, a column came and one went."""
    first = StructType.fromDDL("id long, name string, area string, nation int, old string")
    t = VersionedTable(spark, shared_folder(spark, "versions"), first, [
        [Retyped("area", "array<string>", "CASE WHEN area IS NOT NULL THEN array(area) END"), Renamed("name", "title")],
        [Renamed("area", "areas"), Added("score", "int", "0"), Dropped("old")],
    ])
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("area"), F.col("c_nationkey").alias("nation"), F.lit("x").alias("old"))
    as_list = F.when(F.col("area").isNotNull(), F.array("area"))
    t.write(c.where("id % 3 = 0"), 0)
    t.write(c.where("id % 3 = 1").withColumns({"area": as_list, "title": F.col("name")}), 1)
    t.write(c.where("id % 3 = 2").withColumns({"areas": as_list, "title": F.col("name"), "score": F.col("nation")}))
    return t.read().where("nation < 20").select("id", "title", F.array_join("areas", ",").alias("areas"), "score")


# --- patterns -----------------------------------------------------------------

PATTERN = """CASE s_suppkey % 8 WHEN 0 THEN 'customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHEN 1 THEN '%0' || (s_suppkey % 100) WHEN 2 THEN 'CUSTOMER#00000_' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') WHEN 3 THEN '%_' || (s_suppkey % 30) || '%'
  WHEN 4 THEN repeat('_', CAST(12 + s_suppkey % 12 AS INTEGER)) WHEN 5 THEN 'nobody%' || s_suppkey WHEN 6 THEN repeat('_', CAST(10 + s_suppkey % 12 AS INTEGER)) || '%' ELSE '%TOMER#%' || s_suppkey || '%' END"""


@query(f"""WITH p AS (SELECT s_suppkey AS id, {PATTERN} AS pattern FROM supplier) SELECT p.id, count(c_custkey) AS matches, min(c_custkey) AS first, CASE WHEN count(c_custkey) = 1 THEN min(c_custkey) END AS only FROM p LEFT JOIN customer ON c_name ILIKE pattern GROUP BY p.id""")
def pattern_lookup(spark, d):
    """Each pattern with how many customers' names match it, the first of them, and the only one if it is that."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(PATTERN.replace("VARCHAR", "STRING")).alias("pattern"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return lookalike.looked_up(rows, "pattern", names).select("id", "matches", "first", "only")


# --- budgets ------------------------------------------------------------------


@query("""WITH t AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, n FROM s WHERE before < 5000""")
def budgeted_days(spark, d):
    """Whole days in order until 5,000 orders are reached; the day that reaches them counts whole."""
    days = table(spark, d, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    return stages.budgeted(days, "n", ["o_orderdate"], 5000).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "n")


@query("""WITH s AS (SELECT o_orderkey, coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) SELECT o_orderkey AS id, before::BIGINT AS cents_before FROM s WHERE before < 100000000000""")
def budgeted_orders(spark, d):
    """Orders, the newest first, until a thousand million is reached."""
    from tidewell.operators.ordering import sums_before

    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    out = sums_before(o, ["-o_orderdate", "o_orderkey"], F.col("cents"), "cents_before").where(F.col("cents_before") < 100_000_000_000)
    return out.select(F.col("o_orderkey").alias("id"), "cents_before")


# --- streams ------------------------------------------------------------------

ALLOWED = [("view", "click"), ("click", "view"), ("click", "signup"), ("view", "signup"), ("signup", "click")]
TERMINAL, QUIET_S, DELAY_S = ["purchase", "error"], 3 * 86400, 3600


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (
  SELECT user_id, i, event_type AS status, us, 1 AS steps FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, CASE WHEN ok THEN e.event_type ELSE f.status END, CASE WHEN ok THEN e.us ELSE f.us END, f.steps + CAST(ok AS INTEGER)
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1, LATERAL (SELECT f.status NOT IN ('purchase', 'error') AND (f.status, e.event_type) IN ({", ".join(str(a) for a in ALLOWED)}) AS ok) g
), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS rn FROM f)
SELECT user_id AS run_id, CASE WHEN quiet THEN 'error' ELSE status END AS status, steps + CAST(quiet AS INTEGER) AS steps FROM t, LATERAL (SELECT status NOT IN ('purchase', 'error') AND us // 1000 + {QUIET_S * 1000} < (SELECT max(epoch_us(ts)) // 1000 FROM events) - {DELAY_S * 1000} AS quiet) q WHERE rn = 1""")
def run_states(spark, d):
    """Runs after a stream of their events: each moves along allowed transitions, and one without news for three days ends in an error."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[e]vents.parquet")  # a pattern, as the table may be one file
    stream = events.select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    root = shared_folder(spark, "runs")
    q = runs.start_runs(stream, f"{root}/out", f"{root}/checkpoint", ALLOWED, TERMINAL, QUIET_S, f"{DELAY_S} seconds")
    q.awaitTermination()
    return runs.current_runs(spark, f"{root}/out").select("run_id", "status", "steps")


# --- memory and evidence --------------------------------------------------------


@query("""WITH c AS (SELECT o_custkey AS k, o_orderdate AS at, arg_max(o_orderpriority, o_orderkey) AS stage FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), t AS (SELECT o_custkey AS k, o_orderdate AS at, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F')
SELECT t.id, t.k AS prospect, c.stage AS stage_then, strftime(c.at, '%Y-%m-%d') AS entered FROM t ASOF LEFT JOIN c ON t.k = c.k AND t.at >= c.at""")
def touches_by_stage(spark, d):
    """Each touch of a record with the stage in which it was then."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("prospect_id"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"), "o_orderpriority", "o_orderstatus")
    touches = o.where("o_orderstatus <> 'F'").select("id", "prospect_id", "occurred_at")
    changes = o.where("o_orderstatus = 'F'").select("id", "prospect_id", F.col("o_orderpriority").alias("to_stage"), F.col("occurred_at").alias("created_at"))
    out = memory.with_state_then(touches, changes)
    return out.select("id", F.col("prospect_id").alias("prospect"), "stage_then", F.date_format("entered_at", "yyyy-MM-dd").alias("entered"))


@query(sql("""@t AS (SELECT 'stage' AS kind, prospect_id, id, created_at AS happened, to_stage AS what FROM v_log UNION ALL SELECT 'interaction', o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders UNION ALL SELECT 'contact', id, id, TIMESTAMP '2023-01-01', name FROM v_contacts)
SELECT kind, prospect_id, id, strftime(happened, '%Y-%m-%d %H:%M:%S') AS happened, what, row_number() OVER (PARTITION BY prospect_id ORDER BY happened DESC, kind, id) AS place FROM t"""))
def unified_timeline(spark, d):
    """Everything that happened to each record, newest first, with its place."""
    from tidewell.operators.ordering import numbered

    log = ad.log(spark, d).select("prospect_id", "id", F.col("created_at").alias("at"), F.col("to_stage").alias("what"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("prospect_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("what"))
    c = ad.contacts(spark, d).select(F.col("id").alias("prospect_id"), "id", F.lit("2023-01-01").cast("timestamp").alias("at"), F.col("name").alias("what"))
    t = numbered(memory.timeline({"stage": log, "interaction": o, "contact": c}), ["prospect_id", "-at", "kind", "id"], "_n")
    first = t.groupBy(F.col("prospect_id").alias("_p")).agg(F.min("_n").alias("_first"))
    return t.join(first, F.col("prospect_id") == F.col("_p")).select("kind", "prospect_id", "id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("happened"), "what", (F.col("_n") - F.col("_first") + 1).alias("place"))


@query(f"""WITH o AS (SELECT event_id AS id, user_id AS prospect_id, CASE event_type WHEN 'error' THEN 'no' WHEN 'purchase' THEN 'yes' WHEN 'view' THEN 'defer' END AS result, ts, CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) AS revisit_on FROM events WHERE event_type IN ('error', 'purchase', 'view'))
SELECT prospect_id, id, strftime(revisit_on, '%Y-%m-%d') AS revisit_on, date_diff('day', revisit_on, DATE '{ad.AS_OF}') AS days_due FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY ts DESC, id DESC) AS rn FROM o) WHERE rn = 1 AND result = 'no' AND revisit_on <= DATE '{ad.AS_OF}'""")
def revisit_list(spark, d):
    """Refusals that are due to be looked at again and that nothing later supersedes."""
    kind = F.when(F.col("event_type") == "error", "no").when(F.col("event_type") == "purchase", "yes").when(F.col("event_type") == "view", "defer")
    at = F.col("ts").cast("timestamp")
    o = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("prospect_id"), kind.alias("result"), at.alias("created_at"), F.date_add(at.cast("date"), (F.col("event_id") % 5).cast("int")).alias("revisit_on"))
    due = memory.revisit_due(o.where("result is not null"), ad.as_of())
    return due.select("prospect_id", "id", F.date_format("revisit_on", "yyyy-MM-dd").alias("revisit_on"), "days_due")


@query(r"""WITH i AS (SELECT doc_id AS item_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS level, list_distinct(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) AS has FROM documents),
f AS (SELECT item_id AS draft_id, CASE item_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS may, list_filter(list_distinct(string_split_regex(lower(text), '[^a-z]+')[1:3]), lambda x: x <> '') AS wants FROM benchmark)
SELECT draft_id, i.item_id FROM f JOIN i ON level < 4 AND level <= may AND list_has_all(has, wants) WHERE len(wants) > 0""")
def evidence_picker(spark, d):
    """For each draft the items that its audience may see and that have all its tags: here documents, whose words are tags, and benchmark items."""
    words = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+")
    permission = F.element_at(F.array(*[F.lit(p) for p in evidence.PERMISSIONS]), (F.col("doc_id") % 4 + 1).cast("int"))
    items = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), permission.alias("permission"), F.array_distinct(words(F.col("text"))).alias("tags"))
    audience = F.when(F.col("item_id") % 4 == 1, "partners_only").when(F.col("item_id") % 4 == 2, "internal").otherwise("public")
    drafts = table(spark, d, "benchmark").select(F.col("item_id").alias("draft_id"), audience.alias("audience"), arrays.filled(F.slice(words(F.col("text")), 1, 3)).alias("tags"))
    return evidence.selectable(drafts, items)


# --- pages ----------------------------------------------------------------------


@query("""WITH docs AS (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) GROUP BY 1)
SELECT c_custkey AS id, (2 + CAST(k % 3 <> 0 AS INT) + CAST(k % 5 <> 0 AS INT) + CAST(floor(c_acctbal) <> 0 AS INT) + CAST(k % 6 <> 0 AS INT) + CAST(k % 7 <> 0 AS INT) + CAST(k % 8 <> 0 AS INT) + CAST(k % 3 <> 0 AS INT) + CAST(k % 4 <> 0 AS INT) + CAST(k % 5 <> 0 AS INT)
  + CAST(k % 7 <> 0 AS INT) + CAST(k % 4 <> 0 AS INT) + CAST(k % 3 <> 0 AS INT) + CAST(k % 5 <> 0 AS INT) + CAST(k % 6 <> 0 AS INT) + CAST(k % 5 <> 0 AS INT)) / 17.0::DOUBLE AS share,
  concat_ws('|', CASE WHEN k % 8 <> 0 AND k % 7 <> 0 THEN 'mission' END, CASE WHEN floor(c_acctbal) <> 0 AND k % 6 <> 0 THEN 'financial' END, CASE WHEN k % 7 <> 0 THEN 'people' END, CASE WHEN k % 4 <> 0 THEN 'geography' END, CASE WHEN k % 6 <> 0 THEN 'track_record' END) AS complete,
  coalesce(n, 0) AS documents, newest, c_custkey = (SELECT min(c_custkey) FROM customer) AS shown_first FROM (SELECT *, c_custkey AS k FROM customer) LEFT JOIN docs ON o_custkey = c_custkey""")
def organization_page(spark, d):
    """The page of every organization: how complete its profile is, which sections are, its three newest documents, and whether it is the table's first row, which a page without an id shows."""
    p = _profiles(spark, d)
    sections = F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in profile.health(p).items()])
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("doc"))
    newest = lookups.newest_list(o, "owner", "doc", ["at", "doc"], 3)
    least = table(spark, d, "customer").agg(F.min("c_custkey").alias("_least"))
    page = p.select("id", profile.completeness(p).alias("share"), sections.alias("complete")).join(newest, F.col("id") == F.col("owner"), "left").crossJoin(F.broadcast(least))  # one row
    return page.select("id", "share", "complete", F.coalesce("total", F.lit(0)).alias("documents"), F.array_join("newest", ",").alias("newest"), (F.col("id") == F.col("_least")).alias("shown_first"))
