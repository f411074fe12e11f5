"""More queries: single rows, imports, reviews, and whole screens. They join those of ``tidewell.plans.queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import arrays, dates, labels, numbers, text
from tidewell.operators import contacts, latest, lifecycle, lookups, ordering, screening, searches, stages
from tidewell.plans import adapters as ad
from tidewell.plans.adapters import sql
from tidewell.plans.queries import APPLIED, FIELDS, GREEDY, HEALTH, KEY, LATEST, SAME, WRITES, _channels, _profiles, _stages, _writes, query
from tidewell.sources.scratch import kept, shared_folder
from tidewell.sources.tables import checked_import, read_csv_rows, table

#: Fixed values of these tables: a colour for each stage but one, and what the channels are.
COLORS = [("view", "#64748b"), ("click", "#2563eb"), ("signup", "#7c3aed"), ("purchase", "#059669"), ("error", "#dc2626")]
EVALUATION = "struct<channel:string,recommended:boolean,confidence:string>"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- single rows ------------------------------------------------------------


@query(sql("""@r AS (SELECT s_suppkey AS request, 'user' || s_suppkey || '@x.org' AS address FROM supplier), k AS (SELECT email, count(*) AS n, min(id) AS v FROM v_contacts WHERE email IS NOT NULL GROUP BY email)
SELECT request, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN v END AS single, coalesce(n, 0) <> 1 AS single_error, CASE WHEN n = 1 THEN v END AS maybe, coalesce(n, 0) > 1 AS maybe_error FROM r LEFT JOIN k ON k.email = r.address"""))
def point_lookups(spark, d):
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request"), F.concat(F.lit("user"), F.col("s_suppkey").cast("string"), F.lit("@x.org")).alias("address"))
    return lookups.counted_matches(asked, "address", ad.contacts(spark, d).where("email is not null"), "email", "id").drop("address")


@query(sql("SELECT id, name, status FROM v_candidates ORDER BY id LIMIT 1"))
def singleton_read(spark, d):
    return lookups.singleton(ad.candidates(spark, d)).select("id", "name", "status")


@query(sql("""SELECT 'present' AS kind, id, 15 AS threshold, NULL::VARCHAR AS organization, name, status FROM v_candidates WHERE id = (SELECT min(id) FROM v_candidates) UNION ALL SELECT 'absent', 1, 20, NULL, NULL, NULL"""))
def singleton_upsert(spark, d):
    """A write of two columns to a row of five, and to none."""
    row = lambda threshold: spark.createDataFrame([(1, threshold, None)], "id long, threshold int, organization string")
    c = ad.candidates(spark, d).select(F.col("id").cast("long").alias("id"), F.lit(0).alias("threshold"), "organization", "name", "status")
    present, absent = lifecycle.singleton_upsert(c, row(15)), lifecycle.singleton_upsert(c.where("false"), row(20))
    return _union([present.select(F.lit("present").alias("kind"), "*"), absent.select(F.lit("absent").alias("kind"), "*")])


@query("""WITH hit AS (SELECT l_orderkey AS search, arg_min(l_partkey, (l_linenumber, l_partkey)) AS k FROM lineitem GROUP BY 1) SELECT search, p_partkey AS part, p_brand AS brand FROM hit LEFT JOIN part ON p_partkey = k""")
def best_effort_lookup(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("search"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("part"))
    details = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    return lookups.top_hit_details(hits, details, "search", "rank", "part")


# --- writes -----------------------------------------------------------------


@query(sql("""SELECT id, name, status, source, id >= 10000000 AS added FROM (SELECT id, name, status, NULL AS source FROM v_candidates UNION ALL SELECT 10000000 + s_suppkey, s_name, 'pending', 'form' FROM supplier)"""))
def batch_insert(spark, d):
    """Candidates after a batch of new ones, with the ids that they got."""
    new = table(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("id"), F.col("s_name").alias("name"), F.lit("pending").alias("status"), F.lit("form").alias("source"))
    old = ad.candidates(spark, d).select("id", "name", "status", F.lit(None).cast("string").alias("source"))
    return old.unionByName(new).withColumn("added", F.col("id") >= 10_000_000)


@query(sql(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'dismissed' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'r' || id END ELSE organization END AS organization, CASE WHEN id % 3 = 0 THEN '{ad.AS_OF}' END AS updated FROM v_candidates"))
def keyed_update(spark, d):
    c = ad.candidates(spark, d).select("id", "status", "organization")
    changes = c.where("id % 3 = 0").select("id", F.lit("dismissed").alias("status"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("r"), F.col("id").cast("string"))).alias("organization"))
    return lifecycle.updated(c, changes, "id", ad.as_of()).select("id", "status", "organization", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(sql("""@w AS (SELECT ein, arg_max(name, seq) AS name FROM (SELECT (s_suppkey * 7) % 60 AS ein, s_suppkey AS seq, s_name AS name FROM supplier) GROUP BY ein)
SELECT coalesce(w.ein, c.ein) AS ein, coalesce(w.name, c.name) AS name FROM (SELECT id AS ein, name FROM v_candidates) c FULL JOIN w ON w.ein = c.ein"""))
def cache_upsert(spark, d):
    cache = ad.candidates(spark, d).select(F.col("id").alias("ein"), "name")
    writes = table(spark, d, "supplier").select((F.col("s_suppkey") * 7 % 60).alias("ein"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    return lifecycle.last_write_wins(cache, writes, "ein", "seq")


BACKFILL = """src AS (SELECT 1 AS priority, id, CASE WHEN id % 5 = 0 THEN '  ' ELSE name END AS contact_name, CASE WHEN id % 3 <> 0 THEN ' User' || (id % 500) || '@x.org' END AS contact_email, organization FROM v_prospects
  UNION ALL SELECT 2, id, name, CASE WHEN id % 2 = 0 THEN 'user' || (id % 900) || '@x.org ' END, organization FROM v_candidates),
n AS (SELECT priority, id, coalesce(nullif(trim(contact_name), ''), lower(trim(contact_email))) AS name, nullif(lower(trim(contact_email)), '') AS email, organization FROM src WHERE coalesce(nullif(trim(contact_name), ''), nullif(trim(contact_email), '')) IS NOT NULL)"""


@query(sql(f"""@{BACKFILL} SELECT priority, id, name, email, organization FROM (SELECT *, CASE WHEN email IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY email ORDER BY priority, id) END AS rn FROM n)
WHERE rn = 1 AND (email IS NULL OR email NOT IN (SELECT email FROM v_contacts WHERE email IS NOT NULL))"""))
def contact_backfill_on_conflict(spark, d):
    """New contacts of prospects and candidates whose address the directory lacks."""
    i = F.col("id")
    p = ad.prospects(spark, d).select(F.lit(1).alias("priority"), "id", F.when(i % 5 == 0, "  ").otherwise(F.col("name")).alias("contact_name"), F.when(i % 3 != 0, F.concat(F.lit(" User"), (i % 500).cast("string"), F.lit("@x.org"))).alias("contact_email"), "organization")
    c = ad.candidates(spark, d).select(F.lit(2).alias("priority"), "id", F.col("name").alias("contact_name"), F.when(i % 2 == 0, F.concat(F.lit("user"), (i % 900).cast("string"), F.lit("@x.org "))).alias("contact_email"), "organization")
    return contacts.backfilled(p.unionByName(c), ad.contacts(spark, d))


@query(sql(f"@{APPLIED} SELECT id, 2 AS runs, 2 AS latest_run, CASE WHEN channel = 'BUILDING' THEN 2 ELSE tier END AS latest_tier, score AS first_score FROM tiered"))
def screening_snapshots(spark, d):
    """Each run appends a result for every prospect; the newest result counts. The second run lacks the rules that apply to BUILDING."""
    p = ad.prospects(spark, d)
    first = screening.screened(p, ad.rules(spark), FIELDS, keep=("channel",)).select("id", "score", "tier", F.lit(1).alias("run"))
    again = screening.screened(p.where("not (channel <=> 'BUILDING')"), ad.rules(spark), FIELDS).unionByName(screening.screened(p.where("channel <=> 'BUILDING'"), ad.rules(spark).where("false"), FIELDS))
    log = first.unionByName(again.select("id", "score", "tier", F.lit(2).alias("run")))
    newest = F.max_by(F.struct("run", "tier"), "run")
    return log.groupBy("id").agg(F.count(F.lit(1)).alias("runs"), newest["run"].alias("latest_run"), newest["tier"].alias("latest_tier"), F.min_by("score", "run").alias("first_score"))


# --- imports ----------------------------------------------------------------


IMPORTED = ["name", "channel", "organization", "website", "contact_name", "contact_email", "location", "funder_type", "geographic_focus", "typical_grant_size", "focus_areas"]


def _imported(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.split("p_type", " "), 1)
    number = lambda word: F.concat(F.lit(word), k.cast("string"))
    cells = [
        F.when(k % 11 == 0, "").otherwise(F.col("p_name")), F.when(k % 5 == 0, F.lower(kind)).otherwise(kind), F.when(k % 3 != 0, F.col("p_brand")).otherwise(""), F.when(k % 2 == 0, number("w")).otherwise(""),
        F.when(k % 4 == 0, number("Person ")).otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("User"), (k % 500).cast("string"), F.lit("@X.org"))).otherwise(""), F.lit("Here"), F.when(k % 7 == 0, "Fund").otherwise(""),
        F.lit(""), F.when(k % 2 == 1, F.lit('"$5,000"')).otherwise(""), F.when(k % 2 == 0, '" a, b,"').otherwise(""),
    ]
    rows = read_csv_rows(table(spark, d, "part").select(k.alias("id"), F.concat_ws(",", *cells).alias("value")), ",".join(IMPORTED), IMPORTED)
    known = ["ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE"]
    return checked_import(rows.withColumn("raw", F.to_json(F.struct(*IMPORTED))), known)


IMPORT = """imp AS (SELECT *, name <> '' AND channel IN ('ECONOMY', 'SMALL', 'STANDARD', 'MEDIUM', 'LARGE') AS valid FROM (
  SELECT k AS id, CASE WHEN k % 11 = 0 THEN '' ELSE p_name END AS name, CASE WHEN k % 5 = 0 THEN lower(split_part(p_type, ' ', 1)) ELSE split_part(p_type, ' ', 1) END AS channel, CASE WHEN k % 3 <> 0 THEN p_brand ELSE '' END AS org,
    CASE WHEN k % 2 = 0 THEN 'w' || k ELSE '' END AS website, CASE WHEN k % 4 = 0 THEN 'Person ' || k ELSE '' END AS contact_name, CASE WHEN k % 3 = 1 THEN 'User' || (k % 500) || '@X.org' ELSE '' END AS contact_email, CASE WHEN k % 7 = 0 THEN 'Fund' ELSE '' END AS funder_type,
    CASE WHEN k % 2 = 1 THEN '$5,000' ELSE '' END AS grant_size, CASE WHEN k % 2 = 0 THEN 'a, b,' ELSE '' END AS areas FROM (SELECT *, p_partkey AS k FROM part)))"""


@query(sql(f"@{IMPORT} SELECT count(*) FILTER (WHERE valid) AS imported, count(*) FILTER (WHERE NOT valid) AS errors FROM imp"))
def csv_import_counts(spark, d):
    return _imported(spark, d).agg(F.count_if("valid").alias("imported"), F.count_if(~F.col("valid")).alias("errors"))


@query(sql(f"""@{IMPORT} SELECT id, name, channel, nullif(org, '') AS organization, nullif(website, '') AS website, nullif(contact_name, '') AS contact_name, nullif(contact_email, '') AS contact_email, 'Here' AS location, nullif(funder_type, '') AS funder_type, NULL::VARCHAR AS geographic_focus,
  nullif(grant_size, '') AS typical_grant_size, CASE WHEN areas <> '' THEN 'a|b' END AS focus_areas, 'csv_import' AS source, '{{"name":"' || name || '","channel":"' || channel || '","organization":"' || org || '","website":"' || website || '","contact_name":"' || contact_name || '","contact_email":"' || contact_email
  || '","location":"Here","funder_type":"' || funder_type || '","geographic_focus":"","typical_grant_size":"' || grant_size || '","focus_areas":"' || areas || '"}}' AS raw, 'pending' AS status, CASE WHEN org <> '' THEN 1 ELSE 3 END AS suggested_tier FROM imp WHERE valid"""))
def csv_import_rows(spark, d):
    """The candidates that an import adds, with all fields, screened, each with its raw row."""
    good = _imported(spark, d).where("valid")
    rule = spark.createDataFrame([(1, 1, "Has an organization", None, 5, "organization", "is_set", None, True)], "rule_id int, ord int, label string, channel string, weight int, field string, operator string, value string, active boolean")
    out = screening.screened(good, rule, FIELDS, keep=(*IMPORTED, "raw"))
    return out.select("id", *IMPORTED[:-1], F.array_join("focus_areas", "|").alias("focus_areas"), F.lit("csv_import").alias("source"), "raw", F.lit("pending").alias("status"), F.col("tier").alias("suggested_tier"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5::DOUBLE END AS amount, CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS note FROM part""")
def form_values(spark, d):
    """Texts of a form as values: garbage isn't a number, and an empty text is null."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    typed = F.when(k % 4 == 0, size).when(k % 4 == 1, F.concat(size, F.lit(".5"))).when(k % 4 == 2, F.concat(size, F.lit("k"))).otherwise("")
    return table(spark, d, "part").select(k.alias("id"), numbers.number(typed).alias("amount"), text.null_if_empty(F.when(k % 4 == 3, "").otherwise(F.col("p_name"))).alias("note"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS n, CASE c_custkey % 5 WHEN 0 THEN 'https://a' || c_custkey || '.org|http://b.org' WHEN 1 THEN '' END AS urls, CASE WHEN c_custkey % 5 = 0 THEN 'x' END AS named FROM customer""")
def json_lists(spark, d):
    """Lists of structs from JSON: a bad or missing list is empty, an empty one is stored as null, and links get a scheme."""
    k = F.col("c_custkey")
    two = F.concat(F.lit('[{"name":"x","url":" a'), k.cast("string"), F.lit('.org"},{"name":"","url":"http://b.org"}]'))
    raw = F.when(k % 5 == 0, two).when(k % 5 == 1, '[{"name":"","url":""}]').when(k % 5 == 2, "[]").when(k % 5 == 3, "not json")
    links = arrays.null_if_none(arrays.with_links(arrays.json_list(raw, "struct<name:string,url:string>")))
    rows = table(spark, d, "customer").select(k.alias("id"), links.alias("l"))
    names = F.transform(arrays.named_only(F.col("l")), lambda x: x["name"])
    return rows.select("id", F.when(F.col("l").isNotNull(), F.size("l")).alias("n"), F.array_join(F.transform("l", lambda x: x["url"]), "|").alias("urls"), text.null_if_empty(F.array_join(names, "|")).alias("named"))


@query("""SELECT n_regionkey AS id, '[' || string_agg('{"name":"' || n_name || '","location":null}', ',' ORDER BY n_nationkey) || ']' AS built FROM nation GROUP BY 1""")
def json_array_build(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))
    built = F.transform("a", lambda x: F.struct(x["n_name"].alias("name"), F.lit(None).cast("string").alias("location")))
    return n.select("id", F.to_json(built, {"ignoreNullFields": "false"}).alias("built"))


# --- parameters, labels, texts ----------------------------------------------


@query(sql("""SELECT 'both' AS kind, count(*) AS n FROM v_prospects WHERE contains(lower(name), '#0000') AND channel = 'BUILDING' UNION ALL SELECT 'name', count(*) FROM v_prospects WHERE contains(lower(name), '12')
UNION ALL SELECT 'channel', count(*) FROM v_prospects WHERE channel = 'FURNITURE' UNION ALL SELECT 'neither', count(*) FROM v_prospects"""))
def list_filters(spark, d):
    p = ad.prospects(spark, d)
    asked = {"both": ("#0000", "BUILDING"), "name": (" 12 ", None), "channel": ("", "FURNITURE"), "neither": (None, None)}
    return _union([stages.listed(p, q, c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, (q, c) in asked.items()])


@query(sql("SELECT to_stage AS asked, CASE WHEN to_stage IN ('view', 'click') THEN to_stage ELSE 'view' END AS tab, to_stage IN ('signup', 'click') AS running, count(*) AS n FROM v_log GROUP BY ALL"))
def tab_whitelist(spark, d):
    s = F.col("to_stage")
    return ad.log(spark, d).groupBy(s.alias("asked"), labels.listed_or(s, ["view", "click"], "view").alias("tab"), s.isin("signup", "click").alias("running")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT id, CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLORS) + " END AS color FROM v_prospects"))
def stage_colors(spark, d):
    dim = spark.createDataFrame(COLORS, "stage string, color string")
    return ad.prospects(spark, d).join(F.broadcast(dim), "stage", "left").select("id", "color")  # a fixed list


@query(sql("SELECT string_agg('- ' || value || ': ' || label || ' -- ' || n || ' customers', chr(10) ORDER BY ord) AS text FROM v_segments"))
def channel_list_text(spark, d):
    """The list of the customers' segments as a text, with how many each has."""
    return labels.described(ad.segments(spark, d).withColumn("description", F.concat(F.col("n").cast("string"), F.lit(" customers"))))


@query("""SELECT p_partkey AS id, replace(p_name, ' ', '%20') || '%3F%26''()!~*%2F' AS asked, CASE WHEN p_name = '' THEN '?' ELSE upper(substr(split_part(p_name, ' ', 1), 1, 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) END AS initials FROM part""")
def url_queries(spark, d):
    s = F.col("p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.url_query(F.concat(s, F.lit("?&'()!~*/"))).alias("asked"), text.initials(s, r"\s+").alias("initials"))


@query(sql("SELECT value, row_number() OVER (ORDER BY md5('7:' || value)) AS place FROM (SELECT DISTINCT p_type AS value FROM part)"))
def nightly_order(spark, d):
    """The kinds of all parts in an order that looks random and follows from a seed; one row gathers them, as many as there are kinds."""
    kinds = table(spark, d, "part").select(F.col("p_type").alias("value")).distinct()
    one = kinds.agg(F.sort_array(F.collect_list(F.struct(F.md5(F.concat(F.lit("7:"), "value")).alias("h"), "value"))).alias("all"))
    return one.select(F.posexplode("all").alias("place", "x")).select("x.value", (F.col("place") + 1).alias("place"))


# --- reviews ----------------------------------------------------------------


@query("""SELECT c_custkey AS id, k % 4 = 1 OR k % 4 = 2 AND k % 3 <> 0 AS substance, CASE WHEN k % 4 = 1 OR k % 4 = 2 AND k % 3 <> 0 THEN 'ready_for_review' ELSE 'error' END AS status,
  CASE WHEN k % 4 = 1 THEN 2 ELSE 0 END AS points, CASE WHEN k % 5 <> 0 THEN 'Own' WHEN k % 4 = 1 THEN 'Found' END AS location, CASE WHEN k % 7 = 0 THEN 'Arts' WHEN k % 4 = 1 THEN 'Health|Youth' END AS focus_areas FROM (SELECT *, c_custkey AS k FROM customer)""")
def review_results(spark, d):
    """Results of unknown shape made safe, judged, merged with what is known, and copied back with null for what is empty."""
    k = F.col("c_custkey")
    raw = (
        F.when(k % 4 == 1, '{"strategy":{"outreach_approach":"call","key_talking_points":["a","b"]},"organization_intel":{"location":"Found","focus_areas":["Health","Youth"]}}')
        .when((k % 4 == 2) & (k % 3 != 0), '{"strategy":{"rationale":" why ","key_talking_points":"none"},"organization_intel":{"focus_areas":"Arts"}}')
        .when(k % 4 == 2, '{"strategy":{"rationale":"   "}}')
        .when(k % 4 == 3, "no json")
    )
    c = table(spark, d, "customer").select(k.alias("id"), raw.alias("raw"), F.when(k % 5 != 0, "Own").otherwise("").alias("own"), F.when(k % 7 == 0, F.array(F.lit("Arts"))).alias("areas"))
    found = lambda path: F.coalesce(arrays.json_text(F.col("raw"), path), F.lit(""))
    many = lambda path: F.coalesce(F.from_json(F.get_json_object("raw", path), "array<string>"), F.array().cast("array<string>"))
    out = c.select(
        "id", arrays.has_substance(found("$.strategy.outreach_approach"), found("$.strategy.ask_positioning"), found("$.strategy.rationale")).alias("substance"),
        F.size(arrays.filled(many("$.strategy.key_talking_points"))).alias("points"), text.null_if_empty(arrays.fill_gaps(F.col("own"), found("$.organization_intel.location"))).alias("location"),
        F.array_join(arrays.null_if_none(arrays.fill_list(F.col("areas"), arrays.filled(many("$.organization_intel.focus_areas")))), "|").alias("focus_areas"),
    )
    return out.withColumn("status", F.when(F.col("substance"), "ready_for_review").otherwise("error"))


@query(sql("""SELECT id, CASE WHEN id % 3 = 0 THEN 'purchase|signup' WHEN id % 2 = 0 THEN 'view|signup' ELSE 'signup|view' END AS recommended, CASE WHEN id % 5 = 0 THEN 'click' WHEN id % 3 = 0 THEN 'signup|purchase' ELSE 'view|signup' END AS selection FROM v_log"""))
def channel_evaluations(spark, d):
    """Of each run's evaluations the recommended ones, surest first, three at most, and what is selected before a review."""
    i = F.col("id")
    one = lambda channel, wanted, sure: F.struct(F.lit(channel).alias("channel"), wanted.alias("recommended"), sure.alias("confidence"))
    high, low = F.lit("high"), F.lit("low")
    evaluations = F.array(
        one("view", i % 3 != 0, F.when(i % 2 == 0, "high").otherwise("low")), one("click", F.lit(False), high), one("signup", F.lit(True), F.when((i % 3 != 0) & (i % 2 != 0), "high").otherwise("low")), one("purchase", i % 3 == 0, F.when(i % 3 == 0, high).otherwise(low)),
    ).cast(f"array<{EVALUATION}>")
    rows = ad.log(spark, d).select("id", evaluations.alias("e"), F.when(i % 5 == 0, F.array(F.lit("click"))).alias("approved"))
    first = F.transform(F.slice(arrays.high_confidence_first(F.col("e")), 1, 3), lambda e: e["channel"])
    return rows.select("id", F.array_join(first, "|").alias("recommended"), F.array_join(arrays.default_selection(F.col("approved"), F.col("e")), "|").alias("selection"))


# --- screens ----------------------------------------------------------------


@query(sql(f"""@{LATEST} SELECT 'ready' AS badge, count(*) AS n FROM latest WHERE to_stage = 'signup' AND approved IS NULL UNION ALL SELECT 'pending', count(*) FROM v_candidates WHERE status = 'pending'
UNION ALL SELECT 'stage ' || value, count(p.id) FROM v_stages LEFT JOIN v_prospects p ON p.stage = value GROUP BY value"""))
def sidebar_badges(spark, d):
    last = latest.latest_per_key(ad.log(spark, d), ["prospect_id"])
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("badge"), "n")
    by_stage = stages.zero_filled(_stages(spark).select("value"), ad.prospects(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "stage", {"n": 0})
    return _union([
        count(last.where((F.col("to_stage") == "signup") & F.col("approved").isNull()), "ready"), count(ad.candidates(spark, d).where(F.col("status") == "pending"), "pending"),
        by_stage.select(F.concat(F.lit("stage "), "value").alias("badge"), "n"),
    ])


PRIORITY = f"near AS (SELECT id, {HEALTH} AS health, next_action_due FROM (SELECT * FROM v_prospects WHERE next_action_due IS NOT NULL ORDER BY next_action_due, id LIMIT 10)), top AS (SELECT * FROM near WHERE health IN ('due_soon', 'stalled') ORDER BY next_action_due, id LIMIT 3)"


@query(sql(f"""@{LATEST}, {APPLIED.replace("v_prospects p", "(SELECT * FROM v_candidates WHERE status = 'pending') p")}, {PRIORITY}, a AS (SELECT stage, count(*) AS n, CAST(sum(CAST(coalesce(ask_amount, 0) AS DECIMAL(18, 2))) AS DOUBLE) AS potential FROM v_prospects GROUP BY stage), parts AS (
SELECT 'prospects' AS part, '' AS item, count(*)::DOUBLE AS value FROM v_prospects UNION ALL SELECT 'potential', '', CAST(sum(CAST(coalesce(ask_amount, 0) AS DECIMAL(18, 2))) AS DOUBLE) FROM v_prospects
UNION ALL SELECT 'pending', '', count(*) FROM v_candidates WHERE status = 'pending' UNION ALL SELECT 'ready', '', count(*) FROM latest WHERE to_stage = 'signup' AND approved IS NULL
UNION ALL SELECT 'due this week', '', count(*) FROM v_prospects WHERE next_action_due BETWEEN DATE '{ad.AS_OF}' AND DATE '{ad.AS_OF}' + 7 UNION ALL SELECT 'priority', CAST(id AS VARCHAR) || ' ' || health, 1 FROM top
UNION ALL SELECT 'stage', value, coalesce(n, 0) FROM v_stages LEFT JOIN a ON stage = value UNION ALL SELECT 'forecast', value, floor(100 * coalesce(potential, 0) / greatest(1, (SELECT max(potential) FROM a)) + 0.5) FROM v_stages LEFT JOIN a ON stage = value
UNION ALL (SELECT 'recommended', CAST(id AS VARCHAR), round(coalesce(share, -1), 6) FROM tiered ORDER BY coalesce(share, -1) DESC, id LIMIT 3) UNION ALL (SELECT 'recent', CAST(id AS VARCHAR), 1 FROM v_log WHERE to_stage <> 'error' ORDER BY created_at DESC, id DESC LIMIT 8)
UNION ALL (SELECT 'decided', CAST(id AS VARCHAR), 1 FROM v_candidates WHERE status <> 'pending' ORDER BY price DESC, id DESC LIMIT 8) UNION ALL SELECT 'settings', CAST(min(id) AS VARCHAR), 1 FROM v_candidates)
SELECT part, item, value::DOUBLE AS value FROM parts UNION ALL SELECT 'priority count', '', (SELECT count(*) FROM top) + (SELECT CAST(value > 0 AS INT) FROM parts WHERE part = 'ready') + (SELECT CAST(value > 0 AS INT) FROM parts WHERE part = 'pending')"""))
def dashboard(spark, d):
    """All parts of the first screen as rows of (part, item, value).

    Each table is read once for its sums and once for its first rows, of which a task passes on a few. The parts are written, a few dozen rows, as the count of
    priorities follows from them.
    """
    from pyspark.sql import Window

    p, c, log = ad.prospects(spark, d), ad.candidates(spark, d), ad.log(spark, d)
    today = F.lit(ad.AS_OF).cast("date")
    none, one = F.lit(""), F.lit(1)
    cell = lambda part, item, value: F.struct(F.lit(part).alias("part"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    rows = lambda df, *cells: df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")

    # prospects: one sum for each stage gives all totals
    money = F.sum(F.coalesce("ask_amount", F.lit(0.0)).cast("decimal(18,2)")).alias("m")
    by_stage = p.groupBy("stage").agg(F.count(one).alias("n"), money, F.count_if(F.col("next_action_due").between(today, F.date_add(today, 7))).alias("due"))
    sums = by_stage.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("due").alias("due"), F.max("m").alias("most"), F.collect_list(F.struct("stage", "n", "m")).alias("stages"))  # one row, as many cells as stages
    totals = rows(sums, cell("prospects", none, F.coalesce("n", F.lit(0))), cell("potential", none, F.col("m")), cell("due this week", none, F.coalesce("due", F.lit(0))))
    known = _stages(spark).select("value").crossJoin(F.broadcast(sums.select("stages", "most")))  # one row
    mine = F.get(F.filter("stages", lambda x: x["stage"] == F.col("value")), F.lit(0))
    shares = numbers.share_of_max(F.coalesce(mine["m"].cast("double"), F.lit(0.0)), F.coalesce(F.col("most").cast("double"), F.lit(0.0)))
    staged = rows(known, cell("stage", F.col("value"), F.coalesce(mine["n"], F.lit(0))), cell("forecast", F.col("value"), shares))
    top = stages.priorities(p, dates.health_status(F.col("next_action_due"), ad.as_of()))
    top = rows(top, cell("priority", F.concat_ws(" ", F.col("id").cast("string"), "health"), one))

    # candidates: sums, then the best pending ones and the last decided ones by one ranking
    counted = c.agg(F.count_if(F.col("status") == "pending").alias("n"), F.min("id").alias("first"))
    counted = rows(counted, cell("pending", none, F.col("n")), cell("settings", F.col("first"), one)).where("part <> 'settings' or item is not null")
    judged = screening.screened(c, ad.rules(spark), FIELDS, keep=("status", "price"))
    of = F.when(F.col("status") == "pending", "recommended").otherwise("decided")
    judged = judged.withColumn("part", of).withColumn("s", F.coalesce("share", F.lit(-1.0)))
    waits = F.col("part") == "recommended"
    judged = judged.withColumn("by", F.when(waits, F.col("s")).otherwise(F.col("price"))).withColumn("tie", F.when(waits, -F.col("id")).otherwise(F.col("id")))
    best = judged.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(F.col("by").desc(), F.col("tie").desc()))).where("rn <= 8").where(~waits | (F.col("rn") <= 3))
    best = best.select("part", F.col("id").cast("string").alias("item"), F.when(waits, F.round("s", 6)).otherwise(1.0).alias("value"))

    ready = latest.latest_per_key(log, ["prospect_id"]).agg(F.count_if((F.col("to_stage") == "signup") & F.col("approved").isNull()).alias("n"))
    recent = log.where(F.col("to_stage") != "error").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(8)
    parts = _union([totals, staged, top, counted, best, rows(ready, cell("ready", none, F.col("n"))), rows(recent, cell("recent", F.col("id"), one))])
    parts = kept(parts, shared_folder(spark, "dashboard"), "parts")
    flag = F.when(F.col("part") == "priority", 1).when(F.col("part").isin("ready", "pending") & (F.col("value") > 0), 1).otherwise(0)
    return parts.unionByName(rows(parts.agg(F.coalesce(F.sum(flag), F.lit(0)).alias("n")), cell("priority count", none, F.col("n"))))


@query(sql(f"""@{APPLIED.replace("v_prospects p", "(SELECT * FROM v_candidates) p")} SELECT c.status AS tab, t.id, t.share, t.tier, CASE WHEN t.share IS NULL THEN -1 ELSE t.share END AS sort_key FROM tiered t JOIN v_candidates c ON c.id = t.id
WHERE c.status <> 'accepted' AND (contains(lower(c.name), 'a') OR coalesce(contains(lower(c.organization), 'a'), false))"""))
def discovery_list(spark, d):
    """Every tab of the workspace after a search, the best first; candidates without a share come last."""
    c = ad.candidates(spark, d)
    hit = text.contains_ignoring_case(F.col("name"), F.lit("A")) | F.coalesce(text.contains_ignoring_case(F.col("organization"), F.lit("A")), F.lit(False))
    s = screening.screened(c.where(F.col("status").isin("pending", "saved", "dismissed") & hit), ad.rules(spark), FIELDS, keep=("status",))
    s = s.select(F.col("status").alias("tab"), "id", "share", "tier", F.coalesce("share", F.lit(-1.0)).alias("sort_key"))
    return s.orderBy("tab", F.col("sort_key").desc(), "id")


@query("""SELECT c_custkey AS id, CASE WHEN n IS NULL THEN 0 ELSE n END AS documents, newest FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) GROUP BY 1) ON o_custkey = c_custkey""")
def profile_documents(spark, d):
    """Each profile with how many documents it has and the three newest."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("doc"))
    newest = lookups.newest_list(o, "owner", "doc", ["at", "doc"], 3)
    return _profiles(spark, d).select("id").join(newest, F.col("id") == F.col("owner"), "left").select(
        "id", F.coalesce("total", F.lit(0)).alias("documents"), F.array_join("newest", ",").alias("newest"),
    )


def _searches(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What searches found (three batches over all customers), the known organizations, and the cache of filings."""
    k = F.col("c_custkey")
    text_of = lambda *parts: F.concat(*[p if isinstance(p, str) else p.cast("string") for p in parts])
    name = text_of(F.when(k % 5 == 0, "The ").otherwise(""), "c_mktsegment", F.lit(" "), k * 7 % 400)
    found = table(spark, d, "customer").select(
        k.alias("id"), k.alias("ord"), (F.col("c_nationkey") % 3).alias("batch"), F.col("c_mktsegment").alias("channel"), F.when(k % 9 == 4, "").otherwise(name).alias("name"),
        F.when(k % 4 == 0, text_of(F.lit("Org "), k % 97)).when(k % 4 == 1, "").alias("organization"), F.when(k % 6 == 0, "").otherwise(text_of(F.lit("w"), k)).alias("website"),
        F.when(k % 3 == 0, F.col("c_name")).alias("contact_name"), F.when(k % 2 == 0, text_of(F.lit(" U"), k % 40, F.lit("@X.org"))).alias("contact_email"),
        F.when(k % 7 == 0, "Here").otherwise("").alias("location"), F.when(k % 2 == 0, F.lit("fits")).alias("rationale"),
    )
    s = F.col("s_suppkey")
    known = table(spark, d, "supplier").select(text_of(F.lit("the Building "), s * 11 % 400).alias("name"), F.when(s % 10 == 0, text_of(F.lit("The org "), s)).alias("organization"))
    p = F.col("p_partkey")
    segment = F.element_at(F.array(*[F.lit(c) for c, _ in ad.CHANNELS[:5]]), (p % 5 + 1).cast("int"))
    raw = F.when(p % 3 == 0, '{"filings_with_data":[]}').otherwise(text_of(F.lit('{"filings_with_data":[{"totcntrbgfts":'), p * 1037, F.lit("}]}")))
    cache = table(spark, d, "part").select(p.alias("ein"), F.lower(text_of(segment, F.lit(" "), p % 400)).alias("name"), F.when(p % 4 == 0, "").otherwise(F.col("p_brand")).alias("city"), raw.alias("raw"))
    return found, known, cache


SEARCH = f"""found AS (SELECT c_custkey AS id, c_custkey AS ord, c_nationkey % 3 AS batch, c_mktsegment AS channel,
  CASE WHEN c_custkey % 9 = 4 THEN '' ELSE CASE WHEN c_custkey % 5 = 0 THEN 'The ' ELSE '' END || c_mktsegment || ' ' || (c_custkey * 7 % 400) END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'Org ' || (c_custkey % 97) WHEN 1 THEN '' END AS organization, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'w' || c_custkey END AS website,
  CASE WHEN c_custkey % 3 = 0 THEN c_name END AS contact_name, CASE WHEN c_custkey % 2 = 0 THEN ' U' || (c_custkey % 40) || '@X.org' END AS contact_email, CASE WHEN c_custkey % 7 = 0 THEN 'Here' END AS location, CASE WHEN c_custkey % 2 = 0 THEN 'fits' END AS rationale FROM customer),
known AS (SELECT 'the Building ' || (s_suppkey * 11 % 400) AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'The org ' || s_suppkey END AS organization FROM supplier),
cached AS (SELECT p_partkey AS ein, lower((['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[p_partkey % 5 + 1] || ' ' || (p_partkey % 400)) AS k, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS city, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 1037 END AS gifts FROM part),
valid AS (SELECT * FROM found WHERE name <> ''),
fresh AS (SELECT * FROM valid f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE {SAME.format(a=KEY.format("f.name"), b=KEY.format("k.name"))} OR {SAME.format(a=KEY.format("f.organization"), b=KEY.format("k.organization"))})), {GREEDY},
added AS (SELECT v.id, v.batch, v.channel, v.name, nullif(v.organization, '') AS organization, v.website, v.contact_name, v.contact_email, coalesce(v.location, c.city) AS location, CASE WHEN c.ein IS NOT NULL THEN 'Nonprofit organization (per IRS filing)' END AS funder_type,
  'Annual contributions/gifts made: ~$' || format('{{:,}}', c.gifts) AS typical_grant_size, '{{"rationale":' || CASE WHEN v.rationale IS NULL THEN 'null' ELSE '"fits"' END || ',"propublica_ein":' || coalesce(CAST(c.ein AS VARCHAR), 'null') || '}}' AS raw
  FROM valid v JOIN kept USING (id) LEFT JOIN (SELECT * FROM cached QUALIFY row_number() OVER (PARTITION BY k ORDER BY ein) = 1) c ON c.k = lower(v.name))"""


@query(sql(f"""@{SEARCH}, {APPLIED.replace("v_prospects p", "added p")} SELECT a.*, t.tier AS suggested_tier, 'ai_search' AS source, 'pending' AS status FROM added a JOIN tiered t USING (id)""").replace("WITH", "WITH RECURSIVE", 1))
def discovery_results(spark, d):
    """The candidates that searches add."""
    return searches.search_candidates(*_searches(spark, d), ad.rules(spark), FIELDS)


@query(sql(f"""@{SEARCH} SELECT batch, inserted, skipped, 'Found ' || inserted || ' candidate' || CASE WHEN inserted = 1 THEN '' ELSE 's' END || CASE WHEN skipped > 0 THEN ' (' || skipped || ' already known, skipped)' ELSE '' END AS message
FROM (SELECT v.batch, count(k.id) AS inserted, count(*) - count(k.id) AS skipped FROM valid v LEFT JOIN kept k USING (id) GROUP BY v.batch)""").replace("WITH", "WITH RECURSIVE", 1))
def discovery_counts(spark, d):
    """How many rows of each search were added and skipped, and the message that says so."""
    found, known, cache = _searches(spark, d)
    return searches.search_counts(found, searches.search_candidates(found, known, cache, ad.rules(spark), FIELDS))


#: The directory of all tests of writes: one contact for each address, and those without one.
DIRECTORY = """directory AS (SELECT id, name, email, organization, id AS source_prospect_id, NULL::BIGINT AS source_candidate_id, TIMESTAMP '2023-01-01' + to_days(CAST(id % 300 AS INTEGER)) AS created_at, TIMESTAMP '2023-06-01' + to_days(CAST(id % 200 AS INTEGER)) AS updated_at
  FROM v_contacts WHERE email IS NULL OR id IN (SELECT min(id) FROM v_contacts WHERE email IS NOT NULL GROUP BY email))"""


def _directory(spark, d) -> DataFrame:
    c = ad.contacts(spark, d)
    first = c.where("email is not null").groupBy("email").agg(F.min("id").alias("id")).select("id")
    rows = c.where("email is null").unionByName(c.where("email is not null").join(first, "id", "left_semi"))
    day = lambda start, n: F.timestamp_add("DAY", F.col("id") % n, F.lit(start).cast("timestamp"))
    return rows.select("id", "name", "email", "organization", F.col("id").alias("source_prospect_id"), F.lit(None).cast("long").alias("source_candidate_id"), day("2023-01-01", 300).alias("created_at"), day("2023-06-01", 200).alias("updated_at"))


def _merged_sql(writes: str) -> str:
    """The directory after ``writes``, as ``k``."""
    return f"""{DIRECTORY}, w AS (SELECT *, coalesce(nullif(trim(name), ''), nullif(trim(organization), ''), lower(trim(email))) AS n, nullif(lower(trim(email)), '') AS e FROM {writes}),
we AS (SELECT e, arg_max(n, seq) AS n, arg_max(struct_pack(o := organization, p := source_prospect_id, c := source_candidate_id), seq) AS s, min(seq) AS seq FROM w WHERE e IS NOT NULL AND n IS NOT NULL GROUP BY e),
wn AS (SELECT lower(n) AS ln, organization AS o, min(seq) AS seq, arg_min(n, seq) AS n, arg_max(source_prospect_id, seq) FILTER (WHERE source_prospect_id IS NOT NULL) AS p, arg_max(source_candidate_id, seq) FILTER (WHERE source_candidate_id IS NOT NULL) AS c FROM w WHERE e IS NULL AND n IS NOT NULL GROUP BY ALL),
dn AS (SELECT *, row_number() OVER (PARTITION BY lower(name), organization ORDER BY created_at DESC, id DESC) AS rn FROM directory WHERE email IS NULL),
k AS (SELECT coalesce(d.id, we.seq) AS id, CASE WHEN we.seq IS NOT NULL THEN we.n ELSE d.name END AS name, coalesce(we.e, d.email) AS email, CASE WHEN we.seq IS NOT NULL THEN we.s.o ELSE d.organization END AS organization,
    CASE WHEN we.seq IS NOT NULL THEN we.s.p ELSE d.source_prospect_id END AS source_prospect_id, CASE WHEN we.seq IS NOT NULL THEN we.s.c ELSE d.source_candidate_id END AS source_candidate_id, CASE WHEN we.seq IS NOT NULL THEN TIMESTAMP '{ad.AS_OF}' ELSE d.updated_at END AS updated_at
  FROM (SELECT * FROM directory WHERE email IS NOT NULL) d FULL JOIN we ON we.e = d.email
  UNION ALL SELECT coalesce(d.id, wn.seq), coalesce(d.name, wn.n), NULL, coalesce(d.organization, wn.o), coalesce(wn.p, d.source_prospect_id), coalesce(wn.c, d.source_candidate_id), CASE WHEN wn.seq IS NOT NULL THEN TIMESTAMP '{ad.AS_OF}' ELSE d.updated_at END
  FROM dn d FULL JOIN wn ON d.rn = 1 AND lower(d.name) = wn.ln AND d.organization IS NOT DISTINCT FROM wn.o)"""


SHOWN = "SELECT id, name, email, organization, source_prospect_id AS prospect, source_candidate_id AS candidate, strftime(updated_at, '%Y-%m-%d') AS updated FROM k"


def _shown(k: DataFrame) -> DataFrame:
    return k.select("id", "name", "email", "organization", F.col("source_prospect_id").alias("prospect"), F.col("source_candidate_id").alias("candidate"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(sql(f"""@{SEARCH}, search_writes AS (SELECT 1000000 + id AS seq, contact_name AS name, contact_email AS email, organization, NULL::BIGINT AS source_prospect_id, id AS source_candidate_id FROM added), {_merged_sql("search_writes")} {SHOWN}""").replace("WITH", "WITH RECURSIVE", 1))
def discovery_contacts(spark, d):
    """The directory after the contacts of what searches added."""
    added = searches.search_candidates(*_searches(spark, d), ad.rules(spark), FIELDS)
    writes = searches.contact_writes(added.withColumn("seq", F.col("id") + 1_000_000), "seq")
    return _shown(contacts.merged(_directory(spark, d), writes, ad.as_of()))


@query(sql(f"""@{WRITES}, all_writes AS (SELECT seq, name, email, organization, source_prospect_id, NULL::BIGINT AS source_candidate_id FROM writes UNION ALL SELECT 200000 + seq, 'Person ' || (seq % 200), NULL, CASE WHEN seq % 4 <> 0 THEN 'BUILDING' END, NULL, seq FROM writes), {_merged_sql("all_writes")}
SELECT id, name, email, CASE WHEN organization <> name THEN organization END AS shown, source_prospect_id AS prospect, source_candidate_id AS candidate, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM k"""))
def contact_directory(spark, d):
    """The whole directory after all writes, newest update first, contacts without an address too; an organization that is the name isn't shown twice."""
    w = _writes(spark, d)
    s = F.col("seq")
    none = F.lit(None)
    more = w.select((s + 200_000).alias("seq"), F.concat(F.lit("Person "), (s % 200).cast("string")).alias("name"), none.cast("string").alias("email"), F.when(s % 4 != 0, "BUILDING").alias("organization"), none.cast("long").alias("source_prospect_id"), s.alias("source_candidate_id"))
    k = contacts.merged(_directory(spark, d), w.unionByName(more), ad.as_of())
    shown = k.select("id", "name", "email", contacts.shown_organization(F.col("name"), F.col("organization")).alias("shown"), F.col("source_prospect_id").alias("prospect"), F.col("source_candidate_id").alias("candidate"), "updated_at")
    return ordering.numbered(shown, ["-updated_at", "id"], "place").drop("updated_at")


ACCEPTED = """acc AS (SELECT id, name, organization, CASE WHEN id % 3 = 0 THEN 'Lead ' || id END AS contact_name, CASE WHEN id % 2 = 0 THEN ' User' || (id % 500) || '@x.org' END AS contact_email FROM v_candidates WHERE status = 'pending'),
accept_writes AS (SELECT id AS seq, contact_name AS name, contact_email AS email, organization, id AS source_prospect_id, NULL::BIGINT AS source_candidate_id FROM (SELECT id + 5000000 AS id, contact_name, contact_email, organization FROM acc))"""


def _accepted(spark, d) -> dict[str, DataFrame]:
    i = F.col("id")
    email = F.when(i % 2 == 0, F.concat(F.lit(" User"), (i % 500).cast("string"), F.lit("@x.org")))
    c = ad.candidates(spark, d).where(F.col("status") == "pending").select("id", "name", "organization", F.when(i % 3 == 0, F.concat(F.lit("Lead "), i.cast("string"))).alias("contact_name"), email.alias("contact_email"), "status")
    return lifecycle.accepted(c.withColumn("id", F.col("id") + 5_000_000), "discovery", F.lit("me"), ad.as_of())


@query(sql(f"""@{ACCEPTED} SELECT 'prospect' AS kind, id + 5000000 AS id, name, 'discovery' AS state, organization FROM acc UNION ALL SELECT 'run', id + 5000000, 'Researching ' || name || ' and drafting a strategy...', 'researching', NULL FROM acc
UNION ALL SELECT 'candidate', id + 5000000, 'me {ad.AS_OF}', 'accepted', organization FROM acc"""))
def accept_candidates(spark, d):
    """What accepting all pending candidates writes besides contacts: prospects in the first stage, runs of research, and the candidates' own status, reviewer and time."""
    made = _accepted(spark, d)
    return _union([
        made["prospects"].select(F.lit("prospect").alias("kind"), "id", "name", F.col("stage").alias("state"), "organization"),
        made["runs"].select(F.lit("run").alias("kind"), F.col("prospect_id").alias("id"), F.col("status_message").alias("name"), F.col("status").alias("state"), F.lit(None).cast("string").alias("organization")),
        made["candidates"].select(F.lit("candidate").alias("kind"), "id", F.concat_ws(" ", "reviewed_by", F.date_format("updated_at", "yyyy-MM-dd")).alias("name"), F.col("status").alias("state"), "organization"),
    ])


@query(sql(f"@{ACCEPTED}, {_merged_sql('accept_writes')} {SHOWN}"))
def accepted_contacts(spark, d):
    """The directory after the contacts of accepted candidates, which link to the prospects now."""
    return _shown(contacts.merged(_directory(spark, d), _accepted(spark, d)["contacts"], ad.as_of()))


@query(sql(f"""@{IMPORT}, import_writes AS (SELECT 7000000 + id AS seq, nullif(contact_name, '') AS name, nullif(contact_email, '') AS email, nullif(org, '') AS organization, NULL::BIGINT AS source_prospect_id, NULL::BIGINT AS source_candidate_id FROM imp WHERE valid), {_merged_sql("import_writes")} {SHOWN}"""))
def csv_import_contacts(spark, d):
    """The directory after the contacts of an import, which link to nothing."""
    none = F.lit(None).cast("long")
    writes = _imported(spark, d).where("valid").select((F.col("id") + 7_000_000).alias("seq"), F.col("contact_name").alias("name"), F.col("contact_email").alias("email"), "organization", none.alias("source_prospect_id"), none.alias("source_candidate_id"))
    return _shown(contacts.merged(_directory(spark, d), writes, ad.as_of()))
