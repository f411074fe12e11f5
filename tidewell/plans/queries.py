"""The queries of the relationship pipeline, by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import arrays, dates, labels, numbers, text
from tidewell.operators import contacts, latest, lifecycle, lookups, matching, profile, screening, stages
from tidewell.plans import adapters as ad
from tidewell.plans.adapters import sql
from tidewell.sources.tables import checked_import, read_csv_rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FIELDS = ["channel", "organization", "name"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _stages(spark: SparkSession) -> DataFrame:
    return labels.dimension(spark, ad.STAGES)


def _channels(spark: SparkSession) -> DataFrame:
    return labels.dimension(spark, ad.CHANNELS)


LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY created_at DESC, id DESC) AS rn FROM v_log) WHERE rn = 1
)"""
AGED = f"""{LATEST}, aged AS (
  SELECT p.*, (epoch_us(TIMESTAMP '{ad.AS_OF}') - epoch_us(CASE WHEN l.to_stage = p.stage THEN l.created_at ELSE p.created_at END)) / 86400000000.0::DOUBLE AS days
  FROM v_prospects p LEFT JOIN latest l ON l.prospect_id = p.id
)"""
CRITERION = """CASE r.operator
    WHEN 'equals' THEN lower(coalesce(f.v, '')) = lower(coalesce(r.value, '')) WHEN 'not_equals' THEN lower(coalesce(f.v, '')) <> lower(coalesce(r.value, ''))
    WHEN 'contains' THEN contains(lower(coalesce(f.v, '')), lower(coalesce(r.value, ''))) WHEN 'not_contains' THEN NOT contains(lower(coalesce(f.v, '')), lower(coalesce(r.value, '')))
    WHEN 'is_set' THEN length(trim(coalesce(f.v, ''))) > 0 WHEN 'is_not_set' THEN length(trim(coalesce(f.v, ''))) = 0 ELSE false END"""
APPLIED = f"""applied AS (
  SELECT p.id, p.channel, r.rule_id, r.ord, r.label, r.weight, {CRITERION.replace("f.v", "CASE r.field WHEN 'channel' THEN p.channel WHEN 'organization' THEN p.organization WHEN 'name' THEN p.name END")} AS passed
  FROM v_prospects p LEFT JOIN v_rules r ON r.active AND (r.channel IS NULL OR r.channel = p.channel)
), scored AS (
  SELECT id, channel, coalesce(sum(CASE WHEN passed THEN weight ELSE 0 END), 0)::BIGINT AS score, coalesce(sum(weight), 0)::BIGINT AS max_possible FROM applied GROUP BY id, channel
), tiered AS (
  SELECT *, CASE WHEN max_possible > 0 THEN score::DOUBLE / max_possible END AS share,
    CASE WHEN max_possible <= 0 THEN 2 WHEN score::DOUBLE / max_possible >= 0.7::DOUBLE THEN 1 WHEN score::DOUBLE / max_possible >= 0.4::DOUBLE THEN 2 ELSE 3 END AS tier FROM scored
)"""


# --- stages -----------------------------------------------------------------


@query(sql(f"""@{AGED}
SELECT s.ord, s.value, s.label, coalesce(a.n, 0) AS n, coalesce(a.avg_days, 0) AS avg_days, coalesce(a.potential, 0) AS potential FROM v_stages s LEFT JOIN (
  SELECT stage, count(*) AS n, round(avg(days), 4) AS avg_days, CAST(sum(CAST(coalesce(ask_amount, 0) AS DECIMAL(18, 2))) AS DOUBLE) AS potential FROM aged GROUP BY stage
) a ON a.stage = s.value"""))  # fmt: skip
def stage_stats(spark, d):
    return stages.stage_stats(ad.prospects(spark, d), ad.log(spark, d), _stages(spark), ad.as_of())


@query(sql(f"@{LATEST} SELECT prospect_id, id, to_stage FROM latest"))
def latest_per_key(spark, d):
    return latest.latest_per_key(ad.log(spark, d), ["prospect_id"]).select("prospect_id", "id", "to_stage")


@query(sql("""SELECT prospect_id, max_by(l.id, (l.created_at, l.id)) AS id FROM v_log l JOIN v_prospects p ON p.id = l.prospect_id WHERE l.to_stage = p.stage GROUP BY prospect_id"""))
def latest_matching_state(spark, d):
    p = ad.prospects(spark, d).select(F.col("id").alias("pid"), "stage")
    moved = ad.log(spark, d).join(p, F.col("prospect_id") == F.col("pid"))
    return latest.latest_matching(moved, ["prospect_id"], F.col("to_stage") == F.col("stage")).select("prospect_id", "id")


@query(sql(f"""@entry AS (
  SELECT prospect_id, max(l.created_at) AS at FROM v_log l JOIN v_prospects p ON p.id = l.prospect_id WHERE l.to_stage = p.stage GROUP BY prospect_id
) SELECT p.id, round((epoch_us(TIMESTAMP '{ad.AS_OF}') - epoch_us(coalesce(e.at, p.created_at))) / 86400000000.0::DOUBLE, 6) AS days FROM v_prospects p LEFT JOIN entry e ON e.prospect_id = p.id"""))
def days_since_entry(spark, d):
    out = stages.days_since_entry(ad.prospects(spark, d), ad.log(spark, d), ad.as_of())
    return out.select("id", F.round("days", 6).alias("days"))


@query(sql("SELECT prospect_id, count(*) FILTER (WHERE rn = 1) AS latest, count(*) FILTER (WHERE rn > 1) AS history FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY created_at DESC, id DESC) AS rn FROM v_log) GROUP BY prospect_id"))
def first_vs_rest(spark, d):
    r = latest.ranked(ad.log(spark, d), ["prospect_id"])
    return r.groupBy("prospect_id").agg(F.count_if(F.col("rn") == 1).alias("latest"), F.count_if(F.col("rn") > 1).alias("history"))


@query(sql("""SELECT id, name, organization FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), coalesce(organization, '') ORDER BY created_at DESC, id DESC) AS rn FROM v_contacts WHERE email IS NULL) WHERE rn = 1
UNION ALL SELECT id, name, organization FROM v_contacts WHERE email IS NOT NULL"""))
def dedupe_keep_newest(spark, d):
    c = ad.contacts(spark, d)
    return latest.keep_newest(c, [F.lower("name"), F.coalesce("organization", F.lit(""))], F.col("email").isNull()).select("id", "name", "organization")


@query(sql(f"@{LATEST} SELECT count(*) AS ready FROM latest WHERE to_stage = 'signup' AND approved IS NULL"))
def ready_queue_count(spark, d):
    last = latest.latest_per_key(ad.log(spark, d), ["prospect_id"])
    return last.where((F.col("to_stage") == "signup") & F.col("approved").isNull()).agg(F.count(F.lit(1)).alias("ready"))


@query(sql(f"@{LATEST} SELECT l.id AS run_id, p.id, p.name FROM latest l JOIN v_prospects p ON p.id = l.prospect_id WHERE l.to_stage = 'signup' AND l.approved IS NULL"))
def review_queue(spark, d):
    last = latest.latest_per_key(ad.log(spark, d), ["prospect_id"])
    ready = last.where((F.col("to_stage") == "signup") & F.col("approved").isNull()).select(F.col("id").alias("run_id"), "prospect_id")
    return ready.join(ad.prospects(spark, d), F.col("prospect_id") == F.col("id")).select("run_id", "id", "name")


@query(sql("SELECT s.ord, s.value, count(p.id) AS n FROM v_stages s LEFT JOIN v_prospects p ON p.stage = s.value GROUP BY s.ord, s.value"))
def stage_counts_zero_filled(spark, d):
    agg = ad.prospects(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return stages.zero_filled(_stages(spark).select("ord", "value"), agg, "stage", {"n": 0})


@query(sql("""@a AS (SELECT stage, count(*) AS n, CAST(sum(CAST(coalesce(ask_amount, 0) AS DECIMAL(18, 2))) AS DOUBLE) AS potential FROM v_prospects GROUP BY stage), m AS (SELECT max(potential) AS most FROM a)
SELECT ord, value, coalesce(n, 0) AS n, coalesce(potential, 0) AS potential, CAST(floor(100 * coalesce(potential, 0) / greatest(1, (SELECT most FROM m)) + 0.5) AS BIGINT) AS share FROM v_stages LEFT JOIN a ON stage = value"""))
def forecast_share(spark, d):
    return stages.stage_shares(ad.prospects(spark, d), _stages(spark))


@query(sql("SELECT count(*) AS n, CAST(sum(CAST(coalesce(ask_amount, 0) AS DECIMAL(18, 2))) AS DOUBLE) AS potential, count(*) FILTER (WHERE stage = 'legacy') AS unlisted FROM v_prospects"))
def totals(spark, d):
    p = ad.prospects(spark, d)
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("ask_amount", F.lit(0.0)).cast("decimal(18,2)")).cast("double").alias("potential"), F.count_if(F.col("stage") == "legacy").alias("unlisted"))


@query(sql("""SELECT p.id, coalesce(s.ord, -1) AS stage_ord, CASE WHEN s.value IS NULL THEN 'view' ELSE n.value END AS next_stage
FROM v_prospects p LEFT JOIN v_stages s ON s.value = p.stage LEFT JOIN v_stages n ON n.ord = s.ord + 1"""))
def next_stage(spark, d):
    return stages.with_next_stage(ad.prospects(spark, d), _stages(spark)).select("id", "stage_ord", "next_stage")


@query(sql("SELECT p.id, s.value AS step, s.ord <= coalesce(c.ord, -1) AS done FROM v_prospects p CROSS JOIN v_stages s LEFT JOIN v_stages c ON c.value = p.stage"))
def stage_progress(spark, d):
    p = stages.with_next_stage(ad.prospects(spark, d), _stages(spark))
    steps = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias("step")) for i, (v, _) in enumerate(ad.STAGES)])
    return p.select("id", "stage_ord", F.explode(steps).alias("s")).select("id", "s.step", (F.col("s.ord") <= F.col("stage_ord")).alias("done"))


@query(sql("SELECT p.id, coalesce(s.label, p.stage) AS stage_label, coalesce(c.label, p.channel) AS channel_label FROM v_prospects p LEFT JOIN v_stages s ON s.value = p.stage LEFT JOIN v_channels c ON c.value = p.channel"))
def labels_lookup(spark, d):
    p = labels.with_label(ad.prospects(spark, d), _stages(spark), "stage", "stage_label")
    return labels.with_label(p, _channels(spark), "channel", "channel_label").select("id", "stage_label", "channel_label")


# --- screening --------------------------------------------------------------


@query(sql(f"@{APPLIED} SELECT id, score, max_possible, share, tier FROM tiered"))
def screen_entities(spark, d):
    return screening.screened(ad.prospects(spark, d), ad.rules(spark), FIELDS).select("id", "score", "max_possible", "share", "tier")


@query(sql(f"@{APPLIED} SELECT id, string_agg(rule_id || ':' || weight || ':' || CASE WHEN passed THEN 'true' ELSE 'false' END, ',' ORDER BY ord) AS breakdown FROM applied GROUP BY id"))
def screen_breakdown(spark, d):
    s = screening.screened(ad.prospects(spark, d), ad.rules(spark), FIELDS)
    line = F.transform("breakdown", lambda b: F.concat_ws(":", b["rule_id"].cast("string"), b["weight"].cast("string"), b["passed"].cast("string")))
    return s.select("id", F.array_join(line, ",").alias("breakdown"))


@query(sql("""SELECT c.value AS channel, count(r.rule_id) AS active_rules, coalesce(sum(r.weight), 0)::BIGINT AS max_points,
  ceil(coalesce(sum(r.weight), 0) * 0.7::DOUBLE)::BIGINT AS tier1_points, ceil(coalesce(sum(r.weight), 0) * 0.4::DOUBLE)::BIGINT AS tier2_points
FROM v_segments c LEFT JOIN v_table_rules r ON r.active AND (r.channel IS NULL OR r.channel = c.value) GROUP BY c.value HAVING count(r.rule_id) > 0"""))
def channel_rule_summary(spark, d):
    return screening.channel_summary(ad.segments(spark, d), ad.table_rules(spark, d)).where("active_rules > 0")


@query(sql(f"@{APPLIED} SELECT channel, tier, count(*) AS n FROM tiered GROUP BY channel, tier"))
def tier_distribution(spark, d):
    p = ad.prospects(spark, d)
    s = screening.screened(p, ad.rules(spark), FIELDS, keep=("channel",))
    return s.groupBy("channel", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_size AS weight, CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 3 ELSE 5 END AS nearest,
  CASE p_size WHEN 1 THEN 'Nice to have' WHEN 3 THEN 'Important' WHEN 5 THEN 'Critical' ELSE 'Weight ' || p_size END AS label, count(*) AS n FROM part GROUP BY p_size""")
def nearest_importance(spark, d):
    w = F.col("p_size")
    p = table(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return p.select(w.alias("weight"), labels.nearest_importance(w).alias("nearest"), labels.importance_label(w).alias("label"), "n")


@query(sql(f"""@{APPLIED} SELECT id, CASE tier WHEN 1 THEN 'Tier 1 — Strong fit' WHEN 2 THEN 'Tier 2 — Possible' ELSE 'Tier 3 — Unlikely' END AS tier_label,
  CASE WHEN share >= 0.7::DOUBLE THEN 'high' WHEN share >= 0.4::DOUBLE THEN 'medium' WHEN share IS NOT NULL THEN 'low' END AS fit, CAST(floor(share * 100 + 0.5) AS BIGINT) || '%' AS percent FROM tiered"""))
def tier_labels(spark, d):
    s = screening.screened(ad.prospects(spark, d), ad.rules(spark), FIELDS)
    return s.select("id", labels.tier_label(F.col("tier")).alias("tier_label"), labels.fit_bucket(F.col("share")).alias("fit"), numbers.percent_label(F.col("share")).alias("percent"))


# --- filters, order, sets ---------------------------------------------------


@query(sql("SELECT id, name FROM v_prospects WHERE contains(lower(name), '00012') AND channel = 'BUILDING'"))
def list_search(spark, d):
    p = ad.prospects(spark, d)
    return p.where(text.contains_ignoring_case(F.col("name"), F.lit("00012")) & (F.col("channel") == "BUILDING")).select("id", "name")


@query(sql("SELECT id, name, organization FROM v_candidates WHERE status = 'pending' AND (contains(lower(name), 'ring') OR coalesce(contains(lower(organization), 'd#2'), false))"))
def workspace_search(spark, d):
    c = ad.candidates(spark, d)
    hit = text.contains_ignoring_case(F.col("name"), F.lit("ring")) | F.coalesce(text.contains_ignoring_case(F.col("organization"), F.lit("D#2")), F.lit(False))
    return c.where((F.col("status") == "pending") & hit).select("id", "name", "organization")


@query(sql("SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'saved') AS saved, count(*) FILTER (WHERE status = 'dismissed') AS dismissed FROM v_candidates"))
def tab_counts(spark, d):
    return ad.candidates(spark, d).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ad.STATUSES[:3]])


@query(sql(f"SELECT id, strftime(next_action_due, '%Y-%m-%d') AS due FROM v_prospects WHERE next_action_due BETWEEN DATE '{ad.AS_OF}' AND DATE '{ad.AS_OF}' + 7"))
def range_filter(spark, d):
    today = F.lit(ad.AS_OF).cast("date")
    p = ad.prospects(spark, d).where(F.col("next_action_due").between(today, F.date_add(today, 7)))
    return p.select("id", F.date_format("next_action_due", "yyyy-MM-dd").alias("due"))


@query(sql("""SELECT count(*) FILTER (WHERE organization IS NULL) AS none, count(*) FILTER (WHERE organization IS NOT NULL) AS some, count(*) FILTER (WHERE organization <> 'NATION_1') AS other_by_sql,
  count(*) FILTER (WHERE coalesce(organization, '') <> 'nation_1') AS other_by_rule, count(*) FILTER (WHERE coalesce(ask_amount, 0) <> 0) AS filled, count(*) FILTER (WHERE organization ILIKE 'nation_1_') AS like_one FROM v_prospects"""))
def null_filters(spark, d):
    o = F.col("organization")
    return ad.prospects(spark, d).agg(
        F.count_if(o.isNull()).alias("none"), F.count_if(o.isNotNull()).alias("some"), F.count_if(o != "NATION_1").alias("other_by_sql"), F.count_if(F.coalesce(o, F.lit("")) != "nation_1").alias("other_by_rule"),
        F.count_if(F.coalesce("ask_amount", F.lit(0.0)) != 0).alias("filled"), F.count_if(o.ilike("nation_1_")).alias("like_one"),
    )


@query(sql(f"""@{APPLIED} SELECT id, share FROM tiered ORDER BY coalesce(share, -1) DESC, id LIMIT 3"""))
def recommended_topk(spark, d):
    s = screening.screened(ad.prospects(spark, d), ad.rules(spark), FIELDS)
    return s.orderBy(F.coalesce("share", F.lit(-1.0)).desc(), "id").limit(3).select("id", "share")


@query(sql(f"@{AGED} SELECT id, round(days, 6) AS days FROM (SELECT * FROM aged ORDER BY days DESC, id LIMIT 3) WHERE days >= 1"))
def stuck_longest(spark, d):
    aged = stages.days_in_stage(ad.prospects(spark, d), ad.log(spark, d), ad.as_of())
    return stages.stuck_longest(aged).select("id", F.round("days", 6).alias("days"))


HEALTH = f"CASE WHEN next_action_due - DATE '{ad.AS_OF}' < 0 THEN 'stalled' WHEN next_action_due - DATE '{ad.AS_OF}' <= 3 THEN 'due_soon' WHEN next_action_due IS NOT NULL THEN 'on_track' END"


@query(sql(f"""SELECT id, health FROM (SELECT *, {HEALTH} AS health FROM v_prospects WHERE next_action_due IS NOT NULL ORDER BY next_action_due, id LIMIT 10) WHERE health IN ('due_soon', 'stalled') ORDER BY next_action_due, id LIMIT 3"""))
def priority_limit_then_filter(spark, d):
    health = dates.health_status(F.col("next_action_due"), ad.as_of())
    return stages.priorities(ad.prospects(spark, d), health).select("id", "health")


@query(sql("SELECT id, prospect_id, to_stage FROM v_log WHERE to_stage <> 'error' ORDER BY created_at DESC, id DESC LIMIT 8"))
def recent_topk(spark, d):
    return ad.log(spark, d).where(F.col("to_stage") != "error").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(8).select("id", "prospect_id", "to_stage")


@query(sql("""SELECT id, channel, size FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY channel ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_candidates) WHERE before < 100"""))
def budgeted_prefix(spark, d):
    return stages.budgeted(ad.candidates(spark, d), "size", ["id"], 100, "channel").select("id", "channel", "size")


@query(sql("""SELECT c.value AS channel, coalesce(n, 0) AS n FROM v_channels c LEFT JOIN (SELECT channel, count(*) AS n FROM (SELECT channel FROM v_prospects UNION ALL SELECT upper(channel) FROM v_candidates) GROUP BY channel) u ON u.channel = c.value"""))
def channel_union_counts(spark, d):
    both = ad.prospects(spark, d).select("channel").unionByName(ad.candidates(spark, d).select(F.upper("channel").alias("channel")))
    agg = both.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return stages.zero_filled(_channels(spark).select("value"), agg, "channel", {"n": 0}).withColumnRenamed("value", "channel")


@query(sql("SELECT kind, count(*) AS n, count(organization) AS with_org FROM (SELECT 'prospect' AS kind, name, organization FROM v_prospects UNION ALL SELECT 'candidate', name, organization FROM v_candidates) GROUP BY kind"))
def known_union(spark, d):
    cols = ["name", "organization"]
    u = ad.prospects(spark, d).select(F.lit("prospect").alias("kind"), *cols).unionByName(ad.candidates(spark, d).select(F.lit("candidate").alias("kind"), *cols))
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("organization").alias("with_org"))


@query("""SELECT p_partkey AS id, CASE WHEN list_contains(l, 'red') THEN array_to_string(l, ',') ELSE array_to_string(l || ['red'], ',') END AS added,
  CASE WHEN list_contains(l, 'ring') THEN array_to_string(list_filter(l, lambda x: x <> 'ring'), ',') ELSE array_to_string(l || ['ring'], ',') END AS toggled FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)""")
def array_set_ops(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("l"))
    return p.select("id", F.array_join(arrays.add_distinct(F.col("l"), F.lit(" red ")), ",").alias("added"), F.array_join(arrays.toggle(F.col("l"), F.lit("ring")), ",").alias("toggled"))


@query(sql("SELECT p.id, p.name FROM v_prospects p WHERE p.id IN (SELECT prospect_id FROM v_log WHERE to_stage = 'purchase')"))
def in_list_fetch(spark, d):
    keys = ad.log(spark, d).where(F.col("to_stage") == "purchase").select(F.col("prospect_id").alias("id")).distinct()
    return ad.prospects(spark, d).join(keys, "id", "left_semi").select("id", "name")


@query("""SELECT channel, prospects, decided FROM (SELECT 1 AS o, 'BUILDING' AS channel, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS prospects, count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000) AS decided FROM customer)""")
def count_only(spark, d):
    c = table(spark, d, "customer")
    mine = F.col("c_mktsegment") == "BUILDING"
    return c.agg(F.count_if(mine).alias("prospects"), F.count_if(mine & (F.col("c_acctbal") > 5000)).alias("decided")).select(F.lit("BUILDING").alias("channel"), "prospects", "decided")


# --- matching and contacts --------------------------------------------------

KNOWN = [("The NATION_2 ", None), ("Fund of nation_14", None), ("x", "Region"), ("NAT", None)]
SAME = "({a} <> '' AND {b} <> '' AND ({a} = {b} OR (length({a}) >= 4 AND length({b}) >= 4 AND (contains({a}, {b}) OR contains({b}, {a})))))"
KEY = "regexp_replace(lower(trim(coalesce({0}, ''))), '^the\\s+', '')"


@query(f"""WITH known(name, organization) AS (VALUES {", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in KNOWN)}), f AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'Region' || n_regionkey END AS organization FROM nation)
SELECT id, name FROM f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE {SAME.format(a=KEY.format("f.name"), b=KEY.format("k.name"))} OR {SAME.format(a=KEY.format("f.organization"), b=KEY.format("k.organization"))})""")
def fuzzy_anti_join(spark, d):
    n = table(spark, d, "nation")
    org = F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("Region"), F.col("n_regionkey").cast("string")))
    found = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), org.alias("organization"))
    return matching.fuzzy_anti_join(found, spark.createDataFrame(KNOWN, "name string, organization string")).select("id", "name")


#: A fold in SQL: the rows of a batch in order, each kept unless it matches one kept before.
GREEDY = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ord) AS i, {KEY.format("name")} AS nk, {KEY.format("organization")} AS ok FROM fresh), fold AS (
  SELECT batch, 0::BIGINT AS i, []::VARCHAR[] AS ns, []::VARCHAR[] AS os, []::BIGINT[] AS ids FROM (SELECT DISTINCT batch FROM numbered)
  UNION ALL SELECT f.batch, f.i + 1, CASE WHEN hit THEN ns ELSE list_append(ns, nk) END, CASE WHEN hit THEN os ELSE list_append(os, ok) END, CASE WHEN hit THEN ids ELSE list_append(ids, id) END
  FROM (SELECT f.*, r.id, r.nk, r.ok, len(list_filter(ns, lambda x: {SAME.format(a="x", b="r.nk")})) + len(list_filter(os, lambda x: {SAME.format(a="x", b="r.ok")})) > 0 AS hit FROM fold f JOIN numbered r ON r.batch = f.batch AND r.i = f.i + 1) f
), kept AS (SELECT unnest(ids) AS id FROM (SELECT batch, arg_max(ids, i) AS ids FROM fold GROUP BY batch))"""


@query(f"WITH RECURSIVE fresh AS (SELECT n_nationkey AS id, n_nationkey AS ord, n_name AS name, NULL::VARCHAR AS organization, n_regionkey AS batch FROM nation), {GREEDY} SELECT id, name, batch FROM fresh JOIN kept USING (id)")
def greedy_dedupe(spark, d):
    n = table(spark, d, "nation")
    found = n.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("organization"), F.col("n_regionkey").alias("batch"))
    return matching.greedy_distinct(found, "batch").select("id", "name", "batch")


@query(sql("""@cache AS (SELECT lower(p_name) AS k, min(p_partkey) AS hit FROM part GROUP BY 1) SELECT c.id, cache.hit FROM (SELECT id, upper(name) AS name FROM v_candidates WHERE status = 'saved' UNION ALL SELECT -id - 1, 'nobody' FROM v_candidates WHERE status = 'accepted') c LEFT JOIN cache ON cache.k = lower(c.name)"""))
def cache_enrich(spark, d):
    c = ad.candidates(spark, d)
    rows = c.where(F.col("status") == "saved").select("id", F.upper("name").alias("name")).union(c.where(F.col("status") == "accepted").select(-F.col("id") - 1, F.lit("nobody")))
    cache = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("hit"))
    return matching.enriched(rows, cache, ["hit"]).select("id", "hit")


WRITES = """writes AS (SELECT 100000 + s_suppkey AS seq, CASE WHEN s_suppkey % 4 <> 0 THEN ' ' || s_name || ' ' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN ' USER' || (s_suppkey % 40) || '@X.org' ELSE 'new' || (s_suppkey % 30) || '@y.org' END AS email,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'Org ' || (s_suppkey % 7) END AS organization, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS source_prospect_id FROM supplier)"""


def _writes(spark, d):
    k = F.col("s_suppkey")
    email = F.when(k % 5 == 0, None).when(k % 2 == 0, F.concat(F.lit(" USER"), (k % 40).cast("string"), F.lit("@X.org"))).otherwise(F.concat(F.lit("new"), (k % 30).cast("string"), F.lit("@y.org")))
    return table(spark, d, "supplier").select(
        (k + 100000).alias("seq"), F.when(k % 4 != 0, F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("name"), email.alias("email"),
        F.when(k % 3 != 0, F.concat(F.lit("Org "), (k % 7).cast("string"))).alias("organization"), F.when(k % 2 == 0, k).alias("source_prospect_id"), F.lit(None).cast("long").alias("source_candidate_id"),
    )


@query(sql(f"""@{WRITES}, base AS (SELECT id, name, email, organization FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS rn FROM v_contacts WHERE email IS NOT NULL) WHERE rn = 1),
w AS (SELECT * FROM (SELECT seq, lower(trim(email)) AS e, coalesce(nullif(trim(name), ''), nullif(trim(organization), ''), lower(trim(email))) AS n, organization, source_prospect_id, row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY seq DESC) AS rn FROM writes WHERE email IS NOT NULL) WHERE rn = 1)
SELECT coalesce(b.id, w.seq) AS id, CASE WHEN w.e IS NOT NULL THEN w.n ELSE b.name END AS name, coalesce(w.e, b.email) AS email, CASE WHEN w.e IS NOT NULL THEN w.organization ELSE b.organization END AS organization,
  CASE WHEN w.e IS NOT NULL THEN w.source_prospect_id ELSE b.id END AS source_prospect_id FROM base b FULL JOIN w ON w.e = b.email"""))
def contact_upsert(spark, d):
    base = latest.latest_per_key(ad.contacts(spark, d).where("email is not null").withColumn("o", -F.col("id")), ["email"], "o", "id")
    base = base.withColumn("source_prospect_id", F.col("id")).withColumn("source_candidate_id", F.lit(None).cast("long"))
    return contacts.upserted(base, _writes(spark, d)).drop("source_candidate_id")


@query(sql(f"""@{WRITES}, w AS (SELECT seq, coalesce(nullif(trim(name), ''), nullif(trim(organization), '')) AS n, organization FROM writes WHERE email IS NULL),
c AS (SELECT id, lower(CASE WHEN id % 2 = 0 THEN 'SUPPLIER#' || lpad(CAST((id * 5) % 100 AS VARCHAR), 9, '0') ELSE name END) AS n, CASE WHEN (id * 5) % 100 % 3 <> 0 THEN 'Org ' || ((id * 5) % 100 % 7) END AS organization, created_at FROM v_contacts WHERE email IS NULL)
SELECT seq, name, organization, contact_id FROM (SELECT w.seq, w.n AS name, w.organization, c.id AS contact_id, row_number() OVER (PARTITION BY w.seq ORDER BY c.created_at DESC NULLS LAST, c.id DESC NULLS LAST) AS rn FROM w LEFT JOIN c ON c.n = lower(w.n) AND c.organization IS NOT DISTINCT FROM w.organization WHERE w.n IS NOT NULL) WHERE rn = 1"""))
def contact_match_without_email(spark, d):
    k = (F.col("id") * 5) % 100
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.col("name"))
    c = ad.contacts(spark, d).where("email is null").select("id", name.alias("name"), "email", F.when(k % 3 != 0, F.concat(F.lit("Org "), (k % 7).cast("string"))).alias("organization"), "created_at")
    return contacts.matched_without_email(c, _writes(spark, d))


@query(sql("""@src AS (SELECT 1 AS priority, id, CASE WHEN id % 5 = 0 THEN '  ' ELSE name END AS contact_name, CASE WHEN id % 3 <> 0 THEN ' User' || (id % 50) || '@x.org' END AS contact_email, organization FROM v_prospects
  UNION ALL SELECT 2, id, name, CASE WHEN id % 2 = 0 THEN 'user' || (id % 90) || '@x.org ' END, organization FROM v_candidates),
n AS (SELECT priority, id, coalesce(nullif(trim(contact_name), ''), lower(trim(contact_email))) AS name, nullif(lower(trim(contact_email)), '') AS email, organization FROM src WHERE coalesce(nullif(trim(contact_name), ''), nullif(trim(contact_email), '')) IS NOT NULL)
SELECT priority, id, name, email, organization FROM (SELECT *, CASE WHEN email IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY email ORDER BY priority, id) END AS rn FROM n) WHERE rn = 1"""))
def contact_backfill(spark, d):
    i = F.col("id")
    p = ad.prospects(spark, d).select(F.lit(1).alias("priority"), "id", F.when(i % 5 == 0, "  ").otherwise(F.col("name")).alias("contact_name"), F.when(i % 3 != 0, F.concat(F.lit(" User"), (i % 50).cast("string"), F.lit("@x.org"))).alias("contact_email"), "organization")
    c = ad.candidates(spark, d).select(F.lit(2).alias("priority"), "id", F.col("name").alias("contact_name"), F.when(i % 2 == 0, F.concat(F.lit("user"), (i % 90).cast("string"), F.lit("@x.org "))).alias("contact_email"), "organization")
    return contacts.backfilled(p.unionByName(c))


@query(sql("SELECT id, CASE WHEN trim(organization) <> '' AND email IS NOT NULL AND lower(trim(name)) = lower(trim(email)) THEN organization ELSE name END AS name FROM v_contacts"))
def contact_rename(spark, d):
    return contacts.renamed(ad.contacts(spark, d)).select("id", "name")


# --- scalars ----------------------------------------------------------------


@query(sql(f"SELECT id, {HEALTH} AS health, CASE {HEALTH} WHEN 'on_track' THEN 'On track' WHEN 'due_soon' THEN 'Due soon' WHEN 'stalled' THEN 'Stalled' END AS label FROM v_prospects"))
def health_status(spark, d):
    h = dates.health_status(F.col("next_action_due"), ad.as_of())
    return ad.prospects(spark, d).select("id", h.alias("health"), dates.health_label(h).alias("label"))


@query(sql(f"""SELECT id, CASE WHEN f <= 0 THEN 'today' WHEN f = 1 THEN 'yesterday' ELSE f || ' days ago' END AS relative, strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at::DATE + 7, '%Y-%m-%d') AS week_later,
  CASE WHEN hour(created_at) < 12 THEN 'Good morning' WHEN hour(created_at) < 18 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting, strftime(created_at, '%b %-d') AS short
FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '{ad.AS_OF}') - epoch_us(created_at)) / 86400000000.0::DOUBLE) AS BIGINT) AS f FROM v_log)"""))
def relative_dates(spark, d):
    ts = F.col("created_at")
    return ad.log(spark, d).select("id", dates.relative_day(ts, ad.as_of()).alias("relative"), dates.day_text(ts).alias("day"), dates.day_text(ts, 7).alias("week_later"), dates.greeting(ts).alias("greeting"), dates.short_day(ts).alias("short"))


TENTHS = "CAST(floor(CAST(floor({0} * 10 + 0.5) AS BIGINT) / 10) AS BIGINT) || '.' || (CAST(floor({0} * 10 + 0.5) AS BIGINT) % 10)"


@query(f"""WITH v AS (SELECT o_orderkey AS id, floor(o_totalprice) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 0 ELSE 1000 END + CASE o_orderkey % 4 WHEN 2 THEN 25000 * (o_orderkey % 50) ELSE 0 END AS x FROM orders)
SELECT id, CASE WHEN x >= 1000000 THEN '$' || (CASE WHEN x % 1000000 = 0 THEN CAST(CAST(x / 1000000 AS BIGINT) AS VARCHAR) ELSE {TENTHS.format("(x / 1000000.0::DOUBLE)")} END) || 'M' WHEN x >= 1000 THEN '$' || (CASE WHEN x % 1000 = 0 THEN CAST(CAST(x / 1000 AS BIGINT) AS VARCHAR) ELSE {TENTHS.format("(x / 1000.0::DOUBLE)")} END) || 'K' ELSE '$' || CAST(CAST(x AS BIGINT) AS VARCHAR) END AS money,
  format('{{:,}}', CAST(x AS BIGINT)) AS thousands FROM v""")
def money_compact(spark, d):
    k = F.col("o_orderkey")
    x = F.floor("o_totalprice") * F.when(k % 4 == 0, 1).when(k % 4 == 1, 10).when(k % 4 == 2, 0).otherwise(1000) + F.when(k % 4 == 2, (k % 50) * 25000).otherwise(0)
    v = table(spark, d, "orders").select(k.alias("id"), x.cast("double").alias("x"))
    return v.select("id", numbers.short_money(F.col("x")).alias("money"), numbers.thousands(F.col("x")).alias("thousands"))


@query(f"""SELECT page_id, CASE WHEN n = 0 THEN '' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {TENTHS.format("(n / 1024.0::DOUBLE)")} || ' KB' ELSE {TENTHS.format("(n / 1048576.0::DOUBLE)")} || ' MB' END AS size FROM (SELECT page_id, length(html) * CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 400 END AS n FROM pages)""")
def file_size(spark, d):
    n = F.char_length("html") * F.when(F.col("page_id") % 3 == 0, 0).when(F.col("page_id") % 3 == 1, 1).otherwise(400)
    return table(spark, d, "pages").select("page_id", numbers.file_size(n.cast("long")).alias("size"))


@query("""SELECT c_custkey AS id, CAST(floor(100 * c_acctbal / 9999.0::DOUBLE + 0.5) AS BIGINT) || '%' AS percent, CAST(least(greatest(c_acctbal / 5000.0::DOUBLE, 0), 1) AS DOUBLE) AS clamped, (c_custkey % 3) || ' item' || CASE WHEN c_custkey % 3 = 1 THEN '' ELSE 's' END AS items FROM customer""")
def percent_labels(spark, d):
    share = F.col("c_acctbal") / F.lit(9999.0)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.floor(F.lit(100) * F.col("c_acctbal") / F.lit(9999.0) + F.lit(0.5)).cast("string"), F.lit("%")).alias("percent"), numbers.clamp(F.col("c_acctbal") / F.lit(5000.0)).alias("clamped"), text.plural(F.col("c_custkey") % 3, "item").alias("items"))


@query("""WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '.') || '@x.org' WHEN 2 THEN '  ' || p_brand ELSE '' END AS s FROM part), w AS (SELECT id, s, list_filter(regexp_split_to_array(s, '[\\s@.]+'), lambda x: x <> '') AS l FROM v)
SELECT id, CASE WHEN len(l) = 0 THEN '?' ELSE upper(substr(l[1], 1, 1)) || coalesce(upper(substr(l[2], 1, 1)), '') END AS initials FROM w""")
def initials(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("@x.org"))).when(k % 4 == 2, F.concat(F.lit("  "), "p_brand")).otherwise("")
    return table(spark, d, "part").select(k.alias("id"), text.initials(s).alias("initials"))


@query("""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' ' || regexp_replace(url, '^https?://', '') || ' ' WHEN 2 THEN upper(url) ELSE '  ' END AS u FROM pages)
SELECT page_id, CASE WHEN trim(u) = '' OR regexp_matches(trim(u), '(?i)^https?://') THEN trim(u) ELSE 'https://' || trim(u) END AS link, regexp_replace(u, '^https?://', '') AS label FROM v""")
def url_normalize(spark, d):
    k = F.col("page_id")
    u = F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.concat(F.lit(" "), text.link_label(F.col("url")), F.lit(" "))).when(k % 4 == 2, F.upper("url")).otherwise("  ")
    return table(spark, d, "pages").select("page_id", text.link(u).alias("link"), text.link_label(u).alias("label"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.?!])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l) AS n, l[1] AS first, l[-1] AS last FROM s""")
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("l"))
    return s.select("doc_id", F.size("l").cast("long").alias("n"), F.get("l", F.lit(0)).alias("first"), F.element_at("l", -1).alias("last"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations) SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN len(l) END AS lines, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') END AS joined FROM s""")
def line_split(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", text.line_list(F.col("text")).alias("l"))
    return s.select("conv_id", "turn", F.when(F.col("l").isNotNull(), F.size("l")).cast("long").alias("lines"), F.array_join("l", "|").alias("joined"))


@query("""WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', ' , ') WHEN 1 THEN ' , ' WHEN 2 THEN '' ELSE p_name || ',,' || p_brand END AS s FROM part), w AS (SELECT id, s, list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM v)
SELECT id, CASE WHEN s <> '' THEN array_to_string(l, '|') END AS parts, CASE WHEN s <> '' THEN len(l) END AS n FROM w""")
def comma_split(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.replace("p_name", F.lit(" "), F.lit(" , "))).when(k % 4 == 1, " , ").when(k % 4 == 2, "").otherwise(F.concat("p_name", F.lit(",,"), "p_brand"))
    v = table(spark, d, "part").select(k.alias("id"), text.comma_list(s).alias("l"))
    return v.select("id", F.array_join("l", "|").alias("parts"), F.when(F.col("l").isNotNull(), F.size("l")).cast("long").alias("n"))


@query(r"""WITH v AS (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN '  The ' || n_name WHEN 1 THEN n_name ELSE 'THE' || n_name || ' ' END AS s FROM nation) SELECT id, regexp_replace(lower(trim(s)), '^the\s+', '') AS key, upper(substr(trim(regexp_replace(lower(s), '[._]+', ' ', 'g')), 1, 1)) || substr(trim(regexp_replace(lower(s), '[._]+', ' ', 'g')), 2) AS greeting, regexp_replace(s, '[^0-9]', '', 'g') AS digits FROM v""")
def org_normalize(spark, d):
    k = F.col("n_nationkey")
    s = F.when(k % 3 == 0, F.concat(F.lit("  The "), "n_name")).when(k % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("THE"), "n_name", F.lit(" ")))
    return table(spark, d, "nation").select(k.alias("id"), text.org_key(s).alias("key"), text.greeting_name(F.concat(F.lower(s), F.lit("@x.org"))).alias("greeting"), text.digits(s).alias("digits"))


@query(sql("SELECT id, CAST(json_extract_string(raw, '$.k') AS DOUBLE) AS k, CASE WHEN json_type(raw, '$.k') = 'VARCHAR' THEN json_extract_string(raw, '$.k') END AS k_text, json_extract_string(raw, '$.a[0].b') AS missing FROM v_log"))
def json_path(spark, d):
    return ad.log(spark, d).select("id", arrays.json_number(F.col("raw"), "$.k").alias("k"), arrays.json_text(F.col("raw"), "$.k").alias("k_text"), F.get_json_object("raw", "$.a[0].b").alias("missing"))


@query("""SELECT n_nationkey AS id, '{"rationale":"' || n_name || '","ein":' || n_regionkey || '}' AS built FROM nation""")
def json_build(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_name").alias("rationale"), F.col("n_regionkey").alias("ein"))).alias("built"))


@query("""SELECT n_regionkey AS id, string_agg(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' (Region ' || n_regionkey || ')' ELSE '' END, ', ' ORDER BY n_nationkey) AS funders, string_agg(n_name || ' (lead)' || CASE WHEN n_nationkey % 3 = 0 THEN ' [phone: ' || n_nationkey || ']' ELSE '' END, ', ' ORDER BY n_nationkey) AS people FROM nation GROUP BY n_regionkey""")
def struct_array_text(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(k.alias("o"), F.col("n_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))).alias("location"), F.lit("lead").alias("role"), F.when(k % 3 == 0, k.cast("string")).alias("phone")))).alias("a")
    )
    return rows.select("id", arrays.named_places(F.col("a")).alias("funders"), arrays.people(F.col("a")).alias("people"))


def _profiles(spark, d):
    """A profile for each customer, with gaps by modulus."""
    k = F.col("c_custkey")
    some = lambda n, c: F.when(k % n != 0, c)
    items = lambda n, a, b: F.when(k % n != 0, F.array(F.lit(a), F.lit(b))).when(k % 2 == 0, F.array().cast("array<string>"))
    none = "array<struct<name:string,role:string,phone:string,location:string>>"
    who = F.array(F.struct(F.col("c_name").alias("name"), F.lit("CEO").alias("role"), F.when(k % 3 == 0, F.lit("555")).alias("phone"), F.when(k % 4 == 0, F.lit("Town")).alias("location"))).cast(none)
    return table(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "other").otherwise("public_charity").alias("org_type"), some(4, F.lit("Trust")).alias("org_type_other"), (k % 3 * 1000).cast("int").alias("year_founded"), some(5, F.lit("x.org")).alias("website"),
        F.floor("c_acctbal").cast("double").alias("annual_budget"), some(6, F.lit("need")).alias("funding_need"), some(7, F.lit("problem")).alias("problem_statement"), F.when(k % 8 == 0, "").otherwise("mission").alias("mission"), some(9, F.lit("vision")).alias("vision"),
        some(3, F.lit("programs")).alias("programs"), some(4, F.lit("youth")).alias("who_we_serve"), some(5, F.lit("Austin")).alias("hq_location"), items(3, "Education", "Arts").alias("cause_areas"), some(2, F.lit("Parks")).alias("cause_area_other"),
        items(4, "Texas", "Ohio").alias("geographic_areas"), items(5, "candor", "care").alias("org_values"), items(6, "more", "better").alias("outcomes"), F.when(k % 7 != 0, who).alias("key_people"), F.when(k % 5 != 0, who).alias("notable_funders"),
    )


@query("""SELECT c_custkey AS id, (2 + CAST(k % 3 <> 0 AS INT) + CAST(k % 5 <> 0 AS INT) + CAST(floor(c_acctbal) <> 0 AS INT) + CAST(k % 6 <> 0 AS INT) + CAST(k % 7 <> 0 AS INT) + CAST(k % 8 <> 0 AS INT) + CAST(k % 3 <> 0 AS INT) + CAST(k % 4 <> 0 AS INT) + CAST(k % 5 <> 0 AS INT)
  + CAST(k % 7 <> 0 AS INT) + CAST(k % 4 <> 0 AS INT) + CAST(k % 3 <> 0 AS INT) + CAST(k % 5 <> 0 AS INT) + CAST(k % 6 <> 0 AS INT) + CAST(k % 5 <> 0 AS INT)) / 17.0::DOUBLE AS share,
  k % 8 <> 0 AND k % 7 <> 0 AS mission, floor(c_acctbal) <> 0 AND k % 6 <> 0 AS financial, k % 7 <> 0 AS people, k % 4 <> 0 AS geography, k % 6 <> 0 AS track_record FROM (SELECT *, c_custkey AS k FROM customer)""")
def profile_completeness(spark, d):
    p = _profiles(spark, d)
    return p.select("id", profile.completeness(p).alias("share"), *[c.alias(n) for n, c in profile.health(p).items()])


@query("""SELECT c_custkey AS id, concat_ws(chr(10), 'Organization: ' || c_name, 'Legal status: ' || CASE WHEN k % 2 = 0 THEN 'other' || CASE WHEN k % 4 <> 0 THEN ' (Trust)' ELSE '' END ELSE 'public_charity' END, CASE WHEN k % 3 <> 0 THEN 'Founded: ' || (k % 3 * 1000) END,
  CASE WHEN floor(c_acctbal) <> 0 THEN 'Annual budget: $' || format('{:,}', CAST(floor(c_acctbal) AS BIGINT)) END, CASE WHEN k % 6 <> 0 THEN 'Current funding need: need' END, CASE WHEN k % 7 <> 0 THEN 'Problem statement: problem' END, CASE WHEN k % 8 <> 0 THEN 'Mission: mission' END, CASE WHEN k % 9 <> 0 THEN 'Vision: vision' END,
  CASE WHEN k % 3 <> 0 THEN 'Programs: programs' END, CASE WHEN k % 3 <> 0 AND k % 2 <> 0 THEN 'Cause area(s): Education, Arts, Parks' WHEN k % 3 <> 0 THEN 'Cause area(s): Education, Arts' WHEN k % 2 <> 0 THEN 'Cause area(s): Parks' END, CASE WHEN k % 4 <> 0 THEN 'Population(s) served: youth' END,
  CASE WHEN k % 4 <> 0 THEN 'Geographic area served: Texas, Ohio' END, CASE WHEN k % 5 <> 0 THEN 'HQ location: Austin' END, CASE WHEN k % 5 <> 0 THEN 'Core values: candor; care' END, CASE WHEN k % 6 <> 0 THEN 'Key outcomes: more; better' END,
  CASE WHEN k % 5 <> 0 THEN 'Notable funders: ' || c_name || CASE WHEN k % 4 = 0 THEN ' (Town)' ELSE '' END END, CASE WHEN k % 7 <> 0 THEN 'Key people: ' || c_name || ' (CEO)' || CASE WHEN k % 3 = 0 THEN ' [phone: 555]' ELSE '' END END) AS summary FROM (SELECT *, c_custkey AS k FROM customer)""")
def profile_summary(spark, d):
    p = _profiles(spark, d)
    return p.select("id", profile.summary(p).alias("summary"))


@query("""SELECT c_custkey AS id, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, ''), CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, '') AS own, CASE WHEN c_custkey % 4 = 0 THEN 'a|b' ELSE c_mktsegment END AS items FROM customer""")
def gap_fill(spark, d):
    k = F.col("c_custkey")
    own = F.when(k % 2 == 0, "").otherwise(F.col("c_name"))
    mine = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 1, F.array().cast("array<string>"))
    return table(spark, d, "customer").select(k.alias("id"), arrays.fill_gaps(own, F.when(k % 3 == 0, F.col("c_mktsegment"))).alias("own"), F.array_join(arrays.fill_list(mine, F.array("c_mktsegment")), "|").alias("items"))


# --- lifecycle --------------------------------------------------------------


# Of the commands that name a record's stage the first moves it; the others then name a stage that it has left.
MOVES = """moves AS (SELECT l.id, l.prospect_id AS record_id, l.to_stage AS from_stage, l.created_at, p.id IS NOT NULL AND row_number() OVER (PARTITION BY l.prospect_id, p.id IS NOT NULL ORDER BY l.created_at, l.id) = 1 AS accepted
  FROM v_log l LEFT JOIN v_prospects p ON p.id = l.prospect_id AND p.stage = l.to_stage)"""


def _commands(spark, d):
    return ad.log(spark, d).select("id", "created_at", F.col("prospect_id").alias("record_id"), F.col("to_stage").alias("from_stage"), F.lit("renewal").alias("to_stage"))


@query(sql(f"@{MOVES} SELECT id, record_id, accepted FROM moves"))
def cas_updates(spark, d):
    return lifecycle.move_stages(ad.prospects(spark, d), _commands(spark, d)).select("id", "record_id", "accepted")


@query(sql(f"""@{MOVES} SELECT CASE WHEN m.record_id IS NOT NULL THEN 'renewal' ELSE stage END AS stage, CASE WHEN m.record_id IS NOT NULL THEN '{ad.AS_OF}' END AS updated, count(*) AS n
FROM v_prospects p LEFT JOIN (SELECT record_id FROM moves WHERE accepted) m ON m.record_id = p.id GROUP BY ALL"""))
def moved_stages(spark, d):
    p = ad.prospects(spark, d)
    accepted = lifecycle.move_stages(p, _commands(spark, d)).where("accepted")
    moved = lifecycle.apply_moves(p, accepted, ad.as_of())
    return moved.groupBy("stage", F.date_format("updated_at", "yyyy-MM-dd").alias("updated")).agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"@{MOVES} SELECT record_id AS prospect_id, from_stage, 'renewal' AS to_stage, id AS command FROM moves WHERE accepted"))
def stage_move_audit(spark, d):
    """What a move of stages appends to the log of changes."""
    accepted = lifecycle.move_stages(ad.prospects(spark, d), _commands(spark, d)).where("accepted")
    return accepted.select(F.col("record_id").alias("prospect_id"), "from_stage", "to_stage", F.col("id").alias("command"))


@query(sql("SELECT id, row_number() OVER (PARTITION BY prospect_id ORDER BY created_at, id) = 1 AS won FROM v_log"))
def claim_lock(spark, d):
    return lifecycle.first_claims(ad.log(spark, d), "prospect_id", "created_at").select("id", "won")


@query(sql("""SELECT 'parents' AS kind, count(*) AS n FROM v_prospects WHERE id % 10 <> 3 UNION ALL SELECT 'children', count(*) FROM v_log WHERE prospect_id % 10 <> 3 UNION ALL SELECT 'unlinked', count(*) FROM v_contacts WHERE id % 10 = 3
UNION ALL SELECT 'orphans', count(*) FROM v_log WHERE prospect_id % 10 = 3"""))
def delete_cascade(spark, d):
    p, log = ad.prospects(spark, d), ad.log(spark, d)
    parents, children = lifecycle.delete_with_children(p, log, p.where("id % 10 = 3").select("id"), "id", "prospect_id")
    linked = lifecycle.unlink_missing(ad.contacts(spark, d).withColumn("source", F.col("id")), parents, "source", "id").where("source is null")
    counts = [("parents", parents), ("children", children), ("unlinked", linked), ("orphans", lifecycle.orphans(log, parents, "prospect_id", "id"))]
    out = None
    for kind, df in counts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("SELECT count(*) FILTER (WHERE organization IS NULL) AS organization, count(*) FILTER (WHERE name IS NULL) AS name, count(*) FILTER (WHERE ask_amount IS NULL) AS ask_amount FROM v_prospects"))
def constraint_violations(spark, d):
    return lifecycle.missing_values(ad.prospects(spark, d), ["organization", "name", "ask_amount"])


@query(sql("""@steps AS (SELECT id, to_stage, lag(to_stage) OVER (PARTITION BY prospect_id ORDER BY created_at, id) AS from_state FROM v_log)
SELECT id, from_state, from_state IS NULL OR (from_state, to_stage) IN (('view', 'click'), ('click', 'signup'), ('signup', 'purchase'), ('view', 'error')) AS valid FROM steps"""))
def transition_check(spark, d):
    allowed = spark.createDataFrame([("view", "click"), ("click", "signup"), ("signup", "purchase"), ("view", "error")], "from_state string, to_state string")
    return lifecycle.transitions_checked(ad.log(spark, d), allowed, "prospect_id", "to_stage", ["created_at", "id"]).select("id", "from_state", "valid")


@query(sql("""SELECT id, status FROM (SELECT c.id, coalesce(w.status, c.status) AS status FROM v_candidates c LEFT JOIN (SELECT prospect_id, max_by(CASE to_stage WHEN 'view' THEN 'saved' WHEN 'error' THEN 'dismissed' ELSE 'pending' END, id) AS status FROM v_log GROUP BY prospect_id) w ON w.prospect_id = c.id)"""))
def status_commands(spark, d):
    c = ad.candidates(spark, d).select("id", "status")
    to = F.when(F.col("to_stage") == "view", "saved").when(F.col("to_stage") == "error", "dismissed").otherwise("pending")
    log = ad.log(spark, d)
    writes = log.select(F.col("prospect_id").alias("id"), to.alias("status"), F.col("id").alias("seq")).join(c.select("id"), "id", "left_semi")
    return lifecycle.last_write_wins(c, writes, "id", "seq")


@query(sql("SELECT id, CASE WHEN id % 7 = 0 THEN 'disabled' WHEN organization IS NULL THEN 'no actor' WHEN size >= 15 THEN 'queue full' ELSE 'run' END AS decision FROM v_candidates"))
def cron_gate(spark, d):
    return ad.candidates(spark, d).select("id", lifecycle.gate(F.col("id") % 7 != 0, F.col("organization"), F.col("size"), F.lit(15)).alias("decision"))


@query(sql("SELECT id, prospect_id FROM v_log WHERE to_stage = 'click' AND prospect_id IN (SELECT prospect_id FROM v_log WHERE to_stage = 'signup' AND approved IS NOT NULL)"))
def draft_gate(spark, d):
    log = ad.log(spark, d)
    approved = log.where((F.col("to_stage") == "signup") & F.col("approved").isNotNull()).select("prospect_id").distinct()
    return log.where(F.col("to_stage") == "click").join(approved, "prospect_id", "left_semi").select("id", "prospect_id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS n_areas, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS areas, 0 AS score FROM customer""")
def schema_evolution(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("area"), F.lit(1).alias("dropped"))
    c = c.withColumn("areas", F.when(F.col("area").isNotNull(), F.array("area"))).drop("area", "dropped").withColumn("score", F.lit(0))
    return c.select("id", arrays.size_or_zero(F.col("areas")).alias("n_areas"), F.array_join("areas", ",").alias("areas"), "score")


@query("""SELECT p_partkey AS id, p_name || ', "' || p_brand || '"' AS name, upper(p_type) AS channel, CASE WHEN p_partkey % 2 = 0 THEN 'a|b' END AS focus_areas, p_partkey % 3 <> 0 AS valid FROM (SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS x FROM part)""")
def csv_import(spark, d):
    k = F.col("p_partkey")
    q = F.lit('"')
    line = F.concat(q, "p_name", F.lit(', ""'), "p_brand", F.lit('"""'), F.lit(","), F.upper("p_type"), F.when(k % 3 == 0, "?").otherwise(""), F.lit(","), F.when(k % 2 == 0, '"a, b"').otherwise(""))
    lines = table(spark, d, "part").select(k.alias("id"), line.alias("value"))
    rows = read_csv_rows(lines, " Name,CHANNEL,focus_areas", ["name", "channel", "focus_areas"])
    known = [t for t in ("ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE", "PROMO")]
    out = checked_import(rows, known)
    return out.select("id", "name", F.replace("channel", F.lit("?"), F.lit("")).alias("channel"), F.array_join("focus_areas", "|").alias("focus_areas"), "valid")


# --- screens ----------------------------------------------------------------


@query(sql(f"""@{AGED}, {APPLIED} SELECT a.id, a.name, a.stage, round(a.days, 6) AS days, t.tier, {HEALTH.replace("next_action_due", "a.next_action_due")} AS health FROM aged a JOIN tiered t ON t.id = a.id"""))
def pipeline_board(spark, d):
    p = ad.prospects(spark, d)
    aged = stages.days_in_stage(p, ad.log(spark, d), ad.as_of())
    tiers = screening.screened(p, ad.rules(spark), FIELDS).select("id", "tier")
    health = dates.health_status(F.col("next_action_due"), ad.as_of())
    return aged.join(tiers, "id").select("id", "name", "stage", F.round("days", 6).alias("days"), "tier", health.alias("health"))


@query(sql(f"""@{LATEST} SELECT 'prospects' AS card, count(*) AS n FROM v_prospects UNION ALL SELECT 'pending', count(*) FROM v_candidates WHERE status = 'pending' UNION ALL SELECT 'due this week', count(*) FROM v_prospects WHERE next_action_due BETWEEN DATE '{ad.AS_OF}' AND DATE '{ad.AS_OF}' + 7
UNION ALL SELECT 'ready', count(*) FROM latest WHERE to_stage = 'signup' AND approved IS NULL"""))
def dashboard_cards(spark, d):
    today = F.lit(ad.AS_OF).cast("date")
    p = ad.prospects(spark, d)
    cards = {
        "prospects": p, "pending": ad.candidates(spark, d).where(F.col("status") == "pending"), "due this week": p.where(F.col("next_action_due").between(today, F.date_add(today, 7))),
        "ready": latest.latest_per_key(ad.log(spark, d), ["prospect_id"]).where((F.col("to_stage") == "signup") & F.col("approved").isNull()),
    }
    out = None
    for name, df in cards.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("card"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql(f"""@{APPLIED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY created_at DESC, id DESC) AS rn FROM v_log),
h AS (SELECT prospect_id, count(*) AS total, string_agg(to_stage, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS newest FROM ranked GROUP BY prospect_id),
entry AS (SELECT prospect_id, max(l.created_at) AS at FROM v_log l JOIN v_prospects p ON p.id = l.prospect_id WHERE l.to_stage = p.stage GROUP BY prospect_id)
SELECT p.id, CASE WHEN s.value IS NULL THEN 'view' ELSE n.value END AS next_stage, round((epoch_us(TIMESTAMP '{ad.AS_OF}') - epoch_us(coalesce(e.at, p.created_at))) / 86400000000.0::DOUBLE, 6) AS days,
  coalesce(h.total, 0) AS changes, h.newest AS history, CAST(floor(t.share * 100 + 0.5) AS BIGINT) AS fit, t.tier, coalesce(k.n, 0) AS contacts
FROM v_prospects p JOIN tiered t ON t.id = p.id LEFT JOIN v_stages s ON s.value = p.stage LEFT JOIN v_stages n ON n.ord = s.ord + 1 LEFT JOIN h ON h.prospect_id = p.id LEFT JOIN entry e ON e.prospect_id = p.id
LEFT JOIN (SELECT id % 100 AS of, count(*) AS n FROM v_contacts WHERE email IS NOT NULL GROUP BY 1) k ON k.of = p.id"""))
def prospect_detail(spark, d):
    """The page of every prospect: what comes next, days in the stage, the newest changes, the fit, and how many contacts."""
    p, log = ad.prospects(spark, d), ad.log(spark, d)
    page = stages.with_next_stage(stages.days_since_entry(p, log, ad.as_of()), _stages(spark))
    history = lookups.newest_list(log, "prospect_id", "to_stage", ["created_at", "id"], 3)
    fit = screening.screened(p, ad.rules(spark), FIELDS).select("id", "share", "tier")
    people = ad.contacts(spark, d).where("email is not null").groupBy((F.col("id") % 100).alias("of")).agg(F.count(F.lit(1)).alias("contacts"))
    out = page.join(fit, "id").join(history, F.col("id") == F.col("prospect_id"), "left").join(people, F.col("id") == F.col("of"), "left")
    return out.select(
        "id", "next_stage", F.round("days", 6).alias("days"), F.coalesce("total", F.lit(0)).alias("changes"), F.array_join("newest", ",").alias("history"),
        numbers.round_half_up(F.col("share") * 100).cast("long").alias("fit"), "tier", F.coalesce("contacts", F.lit(0)).alias("contacts"),
    )


#: What each run thought of four channels: recommended or not, surely or not.
EVALUATED = """SELECT id, prospect_id AS org, created_at, c.channel, c.pos, c.ok, c.high FROM v_log, (SELECT unnest([
  {'channel': 'BUILDING', 'pos': 0, 'k': 2}, {'channel': 'FURNITURE', 'pos': 1, 'k': 3}, {'channel': 'HOUSEHOLD', 'pos': 2, 'k': 1}, {'channel': 'MACHINERY', 'pos': 3, 'k': 5}], recursive := true)) u, LATERAL (SELECT u.channel, u.pos, v_log.id % u.k = 0 AS ok, v_log.id % (u.k + 2) = 0 AS high) c"""


@query(sql(f"""@runs AS (SELECT id, prospect_id AS org, row_number() OVER (PARTITION BY prospect_id ORDER BY created_at DESC, id DESC) AS rn, count(*) OVER (PARTITION BY prospect_id) - 1 AS history FROM v_log),
e AS ({EVALUATED}), rec AS (SELECT e.id, string_agg(channel, '|' ORDER BY high DESC, pos) AS recommended FROM e WHERE ok GROUP BY 1),
n AS (SELECT s.value, count(u.channel) AS n FROM v_segments s LEFT JOIN (SELECT channel FROM v_prospects UNION ALL SELECT upper(channel) FROM v_candidates) u ON u.channel = s.value GROUP BY 1)
SELECT r.org, r.id AS run, r.history, coalesce(rec.recommended, '') AS recommended, (SELECT string_agg(value || '=' || n, ',' ORDER BY value) FROM n) AS counts FROM runs r LEFT JOIN rec USING (id) WHERE rn = 1"""))
def channel_fit(spark, d):
    """The page of each organization: its newest run, how many came before, the channels which that run recommends, surest first, and what is in each channel."""
    i = F.col("id")
    one = lambda name, k: F.struct(F.lit(name).alias("channel"), (i % k == 0).alias("recommended"), F.when(i % (k + 2) == 0, "high").otherwise("low").alias("confidence"))
    runs = ad.log(spark, d).select("id", F.col("prospect_id").alias("org"), "created_at", F.array(one("BUILDING", 2), one("FURNITURE", 3), one("HOUSEHOLD", 1), one("MACHINERY", 5)).alias("evaluations"))
    newest = runs.groupBy("org").agg(F.max_by(F.struct("id", "evaluations"), F.struct("created_at", "id")).alias("r"), (F.count(F.lit(1)) - 1).alias("history"))
    first = F.transform(arrays.high_confidence_first(F.col("r.evaluations")), lambda e: e["channel"])
    both = ad.prospects(spark, d).select("channel").unionByName(ad.candidates(spark, d).select(F.upper("channel").alias("channel")))
    counts = stages.zero_filled(ad.segments(spark, d).select("value"), both.groupBy("channel").agg(F.count(F.lit(1)).alias("n")), "channel", {"n": 0})
    line = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "value", F.col("n").cast("string")))), ",")  # as many as there are channels
    return newest.crossJoin(F.broadcast(counts.agg(line.alias("counts")))).select("org", F.col("r.id").alias("run"), "history", F.array_join(first, "|").alias("recommended"), "counts")  # one row


@query(sql(f"""@{APPLIED.replace("v_prospects p", "(SELECT * FROM v_candidates) p")} SELECT t.id, t.share, t.tier FROM tiered t JOIN v_candidates c ON c.id = t.id WHERE c.status = 'pending'"""))
def discovery_workspace(spark, d):
    c = ad.candidates(spark, d)
    s = screening.screened(c.where(F.col("status") == "pending"), ad.rules(spark), FIELDS)
    return s.select("id", "share", "tier")
