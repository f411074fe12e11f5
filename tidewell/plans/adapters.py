"""The domain's tables on the generated ones. Nulls come from modulus conditions, as the source has none.

``CTE`` has the same definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.tables import table

STAGES = [("view", "View"), ("click", "Click"), ("signup", "Signup"), ("purchase", "Purchase"), ("error", "Error"), ("renewal", "Renewal")]
CHANNELS = [(c, c.capitalize()) for c in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SHIPPING")]
STATUSES = ["pending", "saved", "dismissed", "accepted"]
AS_OF = "2024-02-01"
RULES = [
    # rule_id, ord, label, channel, weight, field, operator, value, active
    (1, 1, "In furniture", None, 3, "channel", "equals", "furniture", True),
    (2, 2, "Has an organization", None, 5, "organization", "is_set", None, True),
    (3, 3, "Name ends in 7", "BUILDING", 4, "name", "contains", "7", True),
    (4, 4, "Not in nation 1", "HOUSEHOLD", 2, "organization", "not_equals", "nation_1", True),
    (5, 5, "No organization", "MACHINERY", 1, "organization", "is_not_set", None, True),
    (6, 6, "Without a 9", "FURNITURE", 3, "name", "not_contains", "9", True),
    (7, 7, "Switched off", None, 5, "name", "is_set", None, False),
    (8, 8, "Unknown test", "AUTOMOBILE", 2, "name", "resembles", "x", True),
    (9, 9, "Weighs nothing", None, 0, "name", "is_set", None, True),
]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def rules(spark: SparkSession) -> DataFrame:
    kinds = "rule_id int, ord int, label string, channel string, weight int, field string, operator string, value string, active boolean"
    return spark.createDataFrame(RULES, kinds)


def _case(key: Column, n: int, values: list[str], other: str) -> Column:
    out = F.lit(other)
    for i, v in enumerate(values):
        out = F.when(key % n == i, v).otherwise(out)
    return out


def prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(  # 25 nations
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("channel"),
        _case(k, 6, ["view", "click", "signup", "purchase", "error"], "legacy").alias("stage"),
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("ask_amount"),
        F.lit("2023-12-01").cast("timestamp").alias("created_at"),
        F.when(k % 4 != 0, F.date_add(F.lit(AS_OF).cast("date"), (k % 15 - 5).cast("int"))).alias("next_action_due"),
        F.when(k % 3 != 0, F.col("n_name")).alias("organization"),
    )


def table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part."""
    k = F.col("p_partkey")
    channel = F.element_at(F.array(*[F.lit(c) for c, _ in CHANNELS[:4]]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("rule_id"), F.when(k % 6 != 0, channel).alias("channel"), (F.col("p_size") % 6).alias("weight"), (k % 3 != 0).alias("active"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the customers as a list: ord, value, label, n. One row gathers them, as many as there are kinds."""
    kinds = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    one = kinds.agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("all"))
    return one.select(F.posexplode("all").alias("ord", "x")).select("ord", "x.value", F.initcap("x.value").alias("label"), "x.n")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("prospect_id"), F.col("event_type").alias("to_stage"), F.col("ts").cast("timestamp").alias("created_at"), F.col("props").alias("raw"),
        F.when(F.col("event_id") % 5 == 0, F.lit("yes")).alias("approved"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("channel"), F.when(k % 5 != 0, F.col("p_brand")).alias("organization"),
        F.col("p_size").alias("size"), _case(k, 4, STATUSES[:3], STATUSES[3]).alias("status"), F.col("p_retailprice").alias("price"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    email = F.concat(F.lit("user"), (k % 400).cast("string"), F.lit("@x.org"))
    return c.select(
        k.alias("id"), F.when(k % 10 == 0, email).otherwise(F.concat(F.lit("Person "), (k % 200).cast("string"))).alias("name"),
        F.when(k % 3 != 0, email).alias("email"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("organization"), F.col("c_acctbal").alias("created_at"),
    )


def _sql_case(key: str, n: int, values: list[str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {n} = {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE '{other}' END"


def _values(rows: list, names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS t({names})"


CTE = f"""
v_prospects AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS channel, {_sql_case("c_custkey", 6, ["view", "click", "signup", "purchase", "error"], "legacy")} AS stage,
    CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS ask_amount, TIMESTAMP '2023-12-01' AS created_at,
    CASE WHEN c_custkey % 4 <> 0 THEN DATE '{AS_OF}' + CAST(c_custkey % 15 - 5 AS INTEGER) END AS next_action_due,
    CASE WHEN c_custkey % 3 <> 0 THEN n_name END AS organization
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), v_log AS (
  SELECT event_id AS id, user_id AS prospect_id, event_type AS to_stage, ts AS created_at, props AS raw, CASE WHEN event_id % 5 = 0 THEN 'yes' END AS approved FROM events
), v_candidates AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS channel, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS organization, p_size AS size,
    {_sql_case("p_partkey", 4, STATUSES[:3], STATUSES[3])} AS status, p_retailprice AS price FROM part
), v_contacts AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'user' || (c_custkey % 400) || '@x.org' ELSE 'Person ' || (c_custkey % 200) END AS name,
    CASE WHEN c_custkey % 3 <> 0 THEN 'user' || (c_custkey % 400) || '@x.org' END AS email, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS organization, c_acctbal AS created_at FROM customer
), v_rules AS (
  SELECT * FROM {_values(RULES, "rule_id, ord, label, channel, weight, field, operator, value, active")}
), v_table_rules AS (
  SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 6 <> 0 THEN (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'])[p_partkey % 4 + 1] END AS channel, p_size % 6 AS weight, p_partkey % 3 <> 0 AS active FROM part
), v_segments AS (
  SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS ord, c_mktsegment AS value, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS label, count(*) AS n FROM customer GROUP BY c_mktsegment
), v_stages AS (
  SELECT * FROM {_values([(i, v, x) for i, (v, x) in enumerate(STAGES)], "ord, value, label")}
), v_channels AS (
  SELECT * FROM {_values([(i, v, x) for i, (v, x) in enumerate(CHANNELS)], "ord, value, label")}
)
"""


def sql(body: str) -> str:
    """A query over the adapters."""
    return f"WITH {CTE.strip()}{', ' if body.lstrip().startswith('@') else ' '}{body.lstrip().lstrip('@')}"
