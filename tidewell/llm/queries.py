"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.chat import conversation_digests

    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(turns.unionByName(extra))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.decontamination import contained_items

    out = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("text_hash")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.sharding import written_shards

    return written_shards(table(spark, sf_dir, "documents"), n_shards=40)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.near_join import near_classes

    return near_classes(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.licenses import license_spans

    return license_spans(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.repeats import repeat_summary

    return repeat_summary(table(spark, sf_dir, "documents"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.hmm import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.chroma import align, synthesised

    return align(synthesised(table(spark, sf_dir, "embeddings")), lambda k: k % 100 == 0)


def op11_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.token_files import written_tokens

    return written_tokens(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.runs import periodic_runs, run_digests, with_repeats

    return run_digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", changed), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat,
        "op2_decontamination": op2_decontamination,
        "op3_sharding": op3_sharding,
        "op4_ngram_join": op4_ngram_join,
        "op5_packing": op5_packing,
        "op6_licenses": op6_licenses,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_hmm": op8_hmm,
        "op9_quality": op9_quality,
        "op10_chroma": op10_chroma,
        "op11_token_codes": op11_token_codes,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_hard_negatives": op13_hard_negatives,
    }


#: The template adds 14 characters to a turn. Of these tables only the added conversation needs escapes: two in each turn.
OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(length(role) + length(text) + 14) + CASE WHEN conv_id = -7 THEN 4 ELSE 0 END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP2_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM item_words
), sizes AS (
  SELECT item_id, count(*) AS q FROM item_shingles GROUP BY item_id
), doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM doc_words
), found AS (
  SELECT d.doc_id, i.item_id, count(*) AS found FROM doc_shingles d JOIN item_shingles i USING (s) GROUP BY 1, 2
)
SELECT doc_id, item_id, q AS item_shingles, found, found::DOUBLE / q AS containment
FROM found JOIN sizes USING (item_id) WHERE found >= 0.8::DOUBLE * q
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op2_decontamination": OP2_SQL}
