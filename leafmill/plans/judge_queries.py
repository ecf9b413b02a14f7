"""Sampling, parsing and summing up grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import judge
from leafmill.plans.registry import query, table


@query("""
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, position, n FROM p WHERE n <= 3 OR position IN (0, CAST(round_even((n - 1) / 2, 0) AS INT), n - 1)
""")
def judge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns of each conversation, evenly spread."""
    turns = table(spark, sf_dir, "conversations")
    return judge.sampled_rows(turns, "conv_id", F.struct("turn", "role", "text"), 3).select("conv_id", "turn", "position", "n")


REPLY_SQL = """CASE doc_id % 9 WHEN 0 THEN 'no object here' WHEN 1 THEN 'broken {"score": ' ELSE
  'Well: {"transcription": "label ' || doc_id || ' of the page", "score": ' || (doc_id % 10 + 1) || ', "verdict": "' || (CASE doc_id % 4 WHEN 0 THEN 'poor' WHEN 1 THEN 'acceptable' ELSE 'good' END) || '", "reading_order_ok": ' ||
  (CASE doc_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'null' ELSE 'true' END) || ', "missing_text": ["a", "b"], "wrong_text": [{"ocr": "x' || doc_id || '", "actual": "y"}, "odd"]} done' END"""
TEXT_SQL = "CASE doc_id % 3 WHEN 0 THEN 'label ' || doc_id || ' of the page' WHEN 1 THEN 'label  of teh page' ELSE '' END"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about labels as pages: some hold no JSON, some broken JSON."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 7).alias("source"))
    return labels.select("doc_id", "source", F.expr(REPLY_SQL).alias("reply"), F.expr(TEXT_SQL).alias("text"), (F.col("doc_id") % 40 / 4.0).alias("llm_call_latency_seconds"), F.col("doc_id").alias("llm_input_tokens"), (F.col("doc_id") % 100).alias("llm_output_tokens"))


PAGES_SQL = f"""
WITH r AS (SELECT doc_id, doc_id % 7 AS source, {REPLY_SQL} AS reply, trim(regexp_replace({TEXT_SQL}, ' +', ' ', 'g')) AS text FROM labels),
j AS (SELECT *, CASE WHEN doc_id % 9 > 1 THEN regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) END AS js, 'label ' || doc_id || ' of the page' AS said FROM r),
c AS (SELECT *, levenshtein(said, text) / length(said) AS cer, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END / 5 AS wer FROM j),
pages AS (SELECT doc_id, source, CAST(js->>'score' AS DOUBLE) AS rating, js->>'verdict' AS verdict, CAST(js->>'reading_order_ok' AS BOOLEAN) AS in_order,
  CASE WHEN js IS NOT NULL THEN round_even(greatest(0, least(100, 100 * (1 - cer))), 2) END AS char_accuracy, CASE WHEN js IS NOT NULL THEN round_even(greatest(0, least(100, 100 * (1 - wer))), 2) END AS word_accuracy,
  CASE WHEN js IS NOT NULL THEN round_even(100 * cer, 2) END AS char_error, CASE WHEN js IS NOT NULL THEN round_even(100 * wer, 2) END AS word_error,
  CASE doc_id % 9 WHEN 0 THEN 'ValueError: no JSON object in the judge''s reply' WHEN 1 THEN 'ValueError: no JSON object in the judge''s reply' END AS error_message, doc_id % 40 / 4e0 AS latency FROM c)"""


@query(PAGES_SQL + """ SELECT doc_id, rating, verdict, in_order, char_accuracy, word_accuracy, char_error, word_error, error_message, CASE WHEN error_message IS NULL THEN 'a,b' END AS missing, CASE WHEN error_message IS NULL THEN 'x' || doc_id || '>y' END AS misread FROM pages""")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = judge.graded(replies(spark, sf_dir))
    short = {"llm_quality_rating_out_of_10": "rating", "llm_verdict": "verdict", "reading_order_correct": "in_order", "character_accuracy_percent": "char_accuracy", "word_accuracy_percent": "word_accuracy", "character_error_rate_percent": "char_error", "word_error_rate_percent": "word_error"}
    misread = F.array_join(F.transform("misread_text", lambda w: F.concat(w["ocr_text_says"], F.lit(">"), w["page_actually_says"])), ",")
    return told.select("doc_id", *(F.col(k).alias(v) for k, v in short.items()), "error_message", F.array_join("text_on_page_missing_from_ocr", ",").alias("missing"), misread.alias("misread"))


@query(PAGES_SQL + """ SELECT source, source IS NULL AS is_overall, round_even(avg(rating), 2) AS average_llm_quality_rating_out_of_10, round_even(avg(char_accuracy), 2) AS average_character_accuracy_percent, round_even(avg(word_accuracy), 2) AS average_word_accuracy_percent,
  round_even(avg(char_error), 2) AS average_character_error_rate_percent, round_even(avg(word_error), 2) AS average_word_error_rate_percent, count(*) FILTER (verdict = 'good') AS number_of_pages_good, count(*) FILTER (verdict = 'acceptable') AS number_of_pages_acceptable,
  count(*) FILTER (verdict = 'poor') AS number_of_pages_poor, count(*) FILTER (NOT in_order) AS number_of_pages_with_wrong_reading_order, CAST(sum(doc_id) AS BIGINT) AS total_llm_input_tokens, CAST(sum(doc_id % 100) AS BIGINT) AS total_llm_output_tokens,
  round_even(sum(latency), 2) AS total_llm_call_latency_seconds, round_even(avg(latency), 2) AS average_llm_call_latency_seconds, count(*) AS number_of_pages_judged FROM pages WHERE error_message IS NULL GROUP BY ROLLUP (source)""")
def judge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.summaries(judge.graded(replies(spark, sf_dir)))
