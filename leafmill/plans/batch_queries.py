"""Units, documents and batches, from tables that stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import metrics
from leafmill.functions.charclass import WS
from leafmill.functions.text import normalize
from leafmill.operators import documents as D
from leafmill.operators.evaluate import throughput as speeds
from leafmill.operators.folders import numbered, with_folders
from leafmill.operators.ocr import block_text
from leafmill.operators.units import unit
from leafmill.plans.registry import query, table, texts
from leafmill.sources.results import unit_json

#: Files of up to four documents each; a unit fails if its text's length is a multiple of 3.
UNITS_SQL = """
WITH units AS (SELECT source || '/' || (doc_id // 4) AS file, row_number() OVER (PARTITION BY source, doc_id // 4 ORDER BY doc_id) - 1 AS idx, doc_id,
  CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'native' END AS origin, coalesce(text, '') AS text FROM documents),
sums AS (SELECT file, count(*) AS n_units, count(*) FILTER (status = 'error') AS n_failed, min(idx) FILTER (status = 'error') AS first FROM units GROUP BY file),
rolled AS (SELECT file, n_units, n_failed, CASE WHEN n_failed = n_units THEN 'error' WHEN n_failed > 0 THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN n_failed = n_units THEN 'CorruptFile' END AS error_type, CASE WHEN n_failed = n_units THEN 'unit ' || first || ' is damaged' END AS message FROM sums)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    file = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 4).cast("string"))
    index = F.row_number().over(Window.partitionBy("source", F.floor(F.col("doc_id") / 4)).orderBy("doc_id")) - 1
    text = F.coalesce("text", F.lit(""))
    bad = F.length(text) % 3 == 0
    told = docs.select("doc_id", file.alias("file"), index.alias("index"), F.when(bad, "error").otherwise("ok").alias("status"), F.when(F.col("doc_id") % 2 == 0, "ocr").otherwise("native").alias("origin"), text.alias("text"))
    return told.withColumn("error_type", F.when(F.col("status") == "error", F.lit("CorruptFile"))).withColumn("message", F.when(F.col("status") == "error", F.concat(F.lit("unit "), F.col("index").cast("string"), F.lit(" is damaged"))))


@query(UNITS_SQL + " SELECT * FROM rolled")
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.roll_up(units(spark, sf_dir), "file")


@query(UNITS_SQL + " SELECT count(*) AS documents, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'error') AS error, CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 1 ELSE 0 END AS exit_code FROM rolled")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.status_counts(D.roll_up(units(spark, sf_dir), "file"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file, with its units in an array by index."""
    one = F.struct("index", "status", "origin", "text", "error_type", "message")
    return units(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("units"))


@query(
    UNITS_SQL
    + """ SELECT r.file, status, CASE WHEN n_failed > 0 AND n_failed < n_units THEN n_failed || ' of ' || n_units || ' units failed; see their error_type and message' END AS warning,
  CASE WHEN status = 'error' THEN error_type || ': ' || message ELSE n_units || CASE WHEN n_units = 1 THEN ' unit (' ELSE ' units (' END || (n_units - n_ocr) || ' native, ' || n_ocr || ' ocr), 0s' END AS line, sha256(coalesce(hyp, '')) AS text_sha256
FROM rolled r JOIN (SELECT file, count(*) FILTER (origin = 'ocr') AS n_ocr, string_agg(text, chr(10) || chr(10) ORDER BY idx) FILTER (status = 'ok' AND text <> '') AS hyp FROM units GROUP BY file) o ON r.file = o.file"""
)
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = nested(spark, sf_dir).withColumn("out", D.outcome(F.col("units")))
    line = D.summary_line(D.origin_counts(F.col("units")), F.lit(0), F.col("out.status"), F.col("out.error_type"), F.col("out.message"))
    return told.select("file", "out.status", "out.warning", line.alias("line"), F.sha2(D.hypothesis(F.col("units")), 256).alias("text_sha256"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS unit_index FROM conversations")
def unit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each unit in its document."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", place.alias("unit_index"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS of FROM documents")
def document_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""
WITH jobs AS (SELECT page_id % 3 AS input, '/in/' || page_id AS path, 'dir' || (page_id % 2) AS rel, CASE WHEN page_id % 5 = 0 THEN 'Page' ELSE 'page' END || (page_id // 6) || '.html' AS name FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY rel, lower(name) ORDER BY input, path) AS k FROM jobs)
SELECT path, '/out/' || rel || '/' || name || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS folder, CASE WHEN k > 1 THEN 'another input has the same name; written to ' || name || '-' || k || ' instead' END AS folder_note FROM n
""")
def output_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    name = F.concat(F.when(p % 5 == 0, F.lit("Page")).otherwise(F.lit("page")), F.floor(p / 6).cast("string"), F.lit(".html"))
    jobs = table(spark, sf_dir, "pages").select((p % 3).cast("int").alias("input"), F.concat(F.lit("/in/"), p.cast("string")).alias("path"), F.concat(F.lit("dir"), (p % 2).cast("string")).alias("rel_dir"), name.alias("name"))
    return with_folders(jobs, "/out").select("path", "folder", "folder_note")


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) FILTER (text <> ''), '') AS text FROM conversations GROUP BY conv_id")
def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the blocks of a page."""
    block = F.struct(F.col("turn").alias("order"), "role", "text")
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return pages.select("conv_id", block_text(F.col("blocks")).alias("text"))


REVIEW_SQL = """
WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx, coalesce(text, '') AS text, (turn * 37 + conv_id) % 100 / 1e2 AS conf FROM conversations),
r AS (SELECT conv_id, -1 AS a, 0 AS b, 'status ' || CASE conv_id % 6 WHEN 0 THEN 'partial' ELSE 'error' END AS reason FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 6 < 2
  UNION ALL SELECT conv_id, idx, 0, 'unit ' || idx || ': slow page' FROM u WHERE turn % 5 = 4
  UNION ALL SELECT conv_id, idx, 1, 'unit ' || idx || ': 1 block(s) below confidence 0.8' FROM u WHERE text <> '' AND conf < 0.8e0),
d AS (SELECT c.conv_id, count(reason) AS n_reasons, coalesce(string_agg(reason, ' | ' ORDER BY a, b), '') AS reasons FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id)"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of one block a unit: conv_id and reasons."""
    conf = ((F.col("turn") * 37 + F.col("conv_id")) % 100) / 100.0
    one = F.struct("turn", "role", "text", F.when(F.col("turn") % 5 == 4, F.array(F.lit("slow page"), F.lit("more"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.array(F.struct(F.col("text"), conf.alias("conf"))).alias("blocks"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("units"))
    numbered_units = F.transform("units", lambda u, k: u.withField("index", k))
    k = F.col("conv_id") % 6
    status = F.when(k == 0, "partial").when(k == 1, "error").otherwise("ok")
    return docs.select("conv_id", metrics.review_reasons(status, numbered_units).alias("reasons"))


@query(REVIEW_SQL + " SELECT * FROM d")
def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir).select("conv_id", F.size("reasons").cast("long").alias("n_reasons"), F.array_join("reasons", " | ").alias("reasons"))


@query(REVIEW_SQL + " SELECT 1 - count(*) FILTER (n_reasons > 0) / greatest(count(*), 1) AS stp_rate, count(*) FILTER (n_reasons > 0) / greatest(count(*), 1) AS hitl_rate FROM d")
def stp_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stp, hitl = metrics.stp_rates(F.col("reasons"))
    return reviewed(spark, sf_dir).agg(stp.alias("stp_rate"), hitl.alias("hitl_rate"))


@query("""
SELECT user_id, count(*) AS units, count(*) / nullif(CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT), 0) AS units_per_second,
  count(*) FILTER (event_id % 2 = 0) / nullif(CAST(sum(event_id % 7) AS DOUBLE), 0) AS ocr_units_per_second
FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id
""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as units of a user's document; every second one is from OCR."""
    one = F.struct(F.when(F.col("event_id") % 2 == 0, "ocr").otherwise("native").alias("origin"))
    second = F.unix_timestamp(F.date_trunc("second", "ts"))
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(one).alias("units"), (F.max(second) - F.min(second)).alias("total"), F.sum(F.col("event_id") % 7).alias("ocr"))
    return docs.select("user_id", *(c.alias(k) for k, c in speeds(F.col("units"), F.col("total"), F.col("ocr").cast("double")).items()))


@query("""
SELECT conv_id, turn, text_n, CASE WHEN origin = 'ocr' THEN left(plain, length(plain) - 1) || ',"render_dpi":' || CASE WHEN turn % 2 = 0 THEN 'null' ELSE '200' END || ',"width_px":null,"height_px":null,"blocks":[]}' ELSE plain END AS json FROM (
  SELECT conv_id, turn, length(coalesce(text, '')) AS text_n, CASE WHEN role = 'assistant' THEN 'ocr' ELSE 'native' END AS origin,
    left(a, length(a) - 1) || CASE WHEN turn > 0 THEN ',"page":' || turn ELSE '' END || ',"name":' || to_json(role) || '}' AS plain
  FROM (SELECT *, CAST(json_object('index', turn, 'kind', 'page', 'origin', CASE WHEN role = 'assistant' THEN 'ocr' ELSE 'native' END, 'status', 'ok', 'reason', 'no text layer', 'text', coalesce(text, ''), 'markdown', '', 'warnings', json_array()) AS VARCHAR) AS a FROM conversations)
)
""")
def unit_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as units in JSON."""
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    u = unit(index=F.col("turn"), kind=F.lit("page"), origin=F.when(F.col("role") == "assistant", "ocr").otherwise("native"), reason=F.lit("no text layer"), text=text, page=F.when(F.col("turn") > 0, F.col("turn")), name=F.col("role"), render_dpi=F.when(F.col("turn") % 2 != 0, F.lit(200)))
    return turns.withColumn("u", u).select("conv_id", "turn", F.length(text).cast("long").alias("text_n"), unit_json(F.col("u")).alias("json"))


@query(f"SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[{WS}]+', ' ', 'g')) AS text FROM documents")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text composed, and with white space collapsed."""
    return texts(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text"))
