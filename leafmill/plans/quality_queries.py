"""Quality profiles, verdicts and routes of the table documents.

The documents have no Indic or private-use characters. Where a query has to meet those, it adds some to each text by
its id, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import charclass as cc
from leafmill.functions import quality as Q
from leafmill.plans.registry import query, texts

#: Added to the text of a document, by doc_id % 8, as often as a tenth of its length says (once at least).
INJECTED = {1: "\ue000", 2: "\ufffd", 3: " \u0939\u093f\u0902\u0926\u0940 \u092e\u0947\u0902", 4: " \u094d\u0915", 5: " \u0939\u093f\u00e9\u0902\u0926\u0940", 6: " \u0633\u0644\u0627\u0645", 7: "\x01"}


def injected(text: Column, key: Column) -> Column:
    n = F.floor(F.length(text) / 10).cast("int") + 1
    out = F.lit("")
    for k, piece in INJECTED.items():
        out = F.when(F.pmod(key, F.lit(8)) == k, F.repeat(F.lit(piece), n)).otherwise(out)
    return F.concat(text, out)


INJECTED_SQL = "coalesce(text, '') || CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN repeat('{v}', CAST(floor(length(coalesce(text, '')) / 10) AS INT) + 1)" for k, v in INJECTED.items()) + " ELSE '' END"


def fonts(df: DataFrame) -> DataFrame:
    """Font names by the document's id."""
    return df.withColumn("fonts", F.when(F.col("doc_id") % 9 == 4, F.array(F.lit("Kruti Dev 010"), F.col("lang"), F.lit("ABCDEF+DevLys"))).when(F.col("doc_id") % 9 == 7, F.array(F.lit("Arial"), F.lit("O'Preeti"))).otherwise(F.array(F.lit("Times"), F.col("source"))))


FONTS_SQL = "CASE WHEN doc_id % 9 = 4 THEN ['Kruti Dev 010', lang, 'ABCDEF+DevLys'] WHEN doc_id % 9 = 7 THEN ['Arial', 'O''Preeti'] ELSE ['Times', source] END"


def metrics_sql(text: str, source: str = "documents", keep: str = "doc_id") -> str:
    """CTEs up to `m`, which has `keep`, counts' text t and the 13 metrics of functions.quality.metrics()."""
    gone = lambda x, inside: f"regexp_replace({x}, '[{inside}]+', '', 'g')"
    word = f"[^{cc.WS}]*"
    return f"""
WITH x AS (SELECT {keep}, {text} AS t FROM {source}),
r AS (SELECT *, length({gone("t", cc.WS)}) AS n, {gone("t", cc.WS + cc.LATIN)} AS rest FROM x),
k AS (SELECT *, {gone("rest", cc.BAD)} AS none, length({gone("rest", "^" + cc.PRIVATE)}) AS private, length({gone("rest", "^" + cc.inside([(cc.REPLACEMENT, cc.REPLACEMENT)]))}) AS replaced FROM r),
c AS (SELECT *, length({gone("none", "^" + cc.INDIC)}) AS indic, length({gone("none", "^" + cc.ARABIC)}) AS arabic, length({gone("none", cc.INDIC + cc.ARABIC + cc.COMMON)}) AS strange,
  len(regexp_extract_all(t, '(^|[^{cc.BASE}])[{cc.MARK}]')) AS orphans, len(regexp_extract_all(t, '{word}[{cc.INDIC}]{word}')) AS iw,
  len(regexp_extract_all(t, '{word}(?:[{cc.INDIC}]{word}[{cc.FOREIGN}]|[{cc.FOREIGN}]{word}[{cc.INDIC}]){word}')) AS mixed, len(regexp_extract_all(t, '[^{cc.WS}]+')) AS nw FROM k),
p AS (SELECT *, CAST(100 AS DOUBLE) / greatest(n, 1) AS f FROM c),
m AS (SELECT {keep}, t, n AS chars, indic AS indic_chars, arabic AS arabic_chars, n - length(rest) AS latin_chars,
  round_even(CAST(100 AS DOUBLE) * (length(rest) - length(none)) / greatest(n, 1), 1) AS bad_pct, round_even(CAST(100 AS DOUBLE) * private / greatest(n, 1), 1) AS private_use_pct,
  round_even(CAST(100 AS DOUBLE) * replaced / greatest(n, 1), 1) AS replacement_pct, round_even(CAST(100 AS DOUBLE) * strange / greatest(n, 1), 1) AS foreign_pct,
  orphans AS orphan_marks, mixed AS mixed_script_words, iw AS indic_words, nw AS words, CASE WHEN nw > 0 THEN round_even(CAST(n AS DOUBLE) / nw, 1) ELSE 0 END AS mean_word_len FROM p)"""


METRICS = "chars indic_chars arabic_chars latin_chars bad_pct private_use_pct replacement_pct foreign_pct orphan_marks mixed_script_words indic_words words mean_word_len".split()


def _whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def verdict_sql(fonts: str | None) -> str:
    """CTE `v` after `m`: all of m, problems (null-free text), old (legacy fonts as a list)."""
    hints = "|".join(Q.LEGACY_FONTS)
    quoted = "CASE WHEN contains(q, '''') AND NOT contains(q, '\"') THEN '\"' || q || '\"' ELSE '''' || q || '''' END"
    old = f"coalesce(list_sort(list_distinct(list_filter({fonts}, lambda q: regexp_matches(lower(q), '{hints}')))), [])" if fonts else "[]::VARCHAR[]"
    return f""",
o AS (SELECT *, {old} AS old FROM m),
v AS (SELECT *, concat_ws('; ',
  CASE WHEN bad_pct / 100 > 0.02e0 AND private_use_pct >= replacement_pct THEN 'private-use characters ' || {_whole("private_use_pct")} || '%' END,
  CASE WHEN bad_pct / 100 > 0.02e0 AND replacement_pct / 100 > 0.01e0 THEN 'replacement characters U+FFFD ' || {_whole("replacement_pct")} || '%' END,
  CASE WHEN bad_pct / 100 > 0.02e0 AND NOT private_use_pct >= replacement_pct AND NOT replacement_pct / 100 > 0.01e0 THEN 'control or unassigned characters ' || {_whole("bad_pct")} || '%' END,
  CASE WHEN foreign_pct / 100 > 0.15e0 THEN 'characters outside the supported scripts ' || {_whole("foreign_pct")} || '%' END,
  CASE WHEN indic_chars > 0 AND orphan_marks >= 2 AND orphan_marks / indic_chars > 0.005e0 THEN orphan_marks || ' combining marks detached from their base letter' END,
  CASE WHEN indic_words > 0 AND mixed_script_words >= 2 AND mixed_script_words / indic_words > 0.02e0 THEN mixed_script_words || ' Indic words contain stray non-Indic letters' END,
  CASE WHEN words >= 5 AND (indic_chars + latin_chars) / chars > 0.5e0 AND mean_word_len > 25 THEN 'words implausibly long (mean ' || printf('%.1f', mean_word_len) || ' characters)' END,
  CASE WHEN words >= 5 AND (indic_chars + latin_chars) / chars > 0.5e0 AND mean_word_len < 1.3e0 THEN 'words implausibly short (mean ' || printf('%.1f', mean_word_len) || ' characters)' END,
  CASE WHEN len(old) > 0 THEN 'legacy Indic font ' || array_to_string(list_transform(old, lambda q: {quoted}), ', ') END) AS problems FROM o)"""


REASON_SQL = "CASE WHEN problems = '' THEN 'text layer passed validity check' ELSE 'text layer failed validity check (' || problems || ')' END"


@query(metrics_sql("coalesce(text, '')") + f" SELECT doc_id, {', '.join(METRICS)} FROM m")
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_metrics(texts(spark, sf_dir).select("doc_id", "text")).select("doc_id", "metrics.*")


@query(metrics_sql(INJECTED_SQL) + f" SELECT doc_id, {', '.join(METRICS)} FROM m")
def quality_profile_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", injected(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    return Q.with_metrics(docs).select("doc_id", "metrics.*")


@query(metrics_sql(INJECTED_SQL, keep="doc_id, lang, source") + verdict_sql(FONTS_SQL) + f" SELECT doc_id, problems = '' AS usable, {REASON_SQL} AS reason, CASE WHEN arabic_chars / greatest(chars, 1) > 0.3e0 THEN 1 ELSE 0 END AS n_warnings FROM v")
def text_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fonts(texts(spark, sf_dir)).select("doc_id", "fonts", injected(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    told = Q.with_metrics(docs).withColumn("v", Q.verdict(F.col("metrics"), F.col("fonts")))
    return told.select("doc_id", "v.usable", "v.reason", F.size("v.warnings").alias("n_warnings"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({FONTS_SQL}, lambda q: regexp_matches(lower(q), '{'|'.join(Q.LEGACY_FONTS)}')))), ',') AS fonts FROM documents")
def legacy_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts(texts(spark, sf_dir)).select("doc_id", F.array_join(Q.legacy_fonts(F.col("fonts")), ",").alias("fonts"))


#: Texts of pages: some empty, some short, some not long, the others whole documents.
PAGE_SQL = "CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN lang WHEN 2 THEN lang || ' ' || source || ' page of few words ' || doc_id ELSE " + INJECTED_SQL + " END"


def page_text(df: DataFrame) -> Column:
    k = F.col("doc_id") % 11
    return F.when(k == 0, "").when(k == 1, F.col("lang")).when(k == 2, F.concat("lang", F.lit(" "), "source", F.lit(" page of few words "), F.col("doc_id").cast("string"))).otherwise(injected(F.coalesce("text", F.lit("")), F.col("doc_id")))


COVER, PATHS = "(doc_id % 101) / 1e2", "doc_id % 97"
PERCENT_SQL = _whole("100 * cover") + " || '%'"
ROUTE_SQL = (
    metrics_sql(PAGE_SQL, keep="doc_id, lang, source")
    + verdict_sql(None)
    + f""",
w AS (SELECT *, {COVER} AS cover, {PATHS} AS paths FROM v),
q AS (SELECT *, CASE WHEN chars = 0 AND cover >= 0.05e0 THEN 2 WHEN chars = 0 AND paths >= 50 THEN 3 WHEN chars = 0 THEN 4 WHEN chars < 20 AND cover >= 0.05e0 THEN 5 WHEN chars < 20 THEN 6
  WHEN cover >= 0.5e0 AND chars < 100 THEN 7 WHEN problems <> '' THEN 8 ELSE 9 END AS rule FROM w),
routed AS (SELECT doc_id, rule IN (2, 3, 5, 7, 8) AS ocr, CASE rule WHEN 2 THEN 'no text layer' WHEN 3 THEN 'no text layer (vector graphics only; the text may be outlined)' WHEN 4 THEN 'blank page (no text, no images)'
  WHEN 5 THEN 'text layer too short (' || chars || ' characters) and the page has image content' WHEN 6 THEN 'short text layer (' || chars || ' characters), no images'
  WHEN 7 THEN 'text layer sparse (' || chars || ' characters) and images cover ' || {PERCENT_SQL} || ' of the page' WHEN 8 THEN {REASON_SQL} ELSE 'text layer valid (' || chars || ' characters)' END AS reason,
  CASE WHEN rule = 9 THEN (CASE WHEN arabic_chars / greatest(chars, 1) > 0.3e0 THEN 1 ELSE 0 END) + (CASE WHEN cover >= 0.5e0 THEN 1 ELSE 0 END) ELSE 0 END AS n_warnings,
  CASE WHEN rule >= 8 THEN foreign_pct END AS foreign_pct, CASE WHEN rule IN (3, 4) THEN paths END AS drawing_paths FROM q)"""
)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    docs = docs.select("doc_id", page_text(docs).alias("text"))
    cover, paths = (F.col("doc_id") % 101) / 100.0, F.col("doc_id") % 97
    told = Q.with_route(docs, F.col("text"), cover, paths)
    layer = Q.text_layer(F.col("metrics.chars"), cover, paths, F.col("metrics"), F.col("route"))
    return told.withColumn("layer", layer).select("doc_id", "route.ocr", "route.reason", F.size("route.warnings").alias("n_warnings"), "layer.foreign_pct", "layer.drawing_paths")


@query(ROUTE_SQL + " SELECT * FROM routed")
def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)


@query(ROUTE_SQL + " SELECT ocr, regexp_replace(regexp_replace(reason, '\\(.*', ''), '[0-9]+', '#', 'g') AS kind, count(*) AS pages FROM routed GROUP BY ALL")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.regexp_replace(F.regexp_replace("reason", r"\(.*", ""), "[0-9]+", "#")
    return _routed(spark, sf_dir).groupBy("ocr", kind.alias("kind")).agg(F.count(F.lit(1)).alias("pages"))
