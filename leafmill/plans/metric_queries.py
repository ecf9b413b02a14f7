"""Metrics: error rates of benchmark items, token overlap of documents, fields of customers, boxes from embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import metrics as M
from leafmill.functions.charclass import WS
from leafmill.functions.text import normalize
from leafmill.operators.evaluate import evaluate as evaluate_documents
from leafmill.plans.registry import query, table, texts


def misread(text: Column, key: Column) -> Column:
    """What a poor OCR might have made of a text."""
    out = F.replace(F.replace(text, F.lit("rn"), F.lit("m")), F.lit("the "), F.lit("teh "))
    return F.when(key % 3 == 0, F.concat(out, F.lit(" x y"))).when(key % 3 == 1, F.replace(out, F.lit("e"), F.lit("c"))).otherwise(out)


def _misread_sql(text: str, key: str) -> str:
    out = f"replace(replace({text}, 'rn', 'm'), 'the ', 'teh ')"
    return f"CASE WHEN {key} % 3 = 0 THEN {out} || ' x y' WHEN {key} % 3 = 1 THEN replace({out}, 'e', 'c') ELSE {out} END"


def _squash_sql(text: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({text}), '[{WS}]+', ' ', 'g'))"


#: DuckDB counts edits by bytes, so other characters than ASCII become question marks first.
ASCII_SQL = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g')"


def distance_sql(a: str, b: str) -> str:
    """Levenshtein distance of two lists: rows of the table one after another, each built from the one before."""
    inner = f"list_append(cur, least(prev[y[1] + 1] + 1, cur[y[1]] + 1, prev[y[1]] + CASE WHEN {a}[x[1]] = {b}[y[1]] THEN 0 ELSE 1 END))"
    row = f"list_reduce(list_concat([[x[1]]], list_transform(range(1, len({b}) + 1), lambda j: [j])), lambda cur, y: {inner})"
    return f"list_reduce(list_concat([range(0, len({b}) + 1)], list_transform(range(1, len({a}) + 1), lambda i: [i])), lambda prev, x: {row})[len({b}) + 1]"


def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    ref = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?")
    return items.select("item_id", normalize(ref).alias("ref"), normalize(misread(ref, F.col("item_id"))).alias("hyp"))


PAIRS_SQL = f"WITH p AS (SELECT item_id, {_squash_sql(ASCII_SQL)} AS ref, {_squash_sql(_misread_sql(ASCII_SQL, 'item_id'))} AS hyp FROM benchmark)"


@query(PAIRS_SQL + " SELECT item_id, levenshtein(ref, hyp) / greatest(length(ref), 1) AS cer FROM p")
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pairs(spark, sf_dir).select("item_id", M.cer_of(F.col("ref"), F.col("hyp")).alias("cer"))


@query(PAIRS_SQL + f", w AS (SELECT item_id, list_filter(string_split(ref, ' '), lambda t: t <> '') AS a, list_filter(string_split(hyp, ' '), lambda t: t <> '') AS b FROM p) SELECT item_id, {distance_sql('a', 'b')} / greatest(len(a), 1) AS wer FROM w")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pairs(spark, sf_dir).select("item_id", M.wer_of(F.col("ref"), F.col("hyp")).alias("wer"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(nfc_normalize(coalesce(text, '')), '[^{WS}]+')) AS token FROM documents),
c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT d.doc_id, coalesce(sum(n), 0) AS n FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id),
o AS (SELECT a.doc_id, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND a.token = b.token GROUP BY a.doc_id),
p AS (SELECT s.doc_id, coalesce(o.n, 0) / greatest(h.n, 1) AS "precision", coalesce(o.n, 0) / greatest(s.n, 1) AS recall FROM s JOIN s h ON h.doc_id = s.doc_id + 1 LEFT JOIN o ON o.doc_id = s.doc_id)
SELECT doc_id, "precision", recall, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1 FROM p
""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next one."""
    docs = texts(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("a"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    both = docs.hint("merge").join(after, "doc_id")
    return both.select("doc_id", M.f1_of(M.overlap_of(F.col("a"), F.col("b")), M.word_count(F.col("a")), M.word_count(F.col("b"))).alias("f")).select("doc_id", "f.*")


#: Fields as they should be and as they were read: names lose their zeros, some segments are missing, some have blanks.
FIELDS_SQL = """
WITH f AS (SELECT c_custkey, c_name AS n1, CASE WHEN c_custkey % 7 = 0 THEN replace(c_name, '0', 'O') ELSE '  ' || c_name || ' ' END AS n2, c_mktsegment AS s1, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS s2,
  c_nationkey AS k1, c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS k2 FROM customer),
a AS (SELECT c_custkey, (CASE WHEN n1 = trim(n2) THEN 1 ELSE 0 END + CASE WHEN s2 IS NOT NULL AND s1 = s2 THEN 1 ELSE 0 END + CASE WHEN k1 = k2 THEN 1 ELSE 0 END) / 3 AS accuracy FROM f)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.replace("c_name", F.lit("0"), F.lit("O"))).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    nation = (F.col("c_nationkey") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string")
    pair = lambda n, v: (F.lit(n), v)
    full = F.create_map(*pair("name", name), *pair("nation", nation), *pair("segment", F.col("c_mktsegment")))
    short = F.create_map(*pair("name", name), *pair("nation", nation))
    expected = F.create_map(*pair("name", F.col("c_name")), *pair("segment", F.col("c_mktsegment")), *pair("nation", F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", expected.alias("expected"), F.when(k % 5 == 0, short).otherwise(full).alias("actual"))


@query(FIELDS_SQL + " SELECT * FROM a")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("c_custkey", M.field_accuracy(F.col("expected"), F.col("actual")).alias("accuracy"))


@query(FIELDS_SQL + " SELECT coalesce(avg(CASE WHEN accuracy = 1 THEN 1 ELSE 0 END), 0) AS exact_match_rate FROM a")
def exact_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fields(spark, sf_dir).select(M.field_accuracy(F.col("expected"), F.col("actual")).alias("accuracy"))
    return told.agg(M.exact_match_rate(F.col("accuracy")).alias("exact_match_rate"))


def box(k: int) -> Column:
    """A box of whole thousandths from four numbers of an embedding, from the k-th (from 0)."""
    v = [F.floor(F.col("embedding")[k + i].cast("double") * 1000) for i in range(4)]
    return F.array(*(x.cast("double") for x in (v[0], v[1], v[0] + F.abs(v[2]), v[1] + F.abs(v[3]))))


def _box_sql(k: int) -> str:
    v = [f"floor(CAST(embedding[{k + i + 1}] AS DOUBLE) * 1000)" for i in range(4)]
    return f"[{v[0]}, {v[1]}, {v[0]} + abs({v[2]}), {v[1]} + abs({v[3]})]"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", box(0).alias("a"), box(4).alias("b"))


BOXES_SQL = f"WITH b AS (SELECT vec_id, {_box_sql(0)} AS a, {_box_sql(4)} AS b FROM embeddings)"


@query(BOXES_SQL + """, i AS (SELECT *, greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) AS shared FROM b),
u AS (SELECT *, (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - shared AS either FROM i) SELECT vec_id, CASE WHEN either > 0 THEN shared / either ELSE 0 END AS iou FROM u""")
def iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("vec_id", M.iou(F.col("a"), F.col("b")).alias("iou"))


def pages_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of eight vectors: the boxes `a` as predicted ones, the boxes `b` as true ones, by vector."""
    rows = boxes(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 8).alias("page")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "a", "b"))).alias("r"))
    return rows.select("page", F.transform("r", lambda x: x["a"]).alias("predicted"), F.transform("r", lambda x: x["b"]).alias("truth"))


#: Greedy matching: true boxes of a page one after another, each with its predictions from the best on, of which the first free one counts.
MATCH_SQL = """, r AS (SELECT vec_id // 8 AS page, vec_id, a, b, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS k FROM b),
shared AS (SELECT p.page, t.k AS i, p.k AS j, p.a AS p, t.b AS t, greatest(0, least(p.a[3], t.b[3]) - greatest(p.a[1], t.b[1])) * greatest(0, least(p.a[4], t.b[4]) - greatest(p.a[2], t.b[2])) AS common FROM r p JOIN r t ON p.page = t.page),
either AS (SELECT *, (p[3] - p[1]) * (p[4] - p[2]) + (t[3] - t[1]) * (t[4] - t[2]) - common AS whole FROM shared),
ranked AS (SELECT page, i, list({'s': CASE WHEN whole > 0 THEN common / whole ELSE 0 END, 'j': j} ORDER BY CASE WHEN whole > 0 THEN common / whole ELSE 0 END DESC, j) AS c FROM either GROUP BY page, i),
g AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, 0e0 AS total FROM r
  UNION ALL SELECT page, i, CASE WHEN f.s >= 0.1e0 THEN list_append(used, f.j) ELSE used END, total + coalesce(f.s, 0)
  FROM (SELECT g.page, ranked.i, used, total, list_filter(c, lambda x: NOT list_contains(used, x.j))[1] AS f FROM g JOIN ranked ON ranked.page = g.page AND ranked.i = g.i + 1)),
n AS (SELECT page, count(*) AS n FROM r GROUP BY page)
SELECT g.page, total / n AS mean_iou, len(used) / n AS "precision", len(used) / n AS recall FROM g JOIN n ON g.page = n.page AND g.i = n.n"""


@query(BOXES_SQL.replace("WITH", "WITH RECURSIVE", 1) + MATCH_SQL)
def layout_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of each page matched greedily."""
    return pages_of_boxes(spark, sf_dir).select("page", M.layout_iou(F.col("predicted"), F.col("truth"), 0.1).alias("x")).select("page", "x.*")


@query(
    BOXES_SQL
    + """, r AS (SELECT vec_id // 8 AS page, vec_id, a[1] AS x0, a[2] AS y0, a[3] AS x1, a[4] AS y1 FROM b),
edges AS (SELECT page, x0 AS x FROM r UNION SELECT page, x1 FROM r),
slabs AS (SELECT page, x AS l, lead(x) OVER (PARTITION BY page ORDER BY x) AS rt FROM edges),
spans AS (SELECT s.page, s.l, s.rt, r.y0, r.y1, max(r.y1) OVER (PARTITION BY s.page, s.l ORDER BY r.y0, r.y1, r.vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM slabs s JOIN r ON r.page = s.page AND r.x0 < s.rt AND r.x1 > s.l WHERE s.rt IS NOT NULL),
areas AS (SELECT page, sum((rt - l) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) AS area FROM spans GROUP BY page)
SELECT p.page, coalesce(area, 0) AS area FROM (SELECT DISTINCT page FROM r) p LEFT JOIN areas ON p.page = areas.page"""
)
def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of_boxes(spark, sf_dir).select("page", M.covered_area(F.col("predicted")).alias("area"))


ORDER_SQL = "SELECT conv_id, list(turn ORDER BY (turn * 7 + conv_id) % 5, turn, role, text) AS a, list(turn ORDER BY turn, role, text) AS b FROM conversations GROUP BY conv_id"


@query(f"WITH o AS ({ORDER_SQL}) SELECT conv_id, {distance_sql('a', 'b')} / greatest(len(b), 1) AS distance FROM o")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in a shuffled order against the true one."""
    shuffled = F.struct(((F.col("turn") * 7 + F.col("conv_id")) % 5).alias("k"), "turn", "role", "text")
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(shuffled)).alias("a"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("b"))
    turns = lambda c: F.transform(c, lambda x: x["turn"])
    return lists.select("conv_id", M.reading_order_distance(turns("a"), turns("b")).alias("distance"))


#: Items and what was read of them, with the end of the second unit; words of both in lists, and how many they share.
EVALUATE_SQL = f"""
WITH i AS (SELECT item_id, {ASCII_SQL} AS ref FROM benchmark),
m AS (SELECT item_id, ref, {_misread_sql("ref", "item_id")} AS got FROM i),
p AS (SELECT item_id, got, {_squash_sql("ref")} AS ref, {_squash_sql("CASE WHEN got = '' THEN 'the end' ELSE got || chr(10) || chr(10) || 'the end' END")} AS hyp FROM m),
w AS (SELECT *, list_filter(string_split(ref, ' '), lambda t: t <> '') AS a, list_filter(string_split(hyp, ' '), lambda t: t <> '') AS b FROM p),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda y: y = t))))), 0) AS shared FROM w),
f AS (SELECT *, shared / greatest(len(b), 1) AS pr, shared / greatest(len(a), 1) AS rc FROM o)
SELECT CAST(item_id AS VARCHAR) AS source, levenshtein(ref, hyp) / greatest(length(ref), 1) AS cer, {distance_sql("a", "b")} / greatest(len(a), 1) AS wer,
  pr AS token_precision, rc AS token_recall, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS token_f1, CAST(2 AS INT) AS units, 2 / (1 + item_id % 4) AS units_per_second,
  CASE WHEN item_id % 3 > 0 THEN 1 / (item_id % 3) END AS ocr_units_per_second, CAST(NULL AS DOUBLE) AS peak_rss_mb, CASE WHEN got = '' THEN '' ELSE 'unit 0: 1 block(s) below confidence 0.8' END AS needs_review FROM f"""


@query(EVALUATE_SQL)
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, other characters than ASCII as question marks, as references of documents with two units, half of which are from OCR."""
    items = table(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?"))
    text = F.col("text")
    unit = lambda k, t: F.struct(F.lit(k).alias("index"), F.lit("ok").alias("status"), F.lit("ocr" if k else "native").alias("origin"), t.alias("text"), F.array().cast("array<string>").alias("warnings"), F.array(F.struct(t.alias("text"), F.lit(0.7 + k / 5).alias("conf"))).alias("blocks"))
    source = F.col("item_id").cast("string").alias("source")
    timings = F.struct((1 + F.col("item_id") % 4).cast("double").alias("total_seconds"), (F.col("item_id") % 3).cast("double").alias("ocr_seconds"), F.lit(None).cast("double").alias("peak_rss_mb")).alias("timings")
    docs = items.select(source, F.lit("ok").alias("status"), F.array(unit(0, misread(text, F.col("item_id"))), unit(1, F.lit("the end"))).alias("units"), timings)
    return evaluate_documents(docs, items.select(source, F.col("text").alias("reference"))).withColumn("needs_review", F.array_join("needs_review", " | "))
