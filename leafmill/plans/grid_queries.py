"""Grids, cells and relations between parts of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import sheets
from leafmill.operators.judge import source_pdf as chosen
from leafmill.plans.registry import query, table, texts

#: Texts as grids: lines are rows, and what stands between commas are cells.
GRID_SQL = "WITH g AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: string_split(l, ', ')) AS rows FROM documents), w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM g)"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.split(line, ", ")).alias("rows"))


_LINE = "'| ' || array_to_string(list_transform(list_concat({r}, list_transform(range(width - len({r})), lambda z: '')), lambda c: replace(replace(c, '|', '\\|'), chr(10), '<br>')), ' | ') || ' |'"


@query(GRID_SQL + f" SELECT doc_id, array_to_string(list_concat([{_LINE.format(r='rows[1]')}, '| ' || array_to_string(list_transform(range(width), lambda z: '---'), ' | ') || ' |'], list_transform(rows[2:], lambda q: {_LINE.format(r='q')})), chr(10)) AS markdown FROM w")
def md_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("doc_id", T.md_table(F.col("rows")).alias("markdown"))


@query(GRID_SQL + " SELECT doc_id, array_to_string(list_transform(rows, lambda r: array_to_string(r, chr(9))), chr(10)) AS tsv FROM w")
def tsv_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("doc_id", T.tsv(F.col("rows")).alias("tsv"))


@query("""
WITH cells AS (SELECT l_orderkey AS sheet, l_linenumber AS r, l_suppkey % 4 + 1 AS c, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS v FROM lineitem),
s AS (SELECT sheet, max(r) AS h, max(c) AS w FROM cells GROUP BY sheet),
grid AS (SELECT sheet, y, x FROM (SELECT sheet, w, unnest(range(1, h + 1)) AS y FROM s), LATERAL (SELECT unnest(range(1, w + 1)) AS x)),
lines AS (SELECT g.sheet, g.y, string_agg(coalesce(v, ''), chr(9) ORDER BY g.x) AS line FROM grid g LEFT JOIN (SELECT sheet, r, c, max(v) AS v FROM cells GROUP BY ALL) k ON k.sheet = g.sheet AND k.r = g.y AND k.c = g.x GROUP BY g.sheet, g.y)
SELECT sheet, string_agg(line, chr(10) ORDER BY y) AS tsv FROM lines GROUP BY sheet
""")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as filled cells of a sheet for each order."""
    cell = F.struct(F.col("l_linenumber").cast("int").alias("row"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("col"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    filled = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), cell["row"].alias("row"), cell["col"].alias("col")).agg(F.max(cell["value"]).alias("value"))
    cells = filled.groupBy("sheet").agg(F.collect_list(F.struct("row", "col", "value")).alias("cells"))
    return cells.select("sheet", T.tsv(T.dense(F.col("cells"))).alias("tsv"))


@query("""
WITH v AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1e6 WHEN 2 THEN p_retailprice * 1e14 WHEN 3 THEN p_retailprice / 1e6 WHEN 4 THEN p_retailprice / 1e9 ELSE floor(p_retailprice) END AS x FROM part)
SELECT p_partkey, CASE WHEN x = floor(x) AND abs(x) < 1e15 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS number, CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag,
  CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '2024-02-29' ELSE '2024-02-29 13:05:' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS stamp FROM v
""")
def cell_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price, size = F.col("p_partkey") % 6, F.col("p_retailprice"), F.col("p_size")
    x = F.when(k == 0, price).when(k == 1, price * 1e6).when(k == 2, price * 1e14).when(k == 3, price / 1e6).when(k == 4, price / 1e9).otherwise(F.floor(price).cast("double"))
    stamp = F.when(size % 3 == 0, F.lit(None)).when(size % 3 == 1, F.lit("2024-02-29 00:00:00")).otherwise(F.concat(F.lit("2024-02-29 13:05:"), F.lpad(size.cast("string"), 2, "0")))
    of = lambda kind, v: T.cell_text(F.lit(kind), v)
    return table(spark, sf_dir, "part").select("p_partkey", of("number", x.cast("string")).alias("number"), of("bool", (size % 2 == 0).cast("string")).alias("flag"), of("datetime", stamp).alias("stamp"))


@query("SELECT s_suppkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT)) ELSE chr(CAST(64 + ((n - 1) // 26 - 1) // 26 AS INT)) || chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT)) END AS letters FROM (SELECT s_suppkey, s_suppkey * 131 % 16384 + 1 AS n FROM supplier)")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.column_letters(F.col("s_suppkey") * 131 % 16384 + 1).alias("letters"))


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS sheet, l_linenumber AS r, l_suppkey % 30 + 1 AS c FROM lineitem), v AS (SELECT l_orderkey AS sheet, l_linenumber AS r, l_suppkey % 30 + 1 AS c FROM lineitem WHERE l_returnflag = 'N'),
m AS (SELECT sheet, (CASE WHEN c > 26 THEN 'A' || chr(CAST(64 + c - 26 AS INT)) ELSE chr(CAST(64 + c AS INT)) END) || r AS name, row_number() OVER (PARTITION BY sheet ORDER BY r, c) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.sheet = f.sheet AND v.r = f.r AND v.c = f.c))
SELECT sheet, count(*) AS n, count(*) || ' formula cell(s) have no cached value (workbook was never calculated in Excel); shown empty: ' || string_agg(name, ', ' ORDER BY k) FILTER (k <= 5) || CASE WHEN count(*) > 5 THEN ' ...' ELSE '' END AS warning FROM m GROUP BY sheet
""")
def uncached_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as formulas, of which those that weren't returned have a value."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 30 + 1).alias("col"), "l_returnflag")
    return sheets.uncached(cells, cells.where("l_returnflag = 'N'"))


@query("SELECT n_regionkey AS part, n_nationkey AS position, n_name AS rid, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey AND n_nationkey % 4 <> 0")
def slide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as slides of a region, some of which have no relation."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    order = nations.select(F.col("n_regionkey").alias("part"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("rid"))
    some = nations.where("n_nationkey % 4 <> 0").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return sheets.resolved(order, some.select(F.col("n_regionkey").alias("part"), F.col("n_name").alias("rid"), F.col("r_name").alias("target")))


@query("SELECT n_regionkey AS part, n_nationkey AS number, n_name AS rid, r_name AS target, CASE WHEN r_name IS NULL THEN 'slide ' || n_nationkey || ': picture ' || n_name || ' is not stored in the file' END AS warning FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND n_nationkey % 4 <> 0")
def slide_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pictures = nations.select(F.col("n_regionkey").alias("part"), F.col("n_nationkey").alias("number"), F.col("n_name").alias("rid"))
    some = nations.where("n_nationkey % 4 <> 0").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return sheets.with_missing(pictures, some.select(F.col("n_regionkey").alias("part"), F.col("n_name").alias("rid"), F.col("r_name").alias("target")))


@query("SELECT o_orderkey, coalesce(a.c_name, b.s_name) AS pdf FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_nationkey < 12 LEFT JOIN supplier b ON o_custkey % 200 = b.s_suppkey")
def source_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, customers as recorded paths, suppliers as files of the same name elsewhere."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    here = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("a"))
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("b"))
    told = orders.join(here, "o_custkey", "left").join(named, F.col("o_custkey") % 200 == F.col("k"), "left")
    return told.select("o_orderkey", chosen(F.col("a"), F.col("b")).alias("pdf"))
