"""What files are and say: kinds, formats, hashes, decoding, links; pages and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import links, pages, sniffing
from leafmill.plans.registry import query, table, texts

#: What files begin with, as hexadecimal digits, by page_id modulo their number.
HEADS = ["255044462D312E37", "0A0A255044462D", "89504E470D0A1A0A", "FFD8FFE0", "49492A00", "4D4D002A", "424D" + "00" * 12 + "28000000" + "00" * 8, "424D" + "00" * 12 + "29000000" + "00" * 8, "52494646" + "00000000" + "57454250", "504B0304", "D0CF11E0A1B11AE1", "474946383961", ""]
NAMES = ["a.pdf", "b.PDF", "c.png", "d.jpeg", "e.docx", "f.md", "g.markdown", "h.doc", "i.xls", "j.zip", "k.eml", "l.bin", "noextension", ".hidden", "dir.d/m.tiff", "n.webp", "o.gif"]
KINDS_SQL = """CASE WHEN regexp_matches(substr(h, 1, 2048), '^(..)*255044462D') THEN 'pdf' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN substr(h, 1, 8) IN ('49492A00', '4D4D002A') THEN 'tiff'
  WHEN starts_with(h, '424D') AND length(h) > 36 AND substr(h, 29, 8) IN ('0C000000', '28000000', '34000000', '38000000', '40000000', '6C000000', '7C000000') THEN 'bmp' WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'webp'
  WHEN substr(h, 1, 8) IN ('504B0304', '504B0506') THEN 'zip' WHEN starts_with(h, 'D0CF11E0A1B11AE1') THEN 'ole' WHEN substr(h, 1, 12) IN ('474946383761', '474946383961') THEN 'gif' END"""


def _choice(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    content = F.concat(F.unhex(_choice(k, HEADS)), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", _choice(k, NAMES).alias("name"), F.when(k % 29 == 3, F.unhex(F.lit(""))).otherwise(content).alias("content"))


FILES_SQL = f"WITH f AS (SELECT page_id, {_list(NAMES)}[page_id % {len(NAMES)} + 1] AS name, CASE WHEN page_id % 29 = 3 THEN '' ELSE {_list(HEADS)}[page_id % {len(HEADS)} + 1] || hex(encode(coalesce(html, ''))) END AS h FROM pages), s AS (SELECT *, {KINDS_SQL} AS magic FROM f)"


@query(FILES_SQL + " SELECT page_id, magic FROM s")
def sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("page_id", sniffing.sniff(F.col("content")).alias("magic"))


@query(
    FILES_SQL
    + """, e AS (SELECT *, regexp_extract(name, '[^/](\\.[^./]+)$', 1) AS ext FROM s),
b AS (SELECT *, CASE lower(ext) WHEN '.jpg' THEN 'jpeg' WHEN '.tif' THEN 'tiff' WHEN '.markdown' THEN 'md' WHEN '' THEN NULL ELSE CASE WHEN lower(ext) IN ('.pdf', '.png', '.jpeg', '.tiff', '.bmp', '.webp', '.docx', '.xlsx', '.pptx', '.md', '.doc', '.xls', '.ppt') THEN substr(lower(ext), 2) END END AS named FROM e),
o AS (SELECT *, CASE WHEN h = '' THEN 'file is empty (0 bytes)' WHEN magic = 'zip' THEN 'not a valid ZIP/Office container: File is not a zip file' WHEN magic = 'gif' THEN 'GIF images are not supported'
  WHEN magic = 'ole' AND named IN ('docx', 'xlsx', 'pptx') THEN ext || ' file is an OLE container, not OOXML: it is password-protected or a legacy binary file with the wrong extension; no content was read'
  WHEN magic = 'ole' AND (named IS NULL OR named NOT IN ('doc', 'xls', 'ppt')) THEN 'legacy Office/OLE container with an unrecognised extension'
  WHEN magic IS NULL AND named IS NOT NULL AND named <> 'md' THEN 'content is not a valid ' || upper(named) || ' (extension ' || ext || ')'
  WHEN magic IS NULL AND named IS NULL AND lower(ext) IN ('.eml', '.msg', '.zip', '.7z', '.rar', '.tar', '.gz') THEN ext || ' containers are not supported; extract the files first'
  WHEN magic IS NULL AND named IS NULL THEN 'unsupported file type ''' || CASE ext WHEN '' THEN '(no extension)' ELSE ext END || '''' END AS message FROM b)
SELECT page_id, CASE WHEN message IS NULL THEN CASE WHEN magic IS NULL OR magic = 'ole' THEN named ELSE magic END END AS format, message,
  CASE WHEN message IS NULL THEN NULL WHEN h = '' THEN 'EmptyFile' WHEN magic = 'zip' OR (magic IS NULL AND named IS NOT NULL) THEN 'CorruptFile' WHEN magic = 'ole' AND named IN ('docx', 'xlsx', 'pptx') THEN 'PasswordProtected' ELSE 'UnsupportedFormat' END AS error_type,
  CASE WHEN message IS NULL AND magic <> 'ole' AND named <> magic THEN 'extension ' || ext || ' says ' || named || ' but the content is ' || magic || '; treated as ' || magic ELSE '' END AS warning FROM o"""
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = files(spark, sf_dir).withColumn("magic", sniffing.sniff(F.col("content")))
    told = told.withColumn("d", sniffing.detect(F.col("name"), F.length("content"), F.col("magic"), sniffing.office_kind(F.col("content"), F.col("magic"))))
    return told.select("page_id", "d.format", "d.message", "d.error_type", F.array_join("d.warnings", "; ").alias("warning"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


#: Encodings by doc_id % 5: plain, with a mark, in UTF-16, with Windows line ends, and in Windows-1252 with one letter that isn't ASCII.
@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN regexp_replace(t, '[^\\x01-\\x7F]', '?', 'g') || 'é' ELSE t END AS text, CASE WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END AS n_warnings, CASE WHEN nul THEN 'CorruptFile' END AS error_type
FROM (SELECT doc_id, doc_id % 25 = 20 AS nul, CASE WHEN doc_id % 25 = 20 THEN NULL ELSE replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS t FROM documents)
""")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    plain = F.encode(t, "UTF-8")
    latin = F.concat(F.encode(F.regexp_replace(t, r"[^\x01-\x7F]", "?"), "UTF-8"), F.unhex(F.lit("E9")))
    content = F.when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(k == 2, F.encode(t, "UTF-16")).when(k == 3, F.encode(F.replace(t, F.lit("\n"), F.lit("\r\n")), "UTF-8")).when(k == 4, latin).otherwise(F.when(F.col("doc_id") % 25 == 20, F.concat(F.unhex(F.lit("00")), plain)).otherwise(plain))
    told = texts(spark, sf_dir).select("doc_id", sniffing.decode_text(content).alias("d"))
    return told.select("doc_id", "d.text", F.size("d.warnings").alias("n_warnings"), "d.error_type")


LINKS = ["![a](img/one.png)", "![b](<two%20x.jpg> \"title\")", "![c](https://example.org/x.png) and ![d](//host/y.png)", "![e](data:image/png;base64,AAAA)", "![f](../up.png)", "[no image](x.png)", "![](http:z.png)"]


@query(f"""
WITH t AS (SELECT doc_id, coalesce(text, '') || ' ' || {_list([x.replace("'", "''") for x in LINKS])}[doc_id % {len(LINKS)} + 1] || ' end' AS t FROM documents),
l AS (SELECT doc_id, unnest(regexp_extract_all(t, '{links.IMAGE_LINK}', 1)) AS link, generate_subscripts(regexp_extract_all(t, '{links.IMAGE_LINK}', 1), 1) - 1 AS pos FROM t)
SELECT doc_id, pos, link, CASE WHEN starts_with(link, 'data:') THEN 'data' WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(link, '//') THEN 'remote' ELSE 'file' END AS kind,
  CASE link WHEN 'img/one.png' THEN 'img/one.png' WHEN 'two%20x.jpg' THEN 'two x.jpg' END AS path,
  CASE WHEN starts_with(link, 'data:') THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(link, '//') THEN 'remote image not fetched (no network calls are made): ' || link WHEN starts_with(link, '../') THEN 'image outside the document''s folder was not read: ' || link ELSE 'image file not found: ' || link END AS warning FROM l
""")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _choice(F.col("doc_id"), LINKS), F.lit(" end"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(links.image_links(text)).alias("pos", "link"))
    link, kind = F.col("link"), links.kind(F.col("link"))
    path = F.when(kind == "file", links.local_path(link))
    return found.select("doc_id", "pos", "link", kind.alias("kind"), path.alias("path"), links.warning(link, F.coalesce((kind == "data") & links.data_bytes(link).isNotNull(), F.lit(False))).alias("warning"))


SPECS = ["", "2-3,5", "4-", "1,1-2,9-12"]


@query(f"""
SELECT o_orderkey, array_to_string(list_filter(range(1, o_custkey % 9 + 2), lambda p: CASE o_orderkey % {len(SPECS)} WHEN 0 THEN true WHEN 1 THEN p IN (2, 3, 5) WHEN 2 THEN p >= 4 ELSE p <= 2 OR p BETWEEN 9 AND 12 END), ',') AS pages FROM orders
""")
def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("o_custkey") % 9 + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(pages.pages_of(_choice(F.col("o_orderkey"), SPECS), total), ",").alias("pages"))


SIZE_SQL = "(SELECT p_partkey, p_size * 375e-1 AS w, p_size * 40e0 + p_partkey % 1000 AS h FROM part)"


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37.5).alias("w"), (F.col("p_size") * 40.0 + F.col("p_partkey") % 1000).alias("h"))


@query(f"""
WITH p AS (SELECT *, (w / 72 * 200) * (h / 72 * 200) AS px FROM {SIZE_SQL}), d AS (SELECT *, CASE WHEN px > 2000000 THEN CAST(floor(200 * sqrt(2000000 / px) * 0.999e0) AS INT) ELSE 200 END AS dpi FROM p)
SELECT p_partkey, CASE WHEN dpi >= 10 THEN dpi END AS dpi, CASE WHEN dpi < 10 THEN 'PDF page is ' || CAST(round_even(w, 0) AS BIGINT) || 'x' || CAST(round_even(h, 0) AS BIGINT) || ' pt; it cannot be rendered within 2 MP at a usable resolution' END AS message,
  CASE WHEN px > 2000000 AND dpi >= 10 THEN 'render dpi lowered from 200 to ' || dpi || ' to stay within 2 MP' END AS warning FROM d
""")
def dpi_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sizes(spark, sf_dir).select("p_partkey", pages.render_dpi(F.col("w"), F.col("h"), 200, 2_000_000).alias("d")).select("p_partkey", "d.*")


@query("""
WITH s AS (SELECT p_partkey, p_size * 300 AS w, p_partkey % 977 * 20 AS h FROM part)
SELECT p_partkey, CASE WHEN w * h > 100000000 THEN 'image is ' || w || 'x' || h || ' (' || CAST(round_even(w * h / 1e6, 0) AS BIGINT) || ' megapixels), over the 100 MP limit; raise it with --max-megapixels or downscale the file' END AS too_large,
  CASE WHEN least(p_size, p_partkey % 977) < 32 THEN 'skipped part ' || p_partkey || ': only ' || p_size || 'x' || (p_partkey % 977) || ' px' END AS too_small FROM s JOIN (SELECT p_partkey AS k, p_size FROM part) ON k = p_partkey
""")
def pixel_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("long"), F.col("p_partkey")
    large = pages.too_many_pixels(size * 300, k % 977 * 20, 100_000_000)
    small = pages.too_small(size, k % 977, F.concat(F.lit("part "), k.cast("string")), 32)
    return table(spark, sf_dir, "part").select("p_partkey", large.alias("too_large"), small.alias("too_small"))


@query(f"SELECT p_partkey, greatest(50, least(200, CAST(trunc(1568 / (greatest(w, h) / 72)) AS INT))) AS dpi FROM {SIZE_SQL}")
def judge_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sizes(spark, sf_dir).select("p_partkey", pages.judge_dpi(F.col("w"), F.col("h")).alias("dpi"))
