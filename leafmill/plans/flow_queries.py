"""Files made of rows through the whole flow: images and scans with an engine, listing, results on disk, and a judge."""

from __future__ import annotations

import base64
import json
import os
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import links, pages
from leafmill.functions import metrics as M
from leafmill.operators import extract, judge
from leafmill.operators.ocr import Recognised
from leafmill.plans.metric_queries import BOXES_SQL, pages_of_boxes
from leafmill.plans.process import documents_of
from leafmill.plans.reader_queries import jobs_of, key_of, md, pdf
from leafmill.plans.registry import query, table
from leafmill.schema import Options
from leafmill.session import shared_folder
from leafmill.sources import images, inputs, results
from leafmill.sources import pdf as pdf_backends


class Sizer:
    """An engine that reads off an image's size, and of a drawn page what it is told. Of every seventh width it says that a block was capped."""

    def recognize(self, image: bytes) -> Recognised:
        if image.startswith(b"page "):
            width, height, text = 1, 1, image.decode()
        else:
            width, height = images.frames(image)[0]
            text = f"{width} by {height}"
        blocks = [{"order": n, "label": "Text", "type": "Text", "bbox_xyxy": [0.0, 0.0, 1.0, 1.0], "conf": 0.9, "text": t} for n, t in ((1, text), (0, "read"))]
        return Recognised(width, height, blocks, f"**{text}**", capped=int(width % 7 == 0), most_tokens=512)

    def info(self) -> dict:
        return {"name": "sizer"}

    def close(self) -> None:
        pass


class Drawn:
    """The usual PDF backend, whose pages are drawn as words."""

    @contextmanager
    def open(self, content: bytes) -> Iterator:
        with pdf_backends.default().open(content) as doc:

            class Page:
                encrypted, repaired, pages, page = doc.encrypted, doc.repaired, doc.pages, staticmethod(doc.page)

                @staticmethod
                def render(number: int, dpi: int) -> bytes:
                    return f"page {number} at {dpi}".encode()

            yield Page


#: Extensions of picture(), by the key's remainder.
KINDS = ["png", "bmp", "jpg", "webp", "tif"]


def png(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", width, height, 8, 2, 0, 0, 0) + bytes(4)


def _exif(width: int, height: int) -> bytes:
    """A JPEG's segment with the two sides, 32 bits each."""
    entry = lambda tag, value: struct.pack("<HHII", tag, 4, 1, value)
    body = b"II*\0" + struct.pack("<IH", 8, 1) + entry(0x8769, 26) + bytes(4) + struct.pack("<H", 2) + entry(0xA002, width) + entry(0xA003, height) + bytes(4)
    return b"\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body


def picture(key: int, name: str, segment: str) -> bytes:
    """The header of an image, key + 1 wide and 40 high. Every tenth key has a PNG beyond all limits; a TIFF has a second frame, without a size."""
    kind, width, height = KINDS[key % 5], key + 1, 40
    if kind == "png":
        return png(20000, 10000 + key) if key % 10 == 5 else png(width, height)
    if kind == "bmp":
        return b"BM" + bytes(12) + struct.pack("<Iii", 40, width, -height) + bytes(24)
    if kind == "jpg":
        # A width of more than 16 bits is in Exif alone.
        exif = b"" if width <= 0xFFFF else _exif(width, height)
        return b"\xff\xd8\xff\xe0\x00\x04ab" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width if not exif else 0, 1) + bytes(3) + b"\xff\xd9"
    if kind == "webp":
        return b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    entry = lambda tag, value: struct.pack("<HHII", tag, 4, 1, value)
    first = struct.pack("<H", 2) + entry(256, width) + entry(257, height) + struct.pack("<I", 8 + 30)
    return b"II*\0" + struct.pack("<I", 8) + first + struct.pack("<H", 1) + entry(256, width) + struct.pack("<I", 0)


#: Columns of a unit as rows that the queries of this module return.
UNIT = {"index": "unit_index", "kind": "kind", "origin": "origin", "status": "status", "reason": "reason", "error_type": "error_type", "message": "message", "page": "page", "render_dpi": "render_dpi", "width_px": "width_px", "height_px": "height_px", "text": "text", "markdown": "markdown"}


def _units(documents: DataFrame, *more: Column) -> DataFrame:
    """A row for each unit, and one for each document without any."""
    rows = documents.select(key_of(), "format", F.col("status").alias("document_status"), F.col("message").alias("document_message"), *more, F.explode_outer("units").alias("u"))
    return rows.select(*(c for c in rows.columns if c != "u"), *(F.col(f"u.{c}").alias(a) for c, a in UNIT.items()), F.array_join("u.warnings", "; ").alias("unit_warnings"))


_LARGE = "'image is 20000x' || (10000 + k) || ' (' || CAST(round_even(20000 * (10000 + k) / 1e6, 0) AS BIGINT) || ' megapixels), over the 100 MP limit; raise it with --max-megapixels or downscale the file'"


@query(f"""
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, k % 5 = 4 AS tiff, k % 10 = 5 AS large FROM customer),
u AS (SELECT *, unnest(CASE WHEN tiff THEN [0, 1] ELSE [0] END) AS i FROM c), v AS (SELECT *, tiff AND i = 1 AS bad FROM u)
SELECT k AS c_custkey, ['png', 'bmp', 'jpeg', 'webp', 'tiff'][k % 5 + 1] AS format, CASE WHEN large THEN 'error' WHEN tiff THEN 'partial' ELSE 'ok' END AS document_status, CASE WHEN large THEN {_LARGE} END AS document_message,
  CASE WHEN tiff THEN '1 of 2 units failed; see their error_type and message' ELSE '' END AS document_warnings, CASE WHEN NOT large THEN i END AS unit_index, CASE WHEN large THEN NULL WHEN tiff THEN 'page' ELSE 'image' END AS kind,
  CASE WHEN NOT large THEN 'ocr' END AS origin, CASE WHEN large THEN NULL WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN large THEN NULL WHEN bad THEN 'image frame could not be read' ELSE 'image file (pixels only, no text layer)' END AS reason, CASE WHEN bad THEN 'CorruptFile' END AS error_type,
  CASE WHEN bad THEN 'image frame could not be read: it has no size' END AS message, CASE WHEN tiff THEN i + 1 END AS page, CAST(NULL AS DOUBLE) AS render_dpi, CASE WHEN NOT large AND NOT bad THEN k + 1 END AS width_px,
  CASE WHEN NOT large AND NOT bad THEN 40 END AS height_px, CASE WHEN large THEN NULL WHEN bad THEN '' ELSE 'read' || chr(10) || chr(10) || (k + 1) || ' by 40' END AS text, CASE WHEN large THEN NULL WHEN bad THEN '' ELSE '**' || (k + 1) || ' by 40**' END AS markdown,
  CASE WHEN large THEN NULL WHEN NOT bad AND (k + 1) % 7 = 0 THEN '1 block(s) reached the 512-token limit; their text may be cut off' ELSE '' END AS unit_warnings FROM v""")
def read_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of five formats: sizes from headers, limits, a damaged frame, and what an engine makes of them."""
    extension = F.get(F.array(*map(F.lit, KINDS)), (F.col("c_custkey") % 5).cast("int"))
    return _units(documents_of(jobs_of(spark, sf_dir, picture, extension), Options(), Sizer), F.array_join("warnings", "; ").alias("document_warnings"))


def pictured(key: int, name: str, segment: str) -> bytes:
    """Markdown with a picture between two texts, whose height is at most 50."""
    return f"# {name}\n\n![p](data:image/png;base64,{base64.b64encode(png(40, key % 50 + 1)).decode()})\n\nof {segment}\n".encode()


@query("""
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, k % 50 + 1 AS h, coalesce(c_name, '') AS n, coalesce(c_mktsegment, '') AS s, chr(10) AS nl FROM customer),
l AS (SELECT *, left('data:image/png;base64,' || to_base64(unhex('89504E470D0A1A0A0000000D4948445200000028' || printf('%08x', h) || '080200000000000000')), 60) AS link FROM c),
u AS (SELECT *, unnest(CASE WHEN h < 32 THEN [0, 2] ELSE [0, 1, 2] END) AS part FROM l)
SELECT k AS c_custkey, 'md' AS format, 'ok' AS document_status, CAST(NULL AS VARCHAR) AS document_message, CASE WHEN h < 32 THEN 'skipped ' || link || ': only 40x' || h || ' px' ELSE '' END AS document_warnings,
  CASE WHEN h < 32 AND part = 2 THEN 1 ELSE part END AS unit_index, CASE part WHEN 1 THEN 'image' ELSE 'section' END AS kind, CASE part WHEN 1 THEN 'ocr' ELSE 'native' END AS origin, 'ok' AS status,
  CASE part WHEN 1 THEN 'image linked from Markdown (' || link || ')' ELSE 'Markdown file, read directly' END AS reason, CAST(NULL AS VARCHAR) AS error_type, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS INT) AS page, CAST(NULL AS DOUBLE) AS render_dpi,
  CASE part WHEN 1 THEN 40 END AS width_px, CASE part WHEN 1 THEN h END AS height_px, CASE part WHEN 0 THEN '# ' || n || nl || nl WHEN 1 THEN 'read' || nl || nl || '40 by ' || h ELSE nl || nl || 'of ' || s || nl END AS text,
  CASE part WHEN 0 THEN '# ' || n || nl || nl WHEN 1 THEN '**40 by ' || h || '**' ELSE nl || nl || 'of ' || s || nl END AS markdown, '' AS unit_warnings FROM u""")
def read_pictured_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown cut where a picture is, which is read if it isn't too small."""
    return _units(documents_of(jobs_of(spark, sf_dir, pictured, F.lit("md")), Options(), Sizer), F.array_join("warnings", "; ").alias("document_warnings"))


@query("""
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'pdf' AS format, 'ok' AS document_status, CAST(NULL AS VARCHAR) AS document_message, p - 1 AS unit_index, 'page' AS kind, 'ocr' AS origin, 'ok' AS status, 'OCR forced by --force-ocr' AS reason, CAST(NULL AS VARCHAR) AS error_type,
  CAST(NULL AS VARCHAR) AS message, p AS page, 150e0 AS render_dpi, 1 AS width_px, 1 AS height_px, 'read' || chr(10) || chr(10) || 'page ' || p || ' at 150' AS text, '**page ' || p || ' at 150**' AS markdown, '' AS unit_warnings
FROM customer, (VALUES (1), (2)) v(p)""")
def read_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs whose pages are all drawn and recognised."""
    return _units(documents_of(jobs_of(spark, sf_dir, pdf), Options(dpi=150, force_ocr=True), Sizer, Drawn))


class Grader:
    """A judge that reads the number of the page off the picture and finds the text right on odd pages only."""

    def ask(self, prompt: str, image: bytes) -> judge.Reply:
        number, text = int(image.split()[1]), prompt.partition("<<<\n")[2].partition("\n>>>")[0]
        said = {"transcription": text if number % 2 else text[::-1], "score": 10 - number, "verdict": "good" if number % 2 else "poor", "reading_order_ok": bool(number % 2)}
        return judge.Reply(json.dumps(said), len(text), number)


@query("""
WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS k, p, 'read page ' || p || ' at 150' AS t FROM customer, (VALUES (1), (2)) v(p)),
e AS (SELECT *, CASE WHEN p % 2 = 1 THEN 0e0 ELSE levenshtein(reverse(t), t) / length(t) END AS cer FROM p)
SELECT k AS c_custkey, k || '.pdf' AS pdf_name, p AS page, p - 1 AS position, 2 AS n, CAST(10 - p AS DOUBLE) AS rating, CASE WHEN p % 2 = 1 THEN 'good' ELSE 'poor' END AS verdict, p % 2 = 1 AS in_order,
  round_even(greatest(0, least(100, 100 * (1 - cer))), 2) AS char_accuracy, CAST(length(t) + 1 AS BIGINT) AS tokens_in, CAST(p AS BIGINT) AS tokens_out FROM e WHERE k % 3 <> 0
UNION ALL SELECT k, k || '.pdf', p, p - 1, 2, NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE k % 3 = 0""")
def judge_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read by OCR, sampled and judged against their PDFs; every third customer's PDF is gone."""
    jobs = jobs_of(spark, sf_dir, pdf)
    documents = documents_of(jobs, Options(dpi=150, force_ocr=True), Sizer, Drawn)
    sampled = judge.sampled(judge.eligible(documents), 3)
    files = jobs.where(key_of() % 3 != 0).select("path", "content")
    told = judge.judge_pages(judge.with_pdf(sampled, files), Grader, Drawn)
    short = {"llm_quality_rating_out_of_10": "rating", "llm_verdict": "verdict", "reading_order_correct": "in_order", "character_accuracy_percent": "char_accuracy", "llm_input_tokens": "tokens_in", "llm_output_tokens": "tokens_out"}
    return told.select(key_of("pdf_name"), "pdf_name", "page", "position", "n", *(F.col(c).alias(a) for c, a in short.items()))


@query("""
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_custkey || '.md' AS name, 'ok' AS status, sha256(t) AS sha256, 1 AS unit_count, t AS text, 'image file not found: none-' || c_custkey || '.png' AS warnings, false AS write_failed
FROM (SELECT c_custkey, '# ' || coalesce(c_name, '') || chr(10) || chr(10) || 'of ' || coalesce(c_mktsegment, '') || chr(10) || chr(10) || '![k](none-' || c_custkey || '.png)' || chr(10) AS t FROM customer)""")
def results_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document.json for each customer, written to a folder of its own and read back; a thousand folders hold those, so that none is very large."""
    root = shared_folder(spark, "results")
    documents = documents_of(jobs_of(spark, sf_dir, md), Options(deterministic=True)).withColumn("folder", F.concat_ws("/", F.lit(root), (key_of() % 1000).cast("string"), "name"))
    wrote = results.write_documents(documents)
    failed = wrote.where("write_error is not null").count()
    back = results.read_documents(spark, root).withColumn("name", F.substring_index("folder", "/", -1))
    return back.select(key_of(), "name", "status", "sha256", "unit_count", F.array_join(F.transform("units", lambda u: u["text"]), "").alias("text"), F.array_join("warnings", "; ").alias("warnings"), F.lit(failed > 0).alias("write_failed"))


#: Where a nation's file lies, by the key's remainder: one of a known kind, one below, one of an unknown kind, a lock file, a hidden one, an empty one.
PLACES = ["{}.md", "sub/deep/{}.PDF", "{}.txt", "sub/~${}.docx", ".{}.md", "_{}.xlsx", "e/{}.png"]


@query(f"""
WITH f AS (SELECT n_nationkey AS k, replace({PLACES}[CAST(n_nationkey % 7 AS INT) + 1], '{{}}', n_nationkey || '') AS below, n_nationkey % 7 AS kind, length(n_name) AS l FROM nation)
SELECT below, kind IN (0, 1, 5, 6) AS taken, CASE kind WHEN 1 THEN 'sub/deep' WHEN 6 THEN 'e' WHEN 0 THEN '' WHEN 5 THEN '' END AS rel_dir, CASE WHEN kind IN (0, 1, 5, 6) THEN string_split(below, '/')[-1] END AS name,
  CAST(CASE kind WHEN 6 THEN 0 WHEN 0 THEN l WHEN 1 THEN l WHEN 5 THEN l END AS BIGINT) AS "length", CASE WHEN kind IN (0, 1, 5, 6) THEN false END AS missing FROM f
UNION ALL SELECT 'gone.pdf', true, '', 'gone.pdf', 0, true""")
def input_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of nations in a folder, and one that isn't there: which are taken and which passed over."""
    root = shared_folder(spark, "inbox")
    place = F.replace(F.get(F.array(*map(F.lit, PLACES)), (F.col("n_nationkey") % 7).cast("int")), F.lit("{}"), F.col("n_nationkey").cast("string"))
    rows = table(spark, sf_dir, "nation").select(place.alias("below"), F.when(F.col("n_nationkey") % 7 == 6, "").otherwise(F.col("n_name")).alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for below, text in zip(b.column("below").to_pylist(), b.column("text").to_pylist()):
                fs, at = results.fs_of(f"{root}/{below}")
                fs.create_dir(os.path.dirname(at), recursive=True)
                with fs.open_output_stream(at) as out:
                    out.write(text.encode())
            yield b.select(["below"])

    rows.mapInArrow(store, "below string").count()
    jobs, skipped = inputs.scan(spark, [root, f"{root}/gone.pdf"])
    start = len(root) + 2
    taken = jobs.select(F.expr(f"substring(source, {start})").alias("below"), F.lit(True).alias("taken"), "rel_dir", "name", "length", "missing")
    passed = skipped.select(F.expr(f"substring(source, {start})").alias("below"), F.lit(False).alias("taken"))
    return taken.unionByName(passed, allowMissingColumns=True)


#: Specifications of pages by a key's remainder; the key is put in for {}.
SPECS = ["1-3,5", "{}-", "0", "5-3", " 2 , 4 - ", "x", "", "{}", "1,,2", "3-{}9"]


@query(f"""
WITH s AS (SELECT o_orderkey AS k, replace({SPECS}[CAST(o_orderkey % 10 AS INT) + 1], '{{}}', CAST(o_orderkey % 90 + 1 AS VARCHAR)) AS spec FROM orders),
i AS (SELECT k, spec, list_transform(string_split(replace(spec, ' ', ''), ','), lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN [CAST(x AS INT), CAST(x AS INT)] WHEN regexp_full_match(x, '\\d+-') THEN [CAST(x[:-2] AS INT), NULL]
  WHEN regexp_full_match(x, '\\d+-\\d+') THEN [CAST(split_part(x, '-', 1) AS INT), CAST(split_part(x, '-', 2) AS INT)] ELSE [0, 0] END) AS r FROM s)
SELECT k AS o_orderkey, spec, CASE WHEN len(list_filter(r, lambda x: x[1] < 1 OR x[2] < x[1])) = 0 THEN array_to_string(list_transform(r, lambda x: x[1] || '..' || coalesce(CAST(x[2] AS VARCHAR), '')), ' ') END AS ranges FROM i""")
def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications of pages taken apart; null where one can't be read."""
    key = F.col("o_orderkey")
    spec = F.replace(F.get(F.array(*map(F.lit, SPECS)), (key % 10).cast("int")), F.lit("{}"), (key % 90 + 1).cast("string"))
    ranges = F.transform(pages.page_ranges(F.col("spec")), lambda r: F.concat(r["low"].cast("string"), F.lit(".."), F.coalesce(r["high"].cast("string"), F.lit(""))))
    return table(spark, sf_dir, "orders").select("o_orderkey", spec.alias("spec")).withColumn("ranges", F.array_join(ranges, " "))


@query("""
WITH l AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'data:text/plain;base64,' || to_base64(encode(c_name)) WHEN 1 THEN 'data:,' || url_encode(c_name) WHEN 2 THEN 'https://example.org/' || repeat(c_name, 6) WHEN 3 THEN 'a/../../' || c_name ELSE './b/../' || url_encode(c_name) || '?q#f' END AS link FROM customer)
SELECT l.c_custkey, ['data', 'data', 'remote', 'file', 'file'][CAST(l.c_custkey % 5 AS INT) + 1] AS kind, CASE WHEN l.c_custkey % 5 < 2 THEN c_name END AS content, CASE WHEN l.c_custkey % 5 = 4 THEN c_name END AS target,
  CASE l.c_custkey % 5 WHEN 2 THEN 'remote image not fetched (no network calls are made): ' || left(link, 80) WHEN 3 THEN 'image outside the document''s folder was not read: ' || left(link, 80) WHEN 4 THEN 'image file not found: ' || left(link, 80) END AS warning
FROM l JOIN customer USING (c_custkey)""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What image links refer to: bytes in the link, paths, and why there is nothing to read."""
    name, percent = F.col("c_name"), F.replace(F.url_encode("c_name"), F.lit("+"), F.lit("%20"))
    made = [F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode(name, "UTF-8"))), F.concat(F.lit("data:,"), percent), F.concat(F.lit("https://example.org/"), F.repeat(name, 6)), F.concat(F.lit("a/../../"), name), F.concat(F.lit("./b/../"), percent, F.lit("?q#f"))]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*made), (F.col("c_custkey") % 5).cast("int")).alias("link"))
    link, data = F.col("link"), F.when(links.kind(F.col("link")) == "data", links.data_bytes(F.col("link")))
    return rows.select("c_custkey", links.kind(link).alias("kind"), F.decode(data, "UTF-8").alias("content"), F.when(links.kind(link) == "file", links.local_path(link)).alias("target"), links.warning(link, data.isNotNull()).alias("warning"))


@query(BOXES_SQL + """, r AS (SELECT vec_id // 8 AS page, vec_id, greatest(a[1], 0) AS x0, greatest(a[2], 0) AS y0, least(a[3], 300) AS x1, least(a[4], 200) AS y1 FROM b),
s AS (SELECT * FROM r WHERE x1 > x0 AND y1 > y0), edges AS (SELECT page, x0 AS x FROM s UNION SELECT page, x1 FROM s), slabs AS (SELECT page, x AS l, lead(x) OVER (PARTITION BY page ORDER BY x) AS rt FROM edges),
spans AS (SELECT s.page, l, rt, y0, y1, max(y1) OVER (PARTITION BY s.page, l ORDER BY y0, y1, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM slabs JOIN s ON s.page = slabs.page AND x0 < rt AND x1 > l WHERE rt IS NOT NULL),
areas AS (SELECT page, sum((rt - l) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) AS area FROM spans GROUP BY page)
SELECT p.page, coalesce(area, 0) / 6e4 AS cover FROM (SELECT DISTINCT page FROM r) p LEFT JOIN areas ON p.page = areas.page""")
def image_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of a page of 300 by 200 its boxes cover, after clipping."""
    return pages_of_boxes(spark, sf_dir).select("page", M.image_cover(F.col("predicted"), F.lit(300.0), F.lit(200.0)).alias("cover"))


@query("""
SELECT vec_id, f AS format, CASE WHEN f NOT IN ('pdf', 'tiff', 'png', 'jpeg', 'bmp', 'webp') THEN '--pages applies to PDF pages and multi-frame TIFF frames only; ignored for ' || f END AS note, true AS has_reader
FROM (SELECT vec_id, ['pdf', 'png', 'jpeg', 'tiff', 'bmp', 'webp', 'docx', 'xlsx', 'pptx', 'md', 'doc', 'xls', 'ppt'][CAST(vec_id % 13 AS INT) + 1] AS f FROM embeddings)""")
def page_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each known format whether a choice of pages is worth a warning, and whether there is a reader."""
    formats = list(extract.READERS)
    order = ["pdf", "png", "jpeg", "tiff", "bmp", "webp", "docx", "xlsx", "pptx", "md", "doc", "xls", "ppt"]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.get(F.array(*map(F.lit, order)), (F.col("vec_id") % 13).cast("int")).alias("format"))
    return rows.select("vec_id", "format", extract.page_note(F.col("format"), Options(pages="1")).alias("note"), F.col("format").isin(formats).alias("has_reader"))
