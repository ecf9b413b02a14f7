"""Files made of the rows of customer, in each format, and what the readers make of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.fence import fence
from leafmill.plans.process import documents_of
from leafmill.plans.registry import query, table
from leafmill.schema import Options
from leafmill.session import spread
from leafmill.sources import inputs
from leafmill.sources.items import by_slices

# XML names.
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DRAWING, SLIDES = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"

#: Lines of a PDF page below its heading.
LINE, LINES = "a healthy line of text on this page", 9


def _package(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _links(*rows: tuple[str, str, str]) -> str:
    return f'<Relationships xmlns="{PACKAGE}">{"".join(f"""<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{to}"/>""" for i, kind, to in rows)}</Relationships>'


def docx(key: int, name: str, segment: str) -> bytes:
    """A title, a paragraph, a bullet, and a table of two rows."""

    def p(text: str, style: str = "") -> str:
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{props}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    rows = "".join(f"<w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in r)}</w:tr>" for r in ([f"{name} | x", segment], [str(key), ""]))
    body = p(f"Customer {name}", "T") + p(f"of <{segment}> & more") + p(f"key {key}", "B") + f"<w:tbl>{rows}</w:tbl>"
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("T", "Title"), ("B", "List Bullet")))
    return _package({
        "_rels/.rels": _links(("a", "officeDocument", "word/document.xml")), "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>',
        "word/_rels/document.xml.rels": _links(("s", "styles", "styles.xml")), "word/styles.xml": f'<w:styles xmlns:w="{WORD}">{styles}</w:styles>',
    })


def xlsx(key: int, name: str, segment: str) -> bytes:
    """A sheet of two rows with shared and inline text, a number and a truth value, and an empty sheet."""
    rows = f'<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>{escape(segment)}</t></is></c></row><row r="2"><c r="A2"><v>{key}</v></c><c r="B2" t="b"><v>{key % 2}</v></c></row>'
    sheet = lambda inner: f'<worksheet xmlns="{SHEET}"><sheetData>{inner}</sheetData></worksheet>'
    return _package({
        "_rels/.rels": _links(("a", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="Rows" sheetId="1" r:id="a"/><sheet name="None" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _links(("a", "worksheet", "worksheets/1.xml"), ("b", "worksheet", "worksheets/2.xml"), ("s", "sharedStrings", "strings.xml")),
        "xl/strings.xml": f'<sst xmlns="{SHEET}"><si><t>{escape(name)}</t></si></sst>', "xl/worksheets/1.xml": sheet(rows), "xl/worksheets/2.xml": sheet(""),
    })


def pptx(key: int, name: str, segment: str) -> bytes:
    """Two slides, which odd keys put in the other order than their names have."""
    head = f'xmlns:a="{DRAWING}" xmlns:p="{SLIDES}" xmlns:r="{OFFICE}"'

    def shape(text: str, title: bool = False) -> str:
        place = '<p:ph type="title"/>' if title else ""
        return f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>"

    slide = lambda inner: f"<p:sld {head}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    order = ("b", "a") if key % 2 else ("a", "b")
    return _package({
        "_rels/.rels": _links(("m", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f"<p:presentation {head}><p:sldIdLst>{''.join(f'<p:sldId r:id={chr(34)}{i}{chr(34)}/>' for i in order)}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _links(("a", "slide", "slides/slide1.xml"), ("b", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape(f"Customer {name}", title=True) + shape(segment)), "ppt/slides/slide2.xml": slide(shape(f"key {key}")),
    })


def md(key: int, name: str, segment: str) -> bytes:
    """Text as it is, with a link to an image that isn't there."""
    return f"# {name}\n\nof {segment}\n\n![k](none-{key}.png)\n".encode()


def pdf(key: int, name: str, segment: str) -> bytes:
    """Two pages, each with a heading and lines enough to be read without OCR."""
    safe = lambda t: t.encode("ascii", "replace").decode().replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    page = lambda head: "BT /F 12 Tf 72 720 Td " + " 0 -14 Td ".join(f"({safe(t)}) Tj" for t in [head, *[LINE] * LINES]) + " ET"
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792] /Resources << /Font << /F 5 0 R >> >> >>",
        *(f"<< /Type /Page /Parent 2 0 R /Contents {n} 0 R >>" for n in (6, 7)), "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        *(f"<< /Length {len(p)} >>\nstream\n{p}\nendstream" for p in map(page, (f"Customer {name}", f"key {key} of {segment}"))),
    ]
    out, at = bytearray(b"%PDF-1.7\n"), []
    for n, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{n} 0 obj\n{o}\nendobj\n".encode()
    table_at = len(out)
    rows = "".join(f"{x:010d} 00000 n \n" for x in at)
    return bytes(out) + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n{rows}trailer\n<< /Root 1 0 R /Size {len(at) + 1} >>\nstartxref\n{table_at}\n%%EOF\n".encode()


def jobs_of(spark: SparkSession, sf_dir: str, made: Callable[[int, str, str], bytes], extension: Column | None = None) -> DataFrame:
    """A file for each customer, as by inputs.scan(); its extension is the maker's name unless another is given."""

    def run(key: pa.Array, name: pa.Array, segment: pa.Array) -> pa.Array:
        return by_slices(lambda *columns: [made(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.binary(), key, name, segment)

    text = lambda c: F.coalesce(c, F.lit(""))
    path = F.concat(F.lit("/in/"), F.col("c_custkey").cast("string"), F.lit("."), F.lit(made.__name__) if extension is None else extension)
    content = fence(F.arrow_udf(run, "binary")(F.col("c_custkey").cast("long"), text("c_name"), text("c_mktsegment")))  # made once, not wherever it is used
    rows = spread(table(spark, sf_dir, "customer")).select(path.alias("path"), content.alias("content"))
    jobs = rows.select(F.lit(0).alias("input"), F.col("path").alias("source"), "path", F.lit("").alias("rel_dir"), F.substring_index("path", "/", -1).alias("name"), F.length("content").cast("long").alias("length"), "content", F.lit(False).alias("missing"))
    return jobs.select(*(c.split()[0] for c in inputs.COLUMNS.split(", ")))


def key_of(name: str = "name") -> Column:
    """The customer that a file of jobs_of() was made of."""
    return F.substring_index(name, ".", 1).cast("long").alias("c_custkey")


def _read(spark: SparkSession, sf_dir: str, made: Callable[[int, str, str], bytes]) -> DataFrame:
    """A file for each customer, through detection, reader, routes and roll-up; a row for each unit."""
    documents = documents_of(jobs_of(spark, sf_dir, made), Options())
    units = documents.select(key_of(), "format", F.col("status").alias("document_status"), F.explode("units").alias("u"))
    return units.select("c_custkey", "format", "document_status", *(F.col(f"u.{c}").alias(a) for c, a in (("index", "unit_index"), ("kind", "kind"), ("origin", "origin"), ("status", "status"), ("page", "page"), ("name", "name"), ("text", "text"), ("markdown", "markdown"))))


def _sql(fmt: str, kind: str, *units: tuple[str, str, str, str]) -> str:
    """Units as page, name, text and Markdown, SQL over n (c_name), s (c_mktsegment) and k (c_custkey)."""
    rows = " UNION ALL ".join(
        f"SELECT k AS c_custkey, '{fmt}' AS format, 'ok' AS document_status, CAST({i} AS INT) AS unit_index, '{kind}' AS kind, 'native' AS origin, 'ok' AS status, CAST({page} AS INT) AS page, CAST({name} AS VARCHAR) AS name, {text} AS text, {markdown} AS markdown FROM c"
        for i, (page, name, text, markdown) in enumerate(units)
    )
    return f"WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, coalesce(c_name, '') AS n, coalesce(c_mktsegment, '') AS s, chr(10) AS nl, chr(9) AS tab FROM customer) {rows}"


@query(_sql("docx", "section", (
    "NULL", "NULL", "'Customer ' || n || nl || 'of <' || s || '> & more' || nl || 'key ' || k || nl || n || ' | x' || tab || s || nl || k || tab",
    "'# Customer ' || n || nl || nl || 'of <' || s || '> & more' || nl || nl || '- key ' || k || nl || nl || '| ' || n || ' \\| x | ' || s || ' |' || nl || '| --- | --- |' || nl || '| ' || k || ' |  |'",
)))
def read_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, docx)


@query(_sql(
    "xlsx", "sheet",
    ("NULL", "'Rows'", "n || tab || s || nl || k || tab || upper(CAST(k % 2 = 1 AS VARCHAR))", "'## Rows' || nl || nl || '| ' || n || ' | ' || s || ' |' || nl || '| --- | --- |' || nl || '| ' || k || ' | ' || upper(CAST(k % 2 = 1 AS VARCHAR)) || ' |'"),
    ("NULL", "'None'", "''", "'## None' || nl || nl || '_(empty sheet)_'"),
))
def read_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, xlsx)


_SLIDE = ["'## Customer ' || n || {} || s", "'key ' || k"]


def _slides(odd: int) -> tuple[str, str]:
    one, two = (f"CASE WHEN k % 2 = {odd} THEN {_SLIDE[1]} ELSE {_SLIDE[0].format(gap)} END" for gap in ("nl", "nl || nl"))
    return one, two


@query(_sql("pptx", "page", ("1", "NULL", *_slides(1)), ("2", "NULL", *_slides(0))))
def read_pptx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, pptx)


_MD = "'# ' || n || nl || nl || 'of ' || s || nl || nl || '![k](none-' || k || '.png)' || nl"


@query(_sql("md", "section", ("NULL", "NULL", _MD, _MD)))
def read_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, md)


_PDF = [f"{head} || repeat(nl || '{LINE}', {LINES})" for head in ("'Customer ' || n", "'key ' || k || ' of ' || s")]


@query(_sql("pdf", "page", *(("%d" % n, "NULL", t, t) for n, t in enumerate(_PDF, 1))))
def read_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, pdf)
