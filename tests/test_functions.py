"""Text, page, sniffing and link functions."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import links, pages, sniffing
from leafmill.functions import text as T
from leafmill.sources import items, xlsx


def test_normal_form(value):
    assert value(T.normalize(F.col("t")), "t string", " e\u0301  x\u00a0y\n") == "\u00e9 x y"
    assert value(T.normalize(F.col("t")), "t string", None) == ""
    assert value(T.tokens(F.col("t")), "t string", " a\tb\u3000c ") == ["a", "b", "c"]
    assert value(T.tokens(F.col("t")), "t string", "") == []
    assert value(T.lf(F.col("t")), "t string", "a\r\nb\rc\n") == "a\nb\nc\n"


@pytest.mark.parametrize("rows", [[["a", "b|c"], ["d\ne"]], [["x"], []], [[], []], []])
def test_tables_are_those_of_the_readers(value, rows):
    assert value(T.md_table(F.col("r")), "r array<array<string>>", rows) == items.table(rows)


def test_null_tables_and_tsv(value):
    assert value(T.md_table(F.col("r")), "r array<array<string>>", None) == ""
    assert value(T.md_table(F.col("r")), "r array<array<string>>", [None, ["a", None]]).splitlines()[2] == "| a |  |"
    assert value(T.tsv(F.col("r"), True), "r array<array<string>>", [["a\nb", "c"], ["d"]]) == "a b\tc\nd"


def test_dense_grid(value):
    cells = [(1, 2, "x"), (3, 1, "y")]
    assert value(T.dense(F.col("c")), "c array<struct<row:int,col:int,value:string>>", cells) == [["", "x"], ["", ""], ["y", ""]]
    assert value(T.dense(F.col("c")), "c array<struct<row:int,col:int,value:string>>", None) == []


def test_column_letters(spark):
    got = {r["n"]: r["x"] for r in spark.range(1, 16385).select(F.col("id").alias("n"), T.column_letters(F.col("id")).alias("x")).collect()}
    assert got == {n: xlsx.letters(n) for n in range(1, 16385)}


NUMBERS = [0.0, -0.0, 1.0, -1.5, 123456789.0, 12345678.5, 1e15, 1.5e15, 1e16, 1.234e17, 1e22, 0.001, 0.00012, 1e-5, 9.99e-7, -2.5e-9, 1e300, 123456789012.25, 0.1 + 0.2]


@pytest.mark.parametrize("x", NUMBERS)
def test_numbers_read_as_in_python(value, x):
    assert value(T.cell_text(F.lit("number"), F.col("v")), "v string", repr(x)) == xlsx.cell_text(x)


def test_other_cells(value):
    of = lambda kind, v: value(T.cell_text(F.lit(kind), F.col("v")), "v string", v)
    assert of("bool", "true") == "TRUE" and of("bool", "0") == "FALSE" and of("number", None) == ""
    assert of("datetime", "2024-02-29 00:00:00") == "2024-02-29" == xlsx.cell_text(dt.datetime(2024, 2, 29))
    assert of("datetime", "2024-02-29 01:02:03") == "2024-02-29 01:02:03" == xlsx.cell_text(dt.datetime(2024, 2, 29, 1, 2, 3))


PAGES = [(None, 4, [1, 2, 3, 4]), ("2", 4, [2]), ("1-2,4", 4, [1, 2, 4]), ("3-", 5, [3, 4, 5]), ("2-9", 3, [2, 3]), ("7", 3, []), ("", 2, [1, 2])]


@pytest.mark.parametrize("spec, total, want", PAGES)
def test_page_selection(value, spec, total, want):
    assert value(pages.select_pages(spec, F.col("n")), "n int", total) == want
    assert value(pages.pages_of(F.col("s"), F.col("n")), "s string, n int", spec, total) == want


@pytest.mark.parametrize("spec", ["0", "3-1", "a", "1,,2", "1-b", "-3", "1-2-3"])
def test_bad_page_ranges(value, spec):
    with pytest.raises(ValueError):
        pages.parse_pages(spec)
    assert value(pages.pages_of(F.col("s"), F.col("n")), "s string, n int", spec, 3) is None


def test_empty_page_range():
    with pytest.raises(ValueError):
        pages.parse_pages("")


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7])
def test_samples(spark, k):
    got = spark.range(0, 40).select("id", pages.sample_positions(F.col("id"), k).alias("x")).collect()
    for n, x in got:
        want = list(range(n)) if n <= k else [0] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
        assert x == want


def test_pixels(value):
    assert "108 megapixels" in value(pages.too_many_pixels(F.col("w"), F.col("h"), 100_000_000), "w int, h int", 12000, 9000)
    assert value(pages.too_many_pixels(F.col("w"), F.col("h"), 100_000_000), "w int, h int", 100, 90) is None
    d = value(pages.render_dpi(F.col("w"), F.col("h"), 200, 1_000_000), "w double, h double", 595.0, 842.0)
    assert d["dpi"] < 200 and (595 / 72 * d["dpi"]) * (842 / 72 * d["dpi"]) <= 1e6 and d["warning"]
    assert value(pages.render_dpi(F.col("w"), F.col("h"), 200, 100), "w double, h double", 595.0, 842.0)["message"].startswith("PDF page is 595x842 pt")


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k.replace("__", "/").replace("_xml", ".xml"), v)
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n" + bytes(20)
OLE = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(20)
DETECTED = [
    ("a.pdf", b"junk %PDF-1.7", "pdf", None), ("a.png", PNG, "png", None), ("a.jpg", PNG, "png", None), ("a.md", b"# x", "md", None), ("a.docx", zipped(word__document_xml="x"), "docx", None),
    ("a.bin", zipped(xl__workbook_xml="x"), "xlsx", None), ("a.pptx", zipped(ppt__presentation_xml="x"), "pptx", None), ("a.doc", OLE, "doc", None), ("a.docx", OLE, None, "PasswordProtected"), ("a.x", OLE, None, "UnsupportedFormat"),
    ("a.txt", b"", None, "EmptyFile"), ("a.png", b"no image", None, "CorruptFile"), ("a.docx", b"PK\x03\x04junk", None, "CorruptFile"), ("a.bin", b"data", None, "UnsupportedFormat"), ("a.eml", b"data", None, "UnsupportedFormat"),
    ("a.zip", zipped(a="x"), None, "UnsupportedFormat"), ("a.gif", b"GIF89a", None, "UnsupportedFormat"), ("a.tif", b"II*\0", "tiff", None), ("a.webp", b"RIFF0000WEBP", "webp", None),
    ("a.bmp", b"BM" + bytes(12) + b"\x28\0\0\0" + b"\0", "bmp", None), ("a.bmp", b"BM" + bytes(12) + b"\x29\0\0\0" + b"\0", None, "CorruptFile"), ("a", None, None, "EmptyFile"),
]


def test_detection(spark):
    df = spark.createDataFrame([(i, n, c) for i, (n, c, *_) in enumerate(DETECTED)], "i int, name string, content binary").withColumn("m", sniffing.sniff(F.col("content")))
    got = df.select("i", sniffing.detect(F.col("name"), F.length("content"), F.col("m"), sniffing.office_kind(F.col("content"), F.col("m"))).alias("d")).orderBy("i").collect()
    assert [(r["d"]["format"], r["d"]["error_type"]) for r in got] == [(f, e) for *_, f, e in DETECTED]
    assert got[2]["d"]["warnings"] == ["extension .jpg says jpeg but the content is png; treated as png"]
    assert got[13]["d"]["message"] == "unsupported file type '.bin'"
    assert not set(sniffing.EXTENSIONS.values()) - set(__import__("leafmill.operators.extract", fromlist=["READERS"]).READERS)


@pytest.mark.parametrize(
    "data, text, n, error",
    [
        ("é\r\nx\ry".encode(), "é\nx\ny", 0, None), (b"\xef\xbb\xbfabc", "abc", 0, None), ("é".encode("utf-16"), "é", 0, None), (b"caf\xe9", "café", 1, None), (b"a\0b", None, 0, "CorruptFile"),
        (b"\xff\xfea", None, 0, "UnicodeDecodeError"), (b"\xef\xbb\xbf\xff", None, 0, "UnicodeDecodeError"), (b"", "", 0, None), (None, "", 0, None),
    ],
)
def test_decoding(value, data, text, n, error):
    d = value(sniffing.decode_text(F.col("c")), "c binary", data)
    assert (d["text"], len(d["warnings"]), d["error_type"]) == (text, n, error)


@pytest.mark.parametrize(
    "link, kind, path",
    [("a/b%20c.png?q#f", "file", "a/b c.png"), ("./a/../b.png", "file", "b.png"), ("../x.png", "file", None), ("/etc/x.png", "file", None), ("a/../../x", "file", None), ("http://x/y", "remote", None), ("//x/y", "remote", None), ("c:/x", "remote", None), ("a+b%zz.png", "file", "a+b%zz.png")],
)
def test_links(value, link, kind, path):
    assert value(links.kind(F.col("l")), "l string", link) == kind
    if kind == "file":
        assert value(links.local_path(F.col("l")), "l string", link) == path


def test_data_links(value):
    of = lambda s: value(links.data_bytes(F.col("l")), "l string", s)
    assert of("data:image/png;base64,AAEC") == b"\0\1\2" and of("data:,a%20b+c") == b"a b+c" and of("data:,%E2%82%AC") is None
    assert value(links.image_links(F.col("l")), "l string", "x ![a](b.png) ![c]( <d.png> 't') [e](f.png)") == ["b.png", "d.png"]
