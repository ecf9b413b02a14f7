"""What a file is: by its first bytes, by its name, and by what a ZIP holds."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.quality import _quoted

# Known extensions and the formats they stand for.
EXTENSIONS = {
    ".pdf": "pdf", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".tif": "tiff", ".tiff": "tiff", ".bmp": "bmp", ".webp": "webp",
    ".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx", ".md": "md", ".markdown": "md", ".doc": "doc", ".xls": "xls", ".ppt": "ppt",
}
# What a ZIP of each Office format holds, in the order in which they are tried.
MEMBERS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
# Extensions of containers, which are refused by name.
CONTAINERS = [".eml", ".msg", ".zip", ".7z", ".rar", ".tar", ".gz"]
# Sizes that a BMP's second header can have.
DIB_SIZES = [12, 40, 52, 56, 64, 108, 124]
HEAD = 4096


def sniff(content: Column) -> Column:
    """The kind that the first bytes tell: pdf, png, jpeg, tiff, bmp, webp, zip, ole, gif, or null."""
    s = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")  # a character for each byte
    four = F.substring(s, 1, 4)
    return (
        F.when(F.substring(s, 1, 1024).contains("%PDF-"), "pdf")
        .when(s.startswith("\x89PNG\r\n\x1a\n"), "png")
        .when(s.startswith("\xff\xd8\xff"), "jpeg")
        .when(four.isin("II*\0", "MM\0*"), "tiff")
        .when(s.startswith("BM") & (F.length(s) > 18) & F.substring(s, 15, 4).isin([f"{chr(n)}\0\0\0" for n in DIB_SIZES]), "bmp")
        .when((four == "RIFF") & (F.substring(s, 9, 4) == "WEBP"), "webp")
        .when(four.isin("PK\x03\x04", "PK\x05\x06"), "zip")
        .when(s.startswith("\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), "ole")
        .when(F.substring(s, 1, 6).isin("GIF87a", "GIF89a"), "gif")
    )


def suffix(name: Column) -> Column:
    """The extension of a path's last part, with its dot; empty if there is none."""
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/](\.[^./]+)$", 1)


def format_of(extension: Column) -> Column:
    """The format of an extension, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair)), F.lower(extension))


def _office(s: pd.Series) -> pd.DataFrame:
    rows = []
    for content in s:
        try:
            names = None if content is None else zipfile.ZipFile(io.BytesIO(content)).namelist()
            rows.append((None if names is None else next((k for k, member in MEMBERS.items() if member in names), "zip"), None))
        except zipfile.BadZipFile as e:
            rows.append((None, f"not a valid ZIP/Office container: {e}"))
    return pd.DataFrame(rows, columns=["kind", "message"], dtype="object")


_office_udf = F.pandas_udf(_office, T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())]))


def office_kind(content: Column, magic: Column) -> Column:
    """kind and message of the files that are ZIPs: docx, xlsx, pptx, or zip for any other. Only those files' bytes go to Python."""
    return _office_udf(F.when(magic == "zip", content))


def detect(name: Column, length: Column, magic: Column, office: Column) -> Column:
    """A struct of format, error_type, message and warnings: bytes win over the extension, and text formats have none.

    magic: of sniff(); office: of office_kind(). Null length counts as 0.
    """
    ext = suffix(name)
    by_name = format_of(ext)
    kind = F.when(magic == "zip", office["kind"]).otherwise(magic)
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    fail = [
        (F.coalesce(length, F.lit(0)) == 0, "EmptyFile", F.lit("file is empty (0 bytes)")),
        ((magic == "zip") & office["message"].isNotNull(), "CorruptFile", office["message"]),
        (kind == "zip", "UnsupportedFormat", F.lit("ZIP archives are not supported; extract them first")),
        (kind == "gif", "UnsupportedFormat", F.lit("GIF images are not supported")),
        ((kind == "ole") & by_name.isin("docx", "xlsx", "pptx"), "PasswordProtected", text(ext, " file is an OLE container, not OOXML: it is password-protected or a legacy binary file with the wrong extension; no content was read")),
        ((kind == "ole") & ~F.coalesce(by_name.isin("doc", "xls", "ppt"), F.lit(False)), "UnsupportedFormat", F.lit("legacy Office/OLE container with an unrecognised extension")),
        (kind.isNull() & by_name.isNotNull() & (by_name != "md"), "CorruptFile", text("content is not a valid ", F.upper(by_name), " (extension ", ext, ")")),
        (kind.isNull() & by_name.isNull() & F.lower(ext).isin(CONTAINERS), "UnsupportedFormat", text(ext, " containers are not supported; extract the files first")),
        (kind.isNull() & by_name.isNull(), "UnsupportedFormat", text("unsupported file type ", _quoted(F.when(ext == "", F.lit("(no extension)")).otherwise(ext)))),
    ]
    error, message = F, F
    for condition, what, said in fail:
        error, message = error.when(condition, F.lit(what)), message.when(condition, said)
    fmt = F.when(error.isNull(), F.when((kind == "ole") | kind.isNull(), by_name).otherwise(kind))
    odd = error.isNull() & (kind != "ole") & by_name.isNotNull() & (by_name != kind)
    note = text("extension ", ext, " says ", by_name, " but the content is ", kind, "; treated as ", kind)
    return F.struct(fmt.alias("format"), error.alias("error_type"), message.alias("message"), F.when(odd, F.array(note)).otherwise(F.array().cast("array<string>")).alias("warnings"))


def _other_encodings(s: pd.Series) -> pd.DataFrame:
    rows = []
    for data in s:
        if data is None:
            rows.append((None, None, None, False))
            continue
        try:
            if data.startswith((b"\xff\xfe", b"\xfe\xff")):
                rows.append((data.decode("utf-16"), None, None, False))
            elif data.startswith(b"\xef\xbb\xbf"):
                rows.append((data[3:].decode("utf-8"), None, None, False))
            else:
                rows.append((data.decode("cp1252", errors="replace"), None, None, True))
        except UnicodeDecodeError as e:
            rows.append((None, type(e).__name__, str(e), False))
    return pd.DataFrame(rows, columns=["text", "error_type", "message", "guessed"])


_decode_udf = F.pandas_udf(_other_encodings, T.StructType([T.StructField("text", T.StringType()), T.StructField("error_type", T.StringType()), T.StructField("message", T.StringType()), T.StructField("guessed", T.BooleanType())]))


def decode_text(content: Column) -> Column:
    """A struct of text (LF line ends), warnings, error_type and message. Null content counts as empty.

    A byte order mark decides, then UTF-8, then Windows-1252 with a warning; NUL among the first 8192 bytes of what
    has no mark is an error. UTF-8, marked or not, is decoded natively; only other bytes go to Python.
    """
    content = F.coalesce(content, F.lit(b""))
    head = F.hex(F.substring(content, 1, 3))
    marked, wide = head == "EFBBBF", F.substring(head, 1, 4).isin("FFFE", "FEFF")
    nul = ~marked & ~wide & F.decode(F.substring(content, 1, 8192), "ISO-8859-1").contains("\0")
    body = F.when(marked, F.substring(content, 4, 1 << 30)).otherwise(content).cast("string")
    native = ~wide & F.is_valid_utf8(body)
    other = _decode_udf(F.when(~nul & ~native, content))
    text = F.when(nul, F.lit(None)).when(native, body).otherwise(other["text"])
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    note = F.array(F.lit("not valid UTF-8; decoded as Windows-1252, so non-Latin text may be wrong"))
    return F.struct(
        unix.alias("text"),
        F.when(~nul & ~native & other["guessed"], note).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.when(nul, F.lit("CorruptFile")).when(~native, other["error_type"]).alias("error_type"),
        F.when(nul, F.lit("file contains NUL bytes; it is not a text file")).when(~native, other["message"]).alias("message"),
    )
