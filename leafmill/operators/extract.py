"""Files to items: one pass of a Python stage over the bytes, which imports a reader when the first file of its kind comes."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from functools import cache
from importlib import import_module

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import links
from leafmill.functions.fence import fence
from leafmill.functions.pages import parse_pages
from leafmill.functions.sniffing import decode_text
from leafmill.schema import Options, ReadError, as_error
from leafmill.sources import items, pdf
from leafmill.sources.items import ARROW, ITEM

#: The module that reads each format.
READERS = {
    "pdf": "pdf", "png": "images", "jpeg": "images", "tiff": "images", "bmp": "images", "webp": "images",
    "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "md": "markdown", "doc": "legacy", "xls": "legacy", "ppt": "legacy",
}
#: Formats for which a choice of pages isn't worth a warning.
PAGED = ["pdf", "tiff", "png", "jpeg", "bmp", "webp"]

Backend = Callable[[], pdf.Backend]


def reader(kind: str):
    """The module that reads a format, imported when it is first asked for."""
    return import_module(f"leafmill.sources.{READERS[kind]}")


def read_items(kind: str, content: bytes, text: dict | None, assets: dict[str, dict] | None, options: Options, backend: pdf.Backend) -> list[dict]:
    """The items of one file."""
    ranges = parse_pages(options.pages) if options.pages else None
    if READERS[kind] == "legacy":
        content, kind, said = reader(kind).converted(content, kind)
        return [items.note(said), *read_items(kind, content, None, None, options, backend)]
    if kind == "pdf":
        return reader(kind).read(content, backend, ranges, options.pages)
    if READERS[kind] == "images":
        return reader(kind).read(content, ranges, options.pages)
    if kind == "md":
        if text["error_type"]:
            raise ReadError(text["error_type"], text["message"])
        found = {k: v["bytes"] for k, v in (assets or {}).items() if v["bytes"] is not None}
        return reader(kind).read(text["text"], text["warnings"], found, {k: v["warning"] for k, v in (assets or {}).items()})
    return reader(kind).read(content)


OUT = pa.struct([("items", ARROW), ("error_type", pa.string()), ("message", pa.string()), ("seconds", pa.float64()), ("rss_mb", pa.float64())])
ESCAPED = "document.json uses \\u escapes because the text has characters that cannot be encoded as UTF-8"


@cache
def _process(pid: int):
    """What psutil knows of a process; looking it up takes longer than asking it."""
    import psutil

    return psutil.Process(pid)


def rss_mb() -> float | None:
    """The worker's resident memory, or null where psutil isn't there."""
    try:
        return round(_process(os.getpid()).memory_info().rss / 2**20, 1)
    except Exception:  # a figure that can't be had is no failure
        return None


def _stage(options: Options, backend: Backend):
    def read(kind: pa.Array, content: pa.Array, text: pa.Array, assets: pa.Array) -> list[dict]:
        out = []
        for k, c, t, a in zip(kind, content, text, assets):
            began = time.perf_counter()
            row = {"items": [], "error_type": None, "message": None}
            if k.is_valid:
                try:
                    found = read_items(k.as_py(), c.as_py() or b"", t.as_py(), None if not a.is_valid else dict(a.as_py()), options, backend())
                    row["items"] = items.as_arrow(found)
                    if any(isinstance(v, str) and items.clean(v) != v for i in found for v in i.values()):
                        row["items"] += items.as_arrow([items.note(ESCAPED)])
                except Exception as e:  # whatever a file does to its reader becomes that file's error
                    row["error_type"], row["message"] = map(items.clean, as_error(e))
            out.append(row | {"seconds": time.perf_counter() - began, "rss_mb": rss_mb()})
        return out

    def run(kind: pa.Array, content: pa.Array, text: pa.Array, assets: pa.Array) -> pa.Array:
        return items.by_slices(read, OUT, kind, content, text, assets)

    return F.arrow_udf(run, f"struct<items:array<{ITEM}>,error_type:string,message:string,seconds:double,rss_mb:double>")


def _own_assets(text: Column) -> Column:
    """The map of with_assets() where only data: links have bytes; null without a link."""
    found = F.transform(F.array_distinct(links.image_links(text)), lambda k: F.struct(k.alias("link"), F.when(links.kind(k) == "data", links.data_bytes(k)).alias("bytes")))
    entries = F.transform(found, lambda x: F.struct(x["link"].alias("link"), F.struct(x["bytes"].alias("bytes"), links.warning(x["link"], x["bytes"].isNotNull()).alias("warning")).alias("told")))
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def with_assets(jobs: DataFrame, files: DataFrame | None) -> DataFrame:
    """Adds `assets`, a map from each image link of a Markdown text to its bytes or the reason that there are none.

    jobs: with path, format and text (see functions.sniffing.decode_text); files: path and content of what local links
    may refer to. Rows of other formats have null and pass by: their contents meet no join. Without files no row does:
    what a text links to is in its own row.
    """
    if files is None:
        return jobs.withColumn("assets", fence(F.when(F.col("format") == "md", _own_assets(F.col("text.text")))))
    is_md = F.coalesce(F.col("format") == "md", F.lit(False))
    one = jobs.where(is_md).select("path", F.explode(F.array_distinct(links.image_links(F.col("text.text")))).alias("link"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    one = one.withColumn("kind", links.kind(F.col("link"))).withColumn("target", F.when(F.col("kind") == "file", F.concat(folder, F.lit("/"), links.local_path(F.col("link")))))
    told = one.join(files.select(F.col("path").alias("target"), F.col("content").alias("bytes")), "target", "left")
    told = told.withColumn("bytes", F.when(F.col("kind") == "data", links.data_bytes(F.col("link"))).otherwise(F.col("bytes")))
    entry = F.struct("link", F.struct("bytes", links.warning(F.col("link"), F.col("bytes").isNotNull()).alias("warning")))
    maps = told.groupBy("path").agg(F.map_from_entries(F.collect_list(entry)).alias("assets"))
    found = jobs.where(is_md).join(maps, "path", "left")
    others = jobs.where(~is_md)
    return found.unionByName(others.withColumn("assets", F.lit(None).cast(found.schema["assets"].dataType)))


def extract(jobs: DataFrame, options: Options = Options(), backend: Backend = pdf.default, files: DataFrame | None = None) -> DataFrame:
    """Adds `text` (of Markdown) and `read`: a struct of items, error_type, message, seconds and rss_mb.

    jobs: with path, format (null where detection failed) and content. Nothing is read of rows without a format.
    """
    with_text = jobs.withColumn("text", fence(decode_text(F.when(F.col("format") == "md", F.col("content")))))
    told = with_assets(with_text, files)
    stage = _stage(options, backend)
    return told.withColumn("read", fence(stage(F.col("format"), F.when(F.col("format") != "md", F.col("content")), F.when(F.col("format") == "md", F.col("text")), F.col("assets"))))


def page_note(fmt: Column, options: Options) -> Column:
    """Null, or the warning that a choice of pages means nothing to a format."""
    if not options.pages:
        return F.lit(None).cast("string")
    return F.when(~fmt.isin(PAGED), F.concat(F.lit("--pages applies to PDF pages and multi-frame TIFF frames only; ignored for "), fmt))
