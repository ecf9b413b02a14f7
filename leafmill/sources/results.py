"""document.json: writing one for each document, and reading them back whatever else they hold."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.schema import DOCUMENT

_HIDDEN = re.compile(r"^\.|^_(?!.*=)|\._COPYING_$")
ALWAYS = ["index", "kind", "origin", "status", "reason", "text", "markdown", "warnings"]
OPTIONAL = ["page", "name", "page_width_pt", "page_height_pt", "text_layer", "seconds", "error_type", "message"]


def _joined(*objects: Column) -> Column:
    """JSON objects as one."""
    inner = [F.substring(o, F.lit(2), F.length(o) - 2) for o in objects]
    kept = F.filter(F.array(*inner), lambda x: x != "")
    return F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}"))


def unit_json(u: Column) -> Column:
    """A unit as JSON: keys that are always there, optional ones that aren't null, and for OCR its keys even if they are null."""
    plain = F.to_json(F.struct(*(u[k].alias(k) for k in [*ALWAYS, *OPTIONAL])))
    # A resolution is a whole number of dots.
    sizes = F.to_json(F.struct(u["render_dpi"].cast("int").alias("render_dpi"), u["width_px"].alias("width_px"), u["height_px"].alias("height_px")), {"ignoreNullFields": "false"})
    blocks = F.concat(F.lit('{"blocks":'), F.coalesce(F.to_json(u["blocks"]), F.lit("[]")), F.lit("}"))
    return F.when(u["origin"] == "ocr", _joined(plain, sizes, blocks)).otherwise(plain)


def document_json(d: dict[str, Column] | None = None) -> Column:
    """A document's row, by schema.DOCUMENT, as JSON; d: columns that stand for others. Error keys are there for errors only."""
    c = lambda name: (d or {}).get(name, F.col(name))
    keep = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(c("source").alias("source"), c("sha256").alias("sha256"), c("format").alias("format"), c("status").alias("status")), keep)
    fault = F.when(c("status") == "error", F.to_json(F.struct(c("error_type").alias("error_type"), c("message").alias("message")), keep)).otherwise(F.lit("{}"))
    units = F.concat(F.lit('{"unit_count":'), F.size(c("units")).cast("string"), F.lit(',"units":['), F.array_join(F.transform(c("units"), unit_json), ","), F.lit("]}"))
    rest = F.to_json(F.struct(c("warnings").alias("warnings"), c("timings").alias("timings"), c("tool_versions").alias("tool_versions"), c("model_attribution").alias("model_attribution")))
    no_timings = F.when(c("timings").isNull(), F.lit('{"timings":{}}')).otherwise(F.lit("{}"))
    return _joined(head, fault, units, rest, no_timings)


def fs_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        errors = []
        for folder, text in zip(b.column("folder").to_pylist(), b.column("json").to_pylist()):
            try:
                fs, at = fs_of(folder)
                fs.create_dir(at, recursive=True)
                with fs.open_output_stream(f"{at}/document.json") as out:
                    out.write(json.dumps(json.loads(text), ensure_ascii=False, indent=2).encode())
                errors.append(None)
            except OSError as e:
                errors.append(f"could not write {folder}: {e}")
        yield pa.RecordBatch.from_arrays([b.column("folder"), pa.array(errors, pa.string())], ["folder", "write_error"])


def write_documents(documents: DataFrame) -> DataFrame:
    """Writes folder/document.json for each row (schema.DOCUMENT and folder): folder and write_error (null where it went well).

    Executors write; a task that is run again writes the same files again.
    """
    return documents.select("folder", document_json().alias("json")).mapInArrow(_store, "folder string, write_error string")


def _below(folder: str) -> Iterator[tuple[str, bool]]:
    """Paths right below a folder and whether each is one itself, without what Spark's listings hide. A local folder is never held whole."""
    fs, at = fs_of(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                if not _HIDDEN.search(e.name):
                    yield f"{folder.rstrip('/')}/{e.name}", e.is_dir()
        return
    for f in fs.get_file_info(pafs.FileSelector(at)):
        if not _HIDDEN.search(f.base_name):
            yield f"{folder.rstrip('/')}/{f.base_name}", f.type == pafs.FileType.Directory


def _rows(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _documents_below(path: str, is_folder: bool) -> Iterator[tuple[str]]:
    stack = [(path, is_folder)]
    while stack:
        at, deeper = stack.pop()
        if deeper:
            stack += [x for x in _below(at) if x[1] or x[0].endswith("/document.json")]
        elif at.endswith("/document.json"):
            yield (at,)


def _content(path: str) -> bytes:
    fs, at = fs_of(path)
    with fs.open_input_stream(at) as data:
        return data.read()


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All document.json below a folder, by schema.DOCUMENT, and the `folder` of each; keys that the schema doesn't have are passed over.

    Tasks list and read: one what lies right below the folder, many what lies deeper. No file is known to the driver.
    """
    fs, at = fs_of(folder)
    local = isinstance(fs, pafs.LocalFileSystem)
    root, shown = (at, lambda path: "file://" + quote(path, safe="/!$&'()*+,;=:@~-._")) if local else (folder, str)
    entry, one = pa.schema([("path", pa.string()), ("is_folder", pa.bool_())]), pa.schema([("path", pa.string())])
    text = pa.schema([("path", pa.string()), ("json", pa.binary())])
    each = lambda b: zip(*(b.column(c).to_pylist() for c in b.schema.names))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list(batches)
        yield from _rows(_below(root), entry, 1000)

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows((d for b in batches for row in each(b) for d in _documents_below(*row)), one, 1000)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(((shown(path), _content(path)) for b in batches for (path,) in each(b)), text, 100)

    tasks = 4 * spark.sparkContext.defaultParallelism
    found = spark.range(1).coalesce(1).mapInArrow(top, "path string, is_folder boolean").repartition(tasks)
    paths = found.mapInArrow(deeper, "path string").repartition(tasks)
    told = paths.mapInArrow(read, "path string, json binary").where("length(json) > 0")
    return told.select(F.from_json(F.col("json").cast("string"), DOCUMENT).alias("d"), F.regexp_replace("path", "/[^/]*$", "").alias("folder")).select("d.*", "folder")
