"""Input files as rows: folders and single files, and what is skipped."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.sniffing import EXTENSIONS, format_of, suffix
from leafmill.sources.results import fs_of

COLUMNS = "input int, source string, path string, rel_dir string, name string, length long, content binary, missing boolean"


def _local(path: Column) -> Column:
    """A path without the scheme that Spark puts before local ones."""
    return F.regexp_replace(path, "^file:/+", "/")


def _unlisted(root: str) -> Iterator[dict]:
    """What Spark's listing leaves out: empty files, and those with a part of their path that begins with a dot or an underscore."""
    fs, at = fs_of(root)
    for f in fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)):
        below = f.path[len(at.rstrip("/")) + 1 :]
        if f.type == pafs.FileType.File and (not f.size or re.search(r"(^|/)[._]", below)):
            known = os.path.splitext(f.base_name)[1].lower() in EXTENSIONS and not f.base_name.startswith((".", "~$"))
            content = b""
            if known and f.size:
                with fs.open_input_stream(f.path) as data:
                    content = data.read()
            yield {"path": f.path, "length": f.size, "content": content}


def unlisted(spark: SparkSession, root: str) -> DataFrame:
    """path, length and content of _unlisted(), by a task of its own; content only of files that would be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list(batches)
        for f in _unlisted(root):
            yield pa.RecordBatch.from_pylist([f], pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())]))

    return spark.range(1).coalesce(1).mapInArrow(run, "path string, length long, content binary")


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder: root, path, below (the path below the root), length and content."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(_local(F.col("path")).alias("path"), F.expr("length"), "content")
    start = os.path.abspath(base) if "://" not in base and not base.startswith("file:") else base
    every = found.unionByName(unlisted(spark, start))
    return every.select(_local(F.lit(start)).alias("root"), "path", "length", "content").withColumn("below", F.substring(F.col("path"), F.length("root") + 2, F.lit(1 << 20)))


def scan(spark: SparkSession, inputs: Sequence[str], out_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """jobs (COLUMNS) and skipped (source).

    A folder gives its files of known extensions, but for those below out_dir; files that begin with "~$" or a dot
    and other extensions are skipped. A file that is named itself is taken whatever it is called; one that isn't there is a row
    with `missing`. `content` is only read where a plan uses it. `input` and `path` order the jobs.
    """
    jobs, skipped = [], []
    out = os.path.abspath(out_dir) + "/" if out_dir else None
    for k, given in enumerate(inputs):
        if _is_folder(spark, given):
            every = folder_files(spark, given)
            if out:
                every = every.where(~F.concat(F.col("path"), F.lit("/")).startswith(out))
            name = F.substring_index("path", "/", -1)
            known = format_of(suffix(name)).isNotNull() & ~name.startswith("~$") & ~name.startswith(".")
            source = F.concat(F.lit(given.rstrip("/") + "/"), F.col("below"))
            rel = F.regexp_replace(F.col("below"), "/?[^/]*$", "")
            jobs.append(every.where(known).select(F.lit(k).alias("input"), source.alias("source"), "path", rel.alias("rel_dir"), name.alias("name"), "length", "content", F.lit(False).alias("missing")))
            skipped.append(every.where(~known).select(source.alias("source")))
        elif _exists(spark, given):
            one = spark.read.format("binaryFile").load(given)
            if not _length(spark, given):  # Spark passes empty files over
                one = spark.range(1).select(F.lit(given).alias("path"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
            jobs.append(one.select(F.lit(k).alias("input"), F.lit(given).alias("source"), _local(F.col("path")).alias("path"), F.lit("").alias("rel_dir"), F.substring_index("path", "/", -1).alias("name"), "length", "content", F.lit(False).alias("missing")))
        else:
            jobs.append(spark.range(1).select(F.lit(k).alias("input"), F.lit(given).alias("source"), F.lit(given).alias("path"), F.lit("").alias("rel_dir"), F.lit(given.rpartition("/")[2]).alias("name"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("missing")))
    none = spark.createDataFrame([], "source string")
    rows = None
    for j in jobs:
        rows = j if rows is None else rows.unionByName(j)
    for s in skipped:
        none = none.unionByName(s)
    if rows is None:
        return spark.createDataFrame([], COLUMNS), none
    return rows.select("input", "source", "path", "rel_dir", "name", "length", "content", "missing"), none


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _length(spark: SparkSession, path: str) -> int:
    fs, p = _path(spark, path)
    return fs.getFileStatus(p).getLen()


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()
