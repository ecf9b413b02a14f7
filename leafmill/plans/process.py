"""From files to documents: scan, detect, read, route, recognise, roll up. One row a document all the way."""

from __future__ import annotations

import platform
from collections.abc import Callable, Sequence
from importlib import metadata

import pyspark
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import sniffing
from leafmill.functions.fence import fence
from leafmill.operators import documents as D
from leafmill.operators import extract, ocr, units
from leafmill.operators.folders import with_folders
from leafmill.schema import DOCUMENT, Options
from leafmill.sources import inputs, pdf
from leafmill.sources.results import write_documents

VERSION = "0.1.0"
#: Libraries that read a format, where they are installed.
LIBRARIES = {"pdf": ["PyMuPDF"], "png": ["Pillow"], "jpeg": ["Pillow"], "tiff": ["Pillow"], "bmp": ["Pillow"], "webp": ["Pillow"]}


def version_of(name: str) -> str | None:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return None


def versions(fmt: Column) -> Column:
    """A map of what took part, by format."""
    base = {"leafmill": VERSION, "python": platform.python_version(), "spark": pyspark.__version__}
    entries = lambda more: F.create_map(*(F.lit(x) for k, v in (base | more).items() for x in (k, v)))
    out = None
    for k, names in LIBRARIES.items():
        with_libs = entries({n: v for n in names if (v := version_of(n))})
        out = F.when(fmt == k, with_libs) if out is None else out.when(fmt == k, with_libs)
    return out.otherwise(entries({}))


def detected(jobs: DataFrame) -> DataFrame:
    """Adds sha256, format, error_type, message and warnings of detection. jobs: as by inputs.scan()."""
    told = jobs.withColumn("__magic", fence(sniffing.sniff(F.col("content")))).withColumn("__office", sniffing.office_kind(F.col("content"), F.col("__magic")))
    told = told.withColumn("__is", fence(sniffing.detect(F.col("name"), F.col("length"), F.col("__magic"), F.col("__office"))))
    gone = F.col("missing")
    return told.select(
        *jobs.columns,
        F.when(~gone, F.sha2("content", 256)).alias("sha256"),
        F.when(~gone, F.col("__is.format")).alias("format"),
        F.when(gone, F.lit("FileNotFound")).otherwise(F.col("__is.error_type")).alias("error_type"),
        F.when(gone, F.concat(F.lit("file not found: "), "path")).otherwise(F.col("__is.message")).alias("message"),
        F.when(gone, F.array().cast("array<string>")).otherwise(F.col("__is.warnings")).alias("warnings"),
    )


def documents_of(jobs: DataFrame, options: Options = Options(), engine: Callable = ocr.NoEngine, backend: extract.Backend = pdf.default, files: DataFrame | None = None, attribution: str = "") -> DataFrame:
    """Documents by schema.DOCUMENT, with input, path, rel_dir and name, of jobs as by inputs.scan().

    Any failure is columns: of the file, of a unit, or of a page. files: path and content of what Markdown may link to.
    """
    read = extract.extract(detected(jobs), options, backend, files)
    told = ocr.recognise(units.with_units(read, options), engine, backend)
    told = told.withColumn("__out", fence(D.outcome(F.col("units")))).withColumn("__error", F.coalesce("error_type", "read.error_type"))
    fine = F.col("__error").isNull()
    none = F.array().cast("array<string>")
    noted = F.coalesce(extract.page_note(F.col("format"), options), F.lit(None).cast("string"))
    warnings = F.array_compact(F.concat("warnings", F.array(noted), F.when(fine, F.coalesce("notes", none)).otherwise(none), F.array(F.when(fine, F.col("__out.warning")))))
    timings = F.struct(
        F.bround(F.coalesce("read.seconds", F.lit(0.0)) + F.col("ocr_seconds") + F.col("load_seconds"), 2).alias("total_seconds"), F.col("ocr_seconds"), F.col("load_seconds").alias("model_load_seconds"), F.col("read.rss_mb").alias("peak_rss_mb")
    )
    kept = F.when(fine, F.col("__out.units")).otherwise(F.slice("units", 1, 0))
    kept = F.transform(kept, lambda u: u.withField("seconds", F.lit(None).cast("double"))) if options.deterministic else kept
    took_part = versions(F.col("format"))
    took_part = F.when(F.col("ocr_engine").isNotNull(), F.map_concat(took_part, F.create_map(F.lit("ocr_engine"), F.col("ocr_engine")))).otherwise(took_part)
    out = told.select(
        "input", "path", "rel_dir", "name", "source", "sha256", "format",
        F.when(fine, F.col("__out.status")).otherwise("error").alias("status"),
        F.coalesce("__error", "__out.error_type").alias("error_type"),
        F.when(fine, F.col("__out.message")).otherwise(F.coalesce("message", "read.message", F.lit(""))).alias("message"),
        F.size(kept).alias("unit_count"), kept.alias("units"), warnings.alias("warnings"),
        (F.lit(None) if options.deterministic else timings).alias("timings"),
        took_part.alias("tool_versions"), F.lit(attribution).alias("model_attribution"),
    )
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: f.dataType for f in _parse_datatype_string(DOCUMENT).fields}
    return out.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in out.columns))


def process(spark: SparkSession, paths: Sequence[str], options: Options = Options(), engine: Callable = ocr.NoEngine, backend: extract.Backend = pdf.default, out_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """documents and skipped of some files and folders. With out_dir, documents have folder, and what lies in it is no input."""
    jobs, skipped = inputs.scan(spark, paths, out_dir)
    files = None
    for p in paths:
        if inputs._is_folder(spark, p):
            more = inputs.folder_files(spark, p).select("path", "content")
            files = more if files is None else files.unionByName(more)
    out = documents_of(jobs, options, engine, backend, files)
    if out_dir:
        out = with_folders(out, out_dir)
        out = out.withColumn("warnings", F.array_compact(F.concat("warnings", F.array("folder_note")))).drop("folder_note")
    return out, skipped


def observed(documents: DataFrame, told: Observation) -> DataFrame:
    """The same documents; told.get has the counts of what an action made of them: documents, ok, partial, error, units and ocr_units.

    Tasks add the counts up while they work, so nothing is read again and no document comes to the driver.
    """
    of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "error")]
    by_origin = of(F.size(F.filter("units", lambda u: u["origin"] == "ocr"))).alias("ocr_units")
    return documents.observe(told, F.count(F.lit(1)).alias("documents"), *by_status, of("unit_count").alias("units"), by_origin)


def process_to(spark: SparkSession, paths: Sequence[str], out_dir: str, options: Options = Options(), engine: Callable = ocr.NoEngine, backend: extract.Backend = pdf.default, on_read: Callable[[dict], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """process(), written: documents with `folder`, whose status is an OutputError where document.json couldn't be written.

    on_read is called with the counts of observed() once all files are read, before they are written.
    """
    from leafmill.session import cut

    found, skipped = process(spark, paths, options, engine, backend, out_dir)
    if on_read:
        told = Observation()
        found = cut(observed(found, told))
        on_read(told.get)
    else:
        found = cut(found)  # read, recognised and written once
    wrote = cut(write_documents(found))
    bad = F.col("write_error").isNotNull()
    told = found.join(wrote.where(bad), "folder", "left")
    return told.withColumns({
        "status": F.when(bad, "error").otherwise(F.col("status")), "error_type": F.when(bad, "OutputError").otherwise(F.col("error_type")), "message": F.coalesce("write_error", "message"),
        "units": F.when(bad, F.slice("units", 1, 0)).otherwise(F.col("units")), "unit_count": F.when(bad, 0).otherwise(F.col("unit_count")),
    }).drop("write_error"), skipped
