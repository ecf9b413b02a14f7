"""Grades by a judge that is plugged in: which pages, what it is asked, and what its replies come to."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import judging
from leafmill.functions.fence import fence
from leafmill.functions.pages import is_sampled
from leafmill.operators.extract import Backend
from leafmill.schema import as_error
from leafmill.session import cut
from leafmill.sources import pdf

# Fixed value: what is said where a PDF has no page to judge, or isn't there.
NO_PDF, NO_PAGES = "source PDF not found; pass --pdfs", "no OCR pages in this document (text layer was used); nothing to judge"
HOW_TO_READ = (
    "A judge looked at the picture of each sampled OCR page, wrote down what it says and graded the OCR text. Ratings go from 1 to 10. Accuracies are 100 less the error rate "
    "against the judge's own transcription, so they say how far the two agree, not how far either is right."
)


@dataclass
class Reply:
    text: str
    tokens_in: int = 0
    tokens_out: int = 0
    cut_short: bool = False


class Judge(Protocol):
    def ask(self, prompt: str, png: bytes) -> Reply: ...


def pdf_name(documents: DataFrame) -> Column:
    """What the report calls a document: the last part of its results' folder, of rows without one that of its source."""
    return F.substring_index("folder" if "folder" in documents.columns else "source", "/", -1)


def eligible(documents: DataFrame) -> DataFrame:
    """A row for each page from OCR that is ok, of PDFs that are: source, pdf_name, page, text, position (from 0), n."""
    ocr = F.filter("units", lambda u: (u["origin"] == "ocr") & (u["status"] == "ok") & (F.coalesce(u["page"], F.lit(0)) > 0))
    some = documents.where("format = 'pdf' and status <> 'error'").withColumn("__pages", ocr).withColumn("__name", pdf_name(documents))
    return some.select("source", "__name", F.size("__pages").alias("n"), F.posexplode("__pages").alias("position", "u")).select("source", F.col("__name").alias("pdf_name"), F.col("u.page").alias("page"), F.col("u.text").alias("text"), "position", "n")


def sampled(pages: DataFrame, k: int = 3) -> DataFrame:
    """Up to k pages of each document, evenly spread. pages: of eligible()."""
    return pages.where(is_sampled(F.col("position"), F.col("n"), k))


def sampled_rows(rows: DataFrame, key: str, order: Column, k: int = 3) -> DataFrame:
    """sampled() where pages are rows without positions: adds position and n by a window over the key."""
    by = Window.partitionBy(key)
    placed = rows.withColumn("position", F.row_number().over(by.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    return sampled(placed, k)


def source_pdf(recorded: Column, in_folder: Column) -> Column:
    """The recorded path if it is there, else the file of the same name in the folder of PDFs, else null."""
    return F.coalesce(recorded, in_folder)


def located(documents: DataFrame, files: DataFrame) -> DataFrame:
    """source and pdf_path, where each document's PDF is: at its path, else the first of that name, else null. files: path; no content is read."""
    paths = files.select(F.col("path").alias("__path")).distinct()
    named = paths.groupBy(F.substring_index("__path", "/", -1).alias("__name")).agg(F.min("__path").alias("__first"))
    sources = documents.select("source").distinct()
    out = sources.join(paths, F.col("source") == F.col("__path"), "left").join(named, F.substring_index("source", "/", -1) == F.col("__name"), "left")
    return out.select("source", source_pdf(F.col("__path"), F.col("__first")).alias("pdf_path"))


def with_pdf(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `pdf`, the content of each page's source, by located(). files: path, content.

    Paths are settled first; contents come last, and only of files that pages were sampled from.
    """
    pages = cut(pages)  # they are read three times below, and cost an OCR run each time
    where = located(pages, files)
    wanted = files.select(F.col("path").alias("pdf_path"), F.col("content").alias("pdf")).join(where.select("pdf_path").distinct(), "pdf_path", "left_semi")
    return pages.join(where, "source", "left").join(wanted, "pdf_path", "left").drop("pdf_path")


ASKED = pa.struct([("reply", pa.string()), ("seconds", pa.float64()), ("tokens_in", pa.int64()), ("tokens_out", pa.int64()), ("error", pa.string())])


def _stage(factory: Callable[[], Judge], backend: Backend):
    def run(content: pa.Array, page: pa.Array, prompt: pa.Array) -> pa.Array:
        judge, out = None, []
        held, opened = None, ExitStack()  # the PDF of the row before, which often is that of this row too
        for c, n, p in zip(content, page, prompt):
            row = {"reply": None, "seconds": None, "tokens_in": None, "tokens_out": None, "error": None}
            if not c.is_valid:
                out.append(row | {"error": NO_PDF})
                continue
            began = time.perf_counter()
            try:
                judge = judge or factory()
                if held is None or held != c.as_py():
                    held = None
                    opened.close()
                    doc = opened.enter_context(backend().open(c.as_py()))
                    held = c.as_py()
                size = doc.page(n.as_py())
                longest = max(size.width, size.height) / 72
                png = doc.render(n.as_py(), max(50, min(200, int(1568 / longest))))
                began = time.perf_counter()
                got = judge.ask(p.as_py(), png)
                if got.cut_short:
                    raise ValueError("the judge's reply was cut off")
                row |= {"reply": got.text, "tokens_in": got.tokens_in, "tokens_out": got.tokens_out}
            except Exception as e:  # a page must not stop the others
                kind, message = as_error(e)
                row["error"] = f"{kind}: {message[:200]}"
            out.append(row | {"seconds": round(time.perf_counter() - began, 2)})
        opened.close()
        return pa.array(out, ASKED)

    return F.arrow_udf(run, "struct<reply:string,seconds:double,tokens_in:bigint,tokens_out:bigint,error:string>")


def graded(pages: DataFrame) -> DataFrame:
    """Figures of pages that have `reply` and `text`: adds the columns of judging.page_figures() and error_message."""
    told = pages.withColumn("__reply", judging.parsed(F.col("reply")))
    missing = F.when(F.col("reply").isNotNull() & judging.json_part(F.col("reply")).isNull(), F.lit("ValueError: no JSON object in the judge's reply"))
    broken = F.when(F.col("reply").isNotNull() & F.col("__reply").isNull(), F.lit("JSONDecodeError: the judge's reply can't be read"))
    had = F.col("error_message") if "error_message" in pages.columns else F.lit(None).cast("string")
    out = told.withColumn("error_message", F.coalesce(had, missing, broken))
    figures = judging.page_figures(F.col("__reply"), F.col("text"))
    return out.withColumns({k: F.when(F.col("error_message").isNull(), c) for k, c in figures.items()}).drop("__reply")


def judge_pages(pages: DataFrame, factory: Callable[[], Judge], backend: Backend = pdf.default) -> DataFrame:
    """Asks the judge about each page (with pdf, page and text) and grades the replies."""
    asked = pages.withColumn("__asked", fence(_stage(factory, backend)(F.col("pdf"), F.col("page"), judging.prompt(F.col("text")))))
    told = asked.withColumns({
        "reply": F.col("__asked.reply"), "error_message": F.col("__asked.error"), "llm_call_latency_seconds": F.col("__asked.seconds"),
        "llm_input_tokens": F.col("__asked.tokens_in"), "llm_output_tokens": F.col("__asked.tokens_out"),
    }).drop("__asked", "pdf")
    return graded(told)


def summaries(pages: DataFrame, key: str = "source") -> DataFrame:
    """judging.summary() of the pages without an error, for each document and (key null, is_overall true) for all pages together."""
    good = pages.where(F.col("error_message").isNull()) if "error_message" in pages.columns else pages
    return good.rollup(key).agg(*judging.summary(), (F.grouping(key) == 1).alias("is_overall"))


def _figures(row: dict) -> dict:
    """A summary as the report has it: verdicts in an object of their own."""
    told = {"number_of_pages_per_llm_verdict": {v: row[f"number_of_pages_{v}"] for v in judging.VERDICTS}}
    return {c: v for c, v in row.items() if c not in ("source", "is_overall", "number_of_pages_judged", *(f"number_of_pages_{v}" for v in judging.VERDICTS))} | told


def report(documents: DataFrame, pages: DataFrame, model: str, k: int = 3, files: DataFrame | None = None) -> str:
    """The report as JSON. It holds only sampled pages, k for each PDF, which someone is going to read.

    files: path of the PDFs that are there, so that a missing one is told of documents without OCR pages as well.
    A document whose PDF is missing has no judged pages.
    """
    of, missing = {}, set()
    for r in pages.orderBy("source", "page").toLocalIterator():
        d = r.asDict(recursive=True)
        source = d.pop("source")
        if d["error_message"] == NO_PDF:
            missing.add(source)
        else:
            of.setdefault(source, []).append({"page_number": d.pop("page"), **{c: v for c, v in d.items() if c not in ("pdf_name", "position", "n", "text", "reply") and (v is not None or c != "error_message")}})
    sums = {(r["source"], r["is_overall"]): r.asDict() for r in summaries(pages).collect()}
    counted = F.size(F.filter("units", lambda u: (u["origin"] == "ocr") & (u["status"] == "ok") & (F.coalesce(u["page"], F.lit(0)) > 0))).alias("n")
    read = documents.where("format = 'pdf' and status <> 'error'").select("source", pdf_name(documents).alias("name"), counted)
    read = read.withColumn("lost", F.lit(False)) if files is None else read.join(located(read, files), "source", "left").withColumn("lost", F.col("pdf_path").isNull())
    pdfs, judged = [], 0
    for r in read.orderBy("source", "name").toLocalIterator():
        entry = {"pdf_name": r["name"], "source_pdf_path": r["source"], "total_ocr_pages_in_pdf": r["n"], "judged_pages": of.get(r["source"], [])}
        if r["lost"] or r["source"] in missing:
            entry["error_message"] = NO_PDF
        elif not r["n"]:
            entry["error_message"] = NO_PAGES
        if own := sums.get((r["source"], False)):
            entry |= _figures(own)
            judged += 1
        pdfs.append(entry)
    whole = sums.get((None, True), {"number_of_pages_judged": 0})
    overall = {"number_of_pdfs_judged": judged, "number_of_pages_judged": whole["number_of_pages_judged"]} | (_figures(whole) if whole["number_of_pages_judged"] else {})
    return json.dumps({"how_to_read": HOW_TO_READ, "judge_model_name": model, "max_pages_judged_per_pdf": k, "overall_summary": overall, "pdfs": pdfs}, ensure_ascii=False, indent=2)
