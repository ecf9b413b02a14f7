"""python -m leafmill process | doctor | evaluate | judge"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from importlib import import_module

from leafmill.functions.pages import parse_pages
from leafmill.schema import Options


def pages(text: str) -> str:
    try:
        parse_pages(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None
    return text


def dpi(text: str) -> int:
    if not text.isdigit() or not 50 <= int(text) <= 600:
        raise argparse.ArgumentTypeError(f"--dpi must be a whole number from 50 to 600, got {text!r}")
    return int(text)


def plugged(text: str):
    """What module:name stands for."""
    module, _, name = text.partition(":")
    return getattr(import_module(module), name)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="leafmill", description="Documents in, tables and JSON out.")
    out.add_argument("--version", action="store_true", help="print the version")
    sub = out.add_subparsers(dest="command")
    p = sub.add_parser("process", help="one document.json for each document")
    p.add_argument("inputs", nargs="*", default=["input"], metavar="path", help="files or folders (default: ./input)")
    p.add_argument("--out", default="output/ocr_output", help="one folder below it for each document")
    p.add_argument("--dpi", type=dpi, default=200, help="resolution of PDF pages for OCR, 50-600 (default 200)")
    p.add_argument("--force-ocr", action="store_true", help="OCR every PDF page")
    p.add_argument("--pages", type=pages, help="PDF pages or TIFF frames, like 1-5,8")
    p.add_argument("--table-format", choices=["html", "markdown"], default="html")
    p.add_argument("--max-megapixels", type=float, default=100.0)
    p.add_argument("--deterministic", action="store_true", help="no timings in the output")
    p.add_argument("--engine", type=plugged, help="the OCR engine's factory, module:name")
    d = sub.add_parser("doctor", help="what is installed and what is missing")
    for x in (p, d):
        x.add_argument("--device", choices=["auto", "cpu", "cuda"], default="auto")
        x.add_argument("--model-dir")
    e = sub.add_parser("evaluate", help="error rates and review flags of a document.json")
    e.add_argument("document_json")
    e.add_argument("--reference", required=True, help="the true text, UTF-8")
    j = sub.add_parser("judge", help="grades for sampled OCR pages by a judge that is plugged in")
    j.add_argument("output_dir", nargs="?", default="output/ocr_output")
    j.add_argument("--report-dir", default="output/judge_output")
    j.add_argument("--pdfs", default="input")
    j.add_argument("--pages-per-pdf", type=int, default=3)
    j.add_argument("--model", type=plugged, required=True, help="the judge's factory, module:name")
    return out


def options_of(a: argparse.Namespace) -> Options:
    if a.command != "process":
        return Options(device=a.device, model_dir=a.model_dir)
    return Options(dpi=a.dpi, force_ocr=a.force_ocr, pages=a.pages, table_format=a.table_format, device=a.device, model_dir=a.model_dir, max_pixels=int(a.max_megapixels * 1_000_000), deterministic=a.deterministic)


def _session():
    from leafmill.session import local_session, show_package_to_workers

    spark = local_session(os.cpu_count() or 1)
    show_package_to_workers(spark)
    return spark


def run_process(a: argparse.Namespace, say=print) -> int:
    from pyspark.sql import functions as F

    from leafmill.operators import documents as D
    from leafmill.operators.ocr import NoEngine
    from leafmill.plans.process import process_to

    began = time.monotonic()

    def stamped(what: str) -> None:
        passed = int(time.monotonic() - began)
        print(f"[{passed // 60:02d}:{passed % 60:02d}] {what}", file=sys.stderr)

    found, skipped = process_to(_session(), a.inputs, a.out, options_of(a), a.engine or NoEngine, on_read=lambda n: stamped(f"read {n['documents']} file(s), {n['units']} unit(s), {n['ocr_units']} of them by OCR"))
    line = D.summary_line(D.origin_counts(F.col("units")), F.col("timings.total_seconds"), F.col("status"), F.col("error_type"), F.col("message"))
    for r in found.orderBy("input", "path").select("status", "source", "folder", line.alias("said")).toLocalIterator():
        say(f"{r['status']:<8} {r['source']}  ->  {r['folder']}  {r['said']}")
    for r in skipped.orderBy("source").toLocalIterator():
        print(f"skipped  {r['source']}  (unsupported file type)", file=sys.stderr)
    n = D.status_counts(found).first()
    stamped("done")
    say(f"{n['documents']} document(s): {n['ok']} ok, {n['partial']} partial, {n['error']} error. Output: {a.out}")
    return n["exit_code"]


def run_evaluate(a: argparse.Namespace, say=print) -> int:
    from pyspark.sql import functions as F

    from leafmill.operators.evaluate import evaluate
    from leafmill.schema import DOCUMENT

    spark = _session()
    documents = spark.read.schema(DOCUMENT).option("multiLine", "true").json(a.document_json)
    text = spark.read.text(a.reference, wholetext=True).select(F.col("value").alias("reference"))
    references = documents.select("source").crossJoin(F.broadcast(text))  # one document, one text
    say(json.dumps(json.loads(evaluate(documents, references).toJSON().first()), ensure_ascii=False, indent=2))
    return 0


def run_judge(a: argparse.Namespace, say=print) -> int:
    from leafmill.operators import judge
    from leafmill.session import cut
    from leafmill.sources import inputs, results

    spark = _session()
    documents = results.read_documents(spark, a.output_dir)
    sampled = judge.sampled(judge.eligible(documents), a.pages_per_pdf)
    files = inputs.folder_files(spark, a.pdfs).select("path", "content").where("lower(path) like '%.pdf'")
    pages = cut(judge.judge_pages(judge.with_pdf(sampled, files), a.model))  # each page is asked about once
    os.makedirs(a.report_dir, exist_ok=True)
    at = os.path.join(a.report_dir, "judge_report.json")
    with open(at, "w", encoding="utf-8") as f:
        f.write(judge.report(documents, pages, getattr(a.model, "__name__", "judge"), a.pages_per_pdf, files))
    say(f"report: {at}")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.version or not a.command:
        from leafmill.plans.process import VERSION

        print(f"leafmill {VERSION}") if a.version else p.print_help()
        return 0 if a.version else 2
    if a.command == "doctor":
        from leafmill import doctor

        return doctor.run(options_of(a))
    return {"process": run_process, "evaluate": run_evaluate, "judge": run_judge}[a.command](a)


if __name__ == "__main__":
    raise SystemExit(main())
