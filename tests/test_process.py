"""Folders of files, all the way to documents, JSON and grades."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leafmill.operators import documents as D
from leafmill.operators import folders, judge, ocr
from leafmill.operators.ocr import NoEngine, Recognised
from leafmill.operators.units import exploded
from leafmill.plans.process import process, process_to
from leafmill.schema import Options, ReadError
from leafmill.sources.results import read_documents
from leafmill.streaming import folder as stream
from tests import fakes, files

LONG = "a healthy line of text on this page " * 8
PNG = files.png(64, 48)


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    at = tmp_path_factory.mktemp("in")
    pages = [{"blocks": [LONG]}, {"images": [[0, 0, 595, 842]]}, {"blocks": ["" * 200]}, {"crash": 1}, {"w": 1e7, "h": 1e7, "images": [[0, 0, 1e7, 1e7]]}]
    for name, data in {
        "mixed.pdf": fakes.pdf(pages), "fine.pdf": fakes.pdf([{"blocks": [LONG]}]), "locked.pdf": fakes.pdf("locked"), "lost.pdf": fakes.pdf([{"crash": 1}]), "scan.pdf": fakes.pdf([{"images": [[0, 0, 595, 842]]}] * 7),
        "doc.docx": files.docx(PNG), "deck.pptx": files.pptx(PNG), "book.xlsx": files.xlsx(PNG), "page.png": PNG, "bad.png": PNG + b"crash", "two.tif": files.tiff((50, 60), (20000, 9000)), "huge.png": files.png(1, 1)[:16] + b"\0\0\x4e\x20\0\0\x4e\x20" + bytes(30),
        "notes.md": "# Notes\n\n![a](pics/one.png) mid ![b](http://x/y.png) ![c](../out.png) ![d](none.png) end".encode(), "pics/one.png": PNG, "sub/notes.md": b"caf\xe9", "empty.md": b"", "fake.docx": b"no zip", "old.doc": bytes.fromhex("D0CF11E0A1B11AE1"), "readme.bin": b"x", "~$lock.docx": b"x",
    }.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_bytes(data)
    return at


@pytest.fixture(scope="module")
def results(spark, inbox):
    found, skipped = process(spark, [str(inbox), str(inbox / "readme.bin"), "/nowhere/x.pdf"], Options(), fakes.FakeEngine, fakes.FakePdf)
    return {r["source"].removeprefix(f"{inbox}/"): r.asDict(True) for r in found.collect()}, sorted(r["source"].removeprefix(f"{inbox}/") for r in skipped.collect())


STATUS = {
    "mixed.pdf": ("partial", 5), "fine.pdf": ("ok", 1), "locked.pdf": ("error", 0), "lost.pdf": ("error", 0), "scan.pdf": ("ok", 7), "doc.docx": ("ok", 4), "deck.pptx": ("ok", 3), "book.xlsx": ("ok", 3), "page.png": ("ok", 1), "bad.png": ("error", 0), "two.tif": ("partial", 2),
    "huge.png": ("error", 0), "notes.md": ("ok", 3), "pics/one.png": ("ok", 1), "sub/notes.md": ("ok", 1), "empty.md": ("error", 0), "fake.docx": ("error", 0), "old.doc": ("error", 0), "readme.bin": ("error", 0), "/nowhere/x.pdf": ("error", 0),
}


def test_each_file_has_its_status(results):
    got, skipped = results
    assert {k: (v["status"], v["unit_count"]) for k, v in got.items()} == STATUS
    assert skipped == ["readme.bin", "~$lock.docx"]


def test_errors_have_their_type(results):
    got = {k: v["error_type"] for k, v in results[0].items() if v["status"] == "error"}
    assert got == {
        "locked.pdf": "PasswordProtected", "lost.pdf": "KeyError", "bad.png": "RuntimeError", "huge.png": "ImageTooLarge", "empty.md": "EmptyFile", "fake.docx": "CorruptFile", "old.doc": "UnsupportedFormat", "readme.bin": "UnsupportedFormat", "/nowhere/x.pdf": "FileNotFound"
    }


def test_pages_of_a_pdf(results):
    pages = results[0]["mixed.pdf"]["units"]
    assert [(u["origin"], u["status"], u["page"]) for u in pages] == [("native", "ok", 1), ("ocr", "ok", 2), ("ocr", "ok", 3), ("native", "error", 4), ("native", "error", 5)]
    assert pages[1]["reason"] == "no text layer" and pages[1]["text"].startswith("first\n\nFAKE OCR") and pages[1]["render_dpi"] == 200 and len(pages[1]["blocks"]) == 3
    assert pages[2]["text_layer"]["private_use_pct"] == 100 and pages[0]["text_layer"]["words"] == 64 and pages[1]["text_layer"]["words"] is None
    assert pages[4]["error_type"] == "ImageTooLarge" and pages[4]["reason"] == "page could not be processed"
    assert results[0]["mixed.pdf"]["warnings"] == ["2 of 5 units failed; see their error_type and message"]


def test_other_units(results):
    got = results[0]
    assert [u["kind"] for u in got["doc.docx"]["units"]] == ["section", "image", "section", "section"]
    assert got["doc.docx"]["warnings"] == ["skipped word/media/tiny.png: only 8x8 px", "image r9 is not stored in the file and was skipped", "linked (external) image r7 was not fetched"]
    assert [u["index"] for u in got["deck.pptx"]["units"]] == [0, 1, 2] and got["two.tif"]["units"][1]["message"].startswith("image frame 2 is 20000x9000 (180 megapixels)")
    notes = got["notes.md"]
    assert [u["kind"] for u in notes["units"]] == ["section", "image", "section"]
    assert [w.split(":")[0] for w in notes["warnings"]] == ["remote image not fetched (no network calls are made)", "image outside the document's folder was not read", "image file not found"]
    assert got["sub/notes.md"]["units"][0]["warnings"][0].startswith("not valid UTF-8") and got["sub/notes.md"]["units"][0]["text"] == "café"
    assert got["page.png"]["sha256"] and got["page.png"]["tool_versions"]["spark"] and got["page.png"]["timings"]["ocr_seconds"] >= 0
    assert "ocr_engine" not in got["sub/notes.md"]["tool_versions"] and json.loads(got["scan.pdf"]["tool_versions"]["ocr_engine"]) == {"name": "fake"}


def test_without_an_engine_native_files_are_fine(spark, inbox):
    found, _ = process(spark, [str(inbox / "fine.pdf"), str(inbox / "scan.pdf"), str(inbox / "notes.md")], Options(deterministic=True), NoEngine, fakes.FakePdf)
    got = {r["name"]: r for r in found.collect()}
    assert got["fine.pdf"]["status"] == "ok" and got["fine.pdf"]["timings"] is None and got["notes.md"]["status"] == "ok"
    assert got["scan.pdf"]["error_type"] == "ModelUnavailable"


def test_pages_and_force(spark, inbox):
    found, _ = process(spark, [str(inbox / "fine.pdf"), str(inbox / "book.xlsx")], Options(pages="1", force_ocr=True), fakes.FakeEngine, fakes.FakePdf)
    got = {r["name"]: r for r in found.collect()}
    assert got["fine.pdf"]["units"][0]["reason"].startswith("OCR forced") and got["book.xlsx"]["warnings"][0].endswith("ignored for xlsx")


@pytest.fixture(scope="module")
def written(spark, inbox, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    again = tmp_path_factory.mktemp("again")
    (again / "FINE.pdf").write_bytes(fakes.pdf([{"blocks": [LONG]}]))
    found, _ = process_to(spark, [str(inbox), str(again)], str(out), Options(), fakes.FakeEngine, fakes.FakePdf)
    return out, found


def test_written_documents_read_back(spark, written, results):
    out, found = written
    paths = sorted(str(p.relative_to(out)) for p in out.rglob("document.json"))
    assert len(paths) == 19 and "FINE.pdf-2/document.json" in paths and "sub/notes.md/document.json" in paths
    one = json.loads((out / "mixed.pdf/document.json").read_text())
    assert list(one) == ["source", "sha256", "format", "status", "unit_count", "units", "warnings", "timings", "tool_versions", "model_attribution"]
    native, ocr = one["units"][:2]
    assert list(native)[:8] == ["index", "kind", "origin", "status", "reason", "text", "markdown", "warnings"] and "blocks" not in native and "name" not in native
    assert list(ocr)[-4:] == ["render_dpi", "width_px", "height_px", "blocks"] and ocr["render_dpi"] == 200
    bad = json.loads((out / "locked.pdf/document.json").read_text())
    assert bad["error_type"] == "PasswordProtected" and bad["units"] == []
    image = json.loads((out / "page.png/document.json").read_text())["units"][0]
    assert image["render_dpi"] is None and "page" not in image
    back = {r["source"]: r.asDict(True) for r in read_documents(spark, str(out)).collect()}
    for r in found.collect():
        r = r.asDict(True)
        assert {k: back[r["source"]][k] for k in ("status", "sha256", "unit_count", "warnings", "error_type")} == {k: r[k] for k in ("status", "sha256", "unit_count", "warnings", "error_type")}
        assert [u["text"] for u in back[r["source"]]["units"]] == [u["text"] for u in r["units"]]
    n = D.status_counts(found).first()
    assert (n["documents"], n["partial"], n["exit_code"]) == (19, 2, 1)
    assert exploded(found).where("origin = 'ocr'").count() > 10


def test_what_can_not_be_written_is_an_error(spark, inbox, tmp_path):
    (tmp_path / "blocked").write_text("a file, not a folder")
    found, _ = process_to(spark, [str(inbox / "fine.pdf")], str(tmp_path / "blocked"), Options(), fakes.FakeEngine, fakes.FakePdf)
    r = found.first()
    assert (r["status"], r["error_type"], r["unit_count"]) == ("error", "OutputError", 0)


def test_grades(spark, written, inbox):
    docs = read_documents(spark, str(written[0]))
    sampled = judge.sampled(judge.eligible(docs), 3)
    assert sorted(r["page"] for r in sampled.where("pdf_name = 'scan.pdf'").collect()) == [1, 4, 7]
    pdfs = spark.read.format("binaryFile").load(str(inbox)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content").where("path like '%.pdf'")
    pages = judge.judge_pages(judge.with_pdf(sampled, pdfs), fakes.FakeJudge, fakes.FakePdf).cache()
    good = pages.where("error_message is null").collect()
    assert len(good) == 5 and all(r["character_accuracy_percent"] == 100 and r["llm_verdict"] == "good" and r["misread_text"][0]["ocr_text_says"] == "a" for r in good)
    r = json.loads(judge.report(docs, pages, "fake"))
    assert r["overall_summary"]["number_of_pages_judged"] == 5 and r["overall_summary"]["average_llm_quality_rating_out_of_10"] == 9 and r["overall_summary"]["number_of_pages_with_wrong_reading_order"] == 5
    of = {p["pdf_name"]: p for p in r["pdfs"]}
    assert of["fine.pdf"]["error_message"].startswith("no OCR pages") and of["scan.pdf"]["total_ocr_pages_in_pdf"] == 7 and len(of["scan.pdf"]["judged_pages"]) == 3
    assert of["scan.pdf"]["number_of_pages_per_llm_verdict"] == {"good": 3, "acceptable": 0, "poor": 0} and "number_of_pages_judged" not in of["scan.pdf"]
    lost = judge.judge_pages(judge.with_pdf(sampled, pdfs.limit(0)), fakes.FakeJudge, fakes.FakePdf).cache()
    assert all("source PDF not found" in r["error_message"] for r in lost.collect())
    r = json.loads(judge.report(docs, lost, "fake", files=pdfs.limit(0)))
    assert r["overall_summary"] == {"number_of_pdfs_judged": 0, "number_of_pages_judged": 0}
    assert all(p["error_message"] == judge.NO_PDF and not p["judged_pages"] for p in r["pdfs"]) and len(r["pdfs"]) > 1


def test_one_engine_at_a_time():
    closed = []

    class Engine(fakes.FakeEngine):
        def close(self):
            closed.append(self)

    first, _ = ocr.engine("a", Engine)
    assert ocr.engine("a", Engine) == (first, 0.0) and not closed
    second, _ = ocr.engine("b", Engine)
    assert closed == [first] and second is not first
    with pytest.raises(ReadError):
        ocr.engine("c", NoEngine)
    assert closed == [first, second]


def test_pdfs_by_path_then_by_name(spark):
    files = spark.createDataFrame([("/a/x.pdf", b"1"), ("/b/x.pdf", b"2"), ("/c/y.pdf", b"3"), ("/c/z.pdf", b"4")], "path string, content binary")
    pages = spark.createDataFrame([("/b/x.pdf", 1), ("/b/x.pdf", 2), ("/q/x.pdf", 1), ("/q/y.pdf", 1), ("/q/none.pdf", 1), (None, 1)], "source string, page int")
    found = judge.with_pdf(pages, files)
    got = sorted((r["source"] or "", r["page"], r["pdf"] and bytes(r["pdf"])) for r in found.collect())
    assert got == [("", 1, None), ("/b/x.pdf", 1, b"2"), ("/b/x.pdf", 2, b"2"), ("/q/none.pdf", 1, None), ("/q/x.pdf", 1, b"1"), ("/q/y.pdf", 1, b"3")]
    assert found.columns == ["source", "page", "pdf"]


def test_stream(spark, inbox, tmp_path):
    out, point = str(tmp_path / "table"), str(tmp_path / "point")
    for expected in (17, 17):  # what has been taken isn't taken again; empty files don't arrive
        stream.ingest(spark, str(inbox), out, point, engine=fakes.FakeEngine, backend=fakes.FakePdf, files_at_once=5).awaitTermination()
        assert spark.read.parquet(out).count() == expected
    (inbox / "zz-copy.png").write_bytes(PNG)
    try:
        stream.ingest(spark, str(inbox), out, point, engine=fakes.FakeEngine, backend=fakes.FakePdf).awaitTermination()
        assert spark.read.parquet(out).count() == 18
    finally:
        (inbox / "zz-copy.png").unlink()


def test_stream_takes_first_copies(spark, inbox, tmp_path):
    stream.ingest(spark, str(inbox), str(tmp_path / "t"), str(tmp_path / "p"), engine=fakes.FakeEngine, backend=fakes.FakePdf, dedupe=True).awaitTermination()
    rows = [r["sha256"] for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert len(rows) == len(set(rows)) == 16  # page.png and pics/one.png are copies


def test_folder_names(spark):
    rows = [(0, "/a", "", "x.pdf"), (1, "/b", "", "X.pdf"), (2, "/c", "", "x.pdf-2"), (3, "/d", "", "x.pdf"), (0, "/e", "s", "x.pdf")]
    got = folders.with_folders(spark.createDataFrame(rows, "input int, path string, rel_dir string, name string"), "/o/").orderBy("path").collect()
    assert [r["folder"] for r in got] == ["/o/x.pdf", "/o/X.pdf-2", "/o/x.pdf-2-2", "/o/x.pdf-3", "/o/s/x.pdf"] and got[0]["folder_note"] is None and got[1]["folder_note"].endswith("written to X.pdf-2 instead")


def test_numbers(spark):
    got = folders.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), "k").collect()
    assert sorted((r["k"], r["n"], r["of"]) for r in got) == [(k, k + 1, 1000) for k in range(1000)]
    assert folders.numbered(spark.range(0), "id").count() == 0


def test_capped_blocks_become_a_warning():
    assert Recognised(1, 1, [], "", ["a"], capped=2, most_tokens=512).said() == ["a", "2 block(s) reached the 512-token limit; their text may be cut off"]
    assert Recognised(1, 1, [], "", ["a"]).said() == ["a"]


def test_an_engine_stays_off_the_network(monkeypatch):
    for name in (*ocr.OFFLINE, *ocr.QUIET):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("TRANSFORMERS_OFFLINE", "0")
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    seen = {}

    class Looks(fakes.FakeEngine):
        def __init__(self):
            seen.update(os.environ)

    ocr.engine("offline test", Looks)
    assert (seen["HF_HUB_OFFLINE"], seen["TRANSFORMERS_OFFLINE"], seen["TOKENIZERS_PARALLELISM"], seen["TRANSFORMERS_VERBOSITY"]) == ("1", "1", "true", "error")
    ocr._made.clear()


def test_counts_are_told_once_files_are_read(spark, inbox, tmp_path):
    told = []
    found, _ = process_to(spark, [str(inbox / "fine.pdf"), str(inbox / "scan.pdf"), "/nowhere/x.pdf"], str(tmp_path / "out"), Options(), fakes.FakeEngine, fakes.FakePdf, told.append)
    units = found.agg({"unit_count": "sum"}).first()[0]
    assert len(told) == 1 and told[0]["documents"] == 3 and told[0]["error"] == 1 and told[0]["units"] == units and 0 < told[0]["ocr_units"] < units


def test_results_are_listed_by_tasks(spark, tmp_path):
    for k in range(30):
        at = tmp_path / ("a" if k % 2 else "b/c d") / f"{k}.md"
        at.mkdir(parents=True)
        (at / "document.json").write_text(json.dumps({"source": f"s{k}", "unit_count": k, "units": [], "more": 1}))
        (at / "other.json").write_text("{}")
    for hidden in (".x", "_x"):
        (tmp_path / hidden).mkdir()
        (tmp_path / hidden / "document.json").write_text("{}")
    back = read_documents(spark, str(tmp_path))
    assert not list(back.inputFiles())  # the driver knows of no file
    assert sorted((r["source"], r["unit_count"], r["folder"].rpartition("/")[2]) for r in back.collect()) == sorted((f"s{k}", k, f"{k}.md") for k in range(30))


def test_a_judge_costs_one_ocr_run(spark):
    from leafmill.plans.flow_queries import judge_scans
    from tests.conftest import SMALL

    plan = judge_scans(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [run(c_custkey") == 1 and "_office" not in plan  # the PDFs are made for the judge, and not read for OCR again
