"""Readers of single files, without Spark."""

import pytest

from leafmill.schema import ReadError
from leafmill.sources import docx, images, legacy, markdown, pdf, pptx, xlsx
from tests import fakes, files

PNG = files.png(64, 48)


def kinds(found):
    return [(i["what"], i.get("kind")) for i in found]


def test_docx():
    found = docx.read(files.docx(PNG))
    assert kinds(found) == [("unit", "section"), ("image", "image"), ("unit", "section"), ("image", "image"), ("note", None), ("note", None), ("unit", "section")]
    first = found[0]
    assert first["markdown"] == "# Title\n\n## Section\n\nPlain text\n\n- Point\n\nIn a control\n\n| a<br>b\\|c | d |\n| --- | --- |\n| e |  |\n\nbefore\ttab"
    assert first["text"] == "Title\nSection\nPlain text\nPoint\nIn a control\na b|c\td\ne\t\nbefore\ttab"
    assert found[1]["reason"] == "image embedded in DOCX (/word/media/i.png)" and (found[1]["width_px"], found[1]["height_px"]) == (64, 48)
    assert found[2]["text"] == "after" and found[6]["text"] == "end"
    assert found[4]["message"] == "image r9 is not stored in the file and was skipped" and found[5]["message"] == "linked (external) image r7 was not fetched"


def test_pptx():
    found = pptx.read(files.pptx(PNG))
    assert kinds(found) == [("unit", "page"), ("image", "image"), ("note", None), ("unit", "page")]
    assert found[0]["page"] == 1 and found[0]["markdown"] == "## Heading\n\n| h1 | h2 |\n| --- | --- |\n| x |  |" and found[0]["text"] == "## Heading\n| h1 | h2 |\n| --- | --- |\n| x |  |"
    assert found[1]["reason"] == "picture on slide 1 (ppt/media/p.png)" and found[1]["page"] == 1
    assert found[2]["message"] == "slide 1: picture i9 is not stored in the file" and found[3]["text"] == "grouped" and found[3]["page"] == 2


def test_xlsx():
    found = xlsx.read(files.xlsx(PNG))
    assert kinds(found) == [("unit", "sheet"), ("image", "image"), ("unit", "sheet")]
    sheet = found[0]
    assert sheet["text"] == "Item\tQuantity\t\t\t\n3\t2.5\t7\t\t\n\t\t\t\t\nTRUE\t2024-02-29\t2024-02-29 12:00:00\t#DIV/0!\t06:00:00\ninline\t\t\t\t"
    assert sheet["reason"] == "worksheet, 5 rows x 5 columns, cached values read directly" and sheet["markdown"].startswith("## Sales\n\n| Item | Quantity |")
    assert sheet["warnings"] == ["1 formula cell(s) have no cached value (workbook was never calculated in Excel); shown empty: D2"]
    assert found[1]["reason"] == "image embedded in sheet 'Sales' at row 3, column 1" and found[1]["name"] == "Sales: image 1"
    assert found[2]["markdown"] == "## Empty\n\n_(empty sheet)_" and found[2]["warnings"] == ["sheet is hidden"]


@pytest.mark.parametrize("code, want", [("General", False), ("0.00", False), ("yyyy-mm-dd", True), ('0 "days"', False), ("[Red]0", False), ("[h]:mm", True), ("[hh]:mm:ss", True), ("\\d0", False), ("#,##0;[Red]d", False)])
def test_date_formats(code, want):
    assert xlsx.is_date(code) == want


@pytest.mark.parametrize("read", [docx.read, pptx.read, xlsx.read])
@pytest.mark.parametrize("data", [b"PK\x03\x04 no zip", files.zipped({"x": "y"}), files.zipped({"word/document.xml": "<a", "xl/workbook.xml": "<a", "ppt/presentation.xml": "<a"}), files.zipped({"word/document.xml": "<!DOCTYPE x><a/>", "xl/workbook.xml": "<!DOCTYPE x><a/>", "ppt/presentation.xml": "<!DOCTYPE x><a/>"})])
def test_broken_packages(read, data):
    with pytest.raises(ReadError) as e:
        read(data)
    assert e.value.kind == "CorruptFile"


def test_image_sizes():
    assert images.frames(PNG) == [(64, 48)] and images.frames(files.jpeg(30, 20)) == [(30, 20)] and images.frames(files.tiff((5, 6), (7, 8))) == [(5, 6), (7, 8)]
    assert images.frames(b"GIF89a\x03\0\x04\0") == [(3, 4)] and images.frames(b"BM" + bytes(12) + b"\x28\0\0\0" + b"\x09\0\0\0\xf8\xff\xff\xff") == [(9, 8)]
    assert images.frames(b"RIFF0000WEBPVP8X" + bytes(8) + b"\x09\0\0\x13\0\0") == [(10, 20)]
    for bad in (b"junk", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xd9", b"II*\0\0\0\0\0"):
        with pytest.raises(ReadError):
            images.frames(bad)


def test_image_files():
    one, two = images.read(PNG, [(7, 7)]), images.read(files.tiff((5, 6), (7, 8), (9, 9)), [(2, None)])
    assert [(i["kind"], i["page"], i["frame"]) for i in one + two] == [("image", None, 0), ("page", 2, 1), ("page", 3, 2)]
    assert images.read(files.tiff((5, 6), (7, 8)), [(9, 9)], "9")[0]["message"] == "--pages '9' selected no frame of this image"


def test_markdown():
    found = markdown.read("# a\n\n![x](i.png)\n\nend ![y](gone.png)", ["guessed"], {"i.png": PNG}, {"i.png": None, "gone.png": "image file not found: gone.png"})
    assert kinds(found) == [("unit", "section"), ("image", "image"), ("note", None), ("unit", "section")]
    assert found[0]["text"] == "# a\n\n" and found[0]["warnings"] == ["guessed"] and found[3]["text"] == "\n\nend ![y](gone.png)" and found[3]["warnings"] == []
    assert markdown.read("", ["w"], {}, {}) == [{"what": "unit", "kind": "section", "reason": markdown.REASON, "text": "", "markdown": "", "warnings": ["w"]}]


def test_pdf():
    found = pdf.read(fakes.pdf([{"blocks": ["a\xa0b\n", "c"], "images": [[0, 0, 595, 421]]}, {"crash": 1}, {"paths": 70}]), fakes.FakePdf(), [(1, 2)])
    assert kinds(found) == [("page", None), ("error", "page")] and found[0]["blocks"] == ["a b", "c"] and found[0]["cover"] == 0.5 and found[1]["error_type"] == "KeyError"
    for word, kind in (("broken", "CorruptFile"), ("locked", "PasswordProtected"), ("none", "CorruptFile")):
        with pytest.raises(ReadError) as e:
            pdf.read(fakes.pdf(word), fakes.FakePdf())
        assert e.value.kind == kind
    assert pdf.read(fakes.pdf("mended"), fakes.FakePdf())[0]["message"].startswith("PDF structure was damaged")
    assert pdf.read(fakes.pdf([{}]), fakes.FakePdf(), [(5, 5)], "5")[0]["message"] == "--pages '5' selects no page of this 1-page PDF"


def test_legacy_needs_an_office(monkeypatch):
    monkeypatch.setattr(legacy.shutil, "which", lambda name: None)
    with pytest.raises(ReadError) as e:
        legacy.converted(b"x", "doc")
    assert e.value.kind == "UnsupportedFormat" and ".docx" in e.value.message


def test_a_damaged_tiff_frame_is_one_error():
    """The frames around it stay; a file without any good frame fails."""
    whole = files.tiff((50, 60), (70, 80))
    second = int.from_bytes(whole[4:8], "little")
    at = second + 2 + 12 * int.from_bytes(whole[second : second + 2], "little")
    cut = whole[:at] + (1 << 30).to_bytes(4, "little") + whole[at + 4 :]  # the next description lies beyond the end
    found = images.read(cut)
    assert [(x["what"], x["page"]) for x in found] == [("image", 1), ("error", 2)] and found[1]["error_type"] == "CorruptFile"
    assert [(x["what"], x["page"]) for x in images.read(cut, [(2, 2)], "2")] == [("error", 2)]
    with pytest.raises(ReadError):
        images.read(whole[:second] + b"\xff\xff")


def test_a_batch_is_read_by_slices():
    import pyarrow as pa

    from leafmill.sources import items

    sizes = []

    def run(a, b):
        sizes.append(len(a))
        return [x + y for x, y in zip(a.to_pylist(), b.to_pylist())]

    got = items.by_slices(run, pa.int64(), pa.array(range(1001)), pa.array(range(1001)))
    assert got.to_pylist() == [2 * k for k in range(1001)] and max(sizes) == items.SLICE
    assert len(items.by_slices(run, pa.int64(), pa.array([], pa.int64()), pa.array([], pa.int64()))) == 0
