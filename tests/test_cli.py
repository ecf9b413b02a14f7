"""The command line, and the doctor."""

import json

import pytest

from leafmill import cli, doctor
from leafmill.schema import Options
from tests import files


def test_version_and_help(capsys):
    assert cli.main(["--version"]) == 0 and "leafmill" in capsys.readouterr().out
    assert cli.main([]) == 2


@pytest.mark.parametrize("args", [["process", "--dpi", "20"], ["process", "--dpi", "x"], ["process", "--pages", "3-1"], ["evaluate", "x.json"], ["nonsense"]])
def test_bad_arguments(args):
    with pytest.raises(SystemExit):
        cli.main(args)


def test_options():
    o = cli.options_of(cli.parser().parse_args(["process", "a", "--pages", "1-3", "--max-megapixels", "2.5", "--force-ocr", "--deterministic"]))
    assert (o.pages, o.max_pixels, o.force_ocr, o.deterministic, o.dpi) == ("1-3", 2_500_000, True, True, 200)


def test_process_and_evaluate(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "book.xlsx").write_bytes(files.xlsx(files.png(4, 4)))
    (tmp_path / "in" / "a.md").write_text("one two three")
    assert cli.main(["process", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--deterministic"]) == 0
    said = capsys.readouterr().out
    assert "2 document(s): 2 ok, 0 partial, 0 error" in said and "1 unit (1 native, 0 ocr)" in said and "2 units (2 native, 0 ocr)" in said
    (tmp_path / "ref.txt").write_text("one two four")
    assert cli.main(["evaluate", str(tmp_path / "out" / "a.md" / "document.json"), "--reference", str(tmp_path / "ref.txt")]) == 0
    assert json.loads(capsys.readouterr().out)["wer"] == pytest.approx(1 / 3)
    assert cli.main(["process", str(tmp_path / "gone.pdf"), "--out", str(tmp_path / "out2")]) == 1


def test_doctor(spark, tmp_path):
    said = []
    assert doctor.run(Options(model_dir=str(tmp_path / "none")), said.append) == 1
    assert any("model directory not found" in x for x in said) and any(x.startswith("python") for x in said)
    at = tmp_path / "model/weights/ocr"
    at.mkdir(parents=True)
    (at / "model-00001-of-00001.safetensors").write_bytes(b"x")
    (at / "model.safetensors.index.json").write_text('{"metadata": {"total_size": 10}}')
    assert [p.message.split()[0] for p in doctor.model_problems(str(tmp_path / "model"))] == ["layout", "OCR"]
    assert doctor.major_minor("2.14.0+cpu") == (2, 14)
    assert doctor.table(spark, Options(model_dir=str(tmp_path))).where("problem is not null").count() > 0
