"""An OCR engine, a PDF backend and a judge that know what they are to say."""

import json
from contextlib import contextmanager

from leafmill.operators.judge import Reply
from leafmill.operators.ocr import Recognised
from leafmill.sources.pdf import Page


class FakeEngine:
    """Three blocks of a page, out of order; an image that holds "crash" fails."""

    def recognize(self, image):
        if b"crash" in image:
            raise RuntimeError("simulated crash")
        blocks = [
            {"order": 1, "label": "Paragraph", "type": "Text", "bbox_xyxy": [0.0, 0.0, 9.0, 9.0], "conf": 0.9, "text": f"FAKE OCR {len(image)}"},
            {"order": 0, "label": "Header", "type": "PageHeader", "bbox_xyxy": [0.0, 0.0, 9.0, 1.0], "conf": 0.6, "text": ""},
            {"order": 0, "label": "Note", "type": "Text", "bbox_xyxy": [0.0, 0.0, 9.0, 1.0], "conf": 0.7, "text": "first"},
        ]
        return Recognised(10, 20, blocks if b"blank" not in image else [], "# md", ["slow"] if b"slow" in image else [])

    def info(self):
        return {"name": "fake"}

    def close(self):
        pass


class FakePdf:
    """A "PDF" whose bytes after the magic are JSON: a list of pages, or a word for what is wrong with it."""

    @contextmanager
    def open(self, content):
        body = json.loads(content.partition(b"\n")[2])
        if body == "broken":
            raise ValueError("no xref")

        class Doc:
            encrypted, repaired = body == "locked", body == "mended"
            pages = len(body) if isinstance(body, list) else 0 if body == "none" else 1

            def page(self, n):
                p = body[n - 1] if isinstance(body, list) else {}
                if p.get("crash"):
                    raise KeyError("page")
                return Page(p.get("w", 595.0), p.get("h", 842.0), p.get("blocks", []), [tuple(b) for b in p.get("images", [])], p.get("paths"), p.get("fonts", []))

            def render(self, n, dpi):
                return f"page {n} at {dpi} {json.dumps(body[n - 1])}".encode()

        yield Doc()


class FakeJudge:
    def ask(self, prompt, png):
        if b"at 134" not in png:
            raise RuntimeError(f"odd picture {png[:20]}")
        said = prompt.partition("<<<\n")[2].partition("\n>>>")[0]
        return Reply("Here: " + json.dumps({"transcription": said, "score": 9, "verdict": "good", "reading_order_ok": False, "wrong_text": [{"ocr": "a", "actual": "b"}, "x"]}), 100, 10)


def pdf(body):
    return b"%PDF-1.7\n" + json.dumps(body).encode()
