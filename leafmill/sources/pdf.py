"""PDF through a backend: pages with text blocks, image boxes, drawing paths and fonts; rendering for OCR.

A backend is any object with the methods of Backend; default() picks one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cache
from importlib.util import find_spec
from typing import Protocol

from leafmill.functions.metrics import union_area
from leafmill.schema import ReadError, as_error
from leafmill.sources import items


@dataclass
class Page:
    """What a route needs to know. blocks: texts in reading order; images: boxes; paths: None if it wasn't looked up."""

    width: float
    height: float
    blocks: list[str] = field(default_factory=list)
    images: list[tuple[float, float, float, float]] = field(default_factory=list)
    paths: int | None = None
    fonts: list[str] = field(default_factory=list)


class Document(Protocol):
    encrypted: bool
    repaired: bool
    pages: int

    def page(self, number: int) -> Page: ...

    def render(self, number: int, dpi: int) -> bytes: ...


class Backend(Protocol):
    def open(self, content: bytes): ...


class MuPdf:
    """PyMuPDF as a backend."""

    @contextmanager
    def open(self, content: bytes) -> Iterator[Document]:
        import pymupdf

        class Opened:
            def __init__(self, doc):
                self.doc, self.encrypted, self.repaired, self.pages = doc, bool(doc.needs_pass), bool(doc.is_repaired), doc.page_count

            def page(self, number: int) -> Page:
                p = self.doc[number - 1]
                flags = pymupdf.TEXTFLAGS_TEXT & ~pymupdf.TEXT_PRESERVE_LIGATURES & ~getattr(pymupdf, "TEXT_CID_FOR_UNKNOWN_UNICODE", 0)
                blocks = [b[4] for b in p.get_text("blocks", flags=flags) if b[6] == 0]
                return Page(
                    p.rect.width, p.rect.height, blocks, [tuple(i["bbox"]) for i in p.get_image_info()],
                    None if any(map(str.strip, blocks)) else len(p.get_cdrawings()), [n for f in p.get_fonts(full=False) for n in f[3:5]],
                )

            def render(self, number: int, dpi: int) -> bytes:
                return self.doc[number - 1].get_pixmap(dpi=dpi, colorspace=pymupdf.csRGB, alpha=False).tobytes("png")

        with pymupdf.open(stream=content, filetype="pdf") as doc:
            yield Opened(doc)


@cache
def _installed(name: str) -> bool:
    """Looked up once: a module that isn't there is sought in all folders each time."""
    return find_spec(name) is not None


def default() -> Backend:
    """PyMuPDF where it is installed, else the reader in sources.pdfbytes, which draws no pages."""
    if _installed("pymupdf"):
        return MuPdf()
    from leafmill.sources.pdfbytes import PlainPdf

    return PlainPdf()


def cover(p: Page) -> float:
    """Part of the page under images."""
    cut = [(max(x0, 0.0), max(y0, 0.0), min(x1, p.width), min(y1, p.height)) for x0, y0, x1, y1 in p.images]
    kept = [r for r in cut if r[2] > r[0] and r[3] > r[1]]
    return union_area(kept) / (p.width * p.height) if kept else 0.0


def read(content: bytes, backend: Backend, pages: list[tuple[int, int | None]] | None = None, spec: str | None = None) -> list[dict]:
    """An item for each page that the ranges name; a page that fails is an error item."""
    try:
        opened = backend.open(content)
        doc = opened.__enter__()
    except ReadError:
        raise
    except Exception as e:  # backends raise what they like for files that are cut short or no PDFs
        raise ReadError("CorruptFile", f"not a readable PDF: {e}") from None
    try:
        if doc.encrypted:
            raise ReadError("PasswordProtected", "PDF is encrypted; no text or images were read.")
        if not doc.pages:
            raise ReadError("CorruptFile", "PDF has no pages")
        out = [items.note("PDF structure was damaged and repaired while opening; content may be incomplete")] if doc.repaired else []
        wanted = [n for n in range(1, doc.pages + 1) if not pages or any(a <= n <= (b or n) for a, b in pages)]
        if not wanted:
            out.append(items.note(f"--pages {spec!r} selects no page of this {doc.pages}-page PDF"))
        for n in wanted:
            try:
                p = doc.page(n)
                out.append({"what": "page", "page": n, "blocks": [b.strip("\n").replace("\xa0", " ") for b in p.blocks], "cover": cover(p), "paths": p.paths, "fonts": list(p.fonts), "width_pt": p.width, "height_pt": p.height})
            except Exception as e:  # a page must not take the others with it
                out.append(items.error("page", "page could not be processed", *as_error(e), page=n))
        return out
    finally:
        opened.__exit__(None, None, None)
