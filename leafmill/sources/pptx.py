"""PPTX: a unit for each slide with text, in the order of the presentation; a slide's pictures follow it."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree.ElementTree import Element

from leafmill.sources import images, items
from leafmill.sources.package import OFFICE, Package

# XML names.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = f"{{{OFFICE}}}"
TITLES = ("title", "ctrTitle")


def paragraph(p: Element) -> str:
    return "".join((e.text or "") if e.tag == f"{A}t" else "\n" for e in p.iter() if e.tag in (f"{A}t", f"{A}br")).strip()


def shapes(tree: Element) -> Iterator[tuple[str, object]]:
    """("text", Markdown), ("table", rows) and ("image", relationship) of shapes, also of grouped ones."""
    for e in tree:
        if e.tag == f"{P}grpSp":
            yield from shapes(e)
        elif e.tag == f"{P}sp":
            place = e.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            mark = "## " if place is not None and place.get("type") in TITLES else ""
            yield from (("text", mark + t) for t in map(paragraph, e.findall(f"{P}txBody/{A}p")) if t)
        elif e.tag == f"{P}graphicFrame":
            rows = [[" ".join(map(paragraph, tc.iter(f"{A}p"))).strip() for tc in tr.findall(f"{A}tc")] for tr in e.iter(f"{A}tr")]
            if any(map(any, rows)):
                yield "table", rows
        elif e.tag == f"{P}pic" and (blip := e.find(f"{P}blipFill/{A}blip")) is not None and (rid := blip.get(f"{R}embed")):
            yield "image", rid


def read(content: bytes) -> list[dict]:
    package = Package(content, "PPTX")
    main = "ppt/presentation.xml"
    related = package.related(main)
    slides = [related[rid][0] for s in package.xml(main).iter(f"{P}sldId") if (rid := s.get(f"{R}id")) in related]
    out: list[dict] = []
    for number, slide in enumerate(slides, 1):
        tree = package.xml(slide).find(f"{P}cSld/{P}spTree")
        found = list(shapes(tree)) if tree is not None else []
        pictures = package.related(slide)
        marked = [items.table(v) if kind == "table" else v for kind, v in found if kind != "image"]
        if marked:
            out.append(items.unit("page", "PPTX slide text, read directly", "\n".join(marked), "\n\n".join(marked), page=number))
        for rid in (v for kind, v in found if kind == "image"):
            path = pictures.get(rid, ("", ""))[0]
            blob = package.read(path) if path else None
            if blob is None:
                out.append(items.note(f"slide {number}: picture {rid} is not stored in the file"))
            else:
                out.append(images.embedded(blob, path, f"picture on slide {number} ({path})", page=number))
    return out
