"""Markdown: the text as it is, cut where an image that can be read is linked."""

from __future__ import annotations

import re

from leafmill.functions.links import IMAGE_LINK
from leafmill.sources import images, items

REASON = "Markdown file, read directly"


def read(text: str, warnings: list[str], found: dict[str, bytes], said: dict[str, str]) -> list[dict]:
    """found: bytes of the links that could be read; said: of the others, why not."""
    out: list[dict] = []
    start = 0

    def section(chunk: str) -> None:
        if chunk.strip():
            # Warnings on decoding belong to the first unit, if that is text.
            first = not any(i["what"] != "note" for i in out)
            out.append(items.unit("section", REASON, chunk, chunk, warnings if first else []))

    for m in re.finditer(IMAGE_LINK, text):
        link = m[1]
        if link not in found:
            if said.get(link):
                out.append(items.note(said[link]))
            continue
        section(text[start : m.start()])
        start = m.end()
        out.append(images.embedded(found[link], link[:60], f"image linked from Markdown ({link[:60]})"))
    section(text[start:])
    if not any(i["what"] != "note" for i in out):
        out.append(items.unit("section", REASON, text, text, warnings))
    return out
