"""What readers make of a file: a list of items, of which native expressions make units (see operators.units).

An item is a dict with keys of ITEM, most of them left out. By `what` it is
- unit: text that was read directly;
- image: pixels for OCR, with `blob` (or the file itself, if null) and `frame`;
- page: a page of a PDF, for which the route decides;
- error: a unit that failed;
- note: a warning on the document, where it arose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa

FIELDS = {
    "what": pa.string(), "kind": pa.string(), "reason": pa.string(), "text": pa.string(), "markdown": pa.string(), "warnings": pa.list_(pa.string()), "page": pa.int32(), "name": pa.string(),
    "error_type": pa.string(), "message": pa.string(), "blob": pa.binary(), "embedded": pa.bool_(), "frame": pa.int32(), "width_px": pa.int32(), "height_px": pa.int32(), "label": pa.string(),
    "blocks": pa.list_(pa.string()), "cover": pa.float64(), "paths": pa.int32(), "fonts": pa.list_(pa.string()), "width_pt": pa.float64(), "height_pt": pa.float64(),
}
ARROW = pa.list_(pa.struct(list(FIELDS.items())))
ITEM = (
    "struct<what:string,kind:string,reason:string,text:string,markdown:string,warnings:array<string>,page:int,name:string,error_type:string,message:string,blob:binary,embedded:boolean,frame:int,"
    "width_px:int,height_px:int,label:string,blocks:array<string>,cover:double,paths:int,fonts:array<string>,width_pt:double,height_pt:double>"
)


#: Rows of a batch whose Python objects are alive at a time.
SLICE = 200


def by_slices(run: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What a function makes of the columns' rows, a slice at a time: a batch may have 10,000 of them."""
    parts = [pa.array(run(*(c.slice(k, SLICE) for c in columns)), kind) for k in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def unit(kind: str, reason: str, text: str, markdown: str, warnings: Sequence[str] = (), **more) -> dict:
    return {"what": "unit", "kind": kind, "reason": reason, "text": text, "markdown": markdown, "warnings": list(warnings), **more}


def note(message: str) -> dict:
    return {"what": "note", "message": message}


def error(kind: str, reason: str, error_type: str, message: str, **more) -> dict:
    return {"what": "error", "kind": kind, "reason": reason, "error_type": error_type, "message": message, **more}


def table(rows: Sequence[Sequence[str]]) -> str:
    """The Markdown that functions.text.md_table() gives, for readers that run in Python anyway."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    shape = lambda cells: f"| {' | '.join(cells)} |"
    escaped = [[*(c.replace("|", "\\|").replace("\n", "<br>") for c in r), *[""] * (width - len(r))] for r in rows]
    return "\n".join(map(shape, [escaped[0], ["---"] * width, *escaped[1:]]))


def clean(text: str) -> str:
    """Text that can be UTF-8: lone surrogates as their escapes."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


def as_arrow(items: Iterable[dict]) -> list[dict]:
    """Items with all keys, and text that Arrow takes."""
    return [{k: clean(v) if isinstance(v := item.get(k), str) else [clean(x) if isinstance(x, str) else x for x in v] if isinstance(v, list) else v for k in FIELDS} for item in items]
