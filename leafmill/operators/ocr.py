"""OCR through an engine that is plugged in: only documents with something to recognise send bytes to Python.

A factory makes the engine in each Python worker, when the first image comes. If that fails it isn't tried again: every
unit after it has the same error. A worker holds one engine: that of an earlier run is closed before another is made.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.charclass import WS
from leafmill.functions.fence import fence
from leafmill.operators.extract import Backend
from leafmill.operators.units import FIELDS
from leafmill.schema import BLOCK, ReadError, as_error
from leafmill.sources import pdf
from leafmill.sources.images import upright_png
from leafmill.sources.items import by_slices, clean


# A worker's environment before it makes an engine. Checkpoints are local: nothing goes to the network.
OFFLINE = {"HF_HUB_OFFLINE": "1", "TRANSFORMERS_OFFLINE": "1"}
QUIET = {"HF_HUB_DISABLE_PROGRESS_BARS": "1", "TRANSFORMERS_VERBOSITY": "error", "TOKENIZERS_PARALLELISM": "false"}


@dataclass
class Recognised:
    """What an engine makes of an image. blocks: dicts by schema.BLOCK; capped: how many of them ended at the engine's
    limit of `most_tokens`, which becomes a warning.
    """

    width: int
    height: int
    blocks: list[dict]
    markdown: str = ""
    warnings: list[str] = field(default_factory=list)
    capped: int = 0
    most_tokens: int | None = None

    def said(self) -> list[str]:
        """All warnings."""
        limit = "" if self.most_tokens is None else f"{self.most_tokens}-"
        return [*self.warnings, *([f"{self.capped} block(s) reached the {limit}token limit; their text may be cut off"] if self.capped else [])]


class Engine(Protocol):
    def recognize(self, image: bytes) -> Recognised: ...

    def info(self) -> dict: ...

    def close(self) -> None: ...


class NoEngine:
    """What stands in until an engine is plugged in."""

    def __init__(self):
        raise ReadError("ModelUnavailable", "no OCR engine is plugged in: pass a factory")


_made: dict[str, tuple[Engine | None, Exception | None, float]] = {}


def engine(key: str, factory: Callable[[], Engine]) -> tuple[Engine, float]:
    """This worker's engine of a run, and the seconds that it took to make (0 if it was there)."""
    fresh = key not in _made
    if fresh:
        for old, *_ in _made.values():
            if old is not None:
                with suppress(Exception):  # what is over must not stop what begins
                    old.close()
        _made.clear()
        os.environ.update(QUIET | dict(os.environ) | OFFLINE)
        began = time.perf_counter()
        try:
            _made[key] = factory(), None, time.perf_counter() - began
        except Exception as e:  # remembered, so that it isn't tried for every image
            _made[key] = None, e, 0.0
    made, failure, seconds = _made[key]
    if failure is not None:
        raise failure
    return made, seconds if fresh else 0.0


BLOCKS = pa.list_(pa.struct([("order", pa.int32()), ("label", pa.string()), ("type", pa.string()), ("bbox_xyxy", pa.list_(pa.float64())), ("conf", pa.float64()), ("text", pa.string())]))
RESULT = pa.struct([("error_type", pa.string()), ("message", pa.string()), ("width_px", pa.int32()), ("height_px", pa.int32()), ("blocks", BLOCKS), ("markdown", pa.string()), ("warnings", pa.list_(pa.string())), ("seconds", pa.float64()), ("load_seconds", pa.float64()), ("engine", pa.string())])
RESULT_DDL = f"struct<error_type:string,message:string,width_px:int,height_px:int,blocks:array<{BLOCK}>,markdown:string,warnings:array<string>,seconds:double,load_seconds:double,engine:string>"


def _recognise(request: dict, content: bytes | None, doc, key: str, factory) -> dict:
    began, load, said = time.perf_counter(), 0.0, None
    try:
        maker, load = engine(key, factory)
        said = clean(json.dumps(maker.info(), ensure_ascii=False, sort_keys=True))
        if request["page"] is not None:
            image = doc().render(request["page"], request["dpi"])
        else:
            image = upright_png(request["blob"] if request["blob"] is not None else content, request["frame"])
        got = maker.recognize(image)
        blocks = [{k: clean(v) if isinstance(v, str) else v for k, v in b.items()} for b in got.blocks]
        out = {"width_px": got.width, "height_px": got.height, "blocks": blocks, "markdown": clean(got.markdown), "warnings": list(map(clean, got.said()))}
    except Exception as e:  # a page must not take the others with it
        kind, message = map(clean, as_error(e))
        out = {"error_type": kind, "message": message}
    return out | {"seconds": round(time.perf_counter() - began, 2), "load_seconds": load, "engine": said}


def _stage(factory: Callable[[], Engine], backend: Backend):
    key = uuid.uuid4().hex

    def read(content: pa.Array, requests: pa.Array) -> list[list]:
        out = []
        for c, rs in zip(content, requests):
            rs, data = rs.as_py() or [], c.as_py()
            opened: list = []

            def doc():
                if not opened:
                    opened.append(backend().open(data))
                    opened.append(opened[0].__enter__())
                return opened[1]

            out.append([None if r is None else _recognise(r, data, doc, key, factory) for r in rs])
            if len(opened) == 2:
                opened[0].__exit__(None, None, None)
        return out

    def run(content: pa.Array, requests: pa.Array) -> pa.Array:
        return by_slices(read, pa.list_(RESULT), content, requests)

    return F.arrow_udf(run, f"array<{RESULT_DDL}>")


def block_text(blocks: Column) -> Column:
    """Texts of the blocks that have one, by `order` and then as they came, a blank line between."""
    kept = F.filter(F.transform(blocks, lambda b, k: F.struct(b["order"].alias("order"), k.alias("k"), b["text"].alias("text"))), lambda b: F.coalesce(b["text"], F.lit("")) != "")
    return F.array_join(F.transform(F.array_sort(kept), lambda b: b["text"]), "\n\n")


def _merged(u: Column, r: Column) -> Column:
    """A unit with what was recognised (null if nothing was asked), field by field, without its request."""
    bad = r["error_type"].isNotNull()
    done = r.isNotNull() & ~bad
    text = block_text(r["blocks"])
    blank = F.length(F.regexp_replace(text, f"[{WS}]+", "")) == 0
    said = F.concat(u["warnings"], r["warnings"], F.when(blank, F.array(F.lit("OCR found no text"))).otherwise(F.array().cast("array<string>")))
    new = {
        "text": F.when(done, text), "markdown": F.when(done, r["markdown"]), "warnings": F.when(done, said), "seconds": r["seconds"], "width_px": r["width_px"], "height_px": r["height_px"], "blocks": r["blocks"],
        "status": F.when(bad, F.lit("error")), "error_type": r["error_type"], "message": r["message"],
    }
    return F.struct(*((F.coalesce(new[k], u[k]) if k in new else u[k]).alias(k) for k in FIELDS if k != "request"))


def recognise(documents: DataFrame, factory: Callable[[], Engine] = NoEngine, backend: Backend = pdf.default) -> DataFrame:
    """Fills in the units that have a request. Adds `ocr_seconds`, `load_seconds` and `ocr_engine`, what the engine says of
    itself as JSON (null where none was at work); units lose their request.

    documents: with `content` and `units` (see operators.units).
    """
    requests = F.transform("units", lambda u: u["request"])
    asked = F.filter(requests, lambda r: r.isNotNull())
    needs_file = F.exists(asked, lambda r: r["blob"].isNull())
    stage = _stage(factory, backend)
    out = documents.withColumn("__found", fence(stage(F.when(needs_file, F.col("content")), F.when(F.size(asked) > 0, requests))))
    units = F.transform("units", lambda u, k: _merged(u, F.get(F.col("__found"), k)))
    total = lambda name: F.aggregate("__found", F.lit(0.0), lambda s, r: s + F.coalesce(F.bround(r[name], 2), F.lit(0.0)))
    named = F.get(F.filter(F.transform("__found", lambda r: r["engine"]), lambda e: e.isNotNull()), F.lit(0))
    out = out.withColumn("ocr_engine", named)
    return out.withColumn("units", fence(units)).withColumn("ocr_seconds", F.coalesce(F.bround(total("seconds"), 2), F.lit(0.0))).withColumn("load_seconds", F.coalesce(F.bround(total("load_seconds"), 2), F.lit(0.0))).drop("__found")
