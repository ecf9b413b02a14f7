"""Items to units, natively: the route of PDF pages, limits on pixels, what is skipped, and what goes to OCR.

Everything stays in the document's row; arrays are transformed in place, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import pages, quality
from leafmill.functions.fence import fence
from leafmill.schema import BLOCK, TEXT_LAYER, Options

REQUEST = "struct<blob:binary,frame:int,page:int,dpi:int>"
FIELDS = {
    "index": "int", "kind": "string", "origin": "string", "status": "string", "reason": "string", "text": "string", "markdown": "string", "warnings": "array<string>", "page": "int", "name": "string",
    "page_width_pt": "double", "page_height_pt": "double", "text_layer": TEXT_LAYER, "seconds": "double", "error_type": "string", "message": "string",
    "render_dpi": "double", "width_px": "int", "height_px": "int", "blocks": f"array<{BLOCK}>", "request": REQUEST,
}


def unit(**columns: Column) -> Column:
    """A unit; what isn't given has its usual value."""
    usual = {"status": F.lit("ok"), "text": F.lit(""), "markdown": F.lit(""), "warnings": F.array()}
    return F.struct(*((columns.get(k, usual.get(k, F.lit(None))).cast(kind)).alias(k) for k, kind in FIELDS.items()))


def _judged(items: Column, options: Options) -> Column:
    """Each item with its page's text, counts, metrics, verdict and route: a step for each, as expressions within a step aren't shared."""
    t = options.thresholds
    out = F.transform(items, lambda i: F.struct(i.alias("i"), F.when(i["what"] == "page", F.array_join(i["blocks"], "\n")).alias("text")))
    for step in (quality.pieces, quality.sorted_out, quality.counts):
        out = F.transform(out, lambda x: F.struct(x["i"].alias("i"), step(x["text"]).alias("text")))
    out = F.transform(out, lambda x: F.struct(x["i"].alias("i"), quality.metrics(x["text"]).alias("m")))
    out = F.transform(out, lambda x: F.struct(x["i"].alias("i"), x["m"].alias("m"), quality.verdict(x["m"], x["i"]["fonts"], t).alias("v")))
    return F.transform(out, lambda x: F.struct(x["i"].alias("i"), x["m"].alias("m"), quality.route(x["m"]["chars"], x["i"]["cover"], x["i"]["paths"], x["v"], options.force_ocr, t).alias("r"), pages.render_dpi(x["i"]["width_pt"], x["i"]["height_pt"], options.dpi, options.max_pixels).alias("d")))


def _page(x: Column) -> Column:
    i, r, d = x["i"], x["r"], x["d"]
    layer = quality.text_layer(x["m"]["chars"], i["cover"], i["paths"], x["m"], r)
    kept = F.array_join(F.filter(i["blocks"], lambda b: F.length(quality.squeezed(b)) > 0), "\n\n")
    size = {"page": i["page"], "page_width_pt": F.bround(i["width_pt"], 1), "page_height_pt": F.bround(i["height_pt"], 1), "text_layer": layer}
    note = F.when(d["warning"].isNotNull(), F.array(d["warning"])).otherwise(F.array().cast("array<string>"))
    request = F.struct(F.lit(None).cast("binary").alias("blob"), F.lit(0).alias("frame"), i["page"].alias("page"), d["dpi"].alias("dpi"))
    return (
        F.when(~r["ocr"], unit(kind=F.lit("page"), origin=F.lit("native"), reason=r["reason"], text=kept, markdown=kept, warnings=r["warnings"], **size))
        .when(d["dpi"].isNull(), unit(kind=F.lit("page"), origin=F.lit("native"), status=F.lit("error"), reason=F.lit("page could not be processed"), error_type=F.lit("ImageTooLarge"), message=d["message"], page=i["page"]))
        .otherwise(unit(kind=F.lit("page"), origin=F.lit("ocr"), reason=r["reason"], warnings=F.concat(r["warnings"], note), render_dpi=d["dpi"], request=request, **size))
    )


def _image(i: Column, options: Options) -> Column:
    large = pages.too_many_pixels(i["width_px"], i["height_px"], options.max_pixels, i["label"])
    request = F.struct(i["blob"].alias("blob"), i["frame"].alias("frame"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("dpi"))
    same = {"kind": i["kind"], "origin": F.lit("ocr"), "page": i["page"], "name": i["name"]}
    reason = F.when(i["embedded"], i["reason"]).otherwise(F.lit("image frame could not be read"))
    return F.when(large.isNotNull(), unit(status=F.lit("error"), reason=reason, error_type=F.lit("ImageTooLarge"), message=large, **same)).otherwise(unit(reason=i["reason"], request=request, **same))


def _skipped(i: Column, options: Options) -> Column:
    small = pages.too_small(i["width_px"], i["height_px"], i["name"], options.min_image_px)
    fits = pages.too_many_pixels(i["width_px"], i["height_px"], options.max_pixels).isNull()
    return F.when((i["what"] == "image") & i["embedded"] & fits, small)


def with_units(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds `units` (with a request where OCR has to read) and `notes` (warnings on the document) from `read.items`.

    Units are numbered from 0 in their order. Null items count as none.
    """
    items = F.coalesce(F.col("read.items"), F.array().cast(df.schema["read"].dataType["items"].dataType))
    notes = F.array_compact(F.transform(items, lambda i: F.when(i["what"] == "note", i["message"]).otherwise(_skipped(i, options))))
    mine = F.filter(items, lambda i: (i["what"] != "note") & _skipped(i, options).isNull())

    def of(x: Column) -> Column:
        i = x["i"]
        ocr = F.when((i["kind"] == "page") & i["frame"].isNull(), F.lit("native")).otherwise(F.lit("ocr"))
        return (
            F.when(i["what"] == "page", _page(x))
            .when(i["what"] == "image", _image(i, options))
            .when(i["what"] == "error", unit(kind=i["kind"], origin=ocr, status=F.lit("error"), reason=i["reason"], error_type=i["error_type"], message=i["message"], page=i["page"], name=i["name"]))
            .otherwise(unit(kind=i["kind"], origin=F.lit("native"), reason=i["reason"], text=i["text"], markdown=i["markdown"], warnings=F.coalesce(i["warnings"], F.array().cast("array<string>")), page=i["page"], name=i["name"]))
        )

    numbered = F.transform(F.transform(_judged(mine, options), of), lambda u, k: u.withField("index", k.cast("int")))
    return df.withColumn("notes", notes).withColumn("units", fence(numbered))


def exploded(documents: DataFrame) -> DataFrame:
    """A row for each unit: the document's source, and the unit's fields."""
    return documents.select("source", F.explode("units").alias("u")).select("source", "u.*")
