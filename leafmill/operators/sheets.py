"""Relations between parts of a file: formulas without a value, references in order, references to what isn't there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import column_letters, shown


def uncached(formulas: DataFrame, values: DataFrame) -> DataFrame:
    """sheet, n and warning, of sheets with formulas that have no value. Both have sheet, row and col, from 1."""
    missing = formulas.select("sheet", "row", "col").join(values.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti").distinct()
    cells = missing.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("cells"))
    names = F.transform("cells", lambda c: F.concat(column_letters(c["col"]), c["row"].cast("string")))
    n = F.size("cells").cast("long")
    said = F.concat(n.cast("string"), F.lit(" formula cell(s) have no cached value (workbook was never calculated in Excel); shown empty: "), shown(names))
    return cells.select("sheet", n.alias("n"), said.alias("warning"))


def resolved(order: DataFrame, relations: DataFrame) -> DataFrame:
    """References in their order with their targets; those without one are dropped. order: part, position, rid; relations: part, rid, target."""
    return order.join(relations, ["part", "rid"]).select("part", "position", "rid", "target")


def with_missing(pictures: DataFrame, relations: DataFrame) -> DataFrame:
    """Pictures with their targets, or a warning: part, number, rid, target, warning. pictures: part, number, rid."""
    told = pictures.join(relations, ["part", "rid"], "left")
    said = F.concat(F.lit("slide "), F.col("number").cast("string"), F.lit(": picture "), "rid", F.lit(" is not stored in the file"))
    return told.select("part", "number", "rid", "target", F.when(F.col("target").isNull(), said).alias("warning"))
