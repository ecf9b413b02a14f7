"""Text functions: normal form, tokens, line ends, Markdown tables and tab-separated grids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.charclass import SPACE


def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


_compose_udf = F.pandas_udf(_compose, T.StringType())


def nfc(text: Column) -> Column:
    """Unicode's composed form. Spark has no function for it, so text that isn't ASCII, and only that, goes to Python."""
    return F.coalesce(_compose_udf(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def normalize(text: Column) -> Column:
    """Composed, and with white space collapsed: what the metrics compare. Null counts as empty."""
    return squash(nfc(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """The words between white space; of an empty text none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+"), F.lit(0))


def lf(text: Column) -> Column:
    """All line ends as LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def plain_spaces(text: Column) -> Column:
    """No-break spaces as spaces."""
    return F.replace(text, F.lit(" "), F.lit(" "))


def md_table(rows: Column) -> Column:
    """A Markdown table of an array of arrays of text, the first row as header; short rows are filled up.

    Pipes are escaped and line ends become <br>. Without rows, or without any cell, the table is empty text; null rows
    count as none and null cells as empty.
    """
    rows = F.coalesce(rows, F.array().cast("array<array<string>>"))
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(F.coalesce(r, F.array().cast("array<string>"))))), F.lit(0))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    filled = lambda r: F.transform(F.concat(F.coalesce(r, F.array().cast("array<string>")), F.array_repeat(F.lit(""), width - F.size(F.coalesce(r, F.array().cast("array<string>"))))), cell)
    lines = F.transform(rows, lambda r: line(filled(r)))
    every = F.concat(F.slice(lines, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(width > 0, F.array_join(every, "\n")).otherwise(F.lit(""))


def tsv(rows: Column, flat: bool = False) -> Column:
    """Rows as lines, cells between tabs. flat: line ends within cells become spaces."""
    rows = F.coalesce(rows, F.array().cast("array<array<string>>"))
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")) if flat else F.coalesce(c, F.lit(""))
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell), "\t")), "\n")


def dense(cells: Column) -> Column:
    """Rows of a grid from its filled cells, an array of (row, col, value) counted from 1, where missing ones are empty text.

    Of two cells at one place the later one counts. Null and empty arrays make no rows.
    """
    cells = F.coalesce(cells, F.array().cast("array<struct<row:int,col:int,value:string>>"))
    height = F.coalesce(F.array_max(F.transform(cells, lambda c: c["row"])), F.lit(0))
    width = F.coalesce(F.array_max(F.transform(cells, lambda c: c["col"])), F.lit(0))
    at = F.map_from_entries(F.transform(F.filter(cells, lambda c: c["value"].isNotNull()), lambda c: F.struct((c["row"].cast("bigint") * 1048576 + c["col"]).alias("k"), c["value"].alias("v"))))
    row = lambda r: F.transform(F.sequence(F.lit(1), width), lambda c: F.coalesce(F.try_element_at(at, r.cast("bigint") * 1048576 + c), F.lit("")))
    return F.when((height > 0) & (width > 0), F.transform(F.sequence(F.lit(1), F.greatest(height, F.lit(1))), row)).otherwise(F.array().cast("array<array<string>>"))


def column_letters(n: Column) -> Column:
    """The letters of a sheet's column, counted from 1, up to three letters."""
    digit = lambda x: F.char((x % 26) + 65)
    k = n.cast("bigint") - 1
    two, three = F.floor(k / 26) - 1, F.floor((k - 26) / 676) - 1
    return (
        F.when(k < 26, digit(k))
        .when(k < 702, F.concat(digit(two), digit(k)))
        .otherwise(F.concat(digit(three), digit(F.floor((k - 26) / 26)), digit(k)))
    )


def shown(items: Column, most: int = 5) -> Column:
    """The first items between commas, and an ellipsis if there are more."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, F.lit(" ...")).otherwise(F.lit("")))


def cell_text(kind: Column, value: Column) -> Column:
    """A sheet's value as text, by its kind: bool, number, datetime, date, time or text; null is empty.

    Whole numbers below 1e15 have no decimals; others are in shortest form, with an exponent outside 1e-4 to 1e16.
    A date and time at midnight is a date.
    """
    x = F.when(kind == "number", value).cast("double")
    stamp = F.when(kind == "datetime", value).try_cast("timestamp_ntz")
    return (
        F.when(value.isNull(), F.lit(""))
        .when(kind == "bool", F.when(F.lower(value).isin("1", "true"), F.lit("TRUE")).otherwise(F.lit("FALSE")))
        .when(kind == "number", number_text(x))
        .when((kind == "datetime") & (F.date_format(stamp, "HH:mm:ss.SSSSSS") == "00:00:00.000000"), F.date_format(stamp, "yyyy-MM-dd"))
        .when(kind == "datetime", F.regexp_replace(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", ""))
        .otherwise(value)
    )


def number_text(x: Column) -> Column:
    """A double as cell_text() has it."""
    whole = (F.abs(x) < 1e15) & (x == F.floor(x))
    short = x.cast("string")  # shortest digits, but as d.dddE±n outside 1e-3 to 1e7
    mantissa, power = F.regexp_extract(short, r"^(-?[0-9.]+)E", 1), F.regexp_extract(short, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"[-.]", "")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    n = F.length(digits)
    fixed = (
        F.when(power < 0, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power + 1 >= n, F.concat(sign, F.rpad(digits, power + 1, F.lit("0")), F.lit(".0")))
        .otherwise(F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    )
    exponent = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0"))
    )
    return (
        F.when(x.isNull(), F.lit(""))
        .when(F.isnan(x), F.lit("nan"))
        .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(whole, F.format_string("%d", x.cast("bigint")))
        .when(~short.contains("E"), short)
        .when((F.abs(x) >= 1e16) | (F.abs(x) < 1e-4), exponent)
        .otherwise(fixed)
    )
