"""Units to documents, documents to batches: statuses, counts, and one line for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_units(units: Column) -> Column:
    return F.filter(units, lambda u: u["status"] == "error")


def outcome(units: Column) -> Column:
    """A struct of status, error_type, message, units and a warning, for a document that could be read.

    If all units failed, so did the document: its error is that of the first, and its units go. If some did, it is
    partial. Without units it is ok, with a warning; null units are none.
    """
    failed, n = failed_units(units), F.coalesce(F.size(units), F.lit(0))
    bad = F.coalesce(F.size(failed), F.lit(0))
    first = F.get(failed, F.lit(0))
    lost = (n > 0) & (bad == n)
    some = F.concat(bad.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" units failed; see their error_type and message"))
    return F.struct(
        F.when(lost, "error").when(bad > 0, "partial").otherwise("ok").alias("status"),
        F.when(lost, F.coalesce(first["error_type"], F.lit("Error"))).alias("error_type"),
        F.when(lost, F.coalesce(first["message"], F.lit(""))).alias("message"),
        F.when(lost, F.slice(units, 1, 0)).otherwise(units).alias("units"),
        F.when(~lost & (bad > 0), some).when(n == 0, F.lit("no content was extracted")).alias("warning"),
    )


def roll_up(units: DataFrame, *keys: str) -> DataFrame:
    """The status of documents whose units are rows: key columns, n_units, n_failed, status, error_type, message.

    units: with `index`, `status`, `error_type` and `message`. Partial sums go over the shuffle, units don't.
    """
    bad = F.col("status") == "error"
    first = F.min(F.when(bad, F.struct("index", F.coalesce("error_type", F.lit("Error")).alias("error_type"), F.coalesce("message", F.lit("")).alias("message"))))
    sums = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), F.count_if(bad).alias("n_failed"), first.alias("first"))
    lost = F.col("n_failed") == F.col("n_units")
    return sums.select(
        *keys, "n_units", "n_failed",
        F.when(lost, "error").when(F.col("n_failed") > 0, "partial").otherwise("ok").alias("status"),
        F.when(lost, F.col("first.error_type")).alias("error_type"), F.when(lost, F.col("first.message")).alias("message"),
    )


def status_counts(documents: DataFrame) -> DataFrame:
    """One row: documents, ok, partial, error, and the exit code (1 unless all are ok)."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    row = documents.agg(F.count(F.lit(1)).alias("documents"), of("ok"), of("partial"), of("error"))
    return row.withColumn("exit_code", F.when(F.col("partial") + F.col("error") > 0, 1).otherwise(0))


def origin_counts(units: Column) -> Column:
    """A struct of the numbers of units, of native ones and of those from OCR."""
    n, ocr = F.coalesce(F.size(units), F.lit(0)), F.coalesce(F.size(F.filter(units, lambda u: u["origin"] == "ocr")), F.lit(0))
    return F.struct(n.alias("units"), (n - ocr).alias("native"), ocr.alias("ocr"))


def summary_line(counts: Column, seconds: Column, status: Column, error_type: Column, message: Column) -> Column:
    """What is said of a document on the console. counts: of origin_counts()."""
    n = counts["units"]
    fine = F.concat(n.cast("string"), F.when(n == 1, F.lit(" unit")).otherwise(F.lit(" units")), F.lit(" ("), counts["native"].cast("string"), F.lit(" native, "), counts["ocr"].cast("string"), F.lit(" ocr), "), F.coalesce(seconds, F.lit(0)).cast("string"), F.lit("s"))
    return F.when(status == "error", F.concat(error_type, F.lit(": "), message)).otherwise(fine)


def hypothesis(units: Column) -> Column:
    """The text of all units that are ok and have some, a blank line between."""
    return F.array_join(F.transform(F.filter(units, lambda u: (u["status"] == "ok") & (F.coalesce(u["text"], F.lit("")) != "")), lambda u: u["text"]), "\n\n")
