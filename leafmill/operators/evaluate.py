"""Documents against reference texts, and rates over many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import metrics
from leafmill.functions.text import normalize
from leafmill.operators.documents import hypothesis


def throughput(units: Column, total_seconds: Column, ocr_seconds: Column) -> dict[str, Column]:
    """Units, and units by second of all time and of OCR time (null where there was none)."""
    n = F.coalesce(F.size(units), F.lit(0))
    ocr = F.coalesce(F.size(F.filter(units, lambda u: u["origin"] == "ocr")), F.lit(0))
    return {"units": n, "units_per_second": metrics.per_second(n, total_seconds), "ocr_units_per_second": metrics.per_second(ocr, ocr_seconds)}


def evaluate(documents: DataFrame, references: DataFrame, least: float = 0.8) -> DataFrame:
    """Error rates, token overlap, throughput and review reasons of each document that has a reference.

    documents: by schema.DOCUMENT; references: source, reference. A null reference counts as empty.
    """
    both = documents.join(references.select("source", "reference"), "source")
    told = both.withColumn("__ref", normalize(F.col("reference"))).withColumn("__hyp", normalize(hypothesis(F.col("units"))))
    told = told.withColumn("__f1", metrics.f1_of(metrics.overlap_of(F.col("__ref"), F.col("__hyp")), metrics.word_count(F.col("__ref")), metrics.word_count(F.col("__hyp"))))
    speed = throughput(F.col("units"), F.col("timings.total_seconds"), F.col("timings.ocr_seconds"))
    return told.select(
        "source",
        metrics.cer_of(F.col("__ref"), F.col("__hyp")).alias("cer"),
        metrics.wer_of(F.col("__ref"), F.col("__hyp")).alias("wer"),
        *(F.col(f"__f1.{k}").alias(f"token_{k}") for k in ("precision", "recall", "f1")),
        *(c.alias(k) for k, c in speed.items()),
        F.col("timings.peak_rss_mb").alias("peak_rss_mb"),
        metrics.review_reasons(F.col("status"), F.col("units"), least).alias("needs_review"),
    )


def straight_through(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: stp_rate and hitl_rate."""
    stp, hitl = metrics.stp_rates(F.col("reasons"))
    return documents.select(metrics.review_reasons(F.col("status"), F.col("units"), least).alias("reasons")).agg(stp.alias("stp_rate"), hitl.alias("hitl_rate"))
