"""The queries of this subpackage, by name: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import audio, bpe, decontam, langid, linededup, quality, secrets, simhash, substrings, warc
from leafmill.llm.common import table


def remainder(n: int) -> Column:
    """crc32 of the id's text, modulo n; of a null id 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by a model of the documents that are not held out.

    Null texts and those without a letter are `und` with score 0; a null id is not held out; repeated rows come out
    repeated; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder(4) != 2))
    return langid.identify(docs, model).withColumn("held_out", remainder(4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items of the benchmark each document holds: one row for each pair, none for documents that hold nothing.

    Null and empty texts and items hold nothing and are held by nothing; repeated rows of either table repeat matches.
    """
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text encoded and decoded. Null texts are empty ones, with no ids; repeated rows come out repeated."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that a document of a smaller id has.

    A null text is one empty line. Rows with equal ids are one document, as far as lines are claimed, and come out each;
    without an id a document neither loses nor claims lines.
    """
    return linededup.report(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as stored samples, read back, and the features of its tensors. Null texts are empty ones, of one padded frame; repeated rows come out repeated."""
    return audio.media(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each document, by a model of the labels that are not held out and of all texts.

    Null and empty texts have a score as well; a null id is not held out; labels without an id or a mark teach nothing;
    without any good label all scores are 0.5.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(remainder(3) != 1))
    return quality.scores(docs, model).withColumn("held_out", remainder(3) == 1).select("doc_id", "held_out", "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page archived and read back. Null html is an empty payload, and a response; pages without an id are responses that none revisits; of equal ids with equal payloads one is the response."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each text without the 400-byte strings that also start elsewhere. Null texts are empty ones; repeated rows are copies of each other and lose what they share, if it is long enough."""
    return substrings.report(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each text: counts by kind, and spans. Null and empty texts have none; repeated rows come out repeated."""
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each text and the smallest id of its component. Texts that are null or without words have fingerprint zero and are linked like any other; a null id is the smallest only where there is no other."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_byte_bpe, op4_line_dedup, op5_media_columns, op6_quality, op7_warc, op8_substring_dedup, op9_secret_scan, op10_simhash)}
SQL = {"op4_line_dedup": linededup.SQL, "op7_warc": warc.SQL}
