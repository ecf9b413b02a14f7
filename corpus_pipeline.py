"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir); what it returns is written and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, decontam, linededup, quality, simhash
from leafmill.llm.common import shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like any other, repeated rows stay or go together; labels without an id or a mark
    teach nothing, and without good labels all documents stay.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest document that has them.

    Null texts stay null; documents without an id neither lose nor claim lines; rows with equal ids are one document;
    a document that loses all its lines stays, with an empty text.
    """
    return linededup.dedup(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the smallest id.

    Documents without a word are copies of each other, null or empty; of equal rows one stays; a document without an id
    stays only where its group has no id at all.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold nothing and stay, repeated rows stay or go together; null items are held by nothing, and
    without any item all documents stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed, where each token begins, and the digest of what the ids decode to, which is that of the text.

    Null texts are empty ones, without ids; repeated rows come out repeated.
    """
    told = bpe.encode(docs, public_tokenizers.path(bpe.RANKS))
    return told.select("doc_id", "n_tokens", "ids", "offsets", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_dedup", keep_one), ("decontaminate", drop_leaks), ("encode", encode)]
#: The classifier and the tokenizer can't be put into SQL.
ORACLE_SQL = None


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage wrote is removed once the next one's rows are written."""
    docs, at, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            _removed(spark, before)
        before = f"{at}/{name}"
    return docs
