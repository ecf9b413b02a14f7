"""Files that arrive in a folder, as a stream: each micro-batch goes through the batch plan, and a file is taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions.sniffing import format_of, suffix
from leafmill.operators import extract, ocr
from leafmill.plans.process import documents_of
from leafmill.schema import Options
from leafmill.sources import pdf

ARRIVALS = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the files of known extensions below a folder, as jobs (see sources.inputs.COLUMNS) with the time of their last change. Spark's stream passes empty files over."""
    found = spark.readStream.format("binaryFile").schema(ARRIVALS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(folder)
    name = F.substring_index("path", "/", -1)
    known = format_of(suffix(name)).isNotNull() & ~name.startswith("~$")
    path = F.regexp_replace("path", "^file:/+", "/")
    return found.where(known).select(
        F.lit(0).alias("input"), path.alias("source"), path.alias("path"), F.lit("").alias("rel_dir"), name.alias("name"), F.expr("length"), "content", F.lit(False).alias("missing"), F.col("modificationTime").alias("changed")
    )


def first_copies(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """One of the files with equal bytes that arrive within `late` of each other; state older than that is dropped."""
    return stream.withColumn("sha256", F.sha2("content", 256)).withWatermark("changed", late).dropDuplicatesWithinWatermark(["sha256"]).drop("sha256")


def ingest(
    spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options = Options(), engine: Callable = ocr.NoEngine, backend: extract.Backend = pdf.default, dedupe: bool = False, once: bool = True, files_at_once: int = 1000
) -> StreamingQuery:
    """Documents of arriving files, appended to a table at `out` by format. once: ends when what is there has been read.

    A batch that is run again overwrites its own part of the table, so each file counts once.
    """
    stream = arrivals(spark, folder, files_at_once)
    stream = (first_copies(stream) if dedupe else stream).drop("changed")

    def run(batch: DataFrame, number: int) -> None:
        found = documents_of(batch, options, engine, backend).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "format").parquet(out)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
