"""Session helpers: a local session, the package for Python workers, and cutting lineage."""

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        # Files of a checkpoint go when nothing refers to it any more; set it on a cluster as well.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def show_package_to_workers(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver found it; on a cluster ship it with --py-files."""
    env = spark.sparkContext.environment
    have = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, ROOT])


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """The folder that spark.checkpoint.dir names, or a new one of that name within it; only a local session may have one of its own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="leafmill-"))
    at = jsc.getCheckpointDir().get()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}" if name else at


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to shared_folder()."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a small input comes as fewer partitions than there are; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
