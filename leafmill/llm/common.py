"""What the operators of this subpackage share: tables, lineage cuts, and Arrow text as numpy bytes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which it counts as hot.
HOT = 200_000
#: Bytes of text that a Python worker turns into numpy arrays at a time; a longer single text goes alone.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def spare(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the DataFrame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: computed once, and safe when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(rows: DataFrame, told: DataFrame, key: str, spread: Column | str) -> DataFrame:
    """The rows with what `told` has for their key, or nulls. told: the key, once each; n, the rows that it has at least; other columns.

    Hot keys, of which there is at most one for HOT rows, are broadcast, and their rows are dealt over all tasks by
    `spread`; only the others meet by key. Without hot keys this is a plain join.
    """
    told = cut(told)
    names = [c for c in told.columns if c not in (key, "n")]
    if told.where(F.col("n") > HOT).isEmpty():
        all_told = told.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in names))
        return rows.join(all_told, rows[key] == F.col("__key"), "left").select(*(rows[c] for c in rows.columns), *(F.col(f"__{c}").alias(c) for c in names))
    hot = F.broadcast(told.where(F.col("n") > HOT).select(F.col(key).alias("__hot_key"), F.struct(*names).alias("__hot")))
    # Not a literal, which the optimizer would take out of the join's key.
    warm = told.where(F.col("n") <= HOT).select(F.col(key).alias("__key"), (F.col("n") > HOT).cast("long").alias("__none"), F.struct(*names).alias("__warm"))
    salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 16)) + 1).cast("long")
    dealt = rows.join(hot, rows[key] == F.col("__hot_key"), "left").withColumn("__salt", salt)
    both = dealt.join(warm, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__none")), "left")
    found = F.coalesce("__hot", "__warm")
    return both.select(*(F.col(c) for c in rows.columns), *(found[c].alias(c) for c in names))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, joined, and the offsets of its rows (one more than rows); null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK, row: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about `limit` bytes of text, of which a row counts `row` at least; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + row)
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of `flags` between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: nearby values come out far apart."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Roots:
    """Union-find over the positions 0..n-1; the smallest position of a set is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
