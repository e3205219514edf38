"""Pieces every operator of this subpackage shares: reading, cutting lineage, components, text batches."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of the result contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch, at most: whole texts are long, and executors hold a batch on both sides of the pipe.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"ledgerloom-{uuid.uuid4().hex}"))
    return jsc.getCheckpointDir().get()


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate rows, wherever the session's file systems keep it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder, so a lost executor costs nothing computed before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(spark: SparkSession, floor: int = 1) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of text that one group of a grouped pass holds, as a rule; ``ledgerloom.groupBytes`` of the session goes before
#: it, and should grow with executors' memory on very large inputs, as groups exchange packed rows with one another.
GROUP_BYTES = 1 << 23


def text_groups(docs: DataFrame) -> int:
    """Groups to deal whole texts to, so that each holds some GROUP_BYTES however large the input: one pass over the
    text column counts its bytes."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return partitions_for(spark, -(-n_bytes // int(spark.conf.get("ledgerloom.groupBytes", str(GROUP_BYTES)))))


def group_of(groups: int) -> Column:
    """The group of a row, by id and text, so that neither rows without id nor many rows of one id make a large group."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches at BATCH_ROWS or what is set, if that is less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Returns memory that a Python worker has freed but still holds; workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column as one array, and its rows + 1 boundaries (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_string())  # before chunks are joined: 32-bit offsets end at 2 GiB
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component being the smallest node.

    Alternates large-star and small-star steps, each one shuffle that keeps the number of edges at most as large as
    before; rounds go on until nothing changes, which takes about the logarithm of the longest path.  Every round is
    checkpointed.  A node with many neighbours is a large group only as a window-free minimum followed by a join, so no
    group meets in one task's memory.  Empty input gives no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, mark = None, (0, None)
    while mark != before:
        before = mark
        # large-star: every neighbour larger than u is linked to u's smallest neighbour (or u)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u's smaller neighbours and u are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u <> v").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
