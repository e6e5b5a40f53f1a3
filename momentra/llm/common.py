"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows that make a task of their own in a table that is known to be small; see packed.
PACKED_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a new one on one machine, an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="momentra-")
        sc.setCheckpointDir(root)
    return root


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut through the shared folder; Spark's cleaner removes the files with the frame."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of `rows` rows, in a partition for every PACKED_ROWS of them at most: a table of few rows over all shuffle
    partitions goes on as hundreds of tasks, each with files of its own. Large tables stay as they are."""
    parts = rows // PACKED_ROWS + 1
    return df.coalesce(parts) if parts < shuffle_parts(df.sparkSession) else df


def let_go(spark: SparkSession) -> None:
    """The shuffle files and checkpoints of frames that are no longer held go once the driver collects its garbage, which a
    loop of many small rounds would not wait for."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """In a task: what the allocators of this worker hold unused goes back to the machine, as the worker may wait, or serve
    another stage, for long. Without effect where the C library has no malloc_trim."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z only: lower() would change other letters too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_text(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id counts as the empty text."""
    return crc32_text(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(m)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
