"""Cutting lineage so that a lost executor costs no restart."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and all is one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstone-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*cols: str) -> str:
    """SQL for a 64-bit key made from a row's content: equal rows share it, and it does not depend on partitions."""
    return f"xxhash64({', '.join(cols)})"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle and checkpoint files of tables that nothing refers to any more."""
    for _ in range(2):  # the first round drops Python's handles, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1.5)


def trim() -> None:
    """Gives memory that earlier tasks left in a reused Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
