"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship_by_value(module_name: str) -> None:
    """Have the functions of a module travel with the task, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    made = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def persist(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")  # the shuffle files of this write go when it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers outlive it, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


