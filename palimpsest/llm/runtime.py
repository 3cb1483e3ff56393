"""What the operators share on the Spark side: import path of workers, checkpoints, partition counts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that a checkpoint folder is set.

    The folder named in ``spark.checkpoint.dir`` is used where the session has
    one. Where it is unset, a local run gets a temporary one; on a cluster that
    is an error, as no machine sees the folders of another.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return str(held.get())
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows.

    Every executor reads the written files, so a lost executor costs nothing
    that is upstream of the cut.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as a Parquet table in the shared folder: smaller than a checkpoint for long rows of numbers."""
    spark = prepare(df.sparkSession)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one run in a folder of its own in the shared folder; each can be removed once nothing reads it."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = prepare(spark)
        self.base = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, by: str | None = None, tasks: int | None = None) -> DataFrame:
        """Write ``df``, in a folder for each value of ``by`` where that is given, by ``tasks`` tasks at most, and go on from the written rows."""
        df = df.coalesce(tasks) if tasks else df
        path = f"{self.base}/{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables, and let Spark remove the shuffle files of the plans that led to them."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for name in names:
            store.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}"), True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, as after a cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """In a Python worker: return memory that is free in Arrow's pool and in the allocator to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def drop_caches() -> None:
    """In a Python worker: forget the token pieces of an earlier operator and give their memory back. Workers live on from one to the next."""
    held = sys.modules.get("palimpsest.llm.tokens")
    if held is not None and held.encoder.cache_info().currsize:
        held.encoder.cache_clear()
        give_back()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def narrow(spark: SparkSession) -> int:
    """Tasks that write a table of short rows: an eighth of the shuffle's, as opening and closing a file takes longer than they do."""
    return max(2 * spark.sparkContext.defaultParallelism, shuffle_width(spark) // 8)


def one_text_per_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, under fixed names; extra columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
