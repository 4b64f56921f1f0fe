"""Tables kept in the folder that all executors share, and the memory that Python workers give back."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes a plan's shuffle files when the plan has run; nothing reads them afterwards.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in this one process, as in tests, is it a folder of our own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(*tables: DataFrame) -> None:
    """Delete the files under staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(codecs: bool) -> None:
    """Give back what a worker, which goes on to other tasks, needn't keep: encoded chunks, free blocks of both allocators.

    codecs: keep the vocabularies themselves.
    """
    for module in ("_tokens", "bpe"):
        if found := sys.modules.get(f"{__package__}.{module}"):
            found.forget(codecs)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, codecs: bool = False) -> DataFrame:
    """``df.mapInArrow``, with the worker's memory given back when a task ends; codecs: tasks use vocabularies."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not codecs:  # those of another operator's tasks
            tidy(False)
        try:
            yield from run(batches)
        finally:
            tidy(codecs)

    return df.mapInArrow(whole, schema)
