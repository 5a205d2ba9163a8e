"""Session helpers: the shared scratch folder and reading the input tables."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []
_own = threading.local()


def _paths() -> list[str]:
    """The work tables made so far; a thread that was given a list of its own has its own."""
    return getattr(_own, "made", _made)


def own_work_tables() -> None:
    """From now on ``work_tables`` in this thread removes only what this thread made."""
    _own.made = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and work tables.

    It is the one named in ``spark.checkpoint.dir``. Only on a single machine, where that is
    unset (tests), a new folder under /tmp takes its place; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path for a work table, never used before; below ``folder``, if it is named."""
    path = f"{folder or shared_folder(spark)}/lookout-{name}-{uuid.uuid4().hex}"
    _paths().append(path)
    return path


@contextmanager
def work_tables(spark: SparkSession, removing: AbstractContextManager | None = None) -> Iterator[None]:
    """Removes the work tables made inside when the block ends; results must be written or read by then. ``removing`` is held meanwhile."""
    made = _paths()
    start = len(made)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        with removing or nullcontext():
            for path in made[start:]:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        del made[start:]


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once in the shared folder and go on from the written rows.

    Used where several later steps read the same costly rows. Survives the loss
    of executors, since nothing is kept on them.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_alone(spark: SparkSession, made: Callable[[], DataFrame]) -> DataFrame:
    """``settled`` rows of ``made``, without the work tables that were written on the way to them, nor their shuffle files, which Spark
    removes when the driver has collected its garbage."""
    path = scratch_path(spark, "settled")
    with work_tables(spark):
        df = made()
        df.write.parquet(path)
        schema = df.schema
    del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
