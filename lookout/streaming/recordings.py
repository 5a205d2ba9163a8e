"""Arriving recordings: measured batch by batch, then averaged and judged per subject.

A stream of files goes through the same frames and sums as the batch job, and every batch leaves one folder of feature rows and one of
rejected recordings with the reason; a batch that is run again replaces its folders. The feature rows are themselves a stream, which
``state`` takes up: an upload becomes feature rows, feature rows meet the baseline of the moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lookout.functions.signal import signal_features
from lookout.sources.files import SAMPLE_RATE
from lookout.streaming.jobs import durable_state, file_stream, write_batches

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def recording_stream(spark: SparkSession, folder: str, pattern: str = "*.wav", files_per_batch: int = 1_000) -> DataFrame:
    """The recordings that are below ``folder`` or arrive there, as ``read_recordings`` has them."""
    durable_state(spark)
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return stream.option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "length", "content")


def measure_recordings(
    stream: DataFrame, subject_of: Column, path: str, checkpoint: str, seconds: int = 5, rate: int = SAMPLE_RATE, resample: bool = True
) -> StreamingQuery:
    """Feature rows (subject, path, chunk_id, measures) in ``path/features`` and rejects (subject, path, error) in ``path/rejects``."""

    def write(batch: DataFrame, number: int) -> None:
        # Spark counts 4 MB for opening a file; recordings that are short and many are read by one task per core.
        batch = batch.coalesce(batch.sparkSession.sparkContext.defaultParallelism)
        features, rejects = signal_features(batch, seconds, rate, resample=resample)
        for name, rows in (("features", features), ("rejects", rejects)):
            rows.withColumn("subject", subject_of).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return write_batches(stream, write, checkpoint)


def measured(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(feature rows, rejected recordings) of all batches so far."""
    return tuple(spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("features", "rejects"))


def feature_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """The feature rows of ``measure_recordings`` as a stream."""
    schema = measured(spark, path)[0].schema
    return file_stream(spark, f"{path}/features/batch=*", schema, files_per_batch)

