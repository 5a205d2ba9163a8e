"""Jobs over arriving records: append, running baseline, daily gate, windows, sessions, alerts.

Rows behind the watermark are dropped; ``LateRows`` counts them. State and output lie in the shared folder, so a job
goes on from its checkpoint after a loss. State is kept in RocksDB, off the executor heap (``durable_state``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lookout.operators import decide
from lookout.operators.relational import known_number
from lookout.operators.scan import many_to_one
from lookout.operators.windows import first_per_key
from lookout.schemas import EVENTS
from lookout.sources import commits

Write = Callable[[DataFrame, int], None]


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def durable_state(spark: SparkSession) -> None:
    """Streaming state in RocksDB, with changes written as a log: it may outgrow the heap of the executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1_000, may_be_empty: bool = False
) -> DataFrame:
    """Rows of the files of a table that are there or arrive. ``path`` is a file, a folder of part files or a pattern.

    A path without any file is an error, unless the folder is meant to fill up later (``may_be_empty``).
    """
    durable_state(spark)
    if not may_be_empty and not spark.read.schema(schema).parquet(path).inputFiles():
        raise FileNotFoundError(f"no file to stream at {path}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_file(spark, path):  # a stream watches folders
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder or "/")
    return reader.parquet(path)


def is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(store.exists(where)) and bool(store.getFileStatus(where).isFile())


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000, may_be_empty: bool = False) -> DataFrame:
    """Events with a time-zoned timestamp, as watermarks need it."""
    return file_stream(spark, path, EVENTS, files_per_batch, may_be_empty).withColumn("ts", F.col("ts").cast("timestamp"))


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every arriving row goes to a Parquet table exactly once; ends when all present files are read."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def write_batches(stream: DataFrame, write: Write, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_folder(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Write:
    """Writes a batch to a folder of its own. A batch that is run again replaces its folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop for lateness, over all their batches.

    Attach it before the query starts: ``late = LateRows.attached(spark)``; ``late.of(query)`` waits for the end of
    the query's events.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    @classmethod
    def attached(cls, spark: SparkSession) -> LateRows:
        listener = cls()
        spark.streams.addListener(listener)
        return listener

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, seconds: float = 60.0) -> int:
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError("the query has not ended")
            time.sleep(0.05)
        return self.dropped[str(query.runId)]


# --- per-subject state -----------------------------------------------------------------


def running_baseline(stream: DataFrame, key: str, measures: Mapping[str, str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps count and mean per subject. Each batch writes the subjects it changed."""
    means = [F.avg(known_number(F.col(c))).alias(o) for o, c in measures.items()]
    state = stream.groupBy(key).agg(F.count(F.lit(1)).alias("total_samples"), *means)
    return write_batches(state, batch_folder(path), checkpoint, "update")


def latest_state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last written state per subject, from the compacted part and the batches after it."""
    _, state = commits.current(spark, path)
    upto = state.get("upto", -1)
    # A stream writes batches as folders; those that are merged are no longer read, whether or not they are removed yet.
    later = [b for b in batches_of(spark, path) if b > upto]
    parts = [spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in later))] if later else []
    if state:
        parts.append(spark.read.parquet(*(f"{path}/{p}" for p in commits.paths_of(state))))
    if not parts:
        raise FileNotFoundError(f"no batch of a stream at {path}")
    rows = [p.withColumn("batch", F.col("batch").cast("long")) for p in parts]
    return first_per_key(reduce(DataFrame.unionByName, rows), [key], [F.desc("batch")])


def batches_of(spark: SparkSession, path: str) -> list[int]:
    names = [e.getPath().getName() for e in commits._entries(spark, path)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def compact_baseline(spark: SparkSession, path: str, key: str) -> None:
    """Merge the batch folders into one table of the latest state per subject, between two runs of the stream.

    The merged rows are written beside the history and take its place with one commit; only then are the merged batches
    removed. A loss at any point leaves the history as it was. Of two compactions at once the second fails.
    """
    done = batches_of(spark, path)
    seen, state = commits.current(spark, path)
    upto = max([state.get("upto", -1), *done])
    folder = f"data/{seen + 1}-{uuid.uuid4().hex}"
    latest_state(spark, path, key).write.parquet(f"{path}/{folder}")
    commits.commit(spark, path, seen, {"upto": upto, "live": {"all": [folder]}})
    for batch in done:
        store, where = commits._path(spark, f"{path}/batch={batch}")
        store.delete(where, True)
    commits.clean(spark, path)


def current_baseline(spark: SparkSession, path: str, key: str, min_rows: int) -> DataFrame:
    """Latest state per subject, for those with at least ``min_rows`` records."""
    return latest_state(spark, path, key).drop("batch").filter(F.col("total_samples") >= min_rows)


def first_of_day(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """One row per subject and day; further rows of that day are dropped. ``delay`` is a day at least, else the
    state of a day could go before the day is over."""
    days = stream.sparkSession.range(1).select(F.expr(f"INTERVAL {delay}") >= F.expr("INTERVAL 1 day")).first()[0]
    if not days:
        raise ValueError("the delay must cover a day")
    return (
        stream.withColumn("day", F.to_date(ts))
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark([key, "day"])
    )


# --- windows ---------------------------------------------------------------------------


def windowed(df: DataFrame, key: str, ts: str, value: str, width: str, slide: str | None = None) -> DataFrame:
    """Count and mean per subject and tumbling or sliding window. Works on streams and tables."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = df.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(known_number(F.col(value))).alias("mean_value"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value")


def sessions(stream: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Activity sessions, closed by a pause of more than ``gap``. ``end`` is the last event plus the gap.

    Events are first merged where they were read, so a busy subject sends sessions and not events.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    out = stream.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# --- alerts ----------------------------------------------------------------------------


def alerts(
    stream: DataFrame,
    baseline: DataFrame,
    key: str,
    spread_by: Sequence[str],
    flags: dict[str, tuple[str, str]],
    predict: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Each arrival against its subject's baseline, scored and decided: trend flags, class, status, advice.

    ``flags`` maps a trend flag to (current, baseline) columns; ``predict`` adds ``model_risk``, from a model or from
    rules. A subject without a baseline sets no flag that compares with one.
    """
    joined = many_to_one(stream, baseline, [key], "left", spread_by)
    scored = predict(joined.withColumns(decide.trend_flags(flags)))
    return decide.fallback_decision(scored, "model_risk")
