"""A commit log for tables: readers see the files of one commit, writers change them in one step.

``root/_log`` holds one small file per version, which names what is live. A writer notes the version it has read, writes its
data to folders that no reader knows, and commits by creating the next version's file, which must not exist yet: the
second of two writers fails with ``Clash`` and starts over from what the first one left. A writer that dies leaves the last
version as it was. ``clean`` removes what no recent version names, by age.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.operators.windows import first_per_key
from lookout.session import settled

BUCKETS = 64
BUCKET = "__bucket"
TRIES = 10


class Clash(RuntimeError):
    """Another writer has committed the version that this one was about to write."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _entries(spark: SparkSession, folder: str) -> list:
    store, where = _path(spark, folder)
    return list(store.listStatus(where)) if store.exists(where) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    names = [e.getPath().getName() for e in _entries(spark, f"{root}/_log")]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """The latest version (or one named) and its state; version 0 and an empty state before the first commit."""
    found = versions(spark, root)
    if not found:
        return 0, {}
    chosen = found[-1] if version is None else version
    store, where = _path(spark, f"{root}/_log/{chosen:020d}.json")
    stream = store.open(where)
    try:
        return chosen, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, seen: int, state: dict) -> int:
    """Make ``state`` the version after ``seen``. The file is written beside and renamed, so it is seen whole or not at all."""
    store, beside = _path(spark, f"{root}/_log/.{uuid.uuid4().hex}")
    out = store.create(beside, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(beside, jvm.org.apache.hadoop.fs.Path(f"{root}/_log/{seen + 1:020d}.json"), plain)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise Clash(f"version {seen + 1} of {root} was written by another") from None
    finally:
        if store.exists(beside):
            store.delete(beside, False)
    return seen + 1


def committed(spark: SparkSession, root: str, change: Callable[[int, dict], dict], tries: int = TRIES) -> int:
    """Commit what ``change`` makes of the latest state, starting over when another writer was faster."""
    for left in reversed(range(tries)):
        seen, state = current(spark, root)
        after = change(seen, state)
        try:
            return commit(spark, root, seen, after)
        except Clash:
            if not left:
                raise
    raise AssertionError("no tries")


def clean(spark: SparkSession, root: str, keep: int = 2, older_than: float = 3600.0) -> list[str]:
    """Remove data folders that none of the last ``keep`` versions names, and older versions, once they are ``older_than`` seconds
    old: a reader of an earlier version, and a writer that has not committed yet, have that long to finish."""
    found, until = versions(spark, root), (time.time() - older_than) * 1000
    named = {path.split("/")[1] for v in found[-keep:] for path in paths_of(current(spark, root, v)[1])}
    gone = []
    old = [e for e in _entries(spark, f"{root}/data") if e.getPath().getName() not in named]
    old += [e for e in _entries(spark, f"{root}/_log") if e.getPath().getName()[:-5] in {f"{v:020d}" for v in found[:-keep]}]
    for entry in old:
        if entry.getModificationTime() < until:
            store, where = _path(spark, entry.getPath().toString())
            store.delete(where, True)
            gone.append(where.getName())
    return gone


def paths_of(state: dict) -> list[str]:
    return [p for bucket in state.get("live", {}).values() for p in bucket]


# --- keyed tables ------------------------------------------------------------------------


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the latest version, or of one named."""
    _, state = current(spark, root, version)
    return _read(spark, root, state, paths_of(state))


def _read(spark: SparkSession, root: str, state: dict, paths: Sequence[str]) -> DataFrame:
    reader = spark.read.schema(state["schema"])
    return reader.parquet(*(f"{root}/{p}" for p in paths)) if paths else spark.createDataFrame([], state["schema"])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newer: str) -> DataFrame:
    """Latest row per key of both; a key that only ``old`` has stays. Ties go to ``new``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_per_key(both, keys, [F.desc(newer), F.desc("__new")]).drop("__new")


def upsert_table(new: DataFrame, root: str, keys: Sequence[str], newer: str, buckets: int = BUCKETS, tries: int = TRIES) -> DataFrame:
    """Bring rows into a keyed table, replacing older rows of the same key, and return the table as it is then.

    Rows lie in buckets by a hash of their key; only buckets that ``new`` touches are read and written anew. The number of
    buckets is that of the first upsert.
    """
    spark = new.sparkSession
    new = settled(new)  # read again by every try

    def change(seen: int, state: dict) -> dict:
        n = state.get("buckets", buckets)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        live = dict(state.get("live", {}))
        touched = [str(r[0]) for r in new.select(bucket).distinct().collect()]  # at most n
        schema = state.get("schema", ddl_of(new))
        if not touched:
            return {"buckets": n, "schema": schema, "live": live}
        known = [p for b in touched for p in live.get(b, [])]
        rows = upsert(_read(spark, root, state, known) if known else new.limit(0), new, keys, newer)
        folder = f"data/{seen + 1}-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
        live.update({b: [f"{folder}/{BUCKET}={b}"] for b in touched})
        return {"buckets": n, "schema": schema, "live": live}

    return read_table(spark, root, committed(spark, root, change, tries))


def ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
