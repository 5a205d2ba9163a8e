"""Tables behind a commit log: races, losses midway, and what an upsert rewrites."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from lookout.sources import commits
from lookout.streaming import jobs as st

SCHEMA = "k string, at int, v double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def some(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def failing(df):
    """The rows, but the job that computes them dies midway."""
    return df.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("double"))


def test_upserts_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    assert commits.current(spark, root) == (0, {})
    for at, value in ((1, 1.0), (2, 2.0), (3, 3.0)):
        now = commits.upsert_table(some(spark, ("a", at, value), (f"only{at}", at, value)), root, ["k"], "at", buckets=4)
    want = [("a", 3, 3.0), ("only1", 1, 1.0), ("only2", 2, 2.0), ("only3", 3, 3.0)]
    assert rows(now) == rows(commits.read_table(spark, root)) == want
    assert rows(commits.read_table(spark, root, 1)) == [("a", 1, 1.0), ("only1", 1, 1.0)]
    older = commits.upsert_table(some(spark, ("a", 0, 9.0), ("a", -1, 8.0)), root, ["k"], "at")
    assert rows(older) == want and commits.versions(spark, root) == [1, 2, 3, 4]
    assert rows(commits.upsert_table(spark.createDataFrame([], SCHEMA), root, ["k"], "at")) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    commits.upsert_table(spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("at"), F.lit(0.0).alias("v")), root, ["k"], "at", buckets=16)
    before = commits.current(spark, root)[1]["live"]
    assert len(before) == 16
    commits.upsert_table(some(spark, ("7", 2, 5.0)), root, ["k"], "at")
    after = commits.current(spark, root)[1]["live"]
    assert sum(before[b] != after[b] for b in before) == 1
    table = commits.read_table(spark, root)
    assert table.count() == 500 and rows(table.where("v > 0")) == [("7", 2, 5.0)]


def test_the_second_of_two_writers_starts_over(spark, tmp_path, monkeypatch):
    """Another upsert commits between reading and committing: both end up in the table."""
    root = str(tmp_path / "t")
    commits.upsert_table(some(spark, ("a", 1, 1.0), ("b", 1, 1.0)), root, ["k"], "at", buckets=2)
    plain, raced = commits.commit, []

    def commit(spark, root, seen, state):
        if not raced:
            raced.append(seen)
            monkeypatch.setattr(commits, "commit", plain)
            commits.upsert_table(some(spark, ("a", 2, 2.0), ("c", 2, 2.0)), root, ["k"], "at")
        return plain(spark, root, seen, state)

    monkeypatch.setattr(commits, "commit", commit)
    got = commits.upsert_table(some(spark, ("a", 3, 3.0), ("d", 3, 3.0)), root, ["k"], "at")
    assert rows(got) == [("a", 3, 3.0), ("b", 1, 1.0), ("c", 2, 2.0), ("d", 3, 3.0)]
    assert commits.versions(spark, root) == [1, 2, 3]
    with pytest.raises(commits.Clash):
        plain(spark, root, 2, {})
    with pytest.raises(commits.Clash):
        commits.committed(spark, root, lambda seen, state: plain(spark, root, seen, state) and state, tries=2)


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    commits.upsert_table(some(spark, ("a", 1, 1.0)), root, ["k"], "at", buckets=2)
    with pytest.raises(Exception, match="lost"):
        commits.upsert_table(failing(some(spark, ("a", 2, 2.0), ("b", 2, 2.0))), root, ["k"], "at")
    assert rows(commits.read_table(spark, root)) == [("a", 1, 1.0)]
    assert rows(commits.upsert_table(some(spark, ("b", 2, 2.0)), root, ["k"], "at")) == [("a", 1, 1.0), ("b", 2, 2.0)]


def test_clean_keeps_what_is_named_or_young(spark, tmp_path):
    root = str(tmp_path / "t")
    for at in range(1, 5):
        commits.upsert_table(some(spark, ("a", at, float(at)), ("b", 1, 1.0) if at == 1 else ("a", at, float(at))), root, ["k"], "at", buckets=2)
    assert commits.clean(spark, root) == [] and len(glob.glob(f"{root}/data/*")) == 4
    gone = commits.clean(spark, root, keep=1, older_than=-60)
    assert gone and commits.versions(spark, root) == [4]
    assert rows(commits.read_table(spark, root)) == [("a", 4, 4.0), ("b", 1, 1.0)]
    named = {p.split("/")[1] for p in commits.paths_of(commits.current(spark, root)[1])}
    assert {os.path.basename(p) for p in glob.glob(f"{root}/data/*")} == named


@pytest.fixture()
def history(spark, tmp_path):
    path = str(tmp_path / "base")
    for batch, values in enumerate([[("a", 1, 1.0), ("b", 1, 5.0)], [("a", 2, 2.0)], [("c", 1, 9.0)]]):
        st.batch_folder(path)(spark.createDataFrame(values, "k string, total_samples long, base double"), batch)
    return path


WANT = [("a", 2, 2.0), ("b", 1, 5.0), ("c", 1, 9.0)]


def test_compaction_that_dies_leaves_the_history(spark, history, monkeypatch):
    latest = st.latest_state
    monkeypatch.setattr(st, "latest_state", lambda *a: latest(*a).withColumn("base", F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("base")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        st.compact_baseline(spark, history, "k")
    monkeypatch.setattr(st, "latest_state", latest)
    assert rows(st.current_baseline(spark, history, "k", 1)) == WANT and st.batches_of(spark, history) == [0, 1, 2]
    st.compact_baseline(spark, history, "k")
    assert rows(st.current_baseline(spark, history, "k", 1)) == WANT and st.batches_of(spark, history) == []


def test_merged_batches_are_not_read_twice(spark, history):
    """The commit is there, but a merged batch was not removed, or is run again by the stream: the state stays."""
    st.compact_baseline(spark, history, "k")
    st.batch_folder(history)(spark.createDataFrame([("c", 1, 9.0)], "k string, total_samples long, base double"), 2)
    assert rows(st.current_baseline(spark, history, "k", 1)) == WANT
    st.batch_folder(history)(spark.createDataFrame([("c", 2, 10.0)], "k string, total_samples long, base double"), 3)
    assert rows(st.current_baseline(spark, history, "k", 1)) == [*WANT[:2], ("c", 2, 10.0)]
    st.compact_baseline(spark, history, "k")
    assert rows(st.current_baseline(spark, history, "k", 1)) == [*WANT[:2], ("c", 2, 10.0)]
