from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lookout.operators.aggregates import user_baseline
from lookout.schemas import EVENTS
from lookout.streaming import jobs as st

START = dt.datetime(2024, 1, 1)


def event(i, user, minutes, value=1.0):
    return (i, START + dt.timedelta(minutes=minutes), user, "view", float(value), "{}")


def write(spark, folder, name, events):
    spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / "in")


def stream(spark, folder):
    # One file per batch, in the order they were written.
    return st.event_stream(spark, f"{folder}/*.parquet", 1)


def test_append_once_and_restart(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write(spark, folder, "a", [event(i, 1, i) for i in range(5)])
    st.finish(st.append_to_table(stream(spark, folder), out, state))
    st.finish(st.append_to_table(stream(spark, folder), out, state))  # nothing new
    assert spark.read.parquet(out).count() == 5
    write(spark, folder, "b", [event(i, 2, i) for i in range(5, 8)])
    st.finish(st.append_to_table(stream(spark, folder), out, state))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_running_baseline_equals_batch(spark, folder, tmp_path):
    path, state = str(tmp_path / "base"), str(tmp_path / "state")
    events = [event(i, i % 3, i, i * i % 17) for i in range(40)]
    for n, part in enumerate((events[:10], events[10:25], events[25:])):
        write(spark, folder, f"f{n}", part)
        st.finish(st.running_baseline(stream(spark, folder), "user_id", {"base": "value"}, path, state))
    got = sorted(map(tuple, st.current_baseline(spark, path, "user_id", 14).collect()))
    batch = user_baseline(spark.createDataFrame(events, EVENTS), "user_id", {"base": "value"}, 14)
    assert [g[:2] for g in got] == [w[:2] for w in sorted(map(tuple, batch.collect()))] == [(0, 14)]
    assert got[0][2] == pytest.approx(batch.first()["base"])


def test_a_batch_run_again_replaces_its_folder(spark, tmp_path):
    write_batch = st.batch_folder(str(tmp_path / "t"))
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    write_batch(rows, 0)
    write_batch(rows, 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_late_rows_are_dropped_and_counted(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    late = st.LateRows.attached(spark)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")

    def run():
        s = stream(spark, folder).withWatermark("ts", "1 hour")
        return st.finish(st.append_to_table(st.windowed(s, "user_id", "ts", "value", "1 hour"), out, state))

    write(spark, folder, "a", [event(0, 1, 10), event(1, 1, 70), event(2, 1, 400)])
    run()
    write(spark, folder, "b", [event(3, 1, 20), event(4, 1, 500)])  # the first is hours too late
    try:
        assert late.of(run()) == 1
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(late)
    got = sorted((r["start"], r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [(START, 1), (START + dt.timedelta(hours=1), 1), (START + dt.timedelta(hours=6), 1)]


def test_daily_gate(spark, folder, tmp_path):
    write(spark, folder, "a", [event(0, 1, 0), event(1, 1, 60), event(2, 2, 60), event(3, 1, 1500)])
    first = st.first_of_day(stream(spark, folder), "user_id", "ts", "2 days").select("user_id", "day")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    st.finish(st.append_to_table(first, out, state))
    write(spark, folder, "b", [event(4, 1, 90), event(5, 2, 1501)])  # the first: same day again
    first = st.first_of_day(stream(spark, folder), "user_id", "ts", "2 days").select("user_id", "day")
    st.finish(st.append_to_table(first, out, state))
    got = sorted((r["user_id"], r["day"].day) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_sessions_merge_across_batches(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        s = stream(spark, folder).withWatermark("ts", "1 hour")
        st.finish(st.append_to_table(st.sessions(s, "user_id", "ts", "30 minutes"), out, state))

    write(spark, folder, "a", [event(0, 1, 0), event(1, 1, 20)])
    run()
    write(spark, folder, "b", [event(2, 1, 50), event(3, 1, 81), event(4, 1, 400)])
    run()
    got = sorted((r["start"], r["n"]) for r in spark.read.parquet(out).collect())
    # A pause of exactly the gap (20 to 50) does not end a session.
    assert got == [(START, 3), (START + dt.timedelta(minutes=81), 1)]


def test_alerts_are_flagged_scored_and_decided(spark, folder, tmp_path):
    write(spark, folder, "a", [event(0, 1, 0, 1), event(1, 1, 1, 4), event(2, 1, 2, 9), event(3, 2, 3, 0.1)])
    base = spark.createDataFrame([(1, 10.0)], "user_id long, base double")

    def predict(df):
        share = F.try_divide(F.col("value"), F.col("base"))
        return df.withColumn("model_risk", F.when(share < 0.25, "High").when(share < 0.5, "Medium").otherwise("Low"))

    judged = st.alerts(stream(spark, folder), base, "user_id", ["event_id"], {"pitch_drop": ("value", "base")}, predict)
    path = str(tmp_path / "alerts")
    st.finish(st.write_batches(judged, st.batch_folder(path), str(tmp_path / "state")))
    rows = {r["event_id"]: r for r in spark.read.parquet(path).collect()}
    got = {i: (r["pitch_drop"], r["risk_level"], r["mental_health_status"], len(r["recommendations"])) for i, r in rows.items()}
    assert got == {
        0: (True, "High", "Unhealthy", 4),
        1: (True, "Medium", "Needs Attention", 3),
        2: (False, "Low", "Healthy", 2),
        3: (False, "Low", "Healthy", 2),
    }
    assert [i for i, r in rows.items() if r["base"] is None] == [3]


def test_a_gate_shorter_than_a_day_is_refused(spark, folder):
    write(spark, folder, "a", [event(0, 1, 0)])
    with pytest.raises(ValueError, match="day"):
        st.first_of_day(stream(spark, folder), "user_id", "ts", "1 hour")


def test_a_stream_of_nothing_says_so(spark, tmp_path):
    spark.createDataFrame([], EVENTS).limit(0).write.parquet(str(tmp_path / "gone"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        st.event_stream(spark, str(tmp_path / "none"))


def test_compaction_keeps_the_latest_state(spark, folder, tmp_path):
    path, state = str(tmp_path / "base"), str(tmp_path / "state")
    for n in range(3):
        write(spark, folder, f"f{n}", [event(10 * n + i, i % 2, i, n) for i in range(4)])
        st.finish(st.running_baseline(stream(spark, folder), "user_id", {"base": "value"}, path, state))
    before = sorted(map(tuple, st.current_baseline(spark, path, "user_id", 1).collect()))
    st.compact_baseline(spark, path, "user_id")
    assert st.batches_of(spark, path) == [] and st.latest_state(spark, path, "user_id").count() == 2
    assert sorted(map(tuple, st.current_baseline(spark, path, "user_id", 1).collect())) == before
    write(spark, folder, "f9", [event(90, 0, 5, 9)])
    st.finish(st.running_baseline(stream(spark, folder), "user_id", {"base": "value"}, path, state))
    after = {r["user_id"]: r["total_samples"] for r in st.current_baseline(spark, path, "user_id", 1).collect()}
    assert after == {0: 7, 1: 6}


STREAMED = ["incremental_sink", "stream_append", "stream_baseline", "stream_daily_dedup", "stream_tumbling", "stream_sliding", "stream_sessions", "stream_alerts", "stream_state_baseline", "stream_alerts_as_of"]


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """The smallest tables as folders of four part files, the events in the order of time."""
    out = str(tmp_path_factory.mktemp("parted"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    bounds = events.selectExpr("percentile_approx(ts, array(0.25, 0.5, 0.75))").first()[0]
    for low, high in zip([None, *bounds], [*bounds, None]):  # one after the other: a stream takes the oldest file first
        part = events if low is None else events.filter(F.col("ts") > low)
        part = part if high is None else part.filter(F.col("ts") <= high)
        part.coalesce(1).write.mode("append").parquet(f"{out}/events.parquet")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", STREAMED)
def test_registered_streams_read_folder_tables_in_batches(spark, parted, name, monkeypatch):
    import duckdb

    from compare import compare

    read = st.file_stream
    monkeypatch.setattr(st, "file_stream", lambda spark, path, schema, files_per_batch=1, may_be_empty=False: read(spark, path, schema, 1, may_be_empty))
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{parted}/{t}.parquet/*.parquet'")
    ok, note = compare(spark, con, parted, name)
    assert ok, note
