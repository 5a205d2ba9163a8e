"""Baselines and alerts in one stateful pass, against the batch."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lookout.operators import decide
from lookout.operators.aggregates import user_baseline
from lookout.operators.windows import expanding_baseline
from lookout.schemas import EVENTS
from lookout.streaming import jobs as st
from lookout.streaming import state

START = dt.datetime(2024, 1, 1)
MEASURES = {"base": "value"}
FLAGS = {"pitch_drop": ("value", "base")}


def event(i, user, minutes, value):
    return (i, START + dt.timedelta(minutes=minutes), user, "view", value, "{}")


EVENTS_IN = [event(i, i % 4, 7 * i, [float(i * i % 23), None, float("nan")][0 if i % 9 else i % 2 + 1]) for i in range(90)]
EVENTS_IN += [event(90, None, 700, 3.0), event(91, None, 701, 5.0), event(92, 7, 702, float("nan")), event(93, 1, 7 * 89, 2.0)]
EVENTS_IN.sort(key=lambda e: (e[1], e[0]))


def write(spark, folder, name, events):
    spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def arrivals(spark, folder):
    return st.event_stream(spark, f"{folder}/*.parquet", 1).select("event_id", "user_id", "ts", "value")


def rounded(rows):
    return sorted(((r["event_id"], r["baseline_n"], None if r["base"] is None else round(r["base"], 9)) for r in rows), key=str)


def batch_rows(spark, inclusive=True):
    table = spark.createDataFrame(EVENTS_IN, EVENTS)
    return expanding_baseline(table, "user_id", ["ts", "event_id"], MEASURES, 3, inclusive)


@pytest.mark.parametrize("inclusive", [True, False])
def test_stream_equals_batch_over_restarts(spark, tmp_path, inclusive):
    """Three runs of several batches from one checkpoint lose and repeat nothing, and every row has the batch's baseline."""
    folder, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    for n, (a, b) in enumerate(((0, 20), (20, 25), (25, 60), (60, 61), (61, 200))):
        write(spark, folder, f"f{n}", EVENTS_IN[a:b])
        if n in (1, 2, 4):
            judged = state.with_baseline(arrivals(spark, folder), "user_id", "ts", "event_id", MEASURES, min_rows=3, inclusive=inclusive)
            st.finish(st.append_to_table(judged.drop("idle"), out, check))
    assert rounded(spark.read.parquet(out).collect()) == rounded(batch_rows(spark, inclusive).collect())


def test_state_starts_from_a_table(spark, tmp_path):
    """With the earlier records as initial state, the last rows equal the baselines of all records."""
    folder, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    known, new = EVENTS_IN[:50], EVENTS_IN[50:]
    write(spark, folder, "a", new[:30])
    write(spark, folder, "b", new[30:])
    initial = state.state_of(spark.createDataFrame(known, EVENTS), "user_id", MEASURES)
    judged = state.with_baseline(arrivals(spark, folder), "user_id", "ts", "event_id", MEASURES, initial, min_rows=1)
    st.finish(st.append_to_table(judged.drop("idle"), out, check))
    got = spark.read.parquet(out)
    late = {e[0] for e in new}
    want = [r for r in batch_rows(spark).withColumn("base", F.col("base")).collect() if r["event_id"] in late]
    assert sorted((r["event_id"], r["baseline_n"]) for r in got.collect()) == sorted((r["event_id"], r["baseline_n"]) for r in want)
    last = {}
    for r in got.collect():
        last[r["user_id"]] = max(last.get(r["user_id"], (0, None)), (r["baseline_n"], r["base"]), key=lambda v: v[0])
    whole = user_baseline(spark.createDataFrame(EVENTS_IN, EVENTS), "user_id", MEASURES, 1).collect()
    for r in whole:
        if r["user_id"] in last:
            assert last[r["user_id"]][0] == r["total_samples"] and last[r["user_id"]][1] == (None if r["base"] is None else pytest.approx(r["base"]))


def test_alerts_equal_the_batch(spark, tmp_path):
    """Flags and decisions of the stream equal those of the batch, row by row."""
    folder, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    write(spark, folder, "a", EVENTS_IN[:33])
    write(spark, folder, "b", EVENTS_IN[33:])

    def predict(df):
        return df.withColumn("model_risk", F.when(F.col("pitch_drop"), "High").otherwise("Low"))

    judged = state.alerts_as_of(arrivals(spark, folder), "user_id", "ts", "event_id", FLAGS, predict, min_rows=3)
    columns = ["event_id", "baseline_n", "pitch_drop", "risk_level", "mental_health_status"]
    st.finish(st.append_to_table(judged.select(*columns), out, check))
    batch = decide.fallback_decision(predict(batch_rows(spark).withColumns(decide.trend_flags(FLAGS))), "model_risk")
    got = [tuple(r) for r in spark.read.parquet(out).select(*columns).collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in batch.select(*columns).collect()), key=str)
    assert len({r[2] for r in got}) == 2


def test_idle_subjects_are_told_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))

    def run():
        late = arrivals(spark, folder).withWatermark("ts", "1 minute")
        judged = state.with_baseline(late, "user_id", "ts", "event_id", MEASURES, min_rows=1, idle=dt.timedelta(hours=1))
        st.finish(st.append_to_table(judged, out, check))

    write(spark, folder, "a", [event(1, 1, 0, 4.0), event(2, 1, 10, 8.0), event(3, 2, 10, 1.0)])
    run()
    write(spark, folder, "b", [event(4, 2, 60, 3.0)])
    run()
    write(spark, folder, "c", [event(5, 2, 100, 5.0)])
    run()
    idle = [(r["user_id"], r["baseline_n"], r["base"]) for r in spark.read.parquet(out).where("idle").collect()]
    assert idle == [(1, 2, 6.0)]
    assert sorted(r["event_id"] for r in spark.read.parquet(out).where("NOT idle").collect()) == [1, 2, 3, 4, 5]


class Held:
    """A value state, and the handle that gives it out."""

    def __init__(self):
        self.held = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_many_subjects_of_few_records():
    """A subject's records are taken row by row, so that many subjects of three records each take seconds."""
    processor, arrival = state.GrowingBaseline("user", [state.AT, "id"], {"base": "value"}, ["id", "user", "value"], True, None), Row("id", "user", "value", state.AT)
    began = time.process_time()
    for user in range(10_000):
        processor.init(Held())
        processor.handleInitialState((user,), Row(n=1, s_base=5.0, c_base=1), None)
        rows = [arrival(3, user, float("nan"), None), arrival(2, user, 4.0, 7), arrival(1, None, None, 7)]
        out = [r.asDict() for r in processor.handleInputRows((user,), iter(rows), None)]
        assert [(r["id"], r["value"], r["baseline_n"], r["base"]) for r in out[:2]] == [(1, None, 2, 5.0), (2, 4.0, 3, 4.5)]
        assert out[2]["id"] == 3 and out[2]["value"] != out[2]["value"] and out[2]["base"] == 4.5
        assert processor.state.get() == (4, 9.0, 2)
    assert time.process_time() - began < 10
