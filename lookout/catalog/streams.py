"""Queries: streams run over all present files, their batch twins, user functions, whole jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.catalog.histories import GROWING, past
from lookout.catalog.records import FLAGS, day_text
from lookout.catalog.registry import query
from lookout.catalog.signals import BATCHES_PER_PART, count_of_parts, dealt, of_all_parts, recordings_in
from lookout.catalog.tables import TOKENS, r6
from lookout.functions import text as tx
from lookout.operators import decide
from lookout.operators import userfunctions as uf
from lookout.operators.aggregates import user_baseline
from lookout.operators.windows import first_per_key, latest_per_key
from lookout.plans import jobs
from lookout.plans import views as v
from lookout.session import scratch_path, table
from lookout.streaming import jobs as st
from lookout.streaming import state

DELAY, DELAY_SQL = "2 days", "INTERVAL 2 DAY"


def to_table(stream, name):
    """Run a stream over all present files into a table and read the table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    st.finish(st.append_to_table(stream, path, scratch_path(spark, f"{name}-state")))
    return spark.read.schema(stream.schema).parquet(path)


def micros(df, *columns):
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@query("incremental_sink", f"SELECT doc_id, len({TOKENS}) AS words FROM documents")
def incremental_sink(spark, d):
    """Text measures written batch by batch, so that what is done stays done."""
    schema = table(spark, d, "documents").schema
    stream = st.file_stream(spark, f"{d}/documents.parquet", schema, 10)
    measured = stream.select("doc_id", tx.word_count(F.col("text")).cast("bigint").alias("words"))
    path = scratch_path(spark, "measures")
    st.finish(st.write_batches(measured, st.batch_folder(path), scratch_path(spark, "measures-state")))
    return spark.read.parquet(path).drop("batch")


@query("stream_append", "SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS ts FROM events")
def stream_append(spark, d):
    return micros(to_table(st.event_stream(spark, f"{d}/events.parquet"), "append"), "ts")


@query(
    "stream_baseline",
    """SELECT user_id, count(*) AS total_samples, round(avg(value), 6) AS base_value FROM events
      GROUP BY 1 HAVING count(*) >= 60""",
)
def stream_baseline(spark, d):
    path = scratch_path(spark, "running")
    stream = st.event_stream(spark, f"{d}/events.parquet")
    st.finish(st.running_baseline(stream, "user_id", {"base_value": "value"}, path, scratch_path(spark, "running-state")))
    return st.current_baseline(spark, path, "user_id", 60).withColumn("base_value", r6("base_value"))


DAILY = "SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events"


@query("stream_daily_dedup", DAILY)
def stream_daily_dedup(spark, d):
    first = st.first_of_day(st.event_stream(spark, f"{d}/events.parquet"), "user_id", "ts", DELAY)
    return day_text(to_table(first.select("user_id", "day"), "daily"))


@query(
    "daily_first",
    """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1""",
)
def daily_first(spark, d):
    """The batch form of the daily gate, which can also say which row it keeps: here the last of the day."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"))
    return day_text(latest_per_key(e, ["user_id", "day"], "ts", "event_id").drop("ts"))


def window_sql(starts: str, days: int, closed: bool) -> str:
    closed_only = f"WHERE start + INTERVAL {days} DAY <= (SELECT max(ts) FROM events) - {DELAY_SQL}" if closed else ""
    return f"""WITH w AS (SELECT user_id, value, {starts} AS start FROM events),
      g AS (SELECT user_id, start, count(*) AS n, avg(value) AS m FROM w GROUP BY 1, 2)
      SELECT user_id, epoch_us(start) AS start, epoch_us(start + INTERVAL {days} DAY) AS "end", n,
        round(m, 6) AS mean_value FROM g {closed_only}"""


ONE_DAY = "date_trunc('day', ts)"
# A two-day window that starts every day holds an event twice: from its own day and from the day before.
TWO_DAYS = "unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])"


def rounded(df):
    return micros(df.withColumn("mean_value", r6("mean_value")), "start", "end")


def timed(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling", window_sql(ONE_DAY, 1, True))
def stream_tumbling(spark, d):
    stream = st.event_stream(spark, f"{d}/events.parquet").withWatermark("ts", DELAY)
    return rounded(to_table(st.windowed(stream, "user_id", "ts", "value", "1 day"), "tumbling"))


@query("tumbling_agg", window_sql(ONE_DAY, 1, False))
def tumbling_agg(spark, d):
    return rounded(st.windowed(timed(spark, d), "user_id", "ts", "value", "1 day"))


@query("stream_sliding", window_sql(TWO_DAYS, 2, True))
def stream_sliding(spark, d):
    stream = st.event_stream(spark, f"{d}/events.parquet").withWatermark("ts", DELAY)
    return rounded(to_table(st.windowed(stream, "user_id", "ts", "value", "2 days", "1 day"), "sliding"))


@query("sliding_agg", window_sql(TWO_DAYS, 2, False))
def sliding_agg(spark, d):
    return rounded(st.windowed(timed(spark, d), "user_id", "ts", "value", "2 days", "1 day"))


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER w AS pause FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(CASE WHEN pause IS NULL OR pause > INTERVAL 2 HOUR THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM e),
    g AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, no)
    SELECT user_id, epoch_us(first_ts) AS start, epoch_us(last_ts + INTERVAL 2 HOUR) AS "end", n FROM g
      WHERE last_ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def stream_sessions(spark, d):
    stream = st.event_stream(spark, f"{d}/events.parquet").withWatermark("ts", "1 day")
    return micros(to_table(st.sessions(stream, "user_id", "ts", "2 hours"), "sessions"), "start", "end")


# Rule thresholds for single events.
EVENT_RULES = (decide.Rule("value", "<", 10, 2), decide.Rule("value", "<", 30, 2), decide.Rule("hour", ">", 20, 1))
EVENT_FLAGS = {"pitch_drop": ("value", "base_value"), "slow_speech": ("hour", "base_hour"), "zcr_drop": ("length", "base_length")}


def event_measures(df, *more):
    return df.select("event_id", "user_id", *more, "value", F.hour("ts").cast("double").alias("hour"), F.length("props").cast("double").alias("length"))


@query(
    "stream_alerts",
    """WITH m AS (SELECT event_id, user_id, value, CAST(hour(ts) AS DOUBLE) AS h, CAST(length(props) AS DOUBLE) AS l FROM events),
    b AS (SELECT user_id, avg(value) AS bv, avg(h) AS bh, avg(l) AS bl FROM m GROUP BY 1 HAVING count(*) >= 60),
    j AS (SELECT m.*, coalesce(bv, 0) AS bv, coalesce(bh, 0) AS bh, coalesce(bl, 0) AS bl,
      CASE WHEN value < 10 THEN 2 ELSE 0 END + CASE WHEN value < 30 THEN 2 ELSE 0 END + CASE WHEN h > 20 THEN 1 ELSE 0 END AS score
      FROM m LEFT JOIN b USING (user_id)),
    k AS (SELECT *, CASE WHEN score >= 5 THEN 'High' WHEN score >= 2 THEN 'Medium' ELSE 'Low' END AS level FROM j)
    SELECT event_id, value < bv * 0.9 AS pitch_drop, h < bh * 0.85 AS slow_speech, l < bl * 0.8 AS zcr_drop, level AS risk_level,
      CASE level WHEN 'High' THEN 'Unhealthy' WHEN 'Medium' THEN 'Needs Attention' ELSE 'Healthy' END AS status,
      CASE level WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 ELSE 2 END AS n_tips FROM k""",
)
def stream_alerts(spark, d):
    measures = {base: now for now, base in EVENT_FLAGS.values()}
    base = user_baseline(event_measures(timed(spark, d)), "user_id", measures, 60)
    level = decide.class_name(decide.risk_class(decide.rule_score(EVENT_RULES)))
    stream = event_measures(st.event_stream(spark, f"{d}/events.parquet"))
    judged = st.alerts(stream, base, "user_id", ["event_id"], EVENT_FLAGS, lambda df: df.withColumn("model_risk", level))
    path = scratch_path(spark, "alerts")
    kept = ["event_id", *EVENT_FLAGS, "risk_level", F.col("mental_health_status").alias("status"), F.size("recommendations").alias("n_tips")]
    write = st.batch_folder(path, lambda df: df.select(*kept))
    st.finish(st.write_batches(judged, write, scratch_path(spark, "alerts-state")))
    return spark.read.parquet(path).drop("batch")


LIVE_FROM = "2024-01-24"  # the state starts from the records before; the later ones arrive day by day


def live_days(spark, d):
    """The later events as a stream of one file per day, in the order of time, and the earlier ones as a table."""
    e = timed(spark, d)
    path = scratch_path(spark, "arrivals")
    late = e.filter(F.col("ts") >= LIVE_FROM).withColumn("part", F.to_date("ts"))
    days = [r[0] for r in late.select("part").distinct().orderBy("part").collect()]
    middle = days[len(days) // 2] if days else None
    for later in (False, True):  # one after the other: a stream takes the oldest file first
        half = late.filter((F.col("part") >= F.lit(middle)) == F.lit(later)).drop("part")
        half.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(path)
    return st.event_stream(spark, path, 1_000), e.filter(F.col("ts") < LIVE_FROM)


@query(
    "stream_state_baseline",
    """SELECT user_id, count(*) AS baseline_n, round(avg(value), 6) AS base_value FROM events GROUP BY 1
      HAVING count(*) FILTER (ts >= TIMESTAMP '2024-01-24') > 0""",
)
def stream_state_baseline(spark, d):
    """The last state of every subject that arrives, started from the records of a table."""
    arriving, known = live_days(spark, d)
    measures = {"base_value": "value"}
    stream = state.with_baseline(arriving.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "event_id", measures, state.state_of(known, "user_id", measures))
    rows = to_table(stream, "state-baseline")
    last = first_per_key(rows, ["user_id"], [F.desc("baseline_n")])
    return last.select("user_id", "baseline_n", r6("base_value").alias("base_value"))


@query(
    "stream_alerts_as_of",
    """WITH m AS (SELECT event_id, user_id, ts, value, CAST(hour(ts) AS DOUBLE) AS h, CAST(length(props) AS DOUBLE) AS l FROM events),
    b AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS bv, avg(h) OVER w AS bh, avg(l) OVER w AS bl,
      CASE WHEN value < 10 THEN 2 ELSE 0 END + CASE WHEN value < 30 THEN 2 ELSE 0 END + CASE WHEN h > 20 THEN 1 ELSE 0 END AS score
      FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, n AS baseline_n, n >= 5 AND value < bv * 0.9 AS pitch_drop, n >= 5 AND h < bh * 0.85 AS slow_speech,
      n >= 5 AND l < bl * 0.8 AS zcr_drop, CASE WHEN score >= 5 THEN 'High' WHEN score >= 2 THEN 'Medium' ELSE 'Low' END AS risk_level
    FROM b WHERE ts >= TIMESTAMP '2024-01-24'""",
)
def stream_alerts_as_of(spark, d):
    """Every arrival judged against its subject's baseline of that moment."""
    arriving, known = live_days(spark, d)
    measures = {base: now for now, base in EVENT_FLAGS.values()}
    level = decide.class_name(decide.risk_class(decide.rule_score(EVENT_RULES)))
    stream = event_measures(arriving, "ts")
    judged = state.alerts_as_of(
        stream, "user_id", "ts", "event_id", EVENT_FLAGS, lambda df: df.withColumn("model_risk", level), state.state_of(event_measures(known), "user_id", measures)
    )
    return to_table(judged.select("event_id", "baseline_n", *EVENT_FLAGS, "risk_level"), "alerts-as-of")


# --- user functions --------------------------------------------------------------------


@query(
    "udf_scalar",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS risk FROM events""",
)
def udf_scalar(spark, d):
    def risk(types: pd.Series) -> pd.Series:
        return types.map({"error": 2, "signup": 1}).fillna(0).astype("int32")

    return table(spark, d, "events").select("event_id", uf.map_column(risk, T.IntegerType(), "event_type").alias("risk"))


@query(
    "udf_batches",
    f"""WITH {v.FR} SELECT vec_id, round(list_max(samples) - list_min(samples), 6) AS span FROM fr
      WHERE list_max(samples) > 0.5""",
)
def udf_batches(spark, d):
    """A function that gets a batch of frames and returns fewer rows than it got."""

    def span(batch: pd.DataFrame) -> pd.DataFrame:
        frames = np.vstack(batch["samples"])
        top = frames.max(axis=1)
        return pd.DataFrame({"vec_id": batch["vec_id"], "span": top - frames.min(axis=1)})[top > 0.5]

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("span", T.DoubleType())])
    out = uf.map_batches(v.frames(spark, d).select("vec_id", "samples"), span, schema)
    return out.withColumn("span", r6("span"))


@query(
    "udf_grouped",
    "SELECT user_id, round(regr_slope(value, day(ts)), 6) AS slope FROM events GROUP BY 1",
)
def udf_grouped(spark, d):
    """Slope of the value over the day of the month per user, from sums over parts of the user's rows."""

    def sums(part: pd.DataFrame) -> dict[str, float]:
        x, y = part["x"], part["value"]
        return {"n": len(part), "sx": x.sum(), "sy": y.sum(), "sxx": (x * x).sum(), "sxy": (x * y).sum()}

    rows = table(spark, d, "events").select("user_id", "value", F.dayofmonth("ts").cast("double").alias("x"))
    s = uf.group_partials(rows, ["user_id"], sums, ["n", "sx", "sy", "sxx", "sxy"])
    slope = F.try_divide(
        F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    )
    return s.select("user_id", r6(slope).alias("slope"))


# --- whole jobs ------------------------------------------------------------------------


@query(
    "batch_decisions",
    f"""WITH {v.UD}, good AS (SELECT * FROM ud WHERE day <> DATE '2024-01-03'),
    b AS (SELECT good.*, {past('CURRENT ROW')} FROM good)
    SELECT user_id, CAST(day AS VARCHAR) AS day, baseline_n, coalesce(level_mean < base_level * 0.9, false) AS pitch_drop,
      CASE {v.UD_CLASS} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS risk_level,
      CASE {v.UD_CLASS} WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS n_tips, NULL AS failure FROM b
    UNION ALL SELECT user_id, CAST(day AS VARCHAR), NULL, NULL, 'Error', 0, 'recording not found' FROM ud
      WHERE day = DATE '2024-01-03'""",
)
def batch_decisions(spark, d):
    """All user-days through baseline, flags, prediction and decision; one day has no recordings."""
    lost = F.when(F.col("day") == F.lit("2024-01-03").cast("date"), "recording not found")
    predicted = decide.class_name(decide.risk_class(decide.rule_score(v.USER_DAY_RULES)))
    out = jobs.batch_decisions(
        v.stored_days(spark, d).withColumn("error", lost),
        "user_id",
        ["day"],
        GROWING,
        FLAGS,
        lambda df: df.withColumn("model_risk", predicted),
    )
    failure = F.when(F.col("risk_level") == "Error", F.col("explanation"))
    out = out.select(
        "user_id", "day", "baseline_n", "pitch_drop", "risk_level", F.size("recommendations").alias("n_tips"), failure.alias("failure")
    )
    return day_text(out)


@query(
    "corpus_features",
    f"""WITH {v.TR}, w AS (SELECT conv_id, CAST(floor(start_time / 5) AS BIGINT) AS chunk_id, CAST(sum(len({TOKENS})) AS INT) AS words
      FROM utt GROUP BY 1, 2)
    SELECT CAST(vec_id AS VARCHAR) AS subject, c AS chunk_id, c * 5 AS chunk_start, coalesce(words, 0) AS word_count, NULL AS error
      FROM (SELECT vec_id, unnest(range(1 + vec_id % 2)) AS c FROM embeddings WHERE vec_id % 20 <> 0)
      LEFT JOIN w ON conv_id = vec_id AND chunk_id = c
    UNION ALL SELECT CAST(vec_id AS VARCHAR), NULL, NULL, NULL, 'other sample rate' FROM embeddings WHERE vec_id % 20 = 0""",
)
def corpus_features(spark, d):
    """Labelled chunk rows: recordings made from the vectors, transcripts from the conversations."""
    said = v.participants(spark, d).select(
        F.col("conv_id").cast("string").alias("subject"), "start_time", "turn", F.col("text").alias("value")
    )
    subject = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    # What was said comes with the part of its recording.
    said_in = dealt(said, F.col("subject"), count_of_parts(spark, d, BATCHES_PER_PART))

    def labelled_part(number, folder):
        labelled, rejects = jobs.corpus_features(recordings_in(spark, folder), subject, said_in(number), v.lexicon(spark))
        rows = labelled.filter("risk_label IS NOT NULL").select("subject", "chunk_id", "chunk_start", "word_count", F.lit(None).cast("string").alias("error"))
        return rows.unionByName(rejects.select(subject.alias("subject"), "error"), allowMissingColumns=True)

    return of_all_parts(spark, d, labelled_part)
