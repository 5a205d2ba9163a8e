"""Queries: aggregates, labels, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.catalog.registry import query
from lookout.catalog.tables import BASE, BASE_SQL, past_tie, r6
from lookout.operators import aggregates as agg
from lookout.operators import decide
from lookout.operators import relational as rel
from lookout.plans import views as v
from lookout.session import table


def day_text(df):
    return df.withColumn("day", F.col("day").cast("string"))


# --- aggregates ------------------------------------------------------------------------


HOLED = "(SELECT * REPLACE (CASE WHEN event_id % 17 <> 0 THEN value END AS value) FROM events)"


def holed(spark, d):
    """Events, every seventeenth with NaN for a value: it must count as missing."""
    return table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 17 == 0, float("nan")).otherwise(F.col("value")))


def holed_days(spark, d):
    """User-days, every eleventh user with NaN for a level."""
    return v.stored_days(spark, d).withColumn("level_mean", F.when(F.col("user_id") % 11 == 0, float("nan")).otherwise(F.col("level_mean")))


HOLED_DAYS = "hd AS (SELECT * REPLACE (CASE WHEN user_id % 11 <> 0 THEN level_mean END AS level_mean) FROM ud)"


@query("group_mean", f"SELECT event_type, round(avg(value), 6) AS mean_value FROM {HOLED} GROUP BY 1 ORDER BY 2")
def group_mean(spark, d):
    means = agg.group_mean(holed(spark, d), "event_type", "value")
    return means.withColumn("mean_value", r6("mean_value"))


@query("value_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def value_counts(spark, d):
    return agg.value_counts(table(spark, d, "embeddings"), "label")


@query(
    "user_baseline",
    f"""WITH {v.UD}, {BASE_SQL} SELECT user_id, total_samples, round(base_level, 6) AS base_level,
      round(base_energy, 6) AS base_energy, round(base_rate, 6) AS base_rate,
      round(base_polarity, 6) AS base_polarity FROM bl""",
)
def user_baseline(spark, d):
    base = agg.user_baseline(v.user_day(spark, d), "user_id", BASE, 26)
    return base.select("user_id", "total_samples", *[r6(c).alias(c) for c in BASE])


@query(
    "uploaded_on_day",
    """SELECT user_id, max(CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS DATE) = DATE '2024-01-15'
      AS INT)) = 1 AS uploaded FROM events GROUP BY 1""",
)
def uploaded_on_day(spark, d):
    day = F.lit("2024-01-15").cast("date")
    return agg.uploaded_on_day(table(spark, d, "events"), "user_id", "ts", day, "Asia/Tokyo")


DESCRIBE = ("level_mean", "level_std", "energy_mean", "rate")


@query(
    "describe",
    f"WITH {v.UD}, {HOLED_DAYS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q2,
        round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max FROM hd"""
        for c in DESCRIBE
    ),
)
def describe(spark, d):
    out = agg.describe(holed_days(spark, d), DESCRIBE)
    return out.select("measure", "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "q1", "q2", "q3", "max")])


@query(
    "box_stats",
    f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
      quantile_cont(value, 0.75) AS q3 FROM {HOLED} GROUP BY 1)
    SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3,
      round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
      round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
      count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
      FROM {HOLED} JOIN q USING (event_type) GROUP BY event_type, q1, q2, q3""",
)
def box_stats(spark, d):
    box = agg.box_stats(holed(spark, d), "event_type", "value")
    return box.select(
        "event_type", *[r6(c).alias(c) for c in ("q1", "q2", "q3", "whisker_low", "whisker_high")], "outliers"
    )


@query(
    "class_share",
    """SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
      FROM events GROUP BY 1""",
)
def class_share(spark, d):
    return agg.class_share(table(spark, d, "events"), "event_type").withColumn("share_pct", r6("share_pct"))


@query(
    "corpus_report",
    f"""WITH {v.UD}, c AS (SELECT user_id, {v.UD_CLASS} AS risk FROM ud)
    SELECT risk, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct,
      CAST(sum(count(*)) OVER () AS BIGINT) AS total_chunks,
      (SELECT count(DISTINCT user_id) FROM c) AS total_subjects, 7 AS n_features FROM c GROUP BY 1""",
)
def corpus_report(spark, d):
    days = v.stored_days(spark, d)
    labelled = days.select("user_id", decide.risk_class(decide.rule_score(v.USER_DAY_RULES)).alias("risk"))
    return agg.corpus_report(labelled, "user_id", "risk", 7).withColumn("share_pct", r6("share_pct"))


# --- labels ----------------------------------------------------------------------------


def scored_days(spark, d):
    score = decide.rule_score(v.USER_DAY_RULES)
    days = v.user_day(spark, d).withColumn("score", score)
    return days.withColumn("risk", decide.risk_class(F.col("score")))


@query("rule_score", f"WITH {v.UD} SELECT user_id, CAST(day AS VARCHAR) AS day, {v.UD_SCORE} AS score FROM ud")
def rule_score(spark, d):
    return day_text(scored_days(spark, d).select("user_id", "day", "score"))


@query(
    "risk_label",
    f"""WITH {v.UD}, c AS (SELECT user_id, day, {v.UD_CLASS} AS risk FROM ud) SELECT user_id,
      CAST(day AS VARCHAR) AS day, risk, CASE risk WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END
      AS risk_level FROM c""",
)
def risk_label(spark, d):
    days = scored_days(spark, d)
    return day_text(days.select("user_id", "day", "risk", decide.class_name(F.col("risk")).alias("risk_level")))


# An emotion code for each event type, so that the class maps have something to map.
EVENT_EMOTION = (("error", "sad"), ("click", "ANG"), ("view", "happy"), ("signup", "fear"), ("purchase", "neutral"))


def emotional(spark, d):
    emotion = rel.small_table(spark, EVENT_EMOTION, "event_type string, emotion string")
    e = table(spark, d, "events").select("event_id", "event_type").join(emotion, "event_type", "left")
    return e.select("event_id", decide.emotion_code(F.col("emotion")).alias("code"))


EMOTION_SQL = """em AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'SAD' WHEN 'click' THEN 'ANG'
  WHEN 'view' THEN 'HAP' WHEN 'signup' THEN 'FEA' ELSE 'NEU' END AS code FROM events)"""


@query(
    "risk_map3",
    f"""WITH {EMOTION_SQL} SELECT event_id, code, CASE WHEN code IN ('SAD', 'FEA') THEN 2
      WHEN code IN ('ANG', 'DIS') THEN 1 ELSE 0 END AS risk FROM em""",
)
def risk_map3(spark, d):
    return decide.risk_map3(emotional(spark, d), "code", "risk").select("event_id", "code", "risk")


@query(
    "risk_map2",
    f"""WITH {EMOTION_SQL} SELECT event_id, code, CASE WHEN code IN ('SAD', 'ANG', 'FEA', 'DIS') THEN 1 ELSE 0 END
      AS risk FROM em""",
)
def risk_map2(spark, d):
    return emotional(spark, d).withColumn("risk", decide.risk_map2(F.col("code")))


# --- against the baseline --------------------------------------------------------------

FLAGS = {
    "pitch_drop": ("level_mean", "base_level"),
    "slow_speech": ("rate", "base_rate"),
    "zcr_drop": ("energy_mean", "base_energy"),
}
PAIRS = {
    "level": ("level_mean", "base_level"),
    "energy": ("energy_mean", "base_energy"),
    "rate": ("rate", "base_rate"),
    "polarity": ("polarity", "base_polarity"),
}


def days_with_baseline(spark, d):
    days = v.stored_days(spark, d)
    return rel.join_baseline(days, agg.user_baseline(days, "user_id", BASE, 26), "user_id", spread_by=["day"])


WITH_BASE = f"{v.UD}, {BASE_SQL}, j AS (SELECT * FROM ud LEFT JOIN bl USING (user_id))"


@query(
    "trend_flags",
    f"""WITH {WITH_BASE} SELECT user_id, CAST(day AS VARCHAR) AS day,
      coalesce(level_mean < base_level * 0.9, false) AS pitch_drop,
      coalesce(rate < base_rate * 0.85, false) AS slow_speech,
      coalesce(energy_mean < base_energy * 0.8, false) AS zcr_drop FROM j""",
)
def trend_flags(spark, d):
    days = days_with_baseline(spark, d).withColumns(decide.trend_flags(FLAGS))
    return day_text(days.select("user_id", "day", *FLAGS))


@query(
    "baseline_ratio",
    f"WITH {WITH_BASE} "
    + " UNION ALL ".join(
        f"""SELECT user_id, CAST(day AS VARCHAR) AS day, '{m}' AS measure,
        round(CASE WHEN coalesce(nullif({b}, 0), 1) > 0 THEN {c} / coalesce(nullif({b}, 0), 1) ELSE 1 END, 6) AS ratio
        FROM j"""
        for m, (c, b) in PAIRS.items()
    ),
)
def baseline_ratio(spark, d):
    out = decide.baseline_ratio(days_with_baseline(spark, d), ["user_id", "day"], PAIRS)
    return day_text(out).withColumn("ratio", r6("ratio"))


@query(
    "baseline_delta",
    f"WITH {WITH_BASE} SELECT user_id, CAST(day AS VARCHAR) AS day, "
    + ", ".join(f"round({c} - {b} + 1e-9, 6) AS {m}_delta" for m, (c, b) in PAIRS.items())
    + " FROM j",
)
def baseline_delta(spark, d):
    days = days_with_baseline(spark, d)
    deltas = decide.baseline_delta(PAIRS, F.col("total_samples").isNotNull())
    return day_text(days.select("user_id", "day", *[past_tie(c).alias(o) for o, c in deltas.items()]))


# --- decisions -------------------------------------------------------------------------

LEVEL_SQL = f"""lv AS (SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN day = DATE '2024-01-07' THEN NULL
  ELSE CASE {v.UD_CLASS} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END END AS level FROM ud)"""


def levels(spark, d):
    """Risk levels of user-days; the seventh day has no prediction."""
    days = scored_days(spark, d)
    level = F.when(F.col("day") != F.lit("2024-01-07").cast("date"), decide.class_name(F.col("risk")))
    return day_text(days.select("user_id", "day", level.alias("level")))


STATUS_SQL = "CASE level WHEN 'High' THEN 'Unhealthy' WHEN 'Medium' THEN 'Needs Attention' ELSE 'Healthy' END"


@query("status_map", f"WITH {v.UD}, {LEVEL_SQL} SELECT user_id, day, {STATUS_SQL} AS status FROM lv")
def status_map(spark, d):
    return levels(spark, d).select("user_id", "day", decide.status_of(F.col("level")).alias("status"))


TIPS_SQL = "CASE level " + " ".join(
    f"WHEN '{lv}' THEN '{' | '.join(tips)}'" for lv, tips in decide.ADVICE if lv != "Low"
) + f" ELSE '{' | '.join(dict(decide.ADVICE)['Low'])}' END"


@query("recommendations", f"WITH {v.UD}, {LEVEL_SQL} SELECT user_id, day, {TIPS_SQL} AS tips FROM lv")
def recommendations(spark, d):
    advised = decide.with_advice(levels(spark, d), "level")
    return advised.select("user_id", "day", F.array_join("recommendations", " | ").alias("tips"))


# Six places, so that no printed number is a tie between two roundings.
CURRENT = {"Pitch": ("level_mean", "%.6f"), "Rate": ("rate", "%.6f"), "Sentiment": ("polarity", "%.6f"), "Records": ("n", "%d")}
BASELINE = {"Average Pitch": ("base_level", "%.6f"), "Average Rate": ("base_rate", "%.6f")}
OPENING, NOTE, CLOSING = "Summarise the record below in plain words.", "Weigh it against the sentiment.", "Reply with one JSON object."
MODEL_LEVEL = f"""CASE WHEN day = DATE '2024-01-07' THEN NULL ELSE
      CASE {v.UD_CLASS} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END END"""
CONFIDENCE = f"(40.0 + 5.0 * {v.UD_SCORE})"
NUMBERED_SQL = "CASE level " + " ".join(
    f"WHEN '{lv}' THEN '" + "\n".join(f'{i}. "{t}"' for i, t in enumerate(tips, 1)) + "'" for lv, tips in decide.ADVICE
) + " END"


def requested_days(spark, d):
    """User-days with baseline, flags, predicted class, its confidence, the share of each class and the advice."""
    days = days_with_baseline(spark, d).withColumns(decide.trend_flags(FLAGS))
    score = decide.rule_score(v.USER_DAY_RULES)
    level = F.when(F.col("day") != F.lit("2024-01-07").cast("date"), decide.class_name(decide.risk_class(score)))
    sure = 40.0 + 5.0 * score
    share = F.create_map(level, sure / 100.0)
    days = days.withColumns({"level": level, "confidence": sure, "shares": F.when(level.isNotNull(), share)})
    return decide.with_advice(days, "level")


@query(
    "render_request",
    f"""WITH {WITH_BASE}, k AS (SELECT *, {MODEL_LEVEL} AS level, {CONFIDENCE} AS sure FROM j)
    SELECT user_id, CAST(day AS VARCHAR) AS day, '{OPENING}'
      || printf(E'\n\n--- CURRENT RECORDING ---\nTranscription: ''%s''\nPitch: %.6f\nRate: %.6f\nSentiment: %.6f\nRecords: %d',
           'day ' || day(day), level_mean, rate, polarity, n)
      || CASE WHEN total_samples IS NULL THEN '' ELSE
           printf(E'\n\n--- PERSONAL BASELINE ---\nAverage Pitch: %.6f\nAverage Rate: %.6f\nTRENDS: ', base_level, base_rate)
           || 'Pitch Drop Detected=' || CASE WHEN coalesce(level_mean < base_level * 0.9, false) THEN 'True' ELSE 'False' END
           || ', Slower Speech Detected=' || CASE WHEN coalesce(rate < base_rate * 0.85, false) THEN 'True' ELSE 'False' END END
      || CASE WHEN level IS NULL THEN '' ELSE
           printf(E'\n\n--- MODEL PREDICTION ---\nPredicted: %s Risk (Confidence: %.1f%%)\nProbabilities -> Low: %.1f%%, Medium: %.1f%%, High: %.1f%%\n{NOTE}',
             level, sure, CASE level WHEN 'Low' THEN sure ELSE 0.0 END, CASE level WHEN 'Medium' THEN sure ELSE 0.0 END,
             CASE level WHEN 'High' THEN sure ELSE 0.0 END)
           || E'\n\n--- REQUIRED RECOMMENDATIONS ---\n' || {NUMBERED_SQL} END
      || E'\n\n{CLOSING}' AS request FROM k""",
)
def render_request(spark, d):
    """The request text of every user-day, as it would be sent."""
    request = decide.render_request(
        CURRENT,
        BASELINE,
        {"Pitch Drop": "pitch_drop", "Slower Speech": "slow_speech"},
        F.col("total_samples").isNotNull(),
        F.col("level"),
        F.col("confidence"),
        F.concat(F.lit("day "), F.dayofmonth("day")),
        F.col("shares"),
        F.col("recommendations"),
        OPENING,
        NOTE,
        CLOSING,
    )
    return day_text(requested_days(spark, d).select("user_id", "day", request.alias("request")))


def replies(spark, d):
    """A reply for most events: the JSON of the event in a fence, a cut-off one, plain text, or none."""
    i, e = F.col("event_id"), table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "High").when(F.col("event_type") == "click", "Medium")
    body = F.to_json(F.struct(level.alias("risk_level"), F.col("props").alias("explanation")))
    reply = (
        F.when(i % 11 == 0, F.lit(None))
        .when(i % 7 == 0, F.substring(body, 1, 9))
        .when(i % 5 == 0, F.lit("I cannot say"))
        .when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return e.select("event_id", "event_type", reply.alias("reply"), F.when(i % 2 == 0, "Low").alias("model_risk"))


REPLY_SQL = """rp AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'none' WHEN event_id % 7 = 0 OR event_id % 5 = 0
    THEN 'bad' ELSE 'good' END AS kind, props,
  CASE WHEN event_id % 2 = 0 THEN 'Low' END AS model_risk,
  CASE WHEN event_type = 'error' THEN 'High' WHEN event_type = 'click' THEN 'Medium' END AS said FROM events),
pr AS (SELECT *, coalesce(CASE WHEN kind = 'good' THEN said END, model_risk, 'Unknown') AS level FROM rp)"""


@query(
    "parse_reply",
    f"""WITH {REPLY_SQL} SELECT event_id, level AS risk_level, {STATUS_SQL} AS mental_health_status,
      CASE kind WHEN 'bad' THEN 'Failed to parse the reply.' WHEN 'good' THEN props ELSE '' END AS explanation,
      kind = 'bad' AS failed FROM pr""",
)
def parse_reply(spark, d):
    parsed = decide.parse_reply(replies(spark, d), "reply", "model_risk")
    return parsed.select(
        "event_id", "risk_level", "mental_health_status", "explanation", F.col("reply_error").isNotNull().alias("failed")
    )


@query(
    "fallback_decision",
    f"""WITH {v.UD}, {LEVEL_SQL} SELECT user_id, day, coalesce(level, 'Low') AS risk_level,
      {STATUS_SQL} AS status, {TIPS_SQL} AS tips FROM lv""",
)
def fallback_decision(spark, d):
    out = decide.fallback_decision(levels(spark, d), "level")
    return out.select(
        "user_id",
        "day",
        "risk_level",
        F.col("mental_health_status").alias("status"),
        F.array_join("recommendations", " | ").alias("tips"),
    )


ANSWERED_SQL = f"""k AS (SELECT *, {MODEL_LEVEL} AS model_risk, {CONFIDENCE} AS sure, user_id + day(day) AS i FROM j),
an AS (SELECT *, CASE i % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'bad' ELSE 'good' END AS kind,
  CASE i % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' END AS said FROM k),
fd AS (SELECT *, CASE kind WHEN 'none' THEN coalesce(model_risk, 'Low') WHEN 'bad' THEN coalesce(model_risk, 'Unknown')
  ELSE coalesce(said, model_risk, 'Unknown') END AS level FROM an)"""


def answered_days(spark, d):
    """User-days with a reply for most: JSON, cut-off JSON or none; the reply may contradict the model."""
    days = requested_days(spark, d).withColumnRenamed("level", "model_risk").drop("recommendations", "explanation", "shares")
    i = F.col("user_id") + F.dayofmonth("day")
    said = F.when(i % 3 == 0, "High").when(i % 3 == 1, "Medium")
    body = F.to_json(F.struct(said.alias("risk_level"), F.format_string("%d records", "n").alias("explanation")))
    return days.withColumn("reply", F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, F.substring(body, 1, 9)).otherwise(body))


@query(
    "final_decision",
    f"""WITH {WITH_BASE}, {ANSWERED_SQL}, rd AS (SELECT *, total_samples IS NOT NULL AS ready FROM fd),
    tp AS (SELECT user_id, day, {TIPS_SQL} AS tips FROM (SELECT user_id, day, model_risk AS level FROM fd))
    SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN ready THEN level ELSE 'Unknown' END AS risk_level,
      CASE WHEN ready THEN {STATUS_SQL} ELSE 'Unknown' END AS status,
      CASE WHEN NOT ready THEN 'Not enough data.' WHEN kind = 'bad' THEN 'Failed to parse the reply.'
        WHEN kind = 'good' THEN n || ' records'
        ELSE printf('The model classified this record as %s Risk with %.1f%% confidence.', level, sure) END AS explanation,
      CASE WHEN ready THEN tips ELSE '' END AS tips FROM rd JOIN tp USING (user_id, day)""",
)
def final_decision(spark, d):
    """Records with their baseline, model class, confidence and reply, through to the decision."""
    out = decide.final_decision(answered_days(spark, d), "reply", "model_risk", "confidence", F.col("total_samples").isNotNull())
    return day_text(
        out.select(
            "user_id", "day", "risk_level", F.col("mental_health_status").alias("status"), "explanation", F.array_join("recommendations", " | ").alias("tips")
        )
    )
