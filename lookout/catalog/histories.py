"""Queries: per-subject histories, series and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.catalog.records import FLAGS, day_text
from lookout.catalog.registry import query
from lookout.catalog.tables import TOKENS, past_tie, r6
from lookout.functions import phrases
from lookout.functions import text as tx
from lookout.operators import decide
from lookout.operators import relational as rel
from lookout.operators import windows as win
from lookout.operators.relational import small_table
from lookout.plans import views as v
from lookout.session import table

GROWING = {"base_level": "level_mean", "base_energy": "energy_mean", "base_rate": "rate"}


@query(
    "latest_per_user",
    """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER
      (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_user(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return win.latest_per_key(e, ["user_id"], "ts", "event_id").drop("ts")


def past(frame: str) -> str:
    over = f"OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND {frame})"
    return ", ".join(
        [f"count(*) {over} AS baseline_n"]
        + [f"CASE WHEN count(*) {over} >= 5 THEN avg({c}) {over} END AS {o}" for o, c in GROWING.items()]
    )


@query(
    "expanding_baseline",
    f"WITH {v.UD}, b AS (SELECT user_id, day, {past('CURRENT ROW')} FROM ud) SELECT user_id, CAST(day AS VARCHAR) AS day, "
    "baseline_n, " + ", ".join(f"round({o} + 1e-9, 6) AS {o}" for o in GROWING) + " FROM b",
)
def expanding_baseline(spark, d):
    out = win.expanding_baseline(v.stored_days(spark, d), "user_id", ["day"], GROWING)
    return day_text(out.select("user_id", "day", "baseline_n", *[past_tie(o).alias(o) for o in GROWING]))


@query(
    "deviation_z",
    f"""WITH {v.UD}, b AS (SELECT user_id, day, level_mean, count(*) OVER w AS past_n, avg(level_mean) OVER w AS m,
      stddev_samp(level_mean) OVER w AS s FROM ud
      WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, CAST(day AS VARCHAR) AS day, past_n, CASE WHEN past_n >= 5 THEN round(m + 1e-9, 6) END AS past_mean,
      CASE WHEN past_n >= 5 AND s > 1e-9 THEN round((level_mean - m) / s, 5) END AS z FROM b""",
)
def deviation_z(spark, d):
    out = win.deviation_z(v.stored_days(spark, d), "user_id", ["day"], "level_mean")
    return day_text(
        out.select("user_id", "day", "past_n", past_tie("past_mean").alias("past_mean"), F.round("z", 5).alias("z"))
    )


@query(
    "user_trend",
    f"""WITH {v.UD}, hd AS (SELECT * REPLACE (CASE WHEN day(day) % 7 <> 3 THEN level_mean END AS level_mean) FROM ud),
    o AS (SELECT user_id, level_mean, row_number() OVER w AS no,
      lag(level_mean) OVER w AS before FROM hd WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, count(*) AS n, round(regr_slope(level_mean, no), 6) AS slope,
      round(avg(level_mean - before), 6) AS mean_step FROM o GROUP BY 1""",
)
def user_trend(spark, d):
    """Every seventh day has NaN for a level, which is a missing value."""
    days = v.stored_days(spark, d)
    days = days.withColumn("level_mean", F.when(F.dayofmonth("day") % 7 == 3, float("nan")).otherwise(F.col("level_mean")))
    out = win.user_trend(days, "user_id", ["day"], "level_mean")
    return out.select("user_id", "n", r6("slope").alias("slope"), r6("mean_step").alias("mean_step"))


@query(
    "sample_per_class",
    """SELECT event_type, event_id FROM events QUALIFY row_number() OVER
      (PARTITION BY event_type ORDER BY event_id) <= 10""",
)
def sample_per_class(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id")
    return win.first_per_key(e, ["event_type"], [F.asc("event_id")], 10)


@query(
    "local_peaks",
    f"""WITH {v.UD}, o AS (SELECT user_id, day, energy_mean, row_number() OVER w AS pos,
      lag(energy_mean) OVER w AS b, lead(energy_mean) OVER w AS a,
      avg(energy_mean) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m
      FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, CAST(day AS VARCHAR) AS day, pos, round(energy_mean, 6) AS energy_mean FROM o
      WHERE energy_mean > b AND energy_mean >= a AND energy_mean >= m + 1""",
)
def local_peaks(spark, d):
    placed = win.with_position(v.stored_days(spark, d), "user_id", ["day"], "pos")
    out = win.local_peaks(placed.select("user_id", "day", "pos", "energy_mean"), "user_id", "pos", "energy_mean", 3, 1.0)
    return day_text(out).withColumn("energy_mean", r6("energy_mean"))


@query(
    "session_agg",
    """WITH e AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER w AS pause FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(CASE WHEN pause IS NULL OR pause > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM e)
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, no""",
)
def session_agg(spark, d):
    out = win.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 1800)
    return out.select(
        "user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n"
    )


# --- the flagship ----------------------------------------------------------------------


@query(
    "risk_report",
    f"""WITH {v.UD}, b AS (SELECT ud.*, {past('CURRENT ROW')} FROM ud)
    SELECT user_id, CAST(day AS VARCHAR) AS day, baseline_n, coalesce(level_mean < base_level * 0.9, false) AS pitch_drop,
      coalesce(rate < base_rate * 0.85, false) AS slow_speech, coalesce(energy_mean < base_energy * 0.8, false) AS zcr_drop,
      {v.UD_SCORE} AS score, CASE {v.UD_CLASS} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS risk_level,
      CASE {v.UD_CLASS} WHEN 0 THEN 'Healthy' WHEN 1 THEN 'Needs Attention' ELSE 'Unhealthy' END AS status,
      CASE {v.UD_CLASS} WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS n_tips FROM b""",
)
def risk_report(spark, d):
    """User-days with their growing baseline, trend flags, risk class, status and advice."""
    grown = win.expanding_baseline(v.stored_days(spark, d), "user_id", ["day"], GROWING)
    judged = grown.withColumns(decide.trend_flags(FLAGS)).withColumn("score", decide.rule_score(v.USER_DAY_RULES))
    judged = judged.withColumn("risk_level", decide.class_name(decide.risk_class(F.col("score"))))
    advised = decide.with_advice(judged, "risk_level")
    return day_text(
        advised.select(
            "user_id",
            "day",
            "baseline_n",
            *FLAGS,
            "score",
            "risk_level",
            decide.status_of(F.col("risk_level")).alias("status"),
            F.size("recommendations").alias("n_tips"),
        )
    )


# --- text ------------------------------------------------------------------------------

SENTENCES = "list_filter(regexp_split_to_array(text, '[.!?]+\\s*'), lambda s: trim(s) <> '')"
DOC = f"""tk AS (SELECT doc_id, text, {TOKENS} AS w, len({SENTENCES}) AS n_sent FROM documents)"""
MOOD = f"""{v.LEX}, md AS (SELECT doc_id, avg(polarity) AS pol, avg(subjectivity) AS subj, count(*) AS matched
  FROM (SELECT doc_id, unnest(w) AS word FROM tk) JOIN lex USING (word) GROUP BY 1)"""


@query("word_count", f"WITH {DOC} SELECT doc_id, len(w) AS words FROM tk")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).cast("bigint").alias("words"))


@query(
    "vocab_richness",
    f"""WITH {DOC} SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE round(len(list_distinct(w)) / len(w), 6) END
      AS richness FROM tk""",
)
def vocab_richness(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    return docs.select("doc_id", r6(tx.vocab_richness(F.col("w"))).alias("richness"))


@query("sentence_complexity", f"WITH {DOC} SELECT doc_id, round(len(w) / greatest(n_sent, 1), 6) AS complexity FROM tk")
def sentence_complexity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", tx.words(F.col("text")).alias("w"))
    return docs.select("doc_id", r6(tx.sentence_complexity(F.col("w"), F.col("text"))).alias("complexity"))


@query(
    "lexicon_sentiment",
    f"WITH {DOC}, {MOOD} SELECT doc_id, round(pol, 10) AS polarity, round(subj, 10) AS subjectivity, matched FROM md",
)
def lexicon_sentiment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    out = tx.lexicon_sentiment(docs, ["doc_id"], "w", v.lexicon(spark))
    return out.select(
        "doc_id", F.round("sentiment_polarity", 10).alias("polarity"), F.round("sentiment_subjectivity", 10).alias("subjectivity"), "matched"
    )


# Entries of one and two words, two modifiers, two negations; none begins with a modifier or a negation.
PHRASES = (("of the", 0.6, 0.9), ("de la", -0.7, 0.3), ("the", 0.1, 0.2), ("la", 0.5, 0.7), ("in", -0.1, 0.6), ("is", -0.5, 0.9), ("der", 0.4, 0.8))
MODIFIERS, NEGATIONS = (("to", 1.5), ("and", 0.5)), ("on", "with")
_either = "|".join
_groups = f" (?:(?:{_either(NEGATIONS)})  )?(?:(?:{_either(m for m, _ in MODIFIERS)})  )*(?:{_either(p.replace(' ', '  ') for p, *_ in PHRASES)}) "


def _case(values):
    return "CASE " + " ".join(f"WHEN ends_with(m, ' {p.replace(' ', '  ')} ') THEN CAST({x} AS DOUBLE)" for p, x in values) + " END"


PHRASE_SQL = f"""WITH t AS (SELECT doc_id, array_to_string(list_transform({TOKENS}, lambda w: ' ' || w || ' '), '') AS said FROM documents),
g AS (SELECT doc_id, unnest(regexp_extract_all(said, '{_groups}')) AS m FROM t),
v AS (SELECT doc_id, {_case((p, x) for p, x, _ in PHRASES)} AS p, {_case((p, x) for p, _, x in PHRASES)} AS s,
  {' * '.join(f"pow({x}, len(regexp_extract_all(m, ' {w} ')))" for w, x in MODIFIERS)} AS strength,
  CASE WHEN regexp_matches(m, '^ (?:{_either(NEGATIONS)}) ') THEN -0.5 ELSE 1 END AS turn FROM g),
f AS (SELECT doc_id, count(*) AS matched, avg(greatest(-1, least(1, p * strength * turn))) AS pol, avg(greatest(0, least(1, s * strength))) AS subj FROM v GROUP BY 1)
SELECT doc_id, coalesce(matched, 0) AS matched, round(coalesce(pol, 0), 6) AS polarity, round(coalesce(subj, 0), 6) AS subjectivity FROM t LEFT JOIN f USING (doc_id)"""


@query("phrase_sentiment", PHRASE_SQL)
def phrase_sentiment(spark, d):
    """Sentiment by phrases, with modifiers and negations, in one scan."""
    rows = [(p, x, s, None) for p, x, s in PHRASES] + [(m, None, None, x) for m, x in MODIFIERS]
    lexicon = small_table(spark, rows, "phrase string, polarity double, subjectivity double, intensity double")
    docs = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    out = phrases.phrase_sentiment(docs, ["doc_id"], "w", lexicon, NEGATIONS)
    return out.select("doc_id", "matched", r6("sentiment_polarity").alias("polarity"), r6("sentiment_subjectivity").alias("subjectivity"))


@query(
    "language_features",
    f"""WITH {DOC}, {MOOD} SELECT doc_id, CAST(len(w) AS INT) AS word_count, round(coalesce(pol, 0), 10) AS polarity,
      round(coalesce(subj, 0), 10) AS subjectivity,
      CASE WHEN len(w) = 0 THEN 0 ELSE round(len(list_distinct(w)) / len(w), 6) END AS richness,
      round(len(w) / greatest(n_sent, 1), 6) AS complexity, length(text) AS chars FROM tk LEFT JOIN md USING (doc_id)""",
)
def language_features(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = tx.language_features(docs, ["doc_id"], "text", v.lexicon(spark))
    return out.select(
        "doc_id",
        "word_count",
        F.round("sentiment_polarity", 10).alias("polarity"),
        F.round("sentiment_subjectivity", 10).alias("subjectivity"),
        r6("vocab_richness").alias("richness"),
        r6("sentence_complexity").alias("complexity"),
        F.length("transcription").cast("bigint").alias("chars"),
    )


CHUNK_TEXT = f"""{v.TR}, ct AS (SELECT s.conv_id, s.chunk_id,
  coalesce(string_agg(u.text, ' ' ORDER BY u.start_time, u.turn), '') AS text, count(u.text) AS utterances
  FROM spine s LEFT JOIN utt u ON u.conv_id = s.conv_id AND u.start_time >= s.chunk_start
  AND u.start_time < s.chunk_start + 5 GROUP BY 1, 2)"""


@query("chunk_transcript", f"WITH {CHUNK_TEXT} SELECT conv_id, chunk_id, text AS transcript, utterances FROM ct")
def chunk_transcript(spark, d):
    spine = rel.chunk_spine(v.subject_lengths(spark, d), "total", v.CHUNK_SECONDS)
    said = v.participants(spark, d).select("conv_id", "turn", "start_time", "text")
    joined = rel.interval_join(spine, said, "conv_id", "start_time", v.CHUNK_SECONDS)
    return tx.chunk_transcript(joined, ["conv_id", "chunk_id"], "text", "start_time", "turn")


@query(
    "chunk_language",
    f"""WITH {CHUNK_TEXT}, tk AS (SELECT conv_id, chunk_id, text, {TOKENS} AS w, len({SENTENCES}) AS n_sent FROM ct),
    {v.LEX}, md AS (SELECT conv_id, chunk_id, avg(polarity) AS pol, avg(subjectivity) AS subj
      FROM (SELECT conv_id, chunk_id, unnest(w) AS word FROM tk) JOIN lex USING (word) GROUP BY 1, 2)
    SELECT conv_id, chunk_id, substring(text, 1, 200) AS transcription, CAST(len(w) AS INT) AS word_count,
      round(coalesce(pol, 0), 10) AS polarity, round(coalesce(subj, 0), 10) AS subjectivity,
      CASE WHEN len(w) = 0 THEN 0 ELSE round(len(list_distinct(w)) / len(w), 6) END AS richness,
      round(len(w) / greatest(n_sent, 1), 6) AS complexity FROM tk LEFT JOIN md USING (conv_id, chunk_id)""",
)
def chunk_language(spark, d):
    spine = rel.chunk_spine(v.subject_lengths(spark, d), "total", v.CHUNK_SECONDS)
    said = v.participants(spark, d).select("conv_id", "turn", "start_time", "text")
    out = tx.chunk_language(spine, said, "conv_id", "start_time", "turn", "text", v.CHUNK_SECONDS, v.lexicon(spark))
    return out.select(
        "conv_id",
        "chunk_id",
        "transcription",
        "word_count",
        F.round("sentiment_polarity", 10).alias("polarity"),
        F.round("sentiment_subjectivity", 10).alias("subjectivity"),
        r6("vocab_richness").alias("richness"),
        r6("sentence_complexity").alias("complexity"),
    )
