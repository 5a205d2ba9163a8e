"""The test tables seen as recordings, transcripts, signal frames and scored records.

Each view has a Spark form and the same thing as SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.operators.decide import Rule
from lookout.operators.relational import small_table
from lookout.session import settled, table

CHUNK_SECONDS = 5

# Rule thresholds for user-days.
USER_DAY_RULES = (
    Rule("level_std", "<", 5, 2),
    Rule("pause_ratio", ">", 0.93, 2),
    Rule("energy_mean", "<", 20, 1),
    Rule("rate", "<", 0.05, 1),
    Rule("level_mean", "<", 15, 1),
    Rule("n", "<", 2, 1),
    Rule("polarity", "<", -0.1, 2),
)

# A small lexicon over frequent words of the test texts.
LEXICON = (
    ("the", 0.1, 0.2),
    ("of", -0.2, 0.4),
    ("and", 0.3, 0.1),
    ("de", -0.4, 0.5),
    ("to", 0.2, 0.3),
    ("in", -0.1, 0.6),
    ("la", 0.5, 0.7),
    ("a", -0.3, 0.2),
    ("der", 0.4, 0.8),
    ("is", -0.5, 0.9),
)


def user_day(spark: SparkSession, folder: str) -> DataFrame:
    """One recording per user and day. The hours of a day are kept as bits, so one pass is enough."""
    e = table(spark, folder, "events")
    mood = (
        F.when(F.col("event_type") == "error", -1.0)
        .when(F.col("event_type") == "signup", 0.5)
        .when(F.col("event_type") == "purchase", 1.0)
        .otherwise(0.0)
    )
    v = F.col("value")
    hours = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.hour("ts"))))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("level_mean"),
        # Rounded, so that a spread of exactly a threshold does not depend on the order of the sum.
        F.round(F.stddev_pop(v), 9).alias("level_std"),
        F.sqrt(F.avg(v * v)).alias("energy_mean"),
        (F.count(F.lit(1)) / 24.0).alias("rate"),
        (1 - hours / 24.0).alias("pause_ratio"),
        F.avg(mood).alias("polarity"),
    )


def stored_days(spark: SparkSession, folder: str) -> DataFrame:
    """User-days written once, for queries that read them more than once: the events are scanned one time."""
    return settled(user_day(spark, folder))


UD = """ud AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS level_mean,
         round(stddev_pop(value), 9) AS level_std, sqrt(avg(value * value)) AS energy_mean,
         count(*) / 24.0 AS rate, 1 - count(DISTINCT hour(ts)) / 24.0 AS pause_ratio,
         avg(CASE event_type WHEN 'error' THEN CAST(-1 AS DOUBLE) WHEN 'signup' THEN 0.5
             WHEN 'purchase' THEN 1 ELSE 0 END) AS polarity
  FROM events GROUP BY 1, 2)"""

UD_SCORE = """(CASE WHEN level_std < 5 THEN 2 ELSE 0 END + CASE WHEN pause_ratio > 0.93 THEN 2 ELSE 0 END
  + CASE WHEN energy_mean < 20 THEN 1 ELSE 0 END + CASE WHEN rate < 0.05 THEN 1 ELSE 0 END
  + CASE WHEN level_mean < 15 THEN 1 ELSE 0 END + CASE WHEN n < 2 THEN 1 ELSE 0 END
  + CASE WHEN polarity < -0.1 THEN 2 ELSE 0 END)"""

UD_CLASS = f"CASE WHEN {UD_SCORE} >= 5 THEN 2 WHEN {UD_SCORE} >= 2 THEN 1 ELSE 0 END"


def transcript(spark: SparkSession, folder: str) -> DataFrame:
    """All turns with a start time in seconds."""
    return table(spark, folder, "conversations").withColumn(
        "start_time", F.col("turn") * F.lit(2.3) + (F.col("conv_id") % 4) * 6
    )


def participants(spark: SparkSession, folder: str) -> DataFrame:
    return transcript(spark, folder).filter(F.col("role") == "user")


def subject_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return transcript(spark, folder).groupBy("conv_id").agg(F.max("start_time").alias("total"))


TR = """tr AS (
  SELECT *, turn * CAST(2.3 AS DOUBLE) + (conv_id % 4) * 6 AS start_time FROM conversations),
len AS (SELECT conv_id, max(start_time) AS total FROM tr GROUP BY 1),
spine AS (SELECT conv_id, c.chunk_id, c.chunk_id * 5 AS chunk_start
  FROM len, range(CAST(floor(total / 5) AS BIGINT)) c(chunk_id)),
utt AS (SELECT * FROM tr WHERE role = 'user')"""

LEX = "lex(word, polarity, subjectivity) AS (VALUES " + ", ".join(
    f"('{w}', CAST({p} AS DOUBLE), CAST({s} AS DOUBLE))" for w, p, s in LEXICON
) + ")"


def lexicon(spark: SparkSession) -> DataFrame:
    return small_table(spark, LEXICON, "word string, polarity double, subjectivity double")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Signal frames of 64 samples, scaled so that they differ in energy. 25 frames make a chunk."""
    gain = (F.col("vec_id") % 7 + 1).cast("double")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.col("label"),
        F.floor(F.col("vec_id") / 25).alias("chunk_id"),
        (F.col("vec_id") % 25).alias("pos"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x * gain).alias("samples"),
    )


FR = """fr AS (
  SELECT vec_id, label, vec_id // 25 AS chunk_id, vec_id % 25 AS pos,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 7 + 1)) AS samples
  FROM embeddings)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Truth and two scores per labelled document."""
    d, lab = table(spark, folder, "documents"), table(spark, folder, "labels")
    return d.select("doc_id", "n_chars").join(lab, "doc_id").select(
        "doc_id",
        F.col("quality").alias("y"),
        F.least(F.floor(F.col("n_chars") / 50), F.lit(40)).cast("bigint").alias("score_tied"),
        (F.col("n_chars") % 1000).alias("score"),
    )


SC = """sc AS (
  SELECT doc_id, quality AS y, CAST(least(floor(n_chars / 50), 40) AS BIGINT) AS score_tied,
         n_chars % 1000 AS score
  FROM documents JOIN labels USING (doc_id))"""
