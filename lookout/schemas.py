"""Table definitions: feature records and personal baselines, with their defaults."""

from __future__ import annotations

from pyspark.sql import types as T

PROSODY = (
    "pitch_mean",
    "pitch_std",
    "energy_mean",
    "energy_std",
    "speech_rate",
    "pause_ratio",
    "hnr",
    "zcr_mean",
    "spectral_centroid_mean",
    "spectral_rolloff_mean",
)
LANGUAGE = ("sentiment_polarity", "sentiment_subjectivity", "vocab_richness", "sentence_complexity")
N_MFCC = 13

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("record_date", T.DateType()),
        T.StructField("source_path", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in PROSODY],
        T.StructField("mfcc", T.ArrayType(T.DoubleType())),
        T.StructField("transcription", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in LANGUAGE],
        T.StructField("label", T.StringType()),
    ]
)
RECORD_DEFAULTS = {"user_id": "user1", "label": "unknown"}

# The text fields of a chunk in which nothing was said.
EMPTY_TEXT = {
    "transcription": "",
    "word_count": 0,
    "sentiment_polarity": 0.0,
    "sentiment_subjectivity": 0.0,
    "vocab_richness": 0.0,
    "sentence_complexity": 0.0,
}

# Baseline column -> the record column it is the mean of.
BASELINE_MEASURES = {
    "baseline_pitch_mean": "pitch_mean",
    "baseline_energy_mean": "energy_mean",
    "baseline_speech_rate": "speech_rate",
    "baseline_sentiment": "sentiment_polarity",
    "baseline_zcr": "zcr_mean",
    "baseline_centroid": "spectral_centroid_mean",
}
BASELINES = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("total_samples", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in BASELINE_MEASURES],
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
