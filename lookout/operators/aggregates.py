"""Grouped summaries: means, baselines, shares, quartiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.operators.relational import known_number
from lookout.operators.scan import ROWS_PER_TASK, exact_quantiles, many_to_one

QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
MIN_BASELINE_ROWS = 5


def group_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per group, lowest first. NaN is missing, here and in every summary."""
    return df.groupBy(key).agg(F.avg(known_number(F.col(value))).alias("mean_value")).orderBy("mean_value")


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def class_share(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage per class. There may be as many classes as rows: the total is one number, not a window."""
    counts = value_counts(df, key)
    total = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return counts.withColumn("share_pct", F.col("n") * 100.0 / total)


def user_baseline(
    records: DataFrame,
    key: str,
    measures: Mapping[str, str],
    min_rows: int = MIN_BASELINE_ROWS,
) -> DataFrame:
    """Mean of each measure per subject. Subjects with fewer than ``min_rows`` records have none.

    ``total_samples`` counts all rows; the means skip missing values and NaN.
    """
    return (
        records.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("total_samples"),
            *[F.avg(known_number(F.col(c))).alias(o) for o, c in measures.items()],
        )
        .filter(F.col("total_samples") >= min_rows)
    )


def local_date(ts: Column, zone: str) -> Column:
    """Calendar day of a UTC timestamp in ``zone``."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")))


def uploaded_on_day(records: DataFrame, key: str, ts: str, day: Column, zone: str = "UTC") -> DataFrame:
    """Per subject: did a record arrive on ``day`` (local date)?"""
    return records.groupBy(key).agg(
        (F.count_if(local_date(F.col(ts), zone) == day) > 0).alias("uploaded"),
    )


def describe(df: DataFrame, columns: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Count, mean, std, min, quartiles, max; one row per column."""
    long = df.select(*[known_number(F.col(c)).alias(c) for c in columns]).unpivot([], list(columns), "measure", "v")
    basics = long.groupBy("measure").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    return basics.join(exact_quantiles(long, ["measure"], "v", QUARTILES, rows_per_task), "measure", "left")


def box_stats(df: DataFrame, key: str, value: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Quartiles, whiskers (outermost values within 1.5 IQR) and outlier count per class."""
    df = df.select(key, known_number(F.col(value)).alias(value)).filter(F.col(value).isNotNull())
    quartiles = exact_quantiles(df, [key], value, QUARTILES, rows_per_task)
    # Quartiles of all classes, one row each; rows of a hot class are spread by their value.
    counted = df.groupBy(key, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    joined = many_to_one(counted, quartiles, [key], "inner", ["__v"], True, rows_per_task)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("__v").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(key).agg(
        *[F.max(q).alias(q) for q in QUARTILES],
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("__c"))).alias("outliers"),
    )


def frame_summary(frames: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean and population std of frame measures per chunk, NaN skipped, 0 when nothing is left."""
    out = []
    for m in measures:
        v = known_number(F.col(m))
        out.append(F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{m}_mean"))
        out.append(F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"{m}_std"))
    return frames.groupBy(*keys).agg(*out)


def corpus_report(chunks: DataFrame, subject: str, label: str, n_features: int) -> DataFrame:
    """Subjects, chunks, features and the label split of a chunk table, one row per label."""
    per = chunks.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per subject before the total count, so a long subject is counted in parts.
    subjects = chunks.select(subject).distinct().agg(F.count(F.lit(1)))
    everything = Window.partitionBy()
    return per.select(
        F.col(label),
        F.col("n"),
        (F.col("n") * 100.0 / F.sum("n").over(everything)).alias("share_pct"),
        F.sum("n").over(everything).alias("total_chunks"),
        subjects.scalar().alias("total_subjects"),
        F.lit(n_features).alias("n_features"),
    )
