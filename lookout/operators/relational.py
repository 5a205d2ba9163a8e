"""Projections, predicates, joins and set operations on record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.operators.scan import explode_count, many_to_one


def name_fields(name: Column, separator: str, ending: str | None = None) -> Column:
    """The fields of a file name. ``separator`` and ``ending`` are plain text."""
    if ending:
        name = F.replace(name, F.lit(ending), F.lit(""))
    return F.split(name, f"\\Q{separator}\\E")


def with_field_count(df: DataFrame, fields: str, at_least: int) -> DataFrame:
    return df.filter(F.size(fields) >= at_least)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed lookup table written in the program, as one row of literals that is unfolded.

    Spark sees that it is small and broadcasts it by itself.
    """

    def literal(v: object) -> Column:
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    structs = [
        F.struct(*[literal(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def code_lookup(df: DataFrame, codes: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """Left join to a code table; ``default`` where the code is unknown."""
    return df.join(codes, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def in_range_category(value: Column, low: int, high: int, inside: str, outside: str) -> Column:
    """Category of a number given as text; text that is no number counts as outside."""
    return F.when(value.try_cast("int").between(low, high), inside).otherwise(outside)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def is_bad_number(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def clean_number(value: Column) -> Column:
    """0 in place of missing, NaN and infinite values."""
    value = value.cast("double")
    return F.when(is_bad_number(value), 0.0).otherwise(value)


def known_number(value: Column) -> Column:
    """NULL in place of NaN, so that averages skip it."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def project_available(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *available(df, wanted))


def label_source(df: DataFrame, columns: Sequence[str], name: str | None, place: int, default: str) -> Column:
    """First label column the table has; else a field of the file name, else ``default``."""
    found = available(df, columns)
    if found:
        return F.col(found[0])
    if name not in df.columns:
        raise ValueError(f"no label source: none of {list(columns)} and no file name column")
    return F.coalesce(F.get(F.split(F.col(name), "_"), F.lit(place)), F.lit(default))


def long_enough(df: DataFrame, samples: str, minimum: int) -> DataFrame:
    return df.filter(F.size(samples) >= minimum)


def split_rejects(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one)."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def or_default(value: Column, default: float) -> Column:
    return F.coalesce(value, F.lit(default))


def as_divisor(value: Column) -> Column:
    """1 in place of a missing or zero divisor."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(1.0))


def join_with_suffix(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str) -> DataFrame:
    """Inner join; columns of ``right`` that also occur in ``left`` get the suffix."""
    on = list(on)
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on)


def chunk_spine(subjects: DataFrame, total: str, width: float) -> DataFrame:
    """One row per full chunk of each subject; the tail shorter than ``width`` is dropped."""
    return explode_count(subjects, F.floor(F.col(total) / F.lit(width)), "chunk_id").withColumn(
        "chunk_start", F.col("chunk_id") * F.lit(width)
    )


def interval_join(
    spine: DataFrame, utterances: DataFrame, subject: str, start: str, width: float
) -> DataFrame:
    """Every chunk with the utterances that start in [start, start + width).

    The two range conditions become one equality on the chunk number.
    """
    placed = utterances.withColumn("chunk_id", F.floor(F.col(start) / F.lit(width)))
    return spine.join(placed, [subject, "chunk_id"], "left")


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def join_baseline(records: DataFrame, baseline: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    """Records with their subject's baseline; records without one are kept."""
    return many_to_one(records, baseline, [key], "left", spread_by)


def existing(subjects: DataFrame, files: DataFrame, on: Sequence[str]) -> DataFrame:
    return subjects.join(files, list(on), "left_semi")


def missing(subjects: DataFrame, files: DataFrame, on: Sequence[str]) -> DataFrame:
    return subjects.join(files, list(on), "left_anti")


def paired_difference(
    df: DataFrame, subject: str, condition: str, base: str, other: str, value: str
) -> DataFrame:
    """Mean of ``value`` under two conditions per subject and the difference in percent of ``base``."""

    def mean_if(which: str) -> Column:
        return F.avg(F.when(F.col(condition) == which, F.col(value)))

    return (
        df.filter(F.col(condition).isin(base, other))
        .groupBy(subject)
        .agg(mean_if(base).alias("base_mean"), mean_if(other).alias("other_mean"))
        .filter(F.col("base_mean").isNotNull() & F.col("other_mean").isNotNull())
        .withColumn("diff_pct", F.try_divide(F.col("other_mean") - F.col("base_mean"), F.col("base_mean")) * 100)
    )


def union_all(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
