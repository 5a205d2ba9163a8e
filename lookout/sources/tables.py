"""Record tables: append, read, bulk load; text files. Keyed tables are in ``commits``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.operators.aggregates import MIN_BASELINE_ROWS, user_baseline
from lookout.operators.relational import join_with_suffix, with_defaults
from lookout.schemas import BASELINE_MEASURES, RECORD_DEFAULTS, RECORDS

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    # An empty text and a missing one stay different.
    "nullValue": "\\N",
    "emptyValue": "",
    # Blanks and line ends inside values belong to them.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
CORRUPT = "_corrupt_record"


def write_text_table(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS, sep=separator).csv(path)


def read_text_table(
    spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", multi_line: bool = False
) -> DataFrame:
    """Header text file with a declared schema. Lines that do not fit keep their text in a column of its own.

    ``multi_line`` is for values with line ends in them; such a file cannot be cut into parts.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(full)
        .options(**CSV_OPTIONS, sep=separator, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .option("multiLine", multi_line)
        .csv(path)
    )


def as_records(df: DataFrame, ts: Column | None = None) -> DataFrame:
    """Bring rows to the record schema: missing columns NULL, defaults filled, id and day added."""
    for f in RECORDS.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    df = with_defaults(df, RECORD_DEFAULTS).withColumns(
        {
            "record_id": F.coalesce("record_id", F.uuid()),
            "ts": F.coalesce(F.col("ts").cast("timestamp"), ts if ts is not None else F.current_timestamp()),
        }
    )
    df = df.withColumn("record_date", F.to_date("ts"))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORDS.fields])


def append_records(df: DataFrame, path: str) -> None:
    """Append to the record table, one folder per day, rows of a day in the order of the user.

    The rebalance brings the rows of a day together and splits days that are too large for a task. The order gives every
    part of a file narrow bounds on the user, so a read of one user skips the rest.
    """
    rows = as_records(df).hint("rebalance", "record_date").sortWithinPartitions("record_date", "user_id", "ts")
    rows.write.mode("append").partitionBy("record_date").parquet(path)


def read_records(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    records = spark.read.schema(RECORDS).parquet(path)
    return records if user_id is None else records.filter(F.col("user_id") == user_id)


def baselines_of(
    records: DataFrame, min_rows: int = MIN_BASELINE_ROWS, measures: Mapping[str, str] = BASELINE_MEASURES
) -> DataFrame:
    return user_baseline(records, "user_id", measures, min_rows).withColumn("updated_at", F.current_timestamp())


def bulk_load(
    prosody: DataFrame, language: DataFrame, on: Sequence[str], path: str, min_rows: int = MIN_BASELINE_ROWS
) -> DataFrame:
    """Join two feature tables, append the rows as records and return the baselines of the whole table."""
    merged = join_with_suffix(prosody, language, on, "_lang")
    append_records(merged, path)
    return baselines_of(read_records(prosody.sparkSession, path), min_rows)
