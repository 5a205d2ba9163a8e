"""Per-subject histories: latest record, growing baseline, deviation, trend, peaks, islands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.operators.aggregates import MIN_BASELINE_ROWS
from lookout.operators.relational import known_number
from lookout.operators.scan import ROWS_PER_TASK, OrderedScan, many_to_one

FLAT = 1e-9  # a spread below this is rounding noise
ROUNDING = 4e-16  # and one below this part of the value


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key. Spark keeps only ``n`` rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    return first_per_key(df, keys, [F.desc(ts), F.desc(tie)])


def expanding_baseline(
    records: DataFrame,
    key: str,
    order: Sequence[str],
    measures: Mapping[str, str],
    min_rows: int = MIN_BASELINE_ROWS,
    inclusive: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The baseline as it stood after (or before) each record; NULL while below ``min_rows``."""
    sums: dict[str, Column] = {"baseline_n": F.lit(1).cast("bigint")}
    for out, c in measures.items():
        v = known_number(F.col(c))
        sums[f"__s_{out}"] = v
        sums[f"__c_{out}"] = F.when(v.isNotNull(), 1).otherwise(0).cast("bigint")
    done = OrderedScan(records, [key], order, rows_per_task).running(sums, inclusive).done()
    enough = F.col("baseline_n") >= min_rows
    return done.withColumns(
        {o: F.when(enough, F.try_divide(F.col(f"__s_{o}"), F.col(f"__c_{o}"))) for o in measures}
    ).drop(*[f"__{p}_{o}" for o in measures for p in "sc"])


def deviation_z(
    records: DataFrame,
    key: str,
    order: Sequence[str],
    measure: str,
    min_rows: int = MIN_BASELINE_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Distance of each record from the mean of the subject's earlier ones, in their sample std.

    Sums run over the distance from the subject's overall mean, so a large common part of the values does not eat up
    the digits of the spread. A spread within the rounding of the values is none.
    """
    known = records.withColumn("__v", known_number(F.col(measure)))
    centers = known.groupBy(key).agg(F.coalesce(F.avg("__v"), F.lit(0.0)).alias("__center"))
    near = many_to_one(known, centers, [key], "left", order, True, rows_per_task)
    d = F.col("__v") - F.col("__center")
    sums = {"past_n": F.when(d.isNotNull(), 1).otherwise(0).cast("bigint"), "__s": d, "__ss": d * d}
    done = OrderedScan(near, [key], order, rows_per_task).running(sums, inclusive=False).done()
    n = F.col("past_n")
    mean = F.try_divide(F.col("__s"), n)
    spread = F.sqrt(F.greatest(F.try_divide(F.col("__ss") - F.col("__s") * mean, n - 1), F.lit(0.0)))
    usable = (n >= min_rows) & (spread > F.greatest(F.lit(FLAT), F.abs("__center") * ROUNDING))
    return done.withColumns(
        {
            "past_mean": F.when(n >= min_rows, F.col("__center") + mean),
            "z": F.when(usable, F.try_divide(F.col("__v") - F.col("__center") - mean, spread)),
        }
    ).drop("__s", "__ss", "__v", "__center")


def user_trend(
    records: DataFrame, key: str, order: Sequence[str], measure: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Per subject: slope of the measure over its recordings and mean step between neighbours.

    A missing value or NaN keeps its place in the order and takes no part in slope and steps.
    """
    records = records.withColumn(measure, known_number(F.col(measure)))
    done = OrderedScan(records, [key], order, rows_per_task).rank("__no").previous({"__before": measure}).done()
    return done.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.col(measure), F.col("__no").cast("double")).alias("slope"),
        F.avg(F.col(measure) - F.col("__before")).alias("mean_step"),
    )


def with_position(df: DataFrame, key: str, order: Sequence[str], name: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    return OrderedScan(df, [key], order, rows_per_task).rank(name).done()


def local_peaks(
    series: DataFrame,
    key: str,
    pos: str,
    value: str,
    width: int,
    delta: float,
    slice_rows: int = 65_536,
) -> DataFrame:
    """Rows that top both neighbours and the mean of the ``width`` rows on each side by ``delta``.

    ``pos`` counts 1, 2, 3 .. per key. Each series is cut into slices of ``slice_rows``
    positions; the ``width`` rows next to a cut go to both slices, so no series is one task.
    """
    if width >= slice_rows:
        raise ValueError("slice_rows must exceed width")

    def slice_of(p: Column) -> Column:
        return F.floor(p / F.lit(slice_rows))

    p = F.col(pos)
    cut = series.withColumn(
        "__slice", F.explode(F.array_distinct(F.array(slice_of(p - width), slice_of(p), slice_of(p + width))))
    )
    w = Window.partitionBy(key, "__slice").orderBy(pos)
    near = w.rowsBetween(-width, width)
    v = F.col(value)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    peak = (v > before) & (v >= after) & (v >= F.avg(v).over(near) + delta)
    return (
        cut.withColumn("__peak", F.coalesce(peak, F.lit(False)))
        .filter(F.col("__slice") == slice_of(p))
        .filter("__peak")
        .drop("__slice", "__peak")
    )


def active_islands(
    frames: DataFrame, keys: Sequence[str], pos: str, active: Column, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Runs of neighbouring active positions: first, last and length of each."""
    on = frames.filter(active)
    numbered = OrderedScan(on, keys, [pos], rows_per_task).rank("__no").done()
    return (
        numbered.groupBy(*keys, (F.col(pos) - F.col("__no")).alias("__run"))
        .agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("length"))
        .drop("__run")
    )


def sessions(
    events: DataFrame, key: str, ts: str, tie: str, gap_seconds: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Batch sessions: a new one starts after a pause of more than ``gap_seconds``, as in a session window."""
    timed = events.select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
    scan = OrderedScan(timed, [key], ["__us", tie], rows_per_task).previous({"__before": "__us"})
    fresh = F.col("__before").isNull() | (F.col("__us") - F.col("__before") > gap_seconds * 1_000_000)
    numbered = scan.running({"__session": F.when(fresh, 1).otherwise(0).cast("bigint")}).done()
    return (
        numbered.groupBy(key, "__session")
        .agg(
            F.timestamp_micros(F.min("__us")).alias("first_ts"),
            F.timestamp_micros(F.max("__us")).alias("last_ts"),
            F.count(F.lit(1)).alias("n"),
        )
        .drop("__session")
    )
