"""Baselines and alerts of arriving records in one stateful pass.

Every subject has one value state: the number of records, and per measure the sum and count of its values. An arriving record is
added to it and leaves with the baseline as of its arrival, so flags and decisions need no join with a stored table. The state can
start from the records of a table (``state_of``). Rows of a subject that arrive in one batch are taken in the given
order; a batch is bounded by its files. The state lies in RocksDB and goes on from the checkpoint. With ``idle`` a timer per
subject fires when the watermark is that far beyond its latest record, and the subject's baseline is reported once as idle; a later
record starts the timer again.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lookout.operators import decide
from lookout.operators.aggregates import MIN_BASELINE_ROWS
from lookout.operators.relational import known_number
from lookout.streaming.jobs import durable_state

AT = "arrived_us"


def state_of(records: DataFrame, key: str, measures: Mapping[str, str]) -> DataFrame:
    """What a subject's state is after ``records``: number of rows, sum and count per measure."""
    parts = [F.count(F.lit(1)).alias("n")]
    for out, c in measures.items():
        parts += [F.coalesce(F.sum(known_number(F.col(c))), F.lit(0.0)).alias(f"s_{out}"), F.count(known_number(F.col(c))).alias(f"c_{out}")]
    return records.groupBy(key).agg(*parts)


class GrowingBaseline(StatefulProcessor):
    """Adds records to the state of their subject; see the module."""

    def __init__(self, key: str, order: Sequence[str], measures: Mapping[str, str], columns: Sequence[str], inclusive: bool, idle_ms: int | None):
        self.key, self.order, self.measures, self.columns = key, list(order), dict(measures), list(columns)
        self.inclusive, self.idle_ms = inclusive, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("n", T.LongType())]
        for out in self.measures:
            fields += [T.StructField(f"s_{out}", T.DoubleType()), T.StructField(f"c_{out}", T.LongType())]
        self.state = handle.getValueState("baseline", T.StructType(fields))
        self.row = Row(*self.columns, "baseline_n", *self.measures, "idle")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        parts = [v for out in self.measures for v in (float(initialState[f"s_{out}"]), int(initialState[f"c_{out}"]))]
        self.state.update((int(initialState["n"]), *parts))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Rows and not pandas: most subjects send a few records per batch, and making a frame for each of them is most of the work.
        arrived = sorted(rows, key=lambda row: [_last_if_missing(row[c]) for c in self.order])
        held = self.state.get()
        state = list(held) if held is not None else [0, *([0.0, 0] * len(self.measures))]
        start, sums, counts = list(state), [0.0] * len(self.measures), [0] * len(self.measures)
        latest = max((row[AT] for row in arrived if row[AT] is not None), default=None)
        arrived.reverse()
        while arrived:  # each row is let go when it is judged
            row, before = arrived.pop(), list(state)
            state[0] += 1
            for i, column in enumerate(self.measures.values()):
                value = row[column]
                if value is not None and math.isfinite(value):
                    sums[i] += float(value)
                    counts[i] += 1
                state[1 + 2 * i], state[2 + 2 * i] = start[1 + 2 * i] + sums[i], start[2 + 2 * i] + counts[i]
            yield self._judged([row[c] for c in self.columns], state if self.inclusive else before, False)
        self.state.update(tuple(state))
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(latest // 1000 + self.idle_ms)

    def _judged(self, kept: list, state: list, idle: bool) -> Row:
        means = [state[1 + 2 * i] / state[2 + 2 * i] if state[2 + 2 * i] else None for i in range(len(self.measures))]
        return self.row(*kept, state[0], *means, idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._judged([key[0] if c == self.key else None for c in self.columns], self.state.get(), True)


def _last_if_missing(value) -> tuple:
    missing = value is None or value != value
    return missing, 0 if missing else value


def with_baseline(
    stream: DataFrame,
    key: str,
    ts: str,
    tie: str,
    measures: Mapping[str, str],
    initial: DataFrame | None = None,
    min_rows: int = MIN_BASELINE_ROWS,
    inclusive: bool = True,
    idle: dt.timedelta | None = None,
) -> DataFrame:
    """Each arriving row with ``baseline_n`` and its subject's baseline as of its arrival (NULL below ``min_rows``), and ``idle`` false.

    ``measures`` maps baseline columns to columns of the stream; rows of one batch are ordered by ``ts`` and ``tie``. ``initial`` is a
    table of ``state_of``. With ``idle`` the stream needs a watermark on ``ts``, and rows with ``idle`` true tell of
    subjects that have sent nothing for so long.
    """
    durable_state(stream.sparkSession)
    kept = [f for f in stream.schema if f.name != ts]
    rows = stream.withColumn(AT, F.unix_micros(ts))
    out = T.StructType([*kept]).add("baseline_n", T.LongType())
    for name in measures:
        out = out.add(name, T.DoubleType())
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.add("idle", T.BooleanType())])
    columns = [f.name for f in kept]
    processor = GrowingBaseline(key, [AT, tie], measures, columns, inclusive, None if idle is None else int(idle.total_seconds() * 1000))
    done = rows.groupBy(key).transformWithState(
        processor, out, "append", "none" if idle is None else "eventTime", initialState=None if initial is None else initial.groupBy(key)
    )
    enough = F.col("baseline_n") >= min_rows
    return done.withColumns({m: F.when(enough & ~F.isnan(m), F.col(m)) for m in measures})


def alerts_as_of(
    stream: DataFrame,
    key: str,
    ts: str,
    tie: str,
    flags: dict[str, tuple[str, str]],
    predict: Callable[[DataFrame], DataFrame],
    initial: DataFrame | None = None,
    min_rows: int = MIN_BASELINE_ROWS,
) -> DataFrame:
    """Each arrival against its subject's baseline of that moment, its own values included: trend flags, class, status, advice.

    ``flags`` maps a trend flag to (current, baseline) columns; ``predict`` adds ``model_risk``.
    """
    judged = with_baseline(stream, key, ts, tie, {base: now for now, base in flags.values()}, initial, min_rows)
    return decide.fallback_decision(predict(judged.withColumns(decide.trend_flags(flags))), "model_risk")
