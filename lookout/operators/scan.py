"""Ordered computations over groups of any size.

A window partitioned by a key sorts all rows of one key in one task. That is fine
until one key holds a large part of the table. ``OrderedScan`` looks at the largest
group first. Below ``rows_per_task`` it uses the plain window. Above it, the rows of
the large keys are range-partitioned by the whole order into slices; the window then runs
per (key, slice) and what earlier slices contribute is added from one total per slice.
Both ways give the same result, for every type that can be ordered.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.session import settled

ROWS_PER_TASK = 2_000_000
STREAM_SALTS = 16
SLICE, KEY = "__slice", "__key"


def key_of(columns: Sequence[str]) -> Column:
    """All key columns as one struct. Unlike bare columns, structs with a NULL inside do match in a join."""
    return F.struct(*columns) if columns else F.struct(F.lit(1).alias("one"))


class OrderedScan:
    """Running sums, ranks and previous values per key, along ``order`` ascending.

    ``order`` must be a total order within a key. The slices are cut along all of it.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        rows_per_task: int = ROWS_PER_TASK,
    ):
        self.keys, self.order = list(keys), list(order)
        self.df = df
        self.split = False
        sizes = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__rows"))
        top, total = sizes.agg(F.max("__rows"), F.sum("__rows")).first()
        if (top or 0) > rows_per_task:
            self._cut(sizes, total, rows_per_task)

    def _cut(self, sizes: DataFrame, total: int, rows_per_task: int) -> None:
        # At most total / rows_per_task keys are this large. Spark broadcasts their list while it is short.
        large = sizes.filter(F.col("__rows") > rows_per_task)
        large = settled(large.select(key_of(self.keys).alias(KEY), F.lit(True).alias("__large")))
        marked = self.df.withColumn(KEY, key_of(self.keys)).join(large, KEY, "left")
        heavy = marked.filter("__large").drop("__large")
        # The number of a row's range partition is written with the row, so every use cuts at the same places.
        slices = 2 * math.ceil(total / rows_per_task)
        placed = settled(heavy.repartitionByRange(slices, KEY, *self.order).withColumn(SLICE, F.spark_partition_id()))
        # Rows of ordinary keys have no slice, so they take no part in the totals and match nothing.
        usual = marked.filter(F.col("__large").isNull()).drop("__large").withColumn(SLICE, F.lit(None).cast("int"))
        self.df = usual.unionByName(placed)
        self.split = True

    @property
    def _group(self) -> list[str]:
        return [KEY, SLICE] if self.split else self.keys

    def _window(self):
        return Window.partitionBy(*self._group).orderBy(*self.order)

    def _with_earlier(self, earlier: DataFrame) -> DataFrame:
        return self.df.join(earlier, self._group, "left")

    def running(self, sums: Mapping[str, Column], inclusive: bool = True) -> OrderedScan:
        """Running sum of each expression; 0 before the first row."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        zero = F.lit(0)
        earlier = None
        if self.split:
            totals = self.df.filter(F.col(SLICE).isNotNull()).groupBy(*self._group).agg(*[F.sum(c).alias(f"__e_{o}") for o, c in sums.items()])
            before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
            earlier = totals.withColumns({f"__e_{o}": F.sum(f"__e_{o}").over(before) for o in sums})
        self.df = self.df.withColumns({o: F.coalesce(F.sum(c).over(frame), zero) for o, c in sums.items()})
        if earlier is not None:
            self.df = (
                self._with_earlier(earlier)
                .withColumns({o: F.col(o) + F.coalesce(F.col(f"__e_{o}"), zero) for o in sums})
                .drop(*[f"__e_{o}" for o in sums])
            )
        return self

    def rank(self, name: str) -> OrderedScan:
        """1-based position within the key."""
        return self.running({name: F.lit(1).cast("bigint")})

    def previous(self, values: Mapping[str, str]) -> OrderedScan:
        """The value of a column in the row before, NULL in the first row of a key."""
        w = self._window()
        if not self.split:
            self.df = self.df.withColumns({o: F.lag(c).over(w) for o, c in values.items()})
            return self
        last = self.df.filter(F.col(SLICE).isNotNull()).groupBy(*self._group).agg(
            F.max_by(F.struct(*[F.col(c).alias(o) for o, c in values.items()]), F.struct(*self.order)).alias("__last")
        )
        by_slice = Window.partitionBy(KEY).orderBy(SLICE)
        earlier = last.withColumn("__last", F.lag("__last").over(by_slice))
        self.df = self.df.withColumns(
            {**{o: F.lag(c).over(w) for o, c in values.items()}, "__first": F.row_number().over(w) == 1}
        )
        self.df = (
            self._with_earlier(earlier)
            .withColumns({o: F.when(F.col("__first"), F.col(f"__last.{o}")).otherwise(F.col(o)) for o in values})
            .drop("__last", "__first")
        )
        return self

    def done(self) -> DataFrame:
        return self.df.drop(SLICE, KEY) if self.split else self.df


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact interpolated quantiles per key, one row per key.

    Counts per distinct value, running counts along the value, then the values at the
    wanted places. No group is held in memory, unlike with the ``percentile`` aggregate.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    counts = settled(counts)
    scan = OrderedScan(counts, keys, ["__v"], rows_per_task).running({"__upto": F.col("__c")})
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    if keys:
        placed = many_to_one(scan.done(), sizes, keys, "inner", ["__v"], True, rows_per_task)
    else:
        placed = scan.done().withColumn("__n", sizes.scalar())
    picks = []
    for name, p in shares.items():
        at = F.lit(p) * (F.col("__n") - 1)
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("__upto") - F.col("__c") <= k) & (k < F.col("__upto"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}_{name}"))
        picks.append(F.max(at - F.floor(at)).alias(f"__f_{name}"))
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"__lo_{q}") + (F.col(f"__hi_{q}") - F.col(f"__lo_{q}")) * F.col(f"__f_{q}")).alias(q)
            for q in shares
        ],
    )


def hash_rank(df: DataFrame, keys: Sequence[str], id_col: str, seed: int, rank: str, size: str) -> DataFrame:
    """Pseudo-random 1-based rank of each row within its key, and the size of the key.

    Rows are ordered by the MD5 of id and seed. The first hex digits of it cut every key
    into 65,536 even parts, so a key that holds most of the table is spread as well.
    """
    keys = list(keys)
    mixed = df.withColumn("__h", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))))
    mixed = mixed.withColumns({"__part": F.substring("__h", 1, 4), KEY: key_of(keys)})
    parts = mixed.groupBy(KEY, "__part").agg(F.count(F.lit(1)).alias("__c"))
    along = Window.partitionBy(KEY).orderBy("__part")
    parts = parts.select(
        KEY,
        "__part",
        (F.sum("__c").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"),
        F.sum("__c").over(Window.partitionBy(KEY)).alias(size),
    )
    w = Window.partitionBy(KEY, "__part").orderBy("__h", id_col)
    return (
        mixed.withColumn("__r", F.row_number().over(w))
        .join(parts, [KEY, "__part"])
        .withColumn(rank, F.col("__r") + F.col("__before"))
        .drop("__h", "__part", "__r", "__before", KEY)
    )


def hot_keys(df: DataFrame, on: Sequence[str], rows_per_task: int) -> DataFrame | None:
    """Keys with more than ``rows_per_task`` rows and into how many parts they are cut; None without any."""
    sizes = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows_per_task)
    hot = settled(sizes.select(*on, F.ceil(2 * F.col("__n") / F.lit(rows_per_task)).cast("int").alias("__parts")))
    return hot if hot.take(1) else None


def many_to_one(
    df: DataFrame,
    unique: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = (),
    match_null: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join to a table with one row per key, with the rows of a hot key cut into parts of at most ``rows_per_task``.

    The keys are counted first; only hot ones are cut, each by its size, and only their row of ``unique`` is
    copied. ``spread_by`` names columns that tell rows of one key apart; the part is a hash of them, so a recomputed
    task sends each row where it went before. No broadcast is forced: Spark broadcasts ``unique`` by itself while it is
    below its size limit. A stream cannot be counted; a batch of it, bounded by its files, is cut into
    ``STREAM_SALTS`` parts. With ``match_null`` a NULL key finds the NULL key.
    """
    on = list(on)
    if match_null:
        keyed = unique.withColumn(KEY, key_of(on)).drop(*on)
        return many_to_one(df.withColumn(KEY, key_of(on)), keyed, [KEY], how, spread_by, rows_per_task=rows_per_task).drop(KEY)
    spread = F.xxhash64(*spread_by)
    if df.isStreaming:
        cut = df.withColumn("__part", F.pmod(spread, F.lit(STREAM_SALTS)).cast("int"))
        copies = unique.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(STREAM_SALTS - 1))))
        return cut.join(copies, [*on, "__part"], how).drop("__part")
    hot = hot_keys(df, on, rows_per_task)
    if hot is None:
        return df.join(unique, on, how)
    parts = F.coalesce("__parts", F.lit(1))
    cut = df.join(hot, on, "left").withColumn("__part", F.pmod(spread, parts).cast("int")).drop("__parts")
    copies = unique.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return cut.join(copies, [*on, "__part"], how).drop("__part")


def explode_count(df: DataFrame, count: Column, name: str, block: int = 65_536, spread: bool = False) -> DataFrame:
    """One row per number 0 .. count-1, in two steps so that no array is longer than ``block``.

    With ``spread`` the blocks are dealt out to all tasks before the second step.
    """
    blocks = (
        df.withColumn("__count", count.cast("bigint"))
        .filter(F.col("__count") > 0)
        .withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__count") - 1, F.lit(block).cast("bigint"))))
    )
    if spread:
        blocks = blocks.repartition("__from")
    last = F.least(F.col("__from") + F.lit(block - 1), F.col("__count") - 1)
    return blocks.withColumn(name, F.explode(F.sequence(F.col("__from"), last))).drop("__count", "__from")
