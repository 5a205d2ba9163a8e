"""Ordered scans and joins with a key that holds a third of the rows, against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lookout.operators import scan
from lookout.operators import windows as win
from lookout.operators.aggregates import box_stats, describe

SPLIT = 40  # rows per task, so that the hot key is cut


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows = []
    for i in range(900):
        user = 1 if i % 3 == 0 else 2 + rng.randrange(40)
        rows.append((i, user, rng.randrange(300), rng.choice([None, 1.0, 2.5, float(rng.randrange(50))])))
    return rows


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "id long, user long, at long, v double").repartition(5).cache()


def by_user(data):
    groups = defaultdict(list)
    for r in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        groups[r[1]].append(r)
    return groups


@pytest.mark.parametrize("limit", [SPLIT, 10**6])
def test_running_rank_previous(spark, table, data, limit):
    s = scan.OrderedScan(table, ["user"], ["at", "id"], limit)
    assert s.split == (limit == SPLIT)
    out = s.running({"total": F.col("v")}).rank("no").previous({"before": "id"}).done()
    got = {r["id"]: (r["total"], r["no"], r["before"]) for r in out.collect()}
    want = {}
    for rows in by_user(data).values():
        total, before = 0.0, None
        for no, (i, _, _, v) in enumerate(rows, 1):
            total += v or 0.0
            want[i] = (total, no, before)
            before = i
    assert got == want


@pytest.mark.parametrize("limit", [SPLIT, 10**6])
def test_exclusive_and_no_keys(spark, table, data, limit):
    out = scan.OrderedScan(table, [], ["at", "id"], limit).running({"n": F.lit(1)}, inclusive=False).done()
    order = [r["id"] for r in out.orderBy("n").collect()]
    assert order == [r[0] for r in sorted(data, key=lambda r: (r[2], r[0]))]


def test_slices_are_bounded(spark, table, data):
    s = scan.OrderedScan(table, ["user"], ["at", "id"], SPLIT)
    largest = s.df.groupBy("user", scan.SLICE).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * SPLIT


def test_order_types(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(50)]
    days = spark.createDataFrame(rows, "k int, day date, v double")
    a = scan.OrderedScan(days, ["k"], ["day"], 5).rank("no").done()
    assert [r["no"] for r in a.orderBy("day").collect()] == list(range(1, 51))
    stamps = days.withColumn("ts", F.col("day").cast("timestamp")).drop("day")
    b = scan.OrderedScan(stamps, ["k"], ["ts"], 5).rank("no").done()
    assert [r["no"] for r in b.orderBy("ts").collect()] == list(range(1, 51))


@pytest.mark.parametrize("limit", [5, 10**6])
def test_text_and_coarse_orders(spark, limit):
    """Text as an order column, and a first column with few values: both are cut."""
    rows = [(1, f"2024-01-{1 + i % 3:02d}", f"r{i:03d}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, day string, id string, v double").repartition(4)
    s = scan.OrderedScan(df, ["k"], ["day", "id"], limit)
    if s.split:
        assert s.df.groupBy("k", scan.SLICE).count().agg(F.max("count")).first()[0] <= 10
    got = [r["id"] for r in s.rank("no").done().orderBy("no").collect()]
    assert got == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_a_hot_key_is_cut_by_its_size(spark):
    """A key with nine tenths of the rows: no part of it is above the limit, and only its partner row is copied."""
    rows = [(1 if i % 10 else 2 + i, i) for i in range(4_000)]
    df = spark.createDataFrame(rows, "k long, id long")
    names = spark.createDataFrame([(1, "hot"), *((2 + i, "cold") for i in range(0, 4_000, 10))], "k long, name string")
    hot = scan.hot_keys(df, ["k"], 500)
    parts = hot.first()["__parts"]
    assert hot.count() == 1 and parts == 15
    sizes = df.filter("k = 1").groupBy(F.pmod(F.xxhash64("id"), F.lit(parts))).count()
    assert sizes.agg(F.max("count")).first()[0] <= 500
    out = scan.many_to_one(df, names, ["k"], "inner", ["id"], rows_per_task=500)
    assert out.count() == 4_000 and out.filter("name = 'hot'").count() == 3_600
    assert scan.hot_keys(df, ["k"], 5_000) is None


def test_missing_order_value_and_key(spark):
    rows = [(None, None, 1)] * 1 + [(None, i, 1) for i in range(20)] + [(1, None, 1)] + [(1, i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, at int, v int")
    out = scan.OrderedScan(df, ["k"], ["at"], 5).rank("no").done()
    got = sorted((r["k"] or 0, -1 if r["at"] is None else r["at"], r["no"]) for r in out.collect())
    assert [g[2] for g in got if g[0] == 1] == list(range(1, 32))
    assert [g[2] for g in got if g[0] == 0] == list(range(1, 22))


@pytest.mark.parametrize("limit", [5, 10**6])
def test_exact_quantiles(spark, table, data, limit):
    shares = {"q1": 0.25, "q2": 0.5, "p90": 0.9}
    got = {r["user"]: r for r in scan.exact_quantiles(table, ["user"], "v", shares, limit).collect()}
    frame = pd.DataFrame(data, columns=["id", "user", "at", "v"]).dropna()
    for user, part in frame.groupby("user"):
        for name, p in shares.items():
            assert got[user][name] == pytest.approx(part["v"].quantile(p))
    whole = scan.exact_quantiles(table, [], "v", shares, limit).first()
    assert whole["p90"] == pytest.approx(frame["v"].quantile(0.9))


def test_null_keys_are_a_group(spark):
    rows = [(None, float(i)) for i in range(9)] + [("a", float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("id", F.monotonically_increasing_id())
    for limit in (3, 10**6):
        got = {r["k"]: r["m"] for r in scan.exact_quantiles(df, ["k"], "v", {"m": 0.5}, limit).collect()}
        assert got == {None: 4.0, "a": 1.5}
        ranks = scan.OrderedScan(df, ["k"], ["v"], limit).rank("no").previous({"p": "v"}).done().filter("k IS NULL")
        assert [(r["no"], r["p"]) for r in ranks.orderBy("v").collect()] == [(i + 1, i - 1.0 if i else None) for i in range(9)]
    out = scan.hash_rank(df, ["k"], "id", 1, "r", "n").filter("k IS NULL").collect()
    assert sorted(r["r"] for r in out) == list(range(1, 10))
    unique = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    assert scan.many_to_one(df, unique, ["k"], "inner", ["id"]).count() == 4
    assert scan.many_to_one(df, unique, ["k"], "inner", ["id"], match_null=True).count() == 13
    # NULL keys match on the sort-merge way as well.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert scan.many_to_one(df, unique, ["k"], "inner", ["id"], match_null=True).count() == 13
        assert scan.hash_rank(df, ["k"], "id", 1, "r", "n").count() == 13
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_describe_and_box_split(spark, table):
    few, many = describe(table, ["v", "at"], 5), describe(table, ["v", "at"])
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    a, b = box_stats(table.na.drop(), "user", "v", 5), box_stats(table.na.drop(), "user", "v")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_hash_rank_is_a_permutation(spark, table):
    out = scan.hash_rank(table, ["user"], "id", 42, "r", "n").collect()
    groups = defaultdict(list)
    for row in out:
        groups[row["user"], row["n"]].append(row["r"])
    for (_, n), ranks in groups.items():
        assert sorted(ranks) == list(range(1, n + 1))


def test_many_to_one_spreads_and_keeps_rows(spark, table, data):
    names = spark.createDataFrame([(u, f"u{u}") for u in range(1, 20)], "user long, name string")
    out = scan.many_to_one(table, names, ["user"], "left", ["id"])
    assert out.count() == len(data)
    assert {r["name"] for r in out.filter("user = 1").collect()} == {"u1"}
    assert out.filter("name IS NULL").count() == sum(r[1] >= 20 for r in data)


@pytest.mark.parametrize("spread", [False, True])
def test_explode_count(spark, spread):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", 10)], "k string, n int")
    out = scan.explode_count(df, F.col("n"), "i", block=4, spread=spread)
    got = sorted((r["k"], r["i"]) for r in out.collect())
    assert got == [("b", i) for i in range(3)] + [("c", i) for i in range(10)]


def test_histories_do_not_depend_on_the_split(spark, table):
    v = {"base": "v"}
    few = win.expanding_baseline(table, "user", ["at", "id"], v, 5, True, SPLIT)
    one = win.expanding_baseline(table, "user", ["at", "id"], v, 5, True)
    columns = ["id", "baseline_n", F.round("base", 9)]
    assert sorted(map(str, few.select(*columns).collect())) == sorted(map(str, one.select(*columns).collect()))
    for f in (win.deviation_z, win.user_trend):
        a = f(table, "user", ["at", "id"], "v", rows_per_task=SPLIT)
        b = f(table, "user", ["at", "id"], "v")
        names = sorted(set(a.columns) - {"at", "v"})

        def shown(df):
            return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(names).collect())

        assert shown(a) == shown(b)


def test_sessions_split(spark, data):
    rows = [(r[0], r[1], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * r[2])) for r in data]
    events = spark.createDataFrame(rows, "id long, user long, ts timestamp")
    few = win.sessions(events, "user", "ts", "id", 1200, SPLIT)
    one = win.sessions(events, "user", "ts", "id", 1200)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, one.collect()))
    assert few.agg(F.sum("n")).first()[0] == len(data)


@pytest.mark.parametrize("slice_rows", [8, 17, 10_000])
def test_local_peaks(spark, slice_rows):
    rng = random.Random(3)
    rows = [(k, p, rng.random()) for k in (1, 2) for p in range(1, 60)]
    got = win.local_peaks(spark.createDataFrame(rows, "k int, pos long, x double"), "k", "pos", "x", 3, 0.1, slice_rows)
    want = set()
    for k in (1, 2):
        x = [r[2] for r in rows if r[0] == k]
        for i in range(1, len(x) - 1):
            near = x[max(0, i - 3) : i + 4]
            if x[i] > x[i - 1] and x[i] >= x[i + 1] and x[i] >= sum(near) / len(near) + 0.1:
                want.add((k, i + 1))
    assert {(r["k"], r["pos"]) for r in got.collect()} == want
    with pytest.raises(ValueError):
        win.local_peaks(got, "k", "pos", "x", 9, 0.1, 8)


@pytest.mark.parametrize("limit", [6, 10**6])
def test_islands(spark, limit):
    on = [1, 2, 3, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 30]
    df = spark.createDataFrame([("s", p, p in on) for p in range(1, 32)], "k string, pos long, on boolean")
    out = win.active_islands(df, ["k"], "pos", F.col("on"), limit)
    got = sorted((r["first_pos"], r["last_pos"], r["length"]) for r in out.collect())
    assert got == [(1, 3, 3), (7, 8, 2), (10, 20, 11), (30, 30, 1)]


def test_no_hot_window_in_the_plan(spark, table):
    """The rank-limited forms cut every key before the shuffle."""
    plan = win.latest_per_key(table, ["user"], "at", "id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
