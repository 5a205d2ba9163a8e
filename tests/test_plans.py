"""What the plans must look like: pruned scans, no products of rows, one shuffle where one is enough."""

from __future__ import annotations

import re

import pytest

from lookout import catalog

FOLDER = "/root/testdata/sf0.001"
LAZY = [
    "scan_user_records",
    "filter_conjunct",
    "latest_per_user",
    "sample_per_class",
    "daily_first",
    "user_baseline",
    "interval_join",
    "chunk_language",
    "language_features",
    "lexicon_sentiment",
    "trend_flags",
    "expanding_baseline",
    "roc_auc",
    "confusion_matrix",
    "stratified_split",
    "knn_in_class",
    "signal_features",
]


def plan(spark, name):
    return catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_filters_reach_the_scan(spark):
    assert "EqualTo(user_id,8)" in plan(spark, "scan_user_records")
    assert "EqualTo(l_returnflag,R)" in plan(spark, "filter_conjunct")


def test_columns_are_pruned(spark):
    p = plan(spark, "user_baseline")
    read = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert read and "props" not in read[0] and "event_id" not in read[0]


@pytest.mark.parametrize("name,shuffles", [("lexicon_sentiment", 1), ("latest_per_user", 1),
                                           ("tumbling_agg", 1), ("rule_score", 1), ("session_agg", 1)])
def test_shuffles(spark, name, shuffles):
    physical = plan(spark, name).split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == shuffles


def test_first_rows_are_cut_before_the_shuffle(spark):
    for name in ("latest_per_user", "sample_per_class", "daily_first"):
        assert re.search(r"WindowGroupLimit.*Partial", plan(spark, name))
