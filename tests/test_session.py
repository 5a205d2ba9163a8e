from __future__ import annotations

from types import SimpleNamespace

import pytest

from lookout.session import scratch_path, settled, shared_folder, work_tables


def test_work_tables_lie_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named.rstrip("/")
    assert scratch_path(spark, "x").startswith(named.rstrip("/") + "/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert spark.sparkContext.getCheckpointDir()


def test_settled_rows_are_the_same(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k", "array(id) AS a")
    kept = settled(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert kept.exceptAll(df).count() == 0 and kept.count() == 100
    source = kept.inputFiles()[0]
    assert shared_folder(spark) in source


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, default=None: None)
    there = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(there)


def test_work_tables_go_when_the_job_ends(spark):
    import os

    before = settled(spark.range(3))
    with work_tables(spark):
        inside = settled(spark.range(5))
        kept = inside.count()
        path = inside.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert kept == 5 and not os.path.exists(path)
    assert before.count() == 3
