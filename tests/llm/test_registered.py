"""Registered queries against their SQL, the pipeline against its stages, and the guard around the subpackage."""

from __future__ import annotations

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import plain, rows_of
from lookout.llm import exact, lshforest, queries, wumanber

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rel = con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
    assert plain(None) is None


def test_all_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_pipeline(spark):
    """Every stage does to its input what its operator says, and the mixture covers all that is left."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "benchmark decontamination", "mixing sources"]
    good = stage["quality classifier"](spark, docs, FOLDER).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good.collect()}
    wrong = [i for i, q in labels.items() if (i in ids) != (q == 1)]
    assert good.columns == docs.columns and len(wrong) <= 0.05 * len(labels)

    single = stage["exact dedup"](spark, good, FOLDER).cache()
    kept = {r["doc_id"] for r in exact.exact_groups(good).where("kept").collect()}
    assert {r["doc_id"] for r in single.collect()} == kept
    apart = stage["minhash near-dedup"](spark, single, FOLDER).cache()
    kept = {r["doc_id"] for r in lshforest.near_components(single, percent=80).where("kept").collect()}
    assert {r["doc_id"] for r in apart.collect()} == kept
    clean = stage["benchmark decontamination"](spark, apart, FOLDER).cache()
    found = wumanber.contamination(apart, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    kept = {r["doc_id"] for r in found.where("NOT (n_hit > 0 AND 20 * n_hit >= n_words)").collect()}
    assert {r["doc_id"] for r in clean.collect()} == kept
    mixed = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in mixed.collect()} == kept
    total = mixed.selectExpr("sum(taken)", "sum(size)").first()
    assert abs(total[0] - total[1]) <= 20
    for df in (good, single, apart, clean):
        df.unpersist()


def test_the_rest_imports_without_the_subpackage(tmp_path):
    """A copy of the library without this folder and the pipeline still registers its other queries."""
    code = (
        "import importlib.util as u, sys; find = u.find_spec\n"
        "u.find_spec = lambda name, *a: None if name in ('lookout.llm', 'corpus_pipeline') else find(name, *a)\n"
        "import __spark_entry__ as e; names = e.queries(); assert len(names) > 100 and not any(n.startswith('op1_') or n == 'pipeline' for n in names)\n"
        "assert 'lookout.llm' not in sys.modules and set(e.oracle_sql()) <= set(names)"
    )
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
