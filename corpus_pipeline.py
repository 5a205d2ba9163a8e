"""From raw documents to a training mixture: five stages, each written as Parquet and read again by the next.

The stages keep clean documents whole. They drop documents of low predicted quality, all but one of equal texts, all but
one of each group of near copies, and documents of which a twentieth of the words lie in benchmark windows; the last
stage says how many words of each remaining document the mixture takes.

Defined cases: rows are told apart by id and text, so a text never goes because of another one that has its id, or has none
as it does; of repeated rows one stays after exact dedup. A null or empty text is scored as an empty one, equals all texts without
characters, has no shingles and no benchmark words, and takes part in the mixture with size 0. Columns other than those of
``documents`` are left behind by the first stage; an empty table stays empty through all stages. The mixture weighs documents by their
share of plain characters: stages hand on the columns of ``documents`` only, so the first stage's score does not reach it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.llm import exact, lshforest, mixing, quality, wumanber
from lookout.session import settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted quality of 1."""
    return quality.accepted(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.without_copies(docs.select(COLUMNS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity of 0.8 or more."""
    return lshforest.one_per_component(docs.select(COLUMNS), percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return wumanber.without_benchmark(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes of each document."""
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"), "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", of_quality),
    ("exact dedup", without_copies),
    ("minhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixture),
]

#: A trained classifier has no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
