"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Level 1 counts documents per normalised length, level 2 per length and prefix hash among the lengths that
occur twice; both come from one aggregated table of (length, prefix hash, count), which holds no text and no
row per copy. Level 3 hashes whole texts only where length and prefix hash occur twice.

Defined cases: a null text counts as empty; empty texts are equal to each other. Rows that repeat a doc_id and a
text share one decision in ``exact_groups``, and one of them stays in ``without_copies``. A null doc_id is an id of its own that stays before all others of
its length. Of equal texts the longest original stays, then the smallest doc_id. An empty table gives an empty
result. Columns other than the named two are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import input_columns, settled, without_rows
from lookout.operators.scan import many_to_one

WHITE = " \t\n\x0b\x0c\r"
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def hashed_rows(docs: DataFrame, doc_id: str, text: str, prefix: int, hash_all: bool) -> DataFrame:
    """doc_id, n_chars, whether length and prefix hash occur twice, and the hash of the whole text: of all rows in the scan with
    ``hash_all``, so that only hashes are moved, else of the rows that share both."""
    rows = input_columns(docs, doc_id=doc_id, text=text).select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        normalised(F.col("text")).alias("norm"),
    )
    rows = rows.select("*", F.length("norm").alias("n_norm"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head"))
    whole = F.sha2("norm", 256)
    if hash_all:
        rows = settled(rows.select("doc_id", "n_chars", "n_norm", "head", whole.alias("text_sha256")))
    counted = settled(rows.groupBy("n_norm", "head").agg(F.count(F.lit(1)).alias("n")))
    lengths = counted.groupBy("n_norm").agg(F.sum("n").alias("n")).where("n > 1").select("n_norm")
    keys = counted.join(lengths, "n_norm", "left_semi").where("n > 1").select("n_norm", "head", F.lit(True).alias("shared"))
    marked = rows.join(keys, ["n_norm", "head"], "left")
    shared = F.coalesce("shared", F.lit(False)).alias("shared")
    return settled(marked.select("doc_id", "n_chars", shared, "text_sha256" if hash_all else F.when(F.col("shared"), whole).alias("text_sha256")))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX, hash_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The hash of a text without a partner in length and prefix is null, since it is not computed; ``hash_all``
    fills it in for callers that return it. Hot groups: counting combines map-side, and both joins are of rows to
    one row per group, which adaptive execution splits where a key is large.
    """
    hashed = hashed_rows(docs, doc_id, text, prefix, hash_all)
    groups = settled(
        hashed.where("shared")
        .groupBy("text_sha256")
        .agg(
            F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("first"),
            F.count(F.lit(1)).alias("group_size"),
        )
        .where("group_size > 1")
        .select("text_sha256", F.col("first.doc_id").alias("keep_id"), "group_size")
    )
    joined = hashed.join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with all their columns.

    A copy is taken out by its id, length and text, so another text with the same or no id stays. Of rows that agree in all
    three one stays.
    """
    hashed = hashed_rows(docs, doc_id, text, prefix, False).where("shared")
    keys = hashed.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "n_chars", F.col("text_sha256").alias("sha"))
    counted = settled(keys.groupBy("sha", "n_chars", "doc").agg(F.count(F.lit(1)).alias("n")))
    first = counted.groupBy("sha").agg(F.min(F.struct((-F.col("n_chars")).alias("less"), "doc")).alias("first"))
    judged = settled(many_to_one(counted, first, ["sha"], "inner", spread_by=["doc", "n_chars"]))
    stays = (F.col("doc") == F.col("first.doc")) & (F.col("n_chars") == -F.col("first.less"))
    own = {
        "doc": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))),
        "n_chars": F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
        "sha": F.sha2(normalised(F.col(f"`{text}`")), 256),
    }
    return without_rows(docs, own, judged.where(~stays), judged.where(stays & (F.col("n") > 1)))
