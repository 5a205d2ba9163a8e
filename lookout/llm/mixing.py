"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Each document draws an exponential key -ln(u) / w, u from a hash of its id and w its quality weight; documents are
taken in the order of their keys. A source's target in words is met by whole epochs first; what is left is met by
the documents first in that order, their sizes summed up to the remaining budget, the last one in part.

A source of any size is spread over many tasks: above ``slice_rows`` rows its documents are range-partitioned by
(key, doc_id, size) at sampled places, whatever the weights make of the keys; sums per slice give each slice its start, and
rows are ordered within a slice only (``OrderedScan``). There are at most about twice ``MOST_SLICES`` slices.

Defined cases: a null text has size 0; null is a source of its own, last in order; a source of size 0 has target 0;
ties in the key are broken by doc_id (null first) and size. Rows that repeat a doc_id draw the same key, and each
counts as a document; rows without a doc_id draw by their text. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import input_columns, settled
from lookout.operators.scan import OrderedScan

WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS, MOST_SLICES = 5_000, 10_000
MOST_COPIES = 3
SENT_SOURCES = 50_000  #: a longer list of sources is joined by shuffle, with the same rows


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def clean_share(text: Column) -> Column:
    """A quality weight from 0.01 to 1: the share of characters that are no ASCII marks or digits."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[!-@\[-`{-~]+", ""))
    return F.greatest(F.lit(0.01), 1.0 - marks / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id, or of the text where there is no id."""
    named = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def shared_out(sizes: list[int], weights: list[float], total: float, copies: float) -> list[float]:
    """``total`` shared by weight; a share stops at ``copies`` times its size, its excess goes to the others by weight."""
    targets, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        weight = sum(weights[i] for i in sorted(free))
        above = [i for i in sorted(free) if left * weights[i] / weight > copies * sizes[i]]
        if not above:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in above:
            targets[i] = float(copies * sizes[i])
            free.discard(i)
        left = total - math.fsum(targets)
    return targets


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, copies: int = MOST_COPIES) -> list[tuple]:
    """(source, rows, size, target) per source: the mixture's own short list, one entry per named source."""
    rows = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in rows]
    wanted = [float(weights[i % len(weights)]) for i in range(len(rows))]
    targets = shared_out(sizes, wanted, share * sum(sizes), copies)
    return [(r["source"], int(r["n"]), s, t) for r, s, t in zip(rows, sizes, targets, strict=True)]


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    copies: int = MOST_COPIES,
    quality: Column | None = None,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and the key.

    ``quality`` is an expression over ``text`` (and doc_id, source); by default the share of plain characters.
    """
    spark = docs.sparkSession
    rows = input_columns(docs, doc_id=doc_id, text=text, source=source)
    weight = F.greatest(quality if quality is not None else clean_share(F.col("text")), F.lit(1e-6))
    sized = settled(rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), (-F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / weight).alias("key")))
    plan = source_targets(sized, weights, share, copies)
    spec = [(i, s, size, t) for i, (s, _, size, t) in enumerate(plan)]
    targets = spark.createDataFrame(spec, "source_no int, named string, source_size long, target double")
    if len(spec) <= SENT_SOURCES:
        targets = F.broadcast(targets)
    placed = sized.join(targets, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rows_per_task = max(slice_rows, -(-sum(n for _, n, _, _ in plan) // MOST_SLICES))
    ordered = OrderedScan(placed, ["source_no"], ["key", "doc_id", "size"], rows_per_task).running({"first": F.col("size")}, inclusive=False).done()
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    return (
        ordered.withColumn("epochs", epochs.cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("first"))))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "key")
    )
