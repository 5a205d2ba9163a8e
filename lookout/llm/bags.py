"""Ranked lexical search with bag deduplication: equal documents, as far as the items can tell, are scored once.

What a score can see of a document is its *bag*: the occurrences of the items' terms in it, and its length norm m.
One scan over the texts restricts every document to the vocabulary of the items. Documents are then dealt by a hash of (m, bag),
and grouping by m and bag themselves verifies that the members of a class are identical. Each class is scored once, in whole
numbers; a task keeps the ``k`` best classes per item it has seen. The best ``k`` classes by (score, smallest doc_id) hold the best ``k`` documents,
since every class before them holds a document that ranks higher; only their members are looked up, by ascending
doc_id, and ranked.

The items are worked through in blocks of about ``block_words`` words, so what is sent to the tasks and the counts
collected (one per term of the block) are bounded; more items take more passes over the documents, with the same rows. Scores are sums of
products below 2 ** 53 per slice of terms, so the double matrix product is exact, and slices are added as 64-bit integers.

Defined cases: null texts and texts without terms count nowhere and are never found. Items without terms, or without a
document that scores above 0, return no rows. Repeated document rows are documents of their own and take ranks of their
own; a null doc_id ranks after all others of its score. Item rows that repeat an id and a text are one item; an id with several
texts is several items of that id, each with ranks from 1. Empty tables give an empty result. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookout.llm import tokens as tk
from lookout.llm.common import fields, in_arrow, input_columns, settled

K = 10
BLOCK_WORDS = 2_000_000  #: words of items per pass over the documents
CLASS_ROWS, ITEM_ROWS, TERM_ROWS = 512, 256, 4096  #: sizes of the matrices multiplied at a time
BAGS = "doc_id long, n long, bag binary"
BEST = "item int, class long, score long, least long"


class Vocabulary(NamedTuple):
    """Distinct terms sorted by hash: their hashes, and their bytes one after another."""

    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray


class Items(NamedTuple):
    """The items of a block: item i holds the terms ``terms[first[i]:first[i + 1]]``."""

    first: np.ndarray
    terms: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def vocabulary(texts: list[str]) -> tuple[Vocabulary, Items]:
    """The distinct terms of the texts, and each text's terms once each as indices of the vocabulary."""
    block = tk.texts(pa.array(texts, pa.string()))
    words = tk.words(block, tk.ALNUM)
    data = lowered(block.data)
    spelled = [data[a:b].tobytes() for a, b in zip(words.begin.tolist(), words.end.tolist(), strict=True)]
    known = dict(zip(spelled, words.hashes.tolist(), strict=True))
    order = sorted(known, key=lambda word: (known[word], word))
    index = {word: i for i, word in enumerate(order)}
    per = [sorted({index[word] for word in spelled[a:b]}) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    found = Vocabulary(
        np.array([known[word] for word in order], np.uint64),
        np.cumsum([0] + [len(word) for word in order], dtype=np.int64),
        np.frombuffer(b"".join(order), np.uint8),
    )
    return found, Items(np.cumsum([0] + [len(p) for p in per], dtype=np.int64), np.array([t for p in per for t in p], np.int64))


def same_bytes(a: np.ndarray, a_from: np.ndarray, b: np.ndarray, b_from: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each pair of spans of one length, whether all their bytes are equal."""
    ends = np.cumsum(length)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    differs = a[np.repeat(a_from, length) + inner] != b[np.repeat(b_from, length) + inner]
    return np.bincount(np.repeat(np.arange(len(length)), length)[differs], minlength=len(length)) == 0


def lookup(known: Vocabulary, data: np.ndarray, words: tk.Words) -> np.ndarray:
    """For each word the index of its term, or -1: found by hash, confirmed on the bytes."""
    out = np.full(len(words.hashes), -1, np.int64)
    at = np.searchsorted(known.hashes, words.hashes)
    open_ = np.flatnonzero(at < len(known.hashes))
    while len(open_):
        open_ = open_[known.hashes[at[open_]] == words.hashes[open_]]
        term = at[open_]
        length = known.first[term + 1] - known.first[term]
        fits = np.flatnonzero(length == words.end[open_] - words.begin[open_])
        same = fits[same_bytes(data, words.begin[open_[fits]], known.data, known.first[term[fits]], length[fits])]
        out[open_[same]] = term[same]
        open_ = open_[out[open_] < 0]
        at[open_] += 1
        open_ = open_[at[open_] < len(known.hashes)]
    return out


def bagger(sent):
    """A stage from texts to bags: pairs of term and occurrences as 32-bit numbers, by ascending term."""
    columns = fields(BAGS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for batch, block in tk.blocks(whole, "text"):
                words = tk.words(block, tk.ALNUM)
                n = np.diff(words.first)
                terms = lookup(known, lowered(block.data), words)
                hit = terms >= 0
                size = max(1, len(known.hashes))
                keys, tf = np.unique(tk.owners(words.first)[hit] * size + terms[hit], return_counts=True)
                pairs = np.stack([keys % size, tf], axis=1).astype("<i4")
                ends = np.searchsorted(keys, np.arange(1, len(n) + 1) * size) * 8
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                bag = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(pairs.tobytes())])
                made = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), bag], schema=columns)
                yield made.filter(pa.array(n > 0))

    return work


def pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (term, occurrences) rows of a column of bags, and the bag of each."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    pairs = np.frombuffer(data, "<i4", count=int(offsets[-1]) // 4).reshape(-1, 2) if data is not None else np.zeros((0, 2), "<i4")
    return pairs[offsets[0] // 8 :], np.repeat(np.arange(len(column)), np.diff(offsets) // 8)


def counter(size: int):
    """A stage from classes to the number of documents that hold each term, per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            pairs, owner = pairs_of(batch.column("bag"))
            np.add.at(total, pairs[:, 0], batch.column("members").to_numpy()[owner])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["term", "df"])

    return work


def scores(m: np.ndarray, pairs: np.ndarray, owner: np.ndarray, items: Items, weights: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The scores of classes (rows) for items lo to hi - 1, as whole numbers."""
    a, b = items.first[lo], items.first[hi]
    terms, column = np.unique(items.terms[a:b], return_inverse=True)
    item = np.repeat(np.arange(hi - lo), np.diff(items.first[lo : hi + 1]))
    place = np.searchsorted(terms, pairs[:, 0])
    mine = np.flatnonzero((place < len(terms)) & (terms[np.minimum(place, len(terms) - 1)] == pairs[:, 0])) if len(terms) else np.zeros(0, np.int64)
    place, owner, tf = place[mine], owner[mine], pairs[mine, 1].astype(np.int64)
    gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
    out = np.zeros((len(m), hi - lo), np.int64)
    for start in range(0, len(terms), TERM_ROWS):
        width = min(TERM_ROWS, len(terms) - start)
        left, right = np.zeros((len(m), width)), np.zeros((width, hi - lo))
        inside = (place >= start) & (place < start + width)
        left[owner[inside], place[inside] - start] = gain[inside]
        inside = (column >= start) & (column < start + width)
        right[column[inside] - start, item[inside]] = weights[terms[column[inside]]]
        out += (left @ right).astype(np.int64)
    return out


def best(rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows (item, score, no id, least id, class) the first ``k`` per item by falling score, then smallest id."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    start = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - start < k]


def scorer(sent, k: int):
    """A stage from classes to the ``k`` best of each task for each item."""
    columns = fields(BEST)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        n_items = len(items.first) - 1
        found = np.zeros((0, 5), np.int64)
        cut = np.ones(n_items, np.int64)
        for whole in batches:
            for at in range(0, len(whole), CLASS_ROWS):
                batch = whole.slice(at, CLASS_ROWS)
                m, ids = batch.column("m").to_numpy(), batch.column("class").to_numpy()
                least = batch.column("least")
                no_id, least = np.asarray(least.is_null()), least.fill_null(0).to_numpy()
                pairs, owner = pairs_of(batch.column("bag"))
                new = []
                for lo in range(0, n_items, ITEM_ROWS):
                    hi = min(lo + ITEM_ROWS, n_items)
                    made = scores(m, pairs, owner, items, weights, lo, hi)
                    row, item = np.nonzero(made >= cut[lo:hi])
                    new.append(np.stack([item + lo, made[row, item], no_id[row], least[row], ids[row]], axis=1))
                found = best(np.concatenate([found, *new]), k)
                full = np.flatnonzero(np.bincount(found[:, 0], minlength=n_items) == k)
                cut[full] = found[np.searchsorted(found[:, 0], full, "right") - 1, 1]
        item, score, no_id, least, ids = found.T
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids), pa.array(score), pa.array(least, mask=no_id == 1)], schema=columns)

    return work


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list]:
    """The distinct items in blocks of about ``block_words`` words; one block at a time is on the driver."""
    rows = items.where("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // (block_words * 4)))
    for b in range(n):
        yield (rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows).collect()


def ranked(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = K,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score."""
    rows = input_columns(docs, doc_id=doc_id, text=text)
    out = None
    for block in item_blocks(input_columns(items, item_id=item_id, text=item_text), block_words):
        found = settled(block_ranked(rows, block, items.schema[item_id].dataType.simpleString(), k))
        out = found if out is None else out.unionByName(found)
    return out


def block_ranked(rows: DataFrame, block: list, id_type: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    known, items = vocabulary([r["text"] for r in block])
    send = spark.sparkContext.broadcast
    bags = settled(in_arrow(rows, bagger(send(known)), BAGS))
    n_docs, n_terms = bags.agg(F.count(F.lit(1)), F.sum("n")).first()
    m = F.expr(f"cast(10 + (cast(90 * cast(n as decimal(18, 0)) as decimal(20, 0)) * {n_docs}BD) div {n_terms or 1}BD as long)")
    bags = bags.where(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn("hash", F.xxhash64("m", "bag"))
    key = ["hash", "m", "bag"]
    classes = bags.groupBy(*key).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members"))
    classes = settled(classes.withColumn("class", F.monotonically_increasing_id()))
    counts = in_arrow(classes.select("bag", "members"), counter(len(known.hashes)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(known.hashes))
    for r in counts.collect():  # one row per term of the block
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    order = [F.desc("score"), F.asc_nulls_last("least"), F.asc("class")]
    top = in_arrow(classes.select("class", "m", "bag", "least"), scorer(send((items, weights)), k), BEST)
    top = settled(top.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("r") <= k).select("item", "class", "score"))
    wanted = classes.join(top.select("class").distinct(), "class", "left_semi").select("class", *key)
    members = bags.join(wanted, key).select("class", "doc_id")
    first = Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best_docs = top.join(members, "class").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {id_type}")
    return best_docs.join(names, "item").select("item_id", "rank", "doc_id", "score")
