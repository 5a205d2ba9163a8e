"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of 13 consecutive words (a shorter item is one window). Patterns of one length
share a *shift table* over blocks of two words: it says how far the search may jump when the block before the
cursor cannot end a pattern yet. Where the shift is 0, a hash of the window selects a bucket of patterns, and comparing
the words one by one confirms the occurrence. Many cursors advance together, one per stretch of a text, so a step of
the search is one array operation over all of them.

The benchmark is worked through in blocks of at most ``block_words`` words, so what is sent to the tasks is
bounded; a larger benchmark takes more passes, with the same rows.

Defined cases: null texts and texts without words have no hits; items without words have no window; equal windows of
several items count for each of them. Repeated rows are judged alike. Empty tables give empty results, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm import tokens as tk
from lookout.llm.common import fields, in_arrow, input_columns, settled

WINDOW = 13
STRETCH = 256  #: words per cursor
BLOCK_WORDS = 2_000_000
OUT = "n_words long, hits array<struct<begin: long, end: long>>, items array<string>"


class Patterns(NamedTuple):
    """Patterns of one length: the shift table, and the windows sorted by their hash."""

    size: int
    shift: np.ndarray
    hashes: np.ndarray
    words: np.ndarray  # one row per pattern
    item_first: np.ndarray  # items of pattern i: item_ids[item_first[i]:item_first[i + 1]]
    item_ids: np.ndarray


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tk.mix(a * np.uint64(tk.BASE) + b)


def patterns(size: int, rows: np.ndarray, items: np.ndarray) -> Patterns:
    """``rows`` has one window per row (repeats allowed), ``items`` the item of each."""
    order = np.lexsort((items, tk.row_hashes(rows)))
    rows, items = rows[order], items[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    words = rows[new]
    which = np.cumsum(new) - 1
    distinct = np.ones(len(rows), bool)
    distinct[1:] = new[1:] | (items[1:] != items[:-1])
    block = min(2, size)
    bits = max(12, int(np.ceil(np.log2(len(words) * size + 1))) + 3)
    shift = np.full(1 << bits, size - block + 1, np.uint8 if size < 200 else np.int64)
    for end in range(block - 1, size):
        keys = block_hash(words[:, end - 1] if block == 2 else None, words[:, end])
        np.minimum.at(shift, keys & np.uint64((1 << bits) - 1), size - 1 - end)
    first = np.searchsorted(which[distinct], np.arange(len(words) + 1))
    return Patterns(size, shift, tk.row_hashes(words), words, first, items[distinct])


def block_hash(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    return tk.mix(b) if a is None else pair(a, b)


def search(found: Patterns, words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """All (position of the last word, pattern) of occurrences inside single texts."""
    size, mask = found.size, np.uint64(len(found.shift) - 1)
    w, first = words.hashes, words.first
    lengths = np.diff(first)
    fits = lengths >= size
    if not fits.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # one cursor for each stretch of possible end positions of a text
    lo, hi = first[:-1][fits] + size - 1, first[1:][fits]
    count = -(-(hi - lo) // STRETCH)
    part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(lo, count) + part * STRETCH
    stop = np.minimum(at + STRETCH, np.repeat(hi, count))
    ends, ids = [], []
    while len(at):
        key = block_hash(w[at - 1], w[at]) if size > 1 else block_hash(None, w[at])
        shift = found.shift[key & mask].astype(np.int64)
        stops = at[shift == 0]
        if len(stops):
            for p, i in confirmed(found, w, stops):
                ends.append(p)
                ids.append(i)
        at = at + np.maximum(shift, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ends), np.concatenate(ids)


def confirmed(found: Patterns, w: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ends where a pattern occurs: buckets by window hash, then word by word."""
    rows = w[ends[:, None] + np.arange(1 - found.size, 1)]
    hashes = tk.row_hashes(rows)
    at = np.searchsorted(found.hashes, hashes)
    open_ = np.arange(len(ends))
    while len(open_):
        inside = at[open_] < len(found.hashes)
        open_ = open_[inside]
        open_ = open_[found.hashes[at[open_]] == hashes[open_]]
        same = (found.words[at[open_]] == rows[open_]).all(axis=1)
        if same.any():
            yield ends[open_[same]], at[open_[same]]
        at[open_] += 1


def tables_of(items: list[tuple[str, str]], window: int) -> tuple[list[Patterns], list[str]]:
    """The pattern tables of benchmark items (id, text)."""
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    block = tk.texts(pa.array([text for _, text in items], pa.string()))
    words = tk.words(block, tk.ALNUM)
    lengths = np.diff(words.first)
    ids = np.array([number[name] for name, _ in items], np.int64)
    out = []
    for size in sorted({min(window, int(n)) for n in lengths if n}):
        at = [np.arange(a, b - size + 1) for a, b, n in zip(words.first[:-1], words.first[1:], lengths, strict=True) if (n == size if size < window else n >= window)]
        of = [i for i, n in zip(ids, lengths, strict=True) if (n == size if size < window else n >= window)]
        starts = np.concatenate(at)
        owner = np.repeat(of, [len(a) for a in at])
        out.append(patterns(size, words.hashes[starts[:, None] + np.arange(size)], owner))
    return out, names


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones in order."""
    order = np.lexsort((end, begin))
    begin, end = begin[order], end[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)]


def scan(block: tk.Texts, tables: list[Patterns], names: list[str]) -> list[tuple[int, list, list]]:
    """For each text: number of words, hit intervals of words, names of the items found."""
    words = tk.words(block, tk.ALNUM)
    counts = np.diff(words.first)
    out = [(int(n), [], []) for n in counts]
    parts = [(found, *search(found, words)) for found in tables]
    parts = [(found, ends, ids) for found, ends, ids in parts if len(ends)]
    if not parts:
        return out
    begin = np.concatenate([ends - found.size + 1 for found, ends, _ in parts])
    end = np.concatenate([ends + 1 for _, ends, _ in parts])
    owner = np.searchsorted(words.first, begin, "right") - 1
    per = np.concatenate([np.diff(found.item_first)[ids] for found, _, ids in parts])
    item = np.concatenate([found.item_ids[np.concatenate([np.arange(found.item_first[i], found.item_first[i + 1]) for i in ids])] for found, _, ids in parts])
    found_pairs = np.unique(np.stack([np.repeat(owner, per), item]), axis=1)
    for t in np.unique(owner):
        mine = owner == t
        b, e = merged(begin[mine] - words.first[t], end[mine] - words.first[t])
        out[t][1].extend(zip(b.tolist(), e.tolist(), strict=True))
    for t, i in zip(*found_pairs.tolist(), strict=True):
        out[t][2].append(names[i])
    return out


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The items in blocks of about ``block_words`` words, and whether a block is the last; one block at a time is on the driver."""
    rows = input_columns(benchmark, item_id=item_id, text=text).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // (block_words * 4)))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else rows
        yield [(r["item_id"], r["text"]) for r in part.collect()], b == n - 1


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, hits (word intervals) and the sorted ids of the items found."""
    rows = searched(input_columns(docs, doc_id=doc_id, text=text), "doc_id long", benchmark, item_id, item_text, window, block_words)
    return rows.select("doc_id", "n_words", words_hit().alias("n_hit"), "hits", F.array_sort("items").alias("items"))


def words_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["begin"])


def searched(rows: DataFrame, kept: str, benchmark: DataFrame, item_id: str, item_text: str, window: int, block_words: int) -> DataFrame:
    """The rows, of which the columns ``kept`` stay, with n_words, hits and items of their text."""
    names = [c for c in rows.columns if c != "text"]
    rows = rows.select(*names, "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<begin: long, end: long>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    spark = rows.sparkSession
    for items, last in benchmark_blocks(benchmark, item_id, item_text, block_words):
        out = f"{kept}, {OUT}" if last or "text string" in kept else f"{kept}, text string, {OUT}"
        rows = in_arrow(rows, searcher(spark.sparkContext.broadcast(tables_of(items, window)), fields(out)), out)
        if not last:
            rows = settled(rows)  # a worker holds the tables of one block at a time
    return rows


def searcher(sent, columns: pa.Schema):
    """A stage that adds what one block of the benchmark finds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = sent.value
        for whole in batches:
            for batch, block in tk.blocks(whole, "text"):
                found = scan(block, tables, names)
                earlier = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
                hits, items = [], []
                for (_, new, ids), (old, known) in zip(found, earlier, strict=True):
                    spans = [(h["begin"], h["end"]) for h in old]
                    if old and new:
                        b, e = merged(*np.array(spans + new, np.int64).T)
                        spans = list(zip(b.tolist(), e.tolist(), strict=True))
                    else:
                        spans += new
                    hits.append([{"begin": a, "end": z} for a, z in spans])
                    items.append(known + ids)
                made = {"n_words": [n for n, _, _ in found], "hits": hits, "items": items}
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in columns], schema=columns)

    return work


def is_contaminated(n_hit, n_words):
    """At least one word in twenty lies in an occurrence of a benchmark window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: each row by its own text, in the scan, whatever ids repeat or are missing."""
    own = {c: "text" if c == text else f"c{k}" for k, c in enumerate(docs.columns)}
    kept = ", ".join(f"{own[f.name]} {'string' if f.name == text else f.dataType.simpleString()}" for f in docs.schema)
    found = searched(input_columns(docs, **{new: c for c, new in own.items()}), kept, benchmark, "item_id", "text", WINDOW, BLOCK_WORDS)
    clean = found.where(~is_contaminated(words_hit(), F.col("n_words")))
    return clean.select(*(F.col(new).alias(c) for c, new in own.items()))
