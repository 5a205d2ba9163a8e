"""Repeated passages: which stretches of which texts can hold a passage that occurs twice, found without moving texts.

A passage is ``length`` consecutive symbols (words or bytes). Inside it, the run of ``run`` symbols with the smallest
hash is its *anchor* (the first of them on a tie). Equal passages have the same anchor at the same place, so
passages need to be compared only where they share the anchor's hash, the *key*. Passages of a text with one anchor
start next to each other; together they cover a *piece* of fewer than ``2 * length`` symbols. Every passage lies
in exactly one piece, and a text of n symbols has about ``2 * n / (length - run)`` of them.

``Repeats`` narrows the pieces down in steps that move only numbers: keys that occur once are dropped, equal pieces
(same key and digest) are combined into one *variant* with its first place and count, and only keys with several
variants need the symbols themselves, one copy per variant. A key with more than ``hot`` variants (a passage
shared by a large part of all texts, with other surroundings each time) is not brought together at all: its passages
are dealt out by their own hash and counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm import tokens as tk
from lookout.llm.common import fields, in_arrow, input_columns, row_key, settled

HOT_VARIANTS = 20_000
PIECE_ROWS = 2_048  #: pieces of a text that are cut out at a time
PLACE_BITS = 24  #: of a hash give way to the place when anchors are chosen; more in a text above 16 million symbols


class Symbols(NamedTuple):
    """Symbols of consecutive texts as 64-bit codes, and the first symbol of each text."""

    codes: np.ndarray
    first: np.ndarray


def word_symbols(block: tk.Texts) -> Symbols:
    words = tk.words(block, tk.PLAIN)
    return Symbols(words.hashes, words.first)


def byte_symbols(block: tk.Texts) -> Symbols:
    return Symbols(tk.PLAIN.codes[block.data], block.offsets)


class Hashes:
    """Hashes of any stretch of symbols from one running sum."""

    def __init__(self, codes: np.ndarray):
        up, self.down = tk.powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return tk.mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        n = len(self.sums) - 1 - size + 1
        return tk.mix((self.sums[size:] - self.sums[: max(n, 0)]) * self.down[: max(n, 0)]) if n > 0 else np.zeros(0, np.uint64)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


class Pieces(NamedTuple):
    """Passages start at ``start`` <= p < ``stop``, places in the block, and share the anchor at ``anchor``."""

    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    digest: np.ndarray


def pieces(symbols: Symbols, length: int, run: int) -> Pieces:
    codes, first = symbols
    hashes = Hashes(codes)
    runs = hashes.runs(run)
    width = length - run + 1
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(owner):
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    counts = np.maximum(sizes - length + 1, 0)
    at = np.arange(len(owner)) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    bits = np.uint64(max(PLACE_BITS, int(len(runs) - 1).bit_length()))
    places = (runs >> bits << bits) | np.arange(len(runs), dtype=np.uint64)  # the hash decides, then the first place
    anchor = (sliding_minimum(places, width)[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    start = at[new]
    stop = at[np.append(new[1:], len(at)) - 1] + 1
    anchor = anchor[new]
    # the anchor's place counts: only pieces that lie alike around it are the same variant
    digest = tk.mix(hashes.of(start, stop - 1 + length) + (anchor - start).astype(np.uint64))
    return Pieces(owner[new], start, stop, anchor, runs[anchor], digest)


PIECES = "key long, digest long, doc long, row long, start long, stop long"
Reader = Callable[[tk.Texts], Symbols]


def piece_rows(docs: DataFrame, read: Reader, length: int, run: int, only_keys: bool) -> DataFrame:
    """One row per piece; start and stop are places in the text. With ``only_keys``, just the keys."""
    out = "key long" if only_keys else PIECES
    columns = fields(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            docs, rows = whole.column("doc"), whole.column("row")
            at = 0
            for batch, block in tk.blocks(whole, "text"):
                symbols = read(block)
                found = pieces(symbols, length, run)
                arrays = [pa.array(found.key.view(np.int64))]
                if not only_keys:
                    base = symbols.first[found.owner]
                    owner = pa.array(found.owner + at)
                    arrays += [pa.array(found.digest.view(np.int64)), docs.take(owner), rows.take(owner), pa.array(found.start - base), pa.array(found.stop - base)]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays(arrays, schema=columns)

    return in_arrow(docs.select("doc", "row", "text"), work, out)


class Repeats(NamedTuple):
    """``places``: all pieces of keys that occur twice; ``variants``: the distinct ones with first doc, start, stop and
    number of copies, and the number of variants of their key."""

    places: DataFrame
    variants: DataFrame


def repeats(docs: DataFrame, read: Reader, length: int, run: int) -> Repeats:
    keys = piece_rows(docs, read, length, run, True).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    places = settled(piece_rows(docs, read, length, run, False).join(settled(keys), "key"))
    variants = settled(places.groupBy("key", "digest").agg(F.min(F.struct("doc", "row", "start", "stop")).alias("first"), F.count(F.lit(1)).alias("copies")))
    several = variants.groupBy("key").agg(F.count(F.lit(1)).alias("variants"))
    return Repeats(places, variants.join(settled(several.where("variants > 1")), "key", "left").select("key", "digest", "first.*", "copies", F.coalesce("variants", F.lit(1)).alias("variants")))


CONTENTS = "key long, digest long, doc long, copies long, variants long, passages int, lead binary, symbols binary"


def contents(docs: DataFrame, variants: DataFrame, cut: Callable[[tk.Texts], Callable[[int, int], bytes]], length: int, lead: Callable[[bytes], bytes] = lambda symbols: b"") -> DataFrame:
    """The symbols of one copy of each variant whose key has several, and what ``lead`` makes of them."""
    columns = fields(CONTENTS)
    mixed = variants.where("variants > 1")
    wanted = settled(mixed.groupBy("doc", "row").agg(F.collect_list(F.struct("key", "digest", "start", "stop", "copies", "variants")).alias("pieces")))
    ids = settled(wanted.select("doc", "row"))
    texts = docs.join(ids, ["doc", "row"], "left_semi").join(wanted, ["doc", "row"]).select("doc", "row", "text", "pieces")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # a repeated row gives its symbols once
        for whole in batches:
            for batch, block in tk.blocks(whole, "text"):
                same = zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), strict=True)
                pieces = batch.column("pieces")
                edges = np.asarray(pieces.offsets)
                held = {c: pieces.values.field(c) for c in ("key", "digest", "start", "stop", "copies", "variants")}
                for i, (doc, row) in enumerate(same):
                    if (doc, row) in done:
                        continue
                    done.add((doc, row))
                    a, b = block.offsets[i : i + 2]
                    get = cut(tk.Texts(block.data[a:b], np.array([0, b - a])))
                    for first in range(int(edges[i]), int(edges[i + 1]), PIECE_ROWS):  # a long text has many
                        part = {c: v.slice(first, min(PIECE_ROWS, int(edges[i + 1]) - first)) for c, v in held.items()}
                        start, stop = part["start"].to_numpy(), part["stop"].to_numpy()
                        symbols = [get(x, y - 1 + length) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
                        made = {**part, "doc": np.full(len(start), doc), "passages": stop - start, "lead": [lead(x) for x in symbols], "symbols": symbols}
                        yield pa.RecordBatch.from_arrays([made[f.name] if f.name in part else pa.array(made[f.name], f.type) for f in columns], schema=columns)

    return in_arrow(texts, work, CONTENTS)


PASSAGES = "key long, digest long, doc long, copies long, place int, passage long"


def dealt_passages(hot: DataFrame, width: int, length: int) -> DataFrame:
    """Every passage of the variants of hot keys with a hash of its symbols; ``width`` is the bytes of a symbol."""
    columns = fields(PASSAGES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["symbols"], np.uint64) if width == 8 else tk.PLAIN.codes[np.frombuffer(row["symbols"], np.uint8)]
                n = row["passages"]
                passage = Hashes(codes).runs(length)[:n].view(np.int64)
                same = [pa.array(np.full(n, row[c])) for c in ("key", "digest", "doc", "copies")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(passage)], schema=columns)

    return in_arrow(hot, work, PASSAGES)


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """The runs of true values as half-open intervals."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


MATCHES = "key long, digest long, spans array<struct<a: int, b: int>>"


def spans_of(passages: DataFrame) -> DataFrame:
    """(key, digest, place) of matched passages as MATCHES rows; a variant has fewer passages than ``length``."""
    return passages.groupBy("key", "digest").agg(F.transform(F.array_sort(F.collect_set("place")), lambda p: F.struct(p.alias("a"), (p + 1).cast("int").alias("b"))).alias("spans"))


def covered(found: Repeats, matches: DataFrame, whole, length: int) -> DataFrame:
    """(doc, row, spans): the symbol intervals of each text that repeated passages cover.

    ``whole`` says for which copies of a variant every passage counts; for the first copy, ``matches`` says which. What
    is known of a variant is put into one row first, so the places meet it in a single join, which adaptive execution
    splits where a variant has very many copies.
    """
    variants = found.variants.select("key", "digest", F.col("doc").alias("first_doc"), "copies")
    facts = settled(variants.join(settled(matches), ["key", "digest"], "left"))
    rows = found.places.join(facts, ["key", "digest"])
    all_of = F.array(F.struct(F.lit(0).alias("a"), (F.col("stop") - F.col("start")).cast("int").alias("b")))
    chosen = F.when(whole, all_of).otherwise(F.col("spans"))
    rows = rows.select("doc", "row", "start", F.explode(chosen).alias("s"))
    begin = (F.col("start") + F.col("s.a")).alias("a")
    end = (F.col("start") + F.col("s.b") - 1 + length).alias("b")
    return rows.select("doc", "row", F.struct(begin, end).alias("span")).groupBy("doc", "row").agg(F.collect_list("span").alias("spans"))


def mask_of(spans: list[dict] | None, n: int) -> np.ndarray | None:
    """Which of n symbols the spans cover; None if none."""
    if not spans:
        return None
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.minimum([s["a"] for s in spans], n), 1)
    np.add.at(edges, np.minimum([s["b"] for s in spans], n), -1)
    return np.cumsum(edges[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans) for every document; null spans where nothing is covered."""
    return docs.join(settled(spans), ["doc", "row"], "left").select("doc_id", "text", "spans")


def source_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows with their own key: places belong to rows, so texts under one id, or without one, are told apart."""
    return input_columns(docs, doc_id=doc_id, text=text).withColumns(row_key())
