"""Substring dedup over words with a compressed FM-index per shard.

Shards hold the places where a passage of 50 words may repeat (see ``spans``), dealt out by the hash of the
passage's anchor, so equal passages always meet in one shard and no text is compared with other shards. A shard
indexes its pieces: suffix order, Burrows-Wheeler transform, a wavelet matrix of packed bits with rank counts, and for
each group of suffixes with 50 equal words the smallest doc_id. Then the pieces stream through the index from the
right: backward search keeps the interval of the last 49 words, one step to the left gives the interval of a passage
(its matching statistic is cut off at the threshold), and dropping the last word widens the interval again. All
pieces of the shard take a step together. A passage is reported if its interval holds a smaller doc_id.

Defined cases: null texts have no words; a null doc_id counts as larger than all others, and as equal to other null ones; a
passage repeated inside one document only is not removed. Rows that share a doc_id are told apart by their texts; none of
them is the smaller one, so they lose nothing on account of each other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm import spans as sp
from lookout.llm import tokens as tk
from lookout.llm.common import fields, in_arrow, settled

LENGTH, RUN = 50, 12
SHARD_SYMBOLS = 1_000_000


class Bits:
    """Packed bits with a count at every 64th."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class Index:
    """FM-index of pieces: symbols as dense numbers, each piece followed by an end mark of its own group 0."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, docs: np.ndarray, length: int):
        """``symbols`` of all pieces, ``first`` their starts, ``docs`` one smallest doc_id per piece."""
        self.alphabet, codes = np.unique(symbols, return_inverse=True)
        sizes = np.diff(first)
        n = len(codes) + len(sizes)
        text = np.zeros(n, np.int64)
        own = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
        text[own] = codes + 1
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        order = suffix_order(text, length)
        self.text, self.starts = text, first[:-1] + np.arange(len(sizes))
        self.sizes = sizes
        self.levels: list[tuple[Bits, int]] = []
        seen = text[order - 1]  # the transform: the symbol before each suffix
        self.counts = np.searchsorted(np.sort(text), np.arange(len(self.alphabet) + 2))
        for level in reversed(range(max(1, int(len(self.alphabet)).bit_length()))):
            bit = (seen >> level & 1).astype(bool)
            self.levels.append((Bits(bit), int((~bit).sum())))
            seen = np.concatenate([seen[~bit], seen[bit]])
        alike = same_prefix(text, order, length - 1)
        self.shorter = np.cumsum(~alike) - 1  # group of suffixes with length - 1 equal symbols
        self.short_start = np.append(np.flatnonzero(~alike), n)
        full = same_prefix(text, order, length)
        self.longer = np.cumsum(~full) - 1
        self.least = np.minimum.reduceat(docs[owner][order], np.flatnonzero(~full))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + pattern."""
        base = np.zeros_like(low)
        last = len(self.levels) - 1
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (last - k) & 1).astype(bool)
            a, b, c = bits.rank(base), bits.rank(low), bits.rank(high)
            base, low, high = np.where(one, zeros + a, base - a), np.where(one, zeros + b, low - b), np.where(one, zeros + c, high - c)
        return self.counts[symbol] + low - base, self.counts[symbol] + high - base

    def smallest(self, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Streams the pieces through the index: (place from the piece's end, pieces, smallest doc_id of the passage)."""
        pieces = np.arange(len(self.sizes))
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(self.text))
        for back in range(1, int(self.sizes.max(initial=0)) + 1):
            going = self.sizes[pieces] >= back
            pieces, low, high = pieces[going], low[going], high[going]
            low, high = self.step(self.text[self.starts[pieces] + self.sizes[pieces] - back], low, high)
            if back >= length:
                yield back, pieces, self.least[self.longer[low]]
                group = self.shorter[low]
                low, high = self.short_start[group], self.short_start[group + 1]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their first ``depth`` symbols or more (prefix doubling)."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    known = 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - known] = rank[known:] + 1
        both = rank * (n + 2) + ahead
        order = np.argsort(both, kind="stable")
        sorted_ = both[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
        rank, known = new, known * 2
        if rank.max(initial=0) == n - 1:
            break
    return order


def same_prefix(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, whether it shares ``depth`` symbols, no end mark among them, with the one before."""
    out = np.zeros(len(order), bool)
    open_ = np.arange(1, len(order))
    for j in range(depth):
        a, b = order[open_ - 1] + j, order[open_] + j
        fits = (a < len(text)) & (b < len(text))
        open_, a, b = open_[fits], a[fits], b[fits]
        open_ = open_[(text[a] == text[b]) & (text[a] > 0)]
    out[open_] = True
    return out


def matcher(length: int, columns: pa.Schema):
    """One shard: its variants in, the passages that occur under a smaller doc_id out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = pa.Table.from_batches(held)
        raw = shard.column("symbols").to_pylist()
        sizes = np.array([len(r) // 8 for r in raw])
        symbols = np.frombuffer(b"".join(raw), np.uint64)
        docs = shard.column("doc").to_numpy()
        index = Index(symbols, np.cumsum([0, *sizes]), docs, length)
        hits: dict[int, list[int]] = {}
        for back, pieces, least in index.smallest(length):
            for piece in pieces[least < docs[pieces]].tolist():
                hits.setdefault(piece, []).append(int(sizes[piece]) - back)
        keys, digests = shard.column("key").to_numpy(), shard.column("digest").to_numpy()
        rows = [{"key": int(keys[p]), "digest": int(digests[p]), "spans": [{"a": i, "b": i + 1} for i in sorted(places)]} for p, places in hits.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=columns)

    return work


def word_cutter(text: tk.Texts):
    hashes = tk.words(text, tk.PLAIN).hashes
    return lambda a, b: hashes[a:b].tobytes()


def earlier_passages(docs: DataFrame, length: int = LENGTH, run: int = RUN, shard_symbols: int = SHARD_SYMBOLS, hot: int = sp.HOT_VARIANTS) -> DataFrame:
    """(doc, spans) of the words covered by passages that also start in a document with a smaller doc_id."""
    found = sp.repeats(docs, sp.word_symbols, length, run)
    found = found._replace(variants=settled(found.variants))
    held = settled(sp.contents(docs, found.variants, word_cutter, length))
    usual = held.where(F.col("variants") <= hot)
    n = usual.agg(F.sum(F.length("symbols"))).first()[0] or 0
    shards = max(1, -(-int(n) // (8 * shard_symbols)))
    matches = in_arrow(usual.repartition(shards, "key"), matcher(length, fields(sp.MATCHES)), sp.MATCHES)
    dealt = settled(sp.dealt_passages(held.where(F.col("variants") > hot), 8, length))
    least = dealt.groupBy("key", "passage").agg(F.min("doc").alias("least"))
    spread = dealt.join(least, ["key", "passage"]).where("least < doc")
    return sp.covered(found, matches.unionByName(sp.spans_of(spread)), F.col("doc") > F.col("first_doc"), length)


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words joined by spaces (or, with ``digest``, their
    SHA-256 in ``kept``)."""
    rows = sp.source_rows(docs, doc_id, text)
    columns = fields(KEPT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, block in tk.blocks(whole, "text"):
                counts, removed, kept = [], [], []
                raw = block.data.tobytes()
                for i, found in enumerate(batch.column("spans").to_pylist()):
                    words = raw[block.offsets[i] : block.offsets[i + 1]].split()
                    mask = sp.mask_of(found, len(words))
                    left = b" ".join(words if mask is None else compress(words, (~mask).tolist()))
                    counts.append(len(words))
                    removed.append(0 if mask is None else int(mask.sum()))
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, columns.field("kept").type)], schema=columns)

    return in_arrow(sp.with_spans(rows, earlier_passages(rows, length, **options)), work, KEPT)
