"""Suffix-array dedup over bytes: repeated strings of 200 bytes, found by sorting suffixes in range-partitioned buckets.

The suffixes that can begin a repeated string lie in pieces around anchors (see ``spans``); pieces are placed by
the bytes at the anchor. Spark samples splitters of these leading bytes and range-partitions the pieces, so a bucket
holds all suffixes with the same leading bytes and strings never straddle a boundary. In a bucket all suffixes
are sorted by multikey quicksort in its array form: eight bytes are one character, a level sorts every open part by the
next character at once, and parts of one suffix are done. Parts still open after 200 bytes are the repeated strings.
Leading bytes shared by too many pieces are cut finer: their suffixes are dealt out by the whole string.

Defined cases: a null text is empty; matches never cross documents. Every row is a document of its own, whatever its doc_id:
rows that repeat a doc_id and a text are two places of the same bytes, so both lose them; texts that share a doc_id, or have none, are
told apart and each loses only what occurs elsewhere. Cut characters at the edge of a removed run are left as
bytes. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm import spans as sp
from lookout.llm import tokens as tk
from lookout.llm.common import fields, in_arrow, settled

LENGTH, RUN = 200, 40
BUCKET_BYTES = 4_000_000


def characters(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number in the order of the bytes; a view, nothing is copied."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


def repeated(data: np.ndarray, starts: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, whether its first ``length`` bytes occur at several places (``weights`` counts copies).

    Multikey quicksort: ``open_`` holds the suffixes of parts that are still tied, sorted by what has been read;
    each level splits parts by the next character (of eight bytes, the last level of the bytes that are left). Parts
    whose suffixes all go on alike are not sorted again.
    """
    out = weights > 1
    chars = characters(np.concatenate([data, np.zeros(8, np.uint8)]))
    open_, part, count = np.arange(len(starts)), np.zeros(len(starts), np.int64), 1
    read = 0
    while read < length and len(open_):
        key = chars[starts[open_] + read].astype(np.uint64)
        if length - read < 8:
            key >>= np.uint64(8 * (8 - length + read))
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        split = np.zeros(count, bool)
        split[part[key != key[first][part]]] = True
        mixed = np.flatnonzero(split[part])
        if len(mixed):
            order = mixed[np.lexsort((key[mixed], part[mixed]))]
            open_[mixed], key[mixed] = open_[order], key[order]
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
            part = np.cumsum(new) - 1
            tied = np.bincount(part)[part] > 1
            if not tied.all():
                open_, part = open_[tied], part[tied]
                part = np.cumsum(np.concatenate([[False], part[1:] != part[:-1]])) if len(part) else part
            count = int(part[-1]) + 1 if len(part) else 0
        read += 8
    out[open_] = True
    return out


def sorter(length: int, columns: pa.Schema):
    """One bucket: its variants in, the passages that occur elsewhere out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        raw = bucket.column("symbols").to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        count = bucket.column("passages").to_numpy().astype(np.int64)
        first = np.cumsum([0, *(len(r) for r in raw)])[:-1]
        owner = np.repeat(np.arange(len(raw)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        copies = bucket.column("copies").to_numpy()
        hit = repeated(data, first[owner] + place, copies[owner], length)
        keys, digests = bucket.column("key").to_numpy(), bucket.column("digest").to_numpy()
        rows, edges = [], np.cumsum([0, *count])
        for p in np.unique(owner[hit & (copies[owner] == 1)]):
            spans = sp.intervals(hit[edges[p] : edges[p + 1]])
            rows.append({"key": int(keys[p]), "digest": int(digests[p]), "spans": [{"a": a, "b": b} for a, b in spans]})
        yield pa.RecordBatch.from_pylist(rows, schema=columns)

    return work


def byte_cutter(text: tk.Texts):
    raw = text.data.tobytes()
    return lambda a, b: raw[a:b]


def leading_bytes(length: int, run: int):
    """The bytes at a piece's anchor, the first smallest run of its first string."""

    def lead(piece: bytes) -> bytes:
        runs = sp.Hashes(tk.PLAIN.codes[np.frombuffer(piece, np.uint8)[:length]]).runs(run)
        anchor = int(np.argmin(runs >> np.uint64(sp.PLACE_BITS)))
        return piece[anchor : anchor + run]

    return lead


def repeated_strings(docs: DataFrame, length: int = LENGTH, run: int = RUN, bucket_bytes: int = BUCKET_BYTES, hot: int = sp.HOT_VARIANTS) -> DataFrame:
    """(doc, spans) of the bytes covered by strings that start at another place too."""
    found = sp.repeats(docs, sp.byte_symbols, length, run)
    found = found._replace(variants=settled(found.variants))
    held = settled(sp.contents(docs, found.variants, byte_cutter, length, leading_bytes(length, run)))
    usual = held.where(F.col("variants") <= hot)
    n = usual.agg(F.sum(F.length("symbols"))).first()[0] or 0
    buckets = max(1, -(-int(n) // bucket_bytes))
    # every string of a piece holds the anchor, whose bytes are the leading bytes of the suffix that places the piece
    matches = in_arrow(usual.repartitionByRange(buckets, "lead"), sorter(length, fields(sp.MATCHES)), sp.MATCHES)
    dealt = settled(sp.dealt_passages(held.where(F.col("variants") > hot), 1, length))
    seen = dealt.groupBy("key", "passage").agg(F.sum("copies").alias("seen")).where("seen > 1")
    spread = dealt.where("copies = 1").join(seen, ["key", "passage"])
    return sp.covered(found, matches.unionByName(sp.spans_of(spread)), F.col("copies") > 1, length)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the kept bytes (or, with ``digest``, the
    lowercase hex of their SHA-256)."""
    rows = sp.source_rows(docs, doc_id, text)
    columns = fields(KEPT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, block in tk.blocks(whole, "text"):
                made = {"n_bytes": np.diff(block.offsets).tolist(), "n_removed": [], "n_spans": [], "kept": []}
                for i, found in enumerate(batch.column("spans").to_pylist()):
                    data = block.data[block.offsets[i] : block.offsets[i + 1]]
                    mask = sp.mask_of(found, len(data))
                    left = (data if mask is None else data[~mask]).tobytes()
                    made["n_removed"].append(0 if mask is None else int(mask.sum()))
                    made["n_spans"].append(0 if mask is None else len(sp.intervals(mask)))
                    made["kept"].append(hashlib.sha256(left).hexdigest().encode() if digest else left)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(made[f.name], f.type) for f in list(columns)[1:])], schema=columns)

    return in_arrow(sp.with_spans(rows, repeated_strings(rows, length, **options)), work, KEPT)
