"""Vector code compression: product codes of whole-number vectors, learned and assigned over lexicographic tries.

A vector is cut into equal parts, each part position has its own codebook, and a code names the nearest entry of each part.
The distinct parts with their counts are written once, range-partitioned and sorted, so that the rows of a task are the leaves of a trie in
depth-first order: one level per dimension, equal beginnings share a node. The traversal carries for each node the squared
distances to all entries over the dimensions so far; a node's sums are made once and shared by all leaves below it. It goes
through blocks of consecutive leaves, level by level within a block, and hands the path of a block's last leaf to the
next. At the leaves it takes the nearest entry (ties to the lower index) and adds the part, times its count, to the
entry's sums. Tasks return sums per entry; the driver sees only codebooks, whose size does not depend on the table.

Defined cases: rows whose vector is null or empty, or holds null or non-finite components, are dropped. So are vectors of
another length than that of the smallest vec_id with a length that the parts divide (a table has one length). Components beyond
+-LIMIT after scaling count as +-LIMIT, so that all sums fit 64 bits. Repeated rows count as often as they occur; equal vec_ids are ordered
by their vectors, null vec_ids come last. With fewer rows than entries the codebooks have as many entries as there are rows.
An empty table gives an empty result. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import fields, in_arrow, input_columns, settled

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 24
LEAVES = 2048  #: leaves of a block of the traversal
TASK_ROWS = 32_768  #: distinct parts per task


def lexicographic(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and the index of each row among them."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


class Walk:
    """A depth-first traversal of the trie of one part position, resumed block after block."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # one row per entry
        self.last: np.ndarray | None = None  # the leaf visited last
        self.path = np.zeros((entries.shape[1] + 1, len(entries)), np.int64)  # its sums after each dimension

    def nearest(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each of the distinct ``leaves``, in lexicographic order, and its squared distance."""
        index, distance = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
        for start in range(0, len(leaves), LEAVES):
            block = leaves[start : start + LEAVES]
            sums = self.sums(block)
            index[start : start + len(block)] = at = sums.argmin(axis=1)
            distance[start : start + len(block)] = sums[np.arange(len(block)), at]
        return index, distance

    def sums(self, block: np.ndarray) -> np.ndarray:
        """The squared distances of consecutive leaves to all entries."""
        n, depth = block.shape
        before = np.concatenate([block[:1] if self.last is None else self.last[None], block[:-1]])
        differs = np.concatenate([block != before, np.ones((n, 1), bool)], axis=1)
        shared = differs.argmax(axis=1)  # leading dimensions shared with the leaf before
        if self.last is None:
            shared[0] = 0
        sums, node = self.path[:1].copy(), np.zeros(n, np.int64)
        path = [self.path[0]]
        for d in range(depth):
            new = shared <= d  # these leaves begin a node of depth d + 1
            kept = not new[0]  # the first leaf goes on below the path's node
            begins = np.flatnonzero(new)
            parent = node[begins]
            made = sums if not kept and len(parent) == len(sums) else sums[parent]  # one child each: in place
            step = block[begins, d][:, None] - self.entries[:, d][None]
            np.multiply(step, step, out=step)
            made = np.add(made, step, out=made)
            sums = np.concatenate([self.path[d + 1][None], made]) if kept else made
            node = np.cumsum(new) - (0 if kept else 1)
            path.append(sums[-1].copy())
        self.last, self.path = block[-1], np.stack(path)
        return sums[node]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of whole numbers as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def summer(codebooks: np.ndarray):
    """A stage from sorted distinct parts to the sums of each entry's parts."""
    n_parts, n_entries, depth = codebooks.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(entries) for entries in codebooks]
        total, count = np.zeros(codebooks.shape, np.int64), np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            part = batch.column("part").to_numpy()
            n, rows = batch.column("n").to_numpy(), matrix(batch.column("value"))
            for p in np.unique(part):
                mine = part == p
                index, _ = walks[p].nearest(rows[mine])
                np.add.at(total[p], index, rows[mine] * n[mine][:, None])
                np.add.at(count[p], index, n[mine])
        p, e = np.nonzero(count)
        place = np.tile(np.arange(depth), len(p))
        names = ["part", "entry", "place", "total", "n"]
        values = [np.repeat(p, depth), np.repeat(e, depth), place, total[p, e].ravel(), np.repeat(count[p, e], depth)]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=names)

    return work


def coder(codebooks: np.ndarray, columns: pa.Schema):
    """A stage that adds codes and error to rows: the trie of a batch's distinct parts, position by position."""
    n_parts, _, depth = codebooks.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("ints"))
            codes, error = np.zeros((len(rows), n_parts), np.int32), np.zeros(len(rows), np.int64)
            for p in range(n_parts):
                leaves, which = lexicographic(rows[:, p * depth : (p + 1) * depth])
                index, distance = Walk(codebooks[p]).nearest(leaves)
                codes[:, p] = index[which]
                error += distance[which]
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * n_parts, codes.ravel())
            made = {"codes": lists, "error": pa.array(error)}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in columns], schema=columns)

    return work


def whole_numbers(embeddings: DataFrame, vec_id: str, label: str, vector: str, parts: int) -> tuple[DataFrame, int]:
    """The kept rows as (vec_id, label, ints), and the length of their vectors (0: no rows)."""
    rows = input_columns(embeddings, vec_id=vec_id, label=label, vector=vector)
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    fits = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    rows = rows.where(F.col("vector").isNotNull() & fits & finite)
    first = rows.select("vec_id", F.size("vector").alias("size")).orderBy(F.asc_nulls_last("vec_id"), "size").first()
    size = first["size"] if first else 0
    scaled = F.transform("vector", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int"))
    return rows.where(F.size("vector") == size).select("vec_id", "label", scaled.alias("ints")), size


def learned(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, dimension) of rows with a column ``ints`` of ``size`` whole numbers."""
    depth = size // parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    codebooks = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, depth).transpose(1, 0, 2).copy()
    cut = F.array(*(F.slice("ints", 1 + p * depth, depth) for p in range(parts)))
    found = settled(rows.select(F.posexplode(cut).alias("part", "value")).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")))
    tasks = max(1, -(-found.count() // TASK_ROWS))
    found = settled(found.repartitionByRange(tasks, "part", "value").sortWithinPartitions("part", "value"))
    for _ in range(rounds):
        sums = in_arrow(found, summer(codebooks), "part long, entry long, place long, total long, n long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        codebooks = codebooks.copy()
        for p, e, d, total, n in sums.collect():  # at most one row per component of the codebooks
            codebooks[p, e, d] = total // n
    return codebooks


def compressed(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """The kept rows as vec_id, label, codes, error, label_error, and the codebooks."""
    rows, size = whole_numbers(embeddings, vec_id, label, vector, parts)
    rows = settled(rows)
    codebooks = learned(rows, size, parts, entries, rounds)
    id_type, label_type = (embeddings.schema[c].dataType.simpleString() for c in (vec_id, label))
    out = f"vec_id {id_type}, label {label_type}, codes array<int>, error long"
    coded = settled(in_arrow(rows, coder(codebooks, fields(out)), out))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of"), codebooks


def digest(codebooks: np.ndarray) -> str:
    """The hash of all components by part, entry and dimension."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
