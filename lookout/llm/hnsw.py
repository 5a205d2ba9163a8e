"""Embedding near-duplicates: navigable small-world graphs per shard, every shard queried, recall audited.

Equal vectors of a label are one *node* with a count. The nodes of a label are dealt by hash into shards of about
``shard_rows`` and one hierarchical graph is built per shard. Every pair of shards of a label is searched: the nodes of one shard
are the queries of the other's graph. A query's beam widens as long as it is full of links. The search of a pair is then
audited: the links of up to ``AUDIT`` of its queries are counted by brute force, and the whole search is repeated with
a beam twice as wide until the share ``recall`` of them is found. The wider a beam, the more places it starts from; one as wide as the shard starts everywhere,
so the widening ends with complete results. Cosines of links are verified in double precision.

A pair returns the number of links of each of its nodes and a spanning forest of them, never the pairs of rows themselves; counts
are summed and forests united in Spark. Work per query grows with the number of shards of its label. Many queries search
together, so a step of the search is one array operation.

Defined cases: rows whose vector is null, empty, all zero or holds null or non-finite components, and rows without a label, link with
nothing; they and all other rows without links are their own component. Vectors of different lengths never link.
Rows with equal vectors link with each other, repeated rows too, and each counts as a vector. A vec_id that
occurs with several vectors has a row for each. Null vec_ids are never the smallest id of a component that has others;
a component without ids has a null component_id, and its rows are kept. An empty table gives an empty result. Columns other than the
named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import fields, input_columns, settled
from lookout.llm.components import components
from lookout.operators.scan import many_to_one

COSINE = 0.93
RECALL = 1.0  #: share of the audited links that a search must find
SHARD_ROWS = 4096
AUDIT = 256  #: audited queries per searched pair of shards
DEGREE = 12  #: neighbours per node; twice as many on the lowest layer
BUILD_WIDTH, FIRST_WIDTH, UPPER_WIDTH = 48, 64, 16
BATCH = 256  #: queries or insertions worked on together
SLACK = 1e-4  #: below the threshold in single precision a candidate is still verified
INDEX = "ids array<long>, copies array<long>, vectors binary, levels array<int>, links array<binary>"


class Graph(NamedTuple):
    """The layers of a shard: for each, one row of neighbours (-1: none) per node of the shard."""

    units: np.ndarray  # vectors of length 1, single precision
    levels: np.ndarray
    layers: list[np.ndarray]


def units_of(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1, scaled by their largest component first so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def beam(queries: np.ndarray, units: np.ndarray, links: np.ndarray, row: np.ndarray, node: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once; (row, node) are the places where each starts.

    Returns the best ``width`` nodes of each query, nearest first (-1: none), and their similarities.
    """
    q, n = len(queries), len(units)
    step = max(4, width // 16)
    seen = np.zeros(q * n, bool)
    ids, sims, fresh = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf, np.float32), np.zeros((q, width), bool)
    while True:
        key = row * n + node
        key = np.unique(key[~seen[key]])
        seen[key] = True
        row, node = key // n, key % n
        count = np.bincount(row, minlength=q)
        at = np.flatnonzero(count)
        if len(at):
            place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            line = np.cumsum(count > 0)[row] - 1
            new_ids, new_sims = np.full((len(at), count.max()), -1, np.int64), np.full((len(at), count.max()), -np.inf, np.float32)
            new_ids[line, place] = node
            new_sims[line, place] = np.einsum("ij,ij->i", units[node], queries[row])
            all_ids, all_sims = np.concatenate([ids[at], new_ids], axis=1), np.concatenate([sims[at], new_sims], axis=1)
            all_fresh = np.concatenate([fresh[at], new_ids >= 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[at], sims[at], fresh[at] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_sims, all_fresh))
        pick = fresh & (np.cumsum(fresh, axis=1) <= step)
        if not pick.any():
            return ids, sims
        fresh &= ~pick
        row, place = np.nonzero(pick)
        found = links[ids[row, place]]
        row = np.repeat(row, found.shape[1])
        node = found.ravel()
        row, node = row[node >= 0], node[node >= 0]


def chosen(units: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row of candidates, nearest first, up to ``keep`` neighbours: those nearer to the row's node than to a neighbour
    taken before, then the nearest of the others."""
    n = ids.shape[1]
    near = units[np.maximum(ids, 0)]
    between = near @ near.transpose(0, 2, 1)
    taken, count = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
    for c in range(n):
        ok = (ids[:, c] >= 0) & (count < keep) & ~((between[:, c] > sims[:, c, None]) & taken).any(axis=1)
        taken[:, c] = ok
        count += ok
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * n + np.arange(n)
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(ids, order, axis=1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1) if out.shape[1] < keep else out


def connect(units: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Link the ``new`` nodes with neighbours chosen from their candidates, and those back."""
    keep = links.shape[1]
    links[new, :DEGREE] = chosen(units, ids, sims, DEGREE)
    row, place = np.nonzero(links[new] >= 0)
    target, source = links[new][row, place], new[row]
    near = np.einsum("ij,ij->i", units[target], units[source])
    order = np.lexsort((source, -near, target))
    target, source = target[order], source[order]
    first = np.searchsorted(target, target)
    place = np.arange(len(target)) - first
    some = place < 2 * keep  # the nearest of the newcomers can become neighbours
    nodes, line = np.unique(target, return_inverse=True)
    for start in range(0, len(nodes), BATCH):
        part = nodes[start : start + BATCH]
        mine = some & (line >= start) & (line < start + len(part))
        wide = np.full((len(part), 2 * keep), -1, np.int64)
        wide[line[mine] - start, place[mine]] = source[mine]
        wide = np.concatenate([links[part], wide], axis=1)
        wide = wide[:, (wide >= 0).any(axis=0)]
        near = np.where(wide >= 0, np.einsum("ijk,ik->ij", units[np.maximum(wide, 0)], units[part]), -np.inf).astype(np.float32)
        order = np.argsort(-near, axis=1, kind="stable")
        links[part] = chosen(units, np.take_along_axis(wide, order, axis=1), np.take_along_axis(near, order, axis=1), keep)


def descend(graph: Graph, queries: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Down the upper layers to where the lowest one is to be entered; the beams of each layer on the way, highest first."""
    beams = []
    for links in reversed(graph.layers[1:]):
        ids, sims = beam(queries, graph.units, links, row, node, UPPER_WIDTH)
        beams.append((ids, sims))
        row, place = np.nonzero(ids[:, : UPPER_WIDTH // 2] >= 0)
        node = ids[row, place]
    return row, node, beams


def build(vectors: np.ndarray, seed: int) -> Graph:
    """The hierarchical graph of a shard's vectors; node 0 is on all layers and the way in."""
    n = len(vectors)
    draws = np.random.default_rng(seed).random(n)
    levels = np.floor(-np.log(1 - draws) / np.log(DEGREE)).astype(np.int64)
    levels[0] = levels.max()
    layers = [np.full((n, DEGREE * (2 if level == 0 else 1)), -1, np.int64) for level in range(levels[0] + 1)]
    graph = Graph(units_of(vectors).astype(np.float32), levels, layers)
    start, size = 1, 1
    while start < n:
        new = np.arange(start, min(start + size, n))
        queries = graph.units[new]
        within = queries @ queries.T
        np.fill_diagonal(within, -np.inf)
        row, node, beams = descend(graph, queries, np.arange(len(new)), np.zeros(len(new), np.int64))
        beams.append(beam(queries, graph.units, layers[0], row, node, BUILD_WIDTH))
        for level, (ids, sims) in zip(range(len(layers) - 1, -1, -1), beams, strict=True):
            mine = np.flatnonzero(levels[new] >= level)
            if not len(mine):
                continue
            nearest = np.argsort(-within[mine][:, mine], axis=1, kind="stable")[:, :UPPER_WIDTH]
            others, near = new[mine][nearest], np.take_along_axis(within[mine][:, mine], nearest, axis=1)
            others = np.where(np.isfinite(near), others, -1)
            ids, sims = np.concatenate([ids[mine], others], axis=1), np.concatenate([sims[mine], near], axis=1).astype(np.float32)
            order = np.argsort(-sims, axis=1, kind="stable")
            connect(graph.units, layers[level], new[mine], np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1))
        start += len(new)
        size = min(BATCH, start)
    return graph


def linked(graph: Graph, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray | None, threshold: float, recall: float) -> np.ndarray:
    """Which queries link with which nodes, as a matrix. ``own`` are the nodes that the queries are themselves, if they are of this shard."""
    n, units = len(vectors), units_of(queries)
    exact = units_of(vectors)
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(np.int64))
    truth = units[sample] @ exact.T >= threshold
    if own is not None:
        truth[np.arange(len(sample)), own[sample]] = False
    width = FIRST_WIDTH
    out = np.zeros((len(queries), n), bool)
    while True:
        open_, wide = np.arange(len(queries)), width
        while len(open_):
            wide = min(wide, n)
            again = []
            for start in range(0, len(open_), BATCH):
                part = open_[start : start + BATCH]
                asked = units[part].astype(np.float32)
                row, node, _ = descend(graph, asked, np.arange(len(part)), np.zeros(len(part), np.int64))
                seeds = np.linspace(0, n - 1, n if wide >= n else wide // 16).astype(np.int64)
                row, node = np.concatenate([row, np.repeat(np.arange(len(part)), len(seeds))]), np.concatenate([node, np.tile(seeds, len(part))])
                if own is not None:
                    row, node = np.concatenate([row, np.arange(len(part))]), np.concatenate([node, own[part]])
                ids, sims = beam(asked, graph.units, graph.layers[0], row, node, wide)
                row, place = np.nonzero(sims >= threshold - SLACK)
                node = ids[row, place]
                sure = np.einsum("ij,ij->i", units[part[row]], exact[node]) >= threshold
                out[part[row[sure]], node[sure]] = True
                if wide < n:
                    again.append(part[sims[:, -1] >= threshold - SLACK])
            open_ = np.concatenate(again) if again else open_[:0]
            wide *= 2
        if own is not None:
            out[np.arange(len(queries)), own] = False
        if (out[sample] & truth).sum() >= recall * truth.sum() or width >= n:
            return out
        width *= 2


def forest(found: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links the smallest place in its component (columns first, then rows, unless
    both are the same nodes), or -1."""
    rows, columns = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    inner = found[np.ix_(rows, columns)]
    none = found.shape[0] + found.shape[1]
    down = columns.copy()
    across = rows.copy() if same else rows + found.shape[1]
    while len(rows):
        across_now = np.minimum(across, np.where(inner, down[None], none).min(axis=1))
        down_now = np.minimum(down, np.where(inner, across_now[:, None], none).min(axis=0))
        if same:
            across_now = down_now = np.minimum(across_now, down_now)
        if (across_now == across).all() and (down_now == down).all():
            break
        across, down = across_now, down_now
    by_row, by_column = np.full(found.shape[0], -1, np.int64), np.full(found.shape[1], -1, np.int64)
    by_row[rows], by_column[columns] = across, down
    return by_row, by_column


def packed_index(columns: pa.Schema):
    """A grouped stage from the nodes of a shard to one row with its graph."""

    def work(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        size, shard = nodes["size"][0].as_py(), nodes["shard"][0].as_py()
        vectors = nodes["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size)
        graph = build(vectors, shard)
        links = [layer[graph.levels >= level].astype("<i4").tobytes() for level, layer in enumerate(graph.layers)]
        made = {
            "ids": nodes["node"].to_pylist(),
            "copies": nodes["copies"].to_pylist(),
            "vectors": vectors.astype("<f8").tobytes(),
            "levels": graph.levels.tolist(),
            "links": links,
        }
        return pa.table({f.name: pa.array([made[f.name]], f.type) if f.name in made else nodes[f.name][:1].cast(f.type) for f in columns}, schema=columns)

    return work


def unpacked(levels: np.ndarray, vectors: np.ndarray, links: list[bytes]) -> Graph:
    layers = []
    for level, data in enumerate(links):
        degree = DEGREE * (2 if level == 0 else 1)
        layer = np.full((len(levels), degree), -1, np.int64)
        layer[levels >= level] = np.frombuffer(data, "<i4").reshape(-1, degree)
        layers.append(layer)
    return Graph(units_of(vectors).astype(np.float32), levels, layers)


def searcher(threshold: float, recall: float, columns: pa.Schema):
    """A stage over pairs of shards: rows (a, null, number of links of a in this pair) and (a, b, 0) of a spanning forest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                pair = {name: batch.column(name)[row] for name in batch.schema.names}
                size, same = pair["size"].as_py(), pair["i"].as_py() == pair["j"].as_py()
                ids, copies, other_ids, other_copies, levels = (pair[c].values.to_numpy() for c in ("ids", "copies", "other_ids", "other_copies", "levels"))
                vectors, others = (np.frombuffer(pair[c].as_py(), "<f8").reshape(-1, size) for c in ("vectors", "other_vectors"))
                graph = unpacked(levels, vectors, pair["links"].as_py())
                found = linked(graph, vectors, others, np.arange(len(ids)) if same else None, threshold, recall)
                if same:
                    found |= found.T
                by_row, by_column = forest(found, same)
                sides = [(ids, found.T @ other_copies, by_column)]
                if not same:
                    sides.append((other_ids, found @ copies, by_row))
                places = np.concatenate([ids, other_ids])
                for own, n, root in sides:
                    held = np.flatnonzero(root >= 0)
                    a, b = places[root[held]], own[held]
                    yield pa.RecordBatch.from_arrays([pa.array(b), pa.nulls(len(b), pa.int64()), pa.array(n[held], pa.int64())], schema=columns)
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b]), pa.array(np.zeros((a != b).sum(), np.int64))], schema=columns)

    return work


def links_of(nodes: DataFrame, threshold: float, recall: float, shard_rows: int) -> DataFrame:
    """The links of nodes (node, label, size, vector, copies) as rows (a, b, n) of ``searcher``."""
    group = ["label", "size"]
    counts = settled(nodes.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards")))
    n_shards = counts.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dealt = many_to_one(nodes, counts, group, "inner", spread_by=["node"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    dealt = dealt.drop("shards").repartition(max(1, n_shards), *group, "shard")  # about one shard per task
    label = nodes.schema["label"].dataType.simpleString()
    out = f"label {label}, size int, shard int, {INDEX}"
    index = settled(dealt.groupBy(*group, "shard").applyInArrow(packed_index(fields(out)), out))
    one = index.withColumnRenamed("shard", "i")
    other = index.select(*group, F.col("shard").alias("j"), F.col("ids").alias("other_ids"), F.col("copies").alias("other_copies"), F.col("vectors").alias("other_vectors"))
    pairs = index.select(*group, F.col("shard").alias("i")).join(counts, group).withColumn("j", F.explode(F.sequence("i", F.col("shards") - 1))).drop("shards")
    pairs = pairs.join(one, [*group, "i"]).join(other, [*group, "j"])
    pairs = pairs.repartition(max(1, n_shards), *group, "i", "j")
    out = "a long, b long, n long"
    return settled(pairs.mapInArrow(searcher(threshold, recall, fields(out)), out))


def near_components(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    threshold: float = COSINE,
    recall: float = RECALL,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = input_columns(embeddings, vec_id=vec_id, label=label, vector=vector)
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = settled(rows.withColumns({"vector": F.col("vector").cast("array<double>"), "usable": usable}))
    key = ["label", "vector"]
    nodes = rows.where("usable").groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = settled(nodes.select("*", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("node")))
    links = links_of(nodes.drop("least"), threshold, recall, shard_rows)
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(links.where("b IS NOT NULL").select("a", "b")).select(F.col("b").alias("node"), F.col("a").alias("root"))
    placed = nodes.select("node", "copies", "least").join(counts, "node", "left").join(roots, "node", "left")
    placed = settled(placed.withColumn("root", F.coalesce("root", "node")))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = many_to_one(placed, smallest, ["root"], "inner", spread_by=["node"])
    placed = placed.select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = nodes.select(*key, "node").join(placed, "node").drop("node")
    found = many_to_one(rows.where("usable"), placed, key, "inner", spread_by=["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
