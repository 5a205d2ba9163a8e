"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

1. Every text becomes its set of distinct five-word shingles, and the set a signature of 64 minima. Documents with
   equal sets form a class; only one representative of a class goes on.
2. The forest: ``TREES`` sorted orders of the signature. In each, representatives with the same first ``DEPTH`` values
   form a region. Every order is range-partitioned, so a region of any size is spread over tasks.
3. First links: a row's candidates are its neighbours of longest common prefix and the rows nearest to the consensus of
   its region. Each row takes its best one; the pair is confirmed on whole sets, and links are joined into components.
   A large group of near copies costs one comparison per copy.
4. Remaining links: in regions where rows of *different* components still look similar enough, those rows are compared
   on whole sets. Inside a region shingles are ordered from rare to frequent; a pair that is similar enough shares a
   shingle among the rarest of both (prefix filter, exact), so a passage shared by many texts makes no candidates.
   A mixed region above ``region_rows`` is cut along its main component, or, with many nodes of others, goes one value
   deeper under several orders at once: linked documents still meet, and the depth adapts to how crowded a region is.

Two texts at the threshold 0.85 share a region in at least one of the 12 orders with probability 1 - 1e-5.

Defined cases: texts without words, or null, have the empty set and no links; fewer words than a shingle give one
shingle of all words. Rows are told apart by doc_id and text, so texts that share a doc_id, or have none, are linked each by their own
words; a component's id is the smallest doc_id in it, null if it has none. ``one_per_component`` keeps one row of each
component, one of a repeated row too. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm import tokens as tk
from lookout.llm.common import fields, in_arrow, input_columns, row_key, settled, without_rows
from lookout.llm.components import components
from lookout.operators.scan import many_to_one

SHINGLE, MINIMA, TREES, DEPTH, EXTRA, DEEPEST = 5, 64, 12, 3, 6, 8
REGION_ROWS, CHUNK_ROWS = 50_000, 50_000
_odd = np.random.default_rng(41).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = np.random.default_rng(42).integers(1, 1 << 63, MINIMA, dtype=np.uint64)


def order_of(tree: int) -> np.ndarray:
    """An order of the signature's values; the first ones of different trees do not overlap."""
    head = np.arange(tree * DEPTH, (tree + 1) * DEPTH)
    return np.concatenate([head, np.setdiff1d(np.arange(MINIMA), head)[np.random.default_rng(100 + tree).permutation(MINIMA - DEPTH)]])


ORDERS = np.array([order_of(t) for t in range(TREES)])


def shingle_sets(block: tk.Texts, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    words = tk.words(block, tk.LOWERED)
    runs = tk.windows(words.hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(tk.windows(words.hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima per set; rows of empty sets are meaningless."""
    out = np.zeros((len(sets), MINIMA), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    for j in range(MINIMA):
        out[full, j] = np.minimum.reduceat(flat * _odd[j] + _add[j], at)
    return out


SIGNED = "doc_id long, doc long, row long, n_shingles long, digest binary, short binary, keys array<long>"


def signer(size: int, columns: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, block in tk.blocks(whole, "text"):
                sets = shingle_sets(block, size)
                minima = tk.mix(signatures(sets))
                short = (minima >> np.uint64(56)).astype(np.uint8)
                keys = np.stack([tk.row_hashes(minima[:, ORDERS[t, :DEPTH]]) for t in range(TREES)], axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("doc_id", "doc", "row")),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                        pa.array(list(keys), columns.field("keys").type),
                    ],
                    schema=columns,
                )

    return work


def agreement_floor(percent: int) -> int:
    """Equal signature values below which a pair of that similarity falls with a chance under 1e-5."""
    p = percent / 100
    return max(1, floor(MINIMA * p - 4.4 * sqrt(MINIMA * p * (1 - p))))


def forest_regions(classes: DataFrame) -> DataFrame:
    """(tree, key, node) for every region with at least two nodes."""
    level = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    return level.join(level.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tree", "key"), ["tree", "key"])


def mixed_regions(regions: DataFrame, drawn: DataFrame, labels: DataFrame, region_rows: int) -> DataFrame:
    """Rows (tree, key, node, n_shingles, short, label) of regions with nodes of several components.

    A region above ``region_rows`` of which most nodes are one component is cut: that component's nodes are dealt out, and
    the few others go to every part. One with many nodes of other components goes one value deeper.
    """
    columns = ["tree", "key", "node", "n_shingles", "short", "label"]
    level = regions.join(drawn.join(labels, "node"), "node").select(*columns)
    done = None
    for depth in range(DEPTH, DEEPEST + 1):
        counts = level.groupBy("tree", "key", "label").agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.groupBy("tree", "key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"))
        sizes = sizes.where("size > main.n").select("tree", "key", "size", F.col("main.label").alias("main"), (F.col("size") - F.col("main.n")).alias("others"))
        sized = settled(level.join(sizes, ["tree", "key"]))
        crowded, many = F.col("size") > region_rows, F.col("others") > region_rows
        parts = F.ceil(F.col("size") / region_rows).cast("int")
        own = F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))
        part = F.explode(F.when(F.col("label") == F.col("main"), own).otherwise(F.sequence(F.lit(0), parts - 1)))
        cut = sized.where(crowded & ~many).withColumn("part", part).withColumn("key", F.xxhash64("key", "part"))
        fine = sized.where(~crowded if depth < DEEPEST else ~crowded | many).select(*columns).unionByName(cut.select(*columns))
        done = fine if done is None else done.unionByName(fine)
        deeper = sized.where(crowded & many)
        if depth == DEEPEST or not deeper.take(1):
            return done
        start = DEPTH + (depth - DEPTH) * EXTRA
        orders = F.array(*(F.array(*(F.lit(int(c)) for c in ORDERS[t, start : start + EXTRA])) for t in range(TREES)))
        column = F.element_at(F.element_at(orders, F.col("tree") + 1), F.col("pick") + 1)
        level = deeper.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(EXTRA - 1))))
        level = level.withColumn("key", F.xxhash64("key", "pick", F.substring("short", column + 1, F.lit(1)))).select(*columns)
    return done


def regions_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """The regions of rows sorted by (tree, key), in parts of about ``most`` rows; whether a part may go on elsewhere."""
    held, last, rows, whole = [], None, 0, False
    for batch in batches:
        tree, key = batch.column("tree").to_numpy(), batch.column("key").to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (key[1:] != key[:-1])) + 1
        edges = [0, *cuts.tolist(), len(key)]
        for a, b in zip(edges, edges[1:]):
            now = (int(tree[a]), int(key[a]))
            if held and (now != last or rows > most):
                yield pa.Table.from_batches(held), not whole or now == last
                held, rows, whole = [], 0, now != last
            held.append(batch.slice(a, b - a))
            rows, last = rows + b - a, now
    if held:
        yield pa.Table.from_batches(held), True


def shorts(region: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(region.column("short").to_pylist()), np.uint8).reshape(-1, MINIMA)


def alike(n: np.ndarray, short: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may be linked, and their equal signature values."""
    same = (short[i] == short[j]).sum(axis=1)
    return (same >= agreement_floor(percent)) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])), same


NEAREST = "tree int, key long, a long, b long, same int"


def nearest_finder(columns: pa.Schema, percent: int):
    """For rows of a region in signature order: candidates by longest common prefix and by the region's consensus.

    A pivot of a region that may go on in another part is returned as a pair with itself.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, open_ in regions_of(batches, CHUNK_ROWS):
            node, n, short = region.column("node").to_numpy(), region.column("n_shingles").to_numpy(), shorts(region)
            tree, key = region.column("tree")[0].as_py(), region.column("key")[0].as_py()
            rows = np.arange(len(node))
            ranked = np.lexsort(short[:, ORDERS[tree][::-1]].T)
            consensus = np.array([np.bincount(short[:, c], minlength=256).argmax() for c in range(MINIMA)], np.uint8)
            pivots = np.argsort(-(short == consensus).sum(axis=1), kind="stable")[:2]
            parts = [(ranked[:-1], ranked[1:]), (ranked[1:], ranked[:-1]), *((rows[rows != p], np.full(len(rows) - 1, p)) for p in pivots)]
            if open_:
                parts.append((pivots, pivots))
            for i, j in parts:
                if len(i):
                    ok, same = alike(n, short, i, j, percent)
                    i, j, same = i[ok], j[ok], same[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), tree, np.int32)), pa.array(np.full(len(i), key)), pa.array(node[i]), pa.array(node[j]), pa.array(same.astype(np.int32))], schema=columns)

    return work


OPEN = "tree int, key long, node long"


def open_finder(columns: pa.Schema, percent: int):
    """The nodes of a region that look similar enough to a node of another component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, _ in regions_of(batches, 1 << 40):
            node, n, label, short = (*(region.column(c).to_numpy() for c in ("node", "n_shingles", "label")), shorts(region))
            names, counts = np.unique(label, return_counts=True)
            rest = np.flatnonzero(label != names[counts.argmax()])
            found = np.zeros(len(node), bool)
            size = max(1, (1 << 24) // (len(node) * MINIMA))
            for at in range(0, len(rest), size):
                i = np.repeat(rest[at : at + size], len(node))
                j = np.tile(np.arange(len(node)), len(rest[at : at + size]))
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                ok, _ = alike(n, short, i, j, percent)
                found[i[ok]] = found[j[ok]] = True
            keep = np.flatnonzero(found)
            if len(keep):
                yield region.select(["tree", "key", "node"]).take(pa.array(keep)).combine_chunks().to_batches()[0].cast(columns)

    return work


def setter(size: int, columns: pa.Schema):
    """(node, shingles): the set as 8-byte values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, block in tk.blocks(whole, "text"):
                sets = pa.array([s.tobytes() for s in shingle_sets(block, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), sets], schema=columns)

    return work


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmer(columns: pa.Schema, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True))
            keep = [linked(x, y, percent) for x, y in sets]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=columns).filter(pa.array(keep, pa.bool_()))

    return work


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return in_arrow(both.select("a", "b", "x", "y"), confirmer(fields("a long, b long"), percent), "a long, b long")


def rare_pairs(sets: list[np.ndarray], percent: int) -> Iterator[list[int]]:
    """Groups of sets that share one of their rarest shingles; every similar pair is in one (prefix filter)."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    order = np.lexsort((rank[which], owner))
    token, owner = rank[which][order], owner[order]
    sizes = np.array([len(s) for s in sets])
    place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place < (sizes - -(-sizes * percent // 100) + 1)[owner]
    token, owner = token[inside], owner[inside]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            yield owner[a:b].tolist()


def region_links(node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components inside a region; pairs that are connected by then are not compared."""
    parent = {int(x): int(x) for x in label}
    label = label.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen, out = set(), []
    for group in rare_pairs(sets, percent):
        if len({root(label[i]) for i in group}) < 2:
            continue
        for k, i in enumerate(group):
            for j in group[:k]:
                a, b = root(label[i]), root(label[j])
                if a == b or (i, j) in seen:
                    continue
                seen.add((i, j))
                small, large = sorted((len(sets[i]), len(sets[j])))
                if 100 * small >= percent * large and linked(sets[i], sets[j], percent):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(node[j]), int(node[i])))
    return out


def region_linker(columns: pa.Schema, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, _ in regions_of(batches, 1 << 40):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in region.column("shingles")]
            found = region_links(region.column("node").to_numpy(), region.column("label").to_numpy(), sets, percent)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=columns)

    return work


def by_region(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "key").sortWithinPartitions("tree", "key", "node")


def first_pairs(regions: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each node its best candidate over all orders."""
    find = nearest_finder(fields(NEAREST), percent)
    rows = settled(regions.join(drawn, "node"))
    spread = rows.repartitionByRange("tree", "key", "short").sortWithinPartitions("tree", "key", "short", "node")
    found = settled(in_arrow(spread, find, NEAREST))
    # Parts of one region are tied together by their pivots.
    pivots = found.where("a = b").select("tree", "key", F.col("a").alias("node")).distinct()
    several = pivots.join(pivots.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("tree", "key"), ["tree", "key"])
    tied = in_arrow(by_region(several.join(drawn, "node")), find, NEAREST)
    both = found.unionByName(tied).where("a <> b")
    best = both.groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components_of_rows(docs: DataFrame, doc_id: str, text: str, percent: int, shingle: int, region_rows: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, doc, row, n_shingles, digest), and per digest (a class of equal sets): root of its component, first (doc,
    row) and smallest doc_id."""
    rows = input_columns(docs, doc_id=doc_id, text=text).withColumns(row_key())
    signed = settled(in_arrow(rows, signer(shingle, fields(SIGNED)), SIGNED))
    drawn_from = {c: F.any_value(c).alias(c) for c in ("n_shingles", "short", "keys")}
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("first"), F.min("doc_id").alias("least"), *drawn_from.values())
    classes = settled(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes = classes.select("node", *drawn_from)
    regions = settled(forest_regions(nodes))
    members = settled(regions.select("node").distinct())
    wanted = classes.join(members, "node", "left_semi").select("node", "first.*")
    texts = rows.select("doc", "row", "text").join(wanted, ["doc", "row"]).select("node", "text")
    sets = settled(in_arrow(texts, setter(shingle, fields("node long, shingles binary")), "node long, shingles binary"))
    if sets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):  # repeated rows
        sets = settled(sets.dropDuplicates(["node"]))
    drawn = settled(nodes.join(members, "node", "left_semi").select("node", "n_shingles", "short"))

    stars = components(settled(confirmed(first_pairs(regions, drawn, percent), sets, percent)))
    labels = settled(members.join(stars.select(F.col("b").alias("node"), F.col("a").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    mixed = mixed_regions(regions, drawn, labels, region_rows)
    left = settled(in_arrow(by_region(mixed), open_finder(fields(OPEN), percent), OPEN))
    more = in_arrow(by_region(left.join(labels, "node").join(sets, "node")), region_linker(fields("a long, b long"), percent), "a long, b long")
    stars = components(stars.unionByName(settled(more)))
    placed = classes.select("digest", "first", "least", "node").join(stars.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left")
    return signed.select("doc_id", "doc", "row", "n_shingles", "digest"), settled(placed.withColumn("root", F.coalesce("root", "node")).drop("node"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = SHINGLE, region_rows: int = REGION_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed, classes = components_of_rows(docs, doc_id, text, percent, shingle, region_rows)
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settled(many_to_one(classes, smallest, ["root"], "inner", spread_by=["digest"]).select("digest", "component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return signed.join(named, "digest", "left").select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows that stay, one of each component and all without words, with all their columns. Rows are told apart by id and
    text, so another text with the id of a copy stays."""
    signed, classes = components_of_rows(docs, doc_id, text, percent, SHINGLE, REGION_ROWS)
    winners = classes.groupBy("root").agg(F.min("first").alias("first"))
    named = settled(many_to_one(classes.drop("first", "least"), winners, ["root"], "inner", spread_by=["digest"]).select("digest", "first"))
    counted = signed.where("n_shingles > 0").groupBy("digest", "doc", "row").agg(F.count(F.lit(1)).alias("n"))
    judged = settled(many_to_one(counted, named, ["digest"], "inner", spread_by=["doc", "row"]))
    stays = (F.col("doc") == F.col("first.doc")) & (F.col("row") == F.col("first.row"))
    return without_rows(docs, row_key(doc_id, text), judged.where(~stays), judged.where(stays & (F.col("n") > 1)))
