"""Ranked search, embedding near-duplicates and vector codes, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lookout.llm import bags, hnsw, tries
from lookout.llm import tokens as tk

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


# --- ranked search ---------------------------------------------------------------------


def ranked_by_hand(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in set(items):
        found = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in set(terms(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def search_rows(corpus):
    docs = [(r[0], r[1]) for r in corpus]
    docs += [(None, "the an er"), (None, "the an er"), (500, "THE an er"), (501, "the-an.er!"), (502, "er the an the"), (503, "İstanbul ʼ the９")]
    items = [(1, "the an"), (2, corpus[5][1]), (2, "an other text of item two"), (3, None), (4, ""), (5, "¿ ... !"), (6, "unheard words"), (7, "THE the The"), (7, "THE the The"), (None, "one")]
    return docs, items + [(100 + i, " ".join(random.Random(i).sample(corpus[i][1].split(), 8))) for i in range(20)]


def ranked_rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_ranked(spark, make_docs, corpus, block_words):
    docs, items = search_rows(corpus)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, class string, score long")
    got = bags.ranked(make_docs(docs), table, block_words=block_words)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_rows(got) == ranked_by_hand(docs, items)
    assert max(Counter(r[0] for r in ranked_rows(got)).values()) > 10  # item 2 has two texts


def test_ranked_in_small_slices(make_docs, spark, corpus, monkeypatch):
    """Cutting the matrices anywhere gives the same rows."""
    docs, items = search_rows(corpus)
    known, held = bags.vocabulary([t for _, t in items if t])
    weights = np.arange(1.0, len(known.hashes) + 1)
    rng = np.random.default_rng(1)
    pairs = np.stack([np.sort(rng.choice(len(weights), 30, False)), rng.integers(1, 9, 30)], axis=1).astype("<i4")
    owner, m = np.sort(rng.integers(0, 4, 30)), np.array([10, 55, 100, 2000])
    n = len(held.first) - 1
    whole = bags.scores(m, pairs, owner, held, weights, 0, n)
    want = [[sum(int(weights[t]) * (10**9 * int(tf) // (1000 * int(tf) + 8 * int(m[c]))) for (t, tf), o in zip(pairs, owner, strict=True) if o == c and t in held.terms[held.first[i] : held.first[i + 1]]) for i in range(n)] for c in range(4)]
    assert whole.tolist() == want
    monkeypatch.setattr(bags, "TERM_ROWS", 3)
    assert (bags.scores(m, pairs, owner, held, weights, 0, n) == whole).all()
    assert (bags.scores(m, pairs, owner, held, weights, 2, 5) == whole[:, 2:5]).all()


def test_terms_are_confirmed_on_bytes():
    """Terms whose hashes collide are told apart, and a word with a known hash but other letters is no term."""
    data = np.frombuffer(b"cat dog cow", np.uint8)
    words = tk.Words(np.array([5, 5, 5], np.uint64), np.array([0, 4, 8]), np.array([3, 7, 11]), np.array([0, 3]))
    known = bags.Vocabulary(np.array([5, 5, 9], np.uint64), np.array([0, 3, 6, 9]), np.frombuffer(b"catdogcow", np.uint8))
    assert bags.lookup(known, data, words).tolist() == [0, 1, -1]


def test_equal_hashes_do_not_join_classes(spark, make_docs, monkeypatch):
    """Classes are told apart by m and bag, not by their hash."""
    monkeypatch.setattr(bags.F, "xxhash64", lambda *c: bags.F.lit(1).cast("long"))
    docs, items = [(1, "a b"), (2, "a a b"), (3, "a b"), (4, "b")], [(1, "a"), (2, "b a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_rows(bags.ranked(make_docs(docs), table)) == ranked_by_hand(docs, items)


def test_ranked_hot_class(spark, make_docs):
    docs = [(i, "hot words here") for i in range(3000, 0, -1)] + [(5000 + i, f"cold {i}") for i in range(2000)]
    items = [(1, "hot cold"), (2, "here"), (3, "cold 7")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_rows(bags.ranked(make_docs(docs), table)) == ranked_by_hand(docs, items)


def test_ranked_empty(spark, make_docs, none_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert bags.ranked(none_of, items).count() == 0
    assert bags.ranked(make_docs([(1, "a"), (2, None)]), items.limit(0)).count() == 0
    assert bags.ranked(make_docs([(1, None), (2, " ")]), items).count() == 0


# --- embedding near-duplicates ---------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node string, copies int, n_links long"


def vector_rows(n=700, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).tolist(), i % 2) for i in range(n)]
    center = rng.normal(size=dims)
    rows += [(n + i, (center + 0.12 * rng.normal(size=dims)).tolist(), 1) for i in range(200)]
    rows += [(n + 300 + i, center.tolist(), 1) for i in range(50)]  # copies
    chain = [[math.cos(a), math.sin(a)] + [0.0] * (dims - 2) for a in np.arange(0, 3, 0.3)]
    rows += [(n + 400 + i, v, 0) for i, v in enumerate(chain)]
    rows += [(n + 500, [0.0] * dims, 0), (n + 501, None, 0), (n + 502, [], 0), (n + 503, [float("nan")] + [1.0] * (dims - 1), 0), (n + 504, [None] + [1.0] * (dims - 1), 0)]
    rows += [(n + 505, [float("inf")] * dims, 0), (n + 506, center.tolist(), None), (n + 507, center.tolist(), None), (n + 508, (-center).tolist(), 1)]
    rows += [(n + 509, (1e-30 * center).tolist(), 1), (n + 510, (1e30 * center).tolist(), 1), (n + 511, center.tolist() + [0.0], 1), (n + 511, center.tolist() + [0.0], 1)]
    rows += [(3, rows[8][1], 0), (None, rows[10][1], 0), (None, [5.0] * dims, 0)]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


def near_by_hand(rows, threshold=0.93):
    vectors = [np.array(v, np.float32).astype(float) if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for _, v, lab in rows]
    units = [None if v is None else v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for v in vectors]
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for a, (i, *_) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(links[a]), least, i == least))
    return sorted(out, key=str)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 9, 9) for i, v, lab in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("shard_rows", [4096, 120])
def test_near_vectors(spark, shard_rows):
    rows = vector_rows()
    got = hnsw.near_components(vector_table(spark, rows), shard_rows=shard_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == near_by_hand(rows)


def test_near_vectors_empty(spark):
    assert hnsw.near_components(vector_table(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    got = hnsw.near_components(vector_table(spark, [(1, None, 1), (2, [1.0], None)]))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_graph_finds_neighbours():
    """Without any audit, a beam of the first width finds nine in ten of the true neighbours in unclustered vectors."""
    vectors = np.random.default_rng(5).normal(size=(1500, 24))
    graph = hnsw.build(vectors, 3)
    units = hnsw.units_of(vectors)
    truth = np.argsort(-(units[:200] @ units.T), axis=1)[:, 1:6]
    row, node, _ = hnsw.descend(graph, graph.units[:200], np.arange(200), np.zeros(200, np.int64))
    ids, sims = hnsw.beam(graph.units[:200], graph.units, graph.layers[0], row, node, hnsw.FIRST_WIDTH)
    assert (np.diff(sims, axis=1) <= 0).all()
    assert np.mean([len(set(t) & set(f)) / 5 for t, f in zip(truth.tolist(), ids.tolist(), strict=True)]) >= 0.9


def test_audit_widens_the_beam():
    """A graph without any edge still gives all links, since failed audits widen the beam up to the whole shard."""
    rng = np.random.default_rng(6)
    vectors = np.repeat(rng.normal(size=(60, 8)), 5, axis=0) + 0.01 * rng.normal(size=(300, 8))
    graph = hnsw.build(vectors, 1)
    for layer in graph.layers:
        layer[:] = -1
    units = hnsw.units_of(vectors)
    truth = units @ units.T >= 0.93
    assert (hnsw.linked(graph, vectors, vectors, None, 0.93, 1.0) == truth).all()


def test_forest():
    found = np.zeros((3, 5), bool)
    found[0, [1, 3]] = found[2, 3] = True
    by_row, by_column = hnsw.forest(found, False)
    assert by_row.tolist() == [1, -1, 1] and by_column.tolist() == [-1, 1, -1, 1, -1]


# --- vector codes ----------------------------------------------------------------------


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    size = next((len(v) for i, v, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)) if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)), 0)
    kept = [(i, [max(-(2**24), min(2**24, math.floor(1024 * float(np.float32(x))))) for x in v], lab) for i, v, lab in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    depth = size // parts
    cut = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), parts, depth)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def nearest():
        found = [((cut[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        return [d.argmin(axis=1) for d in found], [d.min(axis=1) for d in found]

    for _ in range(rounds):
        index, _ = nearest()
        for p in range(parts):
            for e in set(index[p].tolist()):
                mine = cut[index[p] == e, p]
                books[p, e] = mine.sum(axis=0) // len(mine)
    index, distance = nearest()
    errors = sum(distance)
    total = Counter()
    for (_, _, lab), e in zip(kept, errors.tolist(), strict=True):
        total[lab] += e
    text = ",".join(str(x) for x in books.ravel().tolist())
    out = [(i, [int(index[p][r]) for p in range(parts)], int(errors[r]), total[lab]) for r, (i, _, lab) in enumerate(kept)]
    return sorted(out, key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("options", [{}, {"entries": 7, "rounds": 2}, {"entries": 3000}])
def test_codes(spark, options, monkeypatch):
    monkeypatch.setattr(tries, "TASK_ROWS", 500)
    rows = [(i, v, lab if i is None or i % 5 else None) for i, v, lab in vector_rows(400)]
    rows += [(9000, [1e-3] * 17, 1), (9001, [3.0e38] * 16, 1), (9002, [-3.0e38] * 16, 1), (9003, [-1e-9] * 16, 1)]
    got, books = tries.compressed(vector_table(spark, rows), **options)
    assert got.columns == ["vec_id", "label", "codes", "error", "label_error"]
    want, digest = codes_by_hand(rows, **options)
    assert tries.digest(books) == digest
    assert sorted(((r["vec_id"], r["codes"], r["error"], r["label_error"]) for r in got.collect()), key=str) == want


def test_codes_empty(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 4, 1), (3, [], 1), (4, [1.0] * 5, 1)]):
        got, books = tries.compressed(vector_table(spark, rows or [(1, [1.0], 1)]).limit(len(rows)))
        assert got.count() == 0 and books.size == 0
    got, _ = tries.compressed(vector_table(spark, [(1, [1.0] * 8, None)]))
    assert [tuple(r) for r in got.collect()] == [(1, None, [0, 0, 0, 0], 0, 0)]


@pytest.mark.parametrize("leaves", [1, 3, 2048])
def test_trie_walk(monkeypatch, leaves):
    """Distances over the trie equal those of every leaf, however the leaves are cut into blocks and calls."""
    monkeypatch.setattr(tries, "LEAVES", leaves)
    rng = np.random.default_rng(leaves)
    for spread, dims in [(1, 3), (2, 6), (40, 5)]:
        rows, entries = rng.integers(-spread, spread + 1, (300, dims)), rng.integers(-spread, spread + 1, (9, dims))
        distinct, which = tries.lexicographic(rows)
        assert (distinct[which] == rows).all() and [tuple(r) for r in distinct] == sorted({tuple(r) for r in rows})
        far = ((distinct[:, None] - entries[None]) ** 2).sum(axis=2)
        walk = tries.Walk(entries)
        half = len(distinct) // 2
        found = [walk.nearest(distinct[:half]), walk.nearest(distinct[half:])]
        assert (np.concatenate([f[0] for f in found]) == far.argmin(axis=1)).all()
        assert (np.concatenate([f[1] for f in found]) == far.min(axis=1)).all()


def test_pairs_of_sliced_bags():
    bag = [np.array([[1, 2], [3, 4]], "<i4").tobytes(), b"", np.array([[5, 6]], "<i4").tobytes()]
    pairs, owner = bags.pairs_of(pa.array([b"12345678", *bag], pa.binary())[1:])
    assert pairs.tolist() == [[1, 2], [3, 4], [5, 6]] and owner.tolist() == [0, 0, 2]
