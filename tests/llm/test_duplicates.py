"""Exact and near duplicates, repeated passages and strings, against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lookout.llm import components as co
from lookout.llm import exact, fmindex, lshforest, spans, suffixes
from lookout.llm import tokens as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows_of(df, *columns):
    """The rows as a multiset of tuples."""
    return Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in (r[c] for c in columns)) for r in df.collect())


def told_apart(corpus):
    """The corpus with ids that repeat over different texts, and texts without an id."""
    more = [(1, corpus[5][1], "s"), (1, corpus[5][1], "s"), (8, corpus[9][1], "s"), (7, "no words of the others", "s"), (202, corpus[12][1] + " end", "s")]
    more += [(None, corpus[3][1], "s"), (None, corpus[15][1], "s"), (None, corpus[15][1], "s"), (None, corpus[15][1].replace("the", "THE"), "s"), (None, None, "s"), (None, "alone here", "s")]
    return [*corpus, *more]


# --- exact -----------------------------------------------------------------------------


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, sha(norm)) for norm, g in groups.items() for _, i in g}


@pytest.mark.parametrize("prefix", [64, 2])
def test_exact(make_docs, corpus, by_id, prefix):
    rows = [*corpus, (400, "a b c d", "s"), (401, "abcd", "s"), (402, "ab cd", "s"), (403, "abce", "s"), (404, "abdc", "s")]
    docs = make_docs(rows)
    want = exact_by_hand(rows)
    assert by_id(exact.exact_groups(docs, hash_all=True, prefix=prefix), "keep_id", "group_size", "kept", "text_sha256") == want
    lazy = by_id(exact.exact_groups(docs, prefix=prefix), "keep_id", "group_size", "kept", "text_sha256")
    assert {i: v[:3] for i, v in lazy.items()} == {i: v[:3] for i, v in want.items()}
    assert all(v[3] is None or v[3] == want[i][3] for i, v in lazy.items())
    assert lazy[303][3] is None  # never hashed whole
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, v in want.items() if v[2]}


def test_one_row_per_text(spark, make_docs, corpus):
    """Of equal texts one row stays, repeated rows and rows without ids included, and no column is lost."""
    rows = told_apart(corpus) + [(900, "w x", "s"), (900, "wx ", "s"), (900, "wx", "s"), (None, "wx", "s"), (901, " w x ", "s")]
    docs = make_docs(rows).withColumnRenamed("key", "_sha_2").withColumnRenamed("node", "sha")
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is not None, i))
    want = Counter((min(g)[2], -min(g)[0], norm) for norm, g in groups.items())
    assert Counter((r["doc_id"], len(r["text"] or ""), re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")) for r in left.collect()) == want
    assert all(r["_sha_2"] == 7 and r["sha"] == "n" for r in left.collect())


def test_exact_empty_and_null_ids(make_docs, none_of):
    assert exact.exact_groups(none_of).count() == 0
    docs = make_docs([(None, "same"), (3, "same"), (None, "other")])
    got = sorted(map(tuple, exact.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(3, None, 2, False), (None, None, 1, True), (None, None, 2, True)], key=str)


# --- near ------------------------------------------------------------------------------


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def near_by_hand(rows, percent):
    """One (doc_id, n_shingles, component_id, kept) per row, and the component of each row."""
    sets = [shingles(text) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    roots = [root(i) for i in range(len(rows))]
    least = {}
    for r, (i, *_) in zip(roots, rows, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    out = [(i, len(s), least.get(r) if s else i, i == (least.get(r) if s else i)) for (i, *_), s, r in zip(rows, sets, roots, strict=True)]
    return out, roots


def chains(prose):
    """Texts of which each differs a little from the one before, and two large groups just below the threshold."""
    rows, words = [], prose(150, 1)
    for i in range(40):
        words = list(words)
        words[(i * 13) % 150] = f"w{i}"
        rows.append((1000 + i, " ".join(words), "s"))
    base = prose(200, 2)
    for i in range(30):
        one = list(base)
        one[5 * i + 3] = f"v{i}"
        one[(5 * i + 90) % 200] = f"u{i}"
        rows.append((2000 + i, " ".join(one), "s"))
    other = list(base)
    other[20:36] = prose(16, 5)
    for i in range(30):
        one = list(other)
        one[6 * i + 1] = f"z{i}"
        rows.append((3000 + i, " ".join(one), "s"))
    return rows


@pytest.mark.parametrize(("percent", "region_rows"), [(85, 50_000), (80, 8)])
def test_near(make_docs, corpus, prose, by_id, percent, region_rows, monkeypatch):
    monkeypatch.setattr(lshforest, "CHUNK_ROWS", 10 if region_rows == 8 else 50_000)
    rows = [*told_apart(corpus), *chains(prose)]
    got = lshforest.near_components(make_docs(rows, 5), percent=percent, region_rows=region_rows)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == Counter(near_by_hand(rows, percent)[0])


def test_one_per_component(make_docs, corpus, none_of):
    """One row of every component stays, whatever ids repeat or are missing; rows without words all stay."""
    rows = told_apart(corpus)
    docs = make_docs(rows)
    left = lshforest.one_per_component(docs)
    assert left.columns == docs.columns
    component = {}
    for (i, text, *_), root in zip(rows, near_by_hand(rows, 85)[1], strict=True):
        component.setdefault((i, text), root)
    kept = Counter(component[r["doc_id"], r["text"]] for r in left.collect() if shingles(r["text"]))
    assert set(kept.values()) == {1} and set(kept) == {component[i, text] for i, text, *_ in rows if shingles(text)}
    assert sum(not shingles(r["text"]) for r in left.collect()) == sum(not shingles(text) for _, text, *_ in rows)
    assert lshforest.near_components(none_of).count() == 0


def test_a_clean_text_under_the_id_of_a_copy_stays(make_docs, prose):
    text, other = " ".join(prose(100, 1)), " ".join(prose(100, 2))
    left = lshforest.one_per_component(make_docs([(1, text), (5, text + " more"), (5, other)]))
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, text), (5, other)]


def test_rare_pairs_hold_every_similar_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    met = {(j, i) for g in lshforest.rare_pairs(sets, 70) for i in g for j in g if j < i}
    for i in range(80):
        for j in range(i):
            if lshforest.linked(sets[i], sets[j], 70):
                assert (j, i) in met


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(50)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["b"]: r["a"] for r in co.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert co.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- passages and strings --------------------------------------------------------------


def passages_by_hand(rows, length):
    """One (doc_id, n_words, n_removed, kept) per row; a null id is larger than all others."""
    first = {}
    order = {id(r): (r[0] is None, r[0] or 0) for r in rows}
    for r in sorted(rows, key=lambda r: order[id(r)]):
        words = WORD.findall(r[1] or "")
        for k in range(len(words) - length + 1):
            first.setdefault(tuple(words[k : k + length]), order[id(r)])
    out = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        gone = set()
        for k in range(len(words) - length + 1):
            if first[tuple(words[k : k + length])] < order[id(r)]:
                gone.update(range(k, k + length))
        out.append((r[0], len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"shard_symbols": 300}, {"length": 9, "run": 4}, {"length": 5, "run": 1}])
def test_passages(make_docs, corpus, options):
    rows = told_apart(corpus)
    got = fmindex.without_repeats(make_docs(rows), **options)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == Counter(passages_by_hand(rows, options.get("length", 50)))


def test_passages_digest_and_empty(make_docs, corpus, none_of):
    got = fmindex.without_repeats(make_docs(corpus), digest=True)
    assert rows_of(got, "doc_id", "kept") == Counter((r[0], sha(r[3])) for r in passages_by_hand(corpus, 50))
    assert fmindex.without_repeats(none_of).count() == 0


def strings_by_hand(rows, length):
    seen = Counter()
    for _, text, *_ in rows:
        raw = (text or "").encode()
        seen.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    out = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        out.append((i, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(c for c, g in zip(raw, gone) if not g)))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"bucket_bytes": 2_000}, {"length": 30, "run": 12}])
def test_strings(make_docs, corpus, options):
    rows = told_apart(corpus)
    got = suffixes.without_repeats(make_docs(rows), **options)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == Counter(strings_by_hand(rows, options.get("length", 200)))


def test_a_text_that_occurs_once_is_kept(make_docs, prose, none_of):
    """The id of a text is also used by another one whose bytes repeat: only the repeated bytes go."""
    base, other, tail = (" ".join(prose(200, k)) for k in (1, 2, 3))
    rows = [(1, base), (1, other), (7, other + tail), (None, tail), (None, tail[:100])]
    got = suffixes.without_repeats(make_docs(rows))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == Counter(strings_by_hand(rows, 200))
    assert (1, 0) in rows_of(got, "doc_id", "n_removed")
    assert suffixes.without_repeats(none_of).count() == 0


def test_pieces_hold_every_passage_once():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, n).astype(np.uint64) for n in (0, 10, 300, 49, 50, 1000)]
    codes, first = tk.mix(np.concatenate(texts)), np.cumsum([0, *map(len, texts)])
    found = spans.pieces(spans.Symbols(codes, first), 50, 12)
    held = sorted(p for a, b in zip(found.start, found.stop) for p in range(a, b))
    assert held == [p for t, n in zip(first, map(len, texts)) for p in range(t, t + max(0, n - 49))]
    same = defaultdict(set)
    runs = {}
    for a, b, anchor, key in zip(found.start, found.stop, found.anchor, found.key):
        assert all(p <= anchor <= p + 38 for p in range(a, b))
        for p in range(a, b):
            same[codes[p : p + 50].tobytes()].add((int(key), int(anchor - p)))
        runs[int(key)] = codes[anchor : anchor + 12].tobytes()
    assert all(len(v) == 1 for v in same.values())


def test_index_answers_like_a_search():
    rng = np.random.default_rng(6)
    pieces = [rng.integers(0, 4, rng.integers(6, 30)).astype(np.uint64) for _ in range(40)]
    docs = rng.integers(0, 30, 40)
    index = fmindex.Index(np.concatenate(pieces), np.cumsum([0, *map(len, pieces)]), docs, 6)
    for back, which, least in index.smallest(6):
        for p, found in zip(which, least):
            place = len(pieces[p]) - back
            want = pieces[p][place : place + 6].tolist()
            assert found == min(d for q, d in zip(pieces, docs) for k in range(len(q) - 5) if q[k : k + 6].tolist() == want)


def test_multikey_sort_finds_repeats():
    rng = np.random.default_rng(7)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    starts = np.arange(4000 - 13)
    seen = Counter(data[k : k + 13].tobytes() for k in starts)
    want = np.array([seen[data[k : k + 13].tobytes()] > 1 for k in starts])
    assert (suffixes.repeated(data, starts, np.ones(len(starts), int), 13) == want).all()
