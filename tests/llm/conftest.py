from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, spans string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs([(doc_id, text, source), ...]): a documents table with extra columns of clashing names."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "n", "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n invented words."""

    def words(n, seed):
        rng = random.Random(seed)
        return ["".join(rng.choice(["an", "er", "the", "on", "ß", "é", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]

    return words


@pytest.fixture(scope="session")
def corpus(prose):
    """Texts with copies, near copies, shared passages, empties, nulls, one-letter runs and a long one."""
    rng = random.Random(3)
    passage = prose(80, 900)
    rows = []
    for i in range(60):
        words = prose(rng.randrange(30, 160), i)
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(20) : 60 + rng.randrange(20)]
        rows.append((i, " ".join(words), f"s{i % 4}" if i % 7 else None))
    rows += [(100 + i, rows[5][1], "s0") for i in range(12)]
    for i in range(12):
        words = rows[8][1].split()
        words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((200 + i, "  ".join(words) + "\n", "s1"))
    rows += [(300, "", "s0"), (301, None, "s0"), (302, " \t\n", None), (303, "one", "s2"), (304, "ONE", "s2"), (305, "a b c", "s2")]
    rows += [(306, "x" * 5000, "s1"), (307, "x " * 400, "s1"), (308, " ".join(prose(20_000, 77)), "s3"), (309, rows[3][1][:-3], "s0")]
    rows += [rows[10], rows[10], (310, "ﬁ… wide space é́", "s0")]
    return rows


@pytest.fixture(scope="session")
def none_of(make_docs):
    return make_docs([], 1)


@pytest.fixture(scope="session")
def by_id():
    """by_id(df, column, ...): {doc_id: (values)}; rows that repeat an id must agree."""

    def read(df, *columns):
        out = {}
        for r in df.collect():
            value = tuple(r[c] for c in columns)
            assert out.setdefault(r["doc_id"], value) == value
        return out

    return read
