"""Sentiment by phrases against a plain scan of the tokens."""

from __future__ import annotations

import random

import pytest

from lookout.functions import phrases

LEXICON = "phrase string, polarity double, subjectivity double, intensity double"
ENTRIES = [
    ("good", 0.7, 0.6, None), ("not good at all", -0.9, 1.0, None), ("good morning", 0.1, 0.0, None), ("at all", 0.0, 0.1, None), ("bad", -0.7, 0.7, None),
    ("really bad", -0.8, 0.9, None), ("very", None, None, 1.3), ("a bit", None, None, 0.5), ("more than very", None, None, 2.0), ("Bad", -0.5, 0.5, None),
    ("nothing", None, None, None), ("", 1.0, 1.0, None), ("fine", 0.4, None, 9.0), ("much  better", 2.0, 3.0, None),
]
NEGATIONS = ("not", "far from")


def by_hand(tokens, reach, factor=-0.5):
    known = {}
    for phrase, p, s, x in ENTRIES:
        words = tuple(phrase.lower().split())
        if words and (p is not None or x is not None):
            known.setdefault(words, []).append((p, s, x))
    average = lambda v: sum(v) / len(v) if v else None
    known = {w: tuple(average([r[k] for r in rows if r[k] is not None]) for k in range(3)) for w, rows in known.items()}
    negations = {tuple(n.split()) for n in NEGATIONS}
    i, negated, group, found = 0, None, None, []
    while i < len(tokens):
        length = next((n for n in range(5, 0, -1) if tuple(tokens[i : i + n]) in known or tuple(tokens[i : i + n]) in negations), 0)
        words = tuple(tokens[i : i + length])
        if not length:
            i += 1
            continue
        if words in negations:
            negated = i + length - 1
        elif known[words][0] is None:
            begin, by = (group[0], group[1]) if group and group[2] == i else (i, 1.0)
            group = (begin, by * known[words][2], i + length)
        else:
            begin, by = group[:2] if group and group[2] == i else (i, 1.0)
            p, s = known[words][0] * by, (known[words][1] or 0.0) * by
            if negated is not None and begin - negated <= reach:
                p *= factor
            found.append((min(1, max(-1, p)), min(1, max(0, s))))
            negated, group = None, None
        i += length
    n = len(found)
    return n, sum(p for p, _ in found) / n if n else 0.0, sum(s for _, s in found) / n if n else 0.0


@pytest.mark.parametrize("reach", [1, 3])
def test_like_a_plain_scan(spark, reach):
    rng = random.Random(5)
    words = "good not at all morning bad really very a bit more than far from nothing fine much better x y".split()
    texts = [[rng.choice(words) for _ in range(rng.randrange(0, 40))] for _ in range(300)] + [[], ["good"] * 5_000, ["very"] * 20 + ["good"], ["not", "good", "at"], ["far", "from"]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, w array<string>").repartition(4)
    lexicon = spark.createDataFrame(ENTRIES, LEXICON)
    got = {r["id"]: tuple(r)[1:] for r in phrases.phrase_sentiment(df, ["id"], "w", lexicon, NEGATIONS, reach).collect()}
    assert got.pop(-1) == (None, None, None)
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(by_hand(text, reach)), text


def test_without_entries_and_too_many(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, [])], "id long, w array<string>")
    none = spark.createDataFrame([], LEXICON)
    assert [tuple(r) for r in phrases.phrase_sentiment(df, ["id"], "w", none).orderBy("id").collect()] == [(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)]
    some = spark.createDataFrame([("b", 0.5, 0.5, None)], LEXICON)
    assert phrases.phrase_sentiment(df, ["id"], "w", some, ["a"], 2).orderBy("id").first()["sentiment_polarity"] == -0.25
    assert phrases.phrase_sentiment(df.limit(0), ["id"], "w", some).count() == 0
    monkeypatch.setattr(phrases, "MOST_WORDS", 0)
    with pytest.raises(ValueError, match="more than"):
        phrases.phrase_sentiment(df, ["id"], "w", some)
