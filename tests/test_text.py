from __future__ import annotations

import pytest

from lookout.functions import text as tx
from lookout.operators.relational import chunk_spine

LEXICON = [("good", 0.7, 0.6), ("bad", -0.7, 0.6), ("calm", 0.3, 0.5)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, polarity double, subjectivity double")


@pytest.fixture(scope="module", params=[7, 5_000])
def untidy(spark, request):
    """The lexicon with a word in two entries, missing values and words that nobody says, short and long."""
    rows = [("good", 0.6, 0.5), ("good", 0.8, 0.7), *LEXICON[1:], ("day", None, 0.1), (None, 1.0, 1.0)]
    rows += [(f"unsaid{i}", 0.9, 0.9) for i in range(request.param - 6)]
    return spark.createDataFrame(rows, "word string, polarity double, subjectivity double")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        (1, "A good day. Good and calm!"),
        (2, ""),
        (3, "   "),
        (4, None),
        (5, "word"),
        (6, "no sentence mark here"),
        (7, "Not good, bad? ... Calm."),
    ]
    return spark.createDataFrame(rows, "id int, text string")


def features(df):
    return {r["id"]: r for r in df.collect()}


def test_language_features(texts, untidy):
    """The same whatever the size of the lexicon, with repeated words and missing values in it."""
    got = features(tx.language_features(texts, ["id"], "text", untidy))
    assert got[1]["word_count"] == 6
    assert got[1]["vocab_richness"] == pytest.approx(5 / 6)
    assert got[1]["sentence_complexity"] == 3
    assert got[1]["sentiment_polarity"] == pytest.approx((0.7 + 0.7 + 0.3) / 3)
    for i in (2, 3):
        assert tuple(got[i])[2:] == (0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(got[4])[1:] == (None,) * 6
    assert got[5]["sentence_complexity"] == 1 and got[5]["sentiment_subjectivity"] == 0
    assert got[6]["sentence_complexity"] == 4
    assert got[7]["sentiment_polarity"] == pytest.approx((0.7 - 0.7 + 0.3) / 3)


def test_negation(texts, untidy):
    got = features(tx.language_features(texts, ["id"], "text", untidy, ["not"]))
    assert got[7]["sentiment_polarity"] == pytest.approx((-0.7 - 0.7 + 0.3) / 3)
    assert got[1]["sentiment_polarity"] == pytest.approx(1.7 / 3)


def test_empty_lexicon(spark, texts):
    none = spark.createDataFrame([], "word string, polarity double, subjectivity double")
    got = features(tx.language_features(texts, ["id"], "text", none))
    assert got[1]["sentiment_polarity"] == 0


def test_chunk_language(spark, lexicon):
    """Start decides the chunk; the tail is dropped; silent chunks stay; only the stored text is cut."""
    lengths = spark.createDataFrame([("p", 17.0), ("q", 4.0)], "subject string, total double")
    said = [
        ("p", 0.0, 1, "good"),
        ("p", 4.99, 2, "bad day"),
        ("p", 10.0, 3, "calm " * 100),
        ("p", 10.5, 4, None),
        ("p", 16.0, 5, "lost"),
        ("q", 1.0, 1, "lost too"),
    ]
    utterances = spark.createDataFrame(said, "subject string, start_time double, turn int, value string")
    spine = chunk_spine(lengths, "total", 5)
    out = tx.chunk_language(spine, utterances, "subject", "start_time", "turn", "value", 5, lexicon)
    got = {(r["subject"], r["chunk_id"]): r for r in out.collect()}
    assert sorted(got) == [("p", 0), ("p", 1), ("p", 2)]
    assert got["p", 0]["transcription"] == "good bad day" and got["p", 0]["word_count"] == 3
    assert got["p", 1]["transcription"] == "" and got["p", 1]["word_count"] == 0
    assert got["p", 2]["word_count"] == 100 and len(got["p", 2]["transcription"]) == 200
