"""Sentiment by a lexicon of words and phrases, with modifiers and negations, in one scan of the tokens.

All entries form one trie over tokens. At every place of a batch the trie is walked at once, a level per array operation, and the
longest entry that starts there is kept; from left to right a text takes the longest entry at a place and goes on behind it. An entry
counts with its polarity and subjectivity. Modifiers directly before it multiply both by their intensity; a negation within
``reach`` words before the entry and its modifiers multiplies the polarity by ``factor``. Polarity stays in -1 .. 1, subjectivity in
0 .. 1. The trie is sent to the tasks, so a lexicon of more than ``MOST_WORDS`` words is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_WORDS = 2_000_000
NEGATION = 0.0  # an intensity that no modifier has
FOUND = T.StructType(
    [T.StructField("matched", T.LongType()), T.StructField("sentiment_polarity", T.DoubleType()), T.StructField("sentiment_subjectivity", T.DoubleType())]
)


class Trie(NamedTuple):
    """Nodes are numbered from 0, the root; ``steps`` are sorted keys node * words + word, ``to`` the nodes they lead to."""

    words: pa.Array
    steps: np.ndarray
    to: np.ndarray
    depth: int
    polarity: np.ndarray  # per node; NaN: no entry ends here
    subjectivity: np.ndarray
    intensity: np.ndarray  # per node; NaN: no modifier ends here


def trie_of(entries: Sequence[tuple[tuple[str, ...], float, float, float]]) -> Trie:
    """``entries`` are (words, polarity, subjectivity, intensity), distinct by words."""
    names = sorted({word for words, *_ in entries for word in words})
    number = {word: i for i, word in enumerate(names)}
    known: dict[tuple[int, int], int] = {}
    values = [(np.nan, np.nan, np.nan)]
    for words, *said in entries:
        node = 0
        for word in words:
            step = (node, number[word])
            if step not in known:
                known[step] = len(values)
                values.append((np.nan, np.nan, np.nan))
            node = known[step]
        values[node] = tuple(said)
    keys = np.array([node * len(names) + word for node, word in known], np.int64)
    order = np.argsort(keys)
    polarity, subjectivity, intensity = np.array(values, float).T
    return Trie(pa.array(names, pa.string()), keys[order], np.array(list(known.values()), np.int64)[order], max((len(w) for w, *_ in entries), default=0), polarity, subjectivity, intensity)


def longest(trie: Trie, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the words (-1: not in the lexicon) the node of the longest entry that starts there, and its length (0:
    none). ``ends`` is the end of the text a place belongs to."""
    n = len(words)
    best, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, node = np.flatnonzero(words >= 0), np.zeros(int((words >= 0).sum()), np.int64)
    for level in range(trie.depth):
        there = at + level < ends[at]
        at, node = at[there], node[there]
        word = words[at + level]
        key = node * len(trie.words) + word
        place = np.minimum(np.searchsorted(trie.steps, key), len(trie.steps) - 1)
        going = (word >= 0) & (trie.steps[place] == key)
        at, node = at[going], trie.to[place[going]]
        if not len(at):
            break
        said = ~(np.isnan(trie.polarity[node]) & np.isnan(trie.intensity[node]))
        best[at[said]], length[at[said]] = node[said], level + 1
    return best, length


def scored(trie: Trie, best: list[int], length: list[int], start: int, places: list[int], reach: int, factor: float) -> tuple[int, float, float]:
    """Matches and sums of polarity and subjectivity of a text whose entries start at ``places`` (from ``start`` on)."""
    matched, polarity, subjectivity = 0, 0.0, 0.0
    upto, negated, scale, group, joined = start, None, 1.0, start, -1
    for i in places:
        if i < upto:
            continue
        node = best[i]
        upto = i + length[i]
        p, strength = trie.polarity[node], trie.intensity[node]
        if p != p:  # no entry: a negation or a modifier
            if strength == NEGATION:
                negated = upto - 1
            else:
                group, scale = (group, scale * strength) if joined == i else (i, strength)
                joined = upto
            continue
        begins, by = (group, scale) if joined == i else (i, 1.0)
        p *= by
        if negated is not None and begins - negated <= reach:
            p *= factor
        matched += 1
        polarity += min(1.0, max(-1.0, p))
        subjectivity += min(1.0, max(0.0, trie.subjectivity[node] * by))
        negated, joined = None, -1
    return matched, polarity, subjectivity


def entries_of(lexicon: DataFrame, negations: Sequence[str]) -> list[tuple[tuple[str, ...], float, float, float]]:
    """The lexicon's entries: repeated phrases are averaged, rows without a phrase or without any value are dropped; a phrase that
    is a negation is nothing else, one with a polarity is no modifier."""
    rows = lexicon.select(F.array_join(F.array_remove(F.split(F.lower(F.trim("phrase")), r"\s+"), ""), " ").alias("phrase"), "polarity", "subjectivity", "intensity")
    rows = rows.where("phrase <> '' AND (polarity IS NOT NULL OR intensity IS NOT NULL)")
    size = rows.agg(F.sum(F.size(F.split("phrase", " ")))).first()[0] or 0
    if size > MOST_WORDS:
        raise ValueError(f"the lexicon has {size} words, more than the {MOST_WORDS} that are sent to a task")
    averages = [F.avg(c).alias(c) for c in ("polarity", "subjectivity", "intensity")]
    turned = {" ".join(n.lower().split()) for n in negations}
    out = [(tuple(n.split()), np.nan, np.nan, NEGATION) for n in sorted(turned) if n]
    for r in rows.groupBy("phrase").agg(*averages).collect():
        if r["phrase"] not in turned:
            values = [np.nan if r[c] is None else r[c] for c in ("polarity", "subjectivity", "intensity")]
            if values[0] == values[0]:
                values[1:] = [0.0 if r["subjectivity"] is None else r["subjectivity"], np.nan]
            out.append((tuple(r["phrase"].split(" ")), *values))
    return out


def phrase_sentiment(
    texts: DataFrame, ids: Sequence[str], tokens: str, lexicon: DataFrame, negations: Sequence[str] = (), reach: int = 1, factor: float = -0.5
) -> DataFrame:
    """Per text the number of entries found, and their mean polarity and subjectivity; 0, 0.0 and 0.0 without any, NULL without tokens.

    ``lexicon`` has phrase, polarity, subjectivity and intensity (a modifier has only the last). Texts keep their order and are not
    moved.
    """
    trie = trie_of(entries_of(lexicon, negations))

    @F.pandas_udf(FOUND)
    def find(column: pd.Series) -> pd.DataFrame:
        told = pa.array(column, pa.list_(pa.string()))
        offsets, flat = np.asarray(told.offsets).astype(np.int64), told.values
        number = pc.fill_null(pc.index_in(flat, value_set=trie.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        best, length = longest(trie, number[: len(ends)], ends) if len(trie.steps) else (np.zeros(len(ends), np.int64),) * 2
        places = np.flatnonzero(length)
        cut = np.searchsorted(places, offsets)
        best, length, places = best.tolist(), length.tolist(), places.tolist()
        rows = []
        for i, missing in enumerate(column.isna()):
            if missing:
                rows.append((None, None, None))
                continue
            n, p, s = scored(trie, best, length, int(offsets[i]), places[cut[i] : cut[i + 1]], reach, factor)
            rows.append((n, p / n if n else 0.0, s / n if n else 0.0))
        return pd.DataFrame(rows, columns=FOUND.names).astype({"matched": "Int64"})

    return texts.select(*ids, find(F.col(tokens)).alias("__found")).select(*ids, "__found.*")
