"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated scores.

Random indexing gives every feature a sparse index vector of +1 and -1 whose places come from a hash, so there is no
dictionary of features. A word has two vectors of that kind:

- its *form*: the mean of the index vectors of the byte triples of the word, known for any word;
- its *contexts*: the sum of the index vectors of its neighbours over the labelled sample, of unit length, for the
  words of the vocabulary; zero for others.

A document is the mean over all its words, plus what the pooling itself shows: the share of words in the vocabulary, of
distinct words, of words equal to the one before, and the logarithm of the number of words. A network with one hidden layer,
written in numpy and trained with Adam, scores it; a temperature fitted on labelled rows that the network has
not seen makes the score a probability.

Bounds: the labelled rows fitted on are at most ``max_labelled`` rows and ``max_chars`` characters, taken in the
order of a hash of the id among the labels that have a document; each label is given a 20th of the rows first, and a text
that does not fit is passed over. A label whose texts are all too long for that is learned from its shortest one, beyond the bound.
The vocabulary is the ``max_vocabulary`` most frequent words of that sample. The model is
about 15 MB and is sent to every task. Scoring reads every text whole.

Defined cases: an empty or null text is the zero vector and gets the network's score for it. Labels that are null or
contradict each other are not learned from. Without labels every score is 0.5; with one label only, that label's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm import tokens as tk
from lookout.llm.common import fields, in_arrow, input_columns, settled

DIMENSIONS, PLACES, REACH = 64, 4, 2
STEP = 1 << 19
LEAST_STEPS = 1_000  #: of the network's training, however small the sample
FEW = 20.0  #: distinct words at which a document's mean counts half
MAX_LABELLED, MAX_CHARS, MAX_VOCABULARY = 4_000, 10_000_000, 40_000
FEWEST = 20  #: each label has this part of the rows, if it has as many


class Model(NamedTuple):
    known: np.ndarray  # sorted hashes of the vocabulary
    contexts: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def index_places(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and signs of the index vectors of hashed features."""
    x = tk.mix(codes + np.uint64(0x632BE59BD9B4E019))
    for _ in range(PLACES):
        yield (x & np.uint64(DIMENSIONS - 1)).astype(np.int64), ((x >> np.uint64(6)) & np.uint64(1)).astype(np.float64) * 2 - 1
        x = x >> np.uint64(7)


def summed(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """For each row the sum of the index vectors of its features."""
    out = np.zeros(n * DIMENSIONS)
    for at in range(0, len(codes), STEP):
        base = rows[at : at + STEP] * DIMENSIONS
        for place, sign in index_places(codes[at : at + STEP]):
            out += np.bincount(base + place, weights=sign, minlength=n * DIMENSIONS)
    return out.reshape(n, DIMENSIONS)


def forms(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The form vectors of words given by their byte spans."""
    length = end - begin
    owner = np.repeat(np.arange(len(begin)), length)
    at = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
    middle = data[at].astype(np.uint64)
    left, right = np.zeros_like(middle), np.zeros_like(middle)
    left[1:], right[:-1] = middle[:-1], middle[1:]
    edge = np.cumsum(length)
    left[edge[:-1]] = 0
    right[edge - 1] = 0
    return summed(owner, left << np.uint64(16) | middle << np.uint64(8) | right, len(begin)) / length[:, None]


def pooled(block: tk.Texts, known: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """One row per text: mean contexts, mean form, shares of known, distinct and repeated words, log length."""
    words = tk.words(block, tk.PLAIN)
    out = np.zeros((len(block), 2 * DIMENSIONS + 4), np.float32)
    if not len(words.hashes):
        return out
    distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    vectors = np.zeros((len(distinct), 2 * DIMENSIONS + 1), np.float32)
    vectors[:, DIMENSIONS:-1] = forms(block.data, words.begin[first], words.end[first])
    if len(known):
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        hit = known[at] == distinct
        vectors[hit, :DIMENSIONS] = contexts[at[hit]]
        vectors[hit, -1] = 1
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b > a:
            mine = which[a:b]
            out[i, :-3] = vectors[mine].mean(axis=0, dtype=np.float64)
            out[i, -3:] = len(np.unique(mine)) / (b - a), (mine[1:] == mine[:-1]).sum() / (b - a), np.log1p(b - a)
    return out


def vocabulary(sample: list[tk.Texts], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent words of the sample and their context vectors."""
    parts = [tk.words(block, tk.PLAIN) for block in sample]
    hashes = np.concatenate([p.hashes for p in parts]) if parts else np.zeros(0, np.uint64)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros((0, DIMENSIONS), np.float32)
    distinct, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    keep = np.sort(np.lexsort((distinct, -counts))[:most])
    place = np.full(len(distinct), -1)
    place[keep] = np.arange(len(keep))
    word = place[which]
    owner = np.concatenate([tk.owners(p.first) + at for p, at in zip(parts, np.cumsum([0, *(len(p.first) for p in parts[:-1])]), strict=True)])
    total = np.zeros((len(keep), DIMENSIONS))
    for step in (s for s in range(-REACH, REACH + 1) if s):
        a = np.arange(max(0, -step), len(word) - max(0, step))
        a = a[(word[a] >= 0) & (owner[a] == owner[a + step])]
        total += summed(word[a], hashes[a + step], len(keep))
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return distinct[keep], (total / np.maximum(norm, 1e-9)).astype(np.float32)


def scaled(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in units of their spread. The mean over a few distinct words is far out at random, so the vectors'
    places are drawn to the center by the number of distinct words, and cut at 3."""
    z = (x - center) / scale
    distinct = x[:, -3] * np.expm1(x[:, -1])
    z[:, : 2 * DIMENSIONS] = np.clip(z[:, : 2 * DIMENSIONS] * (distinct / (distinct + FEW))[:, None], -3, 3)
    return z


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    hidden = np.maximum(scaled(x, model.center, model.scale) @ model.w1 + model.b1, 0)
    return hidden @ model.w2 + model.b2


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins(model, x) / model.temperature, -40, 40)))


def trained(x: np.ndarray, y: np.ndarray, known: np.ndarray, contexts: np.ndarray, hidden: int, epochs: int, seed: int) -> Model:
    """The network, fitted on four fifths of the rows, and its temperature, fitted on the rest."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[~aside])) < 2:
        aside[:] = False
    xt, yt = x[~aside], y[~aside]
    center, scale = xt.mean(axis=0), xt.std(axis=0) + 1e-3
    z = scaled(xt, center, scale)
    width = x.shape[1]
    weights = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    step, size = 0, 128
    for _ in range(max(epochs, -(-LEAST_STEPS // -(-len(yt) // size)))):
        order = rng.permutation(len(yt))
        for at in range(0, len(yt), size):
            rows = order[at : at + size]
            step += 1
            w1, b1, w2, b2 = weights
            h = np.maximum(z[rows] @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40)))
            g = (p - yt[rows]) / len(rows)
            back = np.outer(g, w2) * (h > 0)
            slopes = [z[rows].T @ back + 1e-3 * w1, back.sum(axis=0), h.T @ g + 1e-3 * w2, np.array([g.sum()])]
            for w, m, v, s in zip(weights, first, second, slopes, strict=True):
                m += 0.1 * (s - m)
                v += 0.001 * (s * s - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = weights
    model = Model(known, contexts, center, scale, w1, b1, w2, float(b2[0]), 1.0)
    return model._replace(temperature=temperature(margins(model, x[aside]), y[aside])) if aside.any() else model


def temperature(margin: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the margins under which unseen labels are likeliest."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, np.where(y > 0.5, -margin, margin) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def chosen_rows(rows: list[tuple], max_labelled: int, max_chars: int) -> list[tuple]:
    """The sample of (label, chars, ...) rows: first a few of each label, then any, in the order given. A text that does not
    fit any more is left out, and those after it are still looked at."""
    taken, n, chars = set(), Counter(), Counter()
    few = max(1, max_labelled // FEWEST)
    for at, (label, size, *_) in enumerate(rows):
        if n[label] < few and chars[label] + size <= max_chars // 4:
            taken.add(at)
            n[label] += 1
            chars[label] += size
    total = chars.total()
    for at, (_, size, *_) in enumerate(rows):
        if at not in taken and len(taken) < max_labelled and total + size <= max_chars:
            taken.add(at)
            total += size
    return [rows[at] for at in sorted(taken)]


def labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int, max_chars: int) -> pa.Table:
    """Text and label of the bounded sample, in the order of a hash of the id. It is chosen by lengths, of labels that have
    a document; then the chosen texts are read."""
    known = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = ["doc_id", "chars", "digest"]
    sizes = texts.select("doc_id", F.length("text").cast("long").alias("chars"), F.xxhash64("text").alias("digest"))
    rows = settled(sizes.join(known, "doc_id").groupBy(*key).agg(F.min("label").alias("label")).withColumn("place", F.xxhash64("doc_id")))
    fitting, part = F.col("chars") <= max_chars, F.shiftright("place", 48)
    ends, found = {}, Counter()
    for r in sorted(rows.where(fitting).groupBy("label", part.alias("part")).count().collect(), key=lambda r: r["part"]):
        if found[r["label"]] < max_labelled:
            found[r["label"]] += r["count"]
            ends[r["label"]] = r["part"]
    order = ["place", "doc_id", "chars", "digest"]
    columns = ["label", "chars", *(c for c in order if c != "chars")]
    first = F.lit(False)
    for label, end in ends.items():
        first |= (F.col("label") == label) & (part <= end)
    candidates = sorted((tuple(r) for r in rows.where(fitting & first).select(columns).collect()), key=lambda r: (*r[2:4], r[1], r[4]))
    chosen = chosen_rows(candidates, max_labelled, max_chars)
    for label in {0, 1} - {r[0] for r in chosen}:  # whose texts are all long: its shortest, whatever its length
        chosen += [tuple(r) for r in rows.where(F.col("label") == label).orderBy("chars", *order).limit(1).select(columns).collect()]
    kept = docs.sparkSession.createDataFrame(chosen, rows.select(columns).schema)
    short = texts.join(F.broadcast(kept.select("doc_id").distinct()), "doc_id", "left_semi").select("*", F.length("text").cast("long").alias("chars"), F.xxhash64("text").alias("digest"))
    return short.join(F.broadcast(kept), key).dropDuplicates(key).orderBy(*order).select("text", "label").toArrow()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS, max_vocabulary: int = MAX_VOCABULARY, hidden: int = 32, epochs: int = 30, seed: int = 5) -> Model | float:
    """The model, or one score for all texts where there is nothing to tell apart."""
    rows = labelled_texts(docs, labels, max_labelled, max_chars)
    y = rows.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    batch = rows.select(["text"]).combine_chunks().to_batches()[0]
    sample = [block for _, block in tk.blocks(batch, "text")]
    known, contexts = vocabulary(sample, max_vocabulary)
    x = np.concatenate([pooled(block, known, contexts) for block in sample]).astype(float)
    return trained(x, y, known, contexts, hidden, epochs, seed)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 from ``threshold`` on)."""
    rows = input_columns(docs, doc_id=doc_id, text=text)
    model = fit(rows, input_columns(labels, doc_id=doc_id, label=label), **fitting)
    if isinstance(model, float):
        scored = rows.select("doc_id", F.lit(model).alias("score"))
    else:
        scored = in_arrow(rows, scorer(docs.sparkSession.sparkContext.broadcast(model), fields("doc_id long, score double")), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scorer(sent, columns: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for batch, block in tk.blocks(whole, "text"):
                score = probabilities(model, pooled(block, model.known, model.contexts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], schema=columns)

    return work


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, **fitting) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with all their columns: a filter in the scan, no join."""
    model = fit(input_columns(docs, doc_id=doc_id, text=text), input_columns(labels, doc_id=doc_id, label=label), **fitting)
    if isinstance(model, float):
        return docs.where(F.lit(model >= threshold))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for batch, block in tk.blocks(whole, text):
                yield batch.filter(pa.array(probabilities(model, pooled(block, model.known, model.contexts)) >= threshold))

    return docs.mapInArrow(work, docs.schema)
