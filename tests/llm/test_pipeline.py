"""Every stage of the pipeline against a brute-force version on a small corpus with hard rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from test_duplicates import near_by_hand, shingles, told_apart
from test_filters import contamination_by_hand, mix_by_hand

import corpus_pipeline
from lookout.llm import exact, lshforest, mixing, quality, wumanber

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose):
    """Labels and benchmark items for the made documents."""
    out = str(tmp_path_factory.mktemp("made"))
    spark.createDataFrame([(0, " ".join(prose(20, 71))), (1, "three little words"), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def kept_rows(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_exact_stage(spark, make_docs, corpus, folder):
    rows = told_apart(corpus)
    left = kept_rows(STAGE["exact dedup"](spark, make_docs(rows), folder))
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is not None, i or 0))
    found = Counter(re.sub(r"[\x20\x09-\x0D]", "", text or "") for _, text in left.elements())
    assert found == Counter(dict.fromkeys(groups, 1))
    for i, text in left:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        assert min(groups[norm]) == (-len(text or ""), i is not None, i or 0)


def test_near_stage(spark, make_docs, corpus, folder):
    rows = told_apart(corpus)
    left = kept_rows(STAGE["minhash near-dedup"](spark, make_docs(rows), folder))
    component = {(i, text): root for (i, text, *_), root in zip(rows, near_by_hand(rows, 80)[1], strict=True)}
    with_words = Counter(component[key] for key in left.elements() if shingles(key[1]))
    assert with_words == Counter(dict.fromkeys({component[i, t] for i, t, *_ in rows if shingles(t)}, 1))
    assert sum(n for key, n in left.items() if not shingles(key[1])) == sum(not shingles(t) for _, t, *_ in rows)


def test_benchmark_stage(spark, make_docs, corpus, prose, folder):
    item = " ".join(prose(20, 71))
    rows = told_apart(corpus) + [(600, item, "s"), (601, " ".join(prose(60, 72)) + " " + item, "s"), (602, " ".join(prose(900, 73)) + " " + item, "s"), (None, "three LITTLE words!", "s"), (600, "clean under the same id", "s")]
    left = kept_rows(STAGE["benchmark decontamination"](spark, make_docs(rows), folder))
    items = [(0, item), (1, "three little words"), (2, None)]
    want = Counter()
    for n, (i, text, *_) in enumerate(rows):  # one row at a time, under an id of its own
        (n_words, n_hit, *_), = contamination_by_hand([(n, text)], items, 13).values()
        if not (n_hit > 0 and 20 * n_hit >= n_words):
            want[i, text] += 1
    assert left == want and (602, rows[-3][1]) in left and (600, item) not in left


def test_mixture_stage(spark, make_docs, corpus, folder):
    mixed = STAGE["mixing sources"](spark, make_docs(corpus), folder).collect()
    total, target = mix_by_hand(corpus, 3)
    taken = Counter()
    for r in mixed:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]], abs=1e-3)
        taken[r["source"]] += r["taken"]
    assert len(mixed) == len(corpus) and all(abs(taken[s] - target[s]) <= 1 for s in total)


def test_quality_stage(spark, tmp_path, prose):
    """Made prose stays and heaps of digits and marks go, labelled or not, whatever ids repeat or are missing."""
    rng = random.Random(2)
    good = [" ".join(prose(rng.randrange(40, 90), k)) for k in range(160)]
    bad = [" ".join("".join(rng.choice("0123456789#$%&*{}<>|") for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(40, 90))) for _ in range(160)]
    rows = [(k, text, "en", "s", len(text)) for k, text in enumerate(good + bad)] + [(None, good[0] + " x", "en", "s", 1), (None, bad[0], "en", "s", 1), (3, bad[1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = [(k, int(k < 160), 0) for k in range(320) if k % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = kept_rows(STAGE["quality classifier"](spark, docs, str(tmp_path)))
    wanted = {(i, text) for i, text, *_ in rows if text in set(good) or text == good[0] + " x"}
    assert len(set(left) - wanted) <= 5 and len(wanted - set(left)) <= 5


def test_the_pipeline_uses_its_operators():
    """No stage swallows errors or brings a method of its own."""
    assert {corpus_pipeline.quality, corpus_pipeline.exact, corpus_pipeline.lshforest, corpus_pipeline.wumanber, corpus_pipeline.mixing} == {quality, exact, lshforest, wumanber, mixing}
