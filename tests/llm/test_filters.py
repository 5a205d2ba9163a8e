"""URL filter, decontamination, quality, mixing: against plain Python and on planted cases."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookout.llm import exact, mixing, quality, urls, wumanber
from lookout.llm import queries as registered

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- URLs ------------------------------------------------------------------------------

URLS = [
    "http://a.example.net/en/1?x=1", "https://EXAMPLE.net/en/", "https://b.net/en/", "http://net/", "http://b.net", "http://bnet/",
    "http://x.example.com/de/9#t", "http://x.example.com/den", "http://x.example.com/de", "http://c.org/fr/?q", "http://c.org/en/fr/", "org/fr/",
    "http://d.edu/a/b/c?p=1&q=2", "ftp://É.Example.NET/en/ü", "http://", "://", "", None, "a://b://net/", "http://u:p@net:80/x", "http://q.net?/en/", "HTTP://A.ORG/FR/",
]


def url_by_hand(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = host.translate(LOWER)
    fits = []
    for rule, verdict in registered.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "org") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, suffix string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, registered.RULES, trees=2).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate([*URLS, URLS[0]]):
        host, path, rule, verdict = url_by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
        assert 0 <= got[i]["score"] <= 1


def test_urls_learn_from_labels(spark):
    rng = random.Random(1)
    good = [f"https://site{rng.randrange(90)}.org/en/{rng.choice(['news', 'about', 'story'])}/{i}" for i in range(400)]
    bad = [f"http://x{rng.randrange(10**9)}-{rng.randrange(10**6)}.biz/{rng.randrange(10**9)}?a={i}&b={rng.random()}&c=1" for i in range(400)]
    labelled = spark.createDataFrame([(u, 0) for u in good[:300]] + [(u, 1) for u in bad[:300]], "url string, label int")
    pages = spark.createDataFrame(list(enumerate(good[300:] + bad[300:])), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, [], labelled, trees=5).collect()}
    assert sum((v == "block") == (i >= 100) for i, v in got.items()) >= 190
    again = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages.repartition(7), [], labelled.repartition(3), trees=5).collect()}
    assert got == again


def labelled_urls(spark, n=400):
    rng = random.Random(4)
    rows = [(f"http://{'x' if i % 2 else 'good'}{rng.randrange(60)}.{rng.choice(['org', 'biz'])}/{'?a=1&b=2' if i % 2 else 'page'}{i}", i % 2) for i in range(n)]
    return urls.lexical(spark.createDataFrame(rows, "url string, label int").select("url", F.col("label").cast("double").alias("label")))


def test_expression_equals_the_model(spark):
    """The nested CASE gives the probabilities that the fitted trees give themselves."""
    sample = urls.with_shares_of_others(labelled_urls(spark)).cache()
    model = urls.fitted(sample, 6, 4, 3)
    rows = urls.VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(sample.withColumn("score", urls.score_expression(model)))
    for r in model.transform(rows).select("score", "probability").collect():
        assert r["score"] == pytest.approx(r["probability"][1], abs=1e-12)
    sample.unpersist()


def test_shares_leave_out_a_urls_own_part(spark):
    """Statistics of a labelled URL come from the other parts; a domain seen once shows the neutral share."""
    sample = labelled_urls(spark).unionByName(urls.lexical(spark.createDataFrame([("http://only.once/x", 1.0)], "url string, label double")))
    rows = urls.with_shares_of_others(sample).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS))).collect()
    assert len(rows) == 401
    for r in rows:
        for key in ("suffix", "domain"):
            others = [o["label"] for o in rows if o[key] == r[key] and o["part"] != r["part"]]
            assert r[f"{key}_block"] == pytest.approx((sum(others) + 1) / (len(others) + 2)) and r[f"{key}_seen"] == pytest.approx(math.log1p(len(others)))
    assert [r["domain_block"] for r in rows if r["url"] == "http://only.once/x"] == [0.5]


def test_urls_of_unseen_domains(spark):
    """Domains that no label knows are judged by the other features."""
    rng = random.Random(9)
    made = lambda i, bad, known: f"http://{'k' if known else 'u'}{i}.{rng.choice(['com', 'net'])}/{'x-' * 8 + '?q=1&r=2&s=3' if bad else 'news'}/{i % 7}"
    labelled = spark.createDataFrame([(made(i, i % 2, True), i % 2) for i in range(400)], "url string, label int")
    pages = spark.createDataFrame([(i, made(i, i % 2, False)) for i in range(200)], "page_id long, url string")
    got = urls.judge_urls(pages, [], labelled, trees=5).collect()
    assert sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) >= 190


def test_urls_without_anything(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(none, registered.RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.edu/"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge_urls(one, registered.RULES).collect()} == {"allow"}


def test_url_plan_is_native(spark):
    plan = registered.QUERIES["op1_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# --- decontamination -------------------------------------------------------------------

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_by_hand(rows, items, window):
    windows = {}
    for name, text in items:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text, *_ in rows:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    names |= windows[tuple(words[k : k + size])]
        out[i] = (len(words), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 20])
@pytest.mark.parametrize("window", [13, 4])
def test_contamination(spark, make_docs, corpus, prose, by_id, block_words, window):
    items = [(i, " ".join(prose(30, 500 + i))) for i in range(12)]
    items += [(20, "Two words"), (21, "one"), (22, ""), (23, None), (24, items[0][1]), (25, "a, a; a! a a a a a a a a a a a a"), (26, "Ünï-cødé 42")]
    rows = list(corpus)
    for i, (_, text) in enumerate(items[:12]):
        words = (text or "").split()
        rows.append((500 + i, " ".join(prose(40, i)) + " " + ", ".join(words[i : i + 5 + 2 * i]).upper() + "! " + " ".join(prose(20 * i, i + 99)), "s"))
    rows += [(600, "two  WORDS, ones", "s"), (601, "a " * 50, "s"), (602, "ünï cødé 42 ÜNÏ", "s"), (603, " ".join(t or "" for _, t in items), "s")]
    benchmark = spark.createDataFrame([(i, t, "t") for i, t in items], "item_id long, text string, words string")
    got = by_id(wumanber.contamination(make_docs(rows), benchmark, window=window, block_words=block_words), "n_words", "n_hit", "items")
    assert got == contamination_by_hand(rows, items, window)


def test_contamination_of_nothing(spark, make_docs, none_of, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert wumanber.contamination(none_of, none).count() == 0
    assert wumanber.contamination(make_docs(corpus), none).where("n_hit > 0 OR size(items) > 0").count() == 0
    docs = make_docs([(1, "a b c d e f", "s"), (2, "x y z", "s"), (None, "a b c d e f", "s")])
    item = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    left = wumanber.without_benchmark(docs, item)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [2]


def test_clean_rows_with_missing_or_repeated_ids_stay(spark, make_docs):
    docs = make_docs([(None, "a b c d e f", "s"), (None, "x y z", "s"), (7, "a b c d e f", "s"), (7, "u v w", "s"), (8, None, "s")])
    item = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    left = wumanber.without_benchmark(docs, item)
    assert left.columns == docs.columns and sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == [("7", "u v w"), ("8", "None"), ("None", "x y z")]
    copies = make_docs([(None, "a b", "s"), (5, "a   b", "s"), (None, "x y z", "s"), (7, "q r", "s"), (6, "q   r", "s"), (7, "u v w", "s")])
    left = exact.without_copies(copies)
    assert left.columns == copies.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("5", "a   b"), ("6", "q   r"), ("7", "u v w"), ("None", "x y z")]


# --- quality ---------------------------------------------------------------------------


def labelled_corpus(prose, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(rng.randrange(20, 80), i), i % 4 == 0
        if bad:
            words = [w + rng.choice(["%%%", "$$$", "###"]) for w in words] if i % 8 else [words[0]] * 40
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality(spark, make_docs, prose):
    rows, labels = labelled_corpus(prose)
    extra = [(9000, "", "s"), (9001, None, "s"), (9002, " ".join(prose(30_000, 5)), "s"), (None, "a b", "s"), (9000, "", "s")]
    docs, table = make_docs(rows + extra), spark.createDataFrame([*labels, (1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, score int")
    got = quality.quality_scores(docs, table, epochs=20).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"]]
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    known = [r for r in held if r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known]) > 0.93
    # Labels of the held-out rows have no say.
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in labels]
    other = quality.quality_scores(make_docs(rows), spark.createDataFrame(turned, "doc_id long, quality int, t int"), epochs=20)
    same = quality.quality_scores(make_docs(rows, 5), spark.createDataFrame(labels, "doc_id long, quality int, t int").repartition(4), epochs=20)
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in df.collect()} for df in (other, same))
    assert a == b
    kept = quality.accepted(docs, table, epochs=20)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in got if r["predicted"])


def test_quality_without_labels(spark, make_docs, none_of):
    docs = make_docs([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.quality_scores(docs, one).collect()} == {1}
    assert quality.quality_scores(none_of, one).count() == 0


def test_sample_passes_over_long_texts(spark, make_docs, prose):
    rows, labels = labelled_corpus(prose, 120)
    long = [(1000 + i, "long " * 3000, "s") for i in range(12)]
    docs = make_docs(rows + long)
    table = spark.createDataFrame([(i, q) for i, q, _ in labels] + [(i, 1) for i, *_ in long] + [(5000 + i, 0) for i in range(300)], "doc_id long, label int")
    learned = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    got = quality.labelled_texts(docs, table, 500, 14_000).to_pydict()  # no long text fits, and labels without a document take no place
    sizes = sorted(len(rows[i][1]) for i in learned)
    assert set(got["label"]) == {0, 1} and sum(map(len, got["text"])) <= 14_000
    assert 14_000 - sum(map(len, got["text"])) < max(sizes) or len(got["text"]) == len(learned)
    few = quality.labelled_texts(docs, table, 2, 10**6).to_pydict()
    assert sorted(few["label"]) == [0, 1]
    # All texts of one label are above the bound: the shortest stands for it.
    only = spark.createDataFrame([(i, 0) for i, *_ in long] + [(i, 1) for i in range(1, 60)], "doc_id long, label int")
    assert sorted(set(quality.labelled_texts(docs, only, 500, 14_000).to_pydict()["label"])) == [0, 1]


def test_temperature_softens_overconfidence():
    rng = np.random.default_rng(0)
    p = rng.random(4000)
    y = (rng.random(4000) < p).astype(float)
    margin = np.log(p / (1 - p))
    assert quality.temperature(3 * margin, y) == pytest.approx(3, rel=0.15)


# --- mixing ----------------------------------------------------------------------------


def mix_by_hand(rows, copies):
    size = {}
    for i, text, source, *_ in rows:
        size.setdefault(source, []).append((len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), i))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, _ in size[s]) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] > copies * total[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = float(copies * total[s])
        free -= above
        left = sum(total.values()) - sum(target.values())
    return total, target


@pytest.mark.parametrize("slice_rows", [5_000, 2])
def test_mix(make_docs, corpus, slice_rows):
    rows = corpus + [(700 + i, f"tiny {i}", "t") for i in range(4)] + [(800, "", "empty"), (801, None, "empty")]
    got = mixing.mix_sources(make_docs(rows), slice_rows=slice_rows).collect()
    again = mixing.mix_sources(make_docs(rows, 6), slice_rows=7).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)
    total, target = mix_by_hand(rows, 3)
    assert len(got) == len(rows)
    taken = dict.fromkeys(total, 0)
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in total:
        assert abs(taken[s] - target[s]) <= 1
    # Whole epochs first, then the documents of the smallest keys, the last one in part.
    for s in total:
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: (r["key"], r["doc_id"]))
        if total[s]:
            epochs = math.floor(target[s] / total[s])
            rest = [r["taken"] - epochs * r["size"] for r in mine if r["size"]]
            full = [0 if x == 0 else 1 if x == r["size"] else 0.5 for x, r in zip(rest, (r for r in mine if r["size"]))]
            assert full == sorted(full, reverse=True) and full.count(0.5) <= 1


def test_mix_prefers_quality(make_docs):
    rows = [(i, "word " * 10 if i % 2 else "w0rd! " * 10, "a") for i in range(400)] + [(1000 + i, "word " * 10, "b") for i in range(400)]
    got = mixing.mix_sources(make_docs(rows), weights=(1.0, 7.0), copies=3).collect()
    plain = sum(r["taken"] for r in got if r["source"] == "a" and r["doc_id"] % 2)
    marked = sum(r["taken"] for r in got if r["source"] == "a" and not r["doc_id"] % 2)
    assert plain > 1.2 * marked > 0


def test_mix_of_nothing(make_docs, none_of):
    assert mixing.mix_sources(none_of).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(make_docs([(1, None, None), (2, "", None)])).collect()] == [0, 0]
    same = mixing.mix_sources(make_docs([(1, "a b c", "s"), (1, "a b c", "s"), (None, "a", "s")])).collect()
    assert sum(r["taken"] for r in same) == 7


def test_word_counts_match_the_pattern(spark):
    texts = ["a b", " a\tb\x0bc\x0c", "", None, "x y", "é ß\r\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.n_words(F.col("text"))).collect()
    assert [r[0] for r in rows] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize("weight", [0.01, 1.0, 50.0, None])
def test_a_hot_source_is_spread(spark, weight, monkeypatch):
    """Whatever the weights make of the keys, and without ids, no slice of a source holds more than three times the mean."""
    docs = spark.range(6000).select(F.when(F.lit(weight is None), None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("hot").alias("source"))
    slices = []
    done = mixing.OrderedScan.running

    def running(scan, *args, **options):
        assert scan.split
        slices.extend(r["count"] for r in scan.df.groupBy("__slice").count().collect())
        return done(scan, *args, **options)

    monkeypatch.setattr(mixing.OrderedScan, "running", running)
    got = mixing.mix_sources(docs, weights=(1.0,), share=0.5, quality=F.lit(weight or 1.0), slice_rows=600)
    taken = got.agg(F.sum("taken")).first()[0]
    assert taken == 6000 and len(slices) >= 10 and max(slices) <= 3 * 6000 / len(slices)
    assert got.select("key").distinct().count() == 6000
