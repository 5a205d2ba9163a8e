"""URL filter: host and path rules, and boosted trees on lexical features for all other URLs.

Everything on the path is an expression or a join: the fitted trees become nested CASE expressions, so scoring is
one projection over the URLs. The trees are fitted by Spark's own boosting on a bounded sample of labelled URLs, with suffix
statistics from other parts of the sample than a URL's own; scoring uses those of the whole sample.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and is judged by the trees on
its features (null counts as the empty URL). Repeated rows are judged alike. Without any labelled URL, or with one
label only, there is nothing to learn: the score is the share of blocked labels, 0 without labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDS = 5
FEATURES = (
    "url_length",
    "host_length",
    "path_length",
    "labels",
    "depth",
    "digit_ratio",
    "mark_ratio",
    "hyphens",
    "entropy",
    "parameters",
    "suffix_block",
    "suffix_seen",
    "domain_block",
    "domain_seen",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    """A rule is a host and the beginning of a path; it fits the host and its subdomains."""
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    cases = [F.when(rule_fits(host, path, rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for rule, verdict in ordered]
    return F.coalesce(*cases, F.lit(None).cast("struct<rule: string, verdict: string>"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a short text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path and the features that need no statistics."""
    whole = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(whole, r"(?s)\?([^#]*)", 1)
    length = F.greatest(F.length(whole), F.lit(1))
    return (
        urls.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
        .withColumns({"suffix": F.element_at(F.split(host, r"\."), -1), "domain": F.substring_index(host, ".", -2)})
        .withColumns(
            {
                "url_length": F.length(whole).cast("double"),
                "host_length": F.length(host).cast("double"),
                "path_length": F.length(path).cast("double"),
                "labels": F.size(F.split(host, r"\.")).cast("double"),
                "depth": (F.size(F.filter(F.split(path, "/"), lambda x: x != ""))).cast("double"),
                "digit_ratio": count_of(whole, "[0-9]") / length,
                "mark_ratio": count_of(whole, "[^0-9A-Za-z]") / length,
                "hyphens": count_of(host, "-").cast("double"),
                "entropy": entropy(whole),
                "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            }
        )
    )


def shares(sample: DataFrame, key: str, prior: float = 2.0) -> DataFrame:
    """Smoothed share of blocked URLs and log count per suffix or domain of the labelled sample."""
    return sample.groupBy(key).agg(
        ((F.sum("label") + prior / 2) / (F.count(F.lit(1)) + prior)).alias(f"{key}_block"),
        F.log1p(F.count(F.lit(1)).cast("double")).alias(f"{key}_seen"),
    )


def with_shares(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """The suffix statistics joined on; unseen suffixes get the neutral values.

    The statistics have at most as many rows as the sample, a stated bound (20,000 short rows by default), so they
    are broadcast; three suffixes hold most URLs, and a shuffle by suffix would fill three tasks.
    """
    for key in ("suffix", "domain"):
        rows = rows.join(F.broadcast(shares(sample, key)), key, "left").fillna({f"{key}_block": 0.5, f"{key}_seen": 0.0})
    return rows


def with_shares_of_others(sample: DataFrame, folds: int = FOLDS, prior: float = 2.0) -> DataFrame:
    """The sample with the suffix statistics of the other parts of it, dealt out by a hash of the URL.

    The trees learn on these: a URL's own label, and those of its part, have no say in its features, so a domain
    with one labelled URL shows the neutral share, as an unseen one will.
    """
    rows = sample.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(folds)))
    for key in ("suffix", "domain"):
        own = rows.groupBy(key, "part").agg(F.sum("label").alias("own_label"), F.count(F.lit(1)).alias("own_n"))
        total = own.groupBy(key).agg(F.sum("own_label").alias("all_label"), F.sum("own_n").alias("all_n"))
        n = F.col("all_n") - F.col("own_n")
        block = (F.col("all_label") - F.col("own_label") + prior / 2) / (n + prior)
        rows = rows.join(F.broadcast(own), [key, "part"]).join(F.broadcast(total), key)
        rows = rows.withColumns({f"{key}_block": block, f"{key}_seen": F.log1p(n.cast("double"))}).drop("own_label", "own_n", "all_label", "all_n")
    return rows.drop("part")


def tree_expression(node, names: list[str]) -> Column:
    """One fitted regression tree as a nested CASE."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    test = F.col(names[split.featureIndex()]) <= F.lit(float(split.threshold()))
    return F.when(test, tree_expression(node.leftChild(), names)).otherwise(tree_expression(node.rightChild(), names))


def fitted(sample: DataFrame, trees: int, depth: int, seed: int) -> GBTClassificationModel:
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, minInstancesPerNode=5).fit(rows)


def score_expression(model: GBTClassificationModel) -> Column:
    """The model's probability of block as an expression over FEATURES."""
    parts = [
        tree_expression(tree._call_java("rootNode"), list(FEATURES)) * F.lit(float(weight))
        for tree, weight in zip(model.trees, model.treeWeights, strict=True)
    ]
    margin = reduce(lambda a, b: a + b, parts)
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def fitted_score(sample: DataFrame, trees: int, depth: int, seed: int) -> Column:
    """Probability of block as an expression over FEATURES, from boosted trees fitted on the labelled sample."""
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return F.lit(float(next(iter(counts), 0.0)))
    return score_expression(fitted(sample, trees, depth, seed))


def labelled_sample(labelled: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """At most ``max_rows`` labelled URLs in the order of a hash of the URL: the same on every run."""
    order = F.xxhash64(F.lit(seed), F.col("url"))
    return labelled.select("url", F.col("label").cast("double").alias("label")).distinct().orderBy(order, "url", "label").limit(max_rows)


def judge_urls(
    urls: DataFrame,
    rules: list[tuple[str, str]],
    labelled: DataFrame | None = None,
    max_labelled: int = 20_000,
    trees: int = 12,
    depth: int = 4,
    seed: int = 11,
) -> DataFrame:
    """``urls`` (page_id, url) with host, path, rule, verdict and score.

    ``labelled`` has url and label (1 for block, 0 for allow); by default the URLs that a rule decides are the
    labelled ones. ``max_labelled`` bounds the rows the trees are fitted on; statistics per suffix come from the
    same rows, so their tables have at most that many rows.
    """
    rows = lexical(urls.select("page_id", "url")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.where("found IS NOT NULL").select("url", (F.col("found.verdict") == "block").cast("double").alias("label"))
    sample = settled(lexical(labelled_sample(labelled, max_labelled, seed)))
    score = fitted_score(settled(with_shares_of_others(sample)), trees, depth, seed)
    judged = with_shares(rows, sample).withColumn("score", score)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
