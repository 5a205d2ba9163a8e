"""Text measures on columns: words, richness, sentences, lexicon sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.operators.relational import interval_join
from lookout.session import settled

WORD = r"[\p{L}\p{N}]+"
WORD_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE_BREAK = r"[.!?]+\s*"
KEEP_TEXT = 200
NEGATED = "!"  # no word has it


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s) != "")


def word_count(text: Column) -> Column:
    """The size of ``words``, without building them."""
    return F.regexp_count(text, F.lit(WORD))


def vocab_richness(tokens: Column) -> Column:
    """Distinct words / words; 0 without words."""
    return F.coalesce(F.try_divide(F.size(F.array_distinct(tokens)), F.size(tokens)), F.lit(0.0))


def sentence_complexity(tokens: Column, text: Column) -> Column:
    return F.size(tokens) / F.greatest(F.size(sentences(text)), F.lit(1))


def truncate(text: Column, length: int = KEEP_TEXT) -> Column:
    return F.substring(text, 1, length)


def _marked(tokens: Column, negations: Sequence[str]) -> Column:
    """Words, with a mark in front of those that follow a negation."""
    if not negations:
        return tokens
    return F.transform(
        tokens, lambda w, i: F.when(F.get(tokens, i - 1).isin(*negations), F.concat(F.lit(NEGATED), w)).otherwise(w)
    )


def one_entry_per_word(lexicon: DataFrame) -> DataFrame:
    """The lexicon with one row per word: repeated entries are averaged, entries without a word or a value dropped."""
    return (
        lexicon.na.drop(subset=["word", "polarity", "subjectivity"])
        .groupBy("word")
        .agg(F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity"))
    )


def lexicon_sentiment(
    texts: DataFrame, ids: Sequence[str], tokens: str, lexicon: DataFrame, negations: Sequence[str] = ()
) -> DataFrame:
    """Mean polarity and subjectivity over the words found in the lexicon; texts without one are absent.

    ``lexicon`` has word, polarity, subjectivity. A word after one of ``negations`` counts with reversed polarity.
    The way is the same for a lexicon of any size: words meet their entry in a join, which Spark does in place while the
    lexicon is small, and sums per text are combined before they are moved.
    """
    ids, word = list(ids), F.col("w")
    said = texts.select(*ids, F.explode(_marked(F.col(tokens), negations)).alias("w"))
    if negations:
        said = said.withColumns({"sign": F.when(F.startswith(word, F.lit(NEGATED)), -1.0).otherwise(1.0), "word": F.regexp_replace(word, f"^{NEGATED}", "")})
    else:
        said = said.withColumns({"sign": F.lit(1.0), "word": word})
    hits = said.join(settled(one_entry_per_word(lexicon)), "word")
    return hits.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("matched"),
        F.avg(F.col("polarity") * F.col("sign")).alias("sentiment_polarity"),
        F.avg("subjectivity").alias("sentiment_subjectivity"),
    )


def language_features(
    texts: DataFrame, ids: Sequence[str], text: str, lexicon: DataFrame, negations: Sequence[str] = ()
) -> DataFrame:
    """The six text measures per text. Empty text gives zeros, missing text gives NULLs."""
    ids = list(ids)
    t, tokens = F.col(text), F.col("__tokens")

    def unless_missing(value: Column) -> Column:
        return F.when(t.isNotNull(), value)

    base = texts.select(*ids, t, words(t).alias("__tokens"))
    found = lexicon_sentiment(base, ids, "__tokens", lexicon, negations)
    measured = base.join(found.drop("matched"), ids, "left")
    zero = F.lit(0.0)
    return measured.select(
        *ids,
        t.alias("transcription"),
        unless_missing(F.size(tokens)).alias("word_count"),
        unless_missing(F.coalesce("sentiment_polarity", zero)).alias("sentiment_polarity"),
        unless_missing(F.coalesce("sentiment_subjectivity", zero)).alias("sentiment_subjectivity"),
        unless_missing(vocab_richness(tokens)).alias("vocab_richness"),
        unless_missing(sentence_complexity(tokens, t)).alias("sentence_complexity"),
    )


def chunk_transcript(joined: DataFrame, keys: Sequence[str], text: str, start: str, tie: str) -> DataFrame:
    """Utterances of a chunk in time order, joined by blanks; '' for a silent chunk.

    The text of one chunk is one output value, so a chunk is not cut further.
    """
    said = F.when(F.col(text).isNotNull(), F.struct(F.col(start), F.col(tie), F.col(text).alias("said")))
    return joined.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(said)).getField("said"), " ").alias("transcript"),
        F.count(text).alias("utterances"),
    )


def chunk_language(
    spine: DataFrame,
    utterances: DataFrame,
    subject: str,
    start: str,
    tie: str,
    text: str,
    width: float,
    lexicon: DataFrame,
) -> DataFrame:
    """Text measures per time chunk. Measures use the full text; the stored text is cut."""
    joined = interval_join(spine, utterances, subject, start, width)
    said = chunk_transcript(joined, [subject, "chunk_id"], text, start, tie)
    features = language_features(said, [subject, "chunk_id"], "transcript", lexicon)
    return features.withColumn("transcription", truncate(F.col("transcription")))
