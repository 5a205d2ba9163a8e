"""Whole jobs: corpus features, batch decisions, balanced training."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.functions.signal import FRAME_LENGTH, HOP, signal_features
from lookout.functions.text import chunk_transcript, language_features, truncate
from lookout.learn import evaluate as ev
from lookout.learn import models, prep
from lookout.operators import decide
from lookout.operators.aggregates import MIN_BASELINE_ROWS
from lookout.operators.relational import with_defaults
from lookout.operators.windows import expanding_baseline
from lookout.schemas import EMPTY_TEXT
from lookout.session import settled, settled_alone, work_tables
from lookout.sources.files import SAMPLE_RATE

Step = Callable[[DataFrame], DataFrame]

def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Named steps one after the other; each takes the table and adds its columns."""
    return reduce(lambda table, step: table.transform(step), steps, df)


# --- corpus ----------------------------------------------------------------------------


def corpus_features(
    recordings: DataFrame,
    subject_of: Column,
    utterances: DataFrame,
    lexicon: DataFrame,
    seconds: int = 5,
    rate: int = SAMPLE_RATE,
    rules: Sequence[decide.Rule] = decide.SPEECH_RULES,
    resample: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(one labelled row per subject and chunk: signal measures, text measures, risk class; rejected recordings).

    ``utterances`` has subject, start_time, turn, value. A chunk in which nothing was said has
    zeros for its text.
    """
    signal, rejects = signal_features(recordings, seconds, rate, FRAME_LENGTH, HOP, resample=resample)
    signal = signal.withColumn("subject", subject_of).drop("path")
    # The chunks come from the recordings; what was said after the last full one finds no partner.
    keys = ["subject", "chunk_id"]
    placed = utterances.withColumn("chunk_id", F.floor(F.col("start_time") / F.lit(seconds)))
    said = chunk_transcript(placed, keys, "value", "start_time", "turn")
    text = language_features(said, keys, "transcript", lexicon)
    text = text.withColumn("transcription", truncate(F.col("transcription")))
    joined = with_defaults(signal.join(text, keys, "left"), EMPTY_TEXT)
    labelled = joined.withColumn("chunk_start", F.col("chunk_id") * seconds).withColumn(
        "risk_label", decide.risk_class(decide.rule_score(rules))
    )
    return labelled, rejects


# --- decisions -------------------------------------------------------------------------


def batch_decisions(
    records: DataFrame,
    key: str,
    order: Sequence[str],
    measures: Mapping[str, str],
    flags: dict[str, tuple[str, str]],
    predict: Step,
    error: str = "error",
) -> DataFrame:
    """All records through baseline, trend flags, prediction and decision.

    ``predict`` adds ``model_risk``. Records with an error enter no baseline and get the risk
    level ``Error`` with the error as explanation and no advice.
    """
    ok = F.col(error).isNull()
    done = run_steps(
        records.filter(ok),
        [
            lambda df: expanding_baseline(df, key, order, measures),
            lambda df: df.withColumns(decide.trend_flags(flags)),
            predict,
            lambda df: decide.fallback_decision(df, "model_risk"),
        ],
    )
    return done.unionByName(_failures(records, error), allowMissingColumns=True)


def _failures(records: DataFrame, error: str) -> DataFrame:
    """Records with an error, decided as such."""
    return records.filter(F.col(error).isNotNull()).withColumns(
        {
            "risk_level": F.lit("Error"),
            "explanation": F.col(error),
            "recommendations": F.array().cast("array<string>"),
        }
    )


def decision_job(
    records: DataFrame,
    key: str,
    order: Sequence[str],
    measures: Mapping[str, str],
    flags: dict[str, tuple[str, str]],
    predict: Step,
    ask: Step,
    answer: Step,
    error: str = "error",
    min_rows: int = MIN_BASELINE_ROWS,
) -> DataFrame:
    """All records from their measures to the decision: baseline, trend flags, model, request, reply, decision.

    ``predict`` adds ``model_risk`` and ``confidence``; ``ask`` adds ``request`` (see ``decide.render_request``); ``answer``
    adds ``reply``, from a table of replies or a service, NULL where there is none. Records without a full baseline
    are decided as Unknown, records with an error as Error.
    """
    done = run_steps(
        records.filter(F.col(error).isNull()),
        [
            lambda df: expanding_baseline(df, key, order, measures, min_rows),
            lambda df: df.withColumns(decide.trend_flags(flags)),
            predict,
            ask,
            answer,
            lambda df: decide.final_decision(df, "reply", "model_risk", "confidence", F.col("baseline_n") >= min_rows),
        ],
    )
    return done.unionByName(_failures(records, error), allowMissingColumns=True)


# --- training --------------------------------------------------------------------------


def balanced_training(
    train: DataFrame, features: Sequence[str], label: str, id_col: str, classifier: Estimator
) -> PipelineModel:
    """Oversample the training rows to equal classes, then scale and fit. Fails loudly when it cannot.

    Work tables go as soon as they are not needed: those of the search for neighbours before the fit, all with its end."""

    def balanced() -> DataFrame:
        clean = models.clean_features(train, features)
        points = settled(clean.select(id_col, label, F.array(*features).alias("vec")))
        extra = prep.smote_rows(points, label, id_col, "vec")
        both = points.select(label, "vec").unionByName(extra.select(label, "vec"))
        return both.select(label, *[F.get("vec", F.lit(i)).alias(f) for i, f in enumerate(features)])

    spark = train.sparkSession
    with work_tables(spark):
        return models.fit(settled_alone(spark, balanced), features, classifier)


class Training(NamedTuple):
    """A fitted model and what the rows that it has not seen say about it."""

    model: PipelineModel
    accuracy: DataFrame
    report: DataFrame
    confusion: DataFrame
    curves: DataFrame
    importance: DataFrame


def training_job(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    id_col: str,
    classifier: Estimator,
    path: str | None = None,
    dataset: str = "",
    test_share: float = 0.2,
) -> Training:
    """Split, oversample, fit, holdout report, curves, importance, and the bundle in ``path`` if one is named."""
    split = settled(prep.stratified_split(models.clean_features(df, features), label, id_col, test_share))
    model = balanced_training(split.filter(~F.col("is_test")), features, label, id_col, classifier)
    scored = settled(models.score(model, split.filter("is_test"), features, [id_col, label]))
    classes = list(range(models.class_count(model)))
    shares = F.map_values("probabilities")
    each = scored.select(F.col(label), F.posexplode(shares).alias("class", "s")).filter(F.col("class").isin(classes))
    curves = ev.roc_auc(each, (F.col(label) == F.col("class")).cast("int"), "s", ["class"])
    accuracy = settled(ev.accuracy(scored, label, "predicted"))
    if path:
        models.save_bundle(model, path, features, accuracy.first()["accuracy"], dataset, split.count())
    return Training(
        model,
        accuracy.withColumn("note", F.lit(models.LABEL_NOTE)),
        ev.classification_report(scored, label, "predicted", classes),
        ev.confusion_matrix(scored, label, "predicted", classes),
        curves,
        models.feature_importance(df.sparkSession, model, features),
    )
