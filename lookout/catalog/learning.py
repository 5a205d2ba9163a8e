"""Queries: neighbours, training sets, models, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lookout.catalog.records import scored_days
from lookout.catalog.registry import query
from lookout.catalog.tables import r6
from lookout.learn import evaluate as ev
from lookout.learn import models, prep
from lookout.operators import decide, neighbours
from lookout.operators.neighbours import knn_in_class as nearest
from lookout.plans import jobs
from lookout.plans import views as v
from lookout.session import scratch_path, settled, table

# --- neighbours and oversampling -------------------------------------------------------

KNN = """em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.label, a.vec_id AS id, b.vec_id AS neighbour, round(sqrt(list_sum(list_transform(range(1, 65),
    lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))), 9) AS dist
  FROM em a JOIN em b ON a.label = b.label AND a.vec_id <> b.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) AS rank FROM pairs
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) <= 5)"""


@query(
    "knn_in_class",
    f"WITH {KNN} SELECT label, id AS vec_id, rank, neighbour, round(dist, 6) AS dist FROM knn",
)
def knn_in_class(spark, d):
    out = nearest(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return out.withColumn("dist", r6("dist"))


@query(
    "knn_recall",
    "SELECT CAST(least(400, count(*)) * 5 AS BIGINT) AS audited, true AS recall_reached, true AS recall_is_told FROM embeddings",
)
def knn_recall(spark, d):
    """The audited search over the vectors, its recall measured anew against exact search on the audited rows."""
    e = table(spark, d, "embeddings")
    found, said, _ = neighbours.knn_audited(e, "label", "vec_id", "embedding")
    asked = e.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(neighbours.AUDITED).select("vec_id")
    true = settled(nearest(e, "label", "vec_id", "embedding").join(asked, "vec_id", "left_semi").select("vec_id", "neighbour"))
    hits = true.join(found.select("vec_id", "neighbour"), ["vec_id", "neighbour"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    share = true.agg(F.count(F.lit(1)).alias("audited")).withColumn("hits", hits.scalar())
    return share.select("audited", (F.col("hits") >= 0.95 * F.col("audited")).alias("recall_reached"), (F.abs(F.col("hits") / F.col("audited") - said) < 1e-9).alias("recall_is_told"))


def md5_number(text: str, first: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {first}, 8) AS BIGINT)"


DRAW = "'42|' || label || '|' || no"
SMOTE = f"""{KNN}, sz AS (SELECT label, count(*) AS size FROM em GROUP BY 1),
wanted AS (SELECT label, size, no FROM sz, range((SELECT max(size) FROM sz)) r(no)
  WHERE no < (SELECT max(size) FROM sz) - size),
drawn AS (SELECT label, no, {md5_number(DRAW, 1)} % size + 1 AS base_rank, {md5_number(DRAW, 9)} % 5 + 1 AS rank,
  {md5_number(DRAW, 17)} / 4294967296.0 AS gap FROM wanted),
rk AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|42'), vec_id) AS base_rank
  FROM em)"""


@query(
    "smote_rows",
    f"""WITH {SMOTE} SELECT d.label, d.no, rk.vec_id AS base, knn.neighbour, round(d.gap, 9) AS gap,
      round(a.x[1] + d.gap * (b.x[1] - a.x[1]), 6) AS first_value,
      round(list_sum(list_transform(range(1, 65), lambda i: a.x[i] + d.gap * (b.x[i] - a.x[i]))), 6) AS total
    FROM drawn d JOIN rk USING (label, base_rank) JOIN knn ON knn.id = rk.vec_id AND knn.rank = d.rank
      JOIN em a ON a.vec_id = rk.vec_id JOIN em b ON b.vec_id = knn.neighbour""",
)
def smote_rows(spark, d):
    out = prep.smote_rows(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "label",
        "no",
        "base",
        "neighbour",
        F.round("gap", 9).alias("gap"),
        r6(F.get("embedding", F.lit(0))).alias("first_value"),
        r6(total).alias("total"),
    )


# --- splits, scaling, weights ----------------------------------------------------------

RANKED = """rk AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
  ORDER BY md5(event_id || '|42'), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)"""


@query(
    "stratified_split",
    f"WITH {RANKED} SELECT event_id, event_type, r <= round(n * 0.2) AS is_test FROM rk",
)
def stratified_split(spark, d):
    return prep.stratified_split(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("stratified_folds", f"WITH {RANKED} SELECT event_id, event_type, CAST((r - 1) % 5 AS INT) AS fold FROM rk")
def stratified_folds(spark, d):
    return prep.stratified_folds(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(
    "standardize",
    """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events WHERE event_id % 5 <> 0)
    SELECT event_id, round((value - m) / sd, 6) AS value FROM events, s""",
)
def standardize(spark, d):
    """Scaled with mean and std of the training rows (four of five)."""
    e = table(spark, d, "events").select("event_id", "value")
    scale = prep.fit_scale(e.filter("event_id % 5 <> 0"), ["value"])
    return prep.standardize(e, scale).withColumn("value", r6("value"))


@query(
    "class_weights",
    f"""WITH {v.UD}, c AS (SELECT {v.UD_CLASS} AS risk FROM ud)
    SELECT risk, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
      FROM c GROUP BY 1""",
)
def class_weights(spark, d):
    return prep.class_weights(scored_days(spark, d), "risk").withColumn("weight", r6("weight"))


# --- evaluation ------------------------------------------------------------------------

# A prediction of the three classes that is often, but not always, the class itself.
GUESS_SQL = f"""g AS (SELECT user_id, day, {v.UD_CLASS} AS truth, CASE WHEN level_mean < 10 THEN 2
  WHEN level_mean < 25 THEN 1 ELSE 0 END AS predicted FROM ud)"""


def guesses(spark, d):
    guess = F.when(F.col("level_mean") < 10, 2).when(F.col("level_mean") < 25, 1).otherwise(0)
    return scored_days(spark, d).select("user_id", "day", F.col("risk").alias("truth"), guess.alias("predicted"))


@query(
    "accuracy",
    f"""WITH {v.UD}, {GUESS_SQL} SELECT count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0 END), 6)
      AS accuracy FROM g""",
)
def accuracy(spark, d):
    return ev.accuracy(guesses(spark, d), "truth", "predicted").withColumn("accuracy", r6("accuracy"))


CM_SQL = f"""{v.UD}, {GUESS_SQL}, cm AS (SELECT t.c AS truth, p.c AS predicted,
  (SELECT count(*) FROM g WHERE g.truth = t.c AND g.predicted = p.c) AS n FROM range(3) t(c), range(3) p(c))"""


@query("confusion_matrix", f"WITH {CM_SQL} SELECT CAST(truth AS INT) AS truth, CAST(predicted AS INT) AS predicted, n FROM cm")
def confusion_matrix(spark, d):
    return ev.confusion_matrix(guesses(spark, d), "truth", "predicted", [0, 1, 2])


REPORT_SQL = f"""{CM_SQL}, pc AS (SELECT c, (SELECT sum(n) FROM cm WHERE truth = c AND predicted = c) AS hit,
    (SELECT sum(n) FROM cm WHERE truth = c) AS support, (SELECT sum(n) FROM cm WHERE predicted = c) AS called
  FROM range(3) r(c)),
pr AS (SELECT CAST(c AS VARCHAR) AS name, coalesce(hit / nullif(called, 0), 0) AS p,
  coalesce(hit / nullif(support, 0), 0) AS r, support FROM pc),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr),
rep AS (SELECT name, p, r, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM f)"""


@query(
    "classification_report",
    f"""WITH {REPORT_SQL} SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM rep""",
)
def classification_report(spark, d):
    out = ev.classification_report(guesses(spark, d), "truth", "predicted", [0, 1, 2])
    return out.select("name", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "metrics_table",
    f"""WITH {REPORT_SQL} SELECT name, 'precision' AS metric, round(p, 6) AS value FROM rep
      UNION ALL SELECT name, 'recall', round(r, 6) FROM rep UNION ALL SELECT name, 'f1', round(f1, 6) FROM rep""",
)
def metrics_table(spark, d):
    """The report in long form, written as a metric table and read back."""
    out = ev.classification_report(guesses(spark, d), "truth", "predicted", [0, 1, 2]).drop("support")
    long = out.unpivot(["name"], ["precision", "recall", "f1"], "metric", "value")
    return settled(long.withColumn("value", r6("value")))


@query(
    "one_vs_rest",
    f"""WITH {v.UD}, {GUESS_SQL} SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(c AS INT) AS class,
      CAST(truth = c AS INT) AS target FROM g, range(3) r(c)""",
)
def one_vs_rest(spark, d):
    out = ev.one_vs_rest(guesses(spark, d), "truth", [0, 1, 2], ["user_id", "day"])
    return out.withColumn("day", F.col("day").cast("string"))


def per_class_scores(spark, d):
    """Documents against each quality class, under a score with ties."""
    wide = v.scored(spark, d).select("doc_id", "y", "score_tied")
    each = ev.one_vs_rest(wide, "y", [0, 1], ["doc_id", "score_tied"])
    return each.withColumn("s", F.when(F.col("class") == 1, F.col("score_tied")).otherwise(-F.col("score_tied")))


CUM_SQL = f"""{v.SC}, ovr AS (SELECT c AS class, CAST(y = c AS INT) AS target,
    CASE WHEN c = 1 THEN score_tied ELSE -score_tied END AS s FROM sc, range(2) r(c)),
ct AS (SELECT class, s, sum(target) AS pos, count(*) AS n FROM ovr GROUP BY 1, 2),
cu AS (SELECT class, s, pos, n, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp,
    sum(pos) OVER (PARTITION BY class) AS p, sum(n - pos) OVER (PARTITION BY class) AS q
  FROM ct WINDOW w AS (PARTITION BY class ORDER BY s DESC)),
st AS (SELECT *, tp / p AS tpr, fp / q AS fpr, tp / (tp + fp) AS prec,
    coalesce(lag(tp / p) OVER w, 0) AS tpr0, coalesce(lag(fp / q) OVER w, 0) AS fpr0
  FROM cu WINDOW w AS (PARTITION BY class ORDER BY s DESC))"""


@query(
    "roc_points",
    f"WITH {CUM_SQL} SELECT CAST(class AS INT) AS class, s AS score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM st",
)
def roc_points(spark, d):
    out = ev.roc_points(per_class_scores(spark, d), F.col("target"), "s", ["class"])
    return out.select("class", "score", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query(
    "roc_auc",
    f"""WITH {CUM_SQL} SELECT CAST(class AS INT) AS class, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS auc
      FROM st GROUP BY 1""",
)
def roc_auc(spark, d):
    return ev.roc_auc(per_class_scores(spark, d), F.col("target"), "s", ["class"]).withColumn("auc", r6("auc"))


@query(
    "pr_points",
    f"WITH {CUM_SQL} SELECT CAST(class AS INT) AS class, s AS score, round(prec, 6) AS precision, round(tpr, 6) AS recall FROM st",
)
def pr_points(spark, d):
    out = ev.pr_points(per_class_scores(spark, d), F.col("target"), "s", ["class"])
    return out.select("class", "score", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(
    "avg_precision",
    f"""WITH {CUM_SQL} SELECT CAST(class AS INT) AS class, round(sum((tpr - tpr0) * prec), 6) AS avg_precision
      FROM st GROUP BY 1""",
)
def avg_precision(spark, d):
    out = ev.average_precision(per_class_scores(spark, d), F.col("target"), "s", ["class"])
    return out.withColumn("avg_precision", r6("avg_precision"))


# --- models ----------------------------------------------------------------------------

FEATURES = ("level_mean", "level_std", "energy_mean", "rate", "pause_ratio", "polarity")


def labelled_days(spark, d):
    days = settled(scored_days(spark, d)).withColumn("id", F.col("user_id") * 100_000 + F.unix_date("day"))
    return days.select("id", *FEATURES, F.col("risk").cast("double").alias("label"))


def training_days(spark, d):
    """User-days with an id, a class and a train/test mark, written once."""
    split = settled(prep.stratified_split(labelled_days(spark, d), "label", "id"))
    return settled(prep.with_class_weight(split, "label", "id"))


def gbt_model(days):
    return models.fit(days.filter(~F.col("is_test")), FEATURES, models.gbt())


def forest_model(days):
    return models.fit(days.filter(~F.col("is_test")), FEATURES, models.forest())


def tested_accuracy(model, days):
    scored = models.score(model, days.filter("is_test"), FEATURES, ["label"])
    return ev.accuracy(scored, "label", "predicted")


def beats_guessing(accuracy, days):
    """Rows tested, and whether more of them are right than by always naming the largest class, and nearly all: the classes follow from
    the features by thresholds, which trees can learn."""
    largest = days.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("share")).select("share").scalar()
    return accuracy.select("n", (F.col("accuracy") > largest).alias("beats_guessing"), (F.col("accuracy") >= 0.9).alias("nearly_all_right"))


CLASSED = f"WITH {v.UD}, c AS (SELECT user_id, day, {v.UD_CLASS} AS risk FROM ud), n AS (SELECT risk, count(*) AS n FROM c GROUP BY 1)"
TESTED_SQL = f"{CLASSED} SELECT CAST(sum(round(n * 0.2)) AS BIGINT) AS n, true AS beats_guessing, true AS nearly_all_right FROM n"


@query("model_gbt", f"{CLASSED} SELECT CAST(sum(round(n * 0.2)) AS BIGINT) AS n, true AS beats_guessing, true AS nearly_all_right, 3 AS report_classes, 9 AS cells, true AS curves_rise FROM n")
def model_gbt(spark, d):
    """The whole training job on classes brought to equal size, tested on untouched rows."""
    days = labelled_days(spark, d)
    done = jobs.training_job(days, FEATURES, "label", "id", models.gbt())
    out = beats_guessing(done.accuracy, days)
    cells = done.confusion.agg(F.count(F.lit(1)).cast("int").alias("cells"), F.sum("n").alias("n"))
    curves = done.curves.agg(F.min(F.col("auc") > 0.5).alias("curves_rise"))
    reported = done.report.filter("name RLIKE '^[0-9]+$'").agg(F.count(F.lit(1)).cast("int").alias("report_classes"))
    return out.join(cells, "n").withColumns({"curves_rise": curves.scalar(), "report_classes": reported.scalar()})


@query("model_rf", TESTED_SQL)
def model_rf(spark, d):
    days = training_days(spark, d)
    return beats_guessing(tested_accuracy(forest_model(days), days), days)


@query("score_batch", f"{CLASSED} SELECT user_id * 100000 + (day - DATE '1970-01-01') AS id, true AS shares_sum_to_1, true AS named_by_best, true AS sure_as_best FROM c")
def score_batch(spark, d):
    """Every user-day scored; per row, whether class, name, confidence and probabilities agree."""
    days = training_days(spark, d)
    out = models.score(gbt_model(days), days, FEATURES, ["id"])
    p = F.col("probabilities")
    best = F.array_max(F.map_values(p))
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "id",
        (F.abs(total - 1) < 1e-9).alias("shares_sum_to_1"),
        ((p[F.col("risk_level")] == best) & (F.col("risk_level") == decide.class_name(F.col("predicted")))).alias("named_by_best"),
        (F.abs(F.col("confidence") - 100 * best) < 1e-9).alias("sure_as_best"),
    )


@query("cv_accuracy", f"{CLASSED} SELECT CAST(sum(n) AS BIGINT) AS n, true AS beats_guessing, true AS nearly_all_right, true AS spread_is_small FROM n")
def cv_accuracy(spark, d):
    """Five-fold cross-validation of the boosted pipeline."""
    days = labelled_days(spark, d)
    done = settled(models.cv_summary(models.cross_validate(days, FEATURES, "label", "id", models.gbt())))
    return beats_guessing(done, days).withColumn("spread_is_small", done.select(F.col("spread") < 0.2).scalar())


NAMED_SQL = "(VALUES " + ", ".join(f"('{f}')" for f in FEATURES) + ")"


@query("feature_importance", f"SELECT feature, true AS is_share, 1.0 AS total FROM {NAMED_SQL} f(feature)")
def feature_importance(spark, d):
    found = settled(models.feature_importance(spark, gbt_model(training_days(spark, d)), FEATURES))
    total = found.agg(F.round(F.sum("importance"), 6).alias("total")).select("total").scalar()
    return found.select("feature", F.col("importance").between(0, 1).alias("is_share"), total.alias("total"))


@query("top_features", f"SELECT CAST(rank AS INT) AS rank, true AS known, true AS falling FROM range(1, {len(FEATURES) + 1}) r(rank)")
def top_features(spark, d):
    found = settled(models.top_features(models.feature_importance(spark, forest_model(training_days(spark, d)), FEATURES)))
    w = Window.partitionBy().orderBy(F.desc("importance"), "feature")  # at most fifteen rows
    before = F.lag("importance").over(w)
    return found.select(
        F.row_number().over(w).alias("rank"), F.col("feature").isin(*FEATURES).alias("known"), (before.isNull() | (before >= F.col("importance"))).alias("falling")
    )


@query("model_roundtrip", f"{CLASSED} SELECT true AS same, CAST(sum(n) AS BIGINT) AS n, 'user days' AS dataset FROM n")
def model_roundtrip(spark, d):
    """Scores of a saved and reloaded model next to those of the model itself."""
    days = training_days(spark, d)
    model = forest_model(days)
    accuracy = tested_accuracy(model, days).first()["accuracy"]
    path = scratch_path(spark, "bundle")
    models.save_bundle(model, path, FEATURES, accuracy, "user days", days.count())
    loaded, about = models.load_bundle(spark, path)
    before = models.score(model, days, FEATURES, ["id"]).select("id", F.col("predicted").alias("before"))
    after = models.score(loaded, days, FEATURES, ["id"]).select("id", F.col("predicted").alias("after"))
    names = about.select("dataset").scalar()
    return before.join(after, "id").groupBy((F.col("before") == F.col("after")).alias("same")).agg(
        F.count(F.lit(1)).alias("n"), F.max(names).alias("dataset")
    )
