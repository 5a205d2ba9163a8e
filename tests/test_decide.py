from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lookout.operators import aggregates as agg
from lookout.operators import decide
from lookout.operators import relational as rel
from lookout.operators import windows as win
from lookout.plans.jobs import batch_decisions, decision_job
from lookout.sources import commits, tables


def test_rule_score_missing_feature_turns_rule_off(spark):
    names = [r.feature for r in decide.SPEECH_RULES]
    schema = ", ".join(f"{n} double" for n in names)
    rows = [(None,) * 8, (1.0, 0.9, 0.0, 1.0, 1.0, 100.0, -0.5, 0.0), (15.0, 0.6, 0.01, 2.0, 5.0, 1500.0, -0.1, 3.0)]
    df = spark.createDataFrame(rows, schema)
    score = decide.rule_score(decide.SPEECH_RULES)
    got = df.select(score.alias("s"), decide.risk_class(score).alias("c")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (11, 2), (0, 0)]


@pytest.mark.parametrize("score,level", [(0, 0), (1, 0), (2, 1), (4, 1), (5, 2), (11, 2)])
def test_risk_class(spark, score, level):
    assert spark.range(1).select(decide.risk_class(F.lit(score))).first()[0] == level


REPLIES = [
    (1, '{"risk_level": "High", "explanation": "e", "recommendations": ["a", "b"]}', "Low"),
    (2, '```json\n{"risk_level": "Medium", "mental_health_status": "S"}\n```', None),
    (3, '{"risk_level": "Hi', "Medium"),
    (4, "plain text", None),
    (5, "{}", "High"),
    (6, None, "Low"),
    (7, '{"recommendations": []}', None),
]


def test_parse_reply(spark):
    df = spark.createDataFrame(REPLIES, "id int, reply string, model_risk string")
    got = {r["id"]: r for r in decide.parse_reply(df, "reply", "model_risk").collect()}
    assert (got[1]["risk_level"], got[1]["mental_health_status"], got[1]["recommendations"]) == ("High", "Unhealthy", ["a", "b"])
    assert (got[2]["risk_level"], got[2]["mental_health_status"], got[2]["explanation"]) == ("Medium", "S", "")
    assert (got[3]["risk_level"], got[3]["reply_error"]) == ("Medium", "unreadable reply")
    assert (got[4]["risk_level"], got[4]["mental_health_status"]) == ("Unknown", "Healthy")
    assert (got[5]["risk_level"], got[5]["reply_error"]) == ("High", None)
    assert (got[6]["risk_level"], got[6]["reply_error"]) == ("Low", None)
    assert got[7]["recommendations"] == []


def test_final_decision(spark):
    df = spark.createDataFrame(REPLIES, "id int, reply string, model_risk string").withColumn("conf", F.lit(81.25))
    out = decide.final_decision(df, "reply", "model_risk", "conf", F.col("id") != 5)
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["recommendations"] == ["a", "b"]
    assert len(got[3]["recommendations"]) == 3  # advice of the model's class
    assert len(got[4]["recommendations"]) == 2  # no model: that of Low
    assert (got[5]["risk_level"], got[5]["mental_health_status"], got[5]["recommendations"]) == ("Unknown", "Unknown", [])
    assert got[6]["explanation"] == "The model classified this record as Low Risk with 81.3% confidence."


def test_fallback_default_is_low(spark):
    df = spark.createDataFrame([(1, None), (2, "High"), (3, "odd")], "id int, m string")
    got = {r["id"]: (r["risk_level"], r["mental_health_status"], len(r["recommendations"])) for r in decide.fallback_decision(df, "m").collect()}
    assert got == {1: ("Low", "Healthy", 2), 2: ("High", "Unhealthy", 4), 3: ("odd", "Healthy", 2)}


def test_request_sections(spark):
    df = spark.createDataFrame([(1, 100.0, 120.0, "High"), (2, 90.0, None, None), (3, None, 80.0, None)], "id int, p double, b double, m string")
    df = df.withColumns(decide.trend_flags({"pitch_drop": ("p", "b")}))
    text = decide.render_request(
        {"Pitch": ("p", "%.1f Hz")},
        {"Average Pitch": ("b", "%.1f Hz")},
        {"Pitch Drop": "pitch_drop"},
        F.col("b").isNotNull(),
        F.col("m"),
        F.lit(70.0),
        F.when(F.col("id") == 1, "so it goes"),
        F.create_map(F.lit("Low"), F.lit(0.25), F.lit("High"), F.lit(0.75)),
        F.array(F.lit("rest"), F.lit("walk")),
        opening="You read records.",
        model_note="Mind the model.",
        closing="Answer in JSON.",
    )
    got = {r["id"]: r["t"] for r in df.select("id", text.alias("t")).collect()}
    assert "Pitch: 100.0 Hz" in got[1] and "Average Pitch: 120.0 Hz" in got[1]
    assert "Transcription: 'so it goes'" in got[1] and "Transcription: 'N/A'" in got[2]
    assert "TRENDS: Pitch Drop Detected=True" in got[1] and "Predicted: High Risk (Confidence: 70.0%)" in got[1]
    assert "Probabilities -> Low: 25.0%, Medium: 0.0%, High: 75.0%" in got[1]
    assert '1. "rest"\n2. "walk"' in got[1]
    assert "BASELINE" not in got[2] and "Predicted" not in got[2] and "rest" not in got[2]
    assert got[1].startswith("You read records.\n\n") and got[1].endswith("\n\nAnswer in JSON.") and "\nMind the model.\n" in got[1]
    assert "\\n" not in got[1] and got[1].count("\n\n") == 5
    assert "Pitch: 0.0 Hz" in got[3]


def test_baseline_needs_five_rows_and_skips_nan(spark):
    rows = [("a", float(i)) for i in range(4)] + [("b", 1.0), ("b", float("nan")), ("b", None), ("b", 3.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "user string, v double")
    got = agg.user_baseline(df, "user", {"base": "v"}).collect()
    assert [tuple(r) for r in got] == [("b", 5, 2.0)]


def test_expanding_baseline_inclusive_and_not(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(7)], "user string, at int, v double")
    inc = win.expanding_baseline(df, "user", ["at"], {"base": "v"}).orderBy("at").collect()
    assert [r["base"] for r in inc] == [None] * 4 + [2.0, 2.5, 3.0]
    exc = win.expanding_baseline(df, "user", ["at"], {"base": "v"}, inclusive=False).orderBy("at").collect()
    assert [r["base"] for r in exc] == [None] * 5 + [2.0, 2.5]


def test_ratio_and_delta(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0), (2, 10.0, 0.0), (3, None, 4.0), (4, 3.0, None), (5, 3.0, -2.0)], "id int, c double, b double")
    got = {r["id"]: r["ratio"] for r in decide.baseline_ratio(df, ["id"], {"m": ("c", "b")}).collect()}
    assert got == {1: 2.0, 2: 10.0, 3: 0.0, 4: 3.0, 5: 1.0}
    delta = decide.baseline_delta({"m": ("c", "b")}, F.col("b").isNotNull())
    assert [r[0] for r in df.orderBy("id").select(*[c.alias(o) for o, c in delta.items()]).collect()] == [5.0, 10.0, -4.0, None, 5.0]


def test_nan_is_missing_everywhere(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 3.0, nan, None])], "k string, at int, v double")
    row = agg.describe(df, ["v"]).first()
    assert (row["n"], row["mean"], row["max"], row["q2"], row["std"]) == (3, 2.0, 3.0, 2.0, 1.0)
    assert agg.group_mean(df, "k", "v").first()["mean_value"] == 2.0
    box = agg.box_stats(spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0, nan)], "k string, v double"), "k", "v").first()
    assert (box["q1"], box["q2"], box["outliers"]) == (2.0, 3.0, 0)
    trend = win.user_trend(df, "k", ["at"], "v").first()
    assert (trend["n"], trend["slope"], trend["mean_step"]) == (5, 1.0, 1.0)


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_deviation_keeps_its_digits(spark, shift):
    values = [1.0, 2.0, 4.0, 3.0, 2.5, 9.0, 0.5]
    df = spark.createDataFrame([("a", i, v + shift) for i, v in enumerate(values)] + [("b", i, shift) for i in range(7)], "k string, at int, v double")
    got = {(r["k"], r["at"]): r["z"] for r in win.deviation_z(df, "k", ["at"], "v", 5).collect()}
    import statistics

    want = (9.0 - statistics.mean(values[:5])) / statistics.stdev(values[:5])
    assert got["a", 5] == pytest.approx(want, rel=1e-5) and got["a", 4] is None
    assert got["b", 6] is None


def test_local_day_near_midnight(spark):
    rows = [("a", dt.datetime(2024, 1, 14, 20, 0)), ("b", dt.datetime(2024, 1, 14, 10, 0))]
    df = spark.createDataFrame(rows, "user string, ts timestamp")
    day = F.lit("2024-01-15").cast("date")
    got = dict(map(tuple, agg.uploaded_on_day(df, "user", "ts", day, "Asia/Tokyo").collect()))
    assert got == {"a": True, "b": False}


def test_emotion_names_and_codes(spark):
    df = spark.createDataFrame([("fear",), ("SAD",), ("anger",), ("disgust",), ("happy",), ("xyz",), (None,)], "e string")
    coded = df.select("e", decide.emotion_code(F.col("e")).alias("code"))
    three = {r["e"]: r["risk"] for r in decide.risk_map3(coded, "code", "risk").collect()}
    assert three == {"fear": 2, "SAD": 2, "anger": 1, "disgust": 1, "happy": 0, "xyz": 0, None: 0}
    two = {r["e"]: r["r"] for r in coded.select("e", decide.risk_map2(F.col("code")).alias("r")).collect()}
    assert two == {"fear": 1, "SAD": 1, "anger": 1, "disgust": 1, "happy": 0, "xyz": 0, None: 0}


def test_label_source_without_source(spark):
    with pytest.raises(ValueError):
        rel.label_source(spark.range(1), ["emotion"], "filename", 2, "NEU")


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 5, 2.0)], "k string, at int, v double")
    new = spark.createDataFrame([("a", 2, 9.0), ("b", 5, 8.0), ("c", 1, 3.0)], "k string, at int, v double")
    got = sorted(map(tuple, commits.upsert(old, new, ["k"], "at").collect()))
    assert got == [("a", 2, 9.0), ("b", 5, 8.0), ("c", 1, 3.0)]
    older = spark.createDataFrame([("a", 0, 7.0)], "k string, at int, v double")
    assert sorted(map(tuple, commits.upsert(old, older, ["k"], "at").collect())) == [("a", 1, 1.0), ("b", 5, 2.0)]


def test_records_of_a_day_lie_in_the_order_of_the_user(spark, tmp_path):
    rows = [(f"u{i % 50:02d}", dt.datetime(2024, 1, 1 + i % 2, 12)) for i in range(400)]
    tables.append_records(spark.createDataFrame(rows, "user_id string, ts timestamp").repartition(5), str(tmp_path / "r"))
    for file in spark.read.parquet(str(tmp_path / "r")).inputFiles():
        users = [r["user_id"] for r in spark.read.parquet(file).collect()]
        assert users == sorted(users)


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "t.csv").write_text("speaker\tstart_time\nParticipant\t1.5\nOther\tsoon\n")
    schema = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("start_time", T.DoubleType())])
    got = tables.read_text_table(spark, str(tmp_path), schema, "\t").collect()
    assert sorted((r["speaker"], r["start_time"], r[tables.CORRUPT]) for r in got) == [
        ("Other", None, "Other\tsoon"),
        ("Participant", 1.5, None),
    ]


def test_batch_decisions_carry_errors(spark):
    rows = [("a", i, float(i + 1), None if i != 2 else "no file") for i in range(8)]
    df = spark.createDataFrame(rows, "user string, at int, v double, error string")
    out = batch_decisions(df, "user", ["at"], {"base": "v"}, {"pitch_drop": ("v", "base")},
                          lambda t: t.withColumn("model_risk", F.when(F.col("v") > 6, "High")))
    got = {r["at"]: r for r in out.collect()}
    assert len(got) == 8
    assert (got[2]["risk_level"], got[2]["explanation"], got[2]["recommendations"]) == ("Error", "no file", [])
    assert got[7]["risk_level"] == "High" and got[7]["baseline_n"] == 7
    assert got[5]["base"] == pytest.approx((1 + 2 + 4 + 5 + 6) / 5)  # the failed record is not in it


def test_decision_job_goes_from_measures_to_decisions(spark):
    rows = [("a", i, float(20 - i), "no file" if i == 1 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "user string, at int, v double, error string")
    said = spark.createDataFrame([(7, '{"risk_level": "Medium", "explanation": "said"}'), (8, "what?")], "at int, reply string")

    def ask(t):
        request = decide.render_request({"Value": ("v", "%.1f")}, {"Usual": ("base", "%.1f")}, {"Drop": "pitch_drop"}, F.col("base").isNotNull(), F.col("model_risk"), F.col("confidence"))
        return t.withColumn("request", request)

    out = decision_job(
        df, "user", ["at"], {"base": "v"}, {"pitch_drop": ("v", "base")},
        lambda t: t.withColumns({"model_risk": F.when(F.col("v") < 15, "High").otherwise("Low"), "confidence": F.lit(75.0)}),
        ask, lambda t: t.join(said, "at", "left"),
    )
    got = {r["at"]: r for r in out.collect()}
    assert (got[1]["risk_level"], got[1]["explanation"]) == ("Error", "no file")
    assert got[3]["risk_level"] == "Unknown"
    assert (got[6]["risk_level"], got[6]["explanation"]) == ("High", "The model classified this record as High Risk with 75.0% confidence.")
    assert (got[7]["risk_level"], got[7]["explanation"], len(got[7]["recommendations"])) == ("Medium", "said", 4)
    assert (got[8]["risk_level"], got[8]["reply_error"]) == ("High", "unreadable reply")
    assert "Usual: 17.2" in got[5]["request"] and "Drop Detected=True" in got[8]["request"]
