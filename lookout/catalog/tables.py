"""Queries: sources, sinks, projections, joins, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.catalog.registry import query
from lookout.functions import text as tx
from lookout.operators import relational as rel
from lookout.operators.aggregates import user_baseline
from lookout.operators.windows import latest_per_key
from lookout.plans import views as v
from lookout.schemas import EVENTS
from lookout.session import scratch_path, settled, table
from lookout.sources import commits, files, tables


def r6(c):
    return F.round(c, 6)


def past_tie(c):
    """Six places of a mean of means, whose seventh is often an exact 5: a hair more decides it the same way everywhere."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# --- sources and sinks -----------------------------------------------------------------


@query("csv_roundtrip", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    tables.write_text_table(table(spark, d, "events").select(*EVENTS.fieldNames()), path)
    return tables.read_text_table(spark, path, EVENTS).drop(tables.CORRUPT)


TRANSCRIPT = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("value", T.StringType()),
    ]
)


@query(
    "tsv_roundtrip",
    f"WITH {v.TR} SELECT conv_id, turn, role AS speaker, start_time, text AS value, false AS corrupt FROM tr",
)
def tsv_roundtrip(spark, d):
    path = scratch_path(spark, "tsv")
    turns = v.transcript(spark, d).select(
        "conv_id", "turn", F.col("role").alias("speaker"), "start_time", F.col("text").alias("value")
    )
    tables.write_text_table(turns, path, "\t")
    back = tables.read_text_table(spark, path, TRANSCRIPT, "\t", multi_line=True)
    return back.withColumn("corrupt", F.col(tables.CORRUPT).isNotNull()).drop(tables.CORRUPT)


def day_records(spark, d):
    """User-days as records."""
    return v.user_day(spark, d).select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("day").cast("timestamp").alias("ts"),
        F.concat_ws("/", F.col("user_id"), F.col("day")).alias("source_path"),
        F.col("level_mean").alias("pitch_mean"),
        F.col("level_std").alias("pitch_std"),
        "energy_mean",
        F.col("rate").alias("speech_rate"),
        "pause_ratio",
        F.col("polarity").alias("sentiment_polarity"),
        F.col("n").cast("int").alias("word_count"),
    )


@query(
    "append_records",
    f"""WITH {v.UD} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(day AS VARCHAR) AS record_date,
      round(level_mean, 6) AS pitch_mean, CAST(n AS INT) AS word_count, 'unknown' AS label, 2 AS n_ids FROM ud""",
)
def append_records(spark, d):
    """Two appends; every row must come back once per append, under two ids."""
    path = scratch_path(spark, "records")
    records = settled(day_records(spark, d))
    tables.append_records(records, path)
    tables.append_records(records, path)
    back = tables.read_records(spark, path)
    return (
        back.groupBy("user_id", F.col("record_date").cast("string").alias("record_date"), "word_count", "label")
        .agg(r6(F.max("pitch_mean")).alias("pitch_mean"), F.count_distinct("record_id").cast("int").alias("n_ids"))
        .select("user_id", "record_date", "pitch_mean", "word_count", "label", "n_ids")
    )


@query(
    "scan_user_records",
    f"""WITH {v.UD} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(day AS VARCHAR) AS record_date, round(level_mean, 6) AS pitch_mean,
      CAST(n AS INT) AS word_count FROM ud WHERE user_id = 8""",
)
def scan_user_records(spark, d):
    """The records of one user, read from the written record table."""
    path = scratch_path(spark, "records")
    tables.append_records(day_records(spark, d), path)
    own = tables.read_records(spark, path, "8")
    return own.select("user_id", F.col("record_date").cast("string").alias("record_date"), r6("pitch_mean").alias("pitch_mean"), "word_count")


BASE = {"base_level": "level_mean", "base_energy": "energy_mean", "base_rate": "rate", "base_polarity": "polarity"}
BASE_SQL = """bl AS (SELECT user_id, count(*) AS total_samples, avg(level_mean) AS base_level,
  avg(energy_mean) AS base_energy, avg(rate) AS base_rate, avg(polarity) AS base_polarity
  FROM ud GROUP BY 1 HAVING count(*) >= 26)"""


@query(
    "baseline_upsert",
    f"""WITH {v.UD}, half AS (SELECT user_id, 1 AS version, count(*) AS total_samples, avg(level_mean) AS m
      FROM ud WHERE day < DATE '2024-01-16' GROUP BY 1 HAVING count(*) >= 13),
    whole AS (SELECT user_id, 2 AS version, count(*) AS total_samples, avg(level_mean) AS m
      FROM ud GROUP BY 1 HAVING count(*) >= 26)
    SELECT user_id, version, total_samples, round(m, 6) AS base_level FROM whole
    UNION ALL SELECT user_id, version, total_samples, round(m, 6) FROM half
      WHERE user_id NOT IN (SELECT user_id FROM whole)""",
)
def baseline_upsert(spark, d):
    """Baselines of the first half are replaced by those of the whole month where there are any."""
    days = v.stored_days(spark, d)
    level = {"base_level": "level_mean"}
    old = user_baseline(days.filter("day < DATE '2024-01-16'"), "user_id", level, 13).withColumn("version", F.lit(1))
    new = user_baseline(days, "user_id", level, 26).withColumn("version", F.lit(2))
    root = scratch_path(spark, "baselines")
    commits.upsert_table(old, root, ["user_id"], "version")
    return commits.upsert_table(new, root, ["user_id"], "version").withColumn("base_level", r6(F.col("base_level")))


@query(
    "bulk_load",
    f"""WITH {v.UD} SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS total_samples,
      round(avg(level_mean), 6) AS pitch, round(avg(rate), 6) AS speech, round(avg(polarity), 6) AS mood
      FROM ud GROUP BY 1 HAVING count(*) >= 26""",
)
def bulk_load(spark, d):
    """Two feature tables joined on the file name and loaded; the refreshed baselines come back."""
    records = settled(day_records(spark, d))
    prosody = records.drop("sentiment_polarity", "word_count")
    language = records.select("source_path", "user_id", "sentiment_polarity", "word_count")
    base = tables.bulk_load(prosody, language, ["source_path"], scratch_path(spark, "bulk"), 26)
    return base.select(
        "user_id",
        "total_samples",
        r6("baseline_pitch_mean").alias("pitch"),
        r6("baseline_speech_rate").alias("speech"),
        r6("baseline_sentiment").alias("mood"),
    )


@query(
    "typed_defaults",
    """SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.source END, 'user1') AS user_id,
      coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS label FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def typed_defaults(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("user_id"),
        F.col("quality").cast("string").alias("label"),
    )
    return rel.with_defaults(rows, {"user_id": "user1", "label": "unknown"})


@query(
    "subject_discovery",
    """SELECT CAST(conv_id AS VARCHAR) AS subject, max(CAST(role = 'system' AS INT)) AS has_audio
      FROM conversations GROUP BY 1""",
)
def subject_discovery(spark, d):
    """File paths as they would lie in subject folders: the recording where there is a system turn."""
    turns = table(spark, d, "conversations")
    ending = F.when(F.col("role") == "system", "_AUDIO.wav").otherwise("_TRANSCRIPT.csv")
    paths = turns.select(
        F.concat(F.lit("/corpus/"), F.col("conv_id"), F.lit("_P/"), F.col("conv_id"), ending).alias("path")
    )
    with_audio, without = files.subject_files(paths)
    return with_audio.withColumn("has_audio", F.lit(1)).unionByName(without.withColumn("has_audio", F.lit(0)))


# --- projections and predicates --------------------------------------------------------

NAME = "p AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS f FROM pages)"


def names(spark, d):
    bare = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", rel.name_fields(bare, "/").alias("f"))


@query("parse_name_fields", f"WITH {NAME} SELECT page_id, f[1] AS f0, f[3] AS f2, f[4] AS f3, f[6] AS f5 FROM p")
def parse_name_fields(spark, d):
    return names(spark, d).select("page_id", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in (0, 2, 3, 5)])


@query("filter_field_count", f"WITH {NAME} SELECT page_id, len(f) AS n_fields FROM p WHERE len(f) >= 6")
def filter_field_count(spark, d):
    return rel.with_field_count(names(spark, d), "f", 6).select("page_id", F.size("f").cast("bigint").alias("n_fields"))


# Language names per code; Spanish is left out so that the default occurs.
LANGUAGES = (("en", "english"), ("fr", "french"), ("de", "german"))


@query(
    "code_lookup",
    f"""WITH {NAME} SELECT page_id, f[4] AS code, CASE f[4] WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french'
      WHEN 'de' THEN 'german' ELSE 'unknown' END AS language FROM p""",
)
def code_lookup(spark, d):
    coded = names(spark, d).select("page_id", F.get("f", F.lit(3)).alias("code"))
    codes = rel.small_table(spark, LANGUAGES, "code string, language string")
    return rel.code_lookup(coded, codes, "code", "language", "unknown").select("page_id", "code", "language")


@query(
    "range_category",
    f"""WITH {NAME} SELECT page_id, CASE WHEN TRY_CAST(f[5] AS INT) BETWEEN 100 AND 499 THEN 'low' ELSE 'high'
      END AS band FROM p""",
)
def range_category(spark, d):
    return names(spark, d).select(
        "page_id", rel.in_range_category(F.get("f", F.lit(4)), 100, 499, "low", "high").alias("band")
    )


@query(
    "filter_conjunct",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'""",
)
def filter_conjunct(spark, d):
    both = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").filter(both).select("l_orderkey", "l_linenumber", "l_quantity")


def labelled(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")


@query(
    "drop_missing",
    """SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
      WHERE quality IS NOT NULL AND toxic IS NOT NULL""",
)
def drop_missing(spark, d):
    return rel.drop_missing(labelled(spark, d), ["quality", "toxic"])


@query(
    "clean_numeric",
    """SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 THEN 0.0
      ELSE value END AS value FROM events""",
)
def clean_numeric(spark, d):
    i = F.col("event_id")
    raw = (
        F.when(i % 17 == 0, float("nan"))
        .when(i % 19 == 0, F.when(i % 2 == 0, float("inf")).otherwise(float("-inf")))
        .when(i % 23 != 0, F.col("value"))
    )
    return table(spark, d, "events").select("event_id", rel.clean_number(raw).alias("value"))


@query("project_available", "SELECT event_id, user_id, value FROM events")
def project_available(spark, d):
    return rel.project_available(table(spark, d, "events"), ["user_id", "pitch_mean", "value", "hnr"], ["event_id"])


@query(
    "label_source",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NEU' ELSE event_type END AS from_name,
      event_type AS from_column FROM events""",
)
def label_source(spark, d):
    e = table(spark, d, "events")
    name = F.when(F.col("event_id") % 5 == 0, F.col("user_id").cast("string")).otherwise(
        F.concat_ws("_", "user_id", F.lit("DFA"), "event_type", F.lit("XX"))
    )
    named = e.withColumn("filename", name)
    from_name = rel.label_source(named, ["emotion_label", "emotion"], "filename", 2, "NEU")
    from_column = rel.label_source(named, ["emotion_label", "event_type"], "filename", 2, "NEU")
    return named.select("event_id", from_name.alias("from_name"), from_column.alias("from_column"))


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("min_length", f"SELECT doc_id, len({TOKENS}) AS n_words FROM documents WHERE len({TOKENS}) >= 50")
def min_length(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("samples"))
    return rel.long_enough(docs, "samples", 50).select("doc_id", F.size("samples").cast("bigint").alias("n_words"))


@query(
    "valid_rows",
    """SELECT doc_id, quality IS NOT NULL AS kept, CASE WHEN quality IS NULL THEN 'no label' END AS reason
      FROM documents LEFT JOIN labels USING (doc_id)""",
)
def valid_rows(spark, d):
    marked = settled(labelled(spark, d).withColumn("error", F.when(F.col("quality").isNull(), "no label")))
    good, bad = rel.split_rejects(marked)
    return rel.union_all(
        good.select("doc_id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason")),
        bad.select("doc_id", F.lit(False).alias("kept"), F.col("error").alias("reason")),
    )


@query(
    "null_default",
    """SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 0) AS q, coalesce(nullif(CAST(toxic AS DOUBLE), 0), 1) AS divisor
      FROM documents LEFT JOIN labels USING (doc_id)""",
)
def null_default(spark, d):
    return labelled(spark, d).select(
        "doc_id",
        rel.or_default(F.col("quality").cast("double"), 0.0).alias("q"),
        rel.as_divisor(F.col("toxic").cast("double")).alias("divisor"),
    )


@query("truncate_text", "SELECT doc_id, substring(text, 1, 200) AS head FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate(F.col("text")).alias("head"))


# --- joins -----------------------------------------------------------------------------


@query(
    "join_inner",
    """SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "c_mktsegment", "o_totalprice")


@query(
    "join_suffix",
    f"""WITH {v.UD}, buy AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events
      WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT ud.user_id, CAST(ud.day AS VARCHAR) AS day, ud.n AS n, buy.n AS n_lang
      FROM ud JOIN buy ON ud.user_id = buy.user_id AND ud.day = buy.day""",
)
def join_suffix(spark, d):
    buys = table(spark, d, "events").filter("event_type = 'purchase'")
    buys = buys.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = v.user_day(spark, d).select("user_id", "day", "n")
    return rel.join_with_suffix(days, buys, ["user_id", "day"], "_lang").withColumn("day", F.col("day").cast("string"))


@query(
    "interval_join",
    f"""WITH {v.TR} SELECT s.conv_id, s.chunk_id, CAST(s.chunk_start AS BIGINT) AS chunk_start, u.turn
      FROM spine s LEFT JOIN utt u ON u.conv_id = s.conv_id AND u.start_time >= s.chunk_start
      AND u.start_time < s.chunk_start + 5""",
)
def interval_join(spark, d):
    spine = rel.chunk_spine(v.subject_lengths(spark, d), "total", v.CHUNK_SECONDS)
    said = v.participants(spark, d).select("conv_id", "turn", "start_time")
    return rel.interval_join(spine, said, "conv_id", "start_time", v.CHUNK_SECONDS).select(
        "conv_id", "chunk_id", "chunk_start", "turn"
    )


@query(
    "chunk_text_join",
    f"""WITH {v.TR}, w AS (SELECT conv_id, CAST(floor(start_time / 5) AS BIGINT) AS chunk_id, sum(length(text)) AS chars,
      count(*) AS utterances FROM utt GROUP BY 1, 2)
    SELECT s.conv_id, s.chunk_id, CAST(coalesce(w.chars, 0) AS BIGINT) AS chars,
      coalesce(w.utterances, 0) AS utterances FROM spine s LEFT JOIN w USING (conv_id, chunk_id)""",
)
def chunk_text_join(spark, d):
    """Chunks with the measures of their text, zeros where nothing was said."""
    spine = rel.chunk_spine(v.subject_lengths(spark, d), "total", v.CHUNK_SECONDS)
    measured = (
        v.participants(spark, d)
        .groupBy("conv_id", F.floor(F.col("start_time") / v.CHUNK_SECONDS).alias("chunk_id"))
        .agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("utterances"))
    )
    joined = spine.join(measured, ["conv_id", "chunk_id"], "left").drop("chunk_start", "total")
    return rel.with_defaults(joined, {"chars": 0, "utterances": 0})


@query(
    "record_baseline_join",
    f"""WITH {v.UD}, {BASE_SQL}, last AS (SELECT * FROM ud QUALIFY row_number() OVER
      (PARTITION BY user_id ORDER BY day DESC) = 1)
    SELECT user_id, round(level_mean, 6) AS level_mean, total_samples, round(base_level, 6) AS base_level
      FROM last LEFT JOIN bl USING (user_id)""",
)
def record_baseline_join(spark, d):
    days = v.stored_days(spark, d)
    last = latest_per_key(days, ["user_id"], "day", "n")
    joined = rel.join_baseline(last, user_baseline(days, "user_id", BASE, 26), "user_id", spread_by=["day"])
    return joined.select("user_id", r6("level_mean").alias("level_mean"), "total_samples", r6("base_level").alias("base_level"))


@query(
    "join_semi",
    """SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN
      (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def join_semi(spark, d):
    turns = table(spark, d, "conversations")
    return rel.existing(turns.select("conv_id").distinct(), turns.filter("role = 'system'"), ["conv_id"])


@query(
    "join_anti",
    """SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN
      (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def join_anti(spark, d):
    turns = table(spark, d, "conversations")
    return rel.missing(turns.select("conv_id").distinct(), turns.filter("role = 'system'"), ["conv_id"])


@query(
    "paired_diff",
    """WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a,
      avg(value) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1)
    SELECT user_id, round(a, 6) AS base_mean, round(b, 6) AS other_mean, round((b - a) / a * 100, 6) AS diff_pct
      FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def paired_diff(spark, d):
    out = rel.paired_difference(table(spark, d, "events"), "user_id", "event_type", "view", "purchase", "value")
    return out.select("user_id", *[r6(c).alias(c) for c in ("base_mean", "other_mean", "diff_pct")])


# --- sorts and sets --------------------------------------------------------------------


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rel.top_k(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query(
    "union_all",
    """SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'
      UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error'""",
)
def union_all(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return rel.union_all(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"))


@query("distinct_values", "SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


# --- scalar functions ------------------------------------------------------------------


@query(
    "string_functions",
    """SELECT page_id, replace(url, '.com', '') AS replaced, split_part(url, '/', 3) AS host, upper(url) AS up,
      lower(url) AS low, trim(concat('  ', url, ' ')) AS trimmed, concat_ws(' ', url, 'x') AS joined,
      regexp_extract(url, '([^/]+)$', 1) AS last_part, ends_with(url, 'top') AS ends_top,
      printf('%.1f', page_id / 3.0) AS shown FROM pages""",
)
def string_functions(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        F.replace(u, F.lit(".com"), F.lit("")).alias("replaced"),
        F.split_part(u, F.lit("/"), F.lit(3)).alias("host"),
        F.upper(u).alias("up"),
        F.lower(u).alias("low"),
        F.trim(F.concat(F.lit("  "), u, F.lit(" "))).alias("trimmed"),
        F.concat_ws(" ", u, F.lit("x")).alias("joined"),
        F.regexp_extract(u, "([^/]+)$", 1).alias("last_part"),
        u.endswith("top").alias("ends_top"),
        F.format_string("%.1f", F.col("page_id") / 3.0).alias("shown"),
    )


@query(
    "math_functions",
    """SELECT event_id, CASE WHEN value > 0 THEN round(log10(value), 6) END AS lg, round(value * value, 4) AS sq,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value / (event_id % 3), 6) END AS ratio,
      CAST(floor(value / 5) AS BIGINT) AS bin, round((value - 10) / 10 * 100, 4) AS pct FROM events""",
)
def math_functions(spark, d):
    x = F.col("value")
    return table(spark, d, "events").select(
        "event_id",
        r6(F.log10(x)).alias("lg"),
        F.round(F.pow(x, F.lit(2)), 4).alias("sq"),
        r6(F.try_divide(x, F.col("event_id") % 3)).alias("ratio"),
        F.floor(x / 5).alias("bin"),
        F.round((x - 10) / 10 * 100, 4).alias("pct"),
    )


@query(
    "array_functions",
    """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
    SELECT vec_id, len(x[9:24]) AS n, round(list_max(x), 9) AS top, list_position(x, list_max(x)) AS top_at,
      round(list_sum(x), 6) AS total, round(list_reverse(x)[1], 9) AS last FROM a""",
)
def array_functions(spark, d):
    x = F.col("x")
    arrays = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return arrays.select(
        "vec_id",
        F.size(F.slice(x, 9, 16)).cast("bigint").alias("n"),
        F.round(F.array_max(x), 9).alias("top"),
        F.array_position(x, F.array_max(x)).cast("int").alias("top_at"),
        r6(F.aggregate(x, F.lit(0.0), lambda a, b: a + b)).alias("total"),
        F.round(F.get(F.reverse(x), F.lit(0)), 9).alias("last"),
    )


@query(
    "map_functions",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS class_id,
      2 AS n_keys, value + user_id AS both_sum FROM events""",
)
def map_functions(spark, d):
    lookup = F.create_map(F.lit("error"), F.lit(2), F.lit("signup"), F.lit(1))
    merged = F.map_concat(
        F.create_map(F.lit("value"), F.col("value")),
        F.create_map(F.lit("user"), F.col("user_id").cast("double")),
    )
    e = table(spark, d, "events").withColumn("m", merged)
    return e.select(
        "event_id",
        F.coalesce(F.try_element_at(lookup, F.col("event_type")), F.lit(0)).alias("class_id"),
        F.size("m").alias("n_keys"),
        (F.try_element_at("m", F.lit("value")) + F.try_element_at("m", F.lit("user"))).alias("both_sum"),
    )


@query(
    "json_functions",
    """WITH j AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END AS t FROM events)
    SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(t, '$.k') AS INT) END AS k,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE json_extract_string(t, '$.k') END AS k_text,
      CASE WHEN event_id % 7 = 0 THEN '{"k":-1}' ELSE '{"k":' || json_extract_string(t, '$.k') || '}' END AS back
      FROM j""",
)
def json_functions(spark, d):
    """Every seventh text is cut off and must fall back to the default."""
    cut = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    j = table(spark, d, "events").select("event_id", cut.alias("t"))
    k = F.from_json("t", "k int").getField("k")
    return j.select(
        "event_id",
        k.alias("k"),
        F.get_json_object("t", "$.k").alias("k_text"),
        F.to_json(F.struct(F.coalesce(k, F.lit(-1)).alias("k"))).alias("back"),
    )
