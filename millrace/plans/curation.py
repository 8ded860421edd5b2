"""Queries over texts and records: strings, cleaning, validators, scores, statistics, shards and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import records as R
from millrace.functions import text as X
from millrace.operators import statistics as S
from millrace.operators import validation as V
from millrace.operators.training import train_split
from millrace.plans.catalog import query, read


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents")


def _q(pattern: str) -> str:
    """A regular expression as a SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


CLEAN = f"trim(regexp_replace(regexp_replace(text, {_q(X.SPACE + '+')}, ' ', 'g'), {_q(X.NOT_CLEAN)}, '', 'g'))"
STRIP = f"regexp_replace(text, {_q(f'^{X.SPACE}+|{X.SPACE}+$')}, '', 'g')"
WORDS = f"len(list_filter(string_split_regex(text, {_q(X.SPACE + '+')}), lambda w: w <> ''))"


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query("str_lower_upper_strip", f"SELECT doc_id, lower(source) AS low, upper(source) AS up, {STRIP} AS stripped FROM documents")
def str_lower_upper_strip(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.string_op(F.col("source"), "lower").alias("low"), X.string_op(F.col("source"), "upper").alias("up"), X.string_op(F.col("text"), "strip").alias("stripped"))


@query("str_replace", "SELECT doc_id, replace(text, 'the', 'THE') AS literal, regexp_replace(text, '[0-9]+', '#', 'g') AS regex FROM documents")
def str_replace(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(s, d).select("doc_id", X.string_op(t, "replace", "the", "THE").alias("literal"), X.string_op(t, "replace", "[0-9]+", "#", regex=True).alias("regex"))


@query("str_contains", "SELECT doc_id, regexp_matches(text, 'sensor|camera') AS hit FROM documents")
def str_contains(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.string_op(F.col("text"), "contains", "sensor|camera").alias("hit"))


@query("text_clean", f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def text_clean(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query("text_normalize", f"SELECT doc_id, trim(regexp_replace(text, {_q(X.SPACE + '+')}, ' ', 'g')) AS normalized FROM documents")
def text_normalize(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.normalize(F.col("text")).alias("normalized"))


@query("text_length_filter", f"SELECT doc_id, length(c) AS text_length FROM (SELECT doc_id, {CLEAN} AS c FROM documents) WHERE length(c) BETWEEN 10 AND 4096")
def text_length_filter(s: SparkSession, d: str) -> DataFrame:
    c = _docs(s, d).select("doc_id", X.clean(F.col("text")).alias("c"))
    return c.filter(F.length("c").between(10, 4096)).select("doc_id", F.length("c").alias("text_length"))


@query("text_reject_reason", f"""SELECT doc_id, CASE WHEN text IS NULL THEN 'No text field' WHEN length(c) < 10 OR length(c) > 4096 THEN 'length_filter'
    WHEN {_any('c', X.BOILERPLATE)} THEN 'boilerplate' END AS reason FROM (SELECT doc_id, text, {CLEAN} AS c FROM documents)""")
def text_reject_reason(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.reject_reason(F.col("text")).alias("reason"))


@query("text_quality", f"""SELECT doc_id, round(CASE WHEN text IS NULL OR length({STRIP}) < 10 THEN 0.0 ELSE (CASE WHEN length(text) < 50 THEN 0.8 ELSE 1.0 END)
    * (CASE WHEN {WORDS} < 5 THEN 0.7 ELSE 1.0 END) END, 6)::DOUBLE AS quality FROM documents""")
def text_quality(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.round(X.text_quality(F.col("text")), 6).alias("quality"))


_FORMAT = " OR ".join(f"regexp_matches(text, {_q(p)})" for p in X.STRUCTURED)


@query("instruction_format", f"SELECT doc_id, CASE WHEN {_FORMAT} THEN 'structured' ELSE 'natural_language' END AS format FROM documents")
def instruction_format(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.instruction_format(F.col("text")).alias("format"))


_IQ = f"(CASE WHEN length(text) < 5 THEN 0.3 WHEN length(text) > 1000 THEN 0.8 ELSE 1.0 END) * (CASE WHEN {_any('text', X.QUALITY_ISSUES)} THEN 0.5 ELSE 1.0 END)"


@query("instruction_quality", f"SELECT doc_id, round({_IQ}, 6)::DOUBLE AS quality FROM documents")
def instruction_quality(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.round(X.instruction_quality(F.col("text")), 6).alias("quality"))


@query("instruction_grounding", f"""SELECT doc_id, length(text) AS instruction_length, round({_IQ}, 6)::DOUBLE AS instruction_quality_score, false AS has_trajectory, 0.0::DOUBLE AS instruction_alignment_score
    FROM documents WHERE length(text) >= 5""")
def instruction_grounding(s: SparkSession, d: str) -> DataFrame:
    out = V.ground_instructions(_docs(s, d))
    return out.select("doc_id", "instruction_length", F.round("instruction_quality_score", 6).alias("instruction_quality_score"), "has_trajectory", F.col("instruction_alignment_score").cast("double"))


_KIND_DOCS = "CASE WHEN lower(format) IN ('video', 'cosmos_dreams') THEN 'video' WHEN lower(format) IN ('text', 'json', 'jsonl') THEN 'text' WHEN text IS NOT NULL THEN 'text' ELSE 'unknown' END"
_KIND_GROOT = "CASE WHEN lower(data_type) IN ('video', 'text', 'sensor', 'binary', 'unknown') THEN lower(data_type) WHEN sensor_data IS NOT NULL THEN 'sensor' ELSE 'unknown' END"


@query("type_inference", f"SELECT doc_id, {_KIND_DOCS} AS kind, CASE WHEN text IS NOT NULL THEN ['text'] ELSE [] END AS modalities FROM documents")
def type_inference(s: SparkSession, d: str) -> DataFrame:
    df = _docs(s, d)
    return df.select("doc_id", R.data_type(df).alias("kind"), R.modalities(df).alias("modalities"))


@query("type_inference_declared", f"SELECT row_id, {_KIND_GROOT} AS kind FROM test_groot")
def type_inference_declared(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot")
    return df.select("row_id", R.data_type(df).alias("kind"))


@query("extract_field", "SELECT row_id, sensor_data.joint_positions AS joints, coalesce(task_id, groot_metadata.task_id, 'none') AS task FROM test_groot")
def extract_field(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "test_groot")
    return df.select("row_id", R.extract_field(df, "joint_positions").alias("joints"), R.extract_field(df, "task_id", "none", [["groot_metadata"]]).alias("task"))


_MISSING = "list_filter([CASE WHEN kind = 'text' AND text IS NULL THEN 'text' END, CASE WHEN kind = 'text' AND format IS NULL THEN 'format' END], lambda x: x IS NOT NULL)"


@query("completeness", f"""SELECT doc_id, missing_fields, 1 - len(missing_fields) / (CASE WHEN kind = 'text' THEN 2 ELSE 1 END) AS completeness_score, len(missing_fields) = 0 AS is_valid
    FROM (SELECT doc_id, kind, {_MISSING} AS missing_fields FROM (SELECT *, {_KIND_DOCS} AS kind FROM documents))""")
def completeness(s: SparkSession, d: str) -> DataFrame:
    return V.completeness(_docs(s, d)).select("doc_id", "missing_fields", "completeness_score", "is_valid")


@query("completeness_reject", f"SELECT doc_id FROM (SELECT *, {_KIND_DOCS} AS kind FROM documents) WHERE NOT (kind = 'text' AND (text IS NULL OR format IS NULL))")
def completeness_reject(s: SparkSession, d: str) -> DataFrame:
    return V.completeness(_docs(s, d), allow_partial=False).select("doc_id")


@query("cross_modal", """SELECT event_id, detected_modalities, list_filter([CASE WHEN NOT list_contains(detected_modalities, 'text') THEN 'missing:text' END,
    CASE WHEN len(detected_modalities) > 1 AND event_id % 10 / 16.0 > 0.1 THEN 'temporal_misalignment' END], lambda x: x IS NOT NULL) AS cross_modal_violations FROM
    (SELECT event_id, list_filter([CASE WHEN event_id % 3 <> 0 THEN 'sensor' END, CASE WHEN event_id % 4 <> 0 THEN 'text' END], lambda x: x IS NOT NULL) AS detected_modalities FROM events)""")
def cross_modal(s: SparkSession, d: str) -> DataFrame:
    df = read(s, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 3 <> 0 THEN value END AS observations", "CASE WHEN event_id % 4 <> 0 THEN event_type END AS text",
        "double(event_id) AS sensor_timestamp", "event_id + event_id % 10 / 16.0 AS text_timestamp",
    )
    return V.cross_modal(df, ("text",)).select("event_id", "detected_modalities", "cross_modal_violations")


@query("physics_limits", f"""SELECT row_id, CASE WHEN kind <> 'sensor' THEN [] ELSE list_concat(coalesce(list_filter([CASE WHEN x > 2.001 OR x < -2.001 THEN 'position:joint_' || (i - 1) END
    for x, i in joints], lambda v: v IS NOT NULL), []), CASE WHEN sensor_data IS NULL THEN ['no_sensor_data'] ELSE [] END) END AS violations
    FROM (SELECT *, sensor_data.joint_positions AS joints, {_KIND_GROOT} AS kind FROM test_groot)""")
def physics_limits(s: SparkSession, d: str) -> DataFrame:
    return V.physics(read(s, d, "test_groot"), position=(-2.0, 2.0), rejecting=False).select("row_id", "violations")


@query("schema_validate", """SELECT o_orderkey, list_filter([CASE WHEN o_orderpriority IS NULL THEN 'missing:o_orderpriority' END, CASE WHEN o_totalprice < 1000 OR o_totalprice > 300000 THEN 'range:o_totalprice' END,
    'type:o_orderstatus', 'missing:o_comment', 'unexpected:o_orderdate'], lambda x: x IS NOT NULL) AS schema_errors FROM orders""")
def schema_validate(s: SparkSession, d: str) -> DataFrame:
    expected = {"o_orderkey": "int", "o_custkey": "int", "o_orderpriority": "str", "o_totalprice": ("float", 1000.0, 300000.0), "o_orderstatus": "int", "o_comment": "str"}
    out = V.schema(read(s, d, "orders"), expected)
    order = F.array_intersect(F.array(*[F.lit(x) for x in ("missing:o_orderpriority", "range:o_totalprice", "type:o_orderstatus", "missing:o_comment", "unexpected:o_orderdate")]), "schema_errors")
    return out.select("o_orderkey", order.alias("schema_errors"))


_FLAGS = "list_filter([CASE WHEN format IS NULL THEN 'missing_data_type_or_format' END, CASE WHEN lower(coalesce(format, 'unknown')) = 'text' AND text IS NULL THEN 'text_missing_data' END], lambda x: x IS NOT NULL)"


@query("corruption_flags", f"SELECT doc_id, {_FLAGS} AS corruption_flags, len({_FLAGS}) > 0 AS is_corrupted FROM documents")
def corruption_flags(s: SparkSession, d: str) -> DataFrame:
    return V.corruption(_docs(s, d), checksum=False).select("doc_id", "corruption_flags", "is_corrupted")


_TEXT_SCORE = f"CASE WHEN kind <> 'text' THEN 1.0 WHEN coalesce(text, '') = '' THEN 0.0 ELSE (CASE WHEN length(text) < 10 THEN 0.3 WHEN length(text) > 10000 THEN 0.8 ELSE 1.0 END) * (CASE WHEN {_any('text', X.BOILERPLATE_SHORT)} THEN 0.2 ELSE 1.0 END) END"


@query("quality_score", f"SELECT doc_id, round((3.0 + {_TEXT_SCORE}) / 4, 6)::DOUBLE AS quality_score FROM (SELECT *, {_KIND_DOCS} AS kind FROM documents)")
def quality_score(s: SparkSession, d: str) -> DataFrame:
    return V.quality(_docs(s, d)).select("doc_id", F.round("quality_score", 6).alias("quality_score"))


@query("anomaly_score", f"""SELECT doc_id, round(least(1.0, (CASE WHEN len({_FLAGS}) > 0 THEN 0.3 ELSE 0.0 END) + 0.2 * len({_MISSING}) + (CASE WHEN (3.0 + {_TEXT_SCORE}) / 4 < 0.8 THEN 0.0 ELSE 0.0 END)), 6)::DOUBLE AS anomaly_score
    FROM (SELECT *, {_KIND_DOCS} AS kind FROM documents)""")
def anomaly_score(s: SparkSession, d: str) -> DataFrame:
    scored = V.anomaly(V.quality(V.corruption(V.completeness(_docs(s, d)), checksum=False)))
    return scored.select("doc_id", F.round("anomaly_score", 6).alias("anomaly_score"))


_SANE = "text"
for _p in X.DANGEROUS:
    _SANE = f"regexp_replace({_SANE}, {_q('(?i)' + _p)}, '', 'g')"


@query("sanitize", f"SELECT doc_id, {STRIP.replace('text', 'clean')} AS clean FROM (SELECT doc_id, regexp_replace({_SANE}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS clean FROM documents)")
def sanitize(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", X.sanitize(F.col("text")).alias("clean"))


@query("quality_filter", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang = 'en' AND length(text) BETWEEN 100 AND 2000")
def quality_filter(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.stages import QualityFilter

    return QualityFilter(["text is not null", F.col("lang") == "en", F.length("text").between(100, 2000)]).transform(_docs(s, d)).select("doc_id")


@query("feature_engineering", "SELECT event_id, value * value AS feature_square, event_type = 'view' AS feature_is_view FROM events")
def feature_engineering(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.stages import FeatureEngineering

    stage = FeatureEngineering({"square": F.col("value") * F.col("value"), "is_view": "event_type = 'view'"})
    return stage.transform(read(s, d, "events")).select("event_id", "feature_square", "feature_is_view")


@query("data_aggregator", "SELECT event_type, round(avg(value), 6) AS mean_value, count(value) AS n FROM events GROUP BY 1")
def data_aggregator(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.stages import DataAggregator

    out = DataAggregator(group_by=["event_type"], aggregations={"value": ["mean", "count"]}).transform(read(s, d, "events"))
    return out.select("event_type", F.round("mean(value)", 6).alias("mean_value"), F.col("count(value)").alias("n"))


# --- statistics ---


@query("profile_columns", """SELECT 'o_totalprice' AS "column", count(o_totalprice) AS count, count(*) - count(o_totalprice) AS missing, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std,
    min(o_totalprice) AS min, max(o_totalprice) AS max, round(median(o_totalprice), 4) AS median FROM orders UNION ALL
    SELECT 'o_orderstatus', count(o_orderstatus), count(*) - count(o_orderstatus), NULL, NULL, NULL, NULL, NULL FROM orders""")
def profile_columns(s: SparkSession, d: str) -> DataFrame:
    p = S.profile(read(s, d, "orders"), ["o_totalprice", "o_orderstatus"])
    return p.select("column", "count", "missing", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", F.round("median", 4).alias("median"))


@query("iqr_outliers", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT 'value' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, (SELECT count(*) FROM events WHERE value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1)) AS outliers FROM q""")
def iqr_outliers(s: SparkSession, d: str) -> DataFrame:
    return S.iqr_outliers(read(s, d, "events"), ["value"], 0.5).select("column", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), "outliers")


@query("missing_rates", """SELECT c AS "column", n AS missing_count, n / t AS missing_rate FROM (SELECT 'text' AS c, count(*) - count(text) AS n, count(*) AS t FROM documents UNION ALL
    SELECT 'lang', count(*) - count(lang), count(*) FROM documents UNION ALL SELECT 'n_chars', count(*) - count(n_chars), count(*) FROM documents)""")
def missing_rates(s: SparkSession, d: str) -> DataFrame:
    return S.missing_rates(_docs(s, d), ["text", "lang", "n_chars"])


@query("zscore_columns", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS value_zscore, max(value) OVER () AS value_max FROM events")
def zscore_columns(s: SparkSession, d: str) -> DataFrame:
    return S.with_statistics(read(s, d, "events"), ["value"], ("max",)).select("event_id", F.round("value_zscore", 6).alias("value_zscore"), "value_max")


_HALVES = "SELECT value, event_id % 2 = 0 AS ref FROM events"


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(s, d, "events")
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1").withColumn("value", F.col("value") * 1.1)


@query("drift_psi", """WITH e AS (SELECT value FROM events WHERE event_id % 2 = 0), c AS (SELECT value * 1.1 AS value FROM events WHERE event_id % 2 = 1), b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM e),
    p AS (SELECT least(greatest(floor((value - lo) / w), 0), 9) AS bin, count(*) / sum(count(*)) OVER () AS p FROM e, b GROUP BY 1), q AS (SELECT least(greatest(floor((value - lo) / w), 0), 9) AS bin, count(*) / sum(count(*)) OVER () AS q FROM c, b GROUP BY 1)
    SELECT round(sum((q1 - p1) * ln(q1 / p1)), 6) AS psi FROM (SELECT coalesce(p, 0) + 1e-10 AS p1, coalesce(q, 0) + 1e-10 AS q1 FROM p FULL OUTER JOIN q USING (bin))""")
def drift_psi(s: SparkSession, d: str) -> DataFrame:
    return S.psi(*_halves(s, d), "value").select(F.round("psi", 6).alias("psi"))


@query("drift_ks", """WITH u AS (SELECT value AS x, 1 AS a, 0 AS b FROM events WHERE event_id % 2 = 0 UNION ALL SELECT value * 1.1, 0, 1 FROM events WHERE event_id % 2 = 1), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1)
    SELECT round(max(abs(fa - fb)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM g)""")
def drift_ks(s: SparkSession, d: str) -> DataFrame:
    return S.ks(*_halves(s, d), "value").select(F.round("ks", 6).alias("ks"))


@query("drift_chi2", """WITH g AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS r, count(*) FILTER (event_id % 2 = 1) AS c FROM events GROUP BY 1), e AS (SELECT c, r * (SELECT sum(c) FROM g) / (SELECT sum(r) FROM g) AS e FROM g)
    SELECT round(sum((c - e) ** 2 / e), 6) AS chi2, count(*) - 1 AS degrees FROM e""")
def drift_chi2(s: SparkSession, d: str) -> DataFrame:
    return S.chi_square(*_halves(s, d), "event_type").select(F.round("chi2", 6).alias("chi2"), "degrees")


@query("drift_new_categories", "SELECT count(*) AS new_categories, sum(n) AS new_rows FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1)")
def drift_new_categories(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    before = o.filter("o_orderkey % 2 = 0 and o_orderpriority not in ('1-URGENT', '2-HIGH')")
    return S.chi_square(before, o.filter("o_orderkey % 2 = 1"), "o_orderpriority").select("new_categories", "new_rows")


# --- shards and splits ---


def _md5(key: str, n: int) -> str:
    """The digest folded in 16-bit steps."""
    out = "0"
    for i in range(8):
        out = f"(({out}) * 65536 + cast(concat('0x', substr(md5({key}), {1 + 4 * i}, 4)) AS BIGINT)) % {n}"
    return out


@query("shard_md5", f"SELECT doc_id, {_md5('doc_id::VARCHAR', 16)} AS shard_id FROM documents")
def shard_md5(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.stages import shard

    return shard(_docs(s, d), 16, "hash", "doc_id").select("doc_id", "shard_id")


# The operators' fallback for rows without the keys is row_id: SQL has no equal of the row hash.
@query("shard_task", f"SELECT row_id, {_md5('coalesce(task_id, episode_id, row_id::VARCHAR)', 10)} AS shard_id FROM test_groot")
def shard_task(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.stages import shard

    return shard(read(s, d, "test_groot"), 10, "task_based", "row_id").select("row_id", "shard_id")


@query("shard_round_robin", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS shard_id FROM documents")
def shard_round_robin(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.stages import shard

    return shard(_docs(s, d), 8, "round_robin", "doc_id").select("doc_id", "shard_id")


@query("shard_stats", f"""SELECT count(*) AS shards, sum(n) AS rows, min(n) AS min_rows, max(n) AS max_rows, avg(n) AS avg_rows, round((max(n) - min(n)) / max(n), 6) AS imbalance
    FROM (SELECT {_md5('doc_id::VARCHAR', 16)} AS k, count(*) AS n FROM documents GROUP BY 1)""")
def shard_stats(s: SparkSession, d: str) -> DataFrame:
    return S.balance(shard_md5(s, d), "shard_id").withColumn("imbalance", F.round("imbalance", 6))


@query("split_md5", f"SELECT row_id, CASE WHEN {_md5('coalesce(episode_id, row_id::VARCHAR)', 100)} < 90 THEN 'train' ELSE 'val' END AS split FROM test_groot")
def split_md5(s: SparkSession, d: str) -> DataFrame:
    """All rows by train_split; row_id stands in as the path of rows without an episode."""
    return train_split(read(s, d, "test_groot").withColumn("path", F.col("row_id").cast("string"))).select("row_id", "split")
