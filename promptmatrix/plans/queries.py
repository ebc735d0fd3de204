"""Registered queries over the driver's tables, each with the SQL of the same result where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmatrix.functions import jsontext, prices, scorers, text
from promptmatrix.operators import matrix, requests, results, scoring
from promptmatrix.plans import demo
from promptmatrix.plans.demo import table
from promptmatrix.plans.registry import ORACLE, QUERIES, query
from promptmatrix.streaming import incremental

# -- Matrix ---------------------------------------------------------------


@query("SELECT variant, model, case_id, cell_ord FROM cells", base=True)
def matrix_expand(spark, d):
    return demo.cells(spark, d).select("variant", "model", "case_id", "cell_ord")


@query("SELECT variant, model, case_id, ((case_pos * 2 + (variant = 'tagged')::INT) * 2 + (model = 'fixed')::INT)::BIGINT AS cell_ord FROM cells", base=True)
def matrix_expand_source_order(spark, d):
    v, m = matrix.names(spark, "variant", list(demo.VARIANTS), "v_ord"), matrix.names(spark, "model", list(demo.MODELS), "m_ord")
    return matrix.product(v, m, demo.cases(spark, d), case_major=True).select("variant", "model", "case_id", "cell_ord")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def role_filter(spark, d):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "candidate").when(F.col("c_mktsegment") == "MACHINERY", "both").otherwise("judge")
    return matrix.candidates(table(spark, d, "customer").withColumn("role", role)).select("c_custkey")


@query("SELECT case_id FROM cases WHERE case_id IN (SELECT doc_id::VARCHAR FROM labels)", base=True)
def case_filter(spark, d):
    return matrix.only_cases(demo.cases(spark, d), table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("case_id"))).select("case_id")


@query("SELECT DISTINCT 'x' || doc_id AS case_id FROM labels WHERE toxic = 1")
def unknown_names(spark, d):
    wanted = table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("case_id"))
    return matrix.unknown_names(wanted, demo.cases(spark, d), "case_id")


@query("SELECT variant, model, case_id FROM results WHERE case_pos % 3 <> 0", base=True)
def resume_anti_join(spark, d):
    return matrix.remaining(demo.cells(spark, d), demo.cells(spark, d).where("case_pos % 3 = 0")).select(*matrix.KEY)


@query(
    """WITH b AS (SELECT doc_id // 65536 AS b, sha256(string_agg(doc_id::VARCHAR || chr(10), '' ORDER BY doc_id)) AS d FROM documents GROUP BY 1)
    SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b"""
)
def case_digest(spark, d):
    return matrix.ids_digest(demo.cases(spark, d))


# -- Rendering and requests -----------------------------------------------


@query("SELECT variant, case_id, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS chars FROM rendered WHERE model = 'echo'", base=True)
def render_text(spark, d):
    return demo.rendered(demo.cells(spark, d)).where("model = 'echo'").select("variant", "case_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.length("prompt").cast("long").alias("chars"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("string").alias("sha256"))
    turn = F.struct("turn", F.struct("role", F.array(part).alias("parts")).alias("m"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: t["m"]).alias("messages"))


@query("SELECT conv_id, count(*)::BIGINT AS turns, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def message_text(spark, d):
    return conversations(spark, d).select("conv_id", F.size("messages").cast("long").alias("turns"), F.md5(requests.message_text(F.col("messages")).cast("binary")).alias("text_md5"))


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), 'mock response') AS said FROM conversations GROUP BY conv_id")
def echo_last_user(spark, d):
    return conversations(spark, d).select("conv_id", requests.echo_last_user(F.col("messages")).alias("said"))


@query("SELECT conv_id, (sum(length(text)) // 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def token_count(spark, d):
    return conversations(spark, d).select("conv_id", requests.quarter(F.length(requests.message_text(F.col("messages")))).alias("tokens"))


@query(
    """SELECT doc_id, sha256('1' || chr(10) || 'mock' || chr(10) || '[{"role":"user","parts":[{"type":"text","text":' || to_json(text)::VARCHAR || '}]}]') AS request_key FROM documents"""
)
def request_key(spark, d):
    none = F.lit(None).cast("string")
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), none.alias("media_type"), none.alias("sha256"), F.lit("ignored").alias("source"))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.array(part).alias("parts")))
    return table(spark, d, "documents").select("doc_id", requests.request_key(F.lit("mock"), messages).alias("request_key"))


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("request_key"), F.col("doc_id").alias("cell_ord"), "lang")


@query("SELECT doc_id AS cell_ord, doc_id = min(doc_id) OVER (PARTITION BY text) AS called, doc_id <> min(doc_id) OVER (PARTITION BY text) AS cached FROM documents")
def single_flight(spark, d):
    return requests.single_flight(keyed(spark, d)).select("cell_ord", "called", "cached")


def responses(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).where("cell_ord % 3 = 0").groupBy("request_key").agg(F.min("cell_ord").alias("response"))


@query("SELECT d.doc_id AS cell_ord, r.response, r.response IS NOT NULL AS cached FROM documents d LEFT JOIN (SELECT text, min(doc_id) AS response FROM documents WHERE doc_id % 3 = 0 GROUP BY text) r USING (text)")
def cache_join(spark, d):
    return requests.with_cache(keyed(spark, d), responses(spark, d)).select("cell_ord", "response", "cached")


@query("SELECT sha256(text) AS request_key, min(doc_id) AS cell_ord, arg_min(lang, doc_id) AS lang FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY text")
def calls_to_make(spark, d):
    return requests.to_call(requests.with_cache(keyed(spark, d), responses(spark, d)).drop("response")).select("request_key", "cell_ord", "lang")


@query("SELECT event_id, CASE WHEN floor(value) = value AND value >= 0 THEN value::BIGINT END AS tokens FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN floor(value) ELSE value END AS value FROM events)")
def usage_numbers(spark, d):
    value = F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("double")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", requests.usage(value).alias("tokens"))


@query(
    """WITH p(model, pin, pout) AS (VALUES ('gpt-4o', 2.5::DOUBLE, 10.0::DOUBLE), ('o1', 15.0::DOUBLE, 60.0::DOUBLE)),
    c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'o1' ELSE 'local' END AS model, n_chars // 4 AS i, n_chars // 8 AS o FROM documents)
    SELECT doc_id, model, round((i * pin + o * pout) / 1000000, 8) AS cost_usd FROM c LEFT JOIN p USING (model)"""
)
def price_cost(spark, d):
    model = F.when(F.col("doc_id") % 3 == 0, "gpt-4o").when(F.col("doc_id") % 3 == 1, "o1").otherwise("local")
    calls = table(spark, d, "documents").select("doc_id", model.alias("model"), F.floor(F.col("n_chars") / 4).alias("i"), F.floor(F.col("n_chars") / 8).alias("o"))
    return requests.with_price(calls, prices.table(spark)).select("doc_id", "model", requests.cost(F.col("i"), F.col("o"), F.col("price_in"), F.col("price_out")).alias("cost_usd"))


@query(
    """WITH g AS (SELECT lang, count(*) AS cells, max(n_chars) // 4 AS tokens FROM documents GROUP BY lang),
    m(model, most, pin, pout) AS (VALUES ('gpt-4o', 200, 2.5::DOUBLE, 10.0::DOUBLE), ('o1', NULL, 15.0::DOUBLE, 60.0::DOUBLE), ('local', NULL, NULL, NULL)),
    c AS (SELECT model, round((tokens * cells * pin + coalesce(most, 500) * cells * pout) / 1000000, 8) AS usd FROM g, m)
    SELECT round(sum(usd), 4) AS usd, 'local' AS unpriced FROM c"""
)
def run_estimate(spark, d):
    groups = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("cells"), F.floor(F.max("n_chars") / 4).alias("input_tokens"))
    models = spark.createDataFrame([("gpt-4o", 200), ("o1", None), ("local", None)], "model string, max_tokens long")
    priced = requests.with_price(groups.join(F.broadcast(models), how="cross"), prices.table(spark))
    return requests.estimate(priced).select("usd", F.array_join("unpriced", ",").alias("unpriced"))


@query(
    """SELECT event_id FROM (SELECT event_id, coalesce(sum(round(value, 6)::DECIMAL(38,10)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
    WHERE before < (SELECT round(sum(value) / 3) FROM events)"""
)
def budget_prefix(spark, d):
    events = table(spark, d, "events").select("event_id", F.round("value", 6).alias("cost_usd"))
    limit = table(spark, d, "events").agg(F.round(F.sum("value") / 3)).first()[0]
    return requests.within_budget(events, limit, order="event_id").select("event_id")


@query("SELECT event_id FROM events WHERE event_id <= (SELECT coalesce(min(event_id) FILTER (WHERE event_type = 'error' AND event_id > 50), 1000000000) FROM events)")
def fail_fast_prefix(spark, d):
    events = table(spark, d, "events").withColumn("passed", (F.col("event_type") != "error") | (F.col("event_id") <= 50))
    return requests.until_failure(events, "event_id").select("event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECOND PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM events")
def rate_window(spark, d):
    return requests.in_window(table(spark, d, "events"), "ts", 60, "event_type").select("event_id", "in_window")


# -- Scoring --------------------------------------------------------------


def graded(spark: SparkSession, d: str, spec: dict) -> DataFrame:
    scored = scorers.bind(spec["type"], {k: v for k, v in spec.items() if k != "type"})
    runs = demo.completed(spark, d)
    none = F.lit(None).cast("string")
    entry = scorers.entry("c", 1.0, scored(scorers.Inputs(F.col("output"), F.col("expected"), none, none)))
    return runs.withColumn("e", entry).select("variant", "model", "case_id", "e.score", "e.passed")


def _pair(condition: str) -> str:
    return f"SELECT variant, model, case_id, coalesce(({condition})::INT, 0)::DOUBLE AS score, coalesce({condition}, false) AS passed FROM completed"


@query(_pair("trim(lower(output), E' \\t\\n\\r') = 'the answer is en'"), base=True)
def score_exact(spark, d):
    return graded(spark, d, {"type": "exact", "value": " The answer is EN\n", "case_sensitive": False})


@query(_pair("contains(output, lang)"), base=True)
def score_contains(spark, d):
    return graded(spark, d, {"type": "contains"})


@query(_pair("NOT contains(output, 'idiot')"), base=True)
def score_not_contains(spark, d):
    return graded(spark, d, {"type": "not-contains", "value": "idiot"})


@query(_pair("regexp_matches(output, 'th[ae]+ [a-m]')"), base=True)
def score_regex(spark, d):
    return graded(spark, d, {"type": "regex", "pattern": "th[ae]+ [a-m]"})


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", jsontext.field(F.col("props"), "k").alias("k"))


def _graded_events(spark: SparkSession, d: str, output, spec: dict, label=None) -> DataFrame:
    scored = scorers.bind(spec["type"], {k: v for k, v in spec.items() if k != "type"})
    none = F.lit(None).cast("string")
    e = scored(scorers.Inputs(output, none, none if label is None else label, none))
    return table(spark, d, "events").withColumn("e", scorers.entry("c", 1.0, e)).select("event_id", "e.score", "e.passed")


@query("SELECT event_id, (event_id % 4 <> 0)::INT::DOUBLE AS score, event_id % 4 <> 0 AS passed FROM events")
def score_json_valid(spark, d):
    output = F.when(F.col("event_id") % 4 == 0, "no json here: {broken").when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure!\n```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), F.col("props"), F.lit(" indeed")))
    return _graded_events(spark, d, output, {"type": "json-valid"})


@query("SELECT event_id, (json_extract_string(props, '$.k')::DOUBLE < 50)::INT::DOUBLE AS score, json_extract_string(props, '$.k')::DOUBLE < 50 AS passed FROM events")
def score_json_schema(spark, d):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "exclusiveMaximum": 50}}}
    return _graded_events(spark, d, F.col("props"), {"type": "json-schema", "schema": schema})


@query("SELECT event_id, (json_extract_string(props, '$.k')::INT = event_id % 100)::INT::DOUBLE AS score, json_extract_string(props, '$.k')::INT = event_id % 100 AS passed FROM events")
def score_agreement_exact(spark, d):
    return _graded_events(spark, d, F.col("props"), {"type": "agreement", "field": "k"}, (F.col("event_id") % 100).cast("string"))


@query("SELECT event_id, (abs(json_extract_string(props, '$.k')::INT - event_id % 100) <= 10)::INT::DOUBLE AS score, abs(json_extract_string(props, '$.k')::INT - event_id % 100) <= 10 AS passed FROM events")
def score_agreement_within(spark, d):
    return _graded_events(spark, d, F.col("props"), {"type": "agreement", "field": "k", "mode": "within", "tolerance": 10}, (F.col("event_id") % 100).cast("string"))


@query("SELECT event_id, least((event_id % 7)::DOUBLE / 5, 1.0::DOUBLE) AS score, event_id % 7 >= 3 AS passed FROM events")
def judge_verdict(spark, d):
    output = F.concat(F.lit('The verdict: {"score": '), (F.col("event_id") % 7).cast("string"), F.lit(', "rationale": "ok"}'))
    return _graded_events(spark, d, output, {"type": "llm-judge", "scale": 5, "pass_at": 0.6})


@query("SELECT variant, model, case_id, (length(output) % 2 = 0 AND output IS NOT NULL)::INT::DOUBLE AS score, output IS NOT NULL AND length(output) % 2 = 0 AS passed FROM completed", base=True)
def score_python(spark, d):
    scored = scorers.python({}, function=lambda output, case: len(output) % 2 == 0)
    none = F.lit(None).cast("string")
    e = scorers.entry("c", 1.0, scored(scorers.Inputs(F.col("output"), none, none, none)))
    return demo.completed(spark, d).withColumn("e", e).select("variant", "model", "case_id", "e.score", "e.passed")


@query("SELECT variant, model, case_id, cell_score, passed FROM results", base=True)
def cell_score(spark, d):
    return demo.results(spark, d).select("variant", "model", "case_id", "cell_score", "passed")


# -- Aggregates -----------------------------------------------------------

_STATS = "count(*)::BIGINT AS cases, coalesce(round(sum(cell_score::DECIMAL(38,10))::DOUBLE / count(*), 6), 0.0) AS score, coalesce(round(count(*) FILTER (WHERE passed)::DOUBLE / count(*), 6), 0.0) AS pass_rate, count(error)::BIGINT AS errors"


@query(f"SELECT variant, model, {_STATS} FROM results GROUP BY variant, model", base=True)
def matrix_aggregate(spark, d):
    return scoring.matrix(demo.results(spark, d))


@query(f"SELECT {_STATS} FROM results", base=True)
def overall_aggregate(spark, d):
    return scoring.overall(demo.results(spark, d))


@query("SELECT 0::BIGINT AS cases, 0.0::DOUBLE AS score, 0.0::DOUBLE AS pass_rate, 0::BIGINT AS errors")
def overall_of_nothing(spark, d):
    return scoring.overall(demo.results(spark, d).where("case_pos < 0"))


@query(
    """SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE error IS NULL)::BIGINT AS succeeded, count(error)::BIGINT AS failed, count(*) FILTER (WHERE cached)::BIGINT AS cached,
    sum(input_tokens)::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, round(sum(cost_usd::DECIMAL(38,10)) FILTER (WHERE NOT cached)::DOUBLE, 10) AS cost_usd FROM completed""",
    base=True,
)
def run_totals(spark, d):
    return scoring.totals(demo.completed(spark, d))


@query(
    f""", o AS (SELECT {_STATS} FROM results), b AS (SELECT {_STATS} FROM results WHERE case_pos % 2 = 0)
    SELECT 'min_pass_rate' AS name, pass_rate >= 0.05 AS passed FROM o UNION ALL SELECT 'min_score', score >= 0.3 FROM o
    UNION ALL SELECT 'baseline', o.score >= b.score AND o.pass_rate >= b.pass_rate FROM o, b""",
    base=True,
)
def gate_checks(spark, d):
    r = demo.results(spark, d)
    return scoring.gate(scoring.overall(r), 0.05, 0.3, scoring.overall(r.where("case_pos % 2 = 0"))).select("name", "passed")


@query("SELECT unnest(['answer', 'clean', 'digits', 'lang']) AS criterion")
def criteria_set(spark, d):
    return scoring.criteria(demo.results(spark, d))


@query("SELECT case_id, bool_and(passed) AS passed, count(*)::BIGINT AS cells FROM results GROUP BY case_id", base=True)
def case_all_pass(spark, d):
    return scoring.case_passed(demo.results(spark, d))


@query(
    f""", a AS (SELECT variant, model, {_STATS} FROM results WHERE case_pos % 2 = 0 AND NOT (variant = 'plain' AND model = 'fixed') GROUP BY variant, model),
    b AS (SELECT variant, model, {_STATS} FROM results WHERE case_pos % 2 = 1 AND NOT (variant = 'tagged' AND model = 'fixed') GROUP BY variant, model)
    SELECT variant, model, a.score AS score_a, a.pass_rate AS pass_rate_a, b.score AS score_b, b.pass_rate AS pass_rate_b,
           CASE WHEN a.score IS NULL THEN 'only_b' WHEN b.score IS NULL THEN 'only_a' ELSE 'both' END AS side,
           round(b.score - a.score, 6) AS score_delta, round(b.pass_rate - a.pass_rate, 6) AS pass_rate_delta
    FROM a FULL JOIN b USING (variant, model)""",
    base=True,
)
def compare_runs(spark, d):
    r = demo.results(spark, d)
    a = r.where("case_pos % 2 = 0 AND NOT (variant = 'plain' AND model = 'fixed')")
    b = r.where("case_pos % 2 = 1 AND NOT (variant = 'tagged' AND model = 'fixed')")
    return scoring.compare(scoring.matrix(a), scoring.matrix(b))


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def groups_in_both(spark, d):
    items = table(spark, d, "lineitem")
    return scoring.in_both(items.where("l_returnflag = 'R'"), items.where("l_linestatus = 'O'"), "l_suppkey")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def groups_in_one(spark, d):
    return scoring.only_in(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT doc_id, 'new' AS run FROM documents UNION ALL SELECT doc_id, 'old' FROM labels")
def records_of_both(spark, d):
    return scoring.of_both(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "new", "old")


# -- Reading results ------------------------------------------------------


@query("SELECT variant, model, case_id, cell_ord FROM results WHERE NOT passed ORDER BY cell_ord LIMIT 20", base=True)
def failures_first(spark, d):
    return results.failures(demo.results(spark, d), 20).select("variant", "model", "case_id", "cell_ord")


@query("SELECT variant, model, case_id, cell_score FROM results WHERE NOT passed", base=True)
def failures_all(spark, d):
    return results.failures(demo.results(spark, d)).select("variant", "model", "case_id", "cell_score")


@query("SELECT cell_ord, variant, model, case_id FROM cells ORDER BY cell_ord LIMIT 20 OFFSET 40", base=True)
def results_page(spark, d):
    return results.page(demo.cells(spark, d), 3).select("cell_ord", "variant", "model", "case_id")


@query("SELECT variant, model, case_id, cell_score FROM results WHERE variant = 'tagged' AND model = 'echo' AND case_id = '7'", base=True)
def result_lookup(spark, d):
    return results.one(demo.results(spark, d), "tagged", "echo", "7").select("variant", "model", "case_id", "cell_score")


@query("SELECT variant, model, passed, cell_score FROM results WHERE case_id = '12'", base=True)
def case_drill_down(spark, d):
    return results.drill_down(demo.results(spark, d), "12").select("variant", "model", "passed", "cell_score")


@query("SELECT * FROM (SELECT case_id, variant, model, passed, min(passed::INT) OVER (PARTITION BY case_id) = 1 AS case_passed FROM results) ORDER BY case_passed, case_id, passed, variant, model LIMIT 200", base=True)
def report_order(spark, d):
    return results.for_report(demo.results(spark, d)).select("case_id", "variant", "model", "passed", "case_passed").limit(200)


@query(
    """SELECT variant, model, case_id, cell_score, passed AS cell_passed, p1::INT::DOUBLE AS "score:answer", p3::INT::DOUBLE AS "score:clean", p4::INT::DOUBLE AS "score:digits", p2::INT::DOUBLE AS "score:lang",
    p1 AS "passed:answer", p3 AS "passed:clean", p4 AS "passed:digits", p2 AS "passed:lang", cached, input_tokens, output_tokens, cost_usd, error,
    CASE WHEN regexp_matches(output, '^ *[=+@-]') THEN '''' || output ELSE output END AS output FROM results""",
    base=True,
)
def csv_wide(spark, d):
    return results.wide(demo.results(spark, d), ["answer", "lang", "clean", "digits"])


@query("SELECT conv_id::VARCHAR AS case_id, arg_max(text, turn) AS human_label FROM conversations GROUP BY conv_id")
def latest_labels(spark, d):
    return results.latest_labels(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("case_id"), F.col("text").alias("human_label"), F.col("turn").alias("pos")))


@query("SELECT case_id, variant, model, md5(output) AS output_md5, quality AS human_label FROM completed JOIN labels ON case_id = doc_id::VARCHAR WHERE variant = 'plain' AND model = 'echo' AND error IS NULL", base=True)
def calibration_join(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("case_id"), F.col("quality").alias("human_label"))
    out = results.calibration(demo.completed(spark, d), labels)
    return out.select("case_id", "variant", "model", F.md5(F.col("output").cast("binary")).alias("output_md5"), "human_label")


@query("SELECT 'case-' || substr(sha256(doc_id::VARCHAR), 1, 16) AS case_id FROM documents")
def hash_case_id(spark, d):
    return demo.cases(spark, d).select(text.hash_case_id(F.col("case_id")).alias("case_id"))


@query(
    """SELECT variant, model, 'case-' || substr(sha256(case_id), 1, 16) AS case_id, NULL::VARCHAR AS output, CASE WHEN error IS NOT NULL THEN 'ProviderError HTTP 400' END AS error, cell_score, passed FROM results""",
    base=True,
)
def redacted_results(spark, d):
    return results.redacted(demo.results(spark, d)).select("variant", "model", "case_id", "output", "error", "cell_score", "passed")


@query("SELECT sha256(html) AS sha256, 'text/html' AS media_type, min(url) AS path, count(*)::BIGINT AS uses FROM pages GROUP BY html")
def artifact_dedup(spark, d):
    media = table(spark, d, "pages").select(F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.lit("text/html").alias("media_type"), F.col("url").alias("path"))
    return results.artifacts(media)


@query("SELECT o_orderkey::VARCHAR AS id FROM orders ORDER BY epoch_us(o_orderdate) DESC, o_orderkey::VARCHAR DESC LIMIT 20")
def run_listing(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_ns"))
    return results.latest_runs(runs).select("id")


@query("SELECT arg_max(o_orderkey::VARCHAR, (epoch_us(o_orderdate), o_orderkey::VARCHAR)) AS id FROM orders WHERE o_orderpriority = '1-URGENT'")
def run_by_label(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_ns"), F.col("o_orderpriority").alias("label"))
    return results.by_label(runs, "1-URGENT")


# -- Text -----------------------------------------------------------------


@query("SELECT doc_id, md5(trim('  ' || chr(9) || text || chr(10) || ' ', E' \\t\\n\\r')) AS stripped_md5 FROM documents")
def strip_text(spark, d):
    padded = F.concat(F.lit("  \t"), F.col("text"), F.lit("\n "))
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip(padded).cast("binary")).alias("stripped_md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS snip FROM documents")
def snip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snip(F.col("text"), 60).alias("snip"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages""")
def escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("escaped_md5"))


@query("SELECT doc_id, md5(regexp_replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), '\\s*\\n\\s*', ' ', 'g')) AS cell_md5 FROM documents")
def escape_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.escape_markdown(F.col("text")).cast("binary")).alias("cell_md5"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '''' ELSE '' END || CASE event_id % 3 WHEN 0 THEN ' =1+1' ELSE 'safe' END AS cell FROM events")
def guard_formula(spark, d):
    return table(spark, d, "events").select("event_id", text.guard_formula(F.when(F.col("event_id") % 3 == 0, " =1+1").otherwise("safe")).alias("cell"))


_STOP = "['the', 'of', 'and', 'to', 'in', 'a', 'is']"


@query(
    f"""WITH q AS (SELECT conv_id AS q_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))) AS w FROM conversations WHERE turn = 0),
    p AS (SELECT item_id AS p_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))) AS w FROM benchmark),
    s AS (SELECT q_id, p_id, len(list_intersect(q.w, p.w)) AS n, len(q.w) AS nq, len(p.w) AS np FROM q, p),
    t AS (SELECT q_id, p_id, round(greatest(n::DOUBLE / (nq + np - n), 0.5 * n::DOUBLE / nq), 4) AS score FROM s WHERE n > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id)::INT AS rank FROM t)
    SELECT q_id, rank, p_id, score FROM r WHERE rank <= 3"""
)
def retrieval_top_k(spark, d):
    questions = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("q_id"), F.col("text").alias("question"))
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("p_id"), "text")
    return results.retrieved(questions, passages, 3, ["the", "of", "and", "to", "in", "a", "is"])


@query("SELECT doc_id, CASE WHEN contains(text, 'license') THEN 'legal' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') THEN 'loud' ELSE 'other' END AS category FROM documents")
def keyword_classifier(spark, d):
    rules = {"license": "legal", "|": "table", "!!": "loud"}
    return table(spark, d, "documents").select("doc_id", results.first_keyword(F.col("text"), rules, "other").alias("category"))


@query(
    """WITH s AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents)),
    n AS (SELECT doc_id, i, s, len(list_intersect(list_distinct(string_split(lower(s), ' ')), ['the', 'and', 'that'])) AS hits FROM s)
    SELECT doc_id, trim(arg_max(s, (hits, -length(s), -i))) AS sentence FROM n GROUP BY doc_id"""
)
def best_sentence(spark, d):
    return results.best_sentence(table(spark, d, "documents"), "doc_id", "text", ["the", "and", "that"])


# -- Streaming ------------------------------------------------------------


@query("SELECT event_type AS variant, (user_id % 3)::VARCHAR AS model, count(*)::BIGINT AS cases, count(*) FILTER (WHERE value > 50)::BIGINT AS passed FROM events GROUP BY ALL")
def streaming_matrix(spark, d):
    return incremental.matrix_of_events(spark, d)


@query("SELECT date_trunc('day', ts) AS day, count(*)::BIGINT AS calls, round(sum(value), 4) AS spend FROM events GROUP BY 1")
def calls_by_day(spark, d):
    """An extension: calls and spend in tumbling windows of event time."""
    w = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").cast("long").alias("calls"), F.round(F.sum("value"), 4).alias("spend"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "calls", "spend")


from promptmatrix.plans import project_queries  # noqa: E402, F401  (registers its queries)

__all__ = ["ORACLE", "QUERIES"]
