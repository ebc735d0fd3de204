"""Functions, sources and operators on hand-made rows."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from promptmatrix import spec
from promptmatrix.errors import ConfigError, ContentError, ProviderError, ScoringError, SourceError, StoreError, TemplateError
from promptmatrix.functions import jsontext, prices, scorers, template, text
from promptmatrix.operators import matrix, requests, results, scoring
from promptmatrix.providers import calls
from promptmatrix.sources import cases, files, paged
from promptmatrix.sources.store import Store
from promptmatrix.streaming import waves


@pytest.mark.parametrize(
    ("source", "value"),
    [
        ('{"a": 1}', {"a": 1}),
        ('Sure:\n```json\n{"a": 2}\n```', {"a": 2}),
        ("```json{\"a\": 3}```", {"a": 3}),
        ("prose } then [1, 2] more", [1, 2]),
        ("[" * 63 + ' {"x": 1}', {"x": 1}),
        ('{"a": 1, "a": 2}', {"a": 2}),
        ("7", 7),
    ],
)
def test_lenient_json(source, value):
    assert jsontext.lenient(source) == value


@pytest.mark.parametrize("source", ["", "no json", "1 2", "[" * 64 + ' {"x": 1}', "[" * 100_000])
def test_not_json(source):
    with pytest.raises(jsontext.Unparsable):
        jsontext.lenient(source)


def test_json_schema():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"$ref": "#/$defs/s"}}, "$defs": {"s": {"anyOf": [{"type": "null"}, {"type": "string", "maxLength": 2}]}}}
    jsontext.check_schema(schema)
    bad = lambda v: list(jsontext.violations(v, schema))
    assert not bad({"a": 1}) and not bad({"a": 2.0, "b": None}) and not bad({"a": 1, "b": "xy"})
    assert bad({}) and bad({"a": True}) and bad({"a": 0}) and bad({"a": 1, "c": 1}) and bad({"a": 1, "b": "xyz"}) and bad([])
    with pytest.raises(ScoringError, match="not supported"):
        jsontext.check_schema({"unevaluatedItems": False})


@pytest.mark.parametrize(
    ("source", "context", "out"),
    [
        ("Hi {{ name }}!\n", {"name": "Bo"}, "Hi Bo!\n"),
        ("{{ a.b[0] }}{{ n + 1 }}", {"a": {"b": ["x"]}, "n": 2}, "x3"),
        ("{% if x > 1 %}many{% elif x == 1 %}one{% else %}none{% endif %}", {"x": 1}, "one"),
        ("{% for i in xs %}{{ loop.index }}{{ i|upper }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1A,2B"),
        ("{{ q|default('none') }} {{ x is defined }} {{ xs|join('-') }} {{ xs|length }}", {"xs": [1, 2]}, "none False 1-2 2"),
        ("a {#- note -#} b{{ '{' }}", {}, "a  b{"),
        ("a  {{- 'x' -}}  b", {}, "axb"),
        ("{{ d|tojson }}{{ 'a' in d }}{{ none }}", {"d": {"a": 1}}, '{"a": 1}TrueNone'),
    ],
)
def test_templates(source, context, out):
    assert template.render(source, context) == out


@pytest.mark.parametrize("source", ["{{ nope }}", "{{ a.nope }}", "{% if a %}", "{{ a b }}", "{{ a|nope }}", "{{ 1 % z }}", "{% include 'x' %}", "{{ open"])
def test_template_errors(source):
    with pytest.raises(TemplateError):
        template.render(source, {"a": {}, "z": 0})


def test_template_columns_agree(spark):
    df = spark.createDataFrame([("x", "  Y "), ("é", None)], "a string, b string")
    columns = {"a": F.col("a"), "b": F.col("b")}
    for source in ("{{ a }}", "A {{ a|upper }}: {{ b|trim|lower }}", "{{ b|default('-') }}"):
        assert template.native(source, columns) is not None
        for row in df.select("a", "b", template.column(source, columns).alias("r")).collect():
            context = {k: v for k, v in row.asDict().items() if k in "ab" and v is not None}
            try:
                assert row.r.text == template.render(source, context) and row.r.error is None
            except TemplateError:
                assert row.r.text is None and "undefined" in row.r.error
    loop = template.column("{% for c in a %}[{{ c }}]{% endfor %}", columns)
    assert [r[0] for r in df.select(loop["text"]).collect()] == ["[x]", "[é]"]


def graded(spark, kind, params, output, expected=None, label=None):
    df = spark.createDataFrame([(output, None if expected is None else json.dumps(expected), None if label is None else json.dumps(label))], "o string, e string, l string")
    scored = scorers.bind(kind, params)(scorers.Inputs(F.col("o"), F.col("e"), F.col("l"), F.lit(None).cast("string")))
    return df.select(scorers.entry("c", 1.0, scored).alias("e")).first().e


def test_string_scorers(spark):
    assert graded(spark, "exact", {}, "  Hi\x1c\n", "Hi").passed and not graded(spark, "exact", {"strip": False}, "Hi ", "Hi").passed
    assert graded(spark, "exact", {}, "4", 4).passed and graded(spark, "exact", {"value": "X", "case_sensitive": False}, "x").passed
    missing = graded(spark, "exact", {}, "x")
    assert not missing.passed and missing.score == 0 and "nothing to compare" in missing.error
    assert graded(spark, "contains", {}, "abc", "").passed and graded(spark, "not-contains", {"value": "z"}, "abc").passed and graded(spark, "not-contains", {}, "abc").error
    assert graded(spark, "contains", {"value": None}, "abc", "a").error
    assert graded(spark, "regex", {"pattern": r"^\w+$"}, "é_1").passed and graded(spark, "regex", {"pattern": "ÉA", "case_sensitive": False}, "éa").passed
    assert graded(spark, "regex", {"pattern": r"(?P<y>a)(?P=y)"}, "baa").passed
    for params in ({}, {"pattern": "("}):
        with pytest.raises(ScoringError):
            scorers.bind("regex", params)


def test_agreement(spark):
    passed = lambda out, label, **p: graded(spark, "agreement", p, out, label=label).passed
    assert passed('{"score": 4}', 4) and passed('{"score": "4"}', 4.0) and passed(" GOOD ", "good") and passed("nan", "nan") and passed("true", True)
    assert not passed("true", 1) and not passed('{"score": 1}', True)
    assert passed('{"score": 3}', 4, mode="within", tolerance=1) and graded(spark, "agreement", {"mode": "within"}, '"3"', label=3).error
    assert graded(spark, "agreement", {}, '{"x": 1}', label=1).error and graded(spark, "agreement", {}, "1").error
    for bad in ({"mode": "x"}, {"tolerance": -1}, {"tolerance": "inf"}, {"tolerance": "y"}):
        with pytest.raises(ScoringError):
            scorers.bind("agreement", bad)


def test_judge_and_python(spark):
    assert graded(spark, "llm-judge", {"scale": 5}, '{"score": 9}').score == 1.0 and graded(spark, "llm-judge", {}, '{"score": 0.9, "passed": false}').passed is False
    assert graded(spark, "llm-judge", {}, '{"score": true}').error and graded(spark, "llm-judge", {}, "hm").error
    for value, ok in ((True, True), (0.4, False), ({"score": 1}, True)):
        scored = scorers.python({}, function=lambda o, c, value=value: value)
        e = spark.range(1).select(scorers.entry("c", 1.0, scored(scorers.Inputs(F.lit("x"), *[F.lit(None).cast("string")] * 3))).alias("e")).first().e
        assert e.passed is ok
    for value in (1.5, float("nan"), "x", {"score": 1, "passed": 1}):
        scored = scorers.python({}, function=lambda o, c, value=value: value)
        e = spark.range(1).select(scorers.entry("c", 1.0, scored(scorers.Inputs(F.lit("x"), *[F.lit(None).cast("string")] * 3))).alias("e")).first().e
        assert e.error and e.score == 0 and not e.passed


def scored_rows(spark):
    entry = lambda w, s, p: {"criterion": f"c{w}{s}", "weight": w, "score": s, "passed": p, "detail": None, "error": None}
    rows = [
        ("a", "m1", "c1", 0, None, [entry(3.0, 1.0, True), entry(1.0, 0.5, True)]),
        ("a", "m1", "c2", 1, None, [entry(1.0, 0.5, False)]),
        ("b", "m1", "c1", 2, "ProviderError: boom", [entry(1.0, 1.0, True)]),
        ("b", "m2", "c1", 3, None, []),
        ("b", "m2", "c2", 4, None, [entry(0.0, 1.0, True)]),
    ]
    return scoring.judged(spark.createDataFrame(rows, f"variant string, model string, case_id string, cell_ord long, error string, scores array<{scorers.ENTRY}>"))


def test_cell_scores_and_matrix(spark):
    df = scored_rows(spark)
    assert [(r.cell_score, r.passed) for r in df.orderBy("cell_ord").collect()] == [(0.875, True), (0.5, False), (0.0, False), (0.0, False), (0.0, False)]
    assert [tuple(r) for r in scoring.matrix(df).collect()] == [("a", "m1", 2, 0.6875, 0.5, 0), ("b", "m1", 1, 0.0, 0.0, 1), ("b", "m2", 2, 0.0, 0.0, 0)]
    assert [r.case_id for r in results.for_report(df).select("case_id").distinct().collect()]
    wide = results.wide(df, ["c3.01.0", "c1.00.5"]).orderBy("variant", "model", "case_id").first()
    assert wide["score:c3.01.0"] == 1.0 and wide["passed:c1.00.5"] is True
    assert scoring.gate(scoring.overall(df.limit(0)), 0.1).count() == 0


def test_matrix_operators(spark):
    assert matrix.draw(40, 10, 1) == matrix.draw(40, 10, 1) == sorted(set(matrix.draw(40, 10, 1))) and matrix.draw(3, 9, 1) == [0, 1, 2]
    assert matrix.pick(["a", "b", "c"], ["c", "a"], "variant") == ["a", "c"]
    with pytest.raises(ConfigError, match="available: a"):
        matrix.pick(["a"], ["z"], "variant")
    c = spark.createDataFrame([(0, "x"), (1, "y")], "case_pos long, case_id string")
    v, m = matrix.names(spark, "variant", ["v1", "v2"], "v_ord"), matrix.names(spark, "model", ["m"], "m_ord")
    order = lambda df: [(r.variant, r.case_id) for r in df.orderBy("cell_ord").collect()]
    assert order(matrix.product(v, m, c)) == [("v1", "x"), ("v1", "y"), ("v2", "x"), ("v2", "y")]
    assert order(matrix.product(v, m, c, case_major=True)) == [("v1", "x"), ("v2", "x"), ("v1", "y"), ("v2", "y")]


def test_budget_prefix(spark):
    calls_ = spark.createDataFrame([(i, 1.0) for i in range(4)] + [(4, None)], "cell_ord long, cost_usd double")
    assert sorted(r.cell_ord for r in requests.within_budget(calls_, 2.5).collect()) == [0, 1, 2]
    assert requests.within_budget(calls_, 0).count() == 0 and requests.within_budget(calls_, 9, spent=8.5).count() == 1
    assert requests.within_budget(calls_.limit(0), 1).count() == 0


def test_usage_and_prices(spark):
    df = spark.createDataFrame([("12",), ("12.0",), ("1.5",), ("-1",), ("NaN",), ("true",), (None,)], "v string")
    assert [r[0] for r in df.select(requests.usage(F.col("v"))).collect()] == [12, 12, None, None, None, None, None]
    assert calls.usage("12") == 12 and calls.usage(12.0) == 12 and calls.usage(None) is None
    for bad in (1.5, True, float("nan"), -1, "x"):
        with pytest.raises(ProviderError):
            calls.usage(bad)
    assert len(prices.RATES) == 63 and prices.cost("gpt-4o", 1_000_000, None) == 2.5 and prices.cost("local", 1, 1) is None and prices.cost("gpt-4o", None, None) is None
    assert prices.cost("local", 100, 50, {"pricing": {"input": 1, "output": 2}}) == 0.0002


def test_retries_and_limits():
    waits, tries = [], []

    def fails(times, **kw):
        def call():
            tries.append(1)
            if len(tries) <= times:
                raise ProviderError("x", **kw)
            return "ok"

        return call

    assert calls.with_retries(fails(2, retryable=True), 3, waits.append) == "ok" and waits == [0.5, 1.0]
    tries.clear()
    with pytest.raises(ProviderError):
        calls.with_retries(fails(1), 3, waits.append)
    assert calls.delay(9) == 8.0 and calls.delay(1, 400) == 60.0
    now = [0.0]
    limit = calls.RateLimit(calls.slots(2, [-100.0]), lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    now[0] = 1000.0
    for _ in range(5):
        limit.wait()
    assert now[0] == 1120.0
    limit = calls.RateLimit(calls.slots(3, [1000.0, 1090.0, 1110.0, 900.0]), lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    starts = [(limit.wait(), now[0])[1] for _ in range(3)]
    assert starts == [1120.0, 1150.0, 1170.0]


def test_http_payloads():
    sent = []

    def transport(url, headers, body, timeout):
        sent.append((url, headers, body))
        if len(sent) == 1:
            return 429, {"Retry-After": "2"}, "slow down sk-secret-123"
        if "anthropic" in url:
            return 200, {}, json.dumps({"content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 3, "output_tokens": 1}})
        return 200, {}, json.dumps({"choices": [{"message": {"content": "yo"}}], "usage": {"prompt_tokens": 2, "completion_tokens": 1}})

    part = lambda t: {"type": "text", "text": t, "media_type": None, "sha256": None, "source": None}
    talk = [{"role": "system", "parts": [part("S")]}, {"role": "user", "parts": [part("U")]}]
    env = {"ANTHROPIC_API_KEY": "sk-secret-123", "OPENAI_API_KEY": "k"}
    model = calls.provider({"id": "m", "provider": "anthropic", "params": {"temperature": 0}}, env=env, transport=transport)
    with pytest.raises(ProviderError) as e:
        model.complete(talk)
    assert e.value.retryable and e.value.retry_after == 2.0 and "sk-secret" not in str(e.value)
    assert model.complete(talk).text == "hi" and sent[-1][2]["system"] == "S" and sent[-1][2]["max_tokens"] == 4096 and sent[-1][2]["temperature"] == 0
    chat = calls.provider({"id": "m", "provider": "openai-compatible", "base_url": "http://x/v1/"}, env=env, transport=transport)
    assert chat.complete(talk).input_tokens == 2 and sent[-1][0] == "http://x/v1/chat/completions" and sent[-1][2]["messages"][1] == {"role": "user", "content": "U"}
    with pytest.raises(ProviderError, match="not set"):
        calls.provider({"id": "m", "provider": "openai"}, env={}, transport=transport).complete(talk)


def test_text_functions(spark):
    row = spark.createDataFrame([("a" * 61, " =1", "<&'\">", "x|y\nz")], "a string, b string, c string, d string").select(
        text.snip(F.col("a"), 60).alias("a"), text.snip_counted(F.col("a"), 60).alias("n"), text.guard_formula(F.col("b")).alias("b"), text.escape_html(F.col("c")).alias("c"), text.escape_markdown(F.col("d")).alias("d"),
        text.scrub(F.lit("key sk-12345678 short"), ["sk-12345678", "short"]).alias("s"),
    ).first()
    assert row.a == "a" * 60 + "…" and row.n.endswith("(1 more chars)") and row.b == "' =1" and row.c == "&lt;&amp;&#x27;&quot;&gt;" and row.d == "x\\|y z" and row.s == "key [redacted] short"


def test_scorers_send_what_they_read(spark):
    """Only the inputs that a scorer names go to Python, so a broken one that it does not read changes nothing."""
    row = spark.createDataFrame([('{"score": 1}', "no JSON", "1", "no JSON either")], "output string, expected string, label string, case string")
    inputs = scorers.Inputs(*(F.col(c) for c in row.columns))
    for kind, params, sent in (("json-schema", {"schema": {"type": "object"}}, {"output"}), ("llm-judge", {}, {"output"}), ("agreement", {}, {"output", "label"})):
        scored = row.select(scorers.bind(kind, params)(inputs).alias("s"))
        assert scored.first().s.passed is True, kind
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        call = next(line for line in plan.splitlines() if "ArrowEvalPython" in line).split("ArrowEvalPython [run(")[1].split(")")[0]
        assert {a.strip().split("#")[0] for a in call.split(",")} == sent, kind


def test_datasets(spark, tmp_path):
    (tmp_path / "doc.pdf").write_bytes(b"x")
    (tmp_path / "c.jsonl").write_text('﻿{"id": "a", "q": 1, "expected": "file://literal", "doc": "file://doc.pdf"}\n\n{"q": null}\n')
    got = [r.asDict() for r in cases.dataset(spark, tmp_path / "c.jsonl").orderBy("case_pos").collect()]
    assert got[0]["files"] == {"doc": str(tmp_path / "doc.pdf")} and json.loads(got[0]["expected"]) == "file://literal" and json.loads(got[0]["vars"]) == {"q": 1} and got[1]["case_id"] == "case-2"
    (tmp_path / "c.csv").write_text('id,q,expected\n,"two\nlines",\nb,,x\n')
    got = [r.asDict() for r in cases.dataset(spark, tmp_path / "c.csv").orderBy("case_pos").collect()]
    assert got[0]["case_id"] == "case-1" and got[0]["expected"] is None and json.loads(got[0]["vars"]) == {"q": "two\nlines"} and json.loads(got[1]["vars"]) == {"q": ""}
    spark.createDataFrame([("p1", "hello", 3), (None, "x", None)], "id string, q string, expected long").coalesce(1).write.parquet(str(tmp_path / "c.parquet"))
    got = [r.asDict() for r in cases.dataset(spark, tmp_path / "c.parquet").orderBy("case_pos").collect()]
    assert got[0]["case_id"] == "p1" and got[0]["expected"] == "3" and json.loads(got[0]["vars"]) == {"q": "hello"} and got[1]["case_id"].startswith("case-") and got[1]["expected"] is None
    for name, body, match in (("bad.jsonl", '{"a": 1}\nnope', "line 2 of .* does not parse"), ("list.jsonl", "[1]", "no object"), ("empty.jsonl", "\n", "no cases"), ("dup.jsonl", '{"id": "a"}\n{"id": "a"}', "two cases"), ("x.txt", "", "none of them"), ("out.jsonl", '{"f": "file:///etc/passwd"}', "leads out"), ("up.jsonl", '{"f": "file://../x"}', "leads out")):
        (tmp_path / name).write_text(body)
        with pytest.raises(ConfigError, match=match):
            cases.dataset(spark, tmp_path / name)
    with pytest.raises(ConfigError, match="not found"):
        cases.dataset(spark, tmp_path / "none.csv")


SOURCE = """
from promptmatrix.sources.paged import Page
from promptmatrix.spec import Case
class Paging:
    def __init__(self, total, stuck=False):
        self.total, self.stuck = total, stuck
    def fetch(self, cursor, limit):
        at = int(cursor or 0)
        if self.stuck:
            return Page((), "1" if cursor != "1" else "2") if at < 3 else Page((), "1")
        rows = [Case(id=f"c{i}" if i % 2 else None, vars={"q": i}) for i in range(at, min(at + limit, self.total))]
        end = at + len(rows)
        return Page(rows, str(end) if end < self.total else None)
    def count(self):
        return self.total
def make(total=7, stuck=False):
    return Paging(total, stuck)
"""


def test_paged_source(spark, tmp_path):
    (tmp_path / "s.py").write_text(SOURCE)
    got = cases.unique_ids(paged.cases(spark, "s.py:make", tmp_path, {"total": 7}, 3)).orderBy("case_pos").collect()
    assert [r.case_id for r in got] == ["case-1", "c1", "case-3", "c3", "case-5", "c5", "case-7"]
    assert paged.cases(spark, "s.py:make", tmp_path, {"total": 7}, 3, limit=4).count() == 4
    assert paged.count(paged.load("s.py:make", tmp_path)) == 7
    with pytest.raises(SourceError, match="circles"):
        list(paged.walk(paged.load("s.py:make", tmp_path, {"stuck": True})))
    for bad in ("s.py", "none.py:make", "s.py:nope", "s.py:SOURCE"):
        with pytest.raises(SourceError):
            paged.load(bad, tmp_path)


def test_paged_stream(spark, tmp_path):
    (tmp_path / "s.py").write_text(SOURCE)
    seen = []
    pages = waves.drain(spark, "s.py:make", tmp_path, str(tmp_path / "check"), lambda df, n: seen.extend(r.case_id for r in df.collect()), {"total": 7}, 3)
    assert pages == 3 and sorted(seen) == sorted(["case-1", "c1", "case-3", "c3", "case-5", "c5", "case-7"])
    assert waves.drain(spark, "s.py:make", tmp_path, str(tmp_path / "check"), lambda df, n: seen.append("again"), {"total": 7}, 3) == 0


def test_labels_and_media(spark, tmp_path):
    (tmp_path / "l.csv").write_text("case_id,label\na,1\na,2\nb,good\n")
    got = {r.case_id: r.human_label for r in results.latest_labels(files.labels(spark, tmp_path / "l.csv")).collect()}
    assert got == {"a": "2", "b": '"good"'}
    (tmp_path / "x.png").write_bytes(b"abc")
    row = files.media(spark, [str(tmp_path / "x.png")]).first()
    assert row.media_type == "image/png" and row.length == 3 and row.sha256.startswith("ba7816bf")
    with pytest.raises(ContentError):
        files.media_type("x.pdf", "image")


def test_results_log(spark, tmp_path):
    line = json.dumps({"variant": "v", "model": "m", "case_id": "c", "output": "x", "cached": False, "scores": {"acc": {"weight": 1.0, "score": 1.0, "passed": True}}, "extra": 1})
    (tmp_path / "r.jsonl").write_text(line + "\n" + line[:-20])
    assert [r.passed for r in scoring.judged(files.results_log(spark, str(tmp_path / "r.jsonl"))).collect()] == [True]
    (tmp_path / "bad.jsonl").write_text(line[:-20] + "\n" + line)
    with pytest.raises(StoreError):
        files.results_log(spark, str(tmp_path / "bad.jsonl"))


def test_store(tmp_path):
    store = Store(tmp_path)
    a, b = store.create({}, "x"), store.create({}, "x")
    store.finalize(a, True)
    assert store.resolve("x") == b and store.resolve(a) == a and store.meta(a)["status"] == "complete" and [m["id"] for m in store.runs()] == [a, b]
    assert store.set_baseline(a) == a == store.resolve("baseline")
    (tmp_path / "junk").mkdir()
    (tmp_path / "junk/run.json").write_text("{")
    assert len(store.runs()) == 2
    for bad in ("nope", "../x"):
        with pytest.raises(StoreError):
            store.meta(store.resolve(bad))
    with pytest.raises(StoreError, match="reserved"):
        store.create({}, "latest")


GOOD = {
    "models": [{"id": "m", "provider": "mock"}, {"id": "j", "provider": "mock", "role": "judge"}],
    "variants": [{"name": "v", "prompt": [{"role": "user", "content": "{{ q }}"}]}],
    "cases": [{"id": "a", "vars": {"q": "x"}}],
    "judges": {"g": {"model": "j", "rubric": [{"role": "user", "content": "x"}]}},
    "scorecard": [{"criterion": "c", "weight": 2, "scorer": {"type": "llm-judge", "judge": "g"}}],
}


@pytest.mark.parametrize(
    "change",
    [
        {"unknown": 1}, {"models": []}, {"variants": []}, {"scorecard": []}, {"cases": []}, {"judges": {}}, {"cases": [{"id": "a"}, {"id": "a"}]},
        {"models": [{"id": "m", "provider": "mock"}, {"id": "j", "provider": "mock"}]}, {"models": [{"id": "j", "provider": "mock", "role": "judge"}]},
        {"models": GOOD["models"] + [{"id": "m", "provider": "mock"}]}, {"models": GOOD["models"] + [{"id": "x", "provider": "mock", "role": "both"}]},
        {"models": GOOD["models"] + [{"id": "x", "provider": "command"}]}, {"models": GOOD["models"] + [{"id": "x", "provider": "mock", "command": "ls"}]},
        {"models": GOOD["models"] + [{"id": "x", "provider": "openai-compatible"}]}, {"models": GOOD["models"] + [{"id": "x", "provider": "mock", "api_key_env": "sk-123"}]},
        {"models": GOOD["models"] + [{"id": "x", "provider": "mock", "params": {"pricing": {"input": -1, "output": 1}}}]}, {"thresholds": {"min_score": 2}},
        {"scorecard": [{"criterion": "c", "weight": 0, "scorer": {"type": "exact"}}]}, {"scorecard": [{"criterion": "c", "scorer": {"type": "nope"}}]}, {"scorecard": [{"criterion": "c", "scorer": {"type": "llm-judge"}}]},
        {"variants": [{"name": "v", "prompt": [{"role": "user", "content": [{"text": "a", "image": "b"}]}]}]}, {"settings": {"concurrency": 0}},
    ],
)
def test_bad_configurations(change):
    spec.parse(GOOD)
    with pytest.raises(ConfigError):
        spec.parse(GOOD | change)


@pytest.mark.parametrize("hostile", [None, 1, "x", [], [None], {"a": None}, float("nan"), True, {"models": {"id": 1}}])
def test_hostile_values_fail_cleanly(hostile):
    with pytest.raises(ConfigError):
        spec.parse(hostile)
    for key in GOOD:
        try:
            spec.parse(GOOD | {key: hostile})
        except ConfigError:
            pass


def test_calibration_and_artifacts(spark):
    rows = [("v", "m", "a", 0, "x", None), ("v", "m", "a", 1, "y", None), ("v", "m", "b", 2, None, "err"), ("v", "m", "c", 3, "z", None)]
    df = spark.createDataFrame(rows, "variant string, model string, case_id string, cell_ord long, output string, error string")
    labels = spark.createDataFrame([("a", "5"), ("b", "3")], "case_id string, human_label string")
    assert [(r.case_id, r.output) for r in results.calibration(df, labels).collect()] == [("a", "x")]
    results.one_system(df)
    with pytest.raises(ConfigError, match="several"):
        results.one_system(df.withColumn("variant", F.col("case_id")))


def test_rate_window(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 0)), (2, datetime(2024, 1, 1, 0, 0, 59)), (3, datetime(2024, 1, 1, 0, 1, 0))], "id int, ts timestamp")
    assert [r.in_window for r in requests.in_window(df, "ts").orderBy("id").collect()] == [1, 2, 2]
