"""Registered queries that go through files and whole runs: sources, stores, calls and exports, each with its SQL twin.

Files that a user would have are written to a folder of the driver from the
smaller tables; the tables themselves are read in place.
"""

from __future__ import annotations

import csv
import json
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmatrix import export, settings, spec
from promptmatrix.operators import matrix, requests, results, scoring
from promptmatrix.plans import demo
from promptmatrix.plans import run as runs
from promptmatrix.plans.demo import table
from promptmatrix.plans.registry import query
from promptmatrix.sources import cases, files, paged
from promptmatrix.sources.store import Store
from promptmatrix.streaming import waves

SOURCE = '''
import pyarrow.parquet
from promptmatrix import Case, Page

class Suppliers:
    """Pages of a Parquet table; the cursor is the next row."""

    def __init__(self, path):
        self.rows = pyarrow.parquet.read_table(path, columns=["s_suppkey", "s_name"]).sort_by("s_suppkey").combine_chunks()

    def count(self):
        return self.rows.num_rows

    def fetch(self, cursor, limit):
        at = int(cursor or 0)
        page = [Case(id=str(r["s_suppkey"]), vars={"ask": r["s_name"]}) for r in self.rows.slice(at, limit).to_pylist()]
        return Page(page, str(at + limit) if at + limit < self.rows.num_rows else None)

def make(path):
    return Suppliers(path)
'''


def folder() -> Path:
    """A new folder where driver and executors both look: in spark.checkpoint.dir, if that is on a file system that paths reach."""
    shared = urlparse(runs.shared_folder(SparkSession.active()))
    if shared.scheme not in ("", "file"):
        return Path(tempfile.mkdtemp(prefix="project-"))
    place = Path(shared.path) / f"project-{uuid.uuid4().hex}"
    place.mkdir(parents=True)
    return place


def customers(spark: SparkSession, d: str, base: Path) -> dict:
    """All customers as a Parquet file of cases, written by Spark: asked by name, with the segment expected, and points of their number."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("ask"), (F.col("c_custkey") % 6).alias("points"), F.col("c_mktsegment").alias("expected"))
    rows.write.parquet((base / "customers.parquet").as_uri())
    return {"file": "customers.parquet"}


def project(base: Path | str, **parts) -> spec.Config:
    whole = {
        "models": [{"id": "echo", "provider": "mock"}],
        "variants": [{"name": "plain", "prompt": [{"role": "user", "content": "{{ ask }}"}]}],
        "scorecard": [{"criterion": "equal", "scorer": {"type": "exact"}}],
    } | parts
    return spec.parse(whole, base)


def nations(spark: SparkSession, d: str) -> list[dict]:
    """The 25 nations as cases: asked by name, with the first letter in lower case expected of every third."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    return [{"id": f"n{r.n_nationkey}", "vars": {"ask": r.n_name}, "expected": r.n_name if r.n_nationkey % 3 else r.n_name.lower()} for r in rows]


# -- Sources ----------------------------------------------------------------


@query("SELECT item_id::VARCHAR AS case_id, (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS case_pos, md5(text) AS text_md5 FROM benchmark")
def jsonl_cases(spark, d):
    path = folder() / "cases.jsonl"
    rows = table(spark, d, "benchmark").orderBy("item_id").toLocalIterator()
    path.write_text("".join(json.dumps({"id": str(r.item_id), "text": r.text}, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return cases.dataset(spark, path).select("case_id", "case_pos", F.md5(F.get_json_object("vars", "$.text").cast("binary")).alias("text_md5"))


@query("SELECT c_custkey::VARCHAR AS case_id, c_name AS name, c_mktsegment AS expected FROM customer")
def csv_cases(spark, d):
    """All customers as CSV that Spark writes and reads in splits; no row passes the driver."""
    path = folder() / "cases.csv"
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("expected"))
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path.as_uri())
    one = lambda c: F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    return cases.dataset(spark, path).select("case_id", F.get_json_object("vars", "$.name").alias("name"), one(F.col("expected")).alias("expected"))


@query("SELECT doc_id::VARCHAR AS case_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS case_pos, md5(text) AS text_md5, lang AS expected FROM documents")
def jsonl_parts(spark, d):
    """All documents as a folder of JSON lines that Spark writes and reads in splits."""
    path = folder() / "documents.jsonl"
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("expected"), "doc_id")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.json(path.as_uri())
    found = cases.dataset(spark, path)
    return found.select("case_id", "case_pos", F.md5(_text(found, "vars", "$.text").cast("binary")).alias("text_md5"), _text(found, "expected", "$").alias("expected"))


@query("""SELECT 'case-' || row_number() OVER (ORDER BY o_orderkey) AS case_id, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS case_pos, o_orderkey::VARCHAR AS order_key,
    o_orderpriority || ', "' || o_orderstatus || '"' || chr(10) || chr(10) || o_orderkey AS ask, o_orderstatus AS expected FROM orders""")
def csv_parts(spark, d):
    """All orders as a folder of CSV with quotes, commas and line breaks in its cells."""
    path = folder() / "orders.csv"
    ask = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"\n\n'), "o_orderkey")
    rows = table(spark, d, "orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(F.col("o_orderkey").alias("order_key"), ask.alias("ask"), F.col("o_orderstatus").alias("expected"))
    rows.write.options(header=True, escape='"').csv(path.as_uri())
    found = cases.dataset(spark, path)
    return found.select("case_id", "case_pos", _text(found, "vars", "$.order_key").alias("order_key"), _text(found, "vars", "$.ask").alias("ask"), _text(found, "expected", "$").alias("expected"))


def _text(found: DataFrame, column: str, path: str) -> Column:
    """A text out of a column of JSON."""
    return F.try_variant_get(F.try_parse_json(found[column]), path, "string")


@query("SELECT 'case-' || row_number() OVER (ORDER BY doc_id) AS case_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS case_pos, doc_id, md5(text) AS text_md5 FROM documents")
def parquet_cases(spark, d):
    found = cases.parquet(spark, f"{d}/documents.parquet")
    return found.select("case_id", "case_pos", F.get_json_object("vars", "$.doc_id").cast("long").alias("doc_id"), F.md5(F.get_json_object("vars", "$.text").cast("binary")).alias("text_md5"))


@query("SELECT 'n' || n_nationkey AS case_id, n_nationkey::BIGINT AS case_pos, n_name AS ask FROM nation")
def inline_cases(spark, d):
    given = [spec.Case.model_validate(c) for c in nations(spark, d)]
    return cases.inline(spark, given, folder()).select("case_id", "case_pos", F.get_json_object("vars", "$.ask").alias("ask"))


def _paged(d: str) -> tuple[Path, dict]:
    base = folder()
    (base / "suppliers.py").write_text(SOURCE)
    return base, {"path": f"{d}/supplier.parquet"}


@query("SELECT s_suppkey::VARCHAR AS case_id, (row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT AS case_pos, s_name AS ask FROM supplier")
def paged_cases(spark, d):
    base, params = _paged(d)
    return paged.cases(spark, "suppliers.py:make", base, params, page_size=64).select("case_id", "case_pos", F.get_json_object("vars", "$.ask").alias("ask"))


@query("SELECT s_suppkey::VARCHAR AS case_id FROM supplier ORDER BY s_suppkey LIMIT 7")
def paged_limit(spark, d):
    base, params = _paged(d)
    return paged.cases(spark, "suppliers.py:make", base, params, page_size=3, limit=7).select("case_id")


@query("SELECT count(*)::BIGINT AS cases FROM supplier")
def source_count(spark, d):
    base, params = _paged(d)
    return spark.createDataFrame([(paged.count(paged.load("suppliers.py:make", base, params)),)], "cases long")


@query("SELECT page, count(*) OVER (PARTITION BY page)::BIGINT AS n, case_id FROM (SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) // 40 AS page, s_suppkey::VARCHAR AS case_id FROM supplier)")
def page_waves(spark, d):
    """A source drained as a stream, in whole pages; waves write theirs under their number."""
    base, params = _paged(d)
    place = f"{runs.shared_folder(spark)}/{uuid.uuid4().hex}"
    waves.drain(spark, "suppliers.py:make", base, f"{place}/offsets", lambda pages, number: pages.select("page", "case_id").write.mode("overwrite").parquet(f"{place}/pages/wave={number}"), params, page_size=40)
    rows = spark.read.schema("page long, case_id string").parquet(f"{place}/pages").select("page", "case_id")
    return rows.join(rows.groupBy("page").agg(F.count("*").alias("n")), "page").select("page", "n", "case_id")


@query("SELECT doc_id::VARCHAR AS case_id, toxic::VARCHAR AS human_label FROM labels WHERE toxic IS NOT NULL")
def label_file(spark, d):
    path = folder() / "labels.csv"
    rows = table(spark, d, "labels").where("toxic IS NOT NULL").select("doc_id", "quality", "toxic").collect()
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["case_id", "rating"])
        out.writerows((r.doc_id, r.quality) for r in rows)
        out.writerows((r.doc_id, r.toxic) for r in rows)  # the last label of a case counts
    return results.latest_labels(files.labels(spark, path))


@query("SELECT n_name || '.png' AS name, 'image/png' AS media_type, sha256(n_name) AS sha256, length(n_name)::BIGINT AS length FROM nation")
def media_files(spark, d):
    base = folder()
    for r in table(spark, d, "nation").select("n_name").collect():
        (base / f"{r.n_name}.png").write_bytes(r.n_name.encode())
    return files.media(spark, [str(p) for p in base.iterdir()]).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "media_type", "sha256", "length")


_DRAWN = ", ".join(f"({n}, {p})" for n in (200, 1000, 10000) for p in matrix.draw(n, 25, 7))


@query(f"SELECT doc_id::VARCHAR AS case_id, doc_id AS case_pos FROM documents JOIN (VALUES {_DRAWN}) AS drawn(n, p) ON p = doc_id AND n = (SELECT count(*) FROM documents)")
def sample_positions(spark, d):
    every = demo.cases(spark, d)
    return matrix.sampled(every, matrix.draw(every.count(), 25, 7)).select("case_id", "case_pos")


# -- Rendering ----------------------------------------------------------------


def _documents(d: str, prompt: str) -> spec.Config:
    return project(d, cases={"file": "documents.parquet"}, variants=[{"name": "plain", "prompt": [{"role": "system", "content": "In {{ lang }}."}, {"role": "user", "content": prompt}]}])


@query("SELECT doc_id, md5('In ' || lang || '.' || CASE WHEN n_chars > 400 THEN upper(source) || ':' ELSE 'short:' END || text) AS text_md5 FROM documents")
def rendered_messages(spark, d):
    """Whole texts through templates with a condition and a filter, as a run renders them."""
    bound = runs.bind_config(spark, _documents(d, "{% if n_chars > 400 %}{{ source|upper }}{% else %}short{% endif %}:{{ text }}"), runs.Selection())
    return runs.rendered(bound).select(F.get_json_object("vars", "$.doc_id").cast("long").alias("doc_id"), F.md5(requests.message_text(F.col("messages")).cast("binary")).alias("text_md5"))


@query("SELECT 'plain' AS variant, 'echo' AS model, 'case-' || row_number() OVER (ORDER BY doc_id) AS case_id, true AS failed FROM documents")
def dry_run_errors(spark, d):
    return runs.dry_run(spark, _documents(d, "{{ nowhere }}")).select("variant", "model", "case_id", F.col("error").contains("'nowhere' is undefined").alias("failed"))


@query("SELECT variant, 'echo' AS model, 'n' || n_nationkey AS case_id, (v * 25 + n_nationkey)::BIGINT AS cell_ord FROM nation, (VALUES ('a', 0), ('b', 1)) AS x(variant, v) WHERE n_nationkey IN (3, 9)")
def selected_cells(spark, d):
    prompt = [{"role": "user", "content": "{{ ask }}"}]
    c = project(folder(), cases=nations(spark, d), variants=[{"name": n, "prompt": prompt} for n in "ab"])
    some = runs.cells(spark, c, runs.Selection(cases=["n3", "n9"]))
    whole = runs.cells(spark, c)
    return whole.join(some.select(*matrix.KEY), list(matrix.KEY), "left_semi").select("variant", "model", "case_id", "cell_ord")


# -- Whole runs ---------------------------------------------------------------

_ASKED = "SELECT 'n' || n_nationkey AS case_id, n_name AS ask, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS expected FROM nation"


@query(f"SELECT 'plain' AS variant, 'echo' AS model, case_id, ask AS output, (length(ask) // 4)::BIGINT AS input_tokens, ask = expected AS passed, CASE WHEN ask = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cell_score FROM ({_ASKED})")
def stored_run(spark, d):
    """A run's results as its store gives them back."""
    c = project(folder(), cases=nations(spark, d))
    done = runs.run(spark, c)
    rows = scoring.judged(Store(c.place(c.settings.output_dir)).results(spark, done.run_id))
    return rows.select("variant", "model", "case_id", "output", "input_tokens", "passed", "cell_score")


@query(f"SELECT case_id, upper(ask) AS output, NULL::BIGINT AS input_tokens, NULL::DOUBLE AS cost_usd FROM ({_ASKED})")
def command_calls(spark, d):
    base = folder()
    (base / "shout.py").write_text("import json,sys\nprint(json.load(sys.stdin)['messages'][-1]['text'].upper())")
    c = project(base, cases=nations(spark, d), models=[{"id": "echo", "provider": "command", "command": "python3 shout.py"}])
    return runs.run(spark, c).results.select("case_id", "output", "input_tokens", "cost_usd")


@query("SELECT 25::BIGINT AS cells, 2::BIGINT AS retried, 27::BIGINT AS attempts, 0::BIGINT AS failed")
def retried_calls(spark, d):
    """A provider that fails twice at first, in one task: the first call takes three attempts."""
    c = project(folder(), cases=nations(spark, d), models=[{"id": "echo", "provider": "mock", "max_concurrency": 1, "params": {"fail_times": 2}}])
    bound = runs.bind_config(spark, c, runs.Selection())
    done, _, _ = runs.complete(spark, runs.rendered(bound), bound.models, c.base, None)
    return done.agg(F.count("*").alias("cells"), F.sum(F.col("attempts") - 1).alias("retried"), F.sum("attempts").cast("long").alias("attempts"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query("SELECT 'n' || n_nationkey AS case_id, CASE WHEN n_nationkey % 2 = 1 THEN 'ProviderError: mock fatal error' END AS error FROM nation")
def failed_calls(spark, d):
    """Errors stay with their cell: every second case goes to a model that always fails."""
    given = nations(spark, d)
    bad = runs.run(spark, project(folder(), cases=given[1::2], models=[{"id": "echo", "provider": "mock", "params": {"error": "fatal"}}]))
    return bad.results.unionByName(runs.run(spark, project(folder(), cases=given[::2])).results).select("case_id", "error")


JUDGED = {
    "models": [{"id": "echo", "provider": "mock"}, {"id": "j", "provider": "mock", "role": "judge", "params": {"cost": 0.5}}],
    "judges": {"quality": {"model": "j", "rubric": [{"role": "user", "content": '{"score": {{ vars.points }}, "rationale": "{{ output }}"}'}]}},
    "scorecard": [{"criterion": "judged", "scorer": {"type": "llm-judge", "judge": "quality", "scale": 5}}],
}


@query("SELECT c_custkey::VARCHAR AS case_id, (c_custkey % 6)::DOUBLE / 5 AS score, (c_custkey % 6) * 2 >= 5 AS passed, c_name AS detail FROM customer")
def judged_run(spark, d):
    """A judge that says back its rubric, filled from each customer."""
    base = folder()
    done = runs.run(spark, project(base, cases=customers(spark, d, base), **JUDGED), cache=False)
    return done.results.select("case_id", F.col("scores")[0]["score"].alias("score"), F.col("scores")[0]["passed"].alias("passed"), F.col("scores")[0]["detail"].alias("detail"))


@query("SELECT count(*)::BIGINT AS judge_calls, count(*)::BIGINT AS judge_attempts, count(*) * 0.5::DOUBLE AS judge_cost_usd FROM customer")
def judge_totals(spark, d):
    base = folder()
    totals = runs.run(spark, project(base, cases=customers(spark, d, base), **JUDGED), cache=False).meta["totals"]
    return spark.createDataFrame([(totals["judge_calls"], totals["judge_attempts"], totals["judge_cost_usd"])], "judge_calls long, judge_attempts long, judge_cost_usd double")


@query(f"SELECT case_id, ask AS output, CASE WHEN rank <= 10 THEN 'first' ELSE 'second' END AS run FROM (SELECT *, row_number() OVER (ORDER BY substr(case_id, 2)::INT) AS rank FROM ({_ASKED}))")
def resumed_run(spark, d):
    """A run stopped by its budget after ten cells, and the rest of it."""
    c = project(folder(), cases=nations(spark, d), models=[{"id": "echo", "provider": "mock", "params": {"cost": 1.0}}])
    first = runs.run(spark, c, runs.Selection(max_cost=10))
    done = first.results.select("case_id").collect()
    second = runs.run(spark, c, resume=first.run_id)
    return second.results.select("case_id", "output", F.when(F.col("case_id").isin([r.case_id for r in done]), "first").otherwise("second").alias("run"))


@query(f"SELECT case_id, ask AS output, ask = expected AS passed FROM ({_ASKED})")
def results_log_read(spark, d):
    """A run written as JSON lines and read back."""
    done = runs.run(spark, project(folder(), cases=nations(spark, d)))
    path = f"{runs.shared_folder(spark)}/{uuid.uuid4().hex}"
    export.json_lines(done.results).write.text(path)
    return scoring.judged(files.results_log(spark, path)).select("case_id", "output", "passed")


@query(
    """SELECT variant, model, case_id, cell_score AS score, p1::INT::DOUBLE AS answer FROM results""",
    base=True,
)
def json_export(spark, d):
    lines = export.json_lines(demo.results(spark, d).drop("text", "prompt")).select("value")
    r = F.from_json("value", "variant string, model string, case_id string, error string, scores map<string, struct<weight:double, score:double>>")
    total = F.aggregate(F.map_values("r.scores"), F.lit(0.0), lambda a, e: a + e["weight"])
    points = F.aggregate(F.map_values("r.scores"), F.lit(0.0), lambda a, e: a + e["weight"] * e["score"])
    score = F.when(F.col("r.error").isNull(), F.round(points / total, 6)).otherwise(0.0)
    return lines.select(r.alias("r")).select("r.variant", "r.model", "r.case_id", score.alias("score"), F.col("r.scores")["answer"]["score"].alias("answer"))


@query(f"SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE ask = expected)::BIGINT AS good FROM ({_ASKED})")
def html_report_rows(spark, d):
    """Rows of the cell table of an HTML report, and those not marked as failing."""
    done = runs.run(spark, project(folder(), cases=nations(spark, d)))
    cells = export.html_report(done.meta, done.results).split("<table>")[2]
    bad = cells.count("<tr class=no>")
    return spark.createDataFrame([(cells.count("<tr") - 1, cells.count("<tr") - 1 - bad)], "rows long, good long")


@query(f"SELECT 'plain' AS variant, 'echo' AS model, count(*)::BIGINT AS cells, printf('%.3f', avg((ask = expected)::INT)) AS score FROM ({_ASKED})")
def markdown_matrix(spark, d):
    done = runs.run(spark, project(folder(), cases=nations(spark, d)))
    rows = [line.strip("| ").split(" | ") for line in export.markdown(done.meta, done.results).splitlines() if line.startswith("| plain")]
    return spark.createDataFrame([(r[0], r[1], int(r[2]), r[3]) for r in rows], "variant string, model string, cells long, score string")


@query("SELECT count(DISTINCT text)::BIGINT AS entries, true AS has_bytes FROM documents")
def cache_stats(spark, d):
    """What the response cache holds after every document was asked once."""
    cache = runs.Responses(folder())
    asked = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("request_key"), F.col("text").alias("output")).where("output IS NOT NULL")
    none = F.lit(None)
    cache.add(asked.withColumns({"input_tokens": none.cast("long"), "output_tokens": none.cast("long"), "cost_usd": none.cast("double"), "error": none.cast("string")}))
    return cache.stats(spark).select("entries", (F.col("bytes") > 0).alias("has_bytes"))


@query("SELECT 0::BIGINT AS entries FROM documents LIMIT 1")
def cache_prune(spark, d):
    cache = runs.Responses(folder())
    cache.add(table(spark, d, "nation").select(F.sha2(F.col("n_name").cast("binary"), 256).alias("request_key"), F.col("n_name").alias("output"), F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(0.0).alias("cost_usd"), F.lit(None).cast("string").alias("error")))
    cache.prune(float("inf"))
    return cache.stats(spark).select("entries")


@query("SELECT sha256(n_name) AS sha256, n_name AS content FROM nation")
def run_artifacts(spark, d):
    """The attachments of a run, each content once."""
    base = folder()
    given = nations(spark, d)
    for c in given:
        for copy in ("a", "b"):
            (base / f"{c['id']}{copy}.png").write_bytes(c["vars"]["ask"].encode())
    both = [{"id": f"{c['id']}{copy}", "files": {"shot": f"{c['id']}{copy}.png"}, "expected": "x"} for c in given for copy in ("a", "b")]
    c = project(base, cases=both, variants=[{"name": "plain", "prompt": [{"role": "user", "content": [{"image": "{{ files.shot }}"}]}]}])
    done = runs.run(spark, c)
    return Store(c.place(c.settings.output_dir)).artifacts(spark, done.run_id).select("sha256", F.col("content").cast("string").alias("content"))


@query("SELECT c_mktsegment AS segment, 'the runs drew different samples (' || (count(*) // 2) || ' with seed 1, ' || (count(*) // 2) || ' with seed 2)' AS note FROM customer GROUP BY 1 HAVING count(*) > 1")
def comparison_note(spark, d):
    """Two runs, each over half of a segment's customers, drawn with other seeds."""
    sizes = table(spark, d, "customer").groupBy("c_mktsegment").count().where("count > 1").collect()
    of = lambda n, seed: {"id": str(seed), "matrix": {"cases": "x"}, "selection": {"sample": n // 2, "seed": seed, "available": n}}
    return spark.createDataFrame([(name, runs.selection_note(of(n, 1), of(n, 2))) for name, n in sizes], "segment string, note string")


@query("SELECT (SELECT count(*) FROM nation)::BIGINT AS concurrency, true AS cache FROM region LIMIT 1")
def settings_layers(spark, d):
    """The user's file, under the configuration, under the environment, under the command line: numbers counted in the tables."""
    base = folder()
    regions, all_nations = table(spark, d, "region").count(), nations(spark, d)
    (base / "user.yaml").write_text("concurrency: 3\ncache: false\n")
    c = project(base, cases=all_nations, settings={"concurrency": regions})
    got = settings.resolve(c, {"concurrency": len(all_nations)}, {"PROMPTMATRIX_USER_CONFIG": str(base / "user.yaml"), "PROMPTMATRIX_CACHE": "on"}).settings
    return spark.createDataFrame([(got.concurrency, got.cache)], "concurrency long, cache boolean")


@query("SELECT i::BIGINT AS wave, least(i * (n // 4 + 1), n)::BIGINT AS cells, least(i * (n // 4 + 1), n)::BIGINT AS passed FROM (SELECT count(*) AS n FROM customer), LATERAL (SELECT unnest(range(1, (n + n // 4) // (n // 4 + 1) + 1)) AS i)")
def wave_tallies(spark, d):
    """What a listener hears of a run over all customers that goes in four waves."""
    base, quarter = folder(), table(spark, d, "customer").count() // 4 + 1
    c = project(base, cases=customers(spark, d, base), models=[{"id": "echo", "provider": "mock", "params": {"fail_times": 0}}], scorecard=[{"criterion": "says", "scorer": {"type": "contains", "value": "Customer", "case_sensitive": False}}])
    told: list[tuple[int, int]] = []
    runs.run(spark, c, on_wave=lambda tally: told.append((tally.cells, tally.passed)), wave_cells=quarter)
    return spark.createDataFrame([(i, n, ok) for i, (n, ok) in enumerate(told, 1)], "wave long, cells long, passed long")
