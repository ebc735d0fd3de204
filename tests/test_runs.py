"""What a run costs, stores and asks for: cells counted once, pages fetched once, waves kept."""

from __future__ import annotations

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import promptmatrix as pm
from promptmatrix import cli, secrets, tools
from promptmatrix.operators import matrix
from promptmatrix.plans import run as runs
from promptmatrix.providers import calls
from promptmatrix.sources import cases, files
from promptmatrix.sources.folders import Folder
from promptmatrix.sources.store import Store

SOURCE = """
import pathlib
from promptmatrix import Page

class Numbers:
    def __init__(self, log, total=None, loop=False):
        self.log, self.total, self.loop = pathlib.Path(log), total, loop

    def fetch(self, cursor, limit):
        at = int(cursor or 0)
        with self.log.open("a") as f:
            f.write(f"{at}\\n")
        end = at + limit if self.total is None else min(self.total, at + limit)
        follows = None if end == self.total else "1" if self.loop else str(end)
        return Page([{"id": f"n{i}", "vars": {"ask": str(i)}, "expected": str(i)} for i in range(at, end)], follows)

    def close(self):
        with self.log.open("a") as f:
            f.write("closed\\n")

def make(**params):
    return Numbers(**params)
"""


def project(tmp_path: Path, **change) -> pm.Config:
    data = {
        "models": [{"id": "parrot", "provider": "mock"}],
        "variants": [{"name": "short", "prompt": [{"role": "user", "content": "{{ ask }}"}]}, {"name": "long", "prompt": [{"role": "user", "content": "Please: {{ ask }}"}]}],
        "cases": [{"id": f"n{i}", "vars": {"ask": str(i)}, "expected": str(i)} for i in range(8)],
        "scorecard": [{"criterion": "equal", "scorer": {"type": "exact"}}],
    } | change
    return pm.parse(data, tmp_path)


def source(tmp_path: Path, page_size: int = 4, limit: int | None = None, **params) -> dict:
    (tmp_path / "numbers.py").write_text(SOURCE)
    return {"source": "numbers.py:make", "page_size": page_size, "params": {"log": str(tmp_path / "log"), **params}} | ({"limit": limit} if limit else {})


def judging(**more) -> dict:
    return {
        "models": [{"id": "parrot", "provider": "mock"}, {"id": "grader", "provider": "mock", "role": "judge", "params": {"response": '{"score": 1}', "cost": 1.0}}],
        "judges": {"same": {"model": "grader", "rubric": [{"role": "user", "content": "{{ output }} for {{ vars.ask }}"}]}},
        "scorecard": [{"criterion": "graded", "scorer": {"type": "llm-judge", "judge": "same"}}],
    } | more


@pytest.mark.parametrize("how", [{"cases": ["n3", "n5"]}, {"sample": 2, "seed": 4}])
def test_judged_cells_of_some_cases(spark, tmp_path, how):
    c = project(tmp_path, **judging())
    done = pm.run(spark, c, pm.Selection(**how), cache=False)
    written = spark.read.parquet(Folder(tmp_path / ".promptmatrix/runs").sub(done.run_id).sub("results").uri)
    assert written.count() == done.meta["totals"]["total"] == 4
    assert done.meta["totals"]["judge_cost_usd"] == 4.0 and done.meta["totals"]["judge_calls"] == 4
    assert written.select("cell_ord").distinct().count() == 4


def test_order_has_room_for_gaps(spark):
    some = spark.createDataFrame([(3, "c"), (90, "d"), (1 << 40, "e")], "case_pos long, case_id string")
    two, three = matrix.names(spark, "variant", ["a", "b"], "v_ord"), matrix.names(spark, "model", ["x", "y", "z"], "m_ord")
    for major in (False, True):
        rows = matrix.product(two, three, some, major).collect()
        assert len({r.cell_ord for r in rows}) == 18
        key = (lambda r: (r.case_pos, r.v_ord, r.m_ord)) if major else (lambda r: (r.v_ord, r.m_ord, r.case_pos))
        assert sorted(rows, key=lambda r: r.cell_ord) == sorted(rows, key=key)
    assert matrix.product(two, three.limit(0), some).count() == 0
    assert {r.case_id for r in matrix.sampled(some, [0, 2]).collect()} == {"c", "e"}


def test_pages_are_fetched_once(spark, tmp_path):
    c = project(tmp_path, cases=source(tmp_path, total=11), scorecard=[{"criterion": "equal", "scorer": {"type": "exact"}}, {"criterion": "digits", "scorer": {"type": "regex", "pattern": "[0-9]"}}])
    assert pm.estimate(spark, c) is None and (tmp_path / "log").read_text().split() == ["0", "closed"]
    (tmp_path / "log").unlink()
    assert pm.dry_run(spark, c).count() == 8 and (tmp_path / "log").read_text().split() == ["0", "closed"]
    (tmp_path / "log").unlink()
    capped = project(tmp_path, cases=source(tmp_path, total=11, limit=10))
    done = pm.run(spark, capped)
    assert done.meta["totals"]["total"] == 20 and (tmp_path / "log").read_text().split() == ["0", "4", "8", "closed"]
    assert {r.case_id for r in done.results.collect()} == {f"n{i}" for i in range(10)}


def test_endless_sources(spark, tmp_path):
    c = project(tmp_path, cases=source(tmp_path), models=[{"id": "parrot", "provider": "mock", "params": {"cost": 1.0}}])
    with pytest.raises(pm.ConfigError, match="no limit"):
        pm.run(spark, c)
    done = pm.run(spark, c, pm.Selection(max_cost=9), cache=False)
    assert done.meta["stopped_early"] == "budget" and 9 <= done.meta["totals"]["total"] <= 10
    assert len((tmp_path / "log").read_text().split()) <= 3
    circle = project(tmp_path, cases=source(tmp_path, page_size=1, limit=9, total=50, loop=True))
    with pytest.raises(Exception, match="circles"):
        pm.run(spark, circle)


def test_waves_are_kept_and_told(spark, tmp_path):
    c = project(tmp_path, models=[{"id": "parrot", "provider": "mock", "params": {"fail_times": 0}}])
    told = []

    def listen(tally: pm.Tally) -> None:
        told.append((tally.cells, tally.passed))
        if len(told) == 2:
            raise KeyboardInterrupt  # not a fault of the listener: the run is stopped from outside

    with pytest.raises(KeyboardInterrupt):
        pm.run(spark, c, on_wave=listen, wave_cells=6)
    assert told == [(6, 6), (12, 8)]
    store = Store(tmp_path / ".promptmatrix/runs")
    stopped = store.resolve("latest")
    assert store.results(spark, stopped).count() == 12 and store.meta(stopped)["status"] == "running"
    rest = pm.run(spark, c, resume=stopped, on_wave=lambda tally: 1 / 0)
    assert rest.meta["status"] == "complete" and rest.meta["totals"]["total"] == 16


def test_calls_in_flight_stay_under_the_caps():
    for most, concurrency, models, rate, cores in ((None, 8, 1, None, 4), (3, 8, 1, None, 4), (None, 8, 3, None, 16), (20, 8, 1, 2, 16), (None, 1, 5, 7, 8)):
        s = calls.share({"max_concurrency": most, "requests_per_minute": rate}, concurrency, models, cores)
        assert 1 <= s.tasks * s.in_flight <= max(1, min(most or concurrency, concurrency // models))
        if rate:
            dealt = calls.slots(s.per_minute, [5.0])
            assert s.tasks <= rate and sorted(t for i in range(s.tasks) for t in dealt[i :: s.tasks]) == [0.0] * (rate - 1) + [5.0]


def test_calls_overlap(spark, tmp_path):
    (tmp_path / "slow.py").write_text("import sys,time\nsys.stdin.read()\ntime.sleep(0.5)\nprint('ok')")
    c = project(tmp_path, models=[{"id": "slow", "provider": "command", "command": "python3 slow.py"}], scorecard=[{"criterion": "ok", "scorer": {"type": "contains", "value": "ok"}}], settings={"concurrency": 16})
    began = time.monotonic()
    assert pm.run(spark, c).meta["aggregates"]["overall"]["pass_rate"] == 1.0
    assert time.monotonic() - began < 0.5 * 16 + 8


def test_settings_in_layers(tmp_path):
    (tmp_path / "user.yaml").write_text("concurrency: 3\ncache: false\noutput_dir: mine\n")
    env = {"PROMPTMATRIX_USER_CONFIG": str(tmp_path / "user.yaml")}
    c = project(tmp_path, settings={"concurrency": 5})
    got = pm.resolve_settings(c, env=env)
    assert (got.settings.concurrency, got.settings.cache, got.place(got.settings.output_dir)) == (5, False, str(tmp_path / "mine"))
    got = pm.resolve_settings(c, {"output_dir": "here", "concurrency": None}, env | {"PROMPTMATRIX_CONCURRENCY": "7", "PROMPTMATRIX_CACHE": "YES", "PROMPTMATRIX_CACHE_DIR": "hdfs://a/b"})
    assert (got.settings.concurrency, got.settings.cache) == (7, True)
    assert got.place(got.settings.output_dir) == str(Path.cwd() / "here") and got.place(got.settings.cache_dir) == "hdfs://a/b"
    for bad in ({"PROMPTMATRIX_CACHE": "perhaps"}, {"PROMPTMATRIX_CONCURRENCY": "many"}, {"PROMPTMATRIX_CONCURRENCY": "0"}):
        with pytest.raises(pm.ConfigError):
            pm.resolve_settings(c, env=bad | {"HOME": str(tmp_path)})


def test_folders_by_address(spark, tmp_path):
    c = project(tmp_path, settings={"output_dir": (tmp_path / "away").as_uri(), "cache_dir": (tmp_path / "store").as_uri()})
    done = pm.run(spark, c, label="far")
    store = Store(c.place(c.settings.output_dir))
    assert store.resolve("far") == done.run_id == store.set_baseline("far") == store.baseline() and (tmp_path / "away" / done.run_id / "run.json").is_file()
    cache = runs.Responses(c.place(c.settings.cache_dir))
    assert cache.stats(spark).first().entries == 16 and cache.prune(1e12) > 0 and cache.stats(spark).first().entries == 0
    assert pm.run(spark, c, cache=False).meta["totals"]["total"] == 16


def test_keys_reach_providers(spark, tmp_path):
    (tmp_path / secrets.NAME).write_text("OWN_KEY: not-to-be-seen\n")
    c = project(tmp_path, models=[{"id": "m", "provider": "openai-compatible", "base_url": "http://127.0.0.1:9", "api_key_env": "OWN_KEY", "max_retries": 0, "timeout_s": 1}])
    assert secrets.keys(c, {"HOME": str(tmp_path)}) == {"OWN_KEY": "not-to-be-seen"}
    missing = pm.run(spark, c, pm.Selection(cases=["n1"], variants=["short"])).results.first().error
    reached = pm.run(spark, c, pm.Selection(cases=["n1"], variants=["short"]), keys={"OWN_KEY": "not-to-be-seen"}).results.first().error
    assert "OWN_KEY is not set" in missing and "request failed" in reached


def test_positions_of_parquet_cases(spark, tmp_path):
    for i, n in enumerate((5, 0, 7)):
        spark.createDataFrame([(f"q{i}.{k}",) for k in range(n)], "ask string").coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    paths = sorted(tmp_path.glob("part*/*.parquet"))
    (tmp_path / "all.parquet").mkdir()
    for i, p in enumerate(paths):
        p.rename(tmp_path / "all.parquet" / f"{i}.parquet")
    got = cases.dataset(spark, tmp_path / "all.parquet").orderBy("case_pos").collect()
    assert [(r.case_pos, r.case_id) for r in got] == [(i, f"case-{i + 1}") for i in range(12)]
    assert [json.loads(r.vars)["ask"] for r in got] == [f"q0.{k}" for k in range(5)] + [f"q2.{k}" for k in range(7)]


def test_artifacts_are_kept_once(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"one")
    (tmp_path / "b.png").write_bytes(b"one")
    c = project(tmp_path, variants=[{"name": "v", "prompt": [{"role": "user", "content": [{"image": "{{ files.shot }}"}]}]}], cases=[{"id": n, "files": {"shot": f"{n}.png"}, "expected": "x"} for n in "ab"])
    done = pm.run(spark, c)
    kept = Store(tmp_path / ".promptmatrix/runs").artifacts(spark, done.run_id).collect()
    assert [(bytes(r.content), r.media_type) for r in kept] == [(b"one", "image/png")]


def test_torn_logs_are_repaired(tmp_path):
    log = tmp_path / "results.jsonl"
    for text, left in (("", ""), ('{"a": 1}\n', '{"a": 1}\n'), ('{"a": 1}\n{"b', '{"a": 1}\n'), ("x" * 200_000, ""), ("y\n" + "x" * 200_000, "y\n")):
        log.write_text(text)
        assert files.repair_log(log) == len(text) - len(left) and log.read_text() == left


def test_tools_by_name(spark, tmp_path):
    path = tmp_path / "eval.yaml"
    path.write_text(cli.STARTER)
    assert tools.call(spark, "run_eval", {"config": str(path)})["status"] == "complete"
    assert len(tools.call(spark, "list_runs", {"config": str(path)})) == 1
    for name, arguments in (("run_eval", {"config": str(path), "colour": 1}), ("get_case_result", {"config": str(path)}), ("nothing", {})):
        with pytest.raises(pm.ConfigError):
            tools.call(spark, name, arguments)
    assert tools.config_schema()["additionalProperties"] is False and "spark" not in tools.schema_of("run_eval")["properties"]
    assert [(c["ok"], c["detail"]) for c in tools.probe(str(path))] == [(True, "Reply with OK.")]


def test_texts_on_the_terminal():
    assert cli.plain("a\x1b[31mb\tc") == "a\\x1b[31mb\tc"
    assert cli.clipped("\n".join("l%d" % i for i in range(30))).endswith("l19\n… 40 more characters")
    assert cli.clipped("x" * 3000) == "x" * 2000 + "\n… 1000 more characters" and cli.clipped("short") == "short"


def test_scores_are_not_worked_out_in_filters(spark, tmp_path):
    from promptmatrix.operators import scoring

    cells = spark.range(3).select(F.lit("v").alias("variant"), F.col("id").cast("string").alias("output"), F.lit(None).cast("string").alias("error"))
    graded = scoring.judged(scoring.scorecard(cells, [{"criterion": "c", "scorer": {"type": "regex", "pattern": "marker[0-9]"}}])).where("not passed")
    plan = graded._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "marker" in line for line in plan.splitlines())
