"""Templates as expressions against the renderer, runs that need no Python to render, and rates over waves."""

from __future__ import annotations

import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import promptmatrix as pm
from promptmatrix.errors import TemplateError
from promptmatrix.functions import template, template_columns
from promptmatrix.operators import scoring
from promptmatrix.plans import run as runs

VALUES = [
    None, True, False, 0, 1, -7, 12345678901234567890, 3.5, 100.0, 1.50, 0.1, -0.0, 1e-5, 123456.789, 2.5e10, "", "a", "It's", "  x ", "ÉÈ", "ß", "5", " 12.7 ", "-3", "hello World", "a,b",
    [], ["b", "a"], [1, 2.5, None], ["x", ["y"]], {}, {"k": "v", "n": 1}, {"k": [{"z": 1}, {"z": 2}]}, [{"k": "v"}, {"k": 2}], "x\x1c", 0.30000000000000004, 1e22,
]
TEMPLATES = [
    "x", "{{ a }}-{{ b }}", "{% if a %}yes{% elif b %}b{% else %}no{% endif %}", "{% for x in a %}[{{ x }}]{% endfor %}", "{{ a['k'] }} {{ a[0] }}", "{{ a.k }}", "{{ a[0] | default('none') }}", "{{ a|default('z') }}",
    "{{ a|trim }}", "{{ a|lower }}|{{ b|upper }}", "{{ a|length }}", "{{ a|join(', ') }}", "{{ a|tojson }}", "{{ a|int }}", "{{ a|int(9) }}", "{{ a|first }}", "{{ a|last }}", "{{ a|sort|join('/') }}", "{{ a|title }}", "{{ a|capitalize }}",
    "{{ a|replace('l','L') }}", "{{ a + b }}", "{{ a - b }}", "{{ a * 2 }}", "{{ a / b }}", "{{ a // 3 }} {{ a % 3 }}", "{{ a ~ b }}", "{{ a == b }}", "{{ a != b }}", "{{ a < b }}", "{{ a >= b }}", "{{ a in b }}", "{{ 'a' in a }}",
    "{{ a and b }}", "{{ a or b }}", "{{ not a }}", "{{ a is defined }}", "{{ a.k is defined }}", "{{ a[0] is defined }}", "{{ a is none }}", "{% for x in a %}{{ loop.index }}:{{ x.k }}{% if not loop.last %}, {% endif %}{% endfor %}",
    "{% for x in a.k %}{% for y in b %}{{ x.z }}{{ y }}{% endfor %}{% endfor %}", "{% if a == 'a' and b is defined %}A{{ b }}{% endif %}", "{{ a|abs }}", "{{ -a }}", "{{ (a ~ b)|upper }}", "{% if a is defined and a|length > 1 %}{{ a }}{% endif %}",
]


def test_expressions_never_differ_from_the_renderer(spark):
    """Where an expression gives a text it is the renderer's; where the renderer gives an error the expression gives nothing; plain cases are all given."""
    rng = random.Random(8)
    rows = [{k: rng.choice(VALUES) for k in "ab" if rng.random() < 0.9} for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, v string").withColumn("p", F.try_parse_json("v")).cache()
    look = template_columns.of_variant(F.col("p"))
    given = 0
    for i in range(0, len(TEMPLATES), 8):
        part = TEMPLATES[i : i + 8]
        for row in df.select("i", *(template_columns.compile(s, lambda _: look).alias(f"t{j}") for j, s in enumerate(part))).collect():
            for j, source in enumerate(part):
                try:
                    want = template.render(source, rows[row.i])
                except TemplateError:
                    want = None
                assert row[f"t{j}"] in (None, want), (source, rows[row.i])
                given += row[f"t{j}"] is not None
    assert given > 0.35 * len(rows) * len(TEMPLATES)
    for source in ("{{ a[b] }}", "{{ a|round }}", "{{ [a]|join }}"):
        assert template_columns.compile(source, lambda _: look) is None


def config(tmp_path: Path, n: int, prompt: str, **change) -> pm.Config:
    return pm.parse({
        "models": [{"id": "parrot", "provider": "mock"}], "variants": [{"name": "v", "prompt": [{"role": "system", "content": "Be brief."}, {"role": "user", "content": prompt}]}],
        "cases": [{"id": f"n{i}", "vars": {"ask": f"q{i}", "tags": ["x", "y"], "n": i}, "expected": f"q{i}"} for i in range(n)], "scorecard": [{"criterion": "has", "scorer": {"type": "contains"}}],
    } | change, tmp_path)


LOOP = "{% if n > 2 %}Much: {% endif %}{{ ask|trim }} {% for t in tags %}{{ loop.index }}{{ t }}{% if not loop.last %},{% endif %}{% endfor %}"


def test_runs_render_without_python(spark, tmp_path):
    bound = runs.bind_config(spark, config(tmp_path, 6, LOOP), pm.Selection())
    cells = runs._by_expression(bound, runs._cells(bound))
    assert "Python" not in cells._jdf.queryExecution().executedPlan().toString()
    assert [r.messages[1].parts[0].text for r in cells.orderBy("cell_ord").collect()] == [template.render(LOOP, {"ask": f"q{i}", "tags": ["x", "y"], "n": i}) for i in range(6)]
    mixed = config(tmp_path, 3, "{{ ask }}", cases=[{"id": "a", "vars": {"ask": "one"}, "expected": "one"}, {"id": "b", "vars": {"ask": ["l", 1]}, "expected": "['l', 1]"}, {"id": "c", "vars": {}, "expected": "x"}])
    done = pm.run(spark, mixed)
    rows = {r.case_id: r for r in done.results.collect()}
    assert rows["a"].passed and rows["b"].passed and rows["b"].output == "['l', 1]" and "'ask' is undefined" in rows["c"].error


def test_figures_of_waves_are_those_of_the_results(spark, tmp_path):
    c = config(tmp_path, 30, "{{ ask }}", models=[{"id": "parrot", "provider": "mock", "params": {"fail_times": 0, "cost": 0.1}}, {"id": "no", "provider": "mock", "params": {"response": "no"}}])
    done = pm.run(spark, c, wave_cells=11)
    assert done.meta["aggregates"]["overall"] == scoring.overall(done.results).first().asDict()
    assert done.meta["aggregates"]["matrix"] == [r.asDict() for r in scoring.matrix(done.results).collect()]
    assert {k: v for k, v in done.meta["totals"].items() if not k.startswith("judge")} == scoring.totals(done.results).first().asDict()


@pytest.mark.parametrize("waves", [2])
def test_rate_holds_over_waves(spark, tmp_path, monkeypatch, waves):
    """Three calls a minute in waves of two: no 60 seconds hold more than three starts, by the times the provider wrote down."""
    log = tmp_path / "log"
    (tmp_path / "note.py").write_text(f"import sys,time\nsys.stdin.read()\nopen({str(log)!r}, 'a').write(str(time.time()) + '\\n')\nprint('ok')")
    c = config(tmp_path, 5, "{{ ask }}", models=[{"id": "slow", "provider": "command", "command": "python3 note.py", "requests_per_minute": 3}])
    began = time.time()
    pm.run(spark, c, wave_cells=waves)
    times = sorted(float(t) for t in log.read_text().split())
    assert len(times) == 5 and all(b - a > 59.5 for a, b in zip(times, times[3:], strict=False)) and time.time() - began < 150
