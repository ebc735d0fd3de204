"""A stored run as JSON, CSV, Markdown or HTML.

Large tables are written by Spark; only report texts, whose rows are limited,
are built on the driver.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmatrix.errors import ConfigError
from promptmatrix.operators import results as r
from promptmatrix.operators import scoring

#: Cells up to which an HTML report shows all; beyond, the first failures only.
WHOLE, SUMMARY = 2000, 200


def score_map(rows: DataFrame) -> DataFrame:
    """Results with scores keyed by criterion, as the portable form has them."""
    entry = lambda e: F.struct(e["criterion"].alias("key"), F.struct(e["weight"].alias("weight"), e["score"].alias("score"), e["passed"].alias("passed"), e["detail"].alias("detail"), e["error"].alias("error")).alias("value"))
    return rows.withColumn("scores", F.map_from_entries(F.transform("scores", entry)))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a cell, in the order of the run."""
    keep = [c for c in rows.columns if c not in ("cell_score", "passed")]
    return score_map(rows.select(keep)).orderBy("cell_ord").select(F.to_json(F.struct(*keep)).alias("value"))


def as_json(meta: dict[str, Any], rows: DataFrame) -> Iterator[str]:
    """The run and its results as pieces of one JSON document, cells streamed one partition at a time."""
    yield '{"run": ' + json.dumps(meta, sort_keys=True, default=str) + ', "results": ['
    for i, row in enumerate(json_lines(rows).toLocalIterator()):
        yield (", " if i else "") + row["value"]
    yield "]}"


def write_csv(rows: DataFrame, path: str) -> None:
    """The wide table as CSV files in a folder, one header each."""
    names = [x["criterion"] for x in scoring.criteria(rows).collect()]
    r.wide(rows, names).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _cell(value: Any) -> str:
    return re.sub(r"\s*[\r\n]+\s*", " ", str(value).replace("\\", "\\\\").replace("|", "\\|"))


def _percent(x: float) -> str:
    return f"{x * 100:.1f}%"


def markdown(meta: dict[str, Any], rows: DataFrame, first: int = 20) -> str:
    """Overall numbers, the gate, the matrix, and the first failures."""
    whole, gate = meta["aggregates"]["overall"], meta.get("gate")
    out = [f"# Run {meta['id']}", "", f"{whole['cases']} cells, score {whole['score']:.3f}, pass rate {_percent(whole['pass_rate'])}, {whole['errors']} errors", ""]
    if gate:
        out += [f"Gate: **{'passed' if gate['passed'] else 'failed'}**", *(f"- {'ok' if c['passed'] else 'FAIL'} {c['name']}: {c['detail']}" for c in gate["checks"]), ""]
    out += ["| variant | model | cells | score | pass rate | errors |", "|-|-|-|-|-|-|"]
    out += [f"| {_cell(m['variant'])} | {_cell(m['model'])} | {m['cases']} | {m['score']:.3f} | {_percent(m['pass_rate'])} | {m['errors']} |" for m in meta["aggregates"]["matrix"]]
    failed = r.failures(rows, first + 1).select("variant", "model", "case_id", "error", "output").collect()
    if failed:
        total = rows.where("not passed").count()
        out += ["", f"## Failures ({total})", ""]
        out += [f"- {_cell(f['variant'])} / {_cell(f['model'])} / {_cell(f['case_id'])}: {_cell((f['error'] or f['output'] or '')[:200])}" for f in failed[:first]]
        if total > first:
            out.append(f"- … and {total - first} more")
    return "\n".join(out) + "\n"


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left;vertical-align:top}.no{background:#fdd}pre{white-space:pre-wrap;margin:0}"


def _page(title: str, body: list[str]) -> str:
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>{"".join(body)}</body></html>'


def _table(head: list[str], rows: list[list[Any]], bad: list[bool] | None = None) -> str:
    lines = ["<tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>"]
    for i, row in enumerate(rows):
        lines.append(f"<tr{' class=no' if bad and bad[i] else ''}>" + "".join(f"<td><pre>{html.escape(str(x))}</pre></td>" for x in row) + "</tr>")
    return "<table>" + "".join(lines) + "</table>"


def html_report(meta: dict[str, Any], rows: DataFrame) -> str:
    """A page without scripts: the matrix, then all cells with failing cases first, or of a large run the first failures."""
    whole = meta["aggregates"]["overall"]
    large = whole["cases"] > WHOLE
    shown = (r.failures(rows, SUMMARY) if large else r.for_report(rows)).select("case_id", "variant", "model", "passed", "cell_score", "output", "error", "scores").collect()
    body = [f"<p>{whole['cases']} cells, score {whole['score']:.3f}, pass rate {_percent(whole['pass_rate'])}, {whole['errors']} errors</p>"]
    body.append(_table(["variant", "model", "cells", "score", "pass rate", "errors"], [[m["variant"], m["model"], m["cases"], f"{m['score']:.3f}", _percent(m["pass_rate"]), m["errors"]] for m in meta["aggregates"]["matrix"]]))
    if large:
        body.append(f"<p>The run has {whole['cases']} cells; the first {len(shown)} failures follow.</p>")
    detail = lambda s: "; ".join(f"{e['criterion']}: {'pass' if e['passed'] else e['error'] or e['detail'] or 'fail'}" for e in s or [])
    body.append(_table(["case", "variant", "model", "score", "output", "criteria"], [[x["case_id"], x["variant"], x["model"], f"{x['cell_score']:.3f}", x["error"] or x["output"] or "", detail(x["scores"])] for x in shown], [not x["passed"] for x in shown]))
    return _page(f"Run {meta['id']}", body)


def _delta(x: float) -> str:
    return "=" if abs(x) < 1e-9 else f"{x:+.3f}"


def html_compare(a: dict[str, Any], b: dict[str, Any], compared: DataFrame, note: str | None = None) -> str:
    """Two runs side by side, with the caveat above the table."""
    rows = compared.collect()
    both = [x for x in rows if x["side"] == "both"]
    body = [f"<p>{html.escape(note)}</p>"] if note else []
    body.append(_table(["variant", "model", "score a", "score b", "delta", "pass a", "pass b", "delta"], [[x["variant"], x["model"], f"{x['score_a']:.3f}", f"{x['score_b']:.3f}", _delta(x["score_delta"]), _percent(x["pass_rate_a"]), _percent(x["pass_rate_b"]), _delta(x["pass_rate_delta"])] for x in both]))
    for side, run in (("only_a", a), ("only_b", b)):
        if only := [[x["variant"], x["model"]] for x in rows if x["side"] == side]:
            body += [f"<p>Only in {html.escape(run['id'])}</p>", _table(["variant", "model"], only)]
    return _page(f"{a['id']} and {b['id']}", body)


def calibration_project(pairs: DataFrame) -> Iterator[tuple[str, str]]:
    """Files of a project that measures a judge: the cases, two rubrics, the configuration."""
    lines = pairs.select(F.to_json(F.struct(F.col("case_id").alias("id"), F.col("output").alias("answer"), F.from_json(F.col("human_label").cast("string"), "string").alias("human_label")), {"ignoreNullFields": "false"}).alias("v"))
    yield "cases.jsonl", "".join(x["v"] + "\n" for x in lines.toLocalIterator())
    for name, manner in (("strict", "Be strict: any error fails."), ("lenient", "Be lenient: judge the substance.")):
        yield f"rubric_{name}.yaml", f"- role: system\n  content: You grade answers. {manner} Reply with JSON having score and rationale.\n- role: user\n  content: '{{{{ answer }}}}'\n"
    yield "eval.yaml", (
        "models:\n  - {id: judge-model, provider: mock, params: {response: '{\"score\": 1}'}}\nvariants:\n  - {name: strict, prompt: rubric_strict.yaml}\n  - {name: lenient, prompt: rubric_lenient.yaml}\n"
        "cases: {file: cases.jsonl}\nscorecard:\n  - {criterion: agrees, scorer: {type: agreement, mode: exact}}\n"
    )


def write(meta: dict[str, Any], rows: DataFrame, form: str, path: str | None = None) -> str | None:
    """A run as json, csv, md or html: into a file, or as text where no path is given (csv needs one)."""
    if form == "csv":
        write_csv(rows, path or f"{meta['id']}.csv")
        return None
    makers = {"json": lambda: as_json(meta, rows), "md": lambda: [markdown(meta, rows)], "html": lambda: [html_report(meta, rows)]}
    if form not in makers:
        raise ConfigError(f"no export as {form!r}: json, csv, md or html")
    if path is None:
        return "".join(makers[form]())
    with open(path, "w", encoding="utf-8") as f:
        for piece in makers[form]():
            f.write(piece)
    return None
