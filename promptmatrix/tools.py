"""The engine as seven plain functions with JSON-like answers, for agents and notebooks, behind one checked call."""

from __future__ import annotations

import inspect
import os
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from promptmatrix import secrets, settings, spec
from promptmatrix.errors import ConfigError, MatrixError
from promptmatrix.operators import results, scoring
from promptmatrix.plans import run as runs
from promptmatrix.providers import calls
from promptmatrix.sources.store import Store

#: Failures that a summary carries, results on a page, characters of a long text.
FIRST, PAGE, LONG = 5, 20, 600


def _load(config: str) -> spec.Config:
    return settings.resolve(spec.load(config))


def _store(config: spec.Config) -> Store:
    return Store(config.place(config.settings.output_dir))


def _short(text: str | None) -> str | None:
    return text if text is None or len(text) <= LONG else f"{text[:LONG]}… ({len(text) - LONG} more chars)"


def _brief(row: Any) -> dict[str, Any]:
    return {"variant": row.variant, "model": row.model, "case_id": row.case_id, "passed": row.passed, "score": row.cell_score, "error": _short(row.error), "output": _short(row.output)}


def run_eval(spark: SparkSession, config: str, variants: list[str] | None = None, models: list[str] | None = None, cases: list[str] | None = None, sample: int | None = None, seed: int | None = None, max_cost: float | None = None, label: str | None = None) -> dict[str, Any]:
    c = _load(config)
    done = runs.run(spark, c, runs.Selection(variants, models, cases, sample, seed, max_cost), label, secrets=secrets.values(c.base), keys=secrets.keys(c))
    return get_run(spark, config, done.run_id)


def get_run(spark: SparkSession, config: str, ref: str = "latest", page: int | None = None) -> dict[str, Any]:
    """Aggregates and the first failures, or a page of results (from 1)."""
    store = _store(_load(config))
    meta = store.meta(store.resolve(ref))
    rows = scoring.judged(store.results(spark, meta["id"]))
    out = {k: meta.get(k) for k in ("id", "label", "status", "aggregates", "totals", "gate", "warnings", "stopped_early")}
    if page is None:
        return out | {"failures": [_brief(r) for r in results.failures(rows, FIRST).collect()]}
    total = (meta.get("aggregates") or {}).get("overall", {}).get("cases", 0)
    return out | {"results": [_brief(r) for r in results.page(rows, page, PAGE).collect()], "total": total, "has_more": page * PAGE < total}


def get_case_result(spark: SparkSession, config: str, ref: str, variant: str, model: str, case_id: str) -> dict[str, Any]:
    store = _store(_load(config))
    row = results.one(scoring.judged(store.results(spark, store.resolve(ref))), variant, model, case_id).first()
    if row is None:
        raise ConfigError(f"no result for {variant} / {model} / {case_id}")
    return _brief(row) | {"messages": [m.asDict(recursive=True) for m in row.messages or []], "scores": [s.asDict() for s in row.scores]}


def compare_runs(spark: SparkSession, config: str, a: str, b: str) -> dict[str, Any]:
    store = _store(_load(config))
    left, right = (store.meta(store.resolve(r)) for r in (a, b))
    schema = "variant string, model string, score double, pass_rate double"
    sides = [spark.createDataFrame([(m["variant"], m["model"], m["score"], m["pass_rate"]) for m in x["aggregates"]["matrix"]], schema) for x in (left, right)]
    whole = [x["aggregates"]["overall"] for x in (left, right)]
    return {
        "cells": [r.asDict() for r in scoring.compare(*sides).collect()],
        "overall": {f"{k}_delta": round(whole[1][k] - whole[0][k], 6) for k in ("score", "pass_rate")},
        "note": runs.selection_note(left, right),
    }


def list_runs(config: str, limit: int = 20) -> list[dict[str, Any]]:
    found = _store(_load(config)).runs(max(1, limit))[::-1]
    return [{k: m.get(k) for k in ("id", "label", "status", "started_at")} for m in found]


def set_baseline(config: str, ref: str) -> dict[str, str]:
    return {"baseline": _store(_load(config)).set_baseline(ref)}


def render_prompt(spark: SparkSession, config: str, variant: str, case_id: str) -> list[dict[str, Any]]:
    """The exact messages of a cell; refused for private configurations."""
    c = _load(config)
    if c.privacy.no_look:
        raise ConfigError("prompts of a private configuration can not be shown")
    bound = runs.bind_config(spark, c, runs.Selection(variants=[variant], cases=[case_id]))
    row = runs.rendered(bound).where(F.col("case_id") == case_id).first()
    if row.error:
        raise ConfigError(row.error)
    return [m.asDict(recursive=True) for m in row.messages]


def diagnose(config: str, env: dict[str, str] | None = None) -> list[dict[str, Any]]:
    """What would stop a run: the configuration, its files, the keys of its models, the folders."""
    checks: list[dict[str, Any]] = []

    def check(name: str, ok: bool, detail: str = "") -> None:
        checks.append({"check": name, "ok": ok, "detail": detail})

    try:
        c = spec.load(config)
    except ConfigError as e:
        check("configuration", False, str(e))
        return checks
    check("configuration", True)
    known, warnings = secrets.load(c.base, env)
    for w in warnings:
        check("secrets", False, w)
    for m in c.models:
        name = m.api_key_env or (secrets.DEFAULT_KEYS.get(m.provider) if m.provider != "openai-compatible" else None)
        if name:
            check(f"key of {m.id}", bool(known.get(name)), name)
    for v in c.variants:
        if isinstance(v.prompt, str):
            check(f"prompt of {v.name}", (c.base / v.prompt).is_file(), v.prompt)
    if isinstance(c.cases, spec.CaseFile):
        check("cases", (c.base / c.cases.file).exists(), c.cases.file)
    try:
        c = settings.resolve(c, env=env)
        check("settings", True)
    except ConfigError as e:
        check("settings", False, str(e))
    for what in settings.FOLDERS:
        place = c.place(getattr(c.settings, what))
        if "://" not in place:
            found = next(p for p in (Path(place), *Path(place).parents) if p.exists())
            check(what, found.is_dir() and os.access(found, os.W_OK), place)
    return checks


def probe(config: str, env: dict[str, str] | None = None) -> list[dict[str, Any]]:
    """Calls every model of a configuration once, with a few words, and says which answered; the one check that costs something."""
    c = _load(config)
    keys, hidden = secrets.keys(c, env), secrets.values(c.base, env)
    part = {"type": "text", "text": "Reply with OK.", "media_type": None, "sha256": None, "source": None}
    out = []
    for m in c.models:
        try:
            said = calls.provider(m.model_dump() | {"timeout_s": m.timeout_s or 30.0}, str(c.base), env={**os.environ, **keys}).complete([{"role": "user", "parts": [part]}])
            out.append({"check": f"answer of {m.id}", "ok": True, "detail": _short(secrets.redact(said.text, hidden))[:80]})
        except MatrixError as e:
            out.append({"check": f"answer of {m.id}", "ok": False, "detail": secrets.redact(str(e), hidden)})
    return out


def config_schema() -> dict[str, Any]:
    """JSON Schema of a configuration: names, types and choices.  The rules between its parts are checked on loading only."""
    return spec.Config.model_json_schema() | {"title": "promptmatrix configuration"}


#: The functions an agent may call, by name.
TOOLS: dict[str, Callable[..., Any]] = {f.__name__: f for f in (run_eval, get_run, get_case_result, compare_runs, list_runs, set_baseline, render_prompt)}


def schema_of(name: str) -> dict[str, Any]:
    """The arguments of a tool as a closed schema; the session is not one of them."""
    names = {k: v for k, v in inspect.signature(TOOLS[name]).parameters.items() if k != "spark"}
    return {"type": "object", "properties": {k: {} for k in names}, "required": [k for k, v in names.items() if v.default is inspect.Parameter.empty], "additionalProperties": False}


def call(spark: SparkSession, name: str, arguments: dict[str, Any]) -> Any:
    """Runs a tool by name; unknown tools, unknown arguments and missing ones are refused before anything runs."""
    if name not in TOOLS:
        raise ConfigError(f"no tool {name!r}; there are {', '.join(TOOLS)}")
    schema = schema_of(name)
    unknown, missing = sorted(set(arguments) - set(schema["properties"])), [k for k in schema["required"] if k not in arguments]
    if unknown or missing:
        raise ConfigError(f"{name}: " + "; ".join(f"{what} {', '.join(names)}" for what, names in (("does not take", unknown), ("needs", missing)) if names))
    takes_session = "spark" in inspect.signature(TOOLS[name]).parameters
    return TOOLS[name](spark, **arguments) if takes_session else TOOLS[name](**arguments)
