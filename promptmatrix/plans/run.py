"""A configuration executed: bind, render, complete, score, store, aggregate, gate."""

from __future__ import annotations

import asyncio
import contextlib
import hashlib
import json
import math
import random
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmatrix import spec as specs
from promptmatrix.errors import ConfigError, MatrixError, StoreError, TemplateError
from promptmatrix.functions import prices, template, template_columns
from promptmatrix.functions.scorers import Inputs, bind, entry, judge_params
from promptmatrix.functions.text import hash_case_id, scrub
from promptmatrix.operators import matrix, requests, results, scoring
from promptmatrix.providers import calls, stage
from promptmatrix.sources import cases as case_files
from promptmatrix.sources import files, folders, paged, splits
from promptmatrix.sources.store import Store
from promptmatrix.streaming import waves

#: Cells of the first wave of a run that makes calls, and seconds that a wave should take: waves grow up to eightfold until they do, and a crash loses one wave.
FIRST_WAVE, WAVE_SECONDS = 256, 60
_MESSAGES = "array<struct<role:string, parts:array<struct<type:string, text:string, media_type:string, sha256:string, source:string>>>>"


@dataclass
class Selection:
    """What a run narrows the matrix to, and how it stops."""

    variants: list[str] | None = None
    models: list[str] | None = None
    cases: list[str] | None = None
    sample: int | None = None
    seed: int | None = None
    max_cost: float | None = None
    fail_fast: bool = False


@dataclass
class Outcome:
    run_id: str
    meta: dict[str, Any]
    results: DataFrame
    passed: bool | None
    warnings: list[str] = field(default_factory=list)


@dataclass
class Bound:
    """A configuration with its names checked and its inputs found."""

    config: specs.Config
    variants: list[tuple[str, list[specs.Message]]]
    models: list[specs.Model]
    cases: DataFrame
    available: int
    streamed: bool
    selection: dict[str, Any] | None


def bind_config(spark: SparkSession, config: specs.Config, how: Selection) -> Bound:
    names = matrix.pick([v.name for v in config.variants], how.variants, "variant")
    candidates = [m for m in config.models if m.role in ("candidate", "both")]
    wanted = matrix.pick([m.id for m in candidates], how.models, "model")
    variants = [(v.name, specs.messages(v.prompt, config.base)) for v in config.variants if v.name in names]
    models = [m for m in candidates if m.id in wanted]
    for model in models:
        for name, messages in variants:
            for kind in {k for m in messages for k, _ in m.parts()} - {"text"} - calls.TAKES[model.provider]:
                raise ConfigError(f"variant {name!r} has {kind} parts, which model {model.id!r} ({model.provider}) does not take")
    for c in config.scorecard:
        bind(c.scorer.type, c.scorer.params, str(config.base))
    streamed = isinstance(config.cases, specs.CaseSource)
    if streamed:
        if how.cases:
            raise ConfigError("cases of a source can not be chosen by id")
        table = paged.cases(spark, config.cases.source, config.base, config.cases.params, config.cases.page_size, config.cases.limit)
    elif isinstance(config.cases, specs.CaseFile):
        table = case_files.dataset(spark, config.base / config.cases.file)
    else:
        table = case_files.inline(spark, config.cases, config.base)
    if how.cases:
        ids = spark.createDataFrame([(c,) for c in how.cases], "case_id string")
        missing = [r[0] for r in matrix.unknown_names(ids, table, "case_id").take(5)]
        if missing:
            raise ConfigError(f"unknown case: {', '.join(sorted(missing))}")
        table = matrix.only_cases(table, ids)
    selection, available = None, 0
    if how.sample is not None:
        if streamed:
            raise ConfigError("cases of a source can not be sampled")
        available = table.count()
        seed = how.seed if how.seed is not None else random.SystemRandom().getrandbits(32)
        table = matrix.sampled(table, matrix.draw(available, how.sample, seed))
        selection = {"sample": how.sample, "seed": seed, "available": available}
    return Bound(config, variants, models, table, available, streamed, selection)


def _cells(bound: Bound) -> DataFrame:
    """All cells of the matrix, each with its case's variables parsed once."""
    spark = bound.cases.sparkSession
    models = matrix.names(spark, "model", [m.id for m in bound.models], "m_ord")
    variants = matrix.names(spark, "variant", [n for n, _ in bound.variants], "v_ord")
    parsed = bound.cases.withColumn("_vars", F.try_parse_json(F.coalesce("vars", F.lit("{}"))))
    return matrix.product(variants, models, parsed, case_major=bound.streamed)


def _by_expression(bound: Bound, cells: DataFrame) -> DataFrame:
    """Cells with messages where an expression gives them for sure: null for templates without one, media, and rows that need the renderer's own words."""
    own = template_columns.of_variant(F.col("_vars"))
    attached = lambda path: F.try_element_at(F.col("files"), F.lit(path[1])).cast("variant") if len(path) == 2 and isinstance(path[1], str) else F.lit(None).cast("variant")
    messages = F.lit(None).cast(_MESSAGES)
    for name, told in bound.variants:
        parts = [(m.role, m.parts()) for m in told]
        if any(kind != "text" for _, pieces in parts for kind, _ in pieces):
            continue
        texts = [[template_columns.compile(source, lambda n: attached if n == "files" else own) for _, source in pieces] for _, pieces in parts]
        if any(t is None for row in texts for t in row):
            continue
        none = F.lit(None).cast("string")
        part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), none.alias("media_type"), none.alias("sha256"), none.alias("source"))
        listed = F.array(*(F.struct(F.lit(role).alias("role"), F.array(*map(part, row)).alias("parts")) for (role, _), row in zip(parts, texts, strict=True)))
        messages = F.when(F.col("variant") == name, listed).otherwise(messages)
    sure = F.forall("messages", lambda m: F.forall(m["parts"], lambda p: p["text"].isNotNull())) & F.try_variant_get("_vars", "$['files']", "variant").isNull() & F.col("_vars").isNotNull()
    return scoring.once(cells, "messages", messages).withColumn("messages", F.when(sure, F.col("messages")))


def _by_renderer(bound: Bound, cells: DataFrame) -> DataFrame:
    """Cells with messages, or the error of the cell whose template fails."""
    config = bound.config
    parts = {name: [(m.role, m.parts()) for m in messages] for name, messages in bound.variants}
    base = str(config.base)

    @F.pandas_udf("struct<messages:string, error:string>")
    def render(variant: pd.Series, variables: pd.Series, attached: pd.Series) -> pd.DataFrame:
        hashes: dict[str, str] = {}
        rows = []
        for name, given, paths in zip(variant, variables, attached, strict=True):
            try:
                context, own = json.loads(given or "{}"), json.loads(paths or "{}")
                if "files" in context:
                    raise TemplateError("a variable can not be named 'files'")
                messages = []
                for number, (role, pieces) in enumerate(parts[name], 1):
                    where, out = f"message {number} ({role})", []
                    for kind, source in pieces:
                        said = template.render(source, {**context, "files": own}, where)
                        piece = {"type": kind, "text": said, "media_type": None, "sha256": None, "source": None}
                        if kind != "text":
                            outside = said == source or said in own.values()
                            path = case_files.contained(said, Path(base), True) if not outside else str((Path(base) / said).resolve())
                            if not outside and not Path(path).is_relative_to(Path(base).resolve()):
                                raise ConfigError(f"{where}: {kind} path {said!r} comes from case data and leaves {base}")
                            if path not in hashes:
                                if not Path(path).is_file():
                                    raise ConfigError(f"{where}: {kind} file not found: {said}")
                                hashes[path] = hashlib.sha256(Path(path).read_bytes()).hexdigest()
                            piece = {"type": kind, "text": None, "media_type": files.media_type(path, kind, f"{where}: "), "sha256": hashes[path], "source": path}
                        out.append(piece)
                    messages.append({"role": role, "parts": out})
                rows.append((json.dumps(messages), None))
            except MatrixError as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["messages", "error"])

    r = render("variant", "vars", F.to_json("files"))
    return cells.drop("messages").withColumn("_r", r).withColumns({"messages": F.from_json("_r.messages", _MESSAGES), "error": F.col("_r.error")}).drop("_r")


def rendered(bound: Bound, pick: Callable[[DataFrame], DataFrame] = lambda cells: cells) -> DataFrame:
    """All cells (that ``pick`` leaves) with messages, or the error of the cell whose template fails; rendered once."""
    return Book(bound, pick).cells


def _first_page(spark: SparkSession, bound: Bound) -> Bound:
    """The same with the first page of a case source only, fetched once."""
    if not bound.streamed:
        return bound
    c = bound.config.cases
    n = min(c.page_size, c.limit or c.page_size)
    page = paged.cases(spark, c.source, bound.config.base, c.params, c.page_size, n)
    return replace(bound, cases=_kept(page))


def dry_run(spark: SparkSession, config: specs.Config, how: Selection | None = None) -> DataFrame:
    """The key and render error of every cell, of a case source those of its first page; nothing is called."""
    return rendered(_first_page(spark, bind_config(spark, config, how or Selection()))).select("variant", "model", "case_id", "cell_ord", "error").orderBy("cell_ord")


def estimate(spark: SparkSession, config: specs.Config, how: Selection | None = None) -> dict[str, Any] | None:
    """Roughly what a run will cost, judges included; None if nothing has a price."""
    whole = bind_config(spark, config, how or Selection())
    bound = _first_page(spark, whole)
    n = bound.cases.count()
    if whole.streamed:  # the source's own count, or its limit; else the first page stands for nothing more
        said = paged.count(paged.load(config.cases.source, config.base, config.cases.params))
        known_sizes = [x for x in (said, config.cases.limit) if x is not None]
        n = min(known_sizes) if known_sizes else n
    first = rendered(bound).where(F.col("error").isNull()).groupBy("variant").agg(F.min_by(F.length(requests.message_text(F.col("messages"))), "cell_ord").alias("chars"))
    chars = {r["variant"]: r["chars"] or 0 for r in first.collect()}
    total, unpriced, known = 0.0, [], False
    groups = [(m, chars.get(v, 0) // 4, n) for m in bound.models for v, _ in bound.variants]
    by_id = {m.id: m for m in config.models}
    for c in config.scorecard:
        if c.scorer.type == "llm-judge":
            judge = config.judges[c.scorer.params["judge"]]
            size = sum(len(t) for m in specs.messages(judge.rubric, config.base) for _, t in m.parts()) // 4
            groups.append((by_id[judge.model], size, n * len(bound.models) * len(bound.variants)))
    for model, tokens, cells in groups:
        most = model.params.get("max_tokens")
        each = most if isinstance(most, int) and most > 0 else 500
        usd = prices.cost(str(model.params.get("model", model.id)), tokens * cells, each * cells, model.params)
        if usd is None:
            unpriced += [model.id] if model.id not in unpriced else []
        else:
            total, known = total + usd, True
    return {"usd": round(total, 4), "unpriced": unpriced} if known else None


def spec_json(model: specs.Model) -> str:
    """What of a model can change its response."""
    params = {k: v for k, v in model.params.items() if k not in ("pricing", "cost")}
    return json.dumps({"provider": model.provider, "model": model.params.get("model", model.id), "base_url": model.base_url, "command": model.command, "params": params}, sort_keys=True, default=str)


class Responses:
    """The response cache: a table of completions by request key, a folder for each wave that added some."""

    SCHEMA = "request_key string, output string, input_tokens long, output_tokens long, cost_usd double"
    _NAMES = tuple(c.split()[0] for c in SCHEMA.split(", "))

    def __init__(self, root: Path | str):
        self.place = folders.Folder(root).sub("answers")

    def _files(self) -> list[folders.Entry]:
        return [f for f in self.place.walk() if f.name.endswith(".parquet")]

    def read(self, spark: SparkSession) -> DataFrame:
        if not self._files():
            return spark.createDataFrame([], self.SCHEMA)
        return spark.read.schema(self.SCHEMA).parquet(self.place.uri).select(*self._NAMES).dropDuplicates(["request_key"])

    def of(self, asked: DataFrame) -> DataFrame:
        """The stored responses to these requests (request_key)."""
        spark = asked.sparkSession
        found = self.read(spark)
        return found.join(asked.select("request_key").distinct(), "request_key", "left_semi") if self._files() else found

    def add(self, completed: DataFrame) -> None:
        """Good responses, in few files sorted by key, so that the ranges of keys in their footers tell them apart."""
        kept = completed.where(F.col("error").isNull() & F.col("output").isNotNull()).select(*self._NAMES)
        kept.sortWithinPartitions("request_key").write.option("parquet.bloom.filter.enabled#request_key", "true").parquet(f"{self.place.uri}/wave={uuid.uuid4().hex}")

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row: entries, bytes, and when the oldest file was written."""
        found = self._files()
        if not found:
            return spark.createDataFrame([(0, 0, None)], "entries long, bytes long, oldest timestamp")
        return self.read(spark).agg(F.count("*").alias("entries"), F.lit(sum(f.size for f in found)).cast("long").alias("bytes"), F.timestamp_seconds(F.lit(min(f.modified for f in found))).alias("oldest"))

    def prune(self, before: float) -> int:
        """Deletes files written before a time; returns how many."""
        old = [f for f in self._files() if f.modified < before]
        for f in old:
            self.place.delete(f.name)
        return len(old)


@dataclass
class Caller:
    """What calls need besides the cells: secret values to scrub, keys for providers, how many may be in flight, and when each limited model was last called."""

    secrets: list[str] = field(default_factory=list)
    keys: dict[str, str] = field(default_factory=dict)
    concurrency: int = 8
    recent: dict[str, list[float]] = field(default_factory=dict)

    def heard(self, models: list[specs.Model], made: DataFrame) -> None:
        """Keeps the times of the last minute's attempts of models with a rate, at most that many of each."""
        for m in models:
            if m.requests_per_minute:
                times = made.where(F.col("model") == m.id).select(F.explode("called_at").alias("t")).where(F.col("t") > time.time() - 60)
                late = [r[0] for r in times.orderBy(F.desc("t")).limit(int(m.requests_per_minute)).collect()]
                self.recent[m.id] = sorted([*self.recent.get(m.id, []), *late])[-int(m.requests_per_minute) :]


def key_of(models: list[specs.Model]) -> Column:
    """The request key of a cell of one of these models."""
    key = F.lit(None).cast("string")
    for m in models:
        key = F.when(F.col("model") == m.id, requests.request_key(F.lit(spec_json(m)), F.col("messages"))).otherwise(key)
    return key


def complete(spark: SparkSession, cells: DataFrame, models: list[specs.Model], base: Path, cache: Responses | None, caller: Caller | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """Cells with output, usage, cost, error and cached; the completions that were made; and what deletes them.

    Equal requests are called once, stored responses (``known``, else what the
    cache has of these requests) not at all.  Calls must not run twice: what
    they gave is written to the checkpoint folder before anything reads it.
    """
    asked = cells.where(F.col("error").isNull())
    if "request_key" not in cells.columns:
        asked = asked.withColumn("request_key", key_of(models))
    dumps, caller = [m.model_dump() for m in models], caller or Caller()
    if cache is None:  # every cell is a call of its own
        asked = asked.withColumn("request_key", F.concat_ws(":", "request_key", F.col("cell_ord").cast("string")))
        known = spark.createDataFrame([], Responses.SCHEMA)
    elif known is None:
        known = cache.of(asked)
    first = requests.to_call(asked.select("request_key", "cell_ord", "model", "messages", F.lit(False).alias("cached")))
    wanted = requests.to_call(requests.with_cache(first, known).select("request_key", "cell_ord", "model", "messages", "cached")) if cache is not None else first
    made = stage.completions(wanted, dumps, str(base), caller.secrets, caller.keys, caller.concurrency, caller.recent)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    made.write.parquet(path)
    fresh = spark.read.schema(made.schema).parquet(path)
    caller.heard(models, fresh)
    if cache is not None:
        cache.add(fresh)
    none = {"latency_ms": "double", "error": "string", "attempts": "int", "first_ord": "long"}
    hits = known.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"_known": F.lit(True)})
    every = fresh.drop("model", "called_at").withColumn("_known", F.lit(False)).unionByName(hits)
    done = asked.drop("error").join(every, "request_key", "left")
    served = F.col("error").isNull() & (F.col("_known") | (F.col("first_ord") != F.col("cell_ord")))
    done = done.withColumn("cached", F.coalesce(served, F.lit(False)) if cache is not None else F.lit(False))
    done = done.withColumns({"latency_ms": F.when(~F.col("cached"), F.col("latency_ms")), "attempts": F.when(~F.col("cached"), F.col("attempts")).otherwise(0)}).drop("_known", "first_ord", "request_key")
    none = {"output": "string", "input_tokens": "long", "output_tokens": "long", "cost_usd": "double", "latency_ms": "double", "attempts": "int"}
    failed = cells.where(F.col("error").isNotNull()).drop("request_key").withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"cached": F.lit(False)})
    return done.unionByName(failed), fresh, lambda: remove(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir; only with a local master, as in tests, a temporary one where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ConfigError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def _kept(df: DataFrame) -> DataFrame:
    """Calls must not run twice: their rows are written to the checkpoint folder before anything reads them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _filled(rubric: list[tuple[str, list[tuple[str, str]]]], name: str):
    """A column function: a judge's messages for an output, its expected value and variables, as JSON, or the error."""

    @F.pandas_udf("struct<messages:string, error:string>")
    def fill(outputs: pd.Series, expected: pd.Series, variables: pd.Series) -> pd.DataFrame:
        rows = []
        for o, e, v in zip(outputs, expected, variables, strict=True):
            context = {"output": o, "expected": None if e is None else json.loads(e), "vars": json.loads(v or "{}")}
            try:
                told = [{"role": r, "parts": [{"type": "text", "text": template.render(t, context, f"judge {name!r}"), "media_type": None, "sha256": None, "source": None} for _, t in p]} for r, p in rubric]
                rows.append((json.dumps(told), None))
            except TemplateError as fault:
                rows.append((None, f"TemplateError: {fault}"))
        return pd.DataFrame(rows, columns=["messages", "error"])

    return fill


@dataclass
class Judged:
    """What the judges' calls came to."""

    cost: float = 0.0
    calls: int = 0
    attempts: int = 0


def score(spark: SparkSession, done: DataFrame, config: specs.Config, cache: Responses | None, caller: Caller | None = None) -> tuple[DataFrame, Judged]:
    """Cells with scores, and what the judges' calls came to."""
    head = F.to_json(F.struct(F.col("case_id").alias("id")))
    null = F.lit("null")
    case = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"vars":'), F.coalesce("vars", null), F.lit(',"expected":'), F.coalesce("expected", null), F.lit(',"human_label":'), F.coalesce("human_label", null), F.lit("}"))
    cells = done.withColumn("case_json", case)
    inputs = Inputs(F.col("output"), F.col("expected"), F.col("human_label"), F.col("case_json"))
    entries, spent = [], Judged()
    for number, c in enumerate(config.scorecard):
        params = c.scorer.params
        if c.scorer.type != "llm-judge":
            entries.append(entry(c.criterion, c.weight, bind(c.scorer.type, params, str(config.base))(inputs)))
            continue
        judge = config.judges[params["judge"]]
        model = next(m for m in config.models if m.id == judge.model)
        judge_params(params)
        rubric = [(m.role, m.parts()) for m in specs.messages(judge.rubric, config.base)]

        fill = _filled(rubric, params["judge"])
        asked = cells.where(F.col("error").isNull()).withColumn("_r", fill("output", "expected", "vars"))
        asked = asked.select("cell_ord", F.lit(model.id).alias("model"), F.from_json("_r.messages", _MESSAGES).alias("messages"), F.col("_r.error").alias("error"))
        answered, _, _ = complete(spark, asked, [model], config.base, cache, caller)
        said = _kept(answered)
        made = F.col("attempts") > 0
        cost, n, tries = said.agg(F.coalesce(F.sum(F.when(made & ~F.col("cached"), F.col("cost_usd"))), F.lit(0.0)), F.count_if(made & ~F.col("cached")), F.coalesce(F.sum("attempts"), F.lit(0))).first()
        spent.cost, spent.calls, spent.attempts = spent.cost + cost, spent.calls + n, spent.attempts + tries
        cells = cells.join(said.select("cell_ord", F.col("output").alias(f"_said{number}"), F.col("error").alias(f"_fault{number}")), "cell_ord", "left")
        answer = bind("llm-judge", params)(Inputs(F.col(f"_said{number}"), F.col("expected"), F.col("human_label"), F.col("case_json")))
        fault = F.coalesce(F.col(f"_fault{number}"), answer["error"])
        entries.append(entry(c.criterion, c.weight, F.struct(answer["score"].alias("score"), answer["passed"].alias("passed"), answer["detail"].alias("detail"), fault.alias("error"))))
    scored = F.when(F.col("error").isNull(), F.array(*entries)).otherwise(F.array())
    return scoring.once(cells, "scores", scored), spent


def fingerprint(config: specs.Config) -> str:
    """SHA-256 of the configuration and of every file that it names; of a folder of cases, the names, sizes and times of its files count."""
    found = [c for c in ([config.cases.file] if isinstance(config.cases, specs.CaseFile) else [])]
    found += [v.prompt for v in config.variants if isinstance(v.prompt, str)] + [j.rubric for j in config.judges.values() if isinstance(j.rubric, str)]
    for c in config.scorecard:
        found += [p for k in ("file", "schema") if isinstance(p := c.scorer.params.get(k), str)]
    if isinstance(config.cases, specs.CaseSource):
        found.append(config.cases.source.rpartition(":")[0])
    digest = hashlib.sha256(snapshot(config).encode())
    for name in sorted(set(found)):
        path = config.base / name
        if path.is_file():
            with path.open("rb") as f:
                digest.update(hashlib.file_digest(f, "sha256").digest())
        elif path.is_dir():
            digest.update(repr([(p.name, p.stat().st_size, p.stat().st_mtime_ns) for p in splits.parts(path)]).encode())
        else:
            digest.update(b"<missing>")
    return digest.hexdigest()


def snapshot(config: specs.Config) -> str:
    """The configuration as canonical YAML; a private one without its inline cases."""
    data = config.model_dump(mode="json")
    if config.privacy.no_look and isinstance(config.cases, list):
        data["cases"] = f"<{len(config.cases)} cases withheld>"
    return yaml.safe_dump(data, sort_keys=True, allow_unicode=True)


def _stored(rows: DataFrame) -> DataFrame:
    schema = T._parse_datatype_string(files.RESULT)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


@dataclass
class Tally:
    """A run as far as it has come; handed to ``on_wave`` after each wave."""

    cells: int = 0
    passed: int = 0
    errors: int = 0
    cached: int = 0
    score_sum: float = 0.0
    cost_usd: float = 0.0
    judge: Judged = field(default_factory=Judged)

    @property
    def spent(self) -> float:
        return self.cost_usd + self.judge.cost

    @property
    def pass_rate(self) -> float:
        return self.passed / self.cells if self.cells else 0.0


def _plain(config: specs.Config, models: list[specs.Model]) -> bool:
    """Whether a run makes no calls that cost anything to repeat: all its models are mocks that never fail."""
    judges = {config.judges[c.scorer.params["judge"]].model for c in config.scorecard if c.scorer.type == "llm-judge"}
    return all(stage.is_plain(m.model_dump()) for m in [*models, *(m for m in config.models if m.id in judges)])


class Book:
    """The rendered cells of a run, written once, so that waves read ranges of them and nothing is rendered or fetched again.

    Expressions render what they can; only where they leave cells without
    messages, those cells go through the renderer, in Python.  ``request_key``
    is made here too.
    """

    def __init__(self, bound: Bound, pick: Callable[[DataFrame], DataFrame] = lambda cells: cells):
        spark = bound.cases.sparkSession
        self.spark, self.path = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        by_expression = _by_expression(bound, pick(_cells(bound))).withColumn("_vars", F.col("vars"))
        keyed = lambda cells: cells.drop("_vars").withColumn("error", F.col("error") if "error" in cells.columns else F.lit(None).cast("string")).withColumn("request_key", key_of(bound.models))
        by_expression = keyed(by_expression)
        by_expression.write.parquet(f"{self.path}/expressions")
        cells = spark.read.schema(by_expression.schema).parquet(f"{self.path}/expressions")
        self.count, left = cells.agg(F.count("*"), F.count_if(F.col("messages").isNull())).first()
        if left:
            bare = cells.where(F.col("messages").isNull()).drop("messages", "error", "request_key")
            others = keyed(_by_renderer(bound, bare)).select(cells.columns)
            others.write.parquet(f"{self.path}/renderer")
            cells = cells.where(F.col("messages").isNotNull()).unionByName(spark.read.schema(cells.schema).parquet(f"{self.path}/renderer"))
        self.cells = cells

    def waves(self, size: Callable[[], int]) -> Iterator[DataFrame]:
        """The cells in order, as many at a time as ``size`` says before each wave (0: no more); borders are counted in ranges of the order, never sorted whole."""
        after, left = -1, self.count
        while (n := size()) and left > 0:
            rest = self.cells.where(F.col("cell_ord") > after)
            if n >= left:
                yield rest
                left = 0
                continue
            last = matrix.border(rest, n)
            yield rest.where(F.col("cell_ord") <= last)
            after, left = last, left - n

    def drop(self) -> None:
        remove(self.spark, self.path)


def run(
    spark: SparkSession, config: specs.Config, how: Selection | None = None, label: str | None = None, resume: str | None = None, cache: bool | None = None, secrets: list[str] | None = None,
    request_log: str | None = None, keys: dict[str, str] | None = None, on_wave: Callable[[Tally], None] | None = None, wave_cells: int | None = None,
) -> Outcome:
    """Evaluates a configuration.

    Cells are rendered once and go in waves by their order; every wave's
    results and responses are stored before the next begins, and ``on_wave``
    hears of it.  A run whose models are plain mocks is one wave.  With
    ``max_cost`` a pilot of one cell is followed by as many cells as the rest
    of the budget can surely pay at the dearest price seen; with ``fail_fast``
    waves double from one cell.  A case source is read in whole pages, each
    once, as far as waves ask for.  ``keys`` are credentials by the name of
    their environment variable, for providers; ``wave_cells`` sets the size of a wave.
    """
    how = how or Selection()
    if how.max_cost is not None and (not math.isfinite(how.max_cost) or how.max_cost < 0):
        raise ConfigError("max_cost must be finite and not negative")
    if request_log and config.privacy.no_look:
        raise ConfigError("a private run keeps no trace of its calls")
    endless(config, how)
    caller = Caller(secrets or [], keys or {}, config.settings.concurrency)
    store, private = Store(config.place(config.settings.output_dir)), config.privacy.no_look
    sha = fingerprint(config)
    if resume:
        run_id = store.resolve(resume)
        old = store.meta(run_id)
        if old["status"] == "complete":
            raise StoreError(f"run {run_id} is complete")
        if old["config_sha256"] != sha:
            raise StoreError(f"run {run_id} was made with another configuration")
        if isinstance(config.cases, specs.CaseSource):
            raise StoreError("a run over a case source can not be resumed")
        if old.get("selection"):
            how.sample, how.seed = old["selection"]["sample"], old["selection"]["seed"]
    bound = bind_config(spark, config, how)
    digest = matrix.ids_digest(bound.cases).first()[0] if not bound.streamed else None
    shape = {"variants": [n for n, _ in bound.variants], "models": [m.id for m in bound.models], "cases": digest}
    baseline = None
    if config.thresholds.baseline:
        ref = "baseline" if config.thresholds.baseline == "regression" else config.thresholds.baseline
        baseline = store.meta(store.resolve(ref))["aggregates"]["overall"]
    responses = Responses(config.place(config.settings.cache_dir)) if (config.settings.cache if cache is None else cache) else None
    tally = Tally()
    if resume and old["matrix"] != shape:
        raise StoreError(f"run {run_id} covered another matrix")
    if resume:
        done = store.results(spark, run_id)
        before = old.get("totals") or {}
        tally.cost_usd = done.where("not cached").agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]
        tally.judge = Judged(before.get("judge_cost_usd", 0.0), before.get("judge_calls", 0), before.get("judge_attempts", 0))
    else:
        run_id = store.create({"config_sha256": sha, "matrix": shape, "selection": bound.selection, "no_look": private}, label)
        store.write_text(run_id, "config.snapshot.yaml", snapshot(config))
    python = tuple(c.criterion for c in config.scorecard if c.scorer.type == "python")
    warnings: list[str] = []
    dearest, failed, taken, stopped, most = 0.0, 0, 0, None, FIRST_WAVE
    plain, capped = _plain(config, bound.models), how.max_cost is not None
    media_too = any(kind != "text" for _, told in bound.variants for m in told for kind, _ in m.parts())
    figures: list[Row] = scoring.partial(scoring.judged(done)).collect() if resume else []

    def size() -> int:
        """Cells of the next wave; 0 ends the run."""
        nonlocal stopped
        if capped and tally.spent >= how.max_cost:
            stopped = "budget"
        elif how.fail_fast and failed:
            stopped = "fail-fast"
        if stopped:
            return 0
        n = wave_cells or (1 << 62 if plain else most)
        if capped:
            n = 1 if not taken else min(n, max(1, math.ceil((how.max_cost - tally.spent) / dearest)) if dearest else n)
        return min(n, max(1, taken)) if how.fail_fast else n

    def wave(part: DataFrame, known: DataFrame | None) -> DataFrame:
        """A wave completed, scored and stored; returns the responses that it made."""
        nonlocal dearest, failed, taken, most
        began = time.monotonic()
        completed, made, drop = complete(spark, part, bound.models, config.base, responses, caller, known)
        scored, judge = score(spark, completed, config, responses, caller)
        if request_log or media_too:  # read more than once
            scored = _kept(scored)
        rows = _stored(scored)
        if request_log:  # as JSON lines; headers and keys are never part of a cell, and outputs are scrubbed already
            trace = scored.where("not cached").select("model", "messages", "output", "error", "latency_ms", "attempts")
            trace.select(scrub(F.to_json(F.struct("*")), caller.secrets).alias("value")).write.mode("append").text(request_log)
        media = files.attached(rows) if media_too and not private else None
        written = store.append(run_id, results.redacted(rows, config.privacy.keep_case_ids, python) if private else rows)
        if media is not None:
            store.keep_artifacts(run_id, media)
        own = scoring.partial(scoring.judged(written)).collect()
        figures.extend(own)
        for r in own:
            tally.cells, tally.passed, tally.errors, tally.cached = tally.cells + r["cases"], tally.passed + r["n_passed"], tally.errors + r["errors"], tally.cached + r["cached"]
            tally.score_sum, tally.cost_usd = tally.score_sum + float(r["score_sum"]), tally.cost_usd + float(r["cost"])
        n, cost, unpriced = sum(r["cases"] for r in own), float(sum(r["cost"] for r in own)), sum(r["unpriced"] for r in own)
        tally.judge = Judged(tally.judge.cost + judge.cost, tally.judge.calls + judge.calls, tally.judge.attempts + judge.attempts)
        failed, taken = failed + n - sum(r["n_passed"] for r in own), taken + n
        dearest = max(dearest, (cost + judge.cost) / n) if n else dearest
        most = max(most, int(n * min(8.0, WAVE_SECONDS / max(0.1, time.monotonic() - began))))
        if unpriced and capped and not warnings:
            warnings.append("some calls have no known cost, so the cap can not hold them")
        dropped.append(drop)
        if on_wave:
            with contextlib.suppress(Exception):  # a listener's fault is not the run's
                on_wave(replace(tally))
        return made.where(F.col("error").isNull() & F.col("output").isNotNull()).select(*Responses._NAMES)

    dropped: list[Callable[[], None]] = []

    def through(book: Book) -> None:
        """All waves of these cells; what the cache has of their requests is read once, and what waves add is put beside it."""
        known = None
        if responses is not None:
            known = responses.of(book.cells.where(F.col("error").isNull()))
            if responses._files():
                path = f"{book.path}-known"
                known.write.parquet(path)
                known = spark.read.schema(known.schema).parquet(path)
                dropped.append(lambda: remove(spark, path))
        for part in book.waves(size):
            made = wave(part, known)
            known = None if known is None else known.unionByName(made)
        for drop in (*dropped, book.drop):
            drop()
        dropped.clear()

    if bound.streamed:  # whole pages, as many as the next wave asks for
        each = max(1, len(bound.variants) * len(bound.models))
        drained = waves.drain(spark, config.cases.source, config.base, f"{shared_folder(spark)}/{uuid.uuid4().hex}", lambda pages, _: through(Book(replace(bound, cases=pages.drop("page")))), config.cases.params, config.cases.page_size, config.cases.limit, lambda: -(-size() // each))
        if not drained and not stopped:
            warnings.append("the case source gave no cases")
    else:
        def left(cells: DataFrame) -> DataFrame:
            named = cells.withColumn("_id", hash_case_id(F.col("case_id")) if private and not config.privacy.keep_case_ids else F.col("case_id"))
            return matrix.remaining(named.withColumnRenamed("case_id", "_case").withColumnRenamed("_id", "case_id"), done).drop("case_id").withColumnRenamed("_case", "case_id")

        through(Book(bound, left if resume else lambda cells: cells))
    return finish(spark, store, run_id, config, baseline, tally.judge, stopped, warnings, figures)


def endless(config: specs.Config, how: Selection) -> None:
    """Refuses a run that nothing ends: a case source without a limit and no cap on its cost."""
    if isinstance(config.cases, specs.CaseSource) and config.cases.limit is None and how.max_cost is None:
        source = paged.load(config.cases.source, config.base, config.cases.params)
        if paged.count(source) is None:
            raise ConfigError("the case source has no limit and no count: set cases.limit or max_cost")


async def run_async(*arguments: Any, **named: Any) -> Outcome:
    """``run`` in a thread of its own, for callers with an event loop."""
    return await asyncio.to_thread(run, *arguments, **named)


def load_cases(spark: SparkSession, config: specs.Config, how: Selection | None = None) -> DataFrame:
    """The cases of a configuration as a table."""
    return bind_config(spark, config, how or Selection()).cases


def cells(spark: SparkSession, config: specs.Config, how: Selection | None = None) -> DataFrame:
    """The cells that a run would cover, not rendered: variant, model, case_id, cell_ord."""
    bound = bind_config(spark, config, how or Selection())
    models = matrix.names(spark, "model", [m.id for m in bound.models], "m_ord")
    variants = matrix.names(spark, "variant", [n for n, _ in bound.variants], "v_ord")
    return matrix.product(variants, models, bound.cases, case_major=bound.streamed).select(*matrix.KEY, "cell_ord")


def finish(spark: SparkSession, store: Store, run_id: str, config: specs.Config, baseline: dict | None, judge: Judged, stopped: str | None, warnings: list[str], figures: list[Row]) -> Outcome:
    """Closes a run from the figures of its waves, a row for each wave, variant and model; no result is read again."""
    waves_of = spark.createDataFrame([tuple(r) for r in figures], scoring.PARTIAL)
    whole = scoring.overall_of(waves_of)
    aggregates = {"overall": whole.first().asDict(), "matrix": [r.asDict() for r in scoring.matrix_of(waves_of).collect()]}
    totals = scoring.totals_of(waves_of).first().asDict() | {"judge_cost_usd": round(judge.cost, 10), "judge_calls": judge.calls, "judge_attempts": judge.attempts}
    base = spark.createDataFrame([(baseline["score"], baseline["pass_rate"])], "score double, pass_rate double") if baseline else None
    checks = [r.asDict() for r in scoring.gate(whole, config.thresholds.min_pass_rate, config.thresholds.min_score, base).collect()]
    gate = {"passed": all(c["passed"] for c in checks), "checks": checks} if checks else None
    meta = store.finalize(run_id, stopped is None, aggregates=aggregates, totals=totals, gate=gate, stopped_early=stopped, warnings=warnings)
    return Outcome(run_id, meta, scoring.judged(store.results(spark, run_id)), gate["passed"] if gate else None, warnings)


def rescore(spark: SparkSession, config: specs.Config, run_id: str) -> DataFrame:
    """Stored outputs graded anew by the scorecard of a configuration; nothing is called."""
    cases = bind_config(spark, config, Selection()).cases.select("case_id", "vars", "expected", "human_label")
    rows = Store(config.place(config.settings.output_dir)).results(spark, run_id).drop("scores").join(cases, "case_id")
    return scoring.judged(score(spark, rows, config, None)[0])


def selection_note(a: dict[str, Any], b: dict[str, Any]) -> str | None:
    """Why a comparison of two runs may mislead: they did not cover the same cases."""
    part = lambda m: s if (s := m.get("selection")) and s["sample"] < s.get("available", 0) else None
    x, y = part(a), part(b)
    if bool(x) != bool(y):
        some, whole = (a, b) if x else (b, a)
        return f"run {some['id']} covers a sample of {some['selection']['sample']} cases and run {whole['id']} all of them; part of every delta is that difference"
    if x and (x["sample"], x["seed"]) != (y["sample"], y["seed"]):
        return f"the runs drew different samples ({x['sample']} with seed {x['seed']}, {y['sample']} with seed {y['seed']})"
    if x and x["available"] != y["available"]:
        return f"the runs drew the same sample from different sets of cases ({x['available']} and {y['available']})"
    ids = [(m.get("matrix") or {}).get("cases") for m in (a, b)]
    return "the runs covered different cases" if all(ids) and ids[0] != ids[1] else None


__all__ = ["Bound", "Caller", "Outcome", "Responses", "Selection", "Tally", "dry_run", "estimate", "rescore", "run", "selection_note"]
