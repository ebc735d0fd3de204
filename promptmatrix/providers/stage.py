"""The call stage: unique requests in, completions out.  The only stage with side effects."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmatrix.errors import ProviderError
from promptmatrix.functions import prices
from promptmatrix.functions.text import scrub
from promptmatrix.operators import requests
from promptmatrix.providers import calls

COMPLETION = "request_key string, first_ord long, model string, output string, input_tokens long, output_tokens long, cost_usd double, latency_ms double, error string, attempts int, called_at array<double>"


def is_plain(spec: dict[str, Any]) -> bool:
    """A mock that never fails, which needs no calls."""
    return spec["provider"] == "mock" and not {"error", "fail_times"} & set(spec.get("params") or {})


def native_mock(asked: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """A mock model that never fails, as expressions only."""
    params = spec.get("params") or {}
    said = F.lit(str(params["response"])) if "response" in params else requests.echo_last_user(F.col("messages"))
    return asked.withColumn("output", said).select(
        "request_key", F.col("cell_ord").alias("first_ord"), "model", "output", requests.quarter(F.length(requests.message_text(F.col("messages")))).alias("input_tokens"), requests.quarter(F.length("output")).alias("output_tokens"),
        F.lit(float(params.get("cost", 0.0))).alias("cost_usd"), F.lit(0.0).alias("latency_ms"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"), F.array().cast("array<double>").alias("called_at"),
    )


def called(asked: DataFrame, spec: dict[str, Any], base: str, keys: dict[str, str] | None = None, concurrency: int = 8, models: int = 1, recent: list[float] | None = None) -> DataFrame:
    """Calls of one model: spread over tasks, several in flight in each, never more together than the model's and the run's caps.

    A rate is kept by slots: each may start one call a minute.  The slots are
    dealt to the tasks, used as far as ``recent`` (times of attempts before,
    by whatever wave or stage) says; a task that is run again can not know
    when its slots were used last, and takes them as used just now.
    """
    part = calls.share(spec, concurrency, models, asked.sparkSession.sparkContext.defaultParallelism)
    slots = calls.slots(part.per_minute, recent or [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = calls.provider(spec, base, env={**os.environ, **(keys or {})})
        here = TaskContext.get()
        number, again = (here.partitionId() % part.tasks, here.attemptNumber() > 0) if here else (0, False)
        limit = calls.RateLimit([time.time() if again else t for t in slots[number :: part.tasks]]) if slots else None
        attempts = 3 if spec.get("max_retries") is None else int(spec["max_retries"]) + 1

        def one(key: str, first: int, sent: str) -> tuple:
            messages, began, tried = json.loads(sent), time.monotonic(), []

            def once() -> calls.Completion:
                if limit:
                    limit.wait()
                tried.append(time.time())
                return model.complete(messages)

            try:
                c = calls.with_retries(once, attempts)
                cost = c.cost_usd if c.cost_usd is not None else prices.cost(model.model, c.input_tokens, c.output_tokens, spec.get("params"))
                return key, first, spec["id"], c.text, c.input_tokens, c.output_tokens, cost, (time.monotonic() - began) * 1000, None, len(tried), tried
            except ProviderError as e:
                return key, first, spec["id"], None, None, None, None, (time.monotonic() - began) * 1000, f"{type(e).__name__}: {e}", len(tried), tried

        with ThreadPoolExecutor(part.in_flight) as pool:
            for batch in batches:
                spread = pool.map if part.in_flight > 1 else map  # calls one after another need no threads
                rows = list(spread(one, batch["request_key"], batch["cell_ord"], batch["sent"]))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in COMPLETION.split(", ")]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    one = asked.select("request_key", "cell_ord", F.to_json("messages", {"ignoreNullFields": "false"}).alias("sent"))
    return one.repartition(part.tasks).mapInPandas(run, COMPLETION)


def completions(asked: DataFrame, specs: list[dict[str, Any]], base: str, secrets: list[str] | None = None, keys: dict[str, str] | None = None, concurrency: int = 8, recent: dict[str, list[float]] | None = None) -> DataFrame:
    """One completion for each request (request_key, cell_ord, model, messages); known secrets are scrubbed before anything is kept."""
    out, models = None, sum(not is_plain(s) for s in specs)
    for spec in specs:
        own = asked.where(F.col("model") == spec["id"])
        part = native_mock(own, spec) if is_plain(spec) else called(own, spec, base, keys, concurrency, models, (recent or {}).get(spec["id"]))
        out = part if out is None else out.unionByName(part)
    if out is not None and secrets:
        out = out.withColumns({"output": scrub(F.col("output"), secrets), "error": scrub(F.col("error"), secrets)})
    return out
