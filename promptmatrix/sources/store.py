"""The run store: a folder with one folder a run, holding run.json, a Parquet table of results and its artifacts."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmatrix.errors import StoreError
from promptmatrix.sources.files import RESULT
from promptmatrix.sources.folders import Folder
from promptmatrix.sources.registry import Registry, brief

RESERVED = frozenset({"latest", "baseline"})
_ARTIFACT = "sha256 string, media_type string, path string, content binary"


def _object(text: str | None) -> dict[str, Any] | None:
    """A JSON object; None for anything else."""
    try:
        value = json.loads(text) if text else None
    except json.JSONDecodeError:
        return None
    return value if isinstance(value, dict) else None


def _with_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contents of the files of sha256, media_type and path, one file held at a time; a file that has gone or changed since it was sent is left out."""
    for batch in batches:
        for row in batch.to_pylist():
            try:
                content = Path(row["path"]).read_bytes()
            except OSError:
                continue
            if hashlib.sha256(content).hexdigest() != row["sha256"]:
                continue
            yield pa.RecordBatch.from_pydict({k: pa.array([v], t) for k, v, t in zip(("sha256", "media_type", "path", "content"), (row["sha256"], row["media_type"], row["path"], content), (*[pa.string()] * 3, pa.binary()), strict=True)})


class Store:
    """Metadata through the folder's file system, tables through Spark at the same place, so executors of a cluster write where the driver looks."""

    def __init__(self, root: Path | str):
        self.root = Folder(root)
        self.registry = Registry(self.root, lambda run_id: _object(self._run(run_id).read("run.json")))

    def _run(self, run_id: str) -> Folder:
        if not run_id or "/" in run_id or run_id.startswith("."):
            raise StoreError(f"not a run id: {run_id!r}")
        return self.root.sub(run_id)

    def write_text(self, run_id: str, name: str, text: str) -> None:
        self._run(run_id).write(name, text)

    def _write(self, folder: Folder, name: str, value: Any) -> None:
        folder.write(name, json.dumps(value, indent=2, sort_keys=True, default=str))

    def create(self, meta: dict[str, Any], label: str | None = None) -> str:
        if label in RESERVED:
            raise StoreError(f"label {label!r} is reserved")
        now = datetime.now(timezone.utc)
        run_id = f"{now:%Y%m%dT%H%M%S}{now.microsecond // 1000:03d}-{secrets.token_hex(2)}"
        base = {"format_version": 1, "id": run_id, "label": label, "status": "running", "created_ns": time.time_ns(), "started_at": now.isoformat(timespec="seconds"), "finished_at": None}
        self._write(self._run(run_id), "run.json", base | meta)
        self.registry.put(base | meta)
        return run_id

    def update(self, run_id: str, **new: Any) -> dict[str, Any]:
        old = self.meta(run_id)
        meta = old | new
        self._write(self._run(run_id), "run.json", meta)
        if brief(meta) != brief(old):
            self.registry.put(meta)
        return meta

    def finalize(self, run_id: str, complete: bool, **new: Any) -> dict[str, Any]:
        done = datetime.now(timezone.utc).isoformat(timespec="seconds")
        return self.update(run_id, status="complete" if complete else "incomplete", finished_at=done, **new)

    def meta(self, run_id: str) -> dict[str, Any]:
        found = _object(self._run(run_id).read("run.json"))
        if found is None:
            raise StoreError(f"no such run: {run_id!r}")
        return found

    def append(self, run_id: str, results: DataFrame) -> DataFrame:
        """A wave of results in a folder of its own; a wave is committed whole, so a killed run has no torn records.  Returns the rows as stored."""
        place = f"{self._run(run_id).sub('results').uri}/wave={time.time_ns()}"
        results.write.parquet(place)
        return results.sparkSession.read.schema(RESULT).parquet(place)

    def results(self, spark: SparkSession, run_id: str) -> DataFrame:
        self.meta(run_id)
        place = self._run(run_id).sub("results")
        if not place.exists():
            return spark.createDataFrame([], RESULT)
        return spark.read.schema(RESULT).parquet(place.uri).drop("wave").dropDuplicates(["variant", "model", "case_id", "cell_ord"])

    def keep_artifacts(self, run_id: str, media: DataFrame) -> None:
        """Each attached content once a run, under its digest; ``media`` has sha256, media_type and path."""
        spark = media.sparkSession
        new = media.groupBy("sha256").agg(F.min("media_type").alias("media_type"), F.min("path").alias("path"))
        new = new.join(self.artifacts(spark, run_id).select("sha256"), "sha256", "left_anti")
        new.repartition("sha256").mapInArrow(_with_content, _ARTIFACT).write.mode("append").parquet(self._run(run_id).sub("artifacts").uri)

    def artifacts(self, spark: SparkSession, run_id: str) -> DataFrame:
        place = self._run(run_id).sub("artifacts")
        return spark.read.schema(_ARTIFACT).parquet(place.uri) if place.exists() else spark.createDataFrame([], _ARTIFACT)

    def newest(self, label: str | None = None) -> Iterator[dict[str, Any]]:
        """The readable runs, newest first; those created under a label, if one is given.  Only runs that are asked for are opened."""
        for run in reversed(self.registry.runs()):
            if label is None or run.get("label") == label:
                meta = _object(self._run(run["id"]).read("run.json"))
                if meta and "id" in meta:
                    yield meta

    def runs(self, limit: int | None = None) -> list[dict[str, Any]]:
        """The readable runs, oldest first; the last ``limit`` of them, if it is given."""
        return list(islice(self.newest(), limit))[::-1]

    def set_baseline(self, ref: str) -> str:
        run_id = self.resolve(ref)
        self._write(self.root, "baseline.json", {"id": run_id})
        return run_id

    def baseline(self) -> str | None:
        return (_object(self.root.read("baseline.json")) or {}).get("id")

    def resolve(self, ref: str) -> str:
        """The id of: latest, baseline, an id, or the last run created under a label."""
        if ref == "baseline":
            pinned = self.baseline()
            if pinned is None:
                raise StoreError("no baseline is set")
            return pinned
        if ref == "latest":
            last = next(self.newest(), None)
            if last is None:
                raise StoreError("there are no runs")
            return last["id"]
        if ref and "/" not in ref and not ref.startswith("."):
            meta = _object(self._run(ref).read("run.json"))
            if meta and meta.get("id") == ref:
                return ref
        labelled = next(self.newest(ref), None)
        if labelled is None:
            raise StoreError(f"no run with id or label {ref!r}")
        return labelled["id"]
