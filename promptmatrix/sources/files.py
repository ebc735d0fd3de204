"""Media, labels and results logs as tables."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmatrix.errors import ConfigError, ContentError, StoreError
from promptmatrix.sources.cases import csv_rows, json_lines
from promptmatrix.spec import read_text

# Media types by extension, and the types that each kind of part takes.
MEDIA = {
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".pdf": "application/pdf",
    ".mp3": "audio/mpeg", ".wav": "audio/wav", ".ogg": "audio/ogg", ".flac": "audio/flac", ".m4a": "audio/mp4", ".aac": "audio/aac",
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".webm": "video/webm",
}
KINDS = {"image": "image/", "file": "application/pdf", "audio": "audio/", "video": "video/"}


def media_type(path: str, kind: str, where: str = "") -> str:
    """The type of a file by its extension, if the kind of part takes it."""
    suffix = Path(path).suffix.lower()
    found = MEDIA.get(suffix)
    if found is None or not found.startswith(KINDS[kind]):
        known = ", ".join(sorted(s for s, t in MEDIA.items() if t.startswith(KINDS[kind])))
        raise ContentError(f"{where}{path} is no {kind} ({found or suffix or 'no extension'}; known: {known})")
    return found


def media(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, media_type, sha256 and length of files, hashed where they are read."""
    if not paths:
        return spark.createDataFrame([], "path string, media_type string, sha256 string, length long")
    types = F.create_map(*(x for pair in MEDIA.items() for x in map(F.lit, pair)))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    raw = spark.read.format("binaryFile").load(sorted(set(paths)))
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.try_element_at(types, suffix).alias("media_type"), F.sha2("content", 256).alias("sha256"), "length")


def attached(results: DataFrame) -> DataFrame | None:
    """sha256, media_type and path of the media in the messages of results; None if there is none."""
    parts = F.filter(F.flatten(F.transform(F.coalesce("messages", F.array().cast(results.schema["messages"].dataType)), lambda m: m["parts"])), lambda p: p["sha256"].isNotNull())
    media = results.where(F.size(parts) > 0).select(F.explode(parts).alias("p")).select("p.sha256", "p.media_type", F.col("p.source").alias("path")).distinct()
    return None if media.isEmpty() else media


def coerced(value: Any) -> Any:
    """A label as a number where its text is one."""
    if not isinstance(value, str):
        return value
    for kind in (int, float):
        try:
            return kind(value.strip())
        except ValueError:
            continue
    return value.strip()


def labels(spark: SparkSession, path: Path) -> DataFrame:
    """case_id, human_label (JSON) and pos of a label file; the first filled of human_label, label, rating and score counts."""
    readers = {".jsonl": json_lines, ".csv": csv_rows}
    if path.suffix.lower() not in readers:
        raise ConfigError(f"unsupported label file: {path} (use .csv or .jsonl)")
    rows = []
    for i, r in enumerate(readers[path.suffix.lower()](read_text(path, "label file"), path)):
        key = next((r[k] for k in ("case_id", "id") if r.get(k) not in (None, "")), None)
        value = next((r[k] for k in ("human_label", "label", "rating", "score") if r.get(k) not in (None, "")), None)
        if key is None or value is None:
            raise ConfigError(f"{path}: row {i + 1} needs a case id and a label")
        rows.append((str(key), json.dumps(coerced(value)), i))
    return spark.createDataFrame(rows, "case_id string, human_label string, pos long")


RESULT = (
    "variant string, model string, case_id string, cell_ord long, messages array<struct<role:string, parts:array<struct<type:string, text:string, media_type:string, sha256:string, source:string>>>>, "
    "output string, input_tokens long, output_tokens long, cost_usd double, latency_ms double, cached boolean, error string, "
    "scores array<struct<criterion:string, weight:double, score:double, passed:boolean, detail:string, error:string>>"
)
_LOG = RESULT.split(", scores ")[0] + ", scores map<string, struct<weight:double, score:double, passed:boolean, detail:string, error:string>>"


def repair_log(path: Path | str) -> int:
    """Cuts a last line without its line feed off a results log, so that more can be appended; returns the bytes cut.

    Only the end of the file is read.
    """
    with open(path, "r+b") as f:
        size, cut = f.seek(0, 2), 0
        while cut < size:
            step = min(1 << 16, size - cut)
            f.seek(size - cut - step)
            at = f.read(step).rfind(b"\n")
            if at >= 0:
                cut += step - at - 1
                break
            cut += step
        if cut:
            f.truncate(size - cut)
    return cut


def results_log(spark: SparkSession, path: str) -> DataFrame:
    """Results from a log with one JSON object a line and scores keyed by criterion.

    A line cut off at the very end counts as not written; any other broken
    line is an error.
    """
    lines = spark.read.text(path, wholetext=False).where(F.trim("value") != "").withColumn("cell_ord", F.monotonically_increasing_id())
    parsed = lines.select("cell_ord", F.from_json("value", _LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    broken = parsed.where("bad").agg(F.count("*"), F.min("cell_ord")).first()
    if broken[0]:
        last = parsed.agg(F.max("cell_ord")).first()[0]
        if broken[0] > 1 or broken[1] != last:
            raise StoreError(f"results log is corrupt: {path}")
    good = parsed.where("not bad").select("r.*", F.col("cell_ord").alias("_ord"))
    entries = F.transform(F.map_entries("scores"), lambda e: F.struct(e["key"].alias("criterion"), F.coalesce(e["value"]["weight"], F.lit(1.0)).alias("weight"), F.coalesce(e["value"]["score"], F.lit(0.0)).alias("score"), F.coalesce(e["value"]["passed"], F.lit(False)).alias("passed"), e["value"]["detail"].alias("detail"), e["value"]["error"].alias("error")))
    return good.withColumns({"cell_ord": F.col("_ord"), "scores": F.coalesce(entries, F.array()), "cached": F.coalesce("cached", F.lit(False))}).drop("_ord")
