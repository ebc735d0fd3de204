"""Case files of any size: JSON lines and CSV read in splits by the executors, which have to reach the file.

A file, or a folder of them in the order of their names, is cut into ranges of
bytes.  A line belongs to the range that it begins in.  One pass counts what
each range holds; running sums of the counts then give every range its first
position and line, so the second pass yields the same cases, ids and errors as
reading the files from end to end.

In CSV a line break may stand inside quotes, and whether a range begins inside
them depends on all ranges before.  The first pass therefore answers for both
beginnings, and the answers are chained.  A record belongs to the range that it
begins in, and its reader goes on past the end of the range until it is whole.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmatrix.errors import ConfigError

#: Bytes of a range.
RANGE = 32 << 20
#: Bytes that are looked at in one piece while the end of a line is sought.
STEP = 1 << 20
#: Cases of a batch that goes to Spark, and the characters after which it goes sooner.
BATCH, BATCH_CHARS = 1024, 4 << 20

_MARK = b"\xef\xbb\xbf"
_INSIDE = re.compile(r'(?:[^"]++|"")*+')


class Range(NamedTuple):
    """Bytes ``start`` to ``end`` of a file."""

    path: str
    start: int
    end: int


@dataclass(frozen=True)
class Place:
    """Where a range begins: inside quotes or not, and the cases and lines of its table or file before it."""

    inside: bool = False
    cases: int = 0
    lines: int = 0


class Count(NamedTuple):
    """What a range holds for one way to begin: its records, lines, and whether it ends inside quotes."""

    cases: int
    lines: int
    inside: bool


def parts(path: Path) -> list[Path]:
    """The file itself, or the files of a folder without hidden ones and marks of jobs."""
    return sorted(p for p in path.iterdir() if p.is_file() and p.name[0] not in "._") if path.is_dir() else [path]


def ranges(path: Path, size: int = RANGE) -> list[Range]:
    return [Range(str(p), at, min(at + size, n)) for p in parts(path) for n in (p.stat().st_size,) for at in range(0, n, size)]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line of CSV stands inside quotes; a quote opens only where a field begins, and a doubled one stays inside."""
    at = 0
    if not inside:
        at = 1 if line.startswith('"') else line.find(',"') + 2
        if at == 1 and not line.startswith('"'):
            return False
    while True:
        at = _INSIDE.match(line, at).end()
        if at == len(line):
            return True
        at = line.find(',"', at + 1) + 2
        if at == 1:
            return False


def lines(r: Range, beyond: Callable[[], bool] = lambda: False) -> Iterator[str]:
    """The lines that begin in a range, each with a line feed at its end (for LF, CR LF or CR) if it has an end; and those after it for as long as ``beyond`` says."""
    with open(r.path, "rb") as f:
        at = max(r.start - 1, 0)
        f.seek(at)
        while r.start and at < r.end:
            skipped = f.readline(STEP)
            at += len(skipped)
            if not skipped or skipped.endswith(b"\n"):
                break
        while at < r.end or beyond():
            raw, begin = f.readline(), at
            if not raw:
                return
            at += len(raw)
            text = (raw if begin else raw.removeprefix(_MARK)).decode().replace("\r\n", "\n").replace("\r", "\n")
            *whole, last = text.split("\n")
            for line in [x + "\n" for x in whole] + [last] * (last != ""):
                if begin >= r.end and not beyond():
                    return
                yield line


def count_json(r: Range) -> Iterator[Count]:
    n = cases = 0
    for line in lines(r):
        n += 1
        cases += bool(line.strip())
    yield Count(cases, n, False)


def count_csv(r: Range) -> Iterator[Count]:
    """Counts for a beginning outside and one inside quotes.  Empty records count for nothing; the header is the first record of a file."""
    at, cases = [False, True], [0, 0]
    if r.start == 0:
        cases[0] = None  # the header is still to come
    n = 0
    for line in lines(r):
        n += 1
        for k in (0, 1):
            if not at[k]:
                cases[k] = 0 if cases[k] is None else cases[k] + (line != "\n")
        if at[0] == at[1]:
            at = [ends_inside(line, at[0])] * 2
        else:
            at = [ends_inside(line, a) for a in at]
    for k in (0, 1):
        yield Count(cases[k] or 0, n, at[k])


def json_rows(r: Range, place: Place) -> Iterator[dict[str, Any]]:
    for number, line in enumerate(lines(r), place.lines + 1):
        if line.strip():
            yield json_row(line, number, r.path)


def json_row(line: str, number: int, path: Path | str) -> dict[str, Any]:
    try:
        row = json.loads(line)
    except (json.JSONDecodeError, RecursionError) as e:
        raise ConfigError(f"line {number} of {path} does not parse: {getattr(e, 'msg', e)}") from e
    if not isinstance(row, dict):
        raise ConfigError(f"line {number} of {path} holds no object")
    return row


def csv_rows(r: Range, place: Place) -> Iterator[dict[str, Any]]:
    inside, reading = place.inside, place.inside

    def own() -> Iterator[str]:
        nonlocal inside, reading
        for line in lines(r, lambda: inside and not reading):
            inside = ends_inside(line, inside)
            if reading:  # the rest of a record that began before
                reading = inside
            else:
                yield line

    try:
        with open(r.path, encoding="utf-8-sig") as f:
            header = next(csv.reader(f), [])
        reader = csv.reader(own())
        if r.start == 0:
            next(reader, None)
        for values in reader:
            if values:
                yield csv_row(header, values)
    except csv.Error as e:
        raise ConfigError(f"{r.path} is no CSV: {e}") from e


def csv_row(header: list[str], values: list[str]) -> dict[str, Any]:
    row: dict[Any, Any] = dict(zip(header, values, strict=False)) | {k: None for k in header[len(values) :]}
    if len(values) > len(header):
        row[None] = values[len(header) :]
    return {k: None if v == "" and k in ("id", "expected", "human_label") else v for k, v in row.items()}


@dataclass(frozen=True)
class Kind:
    count: Callable[[Range], Iterator[Count]]
    rows: Callable[[Range, Place], Iterator[dict[str, Any]]]


KINDS = {".jsonl": Kind(count_json, json_rows), ".csv": Kind(count_csv, csv_rows)}


def _tasks(spark: SparkSession, n: int) -> DataFrame:
    """One task a range."""
    return spark.range(0, n, 1, n)


def chained(found: list[Range], answers: list[list[Any]]) -> tuple[list[Place], int]:
    """Where each range begins, from what all ranges answered, and the number of cases; a new file begins outside quotes at its first line."""
    out, at = [], Place()
    for r, answer in zip(found, answers, strict=True):
        if r.start == 0:
            at = Place(cases=at.cases)
        out.append(at)
        cases, n, inside = answer[at.inside if len(answer) > 1 else 0]
        at = replace(at, inside=bool(inside), cases=at.cases + cases, lines=at.lines + n)
    return out, at.cases


def places(spark: SparkSession, found: list[Range], kind: Kind) -> tuple[list[Place], int]:
    """Where each range begins, and the number of cases.  The driver holds some numbers for each range, no line of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                try:
                    answers, error = [[int(x) for x in c] for c in kind.count(found[i])], None
                except UnicodeDecodeError as e:
                    answers, error = [], f"{found[i].path} can not be read: {e}"
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "answers": pa.array([answers], pa.list_(pa.list_(pa.int64()))), "error": pa.array([error], pa.string())})

    counted = sorted(_tasks(spark, len(found)).mapInArrow(run, "i long, answers array<array<long>>, error string").collect())
    wrong = next((r.error for r in counted if r.error), None)
    if wrong:
        raise ConfigError(wrong)
    return chained(found, [r.answers for r in counted])


def cases(spark: SparkSession, path: Path, as_row: Callable[[dict[str, Any], int], tuple], size: int = RANGE) -> DataFrame:
    """The cases of a file or folder with a column ``error``, which is set on the first case of a range that is none; the range ends there."""
    kind = KINDS[path.suffix.lower()]
    found = ranges(path, size)
    began, total = places(spark, found, kind) if found else ([], 0)
    if not total:
        raise ConfigError(f"there are no cases in {path}")
    texts = pa.string()
    shape = pa.schema([("case_pos", pa.int64()), ("case_id", texts), ("vars", texts), ("files", pa.map_(texts, texts)), ("expected", texts), ("human_label", texts), ("error", texts)])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows, strict=True)]
        columns[3] = [list(m.items()) for m in columns[3]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            rows, chars, at = [], 0, began[i].cases
            try:
                for given in kind.rows(found[i], began[i]):
                    rows.append((*as_row(given, at), None))
                    at, chars = at + 1, chars + sum(len(x) for x in rows[-1][2:] if isinstance(x, str))
                    if len(rows) >= BATCH or chars >= BATCH_CHARS:
                        yield batch(rows)
                        rows, chars = [], 0
            except ConfigError as e:
                rows.append((at, None, None, {}, None, None, str(e)))
            if rows:
                yield batch(rows)

    return _tasks(spark, len(found)).mapInArrow(run, "case_pos long, case_id string, vars string, files map<string,string>, expected string, human_label string, error string")


def checked(found: DataFrame) -> DataFrame:
    """The cases without the column ``error``; the first error or else a duplicate id is raised."""
    wrong = found.groupBy("case_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("case_pos", "error"))).alias("first"))
    worst = wrong.where("first is not null or n > 1").orderBy(F.col("first.case_pos").asc_nulls_last(), "case_id").first()
    if worst is not None:
        raise ConfigError(worst["first"].error if worst["first"] else f"two cases have the id {worst.case_id!r}")
    return found.drop("error")
