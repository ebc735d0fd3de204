"""Case files read in splits against the same files read from end to end."""

from __future__ import annotations

import json
import random

import pytest

import promptmatrix as pm

from promptmatrix.errors import ConfigError
from promptmatrix.plans import run as runs
from promptmatrix.sources import cases, splits
from promptmatrix.spec import read_text

READERS = {".jsonl": cases.json_lines, ".csv": cases.csv_rows}


def in_splits(path, size):
    """(first case of its range, row) of all rows, and what the counts promise; the work of the tasks, without Spark."""
    kind, found = splits.KINDS[path.suffix], splits.ranges(path, size)
    began, total = splits.chained(found, [list(kind.count(r)) for r in found])
    rows = []
    for r, place in zip(found, began, strict=True):
        assert place.cases == len(rows)
        rows += kind.rows(r, place)
    assert total == len(rows)
    return rows


def random_csv(rng):
    return "".join(rng.choice(["a", "é", ",", '"', '""', ',"', '",', '"\n', "\n", "\r\n", "\r", " ", " ", "\x0b"]) for _ in range(rng.randrange(60)))


def test_csv_ranges_of_any_size_give_the_rows_of_the_whole(tmp_path):
    rng = random.Random(11)
    path = tmp_path / "c.csv"
    for _ in range(400):
        body = ("﻿" if rng.random() < 0.1 else "") + rng.choice(["id,q\n", "", "\n", '"i\nd",q\r\n']) + random_csv(rng)
        path.write_bytes(body.encode())
        whole = list(cases.csv_rows(read_text(path, "case file"), path))
        for size in (1, rng.randrange(2, 9), rng.randrange(9, 40)):
            assert in_splits(path, size) == whole, (body, size)


def test_lines_of_json_in_ranges_of_any_size(tmp_path):
    rng = random.Random(12)
    path = tmp_path / "c.jsonl"
    for _ in range(400):
        lines = [rng.choice(["", "  ", " ", json.dumps({"q": random_csv(rng)}, ensure_ascii=False)]) for _ in range(rng.randrange(12))]
        body = ("﻿" if rng.random() < 0.1 else "") + "".join(x + rng.choice(["\n", "\r\n", "\r"]) for x in lines) + rng.choice(["", '{"last": 1}'])
        path.write_bytes(body.encode())
        whole = list(cases.json_lines(read_text(path, "case file"), path))
        for size in (1, rng.randrange(2, 9), rng.randrange(9, 90)):
            assert in_splits(path, size) == whole, (body, size)


def test_line_numbers_of_ranges(tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_bytes(b'{"a": 1}\r\n\n\r{"a": 2}\nnope\n{"a": 3}\n')
    for size in (1, 3, 7, 16, 100):
        with pytest.raises(ConfigError, match="line 5 of .* does not parse"):
            in_splits(path, size)


def test_ends_inside_against_each_character():
    rng = random.Random(13)
    for _ in range(5000):
        line, inside = "".join(rng.choice('a",') for _ in range(rng.randrange(12))), rng.random() < 0.5
        state = "in" if inside else "start"
        for c in line + "\n":
            if state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote" and c == '"':
                state = "in"
            elif c in ",\n":
                state = "start"
            else:
                state = "in" if state == "start" and c == '"' else "plain"
        assert splits.ends_inside(line, inside) == (state == "in"), (line, inside)


def same(spark, path, size):
    """The table read in splits equals the one that the driver reads."""
    got = [tuple(r) for r in splits.checked(splits.cases(spark, path, lambda row, i: cases.as_row(cases.as_case(row, f"row {i + 1}"), i, path.parent), size)).orderBy("case_pos").collect()]
    want = [tuple(r) for r in cases.dataset(spark, path).orderBy("case_pos").collect()]
    assert got == want
    return got


def test_tables(spark, tmp_path):
    (tmp_path / "doc.pdf").write_bytes(b"x")
    rows = [{"id": f"c{i}" if i % 3 else None, "q": "x" * (i * 37 % 200), "n": [i, None, 1.50], "expected": {"v": i}} | ({"doc": "file://doc.pdf"} if i % 5 == 0 else {}) for i in range(120)]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    got = same(spark, tmp_path / "c.jsonl", 3000)
    assert len(got) == 120 and got[3][1] == "case-4" and got[5][3] == {"doc": str(tmp_path / "doc.pdf")}
    (tmp_path / "c.csv").write_text('id,q,expected\n' + "".join(f'{i if i % 4 else ""},"a ""quoted"",\nline {"y" * (i * 31 % 300)}",\n' for i in range(150)))
    got = same(spark, tmp_path / "c.csv", 1700)
    assert len(got) == 150 and got[0][1] == "case-1" and "\nline" in json.loads(got[0][2])["q"]


def test_faults_in_splits(spark, tmp_path):
    for name, body, match in (
        ("bad.jsonl", '{"a": 1}\nnope\n[]', "line 2 of .* does not parse"), ("list.jsonl", "[1]", "no object"), ("none.jsonl", "\n", "no cases"), ("dup.jsonl", '{"id": "a"}\n{"id": "b"}\n{"id": "a"}', "two cases have the id 'a'"),
        ("up.jsonl", '{"f": "file://../x"}', "leads out"), ("head.csv", "id,q\n", "no cases"), ("wide.csv", "id,q\na,b\nc,d,e\n", "row 2"), ("quote.csv", "id,q\n" + 'a,"' + "b\n" * 100_000, "is no CSV"),
    ):
        (tmp_path / name).write_text(body)
        with pytest.raises(ConfigError, match=match):
            cases.dataset(spark, tmp_path / name, whole=0)
    (tmp_path / "latin.csv").write_bytes(b"id,q\na,\xff\n")
    with pytest.raises(ConfigError, match="can not be read"):
        cases.dataset(spark, tmp_path / "latin.csv", whole=0)
    with pytest.raises(ConfigError, match="not found"):
        cases.dataset(spark, tmp_path / "gone.csv", whole=0)


def test_folders_of_parts(spark, tmp_path):
    """What Spark writes as JSON or CSV is read as one file would be: parts in order, one header a part, positions without gaps."""
    table = spark.range(0, 60, 1, 4).selectExpr("cast(id as string) as id", "concat('a \"b\",\n', id) as q", "id % 7 as expected")
    table.write.json((tmp_path / "c.jsonl").as_uri())
    table.write.options(header=True, escape='"').csv((tmp_path / "c.csv").as_uri())
    for name in ("c.jsonl", "c.csv"):
        got = cases.dataset(spark, tmp_path / name).orderBy("case_pos").collect()
        assert [(r.case_pos, r.case_id, json.loads(r.vars)) for r in got] == [(i, str(i), {"q": f'a "b",\n{i}'}) for i in range(60)]
    config = {"models": [{"id": "echo", "provider": "mock"}], "variants": [{"name": "v", "prompt": [{"role": "user", "content": "{{ q }}"}]}], "scorecard": [{"criterion": "has", "scorer": {"type": "contains", "value": "b"}}]}
    done = runs.run(spark, pm.spec.parse(config | {"cases": {"file": "c.csv"}}, tmp_path))
    assert done.results.count() == 60
