"""The list of runs: few files opened, nothing lost between writers, run.json as the truth."""

from __future__ import annotations

import json
import threading

import pytest

from promptmatrix.errors import StoreError
from promptmatrix.sources import registry
from promptmatrix.sources.folders import Folder
from promptmatrix.sources.store import Store


def opened(monkeypatch, act):
    """What ``act`` gives, and how many files it opened."""
    n, read = [0], Folder.read

    def counted(self, name):
        n[0] += 1
        return read(self, name)

    monkeypatch.setattr(Folder, "read", counted)
    try:
        return act(), n[0]
    finally:
        monkeypatch.setattr(Folder, "read", read)


def test_many_runs_are_listed_without_opening_each(tmp_path, monkeypatch):
    place = tmp_path / ".registry"
    place.mkdir()
    many = [{"id": f"r{i:05d}", "label": f"l{i % 7}", "status": "complete", "created_ns": i} for i in range(20_000)]
    (place / "snapshot-64.jsonl").write_text("".join(json.dumps(r) + "\n" for r in many))
    for r in many:
        (tmp_path / r["id"]).mkdir()
    for r in many[-40:]:
        (tmp_path / r["id"] / "run.json").write_text(json.dumps(r))
    store = Store(tmp_path)
    found, n = opened(monkeypatch, store.registry.runs)
    assert len(found) == 20_000 and [r["id"] for r in found] == [r["id"] for r in many] and n == 1
    last, n = opened(monkeypatch, lambda: store.runs(20))
    assert [m["id"] for m in last] == [r["id"] for r in many[-20:]] and n == 21
    assert opened(monkeypatch, lambda: store.resolve("latest")) == ("r19999", 2)
    got, n = opened(monkeypatch, lambda: store.resolve("l3"))
    assert got == max(r["id"] for r in many if r["label"] == "l3") and n <= 3


def test_entries_are_folded_into_snapshots(tmp_path, monkeypatch):
    store = Store(tmp_path)
    ids = []
    for i in range(150):
        ids.append(store.create({"n": i}, f"l{i}"))
        if i % 2:
            store.finalize(ids[-1], True, aggregates={})
            store.update(ids[-1], note="no entry for what the list does not show")
    names = Folder(tmp_path / ".registry").names()
    assert sum(n.startswith("snapshot-") for n in names) == 2 and len(names) <= 2 * registry.EVERY + 2
    found, n = opened(monkeypatch, store.registry.runs)
    assert sorted(r["id"] for r in found) == sorted(ids) and n <= registry.EVERY + 1
    assert [r["status"] for r in sorted(found, key=lambda r: int(r["label"][1:]))] == ["running", "complete"] * 75
    assert len(store.runs()) == 150


def test_writers_at_once_lose_nothing(tmp_path):
    def work():
        store = Store(tmp_path)
        for _ in range(25):
            run = store.create({}, "many")
            store.finalize(run, True)
            made.append(run)

    made: list[str] = []
    threads = [threading.Thread(target=work) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = Store(tmp_path).registry.runs()
    assert sorted(r["id"] for r in found) == sorted(made) and len(made) == 200 and {r["status"] for r in found} == {"complete"}


def test_runs_that_the_list_does_not_know_and_runs_that_are_gone(tmp_path):
    store = Store(tmp_path)
    a, b = store.create({}, "x"), store.create({}, "x")
    (tmp_path / "old").mkdir()
    (tmp_path / "old/run.json").write_text(json.dumps({"id": "old", "label": "x", "created_ns": 5}))
    (tmp_path / b / "run.json").write_text("{")
    assert [m["id"] for m in store.runs()] == ["old", a] and store.resolve("x") == store.resolve("latest") == a
    (tmp_path / a / "run.json").unlink()
    (tmp_path / a).rmdir()
    assert [m["id"] for m in store.runs()] == ["old"] and store.resolve("x") == "old"
    (tmp_path / ".registry" / f"{3:012d}.json").write_text('{"id": "torn')
    assert [r["id"] for r in store.registry.runs()] == ["old", b]
    with pytest.raises(StoreError, match="no run"):
        store.resolve("y")


def test_files_are_created_once(spark, tmp_path):
    for place in (Folder(tmp_path / "near"), Folder((tmp_path / "far").as_uri())):
        assert place.create("a", "1") and not place.create("a", "2") and place.read("a") == "1" and place.names() == ["a"]
