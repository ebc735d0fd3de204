"""The list of a store's runs: a log of numbered entries with snapshots, so that listing opens a few files however many runs there are.

An entry is written when a run is created or changes its status, under the
next free number and never over another one; who loses a number takes the
next.  Every ``EVERY``th entry is followed by a snapshot of all runs, after
which older entries go.  The list is an index: run.json stays the truth, a run
that the list does not know is found by its folder, and one whose folder is
gone is left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from promptmatrix.errors import StoreError
from promptmatrix.sources.folders import Folder

FIELDS = ("id", "label", "status", "created_ns", "started_at", "finished_at")
#: Entries between two snapshots.
EVERY = 64
#: How often a reader starts anew when entries go while it reads, and a writer when numbers are taken.
TRIES = 1000
_SNAPSHOT = "snapshot-"


def brief(meta: dict[str, Any]) -> dict[str, Any]:
    return {f: meta.get(f) for f in FIELDS}


def by_time(run: dict[str, Any]) -> tuple[int, str]:
    """Oldest first; runs of one time by id."""
    return run.get("created_ns") or 0, run["id"]


class Registry:
    """``place`` holds the log, ``store`` the folders of runs; ``meta`` reads one run.json and gives None where there is none."""

    def __init__(self, store: Folder, meta: Callable[[str], dict[str, Any] | None]):
        self.store, self.place, self.meta = store, store.sub(".registry"), meta

    def _numbers(self) -> tuple[int, list[int]]:
        """The last snapshot (0: none) and the entries after it."""
        names = self.place.names()
        last = max((int(n[len(_SNAPSHOT) :].split(".")[0]) for n in names if n.startswith(_SNAPSHOT)), default=0)
        return last, [k for n in names if n[0].isdigit() and (k := int(n.split(".")[0])) > last]

    def _known(self) -> tuple[dict[str, dict[str, Any]], bool]:
        """What the log says of each run, and whether all of it could be read."""
        for _ in range(TRIES):
            last, numbers = self._numbers()
            texts = [self.place.read(f"{_SNAPSHOT}{last}.jsonl")] if last else []
            texts += [self.place.read(f"{n:012d}.json") for n in numbers]
            if None not in texts:
                break
        else:
            raise StoreError(f"the list of runs at {self.place.root} changes faster than it can be read")
        found, whole = {}, True
        for line in (line for text in texts for line in text.split("\n") if line):
            try:
                run = json.loads(line)
                found[run["id"]] = run
            except (ValueError, TypeError, KeyError):  # an entry that is being written
                whole = False
        return found, whole

    def runs(self) -> list[dict[str, Any]]:
        """id, label, status and times of every run, oldest first."""
        return self._listed(self._known()[0])

    def _listed(self, known: dict[str, dict[str, Any]]) -> list[dict[str, Any]]:
        out = []
        for name in self.store.names():
            run = known.get(name) if not name.startswith(".") else {}
            if run is None:
                meta = self.meta(name)
                run = brief(meta) if meta and meta.get("id") == name else {}
            if run:
                out.append(run)
        return sorted(out, key=by_time)

    def put(self, meta: dict[str, Any]) -> None:
        """Enters the present state of a run."""
        text = json.dumps(brief(meta), default=str)
        last, numbers = self._numbers()
        start = max([last, *numbers]) + 1
        for n in range(start, start + TRIES):
            if self.place.create(f"{n:012d}.json", text + "\n"):
                break
        else:
            raise StoreError(f"no free number in the list of runs at {self.place.root}")
        if n % EVERY == 0:
            self._snapshot(n, last)

    def _snapshot(self, n: int, before: int) -> None:
        """All runs as entries up to ``n``, and later ones that are there, tell; what the snapshot before covers is deleted, so readers of that one can end."""
        known, whole = self._known()
        if not whole:
            return  # the next one will hold it
        self.place.write(f"{_SNAPSHOT}{n}.jsonl", "".join(json.dumps(r, default=str) + "\n" for r in self._listed(known)))
        for name in self.place.names():
            number = int(name.removeprefix(_SNAPSHOT).split(".")[0]) if name[0].isdigit() or name.startswith(_SNAPSHOT) else None
            if number is not None and (number < before or number == before and not name.startswith(_SNAPSHOT)):
                self.place.delete(name)
