"""Folders of small files: pathlib for local paths, Hadoop's file systems for addresses with a scheme."""

from __future__ import annotations

import os
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from promptmatrix.errors import StoreError


@dataclass(frozen=True)
class Entry:
    """A file: its name from the folder, bytes, and when it was written (seconds)."""

    name: str
    size: int
    modified: float


class Folder:
    """The executors of a cluster reach ``uri``; the driver reads and writes small files through the same file system."""

    def __init__(self, root: Path | str):
        self.root = str(root)
        self.local = Path(self.root) if "://" not in self.root else None
        self.uri = self.local.resolve().as_uri() if self.local is not None else self.root.rstrip("/")

    def sub(self, name: str) -> Folder:
        return Folder(self.local / name if self.local is not None else f"{self.uri}/{name}")

    def _jvm(self, name: str = "") -> tuple[Any, Any]:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise StoreError(f"{self.root} needs a Spark session")
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def read(self, name: str) -> str | None:
        """The text of a file; None if there is none."""
        if self.local is not None:
            try:
                return (self.local / name).read_text(encoding="utf-8")
            except (FileNotFoundError, NotADirectoryError):
                return None
        fs, path = self._jvm(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside and renamed."""
        part = f".{name.replace('/', '_')}.{secrets.token_hex(4)}"
        if self.local is not None:
            self.local.mkdir(parents=True, exist_ok=True)
            (self.local / part).write_text(text, encoding="utf-8")
            os.replace(self.local / part, self.local / name)
            return
        fs, path = self._jvm(name)
        _, beside = self._jvm(part)
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.delete(path, False)
        fs.rename(beside, path)

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one of that name already."""
        if self.local is not None:
            self.local.mkdir(parents=True, exist_ok=True)
            part = self.local / f".{name}.{secrets.token_hex(4)}"
            part.write_text(text, encoding="utf-8")
            try:
                os.link(part, self.local / name)  # whole at once, never over another
            except FileExistsError:
                return False
            finally:
                part.unlink()
            return True
        fs, path = self._jvm(name)
        if fs.exists(path):
            return False
        try:
            stream = fs.create(path, False)
        except Py4JJavaError:
            if fs.exists(path):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def append(self, name: str, text: str) -> None:
        old = self.read(name) or ""
        self.write(name, old + text)

    def exists(self, name: str = "") -> bool:
        if self.local is not None:
            return (self.local / name).exists()
        fs, path = self._jvm(name)
        return fs.exists(path)

    def delete(self, name: str) -> None:
        if self.local is not None:
            (self.local / name).unlink(missing_ok=True)
            return
        fs, path = self._jvm(name)
        fs.delete(path, True)

    def names(self) -> list[str]:
        """The names directly in the folder, in order."""
        if self.local is not None:
            return sorted(p.name for p in self.local.iterdir()) if self.local.is_dir() else []
        fs, path = self._jvm()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def walk(self) -> Iterator[Entry]:
        """All files in the folder and below."""
        if self.local is not None:
            for p in sorted(self.local.rglob("*")) if self.local.is_dir() else ():
                if p.is_file():
                    yield Entry(str(p.relative_to(self.local)), p.stat().st_size, p.stat().st_mtime)
            return
        fs, path = self._jvm()
        if fs.exists(path):
            found, start = fs.listFiles(path, True), len(str(fs.makeQualified(path).toString())) + 1
            while found.hasNext():
                s = found.next()
                yield Entry(s.getPath().toString()[start:], s.getLen(), s.getModificationTime() / 1000)
