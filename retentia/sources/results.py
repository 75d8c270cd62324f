"""Stored results that are kept while someone holds them and their input stays the same."""

import hashlib
import threading
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from retentia.sources.staging import discard, file_states, new_folder


def fingerprint(spark: SparkSession, paths) -> str:
    """A hash over names, sizes and change times of all files under `paths`.

    The files are listed on the driver, without a job; of a table with very many files
    name one that changes with it, such as its manifest.
    """
    seen = hashlib.sha256()
    for path in paths:
        for entry in sorted(file_states(spark, path)):
            seen.update(repr(entry).encode())
    return seen.hexdigest()


@dataclass
class _Entry:
    print: str
    value: Any
    folder: str
    holders: set = field(default_factory=set)
    current: bool = True


class Handle:
    """A hold on a result; use it as a context, or call `release` when done."""

    def __init__(self, cache: "ResultCache", entry: _Entry):
        self._cache, self._entry, self.id = cache, entry, uuid.uuid4().hex
        entry.holders.add(self.id)

    @property
    def value(self):
        return self._entry.value

    @property
    def folder(self) -> str:
        return self._entry.folder

    def release(self) -> None:
        """Give the result up; a second call does nothing."""
        self._cache._release(self._entry, self.id)

    def __enter__(self):
        return self

    def __exit__(self, *problem):
        self.release()


class ResultCache:
    """Results by name and input paths, each in a folder of its own.

    A result is built when it is first asked for, and again when its input files have
    changed.  The folder of one that was replaced or dropped is deleted once nobody
    holds it, so a reader never loses its files.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._entries, self._lock = spark, {}, threading.RLock()

    def get(self, name: str, inputs, build) -> Handle:
        """A hold on `build(folder)`; what it returns may read from that folder."""
        with self._lock:
            key, seen = (name, tuple(inputs)), fingerprint(self._spark, inputs)
            entry = self._entries.get(key)
            if entry is None or entry.print != seen:
                folder = new_folder(self._spark, name)
                try:
                    fresh = _Entry(seen, build(folder), folder)
                except BaseException:
                    discard(self._spark, folder)
                    raise
                self._entries[key] = fresh
                if entry is not None:
                    self._retire(entry)
                entry = fresh
            return Handle(self, entry)

    def drop(self, name: str | None = None) -> None:
        """Forget the results called `name`, or all; those still held go when released."""
        with self._lock:
            for key in [k for k in self._entries if name in (None, k[0])]:
                self._retire(self._entries.pop(key))

    def folders(self) -> list:
        """Where the results that are current are stored."""
        return sorted(e.folder for e in self._entries.values())

    def _retire(self, entry):
        entry.current = False
        if not entry.holders:
            discard(self._spark, entry.folder)

    def _release(self, entry, holder):
        with self._lock:
            if holder in entry.holders:
                entry.holders.remove(holder)
                if not entry.current and not entry.holders:
                    discard(self._spark, entry.folder)
