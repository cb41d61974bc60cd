"""Named functions over columns, and transactions over facets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame


class Functions:
    """A registry of functions from columns to a column, by name and by the SHA-1 of their source."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[..., Column]] = {}
        self._by_sha: dict[str, str] = {}

    def load(self, name: str, fn: Callable[..., Column], source: str = "") -> str:
        self._by_name[name] = fn
        sha = hashlib.sha1((source or name).encode()).hexdigest()
        self._by_sha[sha] = name
        return sha

    def call(self, name: str, *args: Column) -> Column:
        return self._by_name[self._by_sha.get(name, name)](*args)

    def exists(self, *shas: str) -> list[bool]:
        return [s in self._by_sha for s in shas]

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def delete(self, name: str) -> None:
        del self._by_name[name]
        self._by_sha = {s: n for s, n in self._by_sha.items() if n != name}

    def flush(self) -> None:
        self._by_name.clear()
        self._by_sha.clear()


class Conflict(RuntimeError):
    """A watched facet has changed."""


class Transaction:
    """Queued changes to named facets that take effect together, or not at all where a watched facet has another version by then."""

    def __init__(self, facets: dict[str, DataFrame], versions: dict[str, int]):
        self._facets, self._versions = facets, versions
        self._watched: dict[str, int] = {}
        self._queue: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def watch(self, *names: str) -> None:
        self._watched |= {n: self._versions.get(n, 0) for n in names}

    def unwatch(self) -> None:
        self._watched.clear()

    def queue(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        self._queue.append((name, change))

    def discard(self) -> None:
        self._queue.clear()
        self._watched.clear()

    def commit(self) -> None:
        late = [n for n, v in self._watched.items() if self._versions.get(n, 0) != v]
        queue = list(self._queue)
        self.discard()
        if late:
            raise Conflict(", ".join(late))
        new = dict(self._facets)
        for name, change in queue:
            new[name] = change(new[name])
        for name in {n for n, _ in queue}:
            self._facets[name] = new[name]
            self._versions[name] = self._versions.get(name, 0) + 1
