"""Snapshots of candidate lists in a shared folder, so that pages of one request come from one state of the table.

A snapshot is a folder with its items, numbered in feed order, and a manifest that is renamed into place after they are written:
without it there is no snapshot. It is bound to a scope, expires, and closes with its last page. Files of expired snapshots
go with the next purge. All of it is on the file system, so any driver that shares the folder serves the next page.
"""

from __future__ import annotations

import json
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.operators.contract import SnapshotError
from feedlens.operators.paging import newest_first


@dataclass(frozen=True)
class Manifest:
    scope: str
    expires: float
    total: int
    closed: bool = False


@dataclass(frozen=True)
class Page:
    """Rows of a page in order, by pos; id is empty with the last page."""

    rows: DataFrame
    id: str
    page: int
    limit: int
    total: int
    pages: int
    expires: float


def _positive(value: object, otherwise: int) -> int:
    try:
        n = float(value)
    except (TypeError, ValueError):
        return otherwise
    return int(n) if n > 0 and n == int(n) else otherwise


@dataclass(frozen=True)
class SnapshotStore:
    """Codes of its errors: scope_invalid, too_large, capacity, token_failed, unavailable, scope_mismatch."""

    spark: SparkSession
    root: str
    ttl: float = 60.0
    most_snapshots: int = 16
    most_items: int = 5000
    attempts: int = 3
    now: Callable[[], float] = time.time
    new_id: Callable[[], str] = lambda: secrets.token_urlsafe(32)

    def _path(self, *names: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self, name: str) -> Manifest | None:
        files, at = self._path(name, "manifest.json")
        if not files.exists(at):
            return None
        text = self.spark.read.text(at.toString(), wholetext=True).first()
        return Manifest(**json.loads(text.value)) if text else None

    def _commit(self, name: str, manifest: Manifest) -> None:
        """Written beside its place and renamed into it."""
        files, draft = self._path(name, f"draft-{secrets.token_hex(8)}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        _, at = self._path(name, "manifest.json")
        files.delete(at, False)
        if not files.rename(draft, at):
            raise SnapshotError("token_failed")

    def _names(self) -> list[str]:
        files, at = self._path()
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def purge(self) -> None:
        """Drops what has expired."""
        for name in self._names():
            m = self._manifest(name)
            if m is not None and m.expires <= self.now():
                self.delete(name)

    def delete(self, name: str) -> None:
        files, at = self._path(name)
        files.delete(at, True)

    def size(self) -> int:
        """Snapshots that can be read."""
        found = [self._manifest(n) for n in self._names()]
        return sum(m is not None and not m.closed and m.expires > self.now() for m in found)

    def create(self, scope: str, items: DataFrame) -> str:
        """Stores the items in feed order and returns the snapshot's id. Refuses more items than most_items; at most one more
        is read to find out."""
        self.purge()
        scope = (scope or "").strip()
        if not scope:
            raise SnapshotError("scope_invalid")
        if self.size() >= self.most_snapshots:
            raise SnapshotError("capacity")
        taken = set(self._names())
        name = next((n for n in (str(self.new_id() or "").strip() for _ in range(self.attempts)) if n and n not in taken), "")
        if not name:
            raise SnapshotError("token_failed")
        head = items.orderBy(*newest_first()).limit(self.most_items + 1)
        head.withColumn("pos", F.row_number().over(Window.orderBy(*newest_first()))).write.parquet(f"{self.root}/{name}/items")
        total = self.spark.read.parquet(f"{self.root}/{name}/items").count()
        if total > self.most_items:
            self.delete(name)
            raise SnapshotError("too_large")
        self._commit(name, Manifest(scope, self.now() + self.ttl, total))
        return name

    def read_page(self, name: str, scope: str, page: object = 1, limit: object = 1) -> Page:
        """A page; numbers beyond the last give the last, and none that is a positive integer gives 1."""
        name = (name or "").strip()
        m = self._manifest(name) if name else None
        if m is None or m.closed or m.expires <= self.now():
            raise SnapshotError("unavailable")
        if m.scope != (scope or "").strip():
            raise SnapshotError("scope_mismatch")
        limit = _positive(limit, 1)
        pages = max(1, -(-m.total // limit))
        page = min(pages, _positive(page, 1))
        first = (page - 1) * limit + 1
        rows = self.spark.read.parquet(f"{self.root}/{name}/items").where(F.col("pos").between(first, first + limit - 1)).orderBy("pos")
        return Page(rows, name, page, limit, m.total, pages, m.expires)

    def close(self, name: str) -> None:
        """No more pages; the files stay until they expire, as the last page's rows may not be read yet."""
        m = self._manifest(name)
        if m is not None:
            self._commit(name, replace(m, closed=True))

    def serve(self, scope: str, build: Callable[[], DataFrame] | None, name: str = "", page: object = 1, limit: object = 1) -> Page:
        """A request's page: of its snapshot, or of a new one that `build` gives the items of. The last page closes it."""
        if not (name or "").strip():
            if build is None:
                raise TypeError("a first page needs a builder")
            name = self.create(scope, build())
        found = self.read_page(name, scope, page, limit)
        if found.page < found.pages:
            return found
        self.close(name)
        return replace(found, id="")
