"""Caches of the driver: rendered tiles by size, index maps by raster and name."""

from __future__ import annotations

import hashlib
import threading
from collections import OrderedDict
from functools import reduce

from pyspark.sql import DataFrame

from bandloom.model import Seed


def tile_key(raster_id: str, z: int, x: int, y: int, seeds: list[Seed] = ()) -> str:
    """Everything a tile depends on: the raster, its place, and the seeds."""
    digest = hashlib.sha1(repr([(s.row, s.col, s.kind) for s in seeds]).encode()).hexdigest()[:12] if seeds else "-"
    return f"{raster_id}/{z}/{x}/{y}/{digest}"


class TileCache:
    """Bytes in order of use, the oldest dropped over a size; an item larger than all is kept alone."""

    def __init__(self, max_size_mb: float = 500):
        self.limit, self.size = int(max_size_mb * (1 << 20)), 0
        self._items: OrderedDict[str, bytes] = OrderedDict()
        self._lock = threading.Lock()
        self.hits = self.misses = 0

    def get(self, key: str) -> bytes | None:
        with self._lock:
            if key not in self._items:
                self.misses += 1
                return None
            self.hits += 1
            self._items.move_to_end(key)
            return self._items[key]

    def put(self, key: str, value: bytes) -> None:
        with self._lock:
            self.size += len(value) - len(self._items.pop(key, b""))
            self._items[key] = value
            while self.size > self.limit and len(self._items) > 1:
                _, old = self._items.popitem(last=False)
                self.size -= len(old)

    def clear(self) -> None:
        with self._lock:
            self._items.clear()
            self.size = 0

    def stats(self) -> dict:
        return {"items": len(self._items), "size_mb": self.size / (1 << 20), "max_size_mb": self.limit / (1 << 20), "hits": self.hits, "misses": self.misses}


class IndexCache:
    """Materialised index maps by (raster, name), with the progress of a precomputation."""

    def __init__(self):
        self._maps: dict[tuple[str, str], DataFrame] = {}
        self._errors: dict[tuple[str, str], str] = {}
        self._total: dict[str, int] = {}
        self._lock = threading.Lock()

    def begin(self, raster_id: str, total: int) -> None:
        with self._lock:
            self._total[raster_id] = total

    def put(self, raster_id: str, name: str, df: DataFrame) -> None:
        """Keep the table that holds a map as one of its columns."""
        with self._lock:
            self._maps[raster_id, name] = df

    def fail(self, raster_id: str, name: str, error: str) -> None:
        with self._lock:
            self._errors[raster_id, name] = error

    def get(self, raster_id: str, name: str) -> DataFrame | None:
        table = self._maps.get((raster_id, name))
        return None if table is None else table.select("row", "col", name)

    def get_all(self, raster_id: str, names: list[str]) -> DataFrame:
        """(row, col, names) of maps that are there; those of one table are read at once, others are joined."""
        tables: dict[int, tuple[DataFrame, list[str]]] = {}
        for n in names:
            table = self._maps[raster_id, n]
            tables.setdefault(id(table), (table, []))[1].append(n)
        parts = [table.select("row", "col", *own) for table, own in tables.values()]
        return reduce(lambda a, b: a.join(b, ["row", "col"]), parts).select("row", "col", *names)

    def clear_for(self, raster_id: str) -> None:
        with self._lock:
            for store in (self._maps, self._errors):
                for key in [k for k in store if k[0] == raster_id]:
                    del store[key]
            self._total.pop(raster_id, None)

    def status(self, raster_id: str) -> dict:
        """done counts errors too; ready lists names in order."""
        ready = sorted(n for r, n in self._maps if r == raster_id)
        errors = {n: e for (r, n), e in self._errors.items() if r == raster_id}
        total = self._total.get(raster_id, 0)
        return {"total": total, "done": len(ready) + len(errors), "ready": ready, "errors": errors, "finished": total > 0 and len(ready) + len(errors) >= total}
