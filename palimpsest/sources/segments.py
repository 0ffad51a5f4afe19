"""Folders of an index that grows: segments, and a manifest of versions that says which of them count.

A shard is written as a segment of its own; only then a new version of the manifest, a single small file, names it. A reader takes
the newest version, so it never sees half a shard, and what a failed writer left behind is in no version. A shard that a version holds
already is not added again. Versions are never changed, so an older one can still be read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROWS = "segment string, shard string, number int"


class Segments:
    """The segments that ``version`` (the newest, if none is named) of the index in ``path`` holds."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path
        try:
            rows = spark.read.schema(f"{ROWS}, version int").json(f"{path}/manifest").collect()  # a row for each shard and version
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = []
        self.version = max((r["version"] for r in rows), default=0) if version is None else version
        self.held = sorted((r["number"], r["segment"], r["shard"]) for r in rows if r["version"] == self.version)

    @property
    def shards(self) -> list[str]:
        return [s for *_, s in self.held]

    @property
    def folders(self) -> list[str]:
        return [f"{self.path}/{name}" for name in sorted({s for _, s, _ in self.held})]

    def _commit(self, held: list[tuple[int, str, str]]) -> Segments:
        rows = self.spark.createDataFrame([(s, shard, n) for n, s, shard in held], ROWS)
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/version={self.version + 1}")  # of two writers at once, one fails
        return Segments(self.spark, self.path)

    def append(self, shard: str, write: Callable[[str, int], None]) -> Segments:
        """Adds a shard that ``write(folder, number)`` writes; one that is held already is left alone."""
        if shard in self.shards:
            return self
        number = max((n for n, *_ in self.held), default=-1) + 1
        name = f"segment-{number:05d}-{uuid.uuid4().hex[:8]}"
        write(f"{self.path}/{name}", number)
        return self._commit([*self.held, (number, name, shard)])

    def compact(self, write: Callable[[str], None]) -> Segments:
        """One segment in place of all, which ``write(folder)`` makes from them; the shards stay known."""
        if len(self.folders) < 2:
            return self
        name = f"segment-all-{uuid.uuid4().hex[:8]}"
        write(f"{self.path}/{name}")
        return self._commit([(n, name, shard) for n, _, shard in self.held])

    def read(self, table: str, schema: str) -> DataFrame:
        """A table of all segments."""
        found = None
        for folder in self.folders:
            own = self.spark.read.schema(schema).parquet(f"{folder}/{table}")
            found = own if found is None else found.unionByName(own)
        return self.spark.createDataFrame([], schema) if found is None else found
