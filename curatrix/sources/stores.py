"""Scans of vector stores, and writes to them, as a Python data source.

A store is reached through a client that the caller names as ``module:function``
(importable on executors): called with the options it gives an object with

* ``shards() -> list[str]``: parts that can be read on their own, one task each;
* ``scan(shard, page) -> iterator of lists of (id, sample_id, label_id, vector)``,
  at most ``page`` rows a list;
* ``upsert(rows)``: write a list of such rows, where it can be written to.

    spark.dataSource.register(StoreSource)
    spark.read.format("vector_store").option("client", "my.module:connect").load()

With the option ``pushdown`` (and Spark's ``spark.sql.python.filterPushdown.enabled``),
conditions on ``id`` by equality or a list reach the client, if it has
``lookup(ids) -> rows``.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "id string, sample_id string, label_id string, embedding array<double>"


def client(options: dict) -> object:
    module, function = options["client"].split(":")
    return getattr(importlib.import_module(module), function)(dict(options))


class Shard(InputPartition):
    def __init__(self, name: str, ids: tuple[str, ...] | None = None) -> None:
        self.name, self.ids = name, ids


class StoreReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.ids: tuple[str, ...] | None = None

    def partitions(self) -> list[Shard]:
        if self.ids is not None:
            return [Shard("", self.ids)]
        return [Shard(s) for s in client(self.options).shards()]

    def read(self, partition: Shard) -> Iterator[tuple]:
        own = client(self.options)
        if partition.ids is not None:
            yield from (tuple(r) for r in own.lookup(list(partition.ids)))
            return
        for rows in own.scan(partition.name, int(self.options.get("page", 1000))):
            yield from (tuple(r) for r in rows)


class LookupReader(StoreReader):
    """A reader that takes one condition on ``id``, if the client can look ids up (option ``pushdown``)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.ids is None and isinstance(f, EqualTo | In) and f.attribute == ("id",) and hasattr(client(self.options), "lookup"):
                self.ids = tuple(f.value) if isinstance(f, In) else (f.value,)
            else:
                yield f


class StoreWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Upserts of ``write_batch`` rows; a task that is tried again upserts the same rows once more."""
        own, size, held = client(self.options), int(self.options.get("write_batch", 1000)), []
        for r in rows:
            held.append((r["id"], r["sample_id"], r["label_id"], list(r["embedding"])))
            if len(held) >= size:
                own.upsert(held)
                held = []
        if held:
            own.upsert(held)
        return WriterCommitMessage()


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return LookupReader(self.options) if self.options.get("pushdown") == "true" else StoreReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return StoreWriter(self.options)


class FolderStore:
    """A store of JSON lines below a shared folder (option ``root``): later files win."""

    def __init__(self, options: dict) -> None:
        self.root = options["root"]
        self.parts = int(options.get("parts", 4))

    def _part(self, i: str) -> int:
        return sum(i.encode()) % self.parts

    def shards(self) -> list[str]:
        return [str(k) for k in range(self.parts)] if os.path.isdir(self.root) else []

    def _rows(self, shard: int) -> dict[str, list]:
        rows: dict[str, list] = {}
        for name in sorted(os.listdir(self.root)):
            if name.endswith(f".{shard}.jsonl"):
                with open(os.path.join(self.root, name), encoding="utf-8") as f:
                    rows |= {r[0]: r for r in map(json.loads, f)}
        return rows

    def scan(self, shard: str, page: int) -> Iterator[list]:
        rows = list(self._rows(int(shard)).values())
        for at in range(0, len(rows), page):
            yield rows[at : at + page]

    def lookup(self, ids: list[str]) -> list:
        found = {k: self._rows(k) for k in {self._part(i) for i in ids}}
        return [r for i in ids if (r := found[self._part(i)].get(i))]

    def upsert(self, rows: list) -> None:
        os.makedirs(self.root, exist_ok=True)
        number = f"{len(os.listdir(self.root)):012d}-{uuid.uuid4().hex}"
        for k in range(self.parts):
            own = [r for r in rows if self._part(r[0]) == k]
            if own:
                with open(os.path.join(self.root, f"{number}.{k}.jsonl"), "w", encoding="utf-8") as f:
                    f.writelines(json.dumps(r) + "\n" for r in own)


def folder_store(options: dict) -> FolderStore:
    return FolderStore(options)
