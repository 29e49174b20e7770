"""Readers of sources as Spark Data Sources: in batches and as streams with offsets.

An adapter is a class with ``fetch`` and, for streams, ``latest``; an application
names its own by module. Every source of a work list is one partition, so sources
are read in parallel, each by one task. What an adapter raises while it reads is
a row of its own in the column ``error`` and ends that source alone: the items
that it gave before stand, and other sources don't notice.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quern import schemas as S

FORMAT = "quern_items"
FIELDS = tuple(S.RAW_ITEM.names)


class Adapter:
    """What an application's adapter does; items are dictionaries of the raw item's columns, missing ones null."""

    def fetch(self, source: dict, start: int, end: int | None) -> Iterator[dict]:
        """Items from ``start`` up to but not including ``end``, all there are if that is None, in the source's own count."""
        raise NotImplementedError

    def latest(self, source: dict) -> int:
        """How many items the source has by now."""
        raise NotImplementedError


class ManualUpload(Adapter):
    """SRC-07: no items."""

    def fetch(self, source: dict, start: int, end: int | None) -> Iterator[dict]:
        return iter(())

    def latest(self, source: dict) -> int:
        return 0


#: UDF-01, SRC-08: adapters by name; ``module:Class`` names any other.
ADAPTERS = {"manual_upload": "quern.sources.adapters:ManualUpload"}


def adapter_of(source: dict) -> Adapter:
    """SRC-08: the adapter that a source names; LookupError without one of that name."""
    name = source.get("adapter") or ""
    place = ADAPTERS.get(name, name)
    if ":" not in place:
        raise LookupError(f"unknown adapter: {name}")
    module, _, kind = place.partition(":")
    return getattr(importlib.import_module(module), kind)()


class SourcePart(InputPartition):
    def __init__(self, source: dict, start: int, end: int | None):
        self.source, self.start, self.end = source, start, end


def _rows(part: SourcePart) -> Iterator[tuple]:
    given = 0
    try:
        for item in adapter_of(part.source).fetch(part.source, part.start, part.end):
            yield (part.source["source_id"], *[item.get(f) for f in FIELDS if f != "source_id"], part.start + given, None)
            given += 1
    except Exception as e:  # a source's failure must not end the others
        yield (part.source["source_id"], *[None for f in FIELDS if f != "source_id"], None, f"{type(e).__name__}: {e}"[:500])


class _Reader(DataSourceReader):
    def __init__(self, sources: list[dict]):
        self.sources = sources

    def partitions(self) -> list[InputPartition]:
        return [SourcePart(s, 0, None) for s in self.sources]

    def read(self, partition: SourcePart) -> Iterator[tuple]:
        return _rows(partition)


class _StreamReader(DataSourceStreamReader):
    """An offset is how many items of each source have been read; a source that can't say stays where it was."""

    def __init__(self, sources: list[dict]):
        self.sources = sources
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {s["source_id"]: 0 for s in self.sources}

    def latestOffset(self) -> dict:
        for s in self.sources:
            try:
                self.known[s["source_id"]] = max(self.known.get(s["source_id"], 0), adapter_of(s).latest(s))
            except Exception:  # asked again for the next batch
                self.known.setdefault(s["source_id"], 0)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = [(s, start.get(s["source_id"], 0), end.get(s["source_id"], 0)) for s in self.sources]
        return [SourcePart(s, a, b) for s, a, b in spans if b > a]

    def read(self, partition: SourcePart) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ItemsSource(DataSource):
    """``spark.read.format("quern_items").option("sources", json)``: the sources' items with ``place`` and ``error``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType([S.RAW_ITEM["source_id"], *[f for f in S.RAW_ITEM if f.name != "source_id"]]).add("place", "long").add("error", "string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(json.loads(self.options["sources"]))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(json.loads(self.options["sources"]))


def read_sources(spark: SparkSession, sources: list[dict], stream: bool = False) -> DataFrame:
    """Items of a work list's sources, ``place`` counting each source's from 0, and a row with ``error`` for each that failed."""
    spark.dataSource.register(ItemsSource)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("sources", json.dumps(sources)).load()
