"""What adapters must offer to be registered: codecs, exporters, knowledge bases and stores."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Codec(Protocol):
    """Between a format's texts and tokens or annotations as rows."""

    def decode(self, sources: DataFrame) -> DataFrame: ...

    def encode(self, rows: DataFrame) -> DataFrame: ...


@runtime_checkable
class Exporter(Protocol):
    """From a view to what a training framework reads."""

    def export(self, view: DataFrame, **options) -> DataFrame: ...


@runtime_checkable
class Knowledge(Protocol):
    """Entities and their neighbours."""

    def resolve(self, ids: DataFrame) -> DataFrame: ...

    def search(self, text: str, limit: int) -> DataFrame: ...

    def neighbors(self, ids: DataFrame, relation: str | None, limit: int) -> DataFrame: ...


@runtime_checkable
class Store(Protocol):
    """Contents by key."""

    def put(self, blobs: DataFrame) -> None: ...

    def get(self, keys: DataFrame) -> DataFrame: ...
