"""Named catalogues of data sets: which file holds which table in which version."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Entry:
    """Where a table lies below its catalogue's folder, in what format, and the schema where the format has none."""

    path: str
    format: str = "parquet"
    schema: str | T.StructType | None = None


@dataclass(frozen=True)
class Catalog:
    """Tables of one version; a version may be built on another and replace some of its tables."""

    name: str
    folder: str
    entries: dict[str, Entry]

    def with_entries(self, name: str, entries: dict[str, Entry]) -> Catalog:
        return Catalog(name, self.folder, self.entries | entries)

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        """One table, lazily; a table that the catalogue lacks is a KeyError."""
        entry = self.entries[table]
        reader = spark.read.format(entry.format)
        return (reader.schema(entry.schema) if entry.schema is not None else reader).load(f"{self.folder}/{entry.path}")

    def load_all(self, spark: SparkSession, only: Sequence[str] | None = None, without: Sequence[str] = ()) -> dict[str, DataFrame]:
        """All tables but those ``without``, or those named ``only``; nothing is read before an action asks for it."""
        return {t: self.load(spark, t) for t in (self.entries if only is None else only) if t not in without}
