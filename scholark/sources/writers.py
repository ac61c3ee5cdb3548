"""Writers, among them idempotent and incremental ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholark.operators.relational import upsert


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet; an existing output stays as it is unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "ignore").csv(path, header=header, sep=sep)


def write_json_lines(df: DataFrame, path: str, records_a_file: int = 0, overwrite: bool = False) -> None:
    """JSON lines, a new file after ``records_a_file`` records (0: no bound)."""
    df.write.mode("overwrite" if overwrite else "ignore").option("maxRecordsPerFile", records_a_file).json(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, overwrite: bool = True) -> None:
    """A folder of CSV files, one a sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}", overwrite=overwrite)


def write_cards(cards: DataFrame, path: str, overwrite: bool = False) -> None:
    """Cards (``name``, ``value``) as text files in a folder per name."""
    cards.write.mode("overwrite" if overwrite else "ignore").partitionBy("name").text(path)


def node_link(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON lines of a graph: a line per node and per link, so that no line holds the whole graph."""
    nodes = vertices.select(F.to_json(F.struct(F.lit("node").alias("kind"), *vertices.columns)).alias("value"))
    return nodes.unionByName(edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), *edges.columns)).alias("value")))


def upsert_parquet(new: DataFrame, path: str, target: str, key: str) -> None:
    """The table at ``path`` with ``new`` replacing its keys, written to ``target`` (another place: readers keep the old one)."""
    upsert(new.sparkSession.read.parquet(path), new, key).write.mode("overwrite").parquet(target)


def write_listing(spark: SparkSession, folder: str, extension: str | None = None, name: str = "directory.txt") -> DataFrame:
    """The names of the direct children of ``folder`` (those ending in ``extension``), written there as one text file and
    returned as ``value``."""
    from scholark.sources.readers import _names

    found = [n for n in _names(spark, folder) if n != name and not n.startswith(("_", ".")) and (extension is None or n.endswith(extension))]
    listing = spark.createDataFrame([(n,) for n in found], "value string")
    listing.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return listing
