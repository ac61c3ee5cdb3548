"""Readers of the file formats around the pipeline. All are lazy; nothing is inferred from data."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholark.schema import DECLARED, PREDICTIONS


def _names(spark: SparkSession, directory: str) -> list[str]:
    """Names in a folder of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(path)) if system.exists(path) else []


def parquet_path(spark: SparkSession, directory: str, table: str) -> str:
    """The one path of a table: ``{table}_*parquet*``, else ``*_{table}_*parquet*``, else ``{table}.parquet``, as converted dumps
    are named; anything but one match is a ValueError."""
    names = _names(spark, directory)
    for pattern in (f"{table}_*parquet*", f"*_{table}_*parquet*", f"{table}.parquet"):
        if found := [n for n in names if fnmatch.fnmatchcase(n, pattern)]:
            if len(found) > 1:
                raise ValueError(f"{len(found)} paths for {table} in {directory}")
            return f"{directory}/{found[0]}"
    raise ValueError(f"no path for {table} in {directory}")


def read_tsv(spark: SparkSession, path: str, table: str, declared: dict[str, str] = DECLARED) -> DataFrame:
    """A tab-separated dump of a declared table, without header; quotes are text."""
    return spark.read.csv(path, sep="\t", schema=declared[table], quote="", header=False)


def convert_dump(spark: SparkSession, source: str, target: str, declared: dict[str, str] = DECLARED) -> list[str]:
    """Every known table of a dump folder as Parquet; a table is named by its file up to the first dot. Unknown tables and
    those already converted are left alone. The names of the converted tables."""
    done = {n.split(".")[0] for n in _names(spark, target)}
    converted = []
    for name in _names(spark, source):
        table = name.split(".")[0]
        if table in declared and table not in done:
            read_tsv(spark, f"{source}/{name}", table, declared).write.mode("ignore").parquet(f"{target}/{table}.parquet")
            converted.append(table)
    return converted


def read_named_csv(spark: SparkSession, path: str, columns: str, sep: str = ",") -> DataFrame:
    """A (compressed) CSV without header; ``columns`` is a DDL string."""
    return spark.read.csv(path, schema=columns, header=False, sep=sep)


def inverted_abstracts(rows: DataFrame, key: str = "PaperId", index: str = "IndexedAbstract") -> DataFrame:
    """``key``, ``abstract`` of inverted indexes ``{IndexLength, InvertedIndex: {word: [places]}}``; unreadable ones go."""
    kind = "IndexLength int, InvertedIndex map<string, array<int>>"
    words = rows.select(key, F.from_json(index, kind).alias("x")).select(key, F.explode("x.InvertedIndex").alias("word", "places"))
    placed = words.select(key, F.explode("places").alias("at"), "word")
    return placed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("abstract"))


def keyed_json(spark: SparkSession, pattern: str, ids: DataFrame, key: str = "id") -> DataFrame:
    """``key``, ``value``: the JSON text of each id from files named ``{id}.json`` or ``{name}_{id}.json``, the first in order
    of the file's name where several match."""
    files = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(?:^|[/_])([^/_]+)\.json$", 1).alias("__id"), F.input_file_name().alias("__f"), "value")
    first = files.groupBy("__id").agg(F.min_by("value", "__f").alias("value"))
    return ids.join(first, F.col(key).cast("string") == F.col("__id")).drop("__id")


def join_database(spark: SparkSession, url: str, keys: DataFrame, key: str, table: str, properties: dict[str, str] | None = None, parts: int = 16) -> DataFrame:
    """Rows of a database table whose ``key`` is among ``keys`` (one column): read in ``parts`` ranges of the key and joined
    here, which takes the place of a temporary table pushed there."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    rows = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if low is not None:
        rows = rows.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(int(high) + 1)).option("numPartitions", str(parts))
    return rows.load().join(keys.distinct(), key, "left_semi")


def read_edges(spark: SparkSession, path: str, min_weight: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a weighted edge list: edges of ``min_weight`` or less go, their ends stay as vertices."""
    rows = spark.read.csv(path, schema="src bigint, dst bigint, weight double", header=False)
    vertices = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return vertices, rows.where(F.col("weight") > min_weight)


def read_predictions(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "predictions*.jsonl") -> DataFrame:
    return spark.read.schema(PREDICTIONS).option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).json(path)


def read_ego_partitions(spark: SparkSession, path: str) -> DataFrame:
    """``node``, ``component``, ``neighbour`` from lines of ``{node: {component: [neighbours]}}``; a node on two lines fails."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.LongType())))
    maps = spark.read.text(path).select(F.explode(F.from_json("value", kind)).alias("node", "parts"))
    counted = maps.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts"))
    checked = counted.select("node", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two lines for node "), F.col("node"))).cast("map<string,array<bigint>>")).otherwise(F.col("parts")).alias("parts"))
    parts = checked.select("node", F.explode("parts").alias("component", "neighbours"))
    return parts.select(F.col("node").cast("bigint").alias("node"), F.col("component").cast("int").alias("component"), F.explode("neighbours").alias("neighbour"))


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """``s2_id``, ``abbrv``, ``long_form``, ``freq`` from lines of ``{id: ..., abbreviations: [{abbrv: long form}]}``."""
    rows = spark.read.schema("id bigint, abbreviations array<map<string,string>>").json(path)
    pairs = rows.select(F.col("id").alias("s2_id"), F.explode("abbreviations").alias("m")).select("s2_id", F.explode("m").alias("abbrv", "long_form"))
    return pairs.groupBy("s2_id", "abbrv", "long_form").agg(F.count(F.lit(1)).alias("freq"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, embedding array<float>").json(path)


def read_graph_papers(spark: SparkSession, authors: str, papers: str) -> DataFrame:
    """Author-paper rows from two keyed JSON documents: ``author_id``, ``paper_id``, ``title``, ``abstract``, ``citations``,
    ``position``, ``n_authors``. Papers without a title (empty, ``nan``) go, an abstract ``nan`` is empty, counts that are
    no numbers are 0, a missing position is 1."""
    paper = T.MapType(T.StringType(), T.StructType.fromDDL("features struct<Title:string,Abstract:string,CitedCount:string,AuthorNum:string>, neighbors struct<author:map<string,array<int>>>"))
    author = T.MapType(T.StringType(), T.StructType.fromDDL("neighbors struct<papers:array<string>>"))
    whole = lambda path, kind: spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "v"))
    works = whole(papers, paper).select(F.col("key").alias("paper_id"), F.col("v.features.Title").alias("title"), F.col("v.features.Abstract").alias("abstract"), F.col("v.features.CitedCount").alias("c"), F.col("v.features.AuthorNum").alias("k"), F.col("v.neighbors.author").alias("places"))
    works = works.where(F.coalesce(F.trim("title"), F.lit("")) != "").where(F.lower(F.trim("title")) != "nan")
    rows = whole(authors, author).select(F.col("key").alias("author_id"), F.explode("v.neighbors.papers").alias("paper_id")).join(works, "paper_id")
    number = lambda c: F.coalesce(F.expr(f"try_cast(try_cast({c} as double) as bigint)"), F.lit(0))
    clean = F.when(F.lower(F.trim("abstract")) == "nan", F.lit("")).otherwise(F.coalesce("abstract", F.lit("")))
    place = F.coalesce(F.try_element_at("places", F.col("author_id"))[0], F.lit(1))
    return rows.select("author_id", "paper_id", "title", clean.alias("abstract"), number("c").alias("citations"), place.alias("position"), F.greatest(number("k"), F.size("places").cast("bigint"), F.lit(1)).alias("n_authors"))


def read_session_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per focal author: ``sessionInfo`` of its first file, ``tracked`` and ``feedbackList`` of all its files in order."""
    event = "action:string,nodeId:string,timestamp:bigint"
    feedback = "cardId:string,feedback:array<struct<feedbackItemType:string,feedbackItemId:string,other:string,checked:array<string>,flag:boolean>>"
    kind = f"sessionInfo struct<focalId:string,conditions:map<string,string>,distances:map<string,map<string,double>>>, feedbackList array<struct<{feedback}>>, tracked array<struct<{event}>>"
    rows = spark.read.schema(kind).option("multiLine", "true").json(paths).withColumn("__f", F.input_file_name())
    first = F.min_by("sessionInfo", F.col("__f"))
    grouped = rows.groupBy(F.col("sessionInfo.focalId").alias("focal_id")).agg(first.alias("sessionInfo"), F.collect_list(F.struct("__f", "tracked", "feedbackList")).alias("parts"))
    ordered = F.array_sort("parts", lambda a, b: F.when(a["__f"] < b["__f"], -1).when(a["__f"] > b["__f"], 1).otherwise(0))
    return grouped.withColumn("parts", ordered).select("focal_id", "sessionInfo", F.flatten(F.transform("parts", lambda p: p["tracked"])).alias("tracked"), F.flatten(F.transform("parts", lambda p: p["feedbackList"])).alias("feedbackList"))


def read_npy(spark: SparkSession, vectors: str, labels: str) -> DataFrame:
    """``label``, ``embedding`` from a matrix file and its row labels on the driver's disk; a one-off import."""
    import numpy as np

    matrix, names = np.load(vectors), np.load(labels)
    if len(matrix) != len(names):
        raise ValueError(f"{len(matrix)} rows, {len(names)} labels")
    return spark.createDataFrame([(str(n), [float(x) for x in v]) for n, v in zip(names, matrix)], "label string, embedding array<float>")


def read_stop_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("term_display")).where("term_display <> ''").distinct()


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """``query``, ``AuthorId``: ids of the list literal ``author2`` against those of ``ground_truth_authors``; rows that can't be read go."""
    rows = spark.read.csv(path, header=True, schema="author2 string, ground_truth_authors string")
    queries = F.regexp_extract_all("author2", F.lit(r"([0-9]+[\w\-]*)"), F.lit(1))
    truth = F.transform(F.split("ground_truth_authors", r"\|"), lambda x: F.trim(x))
    listed = rows.select(queries.alias("qs"), truth.alias("ts")).where(F.size("qs") > 0)
    return listed.select(F.explode("qs").alias("query"), "ts").select("query", F.explode("ts").alias("AuthorId")).where("AuthorId <> ''")


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Rows of a query that the database runs; the driver class must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**(properties or {})).load()
