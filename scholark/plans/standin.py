"""Domain views over the star-schema tables, used by the queries that need papers, terms, citations or clicks there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholark.functions.scores import author_positions, rank_scaled
from scholark.sources.tables import table

LABEL_OF = {"ECONOMY": "Task", "LARGE": "Method", "MEDIUM": "Material", "PROMO": "Metric", "SMALL": "Generic", "STANDARD": "OtherScientificTerm"}


def papers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("PaperId"), F.year("o_orderdate").cast("bigint").alias("Year"), F.col("o_totalprice").alias("Rank"), F.col("o_orderpriority").alias("DocType"), F.col("o_custkey").alias("VenueId"))


def authorship(spark: SparkSession, d: str) -> DataFrame:
    """Different (paper, author) pairs with the author's first place."""
    line = table(spark, d, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("PaperId"), F.col("l_suppkey").alias("AuthorId")).agg(F.min("l_linenumber").cast("bigint").alias("seq"))


def term_rows(spark: SparkSession, d: str) -> DataFrame:
    """Term occurrences: ``PaperId``, ``term_id``, ``term_display``, ``label``, ``softmax_score``."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    labels = F.create_map(*[x for k, v in LABEL_OF.items() for x in (F.lit(k), F.lit(v))])
    joined = line.select("l_orderkey", "l_partkey", "l_quantity").join(part.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("PaperId"), F.col("l_partkey").alias("term_id"), F.col("p_name").alias("term_display"), labels[F.col("p_type")].alias("label"), (F.col("l_quantity") / 50.0).alias("softmax_score"))


def term_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``term_id``, ``vector``: the vector of each term, by its id modulo the number of vectors."""
    return _vectors(spark, d, table(spark, d, "part").select(F.col("p_partkey").alias("term_id")), "term_id")


def paper_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, table(spark, d, "orders").select(F.col("o_orderkey").alias("PaperId")), "PaperId")


def _vectors(spark: SparkSession, d: str, keys: DataFrame, key: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    count = vectors.agg(F.count(F.lit(1)).alias("n"))
    return keys.crossJoin(F.broadcast(count)).withColumn("vec_id", F.col(key) % F.col("n")).join(vectors, "vec_id").select(key, "vector")


def scored_authorship(spark: SparkSession, d: str) -> DataFrame:
    """Authorship with positions and the corpus-wide ``rank_scaled`` of each paper."""
    ranked = rank_scaled(papers(spark, d)).select("PaperId", "Year", "rank_scaled")
    return author_positions(authorship(spark, d)).join(ranked, "PaperId")


# The same views in SQL.
SQL_PAPERS = "papers AS (SELECT o_orderkey AS PaperId, CAST(year(o_orderdate) AS BIGINT) AS Yr, o_totalprice AS Rnk, o_orderpriority AS DocType, o_custkey AS VenueId FROM orders)"
SQL_AUTHORSHIP = "paa AS (SELECT l_orderkey AS PaperId, l_suppkey AS AuthorId, CAST(min(l_linenumber) AS BIGINT) AS seq FROM lineitem GROUP BY ALL)"
SQL_TERMS = """terms AS (SELECT l_orderkey AS PaperId, l_partkey AS term_id, p_name AS term_display,
    CASE p_type WHEN 'ECONOMY' THEN 'Task' WHEN 'LARGE' THEN 'Method' WHEN 'MEDIUM' THEN 'Material' WHEN 'PROMO' THEN 'Metric' WHEN 'SMALL' THEN 'Generic' ELSE 'OtherScientificTerm' END AS label,
    l_quantity / 50.0 AS softmax_score FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SQL_RANKED = "ranked AS (SELECT PaperId, Yr, 1 - (Rnk - (SELECT min(Rnk) FROM papers)) / (SELECT max(Rnk) - min(Rnk) FROM papers) AS rank_scaled FROM papers)"
SQL_POSITIONS = "pos AS (SELECT paa.*, max(seq) OVER (PARTITION BY PaperId) AS num_authors FROM paa)"
SQL_SCORED = "scored AS (SELECT pos.*, Yr, rank_scaled, CASE WHEN seq = 1 OR seq = num_authors THEN 1.0 ELSE 0.75 END AS mult FROM pos JOIN ranked USING (PaperId))"
