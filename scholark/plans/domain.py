"""Views over the bibliographic tables: one row a paper, an authorship, a term occurrence; with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholark.functions.scores import author_positions, rank_scaled
from scholark.plans.standin import _vectors
from scholark.sources.tables import table


def papers(spark: SparkSession, d: str) -> DataFrame:
    """``PaperId``, ``Year``, ``Rank``: copies of rows taken once."""
    return table(spark, d, "paper").groupBy("PaperId").agg(F.min("Year").cast("bigint").alias("Year"), F.min("Rank").cast("double").alias("Rank"))


def authorship(spark: SparkSession, d: str) -> DataFrame:
    """Different (paper, known author) pairs with the author's first place."""
    rows = table(spark, d, "paper_author_affiliations").where("AuthorId is not null and PaperId is not null")
    return rows.groupBy("PaperId", "AuthorId").agg(F.min("AuthorSequenceNumber").cast("bigint").alias("seq"))


def term_rows(spark: SparkSession, d: str) -> DataFrame:
    """Term occurrences by paper: ``PaperId``, ``term_id`` (a number made of the term), ``term_display``, ``label``, ``softmax_score``."""
    ids = table(spark, d, "paper").select("PaperId", F.col("corpus_paper_id").alias("s2_id")).where("s2_id is not null").distinct()
    terms = table(spark, d, "df_ner").where("label is not null and term_normalized is not null and s2_id is not null").distinct()
    number = F.conv(F.substring(F.md5("term_normalized"), 1, 12), 16, 10).cast("bigint")
    return terms.join(ids, "s2_id").select("PaperId", number.alias("term_id"), F.col("term_normalized").alias("term_display"), "label", "softmax_score")


def term_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``term_id``, ``vector``: the vector of each term, by its number modulo the number of vectors."""
    return _vectors(spark, d, term_rows(spark, d).select("term_id").distinct(), "term_id")


def paper_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, papers(spark, d).select("PaperId"), "PaperId")


def scored_authorship(spark: SparkSession, d: str) -> DataFrame:
    """Authorship with positions and the corpus-wide ``rank_scaled`` of each paper."""
    ranked = rank_scaled(papers(spark, d)).select("PaperId", "Year", "rank_scaled")
    return author_positions(authorship(spark, d)).join(ranked, "PaperId")


# The same views in SQL.
SQL_PAPERS = 'papers AS (SELECT PaperId, CAST(min("Year") AS BIGINT) AS Yr, CAST(min("Rank") AS DOUBLE) AS Rnk FROM paper GROUP BY 1)'
SQL_AUTHORSHIP = "paa AS (SELECT PaperId, AuthorId, CAST(min(AuthorSequenceNumber) AS BIGINT) AS seq FROM paper_author_affiliations WHERE AuthorId IS NOT NULL AND PaperId IS NOT NULL GROUP BY ALL)"
SQL_TERMS = """terms AS (SELECT PaperId, CAST(('0x' || substr(md5(term_normalized), 1, 12)) AS BIGINT) AS term_id, term_normalized AS term_display, label, softmax_score
    FROM (SELECT DISTINCT * FROM df_ner WHERE label IS NOT NULL AND term_normalized IS NOT NULL AND s2_id IS NOT NULL) t
    JOIN (SELECT DISTINCT PaperId, corpus_paper_id FROM paper WHERE corpus_paper_id IS NOT NULL) i ON t.s2_id = i.corpus_paper_id)"""
SQL_RANKED = "ranked AS (SELECT PaperId, Yr, 1 - (Rnk - (SELECT min(Rnk) FROM papers)) / (SELECT max(Rnk) - min(Rnk) FROM papers) AS rank_scaled FROM papers)"
SQL_POSITIONS = "pos AS (SELECT paa.*, max(seq) OVER (PARTITION BY PaperId) AS num_authors FROM paa)"
SQL_SCORED = "scored AS (SELECT pos.*, Yr, rank_scaled, CASE WHEN seq = 1 OR seq = num_authors THEN 1.0 ELSE 0.75 END AS mult FROM pos JOIN ranked USING (PaperId))"
