"""Queries on skewed author and paper keys (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholark.operators.skew import heavy_keys, skew_aggregate, skew_join
from scholark.session import cut_lineage
from scholark.sources.tables import table

#: A key with at least this share of all rows is heavy.
HEAVY_SHARE = 0.015


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paper_author_affiliations")
    return heavy_keys(rows, ["AuthorId", "PaperId"], HEAVY_SHARE).select("key_field", "key_id")


def p1_author_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ``AuthorId``: rows, papers, affiliations, and citations and years of the rows whose paper is known."""
    rows = table(spark, sf_dir, "paper_author_affiliations").select("PaperId", "AuthorId", "AffiliationId")
    papers = table(spark, sf_dir, "paper").groupBy("PaperId").agg(F.max("CitationCount").alias("cites"), F.min("Year").alias("year"))
    joined = cut_lineage(skew_join(rows, papers, "PaperId", HEAVY_SHARE, "left", right_heavy=[]))  # each branch of the aggregate reads it
    return skew_aggregate(joined, "AuthorId", sums={"citations": F.coalesce("cites", F.lit(0))}, mins={"first_year": F.col("year")}, maxs={"last_year": F.col("year")}, distinct={"n_papers": F.col("PaperId"), "n_affiliations": F.col("AffiliationId")}, share=HEAVY_SHARE)


def p1_paper_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ``PaperId``: rows, authors, known authors' citations and the best author rank."""
    rows = table(spark, sf_dir, "paper_author_affiliations").select("PaperId", "AuthorId", "AuthorSequenceNumber")
    authors = table(spark, sf_dir, "authors").groupBy("AuthorId").agg(F.max("CitationCount").alias("cites"), F.min("Rank").alias("rank"))
    joined = cut_lineage(skew_join(rows, authors, "AuthorId", HEAVY_SHARE, "left", right_heavy=[]))  # each branch of the aggregate reads it
    return skew_aggregate(joined, "PaperId", sums={"author_citations": F.coalesce("cites", F.lit(0))}, mins={"best_rank": F.col("rank")}, maxs={"last_sequence": F.col("AuthorSequenceNumber")}, distinct={"n_authors": F.col("AuthorId")}, share=HEAVY_SHARE)


QUERIES = {"p1_found": p1_found, "p1_author_profile": p1_author_profile, "p1_paper_profile": p1_paper_profile}

ORACLES = {
    "p1_found": """
        SELECT 'AuthorId' AS key_field, AuthorId AS key_id FROM paper_author_affiliations WHERE AuthorId IS NOT NULL
        GROUP BY AuthorId HAVING count(*) >= 0.015 * (SELECT count(*) FROM paper_author_affiliations)
        UNION ALL
        SELECT 'PaperId', PaperId FROM paper_author_affiliations WHERE PaperId IS NOT NULL
        GROUP BY PaperId HAVING count(*) >= 0.015 * (SELECT count(*) FROM paper_author_affiliations)""",
    "p1_author_profile": """
        WITH p AS (SELECT PaperId, max(CitationCount) AS cites, min(Year) AS yr FROM paper GROUP BY PaperId)
        SELECT a.AuthorId, count(*) AS n_rows, CAST(sum(coalesce(cites, 0)) AS BIGINT) AS citations, min(yr) AS first_year,
               max(yr) AS last_year, count(DISTINCT a.PaperId) AS n_papers, count(DISTINCT a.AffiliationId) AS n_affiliations
        FROM paper_author_affiliations a LEFT JOIN p ON a.PaperId = p.PaperId WHERE a.AuthorId IS NOT NULL GROUP BY a.AuthorId""",
    "p1_paper_profile": """
        WITH u AS (SELECT AuthorId, max(CitationCount) AS cites, min("Rank") AS rk FROM authors GROUP BY AuthorId)
        SELECT a.PaperId, count(*) AS n_rows, CAST(sum(coalesce(cites, 0)) AS BIGINT) AS author_citations, min(rk) AS best_rank,
               max(AuthorSequenceNumber) AS last_sequence, count(DISTINCT a.AuthorId) AS n_authors
        FROM paper_author_affiliations a LEFT JOIN u ON a.AuthorId = u.AuthorId WHERE a.PaperId IS NOT NULL GROUP BY a.PaperId""",
}
