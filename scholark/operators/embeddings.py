"""Tables of term vectors: kept once, cut to the terms in use, averaged, looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholark.constants import LABELS, SOFTMAX_LEAST
from scholark.functions.vectors import cosine_distance, mean_vectors
from scholark.operators.relational import dense_ids


def first_vectors(rows: DataFrame, term: str, vector: str, order: Column) -> DataFrame:
    """``term``, ``vector``: of several vectors of a term the first in ``order``; null terms go."""
    return rows.where(F.col(term).isNotNull()).groupBy(term).agg(F.min_by(vector, order).alias(vector))


def append_vectors(old: DataFrame, new: DataFrame, term: str, vector: str) -> DataFrame:
    """``old`` and those terms of ``new`` that it lacks, each once: what is there already wins."""
    rows = old.select(term, vector, F.lit(0).alias("__o")).unionByName(new.select(term, vector, F.lit(1).alias("__o")))
    return first_vectors(rows, term, vector, F.col("__o"))


def used_vectors(vectors: DataFrame, terms: DataFrame, term: str) -> DataFrame:
    """``vectors`` of terms in use, with ``embedding_term_id``: their places in order of the term."""
    kept = vectors.join(terms.select(term).distinct(), term, "left_semi")
    return kept.join(dense_ids(kept.select(term), term, "embedding_term_id"), term)


def finalize_embedding_terms(rows: DataFrame, vectors: DataFrame, term: str = "term_normalized") -> DataFrame:
    """``s2_id``, ``label``, ``term``, ``freq``, ``embedding_term_id``: confident non-empty terms of the labels that have a vector.

    A term without a vector has no row: the join is inner, so no place in the table of vectors is missing.
    """
    kept = rows.where(F.col("label").isin(*LABELS) & (F.col("softmax_score") >= SOFTMAX_LEAST) & (F.col(term) != "") & F.col("s2_id").isNotNull())
    counts = kept.groupBy("s2_id", "label", term).agg(F.count(F.lit(1)).alias("freq"))
    return counts.join(used_vectors(vectors, counts, term).select(term, "embedding_term_id"), term)


def unique_term_means(terms: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``embedding``: plain mean over the different terms of each key that have a vector."""
    return mean_vectors(terms.select(*keys, "term_id").distinct().join(vectors, "term_id"), keys, "vector")


def distances_to(papers: DataFrame, vectors: DataFrame, focal: DataFrame) -> DataFrame:
    """``collection_id``, ``PaperId``, ``distance``: cosine distance of listed papers from their collection's focal vector.

    ``papers`` has ``collection_id``, ``PaperId``, ``focal`` has ``collection_id``, ``embedding``; papers without a vector go.
    """
    known = papers.distinct().join(vectors, "PaperId").join(focal.withColumnRenamed("embedding", "__f"), "collection_id")
    return known.select("collection_id", "PaperId", cosine_distance(F.col("vector"), F.col("__f")).alias("distance"))
