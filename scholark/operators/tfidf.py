"""Author-by-term tf-idf with smoothed idf and unit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholark.constants import GENERIC_TAILS
from scholark.functions.text import strip_generic_tail

def author_tfidf(rows: DataFrame, author: str = "AuthorId", term: str = "term_id") -> DataFrame:
    """``tfidf_score`` = tf (ln((1 + n) / (1 + df)) + 1), each author's row of unit length; tf is the number of rows.

    Term ids below 10 have no score but their authors count in n.
    """
    tf = rows.groupBy(author, term).agg(F.count(F.lit(1)).alias("tf"))
    n = rows.agg(F.countDistinct(author).alias("n"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, term).crossJoin(F.broadcast(n)).where(F.col(term) >= 10).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("tfidf_score", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(author)))).select(author, term, "tfidf_score")


def _papers(rows: DataFrame) -> DataFrame:
    return rows.select("AuthorId", "PaperId", "term_id").distinct()


def frequency_cutoff(rows: DataFrame, least: int, term: str = "term_id") -> DataFrame:
    """Rows of terms with at least ``least`` rows."""
    kept = rows.groupBy(term).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(kept.select(term), term, "left_semi")


def _merged(rows: DataFrame, vocabulary: DataFrame, tails: Sequence[str]) -> DataFrame:
    """Terms that lose a generic last word become the term that is left, if the vocabulary has it; others stay."""
    terms = vocabulary.select("term_id", "term_display").distinct()
    stripped = terms.select("term_id", strip_generic_tail(F.col("term_display"), tails).alias("stem"))
    targets = terms.groupBy(F.col("term_display").alias("stem")).agg(F.min("term_id").alias("to_id"))
    mapping = stripped.join(targets, "stem").groupBy("term_id").agg(F.min("to_id").alias("to_id"))
    return rows.join(mapping, "term_id", "left").withColumn("term_id", F.coalesce("to_id", "term_id")).drop("to_id")


def strategy_occurrences(rows: DataFrame) -> DataFrame:
    return author_tfidf(rows)


def strategy_papers(rows: DataFrame) -> DataFrame:
    return author_tfidf(_papers(rows))


def strategy_cutoff(rows: DataFrame) -> DataFrame:
    return author_tfidf(frequency_cutoff(_papers(rows), 2))


def strategy_merged(rows: DataFrame, tails: Sequence[str] = GENERIC_TAILS) -> DataFrame:
    """As ``strategy_papers``, with terms that end in generic words merged into those without; ``tails`` go in their order."""
    return author_tfidf(_merged(_papers(rows), rows, tails))


def strategy_cutoff_merged(rows: DataFrame, tails: Sequence[str] = GENERIC_TAILS) -> DataFrame:
    return author_tfidf(_merged(frequency_cutoff(_papers(rows), 2), rows, tails))


def inverse_frequencies(rows: DataFrame, author: str = "AuthorId", term: str = "term_id") -> DataFrame:
    """``term``, ``idf``: the smoothed inverse author frequency of ``author_tfidf``, to be stored."""
    n = rows.agg(F.countDistinct(author).alias("n"))
    df = rows.groupBy(term).agg(F.countDistinct(author).alias("df"))
    return df.crossJoin(F.broadcast(n)).select(term, (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def collection_tfidf(terms: DataFrame, idf: DataFrame, n: int, term: str = "term_id") -> DataFrame:
    """``collection_id``, ``term``, ``tfidf_score``, ``rank``: the ``n`` best of a collection's different terms by stored idf, each
    counting once, collections being of unit length; terms without a stored idf go."""
    kept = terms.select("collection_id", term).distinct().join(idf, term)
    scored = kept.withColumn("tfidf_score", F.col("idf") / F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("collection_id"))))
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc(F.round("tfidf_score", 9)), term))
    return scored.select("collection_id", term, "tfidf_score", place.alias("rank")).where(F.col("rank") <= n)
