"""Scores and scalings on columns. The bounds of a scaling are one row or a window, never a driver value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholark.constants import MIDDLE_AUTHOR, SCALE_HIGH, SCALE_LOW


def minmax(value: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0), constant: float | None = None) -> Column:
    """``value`` scaled from [low, high] to ``to``; a constant population gives the lower end (or ``constant``)."""
    flat = F.lit(to[0] if constant is None else constant)
    return F.when(value.isNull(), F.lit(None)).when(high == low, flat).otherwise(F.lit(to[0]) + (value - low) / (high - low) * F.lit(to[1] - to[0]))


def rank_scaled(papers: DataFrame, rank: str = "Rank") -> DataFrame:
    """``rank_scaled`` = 1 - min-max of the rank over all rows given, so it must come before any year filter."""
    bounds = papers.agg(F.min(rank).cast("double").alias("__lo"), F.max(rank).cast("double").alias("__hi"))
    scaled = papers.crossJoin(F.broadcast(bounds))
    return scaled.withColumn("rank_scaled", F.lit(1.0) - minmax(F.col(rank).cast("double"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def author_positions(authorship: DataFrame, paper: str = "PaperId", sequence: str = "seq") -> DataFrame:
    """``num_authors`` (the last sequence number of the paper) and ``is_last_author``, over all authors of each paper."""
    last = authorship.groupBy(paper).agg(F.max(sequence).alias("num_authors"))
    return authorship.join(last, paper).withColumn("is_last_author", F.col(sequence) == F.col("num_authors"))


def position_weight(sequence: Column, is_last: Column) -> Column:
    return F.when((sequence == 1) | is_last, F.lit(1.0)).otherwise(F.lit(MIDDLE_AUTHOR))


def author_paper_scores(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``score`` = position weight x min-max of ``rank_scaled`` to [0.5, 1].

    ``rows`` has ``seq``, ``is_last_author`` and ``rank_scaled``. The scaling is fitted on all rows given, or on each
    group of ``scope`` (a collection of papers); a constant population gives 0.5, nulls are passed on.
    """
    value = F.col("rank_scaled")
    if scope:
        bounds = rows.groupBy(*scope).agg(F.min("rank_scaled").alias("__lo"), F.max("rank_scaled").alias("__hi"))
        bounded = rows.join(bounds, scope)
    else:
        bounds = rows.agg(F.min("rank_scaled").alias("__lo"), F.max("rank_scaled").alias("__hi"))
        bounded = rows.crossJoin(F.broadcast(bounds))
    scaled = minmax(value, F.col("__lo"), F.col("__hi"), (SCALE_LOW, SCALE_HIGH))
    return bounded.withColumn("score", position_weight(F.col("seq"), F.col("is_last_author")) * scaled).drop("__lo", "__hi")


def tfidf(tf: Column, df: Column, n: Column) -> Column:
    """ln(tf + 1) * ln(n / df); 0 where tf is 0 or null."""
    return F.when(F.coalesce(tf, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.log1p(tf) * F.log(n / df))


def js_divergence(p: DataFrame, q: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``divergence``: Jensen-Shannon divergence (natural log) of two weighted lists, keys missing on one side as 0."""
    left = p.groupBy(key).agg(F.sum(value).cast("double").alias("a"))
    right = q.groupBy(key).agg(F.sum(value).cast("double").alias("b"))
    sums = left.agg(F.sum("a").alias("sa")).crossJoin(F.broadcast(right.agg(F.sum("b").alias("sb"))))
    both = left.join(right, key, "full").crossJoin(F.broadcast(sums))
    a, b = F.coalesce("a", F.lit(0.0)) / F.col("sa"), F.coalesce("b", F.lit(0.0)) / F.col("sb")
    half = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))
    both = both.select(a.alias("x"), b.alias("y")).withColumn("m", (F.col("x") + F.col("y")) / 2)
    return both.agg((F.sum(half(F.col("x"), F.col("m"))) / 2 + F.sum(half(F.col("y"), F.col("m"))) / 2).alias("divergence"))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; 0 where either is empty or null."""
    union = F.size(F.array_union(a, b))
    return F.when((F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def percent_within(counts: DataFrame, group: str, count: str = "n") -> DataFrame:
    """``percent`` of each row's count within its group."""
    return counts.withColumn("percent", F.col(count) / F.sum(count).over(Window.partitionBy(group)) * 100)
