"""Recommendation of authors: profiles, distances, exclusions and two-stage selection, for any number of focal authors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholark.constants import CANDIDATE_PAPERS, PERSONA_PAPERS, RANK_POOL, WARD_THRESHOLD
from scholark.functions.vectors import cosine_distance, mean_vectors
from scholark.kernels.ward import ward_labels
from scholark.operators.relational import keep_first
from scholark.session import cut_lineage

#: Focal vectors that are sent to all workers at once.
FOCAL_BLOCK = 10_000

#: The two distances of each condition: the near one picks the pool, the far one reorders it.
CONDITIONS = {
    "simTask": ("task_dist", None),
    "simMethod": ("method_dist", None),
    "simspecter": ("paper_dist", None),
    "simTask_distMethod": ("task_dist", "method_dist"),
    "simMethod_distTask": ("method_dist", "task_dist"),
}


def author_term_scores(authorship: DataFrame, terms: DataFrame, label: str | None, weighted: bool = True) -> DataFrame:
    """``AuthorId``, ``term_id``, ``value``: scores of papers times occurrences of the term in them, summed.

    ``authorship`` has ``PaperId``, ``AuthorId`` and ``score``; unweighted, each (paper, author) counts 1.
    """
    chosen = terms if label is None else terms.where(F.col("label") == label)
    counts = chosen.groupBy("PaperId", "term_id").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("score") if weighted else F.lit(1.0)
    return authorship.join(counts, "PaperId").groupBy("AuthorId", "term_id").agg(F.sum(score * F.col("n")).alias("value"))


def author_term_vectors(scores: DataFrame, vectors: DataFrame) -> DataFrame:
    """``AuthorId``, ``embedding``: sum of value x vector over an author's terms, divided by the number of terms."""
    return mean_vectors(scores.join(vectors, "term_id"), ["AuthorId"], "vector", "value")


def author_paper_vectors(authorship: DataFrame, vectors: DataFrame) -> DataFrame:
    """``AuthorId``, ``embedding``: sum of score x vector over an author's papers, divided by the number of papers."""
    return mean_vectors(authorship.join(vectors, "PaperId"), ["AuthorId"], "vector", "score")


def focal_term_vectors(collections: DataFrame, terms: DataFrame, vectors: DataFrame, label: str) -> DataFrame:
    """``collection_id``, ``embedding``: unweighted mean over the term occurrences of a collection's papers."""
    rows = collections.select("collection_id", "PaperId").join(terms.where(F.col("label") == label).select("PaperId", "term_id"), "PaperId")
    counts = rows.groupBy("collection_id", "term_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = counts.groupBy("collection_id").agg((F.sum("n") / F.count(F.lit(1))).alias("scale"))
    means = mean_vectors(counts.join(vectors, "term_id"), ["collection_id"], "vector", "n")
    return means.join(total, "collection_id").select("collection_id", F.transform("embedding", lambda x: x / F.col("scale")).alias("embedding"))


def focal_paper_vectors(collections: DataFrame, vectors: DataFrame) -> DataFrame:
    """``collection_id``, ``embedding``: mean over papers of relevance x vector."""
    return mean_vectors(collections.join(vectors, "PaperId"), ["collection_id"], "vector", "relevance_score")


def distances(focal: DataFrame, candidates: DataFrame, alias: str) -> DataFrame:
    """``collection_id``, ``AuthorId``, ``alias``: cosine distance of every candidate from each focal vector.

    The focal vectors are the stated query set. Up to FOCAL_BLOCK of them go to all workers; more are cut into blocks of so
    many, and every candidate meets the blocks one by one.
    """
    focal = cut_lineage(focal.select("collection_id", F.col("embedding").alias("__f")))
    blocks = -(-focal.count() // FOCAL_BLOCK)
    if blocks <= 1:
        met = candidates.crossJoin(F.broadcast(focal))
    else:
        cut = focal.withColumn("__b", F.pmod(F.xxhash64("collection_id"), F.lit(blocks)).cast("int"))
        met = candidates.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(cut, "__b")
    return met.select("collection_id", "AuthorId", cosine_distance(F.col("embedding"), F.col("__f")).alias(alias))


def candidate_table(parts: Sequence[DataFrame], paper_counts: DataFrame, vertices: DataFrame | None = None, excluded: DataFrame | None = None, least: int | None = CANDIDATE_PAPERS) -> DataFrame:
    """Distances joined over the union of candidates, then those with enough papers, in the graph and not excluded."""
    table = parts[0]
    for part in parts[1:]:
        table = table.join(part, ["collection_id", "AuthorId"], "full")
    table = table.join(paper_counts, "AuthorId", "left")
    if least:
        table = table.where(F.col("paper_count") >= least)
    if vertices is not None:
        table = table.join(vertices.select("AuthorId").distinct(), "AuthorId", "left_semi")
    if excluded is not None:
        table = table.join(excluded.select("collection_id", "AuthorId").distinct(), ["collection_id", "AuthorId"], "left_anti")
    return table


def select_similar(table: DataFrame, condition: str, pool: int | str = RANK_POOL) -> DataFrame:
    """``table`` with ``rank`` per collection under a condition; ``pool`` may be ``half`` of a collection's candidates."""
    near, far = CONDITIONS[condition]
    order = [F.col(near).asc_nulls_last(), F.col("AuthorId")]
    if pool == "half":
        sizes = table.groupBy("collection_id").agg(F.ceil(F.count(F.lit(1)) / 2).alias("__pool"))
        table, bound = table.join(sizes, "collection_id"), F.col("__pool")
    else:
        bound = F.lit(pool)
    window = Window.partitionBy("collection_id")
    first = table.withColumn("__r", F.row_number().over(window.orderBy(*order))).where(F.col("__r") <= bound)
    last = [F.col(far).desc_nulls_last(), *order] if far else order
    return first.withColumn("rank", F.row_number().over(window.orderBy(*last))).drop("__r", "__pool")


def select_exclusive(table: DataFrame, conditions: Sequence[str], n: int, pool: int | str = RANK_POOL) -> DataFrame:
    """``collection_id``, ``condition``, ``AuthorId``, ``rank``: for each condition in turn its first ``n`` candidates that no
    earlier condition took."""
    taken: DataFrame | None = None
    for condition in conditions:
        ranked = select_similar(table, condition, pool)
        if taken is not None:
            ranked = ranked.join(taken.select("collection_id", "AuthorId"), ["collection_id", "AuthorId"], "left_anti")
        place = F.row_number().over(Window.partitionBy("collection_id").orderBy("rank"))
        chosen = ranked.withColumn("rank", place).where(F.col("rank") <= n).select("collection_id", F.lit(condition).alias("condition"), "AuthorId", "rank")
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken


def ward_personas(papers: DataFrame, threshold: float = WARD_THRESHOLD, least: int = PERSONA_PAPERS, keep_all: bool = False) -> DataFrame:
    """``AuthorId``, ``persona_id``, ``PaperId``: papers of each author clustered by their vectors.

    ``papers`` has ``AuthorId``, ``PaperId``, ``Rank`` and ``vector``. Clusters under ``least`` papers are left out; the
    rest are lettered by their best rank. With ``keep_all`` an author with too few papers, or none in a large enough
    cluster, becomes one persona of all papers. The kernel holds an author's vectors and no matrix of their distances, so
    authors of very many papers are clustered like the others.
    """

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("PaperId", ignore_index=True)
        if keep_all and len(rows) < least:
            label = np.zeros(len(rows), dtype=int)
        else:
            label = ward_labels(np.stack(rows["vector"].to_list()), threshold)
        rows = rows.assign(label=label)
        large = rows.groupby("label").filter(lambda g: len(g) >= least)
        if not len(large):
            if not keep_all:
                return rows.assign(persona_id="").loc[[], ["AuthorId", "persona_id", "PaperId"]]
            large = rows.assign(label=0)
        best = large.groupby("label")["Rank"].min().sort_values(kind="stable")
        letter = {c: i for i, c in enumerate(best.index)}
        name = large["AuthorId"].astype(str) + "-" + large["label"].map(lambda c: _letters(letter[c]))
        return pd.DataFrame({"AuthorId": large["AuthorId"], "persona_id": name, "PaperId": large["PaperId"]})

    return papers.select("AuthorId", "PaperId", "Rank", "vector").groupBy("AuthorId").applyInPandas(cluster, "AuthorId bigint, persona_id string, PaperId bigint")


def _letters(place: int) -> str:
    text = ""
    place += 1
    while place:
        place, rest = divmod(place - 1, 26)
        text = chr(65 + rest) + text
    return text


def evaluation(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row ``hit_at_k``, ``mrr``, ``n_queries``: a query without a hit counts 0.

    ``ranked`` has ``query``, ``AuthorId`` and ``rank``, ``truth`` has ``query`` and ``AuthorId``; null truths don't count.
    """
    wanted = truth.dropna().distinct()
    best = wanted.join(ranked, ["query", "AuthorId"]).groupBy("query").agg(F.min("rank").alias("best"))
    asked = wanted.select("query").distinct().join(best, "query", "left")
    return asked.agg(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias("hit_at_k"), F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


def collection_of_authors(scored: DataFrame, authors: DataFrame) -> DataFrame:
    """``collection_id``, ``PaperId``, ``relevance_score``: papers of each collection of authors (``collection_id``,
    ``AuthorId``) with the mean of their scores there."""
    return scored.join(authors, "AuthorId").groupBy("collection_id", "PaperId").agg(F.avg("score").alias("relevance_score"))


def deduplicated(collections: DataFrame, titles: DataFrame) -> DataFrame:
    """A collection's papers with one paper a title, by best rank of ``titles`` (``PaperId``, ``key``, ``order``)."""
    return keep_first(collections.join(titles, "PaperId"), ["collection_id", "key"], [F.col("order").asc_nulls_last(), F.col("PaperId")]).drop("key", "order")
