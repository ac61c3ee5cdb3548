"""Term ranking of paper collections: similarity graphs, TextRank, diversified lists and strategy comparison."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholark.constants import SIMILAR_ANY, SIMILAR_LAST, TERMS_KEPT
from scholark.functions.vectors import cosine_distance, euclidean_distance
from scholark.kernels.greedy import diversified
from scholark.kernels.pagerank import pagerank

#: Terms of one collection and label that the dense kernels take, by relevance: the length of a ranked list.
MOST_TERMS = 1000


def top_terms(terms: DataFrame, keys: list[str], by: str = "relevance", n: int = MOST_TERMS) -> DataFrame:
    """The ``n`` terms of highest ``by`` in every group of ``keys`` with ``rank``; ties by the term."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), "term_display"))
    return terms.withColumn("rank", place).where(F.col("rank") <= n)


def without_stop_terms(terms: DataFrame, stop: DataFrame) -> DataFrame:
    """``terms`` without those of the one-column ``stop`` list."""
    return terms.join(stop.toDF("term_display").distinct(), "term_display", "left_anti")


def similarity_graph(terms: DataFrame, keys: list[str], vector: str = "vector", metric: str = "euclidean") -> DataFrame:
    """``keys``, ``term_1`` < ``term_2``, ``similarity``: 1 - min-max of the distances within each group.

    ``terms`` holds at most MOST_TERMS terms a group (see ``top_terms``). A distance of zero is no edge; a single distance
    in a group gives similarity 1.
    """
    measure = euclidean_distance if metric == "euclidean" else cosine_distance
    left = terms.select(*keys, F.col("term_display").alias("term_1"), F.col(vector).alias("v1"))
    right = terms.select(*keys, F.col("term_display").alias("term_2"), F.col(vector).alias("v2"))
    pairs = left.join(right, keys).where("term_1 < term_2").select(*keys, "term_1", "term_2", measure(F.col("v1"), F.col("v2")).alias("distance")).where("distance > 0")
    group = Window.partitionBy(*keys)
    bounded = pairs.withColumn("lo", F.min("distance").over(group)).withColumn("hi", F.max("distance").over(group))
    scaled = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("distance") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return bounded.select(*keys, "term_1", "term_2", (1 - scaled).alias("similarity"))


def text_rank(terms: DataFrame, graph: DataFrame, key: str, n: int = TERMS_KEPT) -> DataFrame:
    """``key``, ``term_display``, ``rank``, ``score``: PageRank of the similarity graph per group.

    A group without edges gives all its terms, in order of relevance, ``n`` aside; one without terms gives nothing.
    """
    kind = terms.schema[key].dataType.simpleString()

    def score(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["relevance", "term_display"], ascending=[False, True], ignore_index=True)
        names = nodes["term_display"].tolist()
        if not names:
            return pd.DataFrame({key: [], "term_display": [], "rank": [], "score": []})
        if not len(edges):
            return pd.DataFrame({key: nodes[key], "term_display": names, "rank": range(1, len(names) + 1), "score": 0.0})
        at = {t: i for i, t in enumerate(names)}
        weights = np.zeros((len(names), len(names)))
        for a, b, s in zip(edges["term_1"], edges["term_2"], edges["similarity"]):
            weights[at[a], at[b]] = weights[at[b], at[a]] = s
        values = pagerank(weights)
        order = sorted(range(len(names)), key=lambda i: (-values[i], names[i]))[:n]
        return pd.DataFrame({key: nodes[key].iloc[0], "term_display": [names[i] for i in order], "rank": range(1, len(order) + 1), "score": values[order]})

    return terms.select(key, "term_display", "relevance").toDF(key, "term_display", "relevance").groupBy(key).cogroup(graph.select(key, "term_1", "term_2", "similarity").toDF(key, "term_1", "term_2", "similarity").groupBy(key)).applyInPandas(score, f"{key} {kind}, term_display string, rank int, score double")


def diversified_terms(terms: DataFrame, graph: DataFrame, key: str, last: float = SIMILAR_LAST, any_before: float | None = SIMILAR_ANY, n: int = TERMS_KEPT) -> DataFrame:
    """``key``, ``term_display``, ``rank``: terms in order of relevance, those too similar to chosen ones passed over."""
    kind = terms.schema[key].dataType.simpleString()

    def choose(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        names = nodes.sort_values(["relevance", "term_display"], ascending=[False, True])["term_display"].tolist()
        known = {frozenset((a, b)): s for a, b, s in zip(edges["term_1"], edges["term_2"], edges["similarity"])}
        chosen = diversified(names, lambda a, b: known.get(frozenset((a, b)), 0.0), last, any_before, n)
        return pd.DataFrame({key: [nodes[key].iloc[0]] * len(chosen), "term_display": chosen, "rank": range(1, len(chosen) + 1)})

    return terms.select(key, "term_display", "relevance").toDF(key, "term_display", "relevance").groupBy(key).cogroup(graph.select(key, "term_1", "term_2", "similarity").toDF(key, "term_1", "term_2", "similarity").groupBy(key)).applyInPandas(choose, f"{key} {kind}, term_display string, rank int")


def clean_list(terms: DataFrame, key: str) -> DataFrame:
    """Ranked terms trimmed, the first of equal ones kept, ranks closed up."""
    trimmed = terms.withColumn("term_display", F.trim("term_display")).groupBy(key, "term_display").agg(F.min("rank").alias("rank"))
    return trimmed.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("rank", "term_display")))


def nearest_terms(focal: DataFrame, candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``keys``, ``term_id``, ``distance``, ``rank``: candidates by their least cosine distance to any focal term of the group.

    With keys the two sides meet by an ordinary join. Without, the focal terms are the stated query set: they are cut into
    blocks of MOST_TERMS, and every candidate meets the blocks one by one.
    """
    asked = focal.select(*keys, F.col("vector").alias("__f"))
    if keys:
        pairs = candidates.join(asked, keys)
    else:
        blocks = max(1, -(-asked.count() // MOST_TERMS))
        cut = asked.withColumn("__b", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
        pairs = candidates.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(cut, "__b")
    least = pairs.groupBy(*keys, "term_id").agg(F.min(cosine_distance(F.col("vector"), F.col("__f"))).alias("distance"))
    window = Window.partitionBy(*keys).orderBy(F.round("distance", 9), "term_id")
    return least.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def compare_strategies(terms: DataFrame, key: str, strategies: dict[str, Callable[[DataFrame], DataFrame]], n: int = TERMS_KEPT) -> DataFrame:
    """``key``, ``rank`` and a column per strategy with the term it puts there."""
    parts = [run(terms).select(key, "rank", "term_display", F.lit(name).alias("strategy")) for name, run in strategies.items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.where(F.col("rank") <= n).groupBy(key, "rank").pivot("strategy", list(strategies)).agg(F.first("term_display"))
