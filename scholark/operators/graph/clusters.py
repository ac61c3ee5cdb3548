"""Clusters of authors on the co-author graph: subgraphs, centrality, relevance of papers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholark.functions.scores import position_weight
from scholark.kernels.pagerank import pagerank_of_edges
from scholark.session import cut_lineage, release

#: Members and edges of a cluster that one task ranks at most.
TASK_ROWS = 500_000


def induced_subgraphs(graph: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster``, ``src``, ``dst``, ``weight``: edges with both ends in one cluster. ``clusters`` has ``cluster``, ``AuthorId``."""
    left = clusters.select("cluster", F.col("AuthorId").alias("src")).distinct()
    right = clusters.select("cluster", F.col("AuthorId").alias("dst")).distinct()
    return graph.join(left, "src").join(right, ["cluster", "dst"]).select("cluster", "src", "dst", "weight")


def cluster_pagerank(graph: DataFrame, clusters: DataFrame, most: int = TASK_ROWS) -> DataFrame:
    """``cluster``, ``AuthorId``, ``pagerank``: weighted PageRank within each cluster's subgraph, members without edges included.

    One task ranks a cluster of up to ``most`` members and edges by its edges; larger ones are ranked by joins over the cluster
    of machines, with the same steps and the same end.
    """
    members = cut_lineage(clusters.select("cluster", F.col("AuthorId").alias("src")).dropna().distinct())
    edges = cut_lineage(induced_subgraphs(graph, clusters).select("cluster", "src", F.col("dst").cast("bigint").alias("dst"), "weight").where("weight > 0"))
    rows = members.select("cluster", "src", F.lit(None).cast("bigint").alias("dst"), F.lit(0.0).alias("weight")).unionByName(edges)
    kind = clusters.schema["cluster"].dataType.simpleString()
    large = cut_lineage(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select("cluster"))

    def rank(block: pd.DataFrame) -> pd.DataFrame:
        edges = block[block["dst"].notna()]
        nodes = np.sort(block.loc[block["dst"].isna(), "src"].to_numpy())
        i, j, w = np.searchsorted(nodes, edges["src"]), np.searchsorted(nodes, edges["dst"].astype("int64")), edges["weight"].to_numpy()
        apart = i != j
        scores = pagerank_of_edges(len(nodes), np.r_[i, j[apart]], np.r_[j, i[apart]], np.r_[w, w[apart]])
        return pd.DataFrame({"cluster": block["cluster"].iloc[0], "AuthorId": nodes, "pagerank": scores})

    ranked = rows.join(large, "cluster", "left_anti").groupBy("cluster").applyInPandas(rank, f"cluster {kind}, AuthorId bigint, pagerank double")
    if not large.head(1):
        return ranked
    few = members.join(large, "cluster", "left_semi")
    return ranked.unionByName(_joined_pagerank(few, edges.join(large, "cluster", "left_semi")))


def _joined_pagerank(members: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """``pagerank_of_edges`` of all clusters at once by joins; a cluster whose scores have settled is left as it is."""
    ways = edges.unionByName(edges.where("src <> dst").select("cluster", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = ways.groupBy("cluster", "src").agg(F.sum("weight").alias("out"))
    ways = cut_lineage(ways.join(out, ["cluster", "src"]).select("cluster", "src", "dst", (F.col("weight") / F.col("out")).alias("step")))
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("n"))
    loose = members.join(out.select("cluster", "src", F.lit(False).alias("loose")), ["cluster", "src"], "left").withColumn("loose", F.coalesce("loose", F.lit(True)))
    now = cut_lineage(loose.join(n, "cluster").withColumn("score", 1 / F.col("n")))
    settled = []
    for _ in range(rounds):
        lost = now.groupBy("cluster").agg(F.sum(F.when(F.col("loose"), F.col("score")).otherwise(0.0)).alias("lost"))
        given = now.select("cluster", "src", "score").join(ways, ["cluster", "src"]).groupBy("cluster", F.col("dst").alias("src")).agg(F.sum(F.col("score") * F.col("step")).alias("given"))
        fresh = now.join(given, ["cluster", "src"], "left").join(lost, "cluster")
        score = damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - damping) / F.col("n")
        fresh = cut_lineage(fresh.select("cluster", "src", "loose", "n", F.col("score").alias("was"), score.alias("score")))
        moved = cut_lineage(fresh.groupBy("cluster").agg((F.sum(F.abs(F.col("score") - F.col("was"))) < F.max("n") * tolerance).alias("still")))
        settled.append(fresh.join(moved.where("still"), "cluster", "left_semi"))
        release(now)
        now = fresh.join(moved.where("not still"), "cluster", "left_semi").drop("was")
        if not moved.where("not still").head(1):
            break
        now = cut_lineage(now)
    else:
        settled.append(now)
    parts = [p.select("cluster", F.col("src").alias("AuthorId"), F.col("score").alias("pagerank")) for p in settled]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def cluster_papers(authorship: DataFrame, ranks: DataFrame) -> DataFrame:
    """``cluster``, ``PaperId``, ``relevance``: papers of at least two authors of a cluster, with the mean over these of position
    weight times ``pagerank``. ``authorship`` has ``PaperId``, ``AuthorId``, ``seq``, ``is_last_author`` of all authors."""
    rows = authorship.join(ranks, "AuthorId").withColumn("w", position_weight(F.col("seq"), F.col("is_last_author")) * F.col("pagerank"))
    found = rows.groupBy("cluster", "PaperId").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("relevance"))
    return found.where("n > 1").drop("n")


def focal_scores(ranks: DataFrame, focal: DataFrame) -> DataFrame:
    """``cluster``, ``score``: (n - place) / n of the first focal author (one column) in a cluster's order, 0 without one."""
    order = Window.partitionBy("cluster").orderBy(F.desc("pagerank"), "AuthorId")
    placed = ranks.withColumn("place", F.row_number().over(order) - 1)
    sizes = ranks.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    best = placed.join(focal.toDF("AuthorId").distinct(), "AuthorId", "left_semi").groupBy("cluster").agg(F.min("place").alias("place"))
    return sizes.join(best, "cluster", "left").select("cluster", F.coalesce((F.col("n") - F.col("place")) / F.col("n"), F.lit(0.0)).alias("score"))


def cluster_cards(ranks: DataFrame, papers: DataFrame, focal: DataFrame, names: DataFrame, n: int = 5) -> DataFrame:
    """``cluster``, ``n_authors``, ``n_papers``, ``score``, ``authors`` (the ``n`` most central by name): clusters of two papers or more."""
    order = Window.partitionBy("cluster").orderBy(F.desc("pagerank"), "AuthorId")
    placed = ranks.withColumn("place", F.row_number().over(order)).join(names.select("AuthorId", "name"), "AuthorId", "left")
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= n, F.struct("place", "name")))), lambda x: x["name"])
    people = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_authors"), top.alias("authors"))
    works = papers.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_papers")).where("n_papers >= 2")
    return people.join(works, "cluster").join(focal_scores(ranks, focal), "cluster").select("cluster", "n_authors", "n_papers", "score", "authors")
