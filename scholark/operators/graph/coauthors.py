"""Co-authorship graphs: edge lists, projection, neighbourhoods, distances and ego splitting."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholark.constants import EDGE_PRUNE, STRONG_COAUTHOR
from scholark.kernels.splitting import components, graph_of, split
from scholark.operators.relational import year_window
from scholark.session import cut_lineage

#: Nodes of an ego net from which on splitting takes minutes; no result depends on it.
MOST_NODES = 400
#: Authors of a paper that one task pairs with others.
AUTHOR_BLOCK = 1000


def min_publications(rows: DataFrame, least: int) -> DataFrame:
    """Rows of authors with at least ``least`` different papers."""
    kept = rows.groupBy("AuthorId").agg(F.countDistinct("PaperId").alias("n")).where(F.col("n") >= least)
    return rows.join(kept.select("AuthorId"), "AuthorId", "left_semi")


def max_authors(edges: DataFrame, most: int) -> DataFrame:
    """Edges of papers with at most ``most`` authors in the (already filtered, distinct) list."""
    kept = edges.groupBy("PaperId").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    return edges.join(kept.select("PaperId"), "PaperId", "left_semi")


def author_paper_edges(rows: DataFrame, years: tuple[int | None, int | None] = (None, None), refs: tuple[int, int] | None = None, min_pubs: int | None = None, most_authors: int | None = None) -> DataFrame:
    """Different (PaperId, AuthorId) after, in this order: reference counts in [min, max), years, publications, authors."""
    if refs:
        rows = rows.where((F.col("ReferenceCount") >= refs[0]) & (F.col("ReferenceCount") < refs[1]))
    rows = year_window(rows, *years)
    if min_pubs:
        rows = min_publications(rows, min_pubs)
    edges = rows.select("PaperId", "AuthorId").distinct()
    return max_authors(edges, most_authors) if most_authors else edges


def project(edges: DataFrame) -> DataFrame:
    """``src`` < ``dst``, ``weight`` = sum of 1 / (authors - 1) over shared papers.

    A paper of more than AUTHOR_BLOCK authors is cut into blocks of authors that meet block by block, so no task pairs all
    of them. Their pairs are the result, quadratic in the authors of a paper; ``max_authors`` is the way to leave such
    papers out.
    """
    sizes = edges.groupBy("PaperId").agg(F.count(F.lit(1)).alias("d")).where("d > 1").withColumn("k", F.ceil(F.col("d") / AUTHOR_BLOCK).cast("int"))
    sized = edges.join(sizes, "PaperId")
    left = sized.select("PaperId", F.col("AuthorId").alias("src"), "d", F.pmod(F.xxhash64("AuthorId"), F.col("k")).cast("int").alias("b"))
    right = sized.select("PaperId", F.col("AuthorId").alias("dst"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("b"))
    pairs = left.join(right, ["PaperId", "b"]).where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.sum(F.lit(1.0) / (F.col("d") - 1)).alias("weight"))


def coauthors_of(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """``AuthorId``, ``coauthor``, ``weight``, ``ratio``: co-authors of the given authors (one column) only.

    Linear in the rows of these authors' papers, whatever the number of authors of a paper; ``ratio`` is the weight by the
    author's own publications.
    """
    asked = edges.join(authors.toDF("AuthorId").distinct(), "AuthorId", "left_semi")
    own = asked.groupBy("AuthorId").agg(F.count(F.lit(1)).alias("n_pubs"))
    known = edges.join(asked.select("PaperId").distinct(), "PaperId", "left_semi")
    sized = known.groupBy("PaperId").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    pairs = asked.join(sized, "PaperId").join(known.withColumnRenamed("AuthorId", "coauthor"), "PaperId").where("AuthorId <> coauthor")
    weights = pairs.groupBy("AuthorId", "coauthor").agg(F.sum(F.lit(1.0) / (F.col("d") - 1)).alias("weight"))
    return weights.join(own, "AuthorId").select("AuthorId", "coauthor", "weight", (F.col("weight") / F.col("n_pubs")).alias("ratio"))


def publications(edges: DataFrame) -> DataFrame:
    """Vertices: ``AuthorId``, ``n_pubs``; authors without co-authors are vertices too."""
    return edges.groupBy("AuthorId").agg(F.count(F.lit(1)).alias("n_pubs"))


def both_ways(graph: DataFrame) -> DataFrame:
    return graph.unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def coauthor_ratios(graph: DataFrame, pubs: DataFrame) -> DataFrame:
    """``AuthorId``, ``coauthor``, ``ratio`` = weight by the author's own publications, for each direction."""
    directed = both_ways(graph).withColumnsRenamed({"src": "AuthorId", "dst": "coauthor"})
    return directed.join(pubs, "AuthorId").select("AuthorId", "coauthor", (F.col("weight") / F.col("n_pubs")).alias("ratio"))


def heavy_edges(graph: DataFrame, min_weight: float = EDGE_PRUNE) -> DataFrame:
    """Edges of more than ``min_weight`` (to 9 digits); those of ``min_weight`` or less go."""
    return graph.withColumn("weight", F.round("weight", 9)).where(F.col("weight") > min_weight).select("src", "dst", "weight")


def strong_coauthors(edges: DataFrame, least: float = STRONG_COAUTHOR) -> DataFrame:
    """``AuthorId``, ``coauthor``: pairs whose weight is at least ``least`` of the author's own publications."""
    return coauthor_ratios(project(edges), publications(edges)).where(F.round("ratio", 9) >= least).select("AuthorId", "coauthor")


def ego_edges(graph: DataFrame) -> DataFrame:
    """``ego``, ``src``, ``dst``, ``weight``: edges between neighbours of each ego, the ego left out.

    Each edge and its ego are a triangle. A triangle is found once, from its node of fewest edges: edges lead from the node of
    fewer edges to that of more, so that a hub's pairs of neighbours are not all looked at.
    """
    degrees = graph.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    sized = graph.join(degrees.select(F.col("id").alias("src"), F.col("d").alias("sd")), "src").join(degrees.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    left, right = (F.struct(F.col(d).alias("d"), F.col(n).alias("id")) for d, n in (("sd", "src"), ("dd", "dst")))
    ways = sized.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), "weight").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("b").alias("place"), "weight")
    ways = cut_lineage(ways)
    second = ways.select("a", F.col("b").alias("c"), F.col("place").alias("place_c"), F.col("weight").alias("ac"))
    wedges = ways.select("a", "b", "place", F.col("weight").alias("ab")).join(second, "a").where(F.col("place") < F.col("place_c")).drop("place", "place_c")
    closed = wedges.join(ways.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("weight").alias("bc")), ["b", "c"])
    edge = lambda ego, x, y, w: F.struct(F.col(ego).alias("ego"), F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.col(w).alias("weight"))
    return closed.select(F.explode(F.array(edge("a", "b", "c", "bc"), edge("b", "a", "c", "ac"), edge("c", "a", "b", "ab"))).alias("e")).select("e.*")


def distances_from(graph: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``id``, ``distance``: steps from the nearest source, up to ``most``; each round joins the frontier only."""
    ways = cut_lineage(both_ways(graph).select("src", "dst").distinct())
    known = cut_lineage(sources.select(F.col(sources.columns[0]).alias("id")).distinct().withColumn("distance", F.lit(0)))
    for step in range(1, most + 1):
        frontier = known.where(F.col("distance") == step - 1).select(F.col("id").alias("src"))
        fresh = ways.join(frontier, "src").select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti").withColumn("distance", F.lit(step))
        fresh = cut_lineage(fresh)
        if not fresh.head(1):
            break
        known = known.unionByName(fresh)
    return known


_PARTS = "node bigint, component int, neighbour bigint, n_nodes int, n_edges int, error string"


def ego_partitions(graph: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """``node``, ``component``, ``neighbour``, ``n_nodes``, ``n_edges``, ``error``: each ego net minus its ego, split.

    Edges of weight ``min_weight`` or less are removed, nodes stay. Nets of more than two nodes and one edge are split by
    edge betweenness, others into components, each net in one task, whatever its size. ``error`` is always null.
    """
    kept = graph.where(F.col("weight") > min_weight)
    nodes = both_ways(kept).select(F.col("src").alias("ego"), F.col("dst").alias("a"))
    return _split_nets(nodes, ego_edges(kept))


def _split_nets(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    alone = nodes.select("ego", "a", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("weight"))
    rows = alone.unionByName(inner.select("ego", F.col("src").alias("a"), F.col("dst").alias("b"), "weight"))
    return rows.groupBy("ego").applyInPandas(_split_ego, _PARTS)


def _split_ego(rows: pd.DataFrame) -> pd.DataFrame:
    linked = rows[rows["b"].notna()]
    nodes = rows.loc[rows["b"].isna(), "a"].tolist()
    graph = graph_of(nodes, zip(linked["a"].astype(int), linked["b"].astype(int), linked["weight"]))
    parts = split(graph)[0] if len(nodes) > 2 and len(linked) > 1 else components(graph)
    ego = int(rows["ego"].iloc[0])
    return pd.DataFrame([(ego, i, n, len(nodes), len(linked), None) for i, part in enumerate(parts) for n in part], columns=["node", "component", "neighbour", "n_nodes", "n_edges", "error"])


def split_egos(graph: DataFrame) -> DataFrame:
    """``ego_partitions``, written once."""
    return cut_lineage(ego_partitions(graph))


def persona_graph(graph: DataFrame, partitions: DataFrame) -> DataFrame:
    """``src_node``, ``src_component``, ``dst_node``, ``dst_component``, ``weight``: each edge between the two personas that
    see each other; edges one side has no component for go."""
    of = partitions.select("node", "component", "neighbour")
    left = of.select(F.col("node").alias("src"), F.col("neighbour").alias("dst"), F.col("component").alias("src_component"))
    right = of.select(F.col("node").alias("dst"), F.col("neighbour").alias("src"), F.col("component").alias("dst_component"))
    return graph.join(left, ["src", "dst"]).join(right, ["src", "dst"]).select(F.col("src").alias("src_node"), "src_component", F.col("dst").alias("dst_node"), "dst_component", "weight")


def overlapping_memberships(clusters: DataFrame) -> DataFrame:
    """``node``, ``clusters`` (array): a node is in every cluster of its personas. ``clusters`` has ``node``, ``cluster``."""
    return clusters.select("node", "cluster").distinct().groupBy("node").agg(F.array_sort(F.collect_list("cluster")).alias("clusters"))


def partition_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``distance``: mean over both directions of the size-weighted least Jaccard distance between clusters.

    ``a`` and ``b`` have ``node`` and ``cluster``.
    """

    def one_way(x: DataFrame, y: DataFrame) -> DataFrame:
        size_x = x.groupBy("cluster").agg(F.count(F.lit(1)).alias("nx"))
        size_y = y.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("ny"))
        shared = x.join(y.withColumnRenamed("cluster", "other"), "node").groupBy("cluster", "other").agg(F.count(F.lit(1)).alias("both"))
        near = shared.join(size_x, "cluster").join(size_y, "other").groupBy("cluster").agg(F.min(1 - F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))).alias("d"))
        return size_x.join(near, "cluster", "left").agg((F.sum(F.col("nx") * F.coalesce("d", F.lit(1.0))) / F.sum("nx")).alias("d"))

    return one_way(a, b).withColumnRenamed("d", "x").crossJoin(one_way(b, a)).select(((F.col("x") + F.col("d")) / 2).alias("distance"))


__all__ = ["author_paper_edges", "both_ways", "coauthor_ratios", "coauthors_of", "distances_from", "ego_edges", "ego_partitions", "heavy_edges", "max_authors", "min_publications", "overlapping_memberships", "partition_distance", "persona_graph", "project", "publications", "split_egos", "strong_coauthors"]
