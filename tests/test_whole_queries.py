"""Queries without SQL against brute force over whole small tables."""

import numpy as np
import pytest

from scholark.kernels import splitting
from scholark.kernels.greedy import diversified
from scholark.kernels.pagerank import pagerank
from scholark.operators import ranking
from scholark.operators.graph import coauthors as co
from scholark.plans import graph_queries as gq
from scholark.plans import recommend
from scholark.plans import standin
from scholark.sources.tables import table

SF = "/root/testdata/sf0.001"


def brute_similarity(x):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    apart = d[np.triu_indices(len(x), 1)]
    apart = apart[apart > 0]
    s = np.where(d > 0, 1 - (d - apart.min()) / (apart.max() - apart.min()), 0.0)
    return s


@pytest.fixture(scope="module")
def terms(spark):
    groups = {}
    for r in table(spark, SF, "embeddings").select("label", "vec_id", "embedding").collect():
        groups.setdefault(r.label, []).append((-(r.vec_id * 7919 % 1009), str(r.vec_id), np.array(r.embedding, dtype=float)))
    return {k: sorted(v, key=lambda r: r[:2])[: ranking.MOST_TERMS] for k, v in groups.items()}


def test_textrank_ranks_every_term(spark, terms):
    got = {}
    for r in gq.textrank(spark, SF).collect():
        got.setdefault(r.label, {})[r.rank] = r.score
    assert set(got) == set(terms) and max(map(len, terms.values())) > 25
    for label, rows in terms.items():
        scores = np.sort(pagerank(brute_similarity(np.stack([r[2] for r in rows]))))[::-1]
        assert [got[label][i] for i in sorted(got[label])] == pytest.approx(scores[: len(got[label])], rel=1e-6)


def test_diversified_terms_see_every_term(spark, terms):
    got = {}
    for r in sorted(gq.diversified_terms(spark, SF).collect(), key=lambda r: r.rank):
        got.setdefault(r.label, []).append(r.term_display)
    for label, rows in terms.items():
        s, names = brute_similarity(np.stack([r[2] for r in rows])), [r[1] for r in rows]
        at = {t: i for i, t in enumerate(names)}
        assert got[label] == diversified(names, lambda a, b: s[at[a], at[b]], 0.6)


def test_ward_sees_every_paper(spark, monkeypatch):
    given = []
    monkeypatch.setattr(recommend, "ward_personas", lambda papers, *_: given.append(papers))
    gq.ward_personas(spark, SF)
    vectors = standin.paper_vectors(spark, SF).select("PaperId").distinct()
    want = {(r.AuthorId, r.PaperId) for r in standin.authorship(spark, SF).join(vectors, "PaperId").collect()}
    assert {(r.AuthorId, r.PaperId) for r in given[0].collect()} == want


def test_large_ego_nets_are_split(spark, monkeypatch):
    hub = [(0, i, 1.0) for i in range(1, co.MOST_NODES + 2)]
    inner = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.04)]
    graph = spark.createDataFrame(hub + inner, "src long, dst long, weight double")
    monkeypatch.setattr(gq, "_graph", lambda *_: graph)
    rows = [r for r in gq.ego_girvan_newman(spark, SF).collect() if r.node == 0]
    parts = {}
    for r in rows:
        parts.setdefault(r.component, set()).add(r.neighbour)
    want, _ = splitting.split(splitting.graph_of(range(1, 7), inner[:6]))
    assert {r.error for r in rows} == {None} and sorted(map(sorted, parts.values())) == sorted(map(sorted, want))


def test_pagerank_of_clusters_is_never_dense(spark):
    """One cluster of 30,000 authors, whose dense matrix would take 7.2 GB, in one task and by joins."""
    import pandas as pd

    from scholark.kernels.pagerank import pagerank_of_edges
    from scholark.operators.graph import clusters as cl

    rng = np.random.default_rng(3)
    n = 30_000
    src, dst = np.arange(0, n - 3), np.arange(0, n - 3) // 2
    w = rng.random(n - 3) + 0.1
    keep = src > dst
    src, dst, w = src[keep], dst[keep], w[keep]
    graph = spark.createDataFrame(pd.DataFrame({"src": dst, "dst": src, "weight": w}))
    clusters = spark.createDataFrame(pd.DataFrame({"cluster": np.where(np.arange(n) < 20, 7, 1), "AuthorId": np.arange(n)})).unionByName(spark.createDataFrame([(2, a) for a in range(n, n + 5)], "cluster long, AuthorId long"))
    found = [{(r.cluster, r.AuthorId): r.pagerank for r in cl.cluster_pagerank(graph, clusters, most=most).collect()} for most in (500_000, 100)]
    assert len(found[0]) == n + 5 and found[0].keys() == found[1].keys()
    assert all(abs(v - found[1][k]) < 1e-12 for k, v in found[0].items())
    inside = (src < 20) & (dst < 20)
    i, j = np.r_[src[inside], dst[inside]], np.r_[dst[inside], src[inside]]
    m = np.zeros((20, 20))
    m[i, j] = np.r_[w[inside], w[inside]]
    assert np.allclose(pagerank(m), [found[0][7, a] for a in range(20)], atol=1e-12)
    assert np.allclose(pagerank_of_edges(20, i, j, np.r_[w[inside], w[inside]]), pagerank(m), atol=1e-12)


def test_a_hub_costs_its_edges_not_their_pairs(spark):
    """All triangles beside a hub of 60,000 neighbours, whose 3.6 billion pairs can't be looked at within the time."""
    import time

    hub = spark.range(1, 60_001).selectExpr("0L AS src", "id AS dst", "1.0D AS weight")
    rest = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25)], "src long, dst long, weight double")
    began = time.time()
    found = sorted(map(tuple, co.ego_edges(hub.unionByName(rest)).collect()))
    assert found == [(0, 1, 2, 0.5), (0, 2, 3, 0.25), (1, 0, 2, 1.0), (2, 0, 1, 1.0), (2, 0, 3, 1.0), (3, 0, 2, 1.0)]
    assert time.time() - began < 90
