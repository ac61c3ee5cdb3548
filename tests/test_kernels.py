import itertools
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scholark.kernels import splitting
from scholark.kernels.greedy import diversified
from scholark.kernels.pagerank import pagerank
from scholark.kernels.splitting import components, edge_betweenness, graph_of, modularity, split
from scholark.kernels.ward import ward_labels
from scholark.operators.graph import coauthors as co

EDGES = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.sampled_from([1.0, 2.0, 3.5])), max_size=14).map(lambda es: {(min(a, b), max(a, b)): w for a, b, w in es if a != b})


def brute_betweenness(graph):
    total = {(a, b): 0.0 for a in graph for b in graph[a] if a < b}
    for s, t in itertools.permutations(graph, 2):
        paths, best = [], math.inf

        def walk(node, seen, length, path):
            nonlocal best
            if node == t:
                paths.append((length, path))
                best = min(best, length)
                return
            for other, w in graph[node].items():
                if other not in seen:
                    walk(other, seen | {other}, length + w, [*path, (min(node, other), max(node, other))])

        walk(s, {s}, 0.0, [])
        short = [p for n, p in paths if n == best]
        for p in short:
            for e in p:
                total[e] += 1 / len(short)
    return total


@settings(max_examples=40, deadline=None)
@given(EDGES)
def test_betweenness(edges):
    graph = graph_of(range(7), [(a, b, w) for (a, b), w in edges.items()])
    got, want = edge_betweenness(graph), brute_betweenness(graph)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in got)


@settings(max_examples=40, deadline=None)
@given(EDGES)
def test_split_is_a_partition(edges):
    graph = graph_of(range(7), [(a, b, w) for (a, b), w in edges.items()])
    parts, _ = split(graph)
    assert sorted(n for p in parts for n in p) == sorted(graph)
    assert -0.5 <= modularity(graph, parts) <= 1
    assert len(parts) >= len(components(graph))


def test_split_follows_only_sources_that_used_the_edge(monkeypatch):
    """Two cliques and a bridge: after an edge went, sources none of whose paths used it are not followed again."""
    import scholark.kernels.splitting as splitting

    followed, follow = [], splitting._follow
    monkeypatch.setattr(splitting, "_follow", lambda n, near, source, n_edges: followed.append(source) or follow(n, near, source, n_edges))
    edges = [(a, b, 1.0) for k in (0, 5) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(4, 5, 1.0)]
    graph = graph_of(range(10), edges)
    parts, _ = split(graph)
    assert sorted(n for p in parts for n in p) == list(range(10))
    assert len(followed) < 10 * (1 + len(edges))
    assert followed[:20] == [*range(10), *range(10)]  # the bridge is on paths of all
    assert len(followed[20:]) % 10 or len(followed) == 20


def brute_ward(x, threshold):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        def cost(a, b):
            ca, cb = x[a].mean(axis=0), x[b].mean(axis=0)
            return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(ca - cb)

        height, i, j = min((cost(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if height >= threshold:
            break
        groups[i] = groups[i] + groups[j]
        del groups[j]
    return {frozenset(g) for g in groups}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.floats(0.2, 4))
def test_ward(seed, n, threshold):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    label = ward_labels(x, threshold)
    assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label)} == brute_ward(x, threshold)


@settings(max_examples=40, deadline=None)
@given(EDGES)
def test_pagerank_sums_to_one(edges):
    w = np.zeros((7, 7))
    for (a, b), v in edges.items():
        w[a, b] = w[b, a] = v
    score = pagerank(w)
    assert abs(score.sum() - 1) < 1e-6 and (score > 0).all()


def test_diversified_rules():
    near = {frozenset("ab"): 0.9, frozenset("ac"): 0.7, frozenset("bd"): 0.9}
    similar = lambda x, y: near.get(frozenset((x, y)), 0.0)
    assert diversified(list("abcd"), similar, 0.6) == list("abcd")
    assert diversified(list("abcde"), similar, 0.6) == list("ade")
    assert diversified(list("adcbe"), similar, 0.6, None) == list("adcbe")
    assert diversified(list("abcdefgh"), lambda x, y: 0.0, 0.6, keep=3) == list("abc")


def test_split_does_not_depend_on_the_paths_kept(monkeypatch):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b), round(float(rng.integers(1, 5)) / 3, 9)) for a, b in itertools.combinations(range(24), 2) if rng.random() < (0.6 if a // 8 == b // 8 else 0.05)]
    want = split(graph_of(range(24), edges))
    for most in (0, 60, 300):
        monkeypatch.setattr(splitting, "KEPT_SHARES", most, raising=False)
        assert split(graph_of(range(24), edges)) == want


def test_ego_nets_are_split_whatever_their_size(spark):
    """A net of 506 neighbours, most of them alone, and the same net without these: the linked ones are split alike, none is left out."""
    inner = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.04)]
    want, _ = split(graph_of(range(1, 507), inner))
    graph = spark.createDataFrame([(0, i, 1.0) for i in range(1, 507)] + inner, "src long, dst long, weight double")
    parts = {}
    for r in co.split_egos(graph).where("node = 0").collect():
        parts.setdefault(r.component, []).append(r.neighbour)
        assert r.error is None and (r.n_nodes, r.n_edges) == (506, 7)
    assert sorted(map(sorted, parts.values())) == sorted(want) and sum(map(len, want)) == 506
    small = [(0, i, 1.0) for i in range(1, 7)]
    few = {}
    for r in co.split_egos(spark.createDataFrame(small + inner, graph.schema)).where("node = 0").collect():
        few.setdefault(r.component, []).append(r.neighbour)
    assert sorted(map(sorted, few.values())) == sorted(p for p in want if p[0] < 7)
