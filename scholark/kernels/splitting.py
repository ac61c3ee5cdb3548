"""Splitting of a small weighted graph by removal of its most central edges."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np

from scholark.constants import SPLIT_ITERATIONS

Graph = dict[int, dict[int, float]]
#: (edge, share) pairs of the sources' paths that are kept between two removals; the rest is followed again each time.
KEPT_SHARES = 20_000_000


def graph_of(nodes: Iterable[int], edges: Iterable[tuple[int, int, float]]) -> Graph:
    graph: Graph = {n: {} for n in nodes}
    for a, b, w in edges:
        graph.setdefault(a, {})[b] = w
        graph.setdefault(b, {})[a] = w
    return graph


def components(graph: Graph) -> list[list[int]]:
    """Sorted members of each component, by smallest member."""
    seen: set[int] = set()
    found = []
    for start in sorted(graph):
        if start in seen:
            continue
        stack, members = [start], []
        seen.add(start)
        while stack:
            node = stack.pop()
            members.append(node)
            for other in graph[node]:
                if other not in seen:
                    seen.add(other)
                    stack.append(other)
        found.append(sorted(members))
    return found


def edge_betweenness(graph: Graph, samples: int | None = None, seed: int = 1) -> dict[tuple[int, int], float]:
    """Share of shortest weighted paths over each edge, the weight being the length.

    With ``samples``, only paths from so many nodes, drawn by ``seed``, are followed, and scaled up to all.
    """
    nodes = sorted(graph)
    place = {n: i for i, n in enumerate(nodes)}
    ends = [(a, b) for a in nodes for b in graph[a] if a < b]
    near: list[list[tuple[int, float, int]]] = [[] for _ in nodes]
    for e, (a, b) in enumerate(ends):
        near[place[a]].append((place[b], graph[a][b], e))
        near[place[b]].append((place[a], graph[a][b], e))
    sources = list(range(len(nodes)))
    if samples is not None and samples < len(nodes):
        sources = np.random.default_rng(seed).choice(sources, samples, replace=False).tolist()
    total = np.zeros(len(ends))
    for s in sources:
        at, share = _carried(len(nodes), near, s, len(ends))
        total[at] += share
    scale = len(nodes) / max(1, len(sources))
    return {e: float(v) * scale for e, v in zip(ends, total)}


def _carried(n: int, near: list[list[tuple[int, float, int]]], source: int, n_edges: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges on paths from the source, ascending, and the paths over each. ``near`` has (neighbour, length, edge) of each node."""
    row = np.array(_follow(n, near, source, n_edges))
    at = np.flatnonzero(row).astype(np.int32)
    return at, row[at]


def _follow(n: int, near: list[list[tuple[int, float, int]]], source: int, n_edges: int) -> list[float]:
    row = [0.0] * n_edges
    distance, paths, done = [float("inf")] * n, [0.0] * n, [False] * n
    before: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    distance[source], paths[source], order, queue = 0.0, 1.0, [], [(0.0, source)]
    while queue:
        d, node = heapq.heappop(queue)
        if done[node]:
            continue
        done[node] = True
        order.append(node)
        share = paths[node]
        for other, w, e in near[node]:
            if done[other]:
                continue
            length, known = d + w, distance[other]
            if length < known - 1e-12:
                distance[other], paths[other], before[other] = length, share, [(node, e)]
                heapq.heappush(queue, (length, other))
            elif length <= known + 1e-12:
                paths[other] += share
                before[other].append((node, e))
    load = [0.0] * n
    for node in reversed(order):
        part = (1 + load[node]) / paths[node]
        for previous, e in before[node]:
            carried = paths[previous] * part
            row[e] += carried
            load[previous] += carried
    return row


def modularity(graph: Graph, parts: list[list[int]]) -> float:
    weight = sum(w for a in graph for w in graph[a].values()) / 2
    if weight == 0:
        return 0.0
    result = 0.0
    for part in parts:
        inside = set(part)
        within = sum(w for a in part for b, w in graph[a].items() if b in inside) / 2
        degree = sum(w for a in part for w in graph[a].values())
        result += within / weight - (degree / (2 * weight)) ** 2
    return result


def split(graph: Graph, iterations: int = SPLIT_ITERATIONS) -> tuple[list[list[int]], int]:
    """The first partition whose modularity is within a standard deviation of the best, and its place.

    Partitions come from removing the most central edge until the graph falls apart further, ``iterations`` times at
    most. With fewer than two partitions to compare the components stand.
    """
    nodes = sorted(graph)
    place = {n: i for i, n in enumerate(nodes)}
    ends = [(a, b) for a in nodes for b in graph[a] if a < b]
    left = {a: dict(b) for a, b in graph.items()}
    near: list[list[tuple[int, float, int]]] = [[] for _ in nodes]
    for e, (a, b) in enumerate(ends):
        near[place[a]].append((place[b], graph[a][b], e))
        near[place[b]].append((place[a], graph[a][b], e))
    # A source none of whose paths used the edge that went keeps its paths.
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    room = KEPT_SHARES
    gone = np.zeros(len(ends), dtype=bool)
    found = []
    parts = components(left)
    for _ in range(iterations):
        count = len(parts)
        while len(parts) == count and not gone.all():
            total = np.zeros(len(ends))
            for source in range(len(nodes)):
                if (carried := kept.get(source)) is None:
                    carried = _carried(len(nodes), near, source, len(ends))
                    if len(carried[0]) <= room:
                        kept[source], room = carried, room - len(carried[0])
                at, share = carried
                total[at] += share
            total[gone] = -1
            e = int(total.argmax())  # the first, so the smallest, of equal ones
            a, b = ends[e]
            gone[e] = True
            del left[a][b], left[b][a]
            for x in (place[a], place[b]):
                near[x] = [y for y in near[x] if y[2] != e]
            parts = components(left)
            for source, (at, _share) in list(kept.items()):
                if (i := int(np.searchsorted(at, e))) < len(at) and at[i] == e:
                    room += len(at)
                    del kept[source]
        if len(parts) == count:
            break
        found.append(parts)
    if len(found) < 2:
        return components(graph), 0
    quality = np.array([modularity(graph, p) for p in found])
    at = int(np.argmax(quality >= quality.max() - quality.std(ddof=1)))
    return found[at], at + 1
