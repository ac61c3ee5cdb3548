"""Operators on small fixtures against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholark import session
from scholark.llm import clusters, counting, encoding, formatting, mixing, names, neighbours, residue, topn


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# 3


def test_top_n_against_sorting(spark):
    rng = random.Random(3)
    data = [(rng.randrange(4), rng.randrange(12), rng.choice([0.5, 0.25, 1.0, None, float("nan"), -0.0, 0.0]), rng.choice(["A", "a", "b", None])) for _ in range(400)]
    data += data[:20] + [(None, 1, 1.0, "x"), (9, 1, 1.0, "x")]
    df = spark.createDataFrame(data, "g int, i int, s double, d string").withColumn("rank", F.lit(0)).withColumn("salt", F.lit("x"))
    want = set()
    for g in {r[0] for r in data} - {None}:
        best = {}
        for a, i, s, d in data:
            if a == g and s is not None and s == s and d is not None:
                best[i] = min(best.get(i, (1e9, "")), (-s, d))
        want |= {(g, i) for i in sorted(best, key=lambda i: (*best[i], i))[:5]}
    assert {(r.g, r.i) for r in topn.top_n_per_group(df, "g", "i", "s", ["d"], 5, salts=3).collect()} == want
    assert topn.top_n_per_group(df.where("false"), "g", "i", "s", ["d"], 5).count() == 0


# 4


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.1 * rng.normal(size=(25, 8)) for c in centres])
    data = [(f"p{i:03}", [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [("null", None), ("zero", [0.0] * 8), ("short", [1.0]), ("nan", [float("nan")] * 8), ("hole", [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(data + data[:5] + odd, "key string, v array<double>").withColumn("unit", F.lit(1)).withColumn("leaf", F.lit(1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    want = {(f"p{i:03}", f"p{j:03}") for i, r in enumerate(scores) for j in np.argsort(-r)[:3]}
    got = {(r.key, r.neighbour) for r in neighbours.most_similar(df, "key", "v", 3, 8, leaf_rows=20).collect()}
    assert len(want & got) >= 0.95 * len(want) and len(got) == len(want)
    exact = {(r.key, r.neighbour) for r in neighbours.most_similar(df, "key", "v", 3, 8, recall=1.1).collect()}
    assert exact == want
    # A sample too small for the table: a second level of leaves, calibrated like the first.
    deep = {(r.key, r.neighbour) for r in neighbours.most_similar(df, "key", "v", 3, 8, sample_rows=24, leaf_rows=10, deeper=1, inner_leaves=8, inner_sample=100).collect()}
    assert len(want & deep) >= 0.95 * len(want) and len(deep) == len(want)
    assert neighbours.most_similar(df.limit(0), "key", "v", 3, 8).count() == 0
    assert neighbours.most_similar(spark.createDataFrame(data[:2], "key string, v array<double>"), "key", "v", 3, 8).count() == 2


def test_visiting_rows_leave_python_once(spark, monkeypatch):
    """Rows are copied for the leaves they visit by the JVM, not within a Python batch, which would grow with the table."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 8)))], "key bigint, v array<double>")
    kinds, run = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda df, f, kind, *a: kinds.append(kind) or run(df, f, kind, *a))
    assert neighbours.most_similar(df, "key", "v", 3, 8, recall=1.1, leaf_rows=20).count() == 1200
    assert sum("leaves" in kind.fieldNames() for kind in kinds if not isinstance(kind, str)) == 1


def test_blocks_follow_the_queries_counted(spark, monkeypatch):
    """A leaf that nearly all visit is cut by its visits, not by its own rows times the usual number of visits."""
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 50)
    monkeypatch.setattr(neighbours, "BLOCK_PLACES", 100)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones(8) + 0.5 * rng.normal(size=(40, 8)), rng.normal(size=(360, 8))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key bigint, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    want = {(i, int(j)) for i, r in enumerate(scores) for j in np.argsort(-r)[:3]}
    assert {(r.key, r.neighbour) for r in neighbours.most_similar(df, "key", "v", 3, 8, recall=1.1, leaf_rows=20).collect()} == want
    deep = neighbours.most_similar(df, "key", "v", 3, 8, recall=1.1, sample_rows=24, leaf_rows=10, deeper=1, inner_leaves=8, inner_sample=100)
    assert len({(r.key, r.neighbour) for r in deep.collect()} & want) >= 0.95 * len(want)


def test_queries_travel_in_passes(spark, tmp_path, monkeypatch):
    """However many leaves a query visits, few copies of the table travel at a time, and only the result stays on the disk."""
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(neighbours, "PASS_ROWS", 100, raising=False)
    written, run = [], neighbours.cut_lineage
    monkeypatch.setattr(neighbours, "cut_lineage", lambda df, *a: written.append(df.columns) or run(df, *a))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64)).astype("<f4")
    unit = x.astype("<f8") / np.linalg.norm(x.astype("<f8"), axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    want = {(i, int(j)) for i, r in enumerate(scores) for j in np.argsort(-r)[:3]}
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key bigint, v array<float>")
    for copies, how in ((4, {"leaf_rows": 200}), (12, {"leaf_rows": 50, "sample_rows": 100, "deeper": 1, "inner_leaves": 8, "inner_sample": 500})):
        monkeypatch.setattr(neighbours, "PASS_COPIES", copies, raising=False)
        written.clear()
        before = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
        near = neighbours.most_similar(df, "key", "v", 3, 64, recall=1.1, **how)
        assert written.count(["key", "neighbour", "similarity", "rank"]) > 2
        assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) - before < 2000 * 64 * 4
        found = near.collect()
        assert len(found) == 6000 and {r["rank"] for r in found} == {1, 2, 3}
        assert len({(r.key, r.neighbour) for r in found} & want) >= 0.95 * len(want)
        assert all(abs(r.similarity - scores[r.key, r.neighbour]) < 1e-12 for r in found)


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = neighbours.fit_tree(x, 10)
    assert sorted(tree.visits(x[:1], tree.n_leaves)[0]) == list(range(tree.n_leaves))
    assert all(a == v[0] or a in v for a, v in zip(tree.assign(x), tree.visits(x, tree.n_leaves)))


# 5


def test_formatting(spark):
    data = [(1, "Deep Nets: a study"), (2, "deep—nets a STUDY!"), (3, "A study / Deep-nets"), (4, "A study deep nets"), (5, None), (6, ""), (7, "N/A"), (8, "Other title"), (8, "Other title"), (9, "x:y")]
    df = spark.createDataFrame(data, "id int, title string").withColumn("code", F.lit(0)).withColumn("value", F.lit("z"))
    groups = {}
    for r in formatting.collapse_formatting(df, "id", ["title"], swaps=True).collect():
        groups.setdefault(tuple(r["tuple"]), set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [8]]
    assert rows(formatting.copy_counts(df, "id", ["title"]).select("representative", "n_records")) == [(1, 2), (3, 2), (8, 1)]
    two = spark.createDataFrame([(1, "Alpha one", "Beta two"), (2, "beta TWO", "alpha-one"), (3, "Alpha one", None), (4, "gamma", "gamma")], "id int, a string, b string")
    assert rows(formatting.copy_counts(two, "id", ["a", "b"]).select("representative", "n_records")) == [(1, 2), (3, 1), (4, 1)]
    assert formatting.copy_counts(two.where("false"), "id", ["a"]).count() == 0


# 7

WORDS = st.lists(st.text("ab ", max_size=6), max_size=60)


@settings(max_examples=40, deadline=None)
@given(WORDS, st.integers(1, 4))
def test_burst_trie(words, container):
    trie, want = counting.BurstTrie(container), {}
    for w in words:
        trie.add(w, 2, 1)
        want[w] = (want.get(w, (0, 0))[0] + 2, want.get(w, (0, 0))[1] + 1)
    got = {p + s: tuple(c) for p, held in trie.subtrees() for s, c in held.items()}
    assert got == want and trie.entries == len(want)


def test_frequencies(spark):
    rng = random.Random(7)
    data = [(rng.choice(["L", "M", None]), rng.choice(["Deep Net", "deep  net", " tree\t", "x" * 5000, "", " ", None, "ab", "abc"]), rng.choice([1, 2, 3, None])) for _ in range(600)]
    df = spark.createDataFrame(data, "label string, term string, doc int").withColumn("occurrences", F.lit("n")).withColumn("record", F.lit(1))
    want = {}
    for label, term, doc in data:
        clean = " ".join((term or "").lower().split())
        if label and clean:
            n, docs = want.setdefault((label, clean), [0, set()])
            want[(label, clean)][0] += 1
            docs.add(doc)
    got = {(r.label, r.value): (r.occurrences, r.records) for r in counting.value_frequencies(df, "label", counting.folded(F.col("term")), "doc").collect()}
    assert got == {k: (n, len(d)) for k, (n, d) in want.items()}
    # Routes of few rows cut values apart, the most frequent ones many times.
    routed = {(r.label, r.value): (r.occurrences, r.records) for r in counting.value_frequencies(df, "label", counting.folded(F.col("term")), "doc", route_rows=15).collect()}
    assert routed == got
    assert counting.value_frequencies(df.where("false"), "label", counting.folded(F.col("term")), "doc").count() == 0


# 8


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab 1\n\t'sé世<|>") , max_size=300), st.integers(8, 40))
def test_chunks_give_the_ids_of_the_whole(text, chunk):
    whole = encoding.encoder().encode_ordinary(text)
    assert encoding.encode_text(text, chunk=chunk, overlap=8) == whole
    assert encoding.decode_ids(whole) == text


def test_encode_corpus(spark):
    texts = [None, "", " ", "a", "<|endoftext|>", "word " * 50, "x" * 400, "tab\t\t\n\n end", "naïve 世界 " * 30, "a" * 90 + " b" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("key", F.lit("k")).withColumn("ids", F.lit(1))
    got = dict(encoding.encode_corpus(df, "id", "t", chunk=64, overlap=16).collect())
    assert got == {i: encoding.encoder().encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encoding.encode_corpus(df.where("false"), "id", "t").count() == 0


# 9


def test_split_counts_are_exact():
    counts = {"a": 1000, "b": 7, "c": 0, "d": 333}
    parts = mixing.split_counts(counts, 6, 3)
    assert {k: sum(v) for k, v in parts.items()} == counts
    sizes = [sum(v[i] for v in parts.values()) for i in range(6)]
    assert max(sizes) - min(sizes) <= 1


def test_large_urns_are_drawn_by_the_same_law(monkeypatch):
    # Inversion against the exact terms of small urns, and against mean and deviation of one beyond the generator.
    for good, bad, n in ((5, 7, 6), (40, 3, 20), (1, 60, 30), (9, 9, 18)):
        terms = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(min(n, good) + 1)]
        steps = 20_000
        drawn = [mixing._inverted((i + 0.5) / steps, good, bad, n) for i in range(steps)]
        for k, p in enumerate(terms):
            assert abs(drawn.count(k) / steps - p) < 1e-3
    rng, good, bad, n = np.random.default_rng(1), 3_000_000_000, 5_000_000_000, 10_000
    drawn = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(2000)])
    assert abs(drawn.mean() - n * 3 / 8) < 5 and abs(drawn.std() - math.sqrt(n * 15 / 64)) < 3


@pytest.mark.parametrize("total", [None, 300.0, 100_000.0])
def test_mix(spark, total):
    data = [(i, f"some words {i} " * (1 + i % 4), "big" if i % 3 else "small") for i in range(300)] + [(900, None, "big"), (901, "", "small"), (902, "words", None), (903, "words", "unlisted")]
    df = spark.createDataFrame(data, "doc int, t string, s string").withColumn("shard", F.lit("x")).withColumn("key", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("missing", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, targets, "doc", "t", "s", total, shards=4).toPandas()
    assert not mix.duplicated(["doc", "copy"]).any()
    uses = mix.groupby("doc").size()
    assert (uses[mix[mix.source == "big"].doc.unique()] <= 1).all() and uses.max() <= 3 and mix.source.isin(["big", "small"]).all()
    assert all(sorted(g.position) == list(range(1, len(g) + 1)) for _, g in mix.groupby("shard"))
    share = mix.groupby("source").n_tokens.sum() / mix.n_tokens.sum()
    if total != 100_000.0:
        assert abs(share["big"] - 0.5) < 0.05
    else:
        assert uses[mix[mix.source == "small"].doc.unique()].min() == 3
    assert mixing.mix_sources(df.where("false"), targets, "doc", "t", "s").count() == 0
    blocks = mixing.mix_sources(df, targets, "doc", "t", "s", total, block_rows=20, shard_rows=25).toPandas()
    assert sorted(blocks.groupby("source").n_tokens.sum()) == sorted(mix.groupby("source").n_tokens.sum())
    assert not blocks.duplicated(["doc", "copy"]).any() and blocks.groupby("shard").size().max() <= 26
    assert all(sorted(g.position) == list(range(1, len(g) + 1)) for _, g in blocks.groupby("shard"))


# 10


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Dear {{ name }},\nyour paper is fine.", "slot"),
        ("In total, %PEOPLE_COUNT% took part in our long study of maps.", "slot"),
        ("Data are at [INSERT URL]. We thank all.", "slot"),
        ("Gains over the best run reach ??.? points on all maps we drew.", "slot"),
        ("Gains over the best run reach XX.X percent on all maps.", "slot"),
        ("The number of readers is TBD in this draft of the map study.", "slot"),
        ("Is this so?? Readers asked 'why???' often, and the XX karyotype is common.", None),
        ("We wrote 'TBD' wherever a value was a placeholder in the older set.", None),
        ("We use {{title}} markers; `[INSERT TITLE]` is one of the strings such as those.", None),
        ('Engines mark a slot as "${name}" in general.', None),
        ("Run\n\n    make --user ${USER}\n\nResults follow in the next part of this text.", None),
        ("Let $S_{i} = \\{x_{1}\\}$ and f(x) = {x if x > 0}.", None),
        ('A record reads {"label": "Task"}.', None),
        ("Growth was 12% in one year, 30% in the next.", None),
        ("Lorem ipsum dolor sit amet, elit sed magna.", "filler"),
        ("Your text here. Your text here.", "filler"),
        ("Half of the pages held lorem ipsum, which readers skipped at once in our study.", None),
        ("404 Not Found\nThe page you asked for could not be found.", "error"),
        ("Status codes 404 and 500 made up 13 percent of the fetch log. We counted them by hand over a month.", None),
        ("Home | Papers\nPlease enable JavaScript to view this page.\n© X archive", "script"),
        ("A long paper on maps and how people read them. It has many parts and facts.\n\nPlease enable JavaScript to use the tool.", None),
        ("This paper was withdrawn by its authors.", None),
        ("Poster only. Topic: maps in a wetland.", None),
        (None, None),
        ("", None),
        (" \n", None),
    ],
)
def test_residue(text, kind):
    assert residue.residue_kind(text) == kind


def test_residue_operators(spark):
    df = spark.createDataFrame([(1, "{{x_y}} is here"), (2, None), (3, "Plain content of a note."), (1, "{{x_y}} is here")], "id int, text string").withColumn("key", F.lit(0)).withColumn("residue", F.lit(0))
    assert rows(residue.mark_residue(df, "id", "text").distinct()) == [(1, "slot"), (2, None), (3, None)]
    assert sorted(r.id for r in residue.exclude_residue(df, "text").collect()) == [2, 3]
    assert residue.mark_residue(df.where("false"), "id", "text").count() == 0


# 2


def brute_one_edit(a, b):
    if a == b:
        return True
    letters = sorted(set(a + b))
    forms = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in letters for k in (0, 1)} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in forms


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=5), st.text("abc", min_size=1, max_size=5))
def test_one_edit(a, b):
    assert names.one_edit(a, b) == brute_one_edit(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=4), st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=4))
def test_alignment_is_optimal(a, b):
    short, long = sorted((a, b), key=len)
    best = max(sum(names.token_fit(x, y, {}) for x, y in zip(short, p)) for p in itertools.permutations(long, len(short)))
    assert abs(names.align(a, b, {}) - best / len(short)) < 1e-9


def test_link_names(spark):
    typed = [
        (1, "Dorothy A. Vundarmik"), (2, "Vundarmik, Dolly"), (3, "VUNDARMIK DA"), (4, "Dorohty Vundarmik"), (5, "Henry Vundarmik"), (6, "D. Vundarmik"), (6, "D. Vundarmik"),
        (7, "Prof. Henry Vundarmik1, PhD"), (8, None), (9, ""), (10, "Bunkazine Intrusion Triage Consortium"), (11, "The Bunkazine intrusion triage cons."), (12, "Consortium, Bunkazine Intrusoin Triage"),
        (13, "Dorothy Karstelban"), (14, "X. Y. Karstelban"), (15, "Other Group for Maps Network"), (16, "?!"),
    ]
    df = spark.createDataFrame(typed, "id bigint, name string").withColumn("raw", F.lit(1)).withColumn("kind", F.lit("k"))
    forms = spark.createDataFrame([("Dorothy", "Dolly"), ("Dorothy", "Dot")], "given_name string, short_form string")
    got = dict(names.link_names(df, "id", "name", forms).collect())
    assert got[1] == got[2] == got[3] == got[4] == got[6] == 1 and got[5] == got[7] == 5
    assert got[10] == got[11] == got[12] == 10 and got[13] == 13 and got[14] == 14 and got[15] == 15
    assert not {8, 9, 16} & set(got)
    assert names.link_names(df.where("false"), "id", "name", forms).count() == 0


# 6

TEXT = "We map the old harbour with three kinds of cheap sensors. Results show that noise falls by nine percent when the lamps are dim. The code keeps one table per ship and one tree per crane. Two case studies in a distant port back these bold claims."


def test_clusters(spark):
    sentences = TEXT.split(". ")
    other = "A reader found the modern view of the library easier to use than the ancient one. Training takes seven hours on a small machine in the cellar. Future studies may pair this index with slow search."
    note = "Copies may be made for teaching when this line is kept with the print."
    data = [
        (1, "Harbour maps by Quorvantel", TEXT), (2, "harbour  maps by QUORVANTEL!", "<p>" + TEXT.upper() + "</p>"), (3, "Retitled", ". ".join(reversed(sentences))), (4, "Short", ". ".join(sentences[:3])),
        (5, "Long", TEXT.replace("cheap", "modest").replace("distant", "remote") + " " + note), (6, "Harbour maps by Quorvantel", None), (7, "Library views", other), (8, "Library views, part 2", None), (9, None, None), (10, "", "nan"),
        (11, "Stock", note + " Nothing else is like this other text of ours about birds."), (12, "Stock two", note + " Quite a different matter of winter roads and their repair."), (1, "Harbour maps by Quorvantel", TEXT),
    ]
    df = spark.createDataFrame(data, "id bigint, t string, a string").withColumn("node", F.lit(1)).withColumn("words", F.lit(""))
    got = {r.id: r.cluster for r in clusters.cluster_records(df, "id", "t", "a").collect()}
    assert {got[i] for i in range(1, 7)} == {1} and got[7] == 7 and got[8] == 8 and got[11] != got[12] and not {9, 10} & set(got)
    described = {r.cluster: r for r in clusters.describe_clusters(clusters.cluster_records(df, "id", "t", "a"), "id").collect()}
    assert described[1].n_records == 6 and len(described[1].typical) == 3 and described[7].typical == [7]
    assert clusters.cluster_records(df.where("false"), "id", "t", "a").count() == 0


def brute_mcl(edges, nodes, inflation, prune):
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = w
    np.fill_diagonal(m, m.max(axis=0))
    m /= m.sum(axis=0)
    for _ in range(40):
        m = np.linalg.matrix_power(m, 2) ** inflation
        m /= m.sum(axis=0)
        m[(m < prune) & (m < m.max(axis=0))] = 0
        m /= m.sum(axis=0)
    groups = {}
    for j, n in enumerate(nodes):
        groups.setdefault(nodes[int(np.argmax(np.round(m[:, j], 6)))], set()).add(n)
    return {frozenset(g) for g in groups.values()}


def grouped(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.cluster, set()).add(r.node)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("dense", [400, 0])
def test_markov_clusters(spark, dense):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.05), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (10, 11, 0.8), (5, 4, 0.3), (7, 7, 1.0)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    want = brute_mcl(edges[:8], [0, 1, 2, 3, 4, 5, 10, 11], 2.0, 1e-3)
    assert grouped(clusters.markov_clusters(df, dense=dense)) == want == {frozenset({0, 1, 2}), frozenset({3, 4, 5}), frozenset({10, 11})}
    assert clusters.markov_clusters(df.where("false"), dense=dense).count() == 0


def test_a_weak_bridge_is_cut_and_a_hub_is_not_lost(spark):
    # Two dense versions' groups joined by one weak edge: components give one cluster, the flow two.
    left, right = range(0, 8), range(20, 26)
    edges = [(a, b, 0.9) for g in (left, right) for a, b in itertools.combinations(g, 2)] + [(3, 22, 0.42)]
    edges += [(100, 101 + i, 0.7) for i in range(90)]  # a star: its centre attracts all
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    want = {frozenset(left), frozenset(right), frozenset(range(100, 191))}
    assert grouped(clusters.markov_clusters(df)) == want == grouped(clusters.markov_clusters(df, dense=20))
    flows = {r.node: r.flow for r in clusters.markov_clusters(df).collect()}
    assert max((flows[n], n) for n in range(100, 191))[1] == 100


def test_flow_that_does_not_settle_raises():
    chain = np.zeros((1, 40, 40))
    for i in range(39):
        chain[0, i, i + 1] = chain[0, i + 1, i] = 1.0
    with pytest.raises(RuntimeError):
        clusters.flow_block(chain, rounds=2)


def test_crowds_under_a_common_phrase_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CROWD", 6)
    monkeypatch.setattr(clusters, "CENTRES", 2)
    kind = {i: i % 4 for i in range(60)}
    crowds = spark.createDataFrame([(h, i) for h in (1, 2) for i in kind], "h bigint, node bigint")
    alike = lambda ab: ab.where("node % 4 = other % 4")
    pairs = {(r.node, r.other) for r in alike(clusters.centred_pairs(crowds, alike)).collect()}
    root = {i: i for i in kind}
    for _ in kind:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: root[i] for i in kind} == {i: i % 4 for i in kind} and len(pairs) < 60 * 59 / 4


def test_crowds_give_all_similar_pairs(spark, monkeypatch):
    """Members similar to a centre are also met by each other: here i and j are similar within 9, the flow needs all these links."""
    monkeypatch.setattr(clusters, "CROWD", 6)
    monkeypatch.setattr(clusters, "CENTRES", 2)
    crowds = spark.createDataFrame([(h, i) for h, n in ((1, 60), (2, 33), (3, 5)) for i in range(h * 1000, h * 1000 + n)], "h bigint, node bigint")
    alike = lambda ab: ab.where("other - node < 9")
    found = [tuple(r) for r in alike(clusters.centred_pairs(crowds, alike)).collect()]
    want = {(h * 1000 + i, h * 1000 + j) for h, n in ((1, 60), (2, 33), (3, 5)) for i in range(n) for j in range(i + 1, min(n, i + 9))}
    assert set(found) == want and len(found) == len(want)


# 2, every near pair


def test_family_names_meet_all_their_neighbours(spark):
    # One swap and one substitution from klosaizerik, whose forms are as many as theirs; two more in a chain.
    data = [(1, "Ginevra N. Klosaizerik"), (1, "Ginevra N. Klosaieerik"), (2, "Ginevra N. Kloasizerik"), (3, "Otto Brandelmi"), (4, "Otto Brandelma"), (5, "Otto Brandelmax"), (6, "Paul Brandelma"), (7, "Ginevra Morvanto")]
    df = spark.createDataFrame(data, "who int, typed string")
    got = {r.who: r.entity for r in names.link_names(df, "who", "typed").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}


def test_near_pairs_against_brute_force(spark):
    words = sorted({"".join(w) for w in itertools.product("ab", repeat=5)} | {"abcdef", "abcdfe", "abcde", "xabcde", "abc", "abcd"})
    near = names.near_pairs(spark.createDataFrame([(w,) for w in words * 2], "token string"))
    want = {(a, b) for a in words for b in words if a != b and min(len(a), len(b)) >= names.SHORT and names.one_edit(a, b)}
    assert {(r.token, r.other) for r in near.collect()} == want


# 6, titles of records without a text


def test_bare_titles_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CLASS_BLOCK", 40)
    rng = random.Random(6)
    vocabulary = [f"word{i:02}x" for i in range(90)]
    titles = sorted({tuple(sorted(rng.sample(vocabulary[:3], 1) + rng.sample(vocabulary[3:25], rng.randrange(2)) + rng.sample(vocabulary[25:], rng.randrange(3)))) for _ in range(260)})
    titles.append(("clerks", "joining", "meet", "stream", "vralbaix", "word00x"))
    titles.append(("clerks", "joining", "meet", "stream", "vralbiax", "word00x"))
    data = [(i, " ".join(t), None if i % 3 or t[0] == "clerks" else f"Only text number {i} says {i * 7} of {i * 13} in its own words.") for i, t in enumerate(titles)]
    count = {}
    for t in titles:
        for w in t:
            count[w] = count.get(w, 0) + 1
    assert max(count.values()) > 50
    weight = {w: max(1, int((math.log(len(titles) / n) + 0.1) ** 2 * 10 + 0.5)) for w, n in count.items()}
    total = [sum(weight[w] for w in t) for t in titles]
    rarest = [min(t, key=lambda w: (count[w], w)) for t in titles]
    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(titles), 2):
        if data[i][2] is None or data[j][2] is None:
            s = sum(weight[w] for w in set(a) & set(b)) / min(total[i], total[j])
            alike = (data[i][2] is None and rarest[i] in b) or (data[j][2] is None and rarest[j] in a)
            if s >= (clusters.TITLES_AGREE if alike else clusters.TITLES_ALIKE):
                want.add((i, j))
    df = spark.createDataFrame(data, "id long, title string, text string")
    _, edges = clusters.similarity_graph(df, "id", "title", "text")
    assert {(r.src, r.dst) for r in edges.collect()} == want
    assert (len(titles) - 2, len(titles) - 1) in want


# 2, what is read whole


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 3), st.data())
def test_assignment_against_permutations(n, more, data):
    gains = data.draw(st.lists(st.lists(st.sampled_from([0.0, 0.5, 0.7, 0.9, 1.0]), min_size=n + more, max_size=n + more), min_size=n, max_size=n))
    best = max(sum(gains[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(n + more), n))
    assert abs(names.assignment(gains) - best) < 1e-9


def linked(spark, typed):
    df = spark.createDataFrame(typed, "id bigint, name string")
    return dict(names.link_names(df, "id", "name").collect())


def test_names_are_read_whole(spark):
    got = linked(spark, [
        (1, "Consortium for Arctic Permafrost Carbon Flux Tundra Methane Ocean River Bravo"), (2, "Consortium for Arctic Permafrost Carbon Flux Tundra Methane Ocean Forest Alpha"),
        (3, "Arctic Permafrots Carbon Flux Tundra Methane Ocean River Bravo Consortium"),
        (11, "Garcia, Ana Beatriz Carla"), (12, "Garcia, Ana Beatriz Diana"), (13, "Garcia, Ana Beatrix Carla"), (14, "Garcia, Beatriz Ana Carla"),
        (21, "Lee, Wilhelmina K."), (22, "Lea, Wilhelmina K."), (23, "Wong, Wilhelmina"), (24, "Wang, Wilhelmina"),
    ])
    assert got[1] == got[3] == 1 and got[2] == 2
    assert got[11] == got[13] == got[14] == 11 and got[12] == 12
    assert got[21] == got[22] == 21 and got[23] == 23 and got[24] == 24


def test_groups_whose_rarest_words_differ(spark):
    # Both rarest words of each are abbreviated in the other; the common words bring them together.
    own = ["Quorastel Vendramoth", "Lumbrika Ostervand", "Pellagorn Wistrade", "Drovanek Umbraxis"]
    common = [(i, f"Maritime Sensor Imaging {w} Consortium") for i, w in enumerate(own, 3)]
    got = linked(spark, [(1, "Maritime Sensor Imaging Klastermont Zirkovale Consortium"), (2, "Maritime Sensor Imaging Klast Zirk Consortium"), *common])
    assert got[1] == got[2] == 1 and [got[i] for i, _ in common] == [i for i, _ in common]


def test_blocks_of_one_family_name_against_brute_force(spark):
    rng = random.Random(2)
    stems = ["dorothea", "henrike", "valentina", "orlando", "cassius", "ingeborg"]
    typed = []
    for i in range(300):
        g = rng.choice(stems)
        at = rng.randrange(len(g))
        form = rng.choice([g, g, g[:at] + g[at + 1 :], g[0] + ".", g[:at] + "x" + g[at + 1 :]]).capitalize()
        typed.append((i, f"Zvendarmik, {form}" + rng.choice(["", "", " Q."])))
    parsed = {i: names.parse_name(t)["given"] for i, t in typed}
    want = names.label_persons([" ".join(g) for g in parsed.values()], {})
    got = linked(spark, typed)
    for (i, a), (j, b) in itertools.combinations(zip(parsed, want), 2):
        assert (got[i] == got[j]) == (a is not None and a == b), (typed[i], typed[j])


def test_persons_of_names_leave_no_pair_out():
    """Against all pairs: several persons under near leading names, further tokens that are prefixes or forms, turned lists."""
    forms = {"bill": {"william"}, "kate": {"katharina"}}
    fixed = [["anna", "bill"], ["anna", "william"], ["jonathan", "karl"], ["jonathan", "peter"], ["jonathon", "otto"], ["jonathon", "peter"], ["maria", "luisa"], ["luiza", "maria"], ["hans", "kath"], ["hans", "katharina"]]
    rng = random.Random(7)
    words = ["maria", "mariya", "anna", "luisa", "luiza", "kath", "katharina", "kate", "bill", "william", "karl", "k", "m", "w", "wil.", "ma."]
    lists = [fixed] + [[[rng.choice(words[:11]), *rng.choices(words, k=rng.randrange(0, 4))] for _ in range(rng.randrange(2, 9))] for _ in range(300)]
    for fulls in lists:
        sets = names._Sets(len(fulls))
        for i, j in itertools.combinations(range(len(fulls)), 2):
            # Lists in another order that agree by initials alone are not linked.
            written = [t for t in fulls[i] if len(t) > 1], [t for t in fulls[j] if len(t) > 1]
            near = any(names._given_token(x, y, forms) >= names.REORDERED for x in written[0] for y in written[1])
            if names.one_person(fulls[i], fulls[j], forms) and (near or names.token_fit(fulls[i][0], fulls[j][0], forms) >= names.REORDERED):
                sets.union(i, j)
        assert names.persons_of_names(fulls, forms) == [sets.find(i) for i in range(len(fulls))], fulls
