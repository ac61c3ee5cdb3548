"""Queries on co-authorship graphs, vectors, personas and term ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholark.constants import EDGE_PRUNE, STRONG_COAUTHOR, YEARS
from scholark.functions.scores import author_paper_scores
from scholark.functions.vectors import cosine_distance
from scholark.operators import ranking as rk
from scholark.operators.graph import coauthors as co
from scholark.operators.graph.components import connected_components as components
from scholark.plans import domain as dm
from scholark.plans import recommend as rc
from scholark.plans import standin as st
from scholark.session import cut_lineage
from scholark.sources.tables import table

#: Authors of a paper beyond which it makes no edges; years whose co-authorships are split into personas.
MOST_AUTHORS, SPLIT_YEARS = 50, (2020, 2021)


def _rows(spark, d):
    return st.authorship(spark, d).join(st.papers(spark, d).select("PaperId", "Year"), "PaperId")


def _edges(spark, d):
    return co.author_paper_edges(_rows(spark, d), (1996, 2001), min_pubs=3)


def _authorships(spark, d, years):
    rows = dm.authorship(spark, d).join(dm.papers(spark, d).select("PaperId", "Year"), "PaperId")
    return co.author_paper_edges(rows, years, most_authors=MOST_AUTHORS)


def _graph(spark, d, years=YEARS):
    """Co-authors of a window of years, edges of EDGE_PRUNE or less aside."""
    return cut_lineage(co.heavy_edges(co.project(_authorships(spark, d, years)), EDGE_PRUNE))


def min_pubs_edgelist(spark, d):
    return co.author_paper_edges(_rows(spark, d), (1996, 2001), min_pubs=3)


def max_authors_edgelist(spark, d):
    return co.author_paper_edges(_rows(spark, d), (1996, 2001), min_pubs=3, most_authors=3)


def coauthor_projection(spark, d):
    return co.project(_edges(spark, d)).select(F.col("src").alias("AuthorId_1"), F.col("dst").alias("AuthorId_2"), F.round("weight", 6).alias("weight"))


def coauthor_npubs(spark, d):
    return co.publications(_edges(spark, d))


def strong_coauthors(spark, d):
    return co.strong_coauthors(cut_lineage(_authorships(spark, d, YEARS)))


def bfs_ring(spark, d):
    graph = _graph(spark, d)
    source = graph.agg(F.max("dst").alias("id"))
    return co.distances_from(graph, source, 8).where("distance >= 3 and distance < 6").select("id", "distance")


def connected_components(spark, d):
    return components(_graph(spark, d))


def ego_neighbours(spark, d):
    return co.ego_edges(_graph(spark, d)).select("ego", "src", "dst")


def ego_girvan_newman(spark, d):
    return co.split_egos(_graph(spark, d, SPLIT_YEARS))


def persona_graph(spark, d):
    graph = _graph(spark, d, SPLIT_YEARS)
    return co.persona_graph(graph, co.split_egos(graph))


def persona_memberships(spark, d):
    """Overlapping communities: components of the persona graph, read back as clusters of authors."""
    graph = co.persona_graph(g := _graph(spark, d, SPLIT_YEARS), co.split_egos(g))
    name = lambda side: F.concat_ws(":", F.col(f"{side}_node").cast("string"), F.col(f"{side}_component").cast("string"))
    found = components(graph.select(name("src").alias("src"), name("dst").alias("dst")))
    members = found.select(F.split_part("id", F.lit(":"), F.lit(1)).cast("bigint").alias("node"), F.col("component").alias("cluster"))
    return co.overlapping_memberships(members)


def _scored(spark, d):
    return author_paper_scores(st.scored_authorship(spark, d)).select("PaperId", "AuthorId", "score")


def author_term_matrix(spark, d):
    return rc.author_term_scores(_scored(spark, d), st.term_rows(spark, d), "Task").select("AuthorId", "term_id", F.round("value", 5).alias("value"))


def author_avg_embedding(spark, d):
    scores = rc.author_term_scores(_scored(spark, d), st.term_rows(spark, d), "Method")
    vectors = rc.author_term_vectors(scores, st.term_vectors(spark, d))
    return vectors.select("AuthorId", F.posexplode("embedding").alias("i", "x")).select("AuthorId", "i", F.round("x", 5).alias("x"))


def author_avg_paper_vector(spark, d):
    vectors = rc.author_paper_vectors(_scored(spark, d), st.paper_vectors(spark, d))
    return vectors.select("AuthorId", F.posexplode("embedding").alias("i", "x")).select("AuthorId", "i", F.round("x", 5).alias("x"))


def focal_cosine(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    asked = vectors.where("vec_id = 0").select(F.col("v").alias("f"))
    return vectors.crossJoin(F.broadcast(asked)).select("vec_id", "label", F.round(cosine_distance(F.col("v"), F.col("f")), 6).alias("distance"))


def nearest_terms_to_focal(spark, d):
    """Vectors of other labels nearest to any vector of label 0."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("term_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    focal = vectors.where("label = 0").select("vector")
    near = rk.nearest_terms(focal, vectors.where("label <> 0"), [], 25)
    return near.select("term_id", F.round("distance", 6).alias("distance"), "rank")


def _ranked_terms(spark, d, n=rk.MOST_TERMS):
    """The first ``n`` vectors of each label as terms of a collection, relevance by hash of their id."""
    vectors = table(spark, d, "embeddings").select("label", F.col("vec_id").cast("string").alias("term_display"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") * 7919 % 1009).cast("double").alias("relevance"))
    return rk.top_terms(vectors, ["label"], "relevance", n)


def similarity_graph(spark, d):
    return rk.similarity_graph(_ranked_terms(spark, d), ["label"]).select("label", "term_1", "term_2", F.round("similarity", 6).alias("similarity"))


def textrank(spark, d):
    terms = _ranked_terms(spark, d)
    return rk.text_rank(terms, rk.similarity_graph(terms, ["label"]), "label")


def diversified_terms(spark, d):
    terms = _ranked_terms(spark, d)
    return rk.diversified_terms(terms, rk.similarity_graph(terms, ["label"]), "label")


def strategy_comparison(spark, d):
    """Relevance against frequency of the Task terms of every author, side by side by rank."""
    rows = st.term_rows(spark, d).where("label = 'Task'").join(_scored(spark, d), "PaperId")
    terms = rows.groupBy("AuthorId", "term_display").agg(F.round(F.sum("score"), 5).alias("relevance"), F.count(F.lit(1)).alias("freq"))
    return rk.compare_strategies(terms, "AuthorId", {"relevance": lambda t: rk.top_terms(t, ["AuthorId"], "relevance", 5), "frequency": lambda t: rk.top_terms(t, ["AuthorId"], "freq", 5)})


def ward_personas(spark, d):
    """Personas of authors by the vectors of all their papers."""
    rows = _rows(spark, d).join(st.papers(spark, d).select("PaperId", "Rank"), "PaperId").join(st.paper_vectors(spark, d), "PaperId")
    return rc.ward_personas(rows, 1.8, 4)


QUERIES = {
    f.__name__: f
    for f in (
        min_pubs_edgelist, max_authors_edgelist, coauthor_projection, coauthor_npubs, strong_coauthors, bfs_ring, connected_components, ego_neighbours, ego_girvan_newman,
        persona_graph, persona_memberships, author_term_matrix, author_avg_embedding, author_avg_paper_vector, focal_cosine, nearest_terms_to_focal, similarity_graph, textrank,
        diversified_terms, strategy_comparison, ward_personas,
    )
}

_EDGES = f"""{st.SQL_PAPERS}, {st.SQL_AUTHORSHIP}, r AS (SELECT paa.PaperId, AuthorId FROM paa JOIN papers USING (PaperId) WHERE Yr >= 1996 AND Yr < 2001),
    e AS (SELECT DISTINCT PaperId, AuthorId FROM r WHERE AuthorId IN (SELECT AuthorId FROM r GROUP BY 1 HAVING count(DISTINCT PaperId) >= 3))"""
_PROJ = f"{_EDGES}, sz AS (SELECT PaperId, count(*) AS d FROM e GROUP BY 1), pr AS (SELECT x.AuthorId AS src, y.AuthorId AS dst, sum(1.0 / (d - 1)) AS weight FROM e x JOIN e y ON x.PaperId = y.PaperId AND x.AuthorId < y.AuthorId JOIN sz ON sz.PaperId = x.PaperId WHERE d > 1 GROUP BY ALL)"
_DOMAIN = f"""{dm.SQL_PAPERS}, {dm.SQL_AUTHORSHIP}, e AS (SELECT PaperId, AuthorId FROM paa JOIN papers USING (PaperId) WHERE Yr >= {YEARS[0]} AND Yr < {YEARS[1]} QUALIFY count(*) OVER (PARTITION BY PaperId) <= {MOST_AUTHORS}),
    sz AS (SELECT PaperId, count(*) AS d FROM e GROUP BY 1), pr AS (SELECT x.AuthorId AS src, y.AuthorId AS dst, sum(1.0 / (d - 1)) AS weight FROM e x JOIN e y ON x.PaperId = y.PaperId AND x.AuthorId < y.AuthorId JOIN sz ON sz.PaperId = x.PaperId GROUP BY ALL)"""
_HEAVY = f"{_DOMAIN}, h AS (SELECT src, dst, round(weight, 9) AS weight FROM pr WHERE round(weight, 9) > {EDGE_PRUNE}), bw AS (SELECT src, dst FROM h UNION SELECT dst, src FROM h)"
_SC = f"{st.SQL_PAPERS}, {st.SQL_AUTHORSHIP}, {st.SQL_RANKED}, {st.SQL_POSITIONS}, {st.SQL_SCORED}, b AS (SELECT min(rank_scaled) AS lo, max(rank_scaled) AS hi FROM scored), sc AS (SELECT PaperId, AuthorId, mult * CASE WHEN hi = lo THEN 0.5 ELSE 0.5 + 0.5 * (rank_scaled - lo) / (hi - lo) END AS score FROM scored, b)"
_EV = "nv AS (SELECT count(*) AS n FROM embeddings), ev AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"
_COSINE = "1 - list_dot_product(a.v, f.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(f.v, f.v))"

ORACLES = {
    "min_pubs_edgelist": f"WITH {_EDGES} SELECT * FROM e",
    "max_authors_edgelist": f"WITH {_EDGES} SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY PaperId) <= 3",
    "coauthor_projection": f"WITH {_PROJ} SELECT src AS AuthorId_1, dst AS AuthorId_2, round(weight, 6) AS weight FROM pr",
    "coauthor_npubs": f"WITH {_EDGES} SELECT AuthorId, count(*) AS n_pubs FROM e GROUP BY 1",
    "strong_coauthors": f"WITH {_DOMAIN}, pubs AS (SELECT AuthorId, count(*) AS n FROM e GROUP BY 1), w AS (SELECT src, dst, weight FROM pr UNION ALL SELECT dst, src, weight FROM pr), ra AS (SELECT src, dst, round(weight / n, 9) AS ratio FROM w JOIN pubs ON src = AuthorId) SELECT src AS AuthorId, dst AS coauthor FROM ra WHERE ratio >= {STRONG_COAUTHOR}",
    "bfs_ring": f"WITH RECURSIVE {_HEAVY}, walk AS (SELECT max(dst) AS id, 0 AS distance FROM h UNION SELECT bw.dst, distance + 1 FROM walk JOIN bw ON walk.id = bw.src WHERE distance < 8) SELECT id, CAST(min(distance) AS INT) AS distance FROM walk GROUP BY id HAVING min(distance) >= 3 AND min(distance) < 6",
    "connected_components": f"WITH RECURSIVE {_HEAVY}, reach AS (SELECT src AS id, src AS other FROM bw UNION SELECT reach.id, bw.dst FROM reach JOIN bw ON reach.other = bw.src) SELECT id, min(other) AS component FROM reach GROUP BY id",
    "ego_neighbours": f"WITH {_HEAVY} SELECT x.src AS ego, h.src, h.dst FROM h JOIN bw x ON x.dst = h.src JOIN bw y ON y.dst = h.dst AND x.src = y.src",
    "author_term_matrix": f"WITH {_SC}, {st.SQL_TERMS} SELECT AuthorId, term_id, round(sum(score * n), 5) AS value FROM sc JOIN (SELECT PaperId, term_id, count(*) AS n FROM terms WHERE label = 'Task' GROUP BY ALL) t USING (PaperId) GROUP BY ALL",
    "author_avg_embedding": f"WITH {_SC}, {st.SQL_TERMS}, {_EV}, w AS (SELECT AuthorId, term_id, sum(score * k) AS value FROM sc JOIN (SELECT PaperId, term_id, count(*) AS k FROM terms WHERE label = 'Method' GROUP BY ALL) t USING (PaperId) GROUP BY ALL) SELECT AuthorId, i, round(avg(x * value), 5) AS x FROM w, nv, ev WHERE ev.vec_id = term_id % nv.n GROUP BY ALL",
    "author_avg_paper_vector": f"WITH {_SC}, {_EV} SELECT AuthorId, i, round(avg(x * score), 5) AS x FROM sc, nv, ev WHERE ev.vec_id = PaperId % nv.n GROUP BY ALL",
    "focal_cosine": f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT v FROM v WHERE vec_id = 0) SELECT a.vec_id, a.label, round(greatest(0, {_COSINE}), 6) AS distance FROM v a, f",
    "nearest_terms_to_focal": f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT v FROM v WHERE label = 0), m AS (SELECT a.vec_id, min({_COSINE}) AS distance FROM v a, f WHERE a.label <> 0 GROUP BY 1) SELECT vec_id AS term_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY round(distance, 9), vec_id) AS rank FROM m QUALIFY row_number() OVER (ORDER BY round(distance, 9), vec_id) <= 25",
    "similarity_graph": "WITH t AS (SELECT label, CAST(vec_id AS VARCHAR) AS term, CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id * 7919 % 1009 DESC, CAST(vec_id AS VARCHAR)) <= 1000), p AS (SELECT a.label, a.term AS term_1, b.term AS term_2, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM t a JOIN t b ON a.label = b.label AND a.term < b.term), q AS (SELECT *, min(d) OVER (PARTITION BY label) AS lo, max(d) OVER (PARTITION BY label) AS hi FROM p WHERE d > 0) SELECT label, term_1, term_2, round(1 - CASE WHEN hi = lo THEN 0 ELSE (d - lo) / (hi - lo) END, 6) AS similarity FROM q",
    "strategy_comparison": f"WITH {_SC}, {st.SQL_TERMS}, t AS (SELECT AuthorId, term_display, round(sum(score), 5) AS relevance, count(*) AS freq FROM terms JOIN sc USING (PaperId) WHERE label = 'Task' GROUP BY ALL), ra AS (SELECT AuthorId, term_display, row_number() OVER (PARTITION BY AuthorId ORDER BY relevance DESC, term_display) AS rank FROM t), fa AS (SELECT AuthorId, term_display, row_number() OVER (PARTITION BY AuthorId ORDER BY freq DESC, term_display) AS rank FROM t) SELECT AuthorId, rank, ra.term_display AS relevance, fa.term_display AS frequency FROM ra JOIN fa USING (AuthorId, rank) WHERE rank <= 5",
}
