"""The core question: who works on similar tasks with different methods?"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholark.constants import CANDIDATE_PAPERS, RANK_POOL, STRONG_COAUTHOR, YEARS
from scholark.functions.scores import author_paper_scores
from scholark.operators.graph import coauthors as co
from scholark.operators.relational import year_window
from scholark.plans import recommend as rc
from scholark.plans import domain as st
from scholark.session import cut_lineage
from scholark.sources import tables as source

FOCAL, TOP = 2000000017, 10


def focal_table(spark: SparkSession, d: str, paper_distance: bool = False, author: int = FOCAL) -> DataFrame:
    """Distances of all candidates from the focal author, its strong co-authors and itself excluded."""
    # Scores feed seven branches of the plan; written once, they are read from columns instead of recomputed.
    scored = cut_lineage(author_paper_scores(year_window(st.scored_authorship(spark, d), *YEARS)).select("PaperId", "AuthorId", "score"))
    terms, vectors = st.term_rows(spark, d), st.term_vectors(spark, d)
    focal = scored.where(F.col("AuthorId") == author).select(F.col("AuthorId").alias("collection_id"), "PaperId", F.col("score").alias("relevance_score"))
    parts = []
    for label, name in (("Task", "task_dist"), ("Method", "method_dist")):
        authors = rc.author_term_vectors(rc.author_term_scores(scored, terms, label), vectors)
        parts.append(rc.distances(rc.focal_term_vectors(focal, terms, vectors, label), authors, name))
    if paper_distance:
        vectors = st.paper_vectors(spark, d)
        parts.append(rc.distances(rc.focal_paper_vectors(focal, vectors), rc.author_paper_vectors(scored, vectors), "paper_dist"))
    edges = scored.select("PaperId", "AuthorId")
    pubs = co.publications(edges)
    near = co.coauthors_of(edges, focal.select("collection_id").distinct())
    strong = near.where(F.round("ratio", 9) >= STRONG_COAUTHOR).select(F.col("AuthorId").alias("collection_id"), F.col("coauthor").alias("AuthorId"))
    excluded = strong.unionByName(focal.select("collection_id", F.col("collection_id").alias("AuthorId")).distinct())
    return rc.candidate_table(parts, pubs.withColumnRenamed("n_pubs", "paper_count"), pubs, excluded)


def recommend_for(spark: SparkSession, d: str, author: int, method: str = "ST", top: int = TOP, exclude: Sequence[int] = ()) -> DataFrame:
    """``AuthorId``, ``name``, ``task_dist``, ``method_dist``, ``rank`` of an author's ``top`` recommendations by ``ST`` (similar tasks) or
    ``sTdM`` (similar tasks, distant methods). An author without papers in the window gets no row."""
    table = focal_table(spark, d, author=author)
    if exclude:
        table = table.where(~F.col("AuthorId").isin(list(exclude)))
    chosen = rc.select_similar(table, {"ST": "simTask", "sTdM": "simTask_distMethod"}[method]).where(F.col("rank") <= top)
    names = source.table(spark, d, "authors").groupBy("AuthorId").agg(F.min("DisplayName").alias("name"))
    return chosen.join(names, "AuthorId", "left").select("AuthorId", "name", "task_dist", "method_dist", "rank").orderBy("rank")


def _ranked(condition: str, spark: SparkSession, d: str, pool: int | str = RANK_POOL) -> DataFrame:
    near, far = rc.CONDITIONS[condition]
    table = focal_table(spark, d, near == "paper_dist")
    table = table.select("collection_id", "AuthorId", *[F.round(c, 6).alias(c) for c in table.columns if c.endswith("_dist")])
    chosen = rc.select_similar(table, condition, pool).where(F.col("rank") <= TOP)
    return chosen.select("AuthorId", F.col("rank").cast("bigint").alias("rank"), *[c for c in (near, far) if c])


sim_task = partial(_ranked, "simTask")
sim_method = partial(_ranked, "simMethod")
sim_specter = partial(_ranked, "simspecter")
sim_task_dist_method = partial(_ranked, "simTask_distMethod")
sim_method_dist_task = partial(_ranked, "simMethod_distTask")
sim_task_dist_method_half = partial(_ranked, "simTask_distMethod", pool="half")


def sim_authors_exclusive(spark: SparkSession, d: str) -> DataFrame:
    """Four authors a condition, none twice, conditions in a fixed order."""
    table = focal_table(spark, d)
    table = cut_lineage(table.select("collection_id", "AuthorId", *[F.round(c, 6).alias(c) for c in table.columns if c.endswith("_dist")]))
    return rc.select_exclusive(table, ["simTask", "simMethod", "simTask_distMethod"], 4).select("condition", "AuthorId", F.col("rank").cast("bigint").alias("rank"))


def eval_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    """How well each author's nearest authors by paper vector hit its co-authors: every author a query."""
    scored = author_paper_scores(year_window(st.scored_authorship(spark, d), *YEARS)).select("PaperId", "AuthorId", "score")
    vectors = rc.author_paper_vectors(scored, st.paper_vectors(spark, d))
    asked = vectors.where(F.col("AuthorId") % 50 == 0).select(F.col("AuthorId").alias("collection_id"), "embedding")
    near = rc.distances(asked, vectors, "paper_dist").where("collection_id <> AuthorId").withColumn("paper_dist", F.round("paper_dist", 6))
    ranked = rc.select_similar(near, "simspecter", 1000).select(F.col("collection_id").alias("query"), "AuthorId", "rank")
    strong = co.coauthors_of(scored.select("PaperId", "AuthorId"), asked.select("collection_id")).where(F.round("ratio", 9) >= STRONG_COAUTHOR)
    truth = strong.select(F.col("AuthorId").alias("query"), F.col("coauthor").alias("AuthorId"))
    return rc.evaluation(ranked, truth).select(F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"), "n_queries")


QUERIES = {"sim_task": sim_task, "sim_method": sim_method, "sim_specter": sim_specter, "sim_task_dist_method": sim_task_dist_method, "sim_method_dist_task": sim_method_dist_task, "sim_task_dist_method_half": sim_task_dist_method_half, "sim_authors_exclusive": sim_authors_exclusive, "eval_hit_mrr": eval_hit_mrr}

_COS = "greatest(0, least(2, CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(f.v, f.v) = 0 THEN 1 ELSE 1 - list_dot_product(a.v, f.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(f.v, f.v)) END))"
_BASE = f"""WITH {st.SQL_PAPERS}, {st.SQL_AUTHORSHIP}, {st.SQL_RANKED}, {st.SQL_POSITIONS}, {st.SQL_SCORED}, {st.SQL_TERMS},
    win AS (SELECT * FROM scored WHERE Yr >= {YEARS[0]} AND Yr < {YEARS[1]}), b AS (SELECT min(rank_scaled) AS lo, max(rank_scaled) AS hi FROM win),
    sc AS (SELECT PaperId, AuthorId, mult * CASE WHEN hi = lo THEN 0.5 ELSE 0.5 + 0.5 * (rank_scaled - lo) / (hi - lo) END AS score FROM win, b),
    nv AS (SELECT count(*) AS n FROM embeddings), ev AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"""


def _term_distance(label: str, name: str) -> str:
    n = name
    return f""", w_{n} AS (SELECT AuthorId, term_id, sum(score * k) AS value FROM sc JOIN (SELECT PaperId, term_id, count(*) AS k FROM terms WHERE label = '{label}' GROUP BY ALL) t USING (PaperId) GROUP BY ALL),
    a_{n} AS (SELECT AuthorId, list(m ORDER BY i) AS v FROM (SELECT AuthorId, i, avg(x * value) AS m FROM w_{n}, nv, ev WHERE ev.vec_id = term_id % nv.n GROUP BY ALL) GROUP BY 1),
    f_{n} AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM (SELECT term_id FROM terms JOIN sc USING (PaperId) WHERE label = '{label}' AND AuthorId = {FOCAL}) t, nv, ev WHERE ev.vec_id = term_id % nv.n GROUP BY i)),
    {n} AS (SELECT AuthorId, round({_COS}, 6) AS {n} FROM a_{n} a, f_{n} f)"""


_PAPER = f""", ap AS (SELECT AuthorId, list(m ORDER BY i) AS v FROM (SELECT AuthorId, i, avg(x * score) AS m FROM sc, nv, ev WHERE ev.vec_id = PaperId % nv.n GROUP BY ALL) GROUP BY 1)
    , paper_dist AS (SELECT a.AuthorId, round({_COS}, 6) AS paper_dist FROM ap a, (SELECT v FROM ap WHERE AuthorId = {FOCAL}) f)"""
_EXCLUDED = f""", e AS (SELECT DISTINCT PaperId, AuthorId FROM sc), pubs AS (SELECT AuthorId, count(*) AS n_pubs FROM e GROUP BY 1), sz AS (SELECT PaperId, count(*) AS d FROM e GROUP BY 1 HAVING count(*) > 1),
    bw AS (SELECT x.AuthorId AS src, y.AuthorId AS dst, sum(1.0 / (d - 1)) AS weight FROM e x JOIN e y ON x.PaperId = y.PaperId AND x.AuthorId <> y.AuthorId JOIN sz ON sz.PaperId = x.PaperId WHERE x.AuthorId = {FOCAL} OR x.AuthorId % 50 = 0 GROUP BY ALL),
    ra AS (SELECT src, dst, round(weight / n_pubs, 9) AS ratio FROM bw JOIN pubs ON src = AuthorId),
    st AS (SELECT dst FROM ra WHERE src = {FOCAL} AND ratio >= {STRONG_COAUTHOR}), ok AS (SELECT AuthorId FROM pubs WHERE n_pubs >= {CANDIDATE_PAPERS} AND AuthorId <> {FOCAL} AND AuthorId NOT IN (SELECT dst FROM st))"""
_TWO = _term_distance("Task", "task_dist") + _term_distance("Method", "method_dist")
_TABLE = ", tb AS (SELECT coalesce(t.AuthorId, m.AuthorId) AS AuthorId, task_dist, method_dist FROM task_dist t FULL JOIN method_dist m ON t.AuthorId = m.AuthorId), c AS (SELECT * FROM tb WHERE AuthorId IN (SELECT AuthorId FROM ok))"


HALF = "(SELECT CAST(ceil(count(*) / 2.0) AS BIGINT) FROM c)"


def _two_stage(near: str, far: str | None, source: str = "c", name: str = "", pool: int | str = RANK_POOL) -> str:
    order = f"{far} DESC NULLS LAST, {near} NULLS LAST, AuthorId" if far else f"{near} NULLS LAST, AuthorId"
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank{name} FROM (SELECT * FROM {source} ORDER BY {near} NULLS LAST, AuthorId LIMIT {pool})"


def _oracle(near: str, far: str | None, pool: int | str = RANK_POOL) -> str:
    columns = ", ".join(["AuthorId", "rank", near, *([far] if far else [])])
    if near == "paper_dist":
        return _BASE + _TWO + _PAPER + _EXCLUDED + f", c AS (SELECT * FROM paper_dist WHERE AuthorId IN (SELECT AuthorId FROM ok)) SELECT {columns} FROM ({_two_stage(near, far, pool=pool)}) WHERE rank <= 10"
    return _BASE + _TWO + _EXCLUDED + _TABLE + f" SELECT {columns} FROM ({_two_stage(near, far, pool=pool)}) WHERE rank <= 10"


ORACLES = {
    "sim_task": _oracle("task_dist", None),
    "sim_method": _oracle("method_dist", None),
    "sim_specter": _oracle("paper_dist", None),
    "sim_task_dist_method": _oracle("task_dist", "method_dist"),
    "sim_method_dist_task": _oracle("method_dist", "task_dist"),
    "sim_task_dist_method_half": _oracle("task_dist", "method_dist", HALF),
    "sim_authors_exclusive": _BASE + _TWO + _EXCLUDED + _TABLE + f""", r1 AS ({_two_stage('task_dist', None)}), x1 AS (SELECT AuthorId, row_number() OVER (ORDER BY rank) AS rank FROM r1 QUALIFY row_number() OVER (ORDER BY rank) <= 4),
        r2 AS ({_two_stage('method_dist', None)}), x2 AS (SELECT AuthorId, row_number() OVER (ORDER BY rank) AS rank FROM r2 WHERE AuthorId NOT IN (SELECT AuthorId FROM x1) QUALIFY row_number() OVER (ORDER BY rank) <= 4),
        r3 AS ({_two_stage('task_dist', 'method_dist')}), x3 AS (SELECT AuthorId, row_number() OVER (ORDER BY rank) AS rank FROM r3 WHERE AuthorId NOT IN (SELECT AuthorId FROM x1 UNION SELECT AuthorId FROM x2) QUALIFY row_number() OVER (ORDER BY rank) <= 4)
        SELECT 'simTask' AS condition, AuthorId, rank FROM x1 UNION ALL SELECT 'simMethod', AuthorId, rank FROM x2 UNION ALL SELECT 'simTask_distMethod', AuthorId, rank FROM x3""",
    "eval_hit_mrr": _BASE + _PAPER.split(", paper_dist AS")[0] + _EXCLUDED + f""", near AS (SELECT f.AuthorId AS query, a.AuthorId, round({_COS}, 6) AS dist FROM ap a, ap f WHERE f.AuthorId % 50 = 0 AND a.AuthorId <> f.AuthorId),
        rk AS (SELECT query, AuthorId, row_number() OVER (PARTITION BY query ORDER BY dist, AuthorId) AS rank FROM near QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, AuthorId) <= 1000),
        tr AS (SELECT DISTINCT src AS query, dst AS AuthorId FROM ra WHERE src % 50 = 0 AND ratio >= {STRONG_COAUTHOR} AND src IN (SELECT AuthorId FROM ap)),
        best AS (SELECT query, min(rank) AS best FROM tr JOIN rk USING (query, AuthorId) GROUP BY 1), q AS (SELECT DISTINCT query FROM tr)
        SELECT round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k, round(avg(coalesce(1.0 / best, 0.0)), 6) AS mrr, count(*) AS n_queries FROM q LEFT JOIN best USING (query)""",
}
