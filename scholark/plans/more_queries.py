"""Queries for term extraction, embedding tables, clusters, whole runs, cards and study facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholark.constants import LABELS, METHOD_WORDS, PREFIXES, STRONG_COAUTHOR, SUFFIXES, TASK_WORDS, YEARS
from scholark.corpus import Corpus
from scholark.functions import text
from scholark.functions.scores import author_positions, minmax, tfidf
from scholark.operators import embeddings as em
from scholark.operators import extraction as ex
from scholark.operators import ranking as rk
from scholark.operators import relational as rel
from scholark.operators import terms as tm
from scholark.operators import tfidf as ti
from scholark.operators.graph import clusters as cl
from scholark.operators.graph import coauthors as co
from scholark.plans import cards as cd
from scholark.plans import core_queries as cq
from scholark.plans import domain as dm
from scholark.plans import flagship as fl
from scholark.plans import graph_queries as gq
from scholark.plans import recommend as rc
from scholark.plans import runs
from scholark.plans import standin as st
from scholark.plans import study
from scholark.session import cut_lineage
from scholark.sources import writers
from scholark.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name with the SQL that must give the same rows."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


# Text

_LEMMA = """array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), lambda t: CASE WHEN length(t) <= 3 THEN t WHEN regexp_matches(t, 'ies$') THEN regexp_replace(t, 'ies$', 'y')
    WHEN regexp_matches(t, '(ss|sh|ch|x|z)es$') THEN regexp_replace(t, 'es$', '') WHEN regexp_matches(t, '[^sui]s$') THEN regexp_replace(t, 's$', '') ELSE t END), ' ')"""


@query(f"SELECT DISTINCT term_cleaned, {_LEMMA.format('term_cleaned')} AS normal FROM df_ner WHERE term_cleaned IS NOT NULL")
def normal_forms(spark, d):
    return table(spark, d, "df_ner").where("term_cleaned is not null").select("term_cleaned", ex.normal_form(F.col("term_cleaned")).alias("normal")).distinct()


_STOPS = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(ex.STOP_WORDS)) + "]"
_CANDIDATES = f"""runs AS (SELECT PaperId, unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}\\s-]+')) AS run FROM paper WHERE title IS NOT NULL),
    toks AS (SELECT PaperId, list_filter(regexp_split_to_array(trim(run), '\\s+'), lambda t: length(t) > 0) AS ts FROM runs),
    grams AS (SELECT PaperId, ts[i : i + n - 1] AS g FROM (SELECT PaperId, ts, n, unnest(range(1, len(ts) - n + 2)) AS i FROM toks, (SELECT unnest([2, 3, 4]) AS n) WHERE len(ts) >= n)),
    cand AS (SELECT DISTINCT PaperId, array_to_string(g, ' ') AS term FROM grams WHERE NOT list_has_any(g, {_STOPS}) AND len(list_filter(g, lambda t: regexp_matches(t, '^[0-9-]+$'))) = 0)"""
_SIGNS = " OR ".join([f"contains(term, '{w}')" for w in dict.fromkeys([*METHOD_WORDS, *TASK_WORDS])] + [f"ends_with(term, '{x}')" for x in SUFFIXES] + [f"starts_with(term, '{x}')" for x in PREFIXES] + ["regexp_matches(term, '[0-9]|[A-Z]{2,}')"])
_CLASSED = tm.sql_weighted(f"WITH {_CANDIDATES} SELECT DISTINCT term, context, PaperId FROM (SELECT * FROM cand WHERE {_SIGNS}) JOIN (SELECT PaperId, min(lower(title)) AS context FROM paper WHERE title IS NOT NULL GROUP BY 1) c USING (PaperId)").replace("SELECT term, context,", "SELECT PaperId, term, context,")


@query(f"WITH {_CANDIDATES} SELECT * FROM cand")
def title_candidates(spark, d):
    """Runs of two to four words of each title without a stop word."""
    return ex.candidates(table(spark, d, "paper"), "PaperId", "title")


@query(f'SELECT PaperId, term, class FROM ({_CLASSED})')
def text_terms(spark, d):
    """Terms of each title with their class."""
    return ex.extract_terms(table(spark, d, "paper"), "PaperId", "title")


@query(f"""WITH tt AS (SELECT PaperId, term, class FROM ({_CLASSED})), {dm.SQL_AUTHORSHIP}, att AS (SELECT AuthorId, class, count(DISTINCT term) AS n_terms FROM paa JOIN tt USING (PaperId) GROUP BY ALL)
    SELECT class, count(*) AS n_authors, CAST(sum(n_terms) AS BIGINT) AS n_terms, round(count(*) / (SELECT count(DISTINCT AuthorId) FROM authors), 6) AS share FROM att GROUP BY 1""")
def author_term_coverage(spark, d):
    counts = ex.author_terms(text_terms(spark, d), dm.authorship(spark, d))
    return ex.coverage(counts, table(spark, d, "authors").select("AuthorId")).withColumn("share", F.round("share", 6))


@query()
def aligned_abbreviations(spark, d):
    """Abbreviations of each paper's raw terms with the long forms they align with."""
    return ex.abbreviations(table(spark, d, "df_ner").select("s2_id", "term").distinct(), "s2_id", "term")


@query("""WITH w AS (SELECT DISTINCT PaperId, title, abstract FROM paper) SELECT PaperId, CASE WHEN coalesce(length(abstract), 0) = 0 THEN coalesce(title, '') ELSE coalesce(title, '') || '. ' || abstract END AS text,
    regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM w""")
def title_texts(spark, d):
    """Title and abstract of each paper as one text, and a file name from the title."""
    rows = table(spark, d, "paper").select("PaperId", "title", "abstract").distinct()
    return rows.select("PaperId", text.join_title_abstract(F.col("title"), F.col("abstract")).alias("text"), text.slug(F.col("title")).alias("slug"))


@query("""SELECT persona_id, split_part(persona_id, '_', 1) AS author FROM persona_embeddings WHERE CAST(split_part(persona_id, '_', 1) AS BIGINT) % 7 = 0""")
def persona_filter(spark, d):
    """Personas of the evaluated authors, by the author part of their key."""
    asked = table(spark, d, "authors").where("AuthorId % 7 = 0").select(F.col("AuthorId").cast("string"))
    personas = table(spark, d, "persona_embeddings").select("persona_id")
    known = personas.select(text.id_part(F.col("persona_id"), "_").alias("a")).where("cast(a as bigint) % 7 = 0")
    return runs.of_authors(personas, "persona_id", asked.union(known), "_").select("persona_id", text.id_part(F.col("persona_id"), "_").alias("author"))


@query("SELECT max(contains(persona_id, '_')) AS persona_mode FROM persona_embeddings")
def persona_mode(spark, d):
    return runs.has_personas(table(spark, d, "persona_embeddings"), "persona_id", "_")


# Relational rules


@query("SELECT AuthorId FROM (SELECT DISTINCT AuthorId FROM authors) ORDER BY md5(AuthorId || '-7'), AuthorId LIMIT 100")
def hash_sample_authors(spark, d):
    """A sample of a hundred authors that only the seed decides."""
    return rel.hash_sample(table(spark, d, "authors").select("AuthorId").distinct(), "AuthorId", 100, 7)


@query("SELECT DISTINCT PaperId FROM paper WHERE contains(abstract, 'the') AND contains(abstract, 'records')")
def contains_all_terms(spark, d):
    return rel.contains_all(table(spark, d, "paper"), "abstract", ["the", "records"]).select("PaperId").distinct()


@query("SELECT DISTINCT PaperId, DocType FROM paper WHERE DocType <> ''")
def not_empty_types(spark, d):
    return rel.not_empty(table(spark, d, "paper"), "DocType").select("PaperId", "DocType").distinct()


@query("SELECT persona_id, num_papers, max(num_papers) OVER (PARTITION BY author_id) AS num_papers_overall FROM (SELECT DISTINCT author_id, persona_id, num_papers FROM persona_embeddings) QUALIFY max(num_papers) OVER (PARTITION BY author_id) > 5")
def overall_papers(spark, d):
    """Personas of authors with more than five papers in their largest persona."""
    rows = table(spark, d, "persona_embeddings").select("author_id", "persona_id", "num_papers").distinct()
    return rel.high_pass(rel.with_group_max(rows, ["author_id"], "num_papers", "num_papers_overall")).select("persona_id", "num_papers", "num_papers_overall")


@query("SELECT AuthorId FROM tfidf_dfs WHERE AuthorId IS NOT NULL GROUP BY 1 HAVING count(DISTINCT term_id) > 10 AND count(DISTINCT term_display) > 10")
def enough_terms(spark, d):
    rows = table(spark, d, "tfidf_dfs").where("AuthorId is not null").groupBy("AuthorId").agg(F.collect_set("term_id").alias("a"), F.collect_set("term_display").alias("b"))
    return rel.enough_data(rows, ["a", "b"]).select("AuthorId")


@query("""WITH r AS (SELECT term_id, term_display, tfidf_score, AuthorId FROM tfidf_dfs WHERE tfidf_score IS NOT NULL AND NOT isnan(tfidf_score) AND term_display IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY tfidf_score DESC, AuthorId, term_display) = 1)
    SELECT term_id, term_display, tfidf_score FROM r ORDER BY tfidf_score DESC, AuthorId, term_display LIMIT 10""")
def best_term_rows(spark, d):
    """The ten best terms over all authors, each once."""
    rows = table(spark, d, "tfidf_dfs").where("tfidf_score is not null and not isnan(tfidf_score) and term_display is not null")
    return rel.first_rows(rows, "term_id", [F.desc("tfidf_score"), F.col("AuthorId"), F.col("term_display")], 10).select("term_id", "term_display", "tfidf_score")


_PRIORITY = ("Task", "Method", "Material", "Metric")


@query(f"""WITH g AS (SELECT s2_id, label, term_cleaned, min(chunk_id) AS place FROM df_ner WHERE term_cleaned IS NOT NULL AND s2_id IS NOT NULL AND label IN {_PRIORITY} GROUP BY ALL)
    SELECT s2_id, label, term_cleaned FROM g QUALIFY row_number() OVER (PARTITION BY s2_id, lower(term_cleaned) ORDER BY list_position({list(_PRIORITY)}, label), place, term_cleaned) = 1""")
def cascaded_terms(spark, d):
    """Terms of each paper that no label of higher priority holds."""
    rows = table(spark, d, "df_ner").where("s2_id is not null").groupBy("s2_id", "label", "term_cleaned").agg(F.min("chunk_id").alias("place"))
    return rel.cascade_terms(rows, ["s2_id"], "term_cleaned", "label", "place", _PRIORITY).select("s2_id", "label", "term_cleaned")


@query("""SELECT 'in' AS side, count(*) AS n FROM paper_author_affiliations WHERE AuthorId IN (SELECT AuthorId FROM authors)
    UNION ALL SELECT 'out', count(*) FROM paper_author_affiliations WHERE AuthorId IS NULL OR AuthorId NOT IN (SELECT AuthorId FROM authors)""")
def known_authors(spark, d):
    """Rows whose author is in the table of authors, and those whose isn't, null ones included."""
    rows, known = table(spark, d, "paper_author_affiliations").select("AuthorId"), table(spark, d, "authors").select("AuthorId")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n") for side, df in (("in", rel.in_list(rows, known, "AuthorId")), ("out", rel.not_in_list(rows, known, "AuthorId")))]
    return parts[0].unionByName(parts[1])


# Ranking of terms


@query("""WITH t AS (SELECT DISTINCT AuthorId, term_display FROM tfidf_dfs WHERE AuthorId IS NOT NULL AND term_display IS NOT NULL)
    SELECT AuthorId, term_display FROM t QUALIFY row_number() OVER (PARTITION BY AuthorId ORDER BY md5(term_display || '-3'), term_display) <= 5""")
def random_terms(spark, d):
    """Five terms of each author in an order that only the seed decides."""
    rows = table(spark, d, "tfidf_dfs").where("AuthorId is not null and term_display is not null").select("AuthorId", "term_display").distinct()
    place = F.row_number().over(Window.partitionBy("AuthorId").orderBy(rel.hash_order("term_display", 3), "term_display"))
    return rows.withColumn("r", place).where("r <= 5").drop("r")


@query("""WITH t AS (SELECT DISTINCT AuthorId, trim(term_display) AS term_display FROM tfidf_dfs WHERE AuthorId IS NOT NULL AND term_display IS NOT NULL AND term_display NOT IN (SELECT term_display FROM tfidf_dfs WHERE term_display IS NOT NULL GROUP BY 1 HAVING count(*) > 100)),
    r AS (SELECT AuthorId, term_display, row_number() OVER (PARTITION BY AuthorId ORDER BY term_display) AS rank FROM t) SELECT * FROM r""")
def cleaned_term_lists(spark, d):
    """Terms of each author without stop terms (here: those in over a hundred rows), trimmed, each once, ranks closed up."""
    rows = table(spark, d, "tfidf_dfs").where("AuthorId is not null and term_display is not null")
    stop = rows.groupBy("term_display").agg(F.count(F.lit(1)).alias("n")).where("n > 100").select("term_display")
    ranked = rk.without_stop_terms(rows.select("AuthorId", "term_display").distinct(), stop).withColumn("rank", F.lit(1))
    return rk.clean_list(ranked, "AuthorId")


_AUTHOR_TERMS = f"WITH {st.SQL_AUTHORSHIP}, {st.SQL_TERMS}, rows AS (SELECT DISTINCT AuthorId, term_id FROM terms JOIN paa USING (PaperId) WHERE label = 'Method')"


@query(_AUTHOR_TERMS + """, idf AS (SELECT term_id, ln((1 + (SELECT count(DISTINCT AuthorId) FROM rows)) / (1.0 + count(DISTINCT AuthorId))) + 1 AS idf FROM rows GROUP BY 1),
    c AS (SELECT DISTINCT s_nationkey AS collection_id, term_id FROM rows JOIN supplier ON AuthorId = s_suppkey), w AS (SELECT collection_id, term_id, idf / sqrt(sum(idf * idf) OVER (PARTITION BY collection_id)) AS v FROM c JOIN idf USING (term_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY round(v, 9) DESC, term_id) AS rank FROM w) SELECT collection_id, term_id, round(v, 6) AS tfidf_score, rank FROM r WHERE rank <= 20""")
def collection_tfidf_terms(spark, d):
    """The twenty best Method terms of each nation's authors as one collection, by stored idf."""
    rows = st.term_rows(spark, d).where("label = 'Method'").join(st.authorship(spark, d).select("PaperId", "AuthorId"), "PaperId").select("AuthorId", "term_id").distinct()
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("AuthorId"), F.col("s_nationkey").alias("collection_id"))
    return ti.collection_tfidf(rows.join(nations, "AuthorId"), ti.inverse_frequencies(rows), 20).withColumn("tfidf_score", F.round("tfidf_score", 6))


@query(_AUTHOR_TERMS + " SELECT AuthorId, string_agg(CAST(term_id AS VARCHAR), ' ' ORDER BY term_id) AS terms FROM rows GROUP BY 1")
def author_term_text(spark, d):
    rows = st.term_rows(spark, d).where("label = 'Method'").join(st.authorship(spark, d).select("PaperId", "AuthorId"), "PaperId").select("AuthorId", "term_id").distinct()
    return tm.concat_terms(rows, "AuthorId", "term_id")


@query("""WITH r AS (SELECT s2_id, term_normalized AS term, sum(softmax_score) AS tf FROM (SELECT DISTINCT s2_id, chunk_id, label, term_normalized, softmax_score FROM df_ner WHERE label = 'Task' AND s2_id IS NOT NULL AND term_normalized IS NOT NULL AND softmax_score IS NOT NULL) GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM r GROUP BY 1) SELECT s2_id, term, round(ln(1 + tf) * ln((SELECT count(DISTINCT s2_id) FROM r) / df), 5) AS tfidf FROM r JOIN d USING (term)""")
def collection_relevance_tfidf(spark, d):
    """Tf-idf of the Task terms of each paper with the summed score as term frequency."""
    rows = table(spark, d, "df_ner").where("label = 'Task' and s2_id is not null and term_normalized is not null and softmax_score is not null").select("s2_id", "chunk_id", "label", "term_normalized", "softmax_score").distinct()
    tf = rows.groupBy("s2_id", F.col("term_normalized").alias("term")).agg(F.sum("softmax_score").alias("tf"))
    df, n = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), tf.agg(F.countDistinct("s2_id").alias("n"))
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select("s2_id", "term", F.round(tfidf(F.col("tf"), F.col("df"), F.col("n")), 5).alias("tfidf"))


# Embedding tables


def _term_table(spark, d):
    """Vectors of two thirds of the terms, some of them twice."""
    terms = table(spark, d, "df_ner").where("term_normalized is not null").select("term_normalized", F.conv(F.substring(F.md5("term_normalized"), 1, 6), 16, 10).cast("bigint").alias("m")).distinct()
    rows = terms.where("m % 3 <> 0").select("term_normalized", F.array(F.lit(1.0), F.col("m").cast("double")).alias("embedding"))
    return em.append_vectors(rows, rows.select("term_normalized", F.array(F.lit(9.0), F.lit(9.0)).alias("embedding")), "term_normalized", "embedding")


@query(f"""WITH k AS (SELECT s2_id, label, term_normalized, count(*) AS freq FROM df_ner WHERE label IN {tuple(LABELS)} AND softmax_score >= 0.9 AND term_normalized <> '' AND s2_id IS NOT NULL GROUP BY ALL),
    u AS (SELECT DISTINCT term_normalized FROM k WHERE CAST('0x' || substr(md5(term_normalized), 1, 6) AS BIGINT) % 3 <> 0), i AS (SELECT term_normalized, dense_rank() OVER (ORDER BY term_normalized) - 1 AS embedding_term_id FROM u)
    SELECT k.*, embedding_term_id FROM k JOIN i USING (term_normalized)""")
def embedding_terms(spark, d):
    return em.finalize_embedding_terms(table(spark, d, "df_ner"), _term_table(spark, d))


@query("""SELECT DISTINCT term_normalized, CAST(1 AS DOUBLE) AS first, CAST(CAST('0x' || substr(md5(term_normalized), 1, 6) AS BIGINT) AS DOUBLE) AS second FROM df_ner
    WHERE term_normalized IS NOT NULL AND CAST('0x' || substr(md5(term_normalized), 1, 6) AS BIGINT) % 3 <> 0""")
def appended_vectors(spark, d):
    """A table of vectors to which known terms were added again: what was there wins."""
    return _term_table(spark, d).select("term_normalized", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


_VECTORS = "nv AS (SELECT count(*) AS n FROM embeddings), ev AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"


@query(f"WITH {st.SQL_AUTHORSHIP}, {st.SQL_TERMS}, {_VECTORS}, t AS (SELECT DISTINCT AuthorId, term_id FROM terms JOIN paa USING (PaperId) WHERE label = 'Task') SELECT AuthorId, i, round(avg(x), 5) AS x FROM t, nv, ev WHERE ev.vec_id = term_id % nv.n GROUP BY ALL")
def unique_term_vectors(spark, d):
    """Plain mean of the vectors of each author's different Task terms."""
    rows = st.term_rows(spark, d).where("label = 'Task'").join(st.authorship(spark, d), "PaperId").select("AuthorId", "term_id")
    means = em.unique_term_means(rows, st.term_vectors(spark, d), ["AuthorId"])
    return means.select("AuthorId", F.posexplode("embedding").alias("i", "x")).select("AuthorId", "i", F.round("x", 5).alias("x"))


@query(f"""WITH {dm.SQL_PAPERS}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT count(*) AS n FROM v)
    SELECT 1 AS collection_id, PaperId, round(greatest(0, 1 - list_dot_product(a.v, f.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(f.v, f.v))), 6) AS distance
    FROM papers, n, v a, (SELECT v FROM v WHERE vec_id = 0) f WHERE Yr = 2020 AND a.vec_id = PaperId % n.n""")
def paper_distances(spark, d):
    """Distance of the papers of one year from a focal vector."""
    papers = dm.papers(spark, d).where("Year = 2020").select(F.lit(1).alias("collection_id"), "PaperId")
    focal = table(spark, d, "embeddings").where("vec_id = 0").select(F.lit(1).alias("collection_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return em.distances_to(papers, dm.paper_vectors(spark, d), focal).withColumn("distance", F.round("distance", 6))


# Clusters


def _clusters(spark, d):
    """Authors by their last known affiliation as clusters."""
    return table(spark, d, "authors").where("LastKnownAffiliationId is not null").groupBy("AuthorId").agg(F.min("LastKnownAffiliationId").alias("cluster")).select("cluster", "AuthorId")


def _ranks(spark, d):
    return _clusters(spark, d).withColumn("pagerank", F.lit(1.0) / (1 + F.col("AuthorId") % 7))


_CLUSTERS = "cl AS (SELECT AuthorId, min(LastKnownAffiliationId) AS cluster FROM authors WHERE LastKnownAffiliationId IS NOT NULL GROUP BY 1)"
_RANKS = f"{_CLUSTERS}, rk AS (SELECT *, 1.0 / (1 + AuthorId % 7) AS pagerank FROM cl)"
_POSITIONED = f"{dm.SQL_AUTHORSHIP}, pos AS (SELECT paa.*, max(seq) OVER (PARTITION BY PaperId) AS last FROM paa)"
_CLUSTER_PAPERS = f"{_RANKS}, {_POSITIONED}, cp AS (SELECT cluster, PaperId, avg(pagerank * CASE WHEN seq = 1 OR seq = last THEN 1.0 ELSE 0.75 END) AS relevance FROM pos JOIN rk USING (AuthorId) GROUP BY ALL HAVING count(*) > 1)"
_SCORES = "pl AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pagerank DESC, AuthorId) - 1 AS place, count(*) OVER (PARTITION BY cluster) AS n FROM rk), fs AS (SELECT cluster, coalesce(max((n - place) / n) FILTER (WHERE AuthorId % 50 = 0), 0) AS score FROM pl GROUP BY 1)"


@query(f"WITH {gq._HEAVY}, {_CLUSTERS} SELECT a.cluster, src, dst FROM h JOIN cl a ON a.AuthorId = src JOIN cl b ON b.AuthorId = dst AND a.cluster = b.cluster")
def induced_subgraphs(spark, d):
    return cl.induced_subgraphs(gq._graph(spark, d), _clusters(spark, d)).select("cluster", "src", "dst")


@query()
def cluster_pagerank(spark, d):
    return cl.cluster_pagerank(gq._graph(spark, d), _clusters(spark, d))


def _cluster_papers(spark, d):
    return cl.cluster_papers(author_positions(dm.authorship(spark, d)), _ranks(spark, d))


@query(f"WITH {_CLUSTER_PAPERS} SELECT cluster, PaperId, round(relevance, 6) AS relevance FROM cp")
def cluster_paper_relevance(spark, d):
    return _cluster_papers(spark, d).withColumn("relevance", F.round("relevance", 6))


@query(f"WITH {_RANKS}, {_SCORES} SELECT cluster, round(score, 6) AS score FROM fs")
def cluster_focal_scores(spark, d):
    focal = table(spark, d, "authors").where("AuthorId % 50 = 0").select("AuthorId")
    return cl.focal_scores(_ranks(spark, d), focal).withColumn("score", F.round("score", 6))


@query(f"""WITH {_CLUSTER_PAPERS}, {_SCORES}, nm AS (SELECT AuthorId, min(DisplayName) AS name FROM authors GROUP BY 1),
    au AS (SELECT cluster, count(*) AS n_authors, string_agg(name, '; ' ORDER BY place) FILTER (WHERE place < 5) AS authors FROM pl LEFT JOIN nm USING (AuthorId) GROUP BY 1), wk AS (SELECT cluster, count(*) AS n_papers FROM cp GROUP BY 1 HAVING count(*) >= 2)
    SELECT cluster, n_authors, n_papers, round(score, 6) AS score, coalesce(authors, '') AS authors FROM au JOIN wk USING (cluster) JOIN fs USING (cluster)""")
def cluster_cards(spark, d):
    focal = table(spark, d, "authors").where("AuthorId % 50 = 0").select("AuthorId")
    names = table(spark, d, "authors").groupBy("AuthorId").agg(F.min("DisplayName").alias("name"))
    cards = cl.cluster_cards(_ranks(spark, d), _cluster_papers(spark, d), focal, names)
    return cards.withColumn("score", F.round("score", 6)).withColumn("authors", F.array_join("authors", "; "))


# Whole runs

_POOR = f", poor AS (SELECT DISTINCT AuthorId FROM (SELECT AuthorId, label, count(DISTINCT (PaperId, term_id)) AS n FROM terms JOIN paa USING (PaperId) WHERE label IN ('Task', 'Method', 'Material') GROUP BY ALL) WHERE n < 10)"


def _excluded(spark, d):
    edges = rel.year_window(dm.authorship(spark, d).join(dm.papers(spark, d).select("PaperId", "Year"), "PaperId"), *YEARS).select("PaperId", "AuthorId")
    focal = spark.createDataFrame([(fl.FOCAL, fl.FOCAL)], "collection_id bigint, AuthorId bigint")
    strong = co.coauthors_of(edges, focal.select("AuthorId")).where(F.round("ratio", 9) >= STRONG_COAUTHOR).select(F.col("AuthorId").alias("collection_id"), F.col("coauthor").alias("AuthorId"))
    return runs.exclusion_set(focal, tm.insufficient_terms(dm.term_rows(spark, d), dm.authorship(spark, d)), strong)


@query(fl._BASE + fl._EXCLUDED + _POOR + f" SELECT {fl.FOCAL} AS collection_id, AuthorId FROM (SELECT AuthorId FROM poor UNION SELECT {fl.FOCAL} UNION SELECT dst FROM st)")
def exclusion_set(spark, d):
    """Authors that a run for the focal author leaves out."""
    return _excluded(spark, d)


@query(fl.ORACLES["sim_authors_exclusive"].replace(", c AS (SELECT * FROM tb WHERE AuthorId IN (SELECT AuthorId FROM ok))", _POOR + ", c AS (SELECT * FROM tb WHERE AuthorId IN (SELECT AuthorId FROM ok) AND AuthorId NOT IN (SELECT AuthorId FROM poor))"))
def author_run(spark, d):
    """The whole run for the focal author: four authors a condition, with all exclusions."""
    rows = fl.focal_table(spark, d)
    rows = cut_lineage(rows.select("collection_id", "AuthorId", *[F.round(c, 6).alias(c) for c in rows.columns if c.endswith("_dist")]))
    return runs.full_run(rows, _excluded(spark, d)).select("condition", "AuthorId", F.col("rank").cast("bigint").alias("rank"))


@query(fl._BASE + fl._TWO + fl._EXCLUDED + fl._TABLE + f" SELECT 'simTask' AS condition, AuthorId, rank FROM ({fl._two_stage('task_dist', None)}) WHERE rank <= 20 UNION ALL SELECT 'simTask_distMethod', AuthorId, rank FROM ({fl._two_stage('task_dist', 'method_dist')}) WHERE rank <= 20")
def run_distance_tables(spark, d):
    """The first twenty of two conditions for the focal author, each by itself."""
    rows = fl.focal_table(spark, d)
    rows = cut_lineage(rows.select("collection_id", "AuthorId", *[F.round(c, 6).alias(c) for c in rows.columns if c.endswith("_dist")]))
    return runs.distance_tables(rows, ["simTask", "simTask_distMethod"], 20).select("condition", "AuthorId", F.col("rank").cast("bigint").alias("rank"))


def _venues(spark, d):
    """What stands for venues: document type and year."""
    return table(spark, d, "paper").groupBy("PaperId").agg(F.min(F.concat_ws("-", "DocType", F.col("Year").cast("string"))).alias("venue"))


_VENUES = """ve AS (SELECT PaperId, min(concat_ws('-', DocType, CAST("Year" AS VARCHAR))) AS venue FROM paper GROUP BY 1)"""
_RATIOS = """ow AS (SELECT AuthorId, count(*) AS n, list(DISTINCT venue) AS vs FROM (SELECT DISTINCT PaperId, AuthorId FROM paa) JOIN ve USING (PaperId) GROUP BY 1 HAVING count(*) >= 3),
    ra AS (SELECT AuthorId, len(list_intersect(vs, f)) / len(list_distinct(list_concat(vs, f))) AS ratio FROM ow, fv)"""


@query(f"WITH {dm.SQL_AUTHORSHIP}, {_VENUES}, fv AS (SELECT list(DISTINCT venue) AS f FROM paa JOIN ve USING (PaperId) WHERE AuthorId = {fl.FOCAL}), {_RATIOS} SELECT AuthorId, round(ratio, 6) AS ratio FROM ra")
def venue_ratios(spark, d):
    """How many venues each author shares with the focal one."""
    rows, venues = dm.authorship(spark, d), _venues(spark, d)
    focal = rows.where(F.col("AuthorId") == fl.FOCAL).join(venues, "PaperId").select("venue")
    return runs.venue_ratios(rows, venues, focal).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH RECURSIVE {gq._HEAVY}, src AS (SELECT max(dst) AS s FROM h), walk AS (SELECT s AS id, 0 AS distance FROM src UNION SELECT bw.dst, distance + 1 FROM walk JOIN bw ON walk.id = bw.src WHERE distance < 5),
    ring AS (SELECT id AS AuthorId, CAST(min(distance) AS INT) AS distance FROM walk GROUP BY 1 HAVING min(distance) >= 3), {_VENUES}, fv AS (SELECT list(DISTINCT venue) AS f FROM paa JOIN ve USING (PaperId) WHERE AuthorId = (SELECT s FROM src)), {_RATIOS}
    SELECT AuthorId, distance, round(ratio, 6) AS ratio FROM ring JOIN ra USING (AuthorId) WHERE ratio >= 0.1 ORDER BY md5(AuthorId || '-1'), AuthorId LIMIT 5""")
def other_authors(spark, d):
    """Five authors at a middle distance from a focal one in the graph who share venues with it."""
    graph, rows, venues = gq._graph(spark, d), dm.authorship(spark, d), _venues(spark, d)
    focal = graph.agg(F.max("dst").alias("AuthorId"))
    shared = runs.venue_ratios(rows, venues, rows.join(focal, "AuthorId", "left_semi").join(venues, "PaperId").select("venue"))
    return runs.other_authors(graph, focal, focal.where("false"), shared, 5, 1, least=0.1).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {dm.SQL_AUTHORSHIP}, sh AS (SELECT PaperId FROM paa WHERE AuthorId % 7 = 0) SELECT PaperId, AuthorId, seq FROM paa WHERE AuthorId = {fl.FOCAL} AND PaperId IN (SELECT PaperId FROM sh)")
def persona_papers(spark, d):
    """Papers that the focal author shares with some others."""
    rows = dm.authorship(spark, d)
    members = table(spark, d, "authors").where("AuthorId % 7 = 0").select("AuthorId").union(rows.where("AuthorId % 7 = 0").select("AuthorId"))
    own = rows.where(F.col("AuthorId") == fl.FOCAL)
    shared = runs.shared_with(rows, members).select(F.lit(fl.FOCAL).alias("collection_id"), "PaperId")
    return runs.subset_weights(own.withColumn("collection_id", F.lit(fl.FOCAL)), shared).select("PaperId", "AuthorId", "seq")


# Cards


@query(f"""{_AUTHOR_TERMS}, tp AS (SELECT l_suppkey AS a, p_brand AS topic, round(sum(l_discount), 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 4 <> 0 GROUP BY ALL),
    t15 AS (SELECT a, string_agg(topic, ',' ORDER BY score DESC, topic) AS topics FROM (SELECT * FROM tp QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, topic) <= 15) GROUP BY 1)
    SELECT DISTINCT s_suppkey AS collection_id, coalesce(topics, '') AS topics, n_name AS affiliations FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN paa ON AuthorId = s_suppkey LEFT JOIN t15 ON a = s_suppkey""")
def author_card_lists(spark, d):
    """Topics and affiliations of author cards."""
    ids = st.authorship(spark, d).select(F.col("AuthorId").alias("collection_id")).distinct()
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("collection_id"), F.col("n_name").alias("affiliation"), F.lit(1).alias("n"))
    none = ids.where("false").select("collection_id", F.lit("").alias("label"), F.lit("").alias("term_display"), F.lit(1).alias("rank"))
    cards = cd.author_cards(ids, none, cq.topics_by_score(spark, d).withColumnRenamed("AuthorId", "collection_id"), places)
    return cards.select("collection_id", F.array_join("topics", ",").alias("topics"), F.array_join("affiliations", ",").alias("affiliations"))


_STRATEGIES = gq.ORACLES["strategy_comparison"]


def _strategies(spark, d):
    wide = gq.strategy_comparison(spark, d)
    return wide.select(F.col("AuthorId").alias("collection_id"), F.expr("stack(2, 'relevance', relevance, 'frequency', frequency)").alias("strategy", "term_display"), "rank")


@query(f"SELECT AuthorId AS collection_id, strategy, string_agg(term, '|' ORDER BY rank) AS terms FROM (SELECT AuthorId, rank, 'relevance' AS strategy, relevance AS term FROM ({_STRATEGIES}) UNION ALL SELECT AuthorId, rank, 'frequency', frequency FROM ({_STRATEGIES})) GROUP BY ALL")
def compare_card_terms(spark, d):
    """Cards that compare ranking strategies, flattened."""
    return cd.compare_cards(_strategies(spark, d)).select("collection_id", F.explode("strategies").alias("strategy", "t")).select("collection_id", "strategy", F.array_join("t", "|").alias("terms"))


@query(f"SELECT AuthorId AS collection_id, rank, frequency AS A, relevance AS B FROM ({_STRATEGIES})")
def blind_rank_sheet(spark, d):
    """A sheet of strategies under letters."""
    return cd.rank_sheet(_strategies(spark, d), ["frequency", "relevance"], blind=True)


@query(f"""WITH {gq._HEAVY} SELECT '{{"kind":"node","id":' || id || '}}' AS value FROM (SELECT DISTINCT src AS id FROM bw) UNION ALL SELECT '{{"kind":"link","src":' || src || ',"dst":' || dst || '}}' FROM h""")
def graph_lines(spark, d):
    """The co-author graph as lines of JSON."""
    graph = gq._graph(spark, d)
    vertices = graph.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return writers.node_link(vertices, graph.select("src", "dst"))


# Study facts on the events: a user's values of k stand for cards, event types for item types


def _study_cards(spark, d):
    rows = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("card_id"), "event_type", "value")
    return rows.where("card_id is not null"), rows.where("card_id is not null").select("user_id", "card_id", (F.col("card_id") % 2 == 0).alias("hide_terms")).distinct()


_KINDS = {"click": "paper", "view": "topic", "purchase": "Task"}
_ITEM = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE 'card' END"
_EVENTS = f"ev AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS card_id, {_ITEM} AS item_type, value FROM events WHERE json_extract(props, '$.k') IS NOT NULL), cs AS (SELECT DISTINCT user_id, card_id, card_id % 2 = 0 AS hide_terms FROM ev)"
_FACTS = f"""{_EVENTS}, ty AS (SELECT *, unnest(CASE WHEN hide_terms THEN ['card', 'paper', 'topic'] ELSE ['card', 'paper', 'topic', 'Task', 'Method', 'Material'] END) AS item_type FROM cs),
    ct AS (SELECT user_id, card_id, item_type, count(*) AS n FROM ev GROUP BY ALL),
    rr AS (SELECT ty.*, coalesce(n, 0) AS num_checked, CASE ty.item_type WHEN 'card' THEN 5 WHEN 'paper' THEN least(ty.card_id % 9, 7) ELSE 10 END AS num_observed FROM ty LEFT JOIN ct ON ty.user_id = ct.user_id AND ty.card_id = ct.card_id AND ty.item_type = ct.item_type)"""


def _facts(spark, d):
    events, cards = _study_cards(spark, d)
    kinds = F.create_map(*[x for k, v in _KINDS.items() for x in (F.lit(k), F.lit(v))])
    checked = events.select("user_id", "card_id", F.coalesce(kinds[F.col("event_type")], F.lit("card")).alias("item_type"))
    shown = cards.select("user_id", "card_id", F.least(F.col("card_id") % 9, F.lit(7)).alias("n_observed"))
    return study.result_rows(cards, checked, shown)


@query(f"WITH {_FACTS} SELECT user_id, card_id, hide_terms, item_type, num_checked, num_observed FROM rr")
def study_result_rows(spark, d):
    return _facts(spark, d).select("user_id", "card_id", "hide_terms", "item_type", "num_checked", F.col("num_observed"))


@query(f"""WITH {_FACTS}, sd AS (SELECT *, CASE WHEN card_id % 3 = 0 THEN 'a' WHEN card_id % 3 = 1 THEN 'b' END AS side FROM rr WHERE item_type <> 'card'),
    mn AS (SELECT user_id, item_type, avg(num_checked) FILTER (WHERE side = 'a') AS a, avg(num_checked) FILTER (WHERE side = 'b') AS b FROM sd GROUP BY ALL),
    w AS (SELECT user_id, CASE WHEN a = b THEN NULL WHEN a > b THEN 1 ELSE 0 END AS win FROM mn) SELECT user_id, round(avg(win), 6) AS novelty FROM w WHERE win IS NOT NULL GROUP BY 1""")
def study_novelty(spark, d):
    """How often a user checked more under one group of conditions than under the other, over the item types."""
    rows = _facts(spark, d).withColumn("condition", F.concat(F.lit("c"), (F.col("card_id") % 3).cast("string")))
    return study.mean_novelty(rows, "user_id", "condition", "num_checked", ["c0"], ["c1"], ["card"]).withColumn("novelty", F.round("novelty", 6))


@query(f"""WITH {_EVENTS}, av AS (SELECT user_id, list(DISTINCT item_type) AS f FROM ev GROUP BY 1), cv AS (SELECT user_id, card_id, list(DISTINCT item_type) AS v FROM ev GROUP BY ALL)
    SELECT user_id, card_id, round(1 - len(list_intersect(v, f)) / len(list_distinct(list_concat(v, f))), 6) AS kinds_overlap, CASE card_id % 3 WHEN 0 THEN 'sT' WHEN 1 THEN 'ss' ELSE 'other' END AS condition_short FROM cv JOIN av USING (user_id)""")
def study_distance_measures(spark, d):
    """Kinds of things done with a card against those done at all, as a distance, with short names of conditions."""
    events, _ = _study_cards(spark, d)
    kinds = F.create_map(*[x for k, v in _KINDS.items() for x in (F.lit(k), F.lit(v))])
    rows = events.withColumn("kind", F.coalesce(kinds[F.col("event_type")], F.lit("card")))
    cards = rows.groupBy("user_id", "card_id").agg(F.collect_set("kind").alias("kinds"))
    features = study.overlap_features(cards, rows.groupBy("user_id").agg(F.collect_set("kind").alias("kinds")), ["kinds"])
    named = features.withColumn("condition", F.when(F.col("card_id") % 3 == 0, "simTask").when(F.col("card_id") % 3 == 1, "simspecter_hideTerms").otherwise("other"))
    return study.distance_measures(named, "condition", ["kinds_overlap"]).select("user_id", "card_id", F.round("kinds_overlap", 6).alias("kinds_overlap"), "condition_short")


@query(f"""WITH {_EVENTS}, rk AS (SELECT user_id, card_id, CASE WHEN card_id % 2 = 0 THEN 'x' ELSE 'y' END AS shown_by, hide_terms FROM cs), cand AS (SELECT user_id, c AS condition, card_id, row_number() OVER (PARTITION BY user_id, c ORDER BY card_id) AS rank FROM rk, (SELECT unnest(['x', 'y']) AS c)),
    best AS (SELECT * FROM cand WHERE rank <= 10) SELECT b.user_id, b.condition, b.card_id FROM best b JOIN rk ON b.user_id = rk.user_id AND b.card_id = rk.card_id WHERE b.condition <> shown_by AND NOT hide_terms""")
def study_post_hoc(spark, d):
    """Cards that the other condition would have shown too."""
    _, cards = _study_cards(spark, d)
    shown = cards.withColumn("condition", F.when(F.col("card_id") % 2 == 0, "x").otherwise("y"))
    candidates = cards.withColumn("condition", F.explode(F.array(F.lit("x"), F.lit("y"))))
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "condition").orderBy("card_id")))
    return study.post_hoc_duplicates(ranked, shown).select("user_id", "condition", "card_id")


@query("SELECT event_id, replace(replace(props, '\"k\"', 'key'), ' ', '') AS props FROM events")
def study_raw_feedback(spark, d):
    return study.raw_feedback(table(spark, d, "events").select("event_id", "props"), "props", {'"k"': "key", " ": ""})


# Further forms of operators


@query("SELECT term_normalized, count(DISTINCT term) AS n FROM df_ner WHERE term_normalized IS NOT NULL GROUP BY 1 HAVING count(DISTINCT term) > 1")
def conflicting_displays(spark, d):
    """Normal forms with several raw forms, as display forms must not have them."""
    return tm.conflicting_displays(table(spark, d, "df_ner"), "term")


@query("""WITH t AS (SELECT PaperId, min(replace(title, ' ', '')) AS key, min(CASE DocType WHEN 'Journal' THEN 0 WHEN 'Conference' THEN 1 WHEN 'Book' THEN 2 WHEN 'BookChapter' THEN 3 WHEN 'Repository' THEN 4 WHEN 'Dataset' THEN 5 END) AS o FROM paper GROUP BY 1),
    c AS (SELECT DISTINCT AuthorId AS collection_id, PaperId FROM paper_author_affiliations WHERE AuthorId IS NOT NULL)
    SELECT collection_id, PaperId FROM c JOIN t USING (PaperId) QUALIFY row_number() OVER (PARTITION BY collection_id, key ORDER BY o NULLS LAST, PaperId) = 1""")
def deduplicated_papers(spark, d):
    """Papers of each author with one a title, the best document type first."""
    titles = table(spark, d, "paper").groupBy("PaperId").agg(F.min(text.title_key(F.col("title"))).alias("key"), F.min(rel.doctype_rank(F.col("DocType"))).alias("order"))
    return rc.deduplicated(dm.authorship(spark, d).select(F.col("AuthorId").alias("collection_id"), "PaperId"), titles).select("collection_id", "PaperId")


@query(f"WITH {dm.SQL_PAPERS}, {dm.SQL_AUTHORSHIP} SELECT PaperId, AuthorId, Yr AS \"Year\" FROM paa JOIN papers USING (PaperId) WHERE Yr >= {YEARS[0]} AND Yr < {YEARS[1]} QUALIFY count(*) OVER (PARTITION BY PaperId) <= 50")
def paper_author_years(spark, d):
    """Edges between papers and authors with the paper's year."""
    return gq._authorships(spark, d, YEARS).join(dm.papers(spark, d).select("PaperId", "Year"), "PaperId")


@query(f"""WITH {st.SQL_AUTHORSHIP}, rc AS (SELECT l_orderkey AS PaperId, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT PaperId, AuthorId FROM paa JOIN rc USING (PaperId) WHERE n >= 3 AND n < 6)
    SELECT DISTINCT PaperId, AuthorId FROM k WHERE AuthorId IN (SELECT AuthorId FROM k GROUP BY 1 HAVING count(DISTINCT PaperId) >= 2)""")
def reference_range_edges(spark, d):
    """Edges of papers with three to five references and authors of two papers or more."""
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("PaperId")).agg(F.count(F.lit(1)).alias("ReferenceCount"))
    return co.author_paper_edges(st.authorship(spark, d).join(counts, "PaperId"), refs=(3, 6), min_pubs=2)


@query(f"WITH {st.SQL_PAPERS}, {st.SQL_AUTHORSHIP} SELECT AuthorId AS collection_id, count(*) AS n_papers, min(Rnk) AS best FROM paa JOIN papers USING (PaperId) GROUP BY 1")
def details_counts(spark, d):
    """Details documents: all papers of each author."""
    structs = cd.paper_structs(st.papers(spark, d).select("PaperId", "Rank", "Year"), st.authorship(spark, d))
    cards = cd.collection_cards(st.authorship(spark, d).select(F.col("AuthorId").alias("collection_id"), "PaperId"), structs, n=None)
    return cards.select("collection_id", F.size("papers").cast("long").alias("n_papers"), F.col("papers")[0]["Rank"].alias("best"))


@query("""WITH p AS (SELECT PaperId, max(CitationCount) AS c FROM paper GROUP BY 1), b AS (SELECT min(c) AS lo, max(c) AS hi FROM p) SELECT PaperId, round(0.5 + 0.5 * (c - lo) / (hi - lo), 6) AS weight FROM p, b""")
def citation_weights(spark, d):
    papers = table(spark, d, "paper").groupBy("PaperId").agg(F.max("CitationCount").alias("c"))
    bounds = papers.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return papers.crossJoin(F.broadcast(bounds)).select("PaperId", F.round(minmax(F.col("c"), F.col("lo"), F.col("hi"), (0.5, 1.0)), 6).alias("weight"))


@query("SELECT AuthorId, DisplayName FROM (SELECT DISTINCT AuthorId, DisplayName, \"Rank\" AS r FROM authors WHERE contains(DisplayName, 'Consortium') OR contains(DisplayName, 'Group')) WHERE contains(DisplayName, 'Group') ORDER BY r NULLS LAST, AuthorId LIMIT 1")
def found_author(spark, d):
    """The best-ranked author whose name holds a text."""
    return Corpus(lambda _: table(spark, d, "authors").distinct()).find_author("Group").select("AuthorId", "DisplayName")


@query(f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT a.label, a.vec_id AS term_id, min(1 - list_dot_product(a.v, f.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(f.v, f.v))) AS distance
    FROM v a JOIN v f ON a.label = f.label AND f.vec_id % 2 = 0 WHERE a.vec_id % 2 = 1 GROUP BY ALL) SELECT label, term_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), term_id) AS rank FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), term_id) <= 10""")
def nearest_terms_by_label(spark, d):
    """Odd vectors nearest to any even one of their label."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("term_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    near = rk.nearest_terms(vectors.where("term_id % 2 = 0").select("label", "vector"), vectors.where("term_id % 2 = 1"), ["label"], 10)
    return near.select("label", "term_id", F.round("distance", 6).alias("distance"), "rank")
