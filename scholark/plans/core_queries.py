"""Queries for filters, joins, sets, windows, scores, terms and tf-idf."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholark.functions import scores, text
from scholark.operators import relational as rel
from scholark.operators import terms as tm
from scholark.operators import tfidf as ti
from scholark.plans import domain as dm
from scholark.plans import standin as st
from scholark.sources.tables import table

YEARS = (1996, 2001)
ORDER = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def year_window_rank_scaled(spark, d):
    ranked = scores.rank_scaled(st.papers(spark, d))
    return rel.year_window(ranked, *YEARS).select("PaperId", "Year", F.round("rank_scaled", 6).alias("rank_scaled"))


def either_endpoint_filter(spark, d):
    cites = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("PaperId"), F.col("l_partkey").alias("PaperReferenceId"))
    ids = rel.year_window(st.papers(spark, d), 1996, 1997).select(F.col("PaperId").alias("id"))
    return rel.either_end_in(cites, "PaperId", "PaperReferenceId", ids)


def in_out_union_distinct(spark, d):
    cites = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("PaperId"), F.col("l_partkey").alias("PaperReferenceId"))
    ids = rel.year_window(st.papers(spark, d), 1996, 1997).select(F.col("PaperId").alias("id"))
    return rel.in_out_union(cites, "PaperId", "PaperReferenceId", ids)


def catalog_outer_merge_indicator(spark, d):
    left = rel.year_window(st.papers(spark, d), 1996, 1999).select("PaperId", "VenueId")
    right = table(spark, d, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_orderkey").alias("PaperId")).agg(F.count(F.lit(1)).alias("n_lines"))
    return rel.outer_with_origin(left, right, ["PaperId"])


def cascade_subset_counts(spark, d):
    """Rows of each table left after papers of two years are cut out and everything else by what they refer to."""
    kept = rel.year_window(st.papers(spark, d), 1996, 1998).select("PaperId", "VenueId")
    rows = table(spark, d, "lineitem").join(kept.select(F.col("PaperId").alias("l_orderkey")), "l_orderkey", "left_semi")
    authors = table(spark, d, "supplier").join(rows.select(F.col("l_suppkey").alias("s_suppkey")).distinct(), "s_suppkey", "left_semi")
    fields = table(spark, d, "part").join(rows.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    venues = table(spark, d, "customer").join(kept.select(F.col("VenueId").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    places = table(spark, d, "nation").join(authors.select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    named = {"papers": kept, "authorships": rows, "authors": authors, "fields": fields, "venues": venues, "affiliations": places}
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in named.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def title_dedup(spark, d):
    return rel.drop_duplicate_titles(table(spark, d, "paper").select("PaperId", "title", "DocType").distinct())


def author_position_scores_corpus(spark, d):
    return scores.author_paper_scores(st.scored_authorship(spark, d)).select("PaperId", "AuthorId", "is_last_author", F.round("score", 6).alias("score"))


def author_position_scores_author(spark, d):
    return scores.author_paper_scores(st.scored_authorship(spark, d), ["AuthorId"]).select("PaperId", "AuthorId", F.round("score", 6).alias("score"))


def paper_weights(spark, d):
    """Relevance of papers to each nation's authors, as one collection a nation: mean score over its authors."""
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("AuthorId"), F.col("s_nationkey").alias("collection_id"))
    rows = st.scored_authorship(spark, d).join(nations, "AuthorId")
    scored = scores.author_paper_scores(rows, ["collection_id"])
    return scored.groupBy("collection_id", "PaperId").agg(F.round(F.avg("score"), 6).alias("relevance_score"))


def clean_terms(spark, d):
    return table(spark, d, "df_ner").select("s2_id", "term", text.clean_term(F.col("term")).alias("cleaned"), text.clean_term_min3(F.col("term")).alias("cleaned_min3")).distinct()


def display_term_map(spark, d):
    return tm.display_terms(table(spark, d, "df_ner").select("term_normalized", "term_cleaned", "term"))


def abbrev_expand(spark, d):
    """Terms of papers that define an abbreviation, with the paper's abbreviations written out."""
    rows = table(spark, d, "df_ner").select("s2_id", "term").distinct()
    pairs = tm.bracket_abbreviations(rows, "s2_id", "term")
    return tm.expand_terms(rows, pairs, "s2_id", "term")


def mostly_upper_terms(spark, d):
    """Typed names and raw terms with a token of capitals."""
    terms = table(spark, d, "df_ner").select("term").union(table(spark, d, "authors").select("DisplayName"))
    return terms.distinct().where(text.mostly_upper(F.col("term")))


def term_finalize(spark, d):
    rows = table(spark, d, "df_ner").select("s2_id", "label", "term_normalized", "term_display", "softmax_score")
    return tm.finalize_terms(rows)


def term_upsert(spark, d):
    """Terms of early load chunks brought up to date by those of later ones; keys are papers, known terms keep their display form."""
    rows = table(spark, d, "df_ner").select("s2_id", "chunk_id", "label", "term_normalized", "term_display", "softmax_score")
    middle = rows.agg(F.expr("percentile(chunk_id, 0.5)").alias("m"))
    marked = rows.crossJoin(F.broadcast(middle))
    old = tm.term_frequencies(marked.where("chunk_id <= m"))
    new = tm.term_frequencies(marked.where("chunk_id > m"))
    return tm.upsert_terms(old, new)


def dense_term_ids(spark, d):
    return rel.dense_ids(table(spark, d, "df_ner").select("term_normalized"), "term_normalized")


def term_classify_priority(spark, d):
    terms = table(spark, d, "df_ner").select(F.lower(F.trim("term_normalized")).alias("term")).distinct()
    return terms.select("term", tm.classify_by_priority(F.col("term")).alias("class"))


def term_classify_weighted(spark, d):
    rows = table(spark, d, "df_ner").select(F.lower(F.trim("term_normalized")).alias("term"), F.lower("term").alias("context")).distinct()
    return rows.select("term", "context", tm.classify_by_weight(F.col("term"), F.col("context")).alias("class"))


def term_relevance(spark, d):
    """Per author and label: relevance of each term, summed over title-deduplicated papers."""
    weights = scores.author_paper_scores(st.scored_authorship(spark, d), ["AuthorId"]).select(F.col("AuthorId").alias("collection_id"), "PaperId", F.col("score").alias("relevance_score"))
    return tm.term_relevance(st.term_rows(spark, d), weights, ["collection_id", "label", "term_display"]).withColumn("relevance", F.round("relevance", 5))


def topics_by_score(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    topics = line.join(part, F.col("l_partkey") == F.col("p_partkey")).where("p_size % 4 <> 0")
    return topics.groupBy(F.col("l_suppkey").alias("AuthorId"), F.col("p_brand").alias("topic")).agg(F.round(F.sum("l_discount"), 6).alias("score"))


def fos_mass(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    sums = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("field")).agg(F.round(F.sum("l_discount"), 6).alias("mass"))
    return sums.where("mass > 0")


#: Last words that name no thing of their own in the part names, which stand for terms here.
STANDIN_TAILS = ("widget", "gear")


def _tfidf(strategy):
    def run(spark, d):
        rows = st.term_rows(spark, d).where("label = 'Method'").join(st.authorship(spark, d).select("PaperId", "AuthorId"), "PaperId").select("AuthorId", "PaperId", "term_id", "term_display")
        return strategy(rows).select("AuthorId", "term_id", F.round("tfidf_score", 6).alias("tfidf_score"))

    return run


def fos_tfidf_paper(spark, d):
    """Tf-idf of the fields of each paper, the summed score being the term frequency."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("PaperId"), F.col("p_brand").alias("field")).agg(F.sum("l_discount").alias("tf"))
    rows = rows.where("tf > 0")
    df = rows.groupBy("field").agg(F.count(F.lit(1)).alias("df"))
    n = rows.agg(F.countDistinct("PaperId").alias("n"))
    return rows.join(df, "field").crossJoin(F.broadcast(n)).select("PaperId", "field", F.round(scores.tfidf(F.col("tf"), F.col("df"), F.col("n")), 6).alias("tfidf"))


def insufficient_terms(spark, d):
    """Authors with under ten different terms of a label in one of the three labels that count; a label with none doesn't."""
    return tm.insufficient_terms(dm.term_rows(spark, d), dm.authorship(spark, d))


def venue_overlap(spark, d):
    """Share of venues that the authors of nation 0 and each other nation's have in common, three rows or more."""
    home = table(spark, d, "supplier").select(F.col("s_suppkey").alias("AuthorId"), F.col("s_nationkey").alias("nation"))
    rows = st.authorship(spark, d).join(home, "AuthorId").join(st.papers(spark, d), "PaperId")
    venues = rows.groupBy("nation").agg(F.collect_set("VenueId").alias("venues"), F.count("VenueId").alias("n"))
    focal = venues.orderBy("nation").limit(1)
    return venues.where("n >= 3").crossJoin(F.broadcast(focal.select(F.col("nation").alias("focal"), F.col("venues").alias("fv")))).where("nation <> focal").select("nation", F.round(scores.overlap_ratio(F.col("venues"), F.col("fv")), 6).alias("ratio"))


def jaccard_pairs(spark, d):
    """Jaccard index of the term sets of two labels."""
    sets = st.term_rows(spark, d).groupBy("label").agg(F.collect_set("term_display").alias("terms"))
    other = sets.select(F.col("label").alias("label_2"), F.col("terms").alias("terms_2"))
    return sets.join(F.broadcast(other), F.col("label") < F.col("label_2")).select(F.col("label").alias("label_1"), "label_2", F.round(scores.overlap_ratio(F.col("terms"), F.col("terms_2")), 6).alias("jaccard"))


def js_divergence(spark, d):
    rows = st.term_rows(spark, d).groupBy("label", "term_display").agg(F.count(F.lit(1)).alias("n"))
    return scores.js_divergence(rows.where("label = 'Task'"), rows.where("label = 'Method'"), "term_display", "n").select(F.round("divergence", 6).alias("divergence"))


def affiliations_by_frequency(spark, d):
    rows = table(spark, d, "paper_author_affiliations").where("AffiliationId is not null").groupBy("AffiliationId").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(table(spark, d, "affiliations").select("AffiliationId", "DisplayName").distinct(), "AffiliationId")


def authors_per_paper_ordered(spark, d):
    """Authors of each paper in order, as one list a paper: a list is one row, so one task's, however long."""
    rows = st.authorship(spark, d).groupBy("PaperId").agg(F.array_sort(F.collect_list(F.struct("seq", "AuthorId"))).alias("a"))
    return rows.select("PaperId", F.array_join(F.transform("a", lambda x: x["AuthorId"].cast("string")), ",").alias("author_ids"))


def persona_letters(spark, d):
    """Letters by best rank: the venues of each author as its personas; after Z comes AA."""
    rows = st.authorship(spark, d).join(st.papers(spark, d), "PaperId").groupBy("AuthorId", "VenueId").agg(F.min("Rank").alias("best"))
    place = F.row_number().over(Window.partitionBy("AuthorId").orderBy("best", "VenueId"))
    return rows.withColumn("p", place).select("AuthorId", "VenueId", F.concat(F.col("AuthorId").cast("string"), F.lit("-"), text.letters(F.col("p"))).alias("persona_id"))


QUERIES = {
    f.__name__: f
    for f in (
        year_window_rank_scaled, either_endpoint_filter, in_out_union_distinct, catalog_outer_merge_indicator, cascade_subset_counts, title_dedup,
        author_position_scores_corpus, author_position_scores_author, paper_weights, clean_terms, display_term_map, abbrev_expand, mostly_upper_terms,
        term_finalize, term_upsert, dense_term_ids, term_classify_priority, term_classify_weighted, term_relevance, topics_by_score, fos_mass,
        fos_tfidf_paper, insufficient_terms, venue_overlap, jaccard_pairs, js_divergence, affiliations_by_frequency, authors_per_paper_ordered, persona_letters,
    )
} | {f"author_term_tfidf_s0{i}": _tfidf(s) for i, s in enumerate((ti.strategy_occurrences, ti.strategy_papers, ti.strategy_cutoff, partial(ti.strategy_merged, tails=STANDIN_TAILS), partial(ti.strategy_cutoff_merged, tails=STANDIN_TAILS)), 1)}

_P, _A, _T, _R, _POS, _S = st.SQL_PAPERS, st.SQL_AUTHORSHIP, st.SQL_TERMS, st.SQL_RANKED, st.SQL_POSITIONS, st.SQL_SCORED
_CLEAN = "lower(trim(regexp_replace(regexp_replace(regexp_replace(term, '\\s\\(.*?\\)', '', 'g'), '\\s\\(.*', '', 'g'), ' +', ' ', 'g')))"
_TF = f"WITH {_A}, {_T}, rows AS (SELECT AuthorId, PaperId, term_id, term_display FROM terms JOIN paa USING (PaperId) WHERE label = 'Method')"
_SCORE = """, n AS (SELECT count(DISTINCT AuthorId) AS n FROM rows), dfs AS (SELECT term_id, count(DISTINCT AuthorId) AS df FROM tf GROUP BY 1),
    raw AS (SELECT AuthorId, term_id, tf * (ln((1 + n.n) / (1.0 + df)) + 1) AS w FROM tf JOIN dfs USING (term_id), n WHERE term_id >= 10)
    SELECT AuthorId, term_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY AuthorId)), 6) AS tfidf_score FROM raw"""
_MERGE = """, merged AS (SELECT r.AuthorId, r.PaperId, coalesce(m.to_id, r.term_id) AS term_id FROM {rows} r LEFT JOIN
    (SELECT a.term_id, min(b.term_id) AS to_id FROM (SELECT DISTINCT term_id, term_display FROM rows) a JOIN (SELECT DISTINCT term_id, term_display FROM rows) b
     ON regexp_replace(regexp_replace(a.term_display, ' widget$', ''), ' gear$', '') = b.term_display GROUP BY 1) m ON r.term_id = m.term_id)"""
_LETTERS = " || ".join(f"CASE WHEN p > {sum(26**k for k in range(1, i + 1))} THEN chr(CAST(65 + ((p - 1 - {sum(26**k for k in range(1, i + 1))}) // {26**i}) % 26 AS INT)) ELSE '' END" for i in (3, 2, 1, 0))
_DIST, _CUT = ", d AS (SELECT DISTINCT AuthorId, PaperId, term_id FROM rows)", ", c AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY term_id) >= 2)"

ORACLES = {
    "year_window_rank_scaled": f"WITH {_P}, {_R} SELECT PaperId, Yr AS \"Year\", round(rank_scaled, 6) AS rank_scaled FROM ranked WHERE Yr >= 1996 AND Yr < 2001",
    "either_endpoint_filter": f"WITH {_P}, ids AS (SELECT PaperId FROM papers WHERE Yr = 1996) SELECT l_orderkey AS PaperId, l_partkey AS PaperReferenceId FROM lineitem WHERE l_orderkey IN (SELECT PaperId FROM ids) OR l_partkey IN (SELECT PaperId FROM ids)",
    "in_out_union_distinct": f"WITH {_P}, ids AS (SELECT PaperId FROM papers WHERE Yr = 1996) SELECT DISTINCT l_orderkey AS PaperId, l_partkey AS PaperReferenceId FROM lineitem WHERE l_orderkey IN (SELECT PaperId FROM ids) OR l_partkey IN (SELECT PaperId FROM ids)",
    "catalog_outer_merge_indicator": f"WITH {_P}, l AS (SELECT PaperId, VenueId FROM papers WHERE Yr >= 1996 AND Yr < 1999), r AS (SELECT l_orderkey AS PaperId, count(*) AS n_lines FROM lineitem WHERE l_quantity >= 45 GROUP BY 1) SELECT coalesce(l.PaperId, r.PaperId) AS PaperId, VenueId, n_lines, CASE WHEN l.PaperId IS NOT NULL AND r.PaperId IS NOT NULL THEN 'both' WHEN l.PaperId IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS _merge FROM l FULL JOIN r ON l.PaperId = r.PaperId",
    "cascade_subset_counts": f"""WITH {_P}, k AS (SELECT PaperId, VenueId FROM papers WHERE Yr >= 1996 AND Yr < 1998), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT PaperId FROM k)),
        s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l))
        SELECT 'papers' AS table_name, count(*) AS n_rows FROM k UNION ALL SELECT 'authorships', count(*) FROM l UNION ALL SELECT 'authors', count(*) FROM s
        UNION ALL SELECT 'fields', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM l) UNION ALL SELECT 'venues', count(*) FROM customer WHERE c_custkey IN (SELECT VenueId FROM k)
        UNION ALL SELECT 'affiliations', count(*) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM s)""",
    "title_dedup": """SELECT PaperId, title, DocType FROM (SELECT DISTINCT PaperId, title, DocType FROM paper) QUALIFY row_number() OVER (PARTITION BY replace(title, ' ', '')
        ORDER BY CASE DocType WHEN 'Journal' THEN 0 WHEN 'Conference' THEN 1 WHEN 'Book' THEN 2 WHEN 'BookChapter' THEN 3 WHEN 'Repository' THEN 4 WHEN 'Dataset' THEN 5 END NULLS LAST, PaperId) = 1""",
    "author_position_scores_corpus": f"WITH {_P}, {_A}, {_R}, {_POS}, {_S}, b AS (SELECT min(rank_scaled) AS lo, max(rank_scaled) AS hi FROM scored) SELECT PaperId, AuthorId, seq = num_authors AS is_last_author, round(mult * CASE WHEN hi = lo THEN 0.5 ELSE 0.5 + 0.5 * (rank_scaled - lo) / (hi - lo) END, 6) AS score FROM scored, b",
    "author_position_scores_author": f"WITH {_P}, {_A}, {_R}, {_POS}, {_S}, b AS (SELECT AuthorId, min(rank_scaled) AS lo, max(rank_scaled) AS hi FROM scored GROUP BY 1) SELECT PaperId, AuthorId, round(mult * CASE WHEN hi = lo THEN 0.5 ELSE 0.5 + 0.5 * (rank_scaled - lo) / (hi - lo) END, 6) AS score FROM scored JOIN b USING (AuthorId)",
    "paper_weights": f"WITH {_P}, {_A}, {_R}, {_POS}, {_S}, c AS (SELECT scored.*, s_nationkey AS collection_id FROM scored JOIN supplier ON AuthorId = s_suppkey), b AS (SELECT collection_id, min(rank_scaled) AS lo, max(rank_scaled) AS hi FROM c GROUP BY 1) SELECT collection_id, PaperId, round(avg(mult * CASE WHEN hi = lo THEN 0.5 ELSE 0.5 + 0.5 * (rank_scaled - lo) / (hi - lo) END), 6) AS relevance_score FROM c JOIN b USING (collection_id) GROUP BY 1, 2",
    "clean_terms": f"SELECT DISTINCT s2_id, term, {_CLEAN} AS cleaned, CASE WHEN length({_CLEAN}) < 3 THEN '' ELSE {_CLEAN} END AS cleaned_min3 FROM df_ner",
    "display_term_map": """WITH c AS (SELECT term_normalized, term_cleaned, term, count(*) AS freq FROM df_ner WHERE term_normalized IS NOT NULL AND term_cleaned IS NOT NULL AND term IS NOT NULL GROUP BY ALL),
        m AS (SELECT *, count(*) OVER (PARTITION BY term_normalized) AS k FROM c)
        SELECT term_normalized, term_cleaned AS term_display FROM m WHERE k > 1 QUALIFY row_number() OVER (PARTITION BY term_normalized ORDER BY freq DESC, term_cleaned, term) = 1""",
    "abbrev_expand": """WITH r AS (SELECT DISTINCT s2_id, term FROM df_ner WHERE term IS NOT NULL), p AS (SELECT DISTINCT s2_id, regexp_extract(term, '\\(([A-Z]{2,8})\\)', 1) AS abbrv, trim(regexp_extract(term, '^(.*?)\\s*\\([A-Z]{2,8}\\)', 1)) AS long_form FROM r WHERE regexp_matches(term, '\\([A-Z]{2,8}\\)')),
        one AS (SELECT s2_id, abbrv, min(long_form) AS long_form FROM p WHERE long_form <> '' GROUP BY 1, 2), j AS (SELECT r.s2_id, r.term, one.abbrv, one.long_form FROM r JOIN one ON r.s2_id = one.s2_id),
        o AS (SELECT s2_id, term, list({'a': abbrv, 'l': long_form} ORDER BY abbrv) AS ps FROM j GROUP BY ALL)
        SELECT s2_id, term, list_reduce(list_prepend({'a': '', 'l': term}, ps), lambda acc, p: {'a': '', 'l': CASE WHEN contains(term, p.a) THEN regexp_replace(acc.l, '\\b' || p.a || '\\b', p.l, 'g') ELSE acc.l END}).l AS expanded FROM o""",
    "mostly_upper_terms": "SELECT DISTINCT term FROM (SELECT term FROM df_ner UNION SELECT DisplayName FROM authors) WHERE len(list_filter(regexp_split_to_array(term, '\\s+'), lambda t: length(t) > 0 AND length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(t) >= 0.75)) > 0",
    "term_finalize": """WITH k AS (SELECT s2_id, label, term_normalized, term_display FROM df_ner WHERE label IN ('Task', 'Method', 'Material', 'Metric') AND softmax_score >= 0.9 AND s2_id IS NOT NULL AND term_normalized IS NOT NULL AND term_display IS NOT NULL),
        one AS (SELECT term_normalized, min(term_display) AS term_display FROM k GROUP BY 1), ids AS (SELECT term_normalized, dense_rank() OVER (ORDER BY term_normalized) - 1 AS term_id FROM (SELECT DISTINCT term_normalized FROM k))
        SELECT s2_id, label, k.term_normalized, one.term_display, count(*) AS freq, term_id FROM k JOIN one ON k.term_normalized = one.term_normalized JOIN ids ON k.term_normalized = ids.term_normalized GROUP BY ALL""",
    "term_upsert": """WITH m AS (SELECT quantile_cont(chunk_id, 0.5) AS m FROM df_ner), k AS (SELECT df_ner.*, chunk_id > m.m AS late FROM df_ner, m WHERE label IN ('Task', 'Method', 'Material', 'Metric') AND softmax_score >= 0.9 AND s2_id IS NOT NULL AND term_normalized IS NOT NULL AND term_display IS NOT NULL),
        f AS (SELECT late, s2_id, label, term_normalized, min(term_display) AS d0, count(*) AS freq FROM k GROUP BY ALL), known AS (SELECT term_normalized, min(d0) AS d FROM f WHERE NOT late GROUP BY 1)
        SELECT s2_id, label, f.term_normalized, coalesce(known.d, d0) AS term_display, freq FROM f LEFT JOIN known ON f.term_normalized = known.term_normalized WHERE late OR s2_id NOT IN (SELECT s2_id FROM f WHERE late)""",
    "dense_term_ids": "SELECT term_normalized, dense_rank() OVER (ORDER BY term_normalized) - 1 AS term_id FROM (SELECT DISTINCT term_normalized FROM df_ner WHERE term_normalized IS NOT NULL)",
    "term_classify_priority": tm.sql_priority("SELECT DISTINCT lower(trim(term_normalized)) AS term FROM df_ner"),
    "term_classify_weighted": tm.sql_weighted("SELECT DISTINCT lower(trim(term_normalized)) AS term, lower(term) AS context FROM df_ner"),
    "term_relevance": f"WITH {_P}, {_A}, {_R}, {_POS}, {_S}, {_T}, b AS (SELECT AuthorId, min(rank_scaled) AS lo, max(rank_scaled) AS hi FROM scored GROUP BY 1), w AS (SELECT AuthorId AS collection_id, PaperId, mult * CASE WHEN hi = lo THEN 0.5 ELSE 0.5 + 0.5 * (rank_scaled - lo) / (hi - lo) END AS relevance_score FROM scored JOIN b USING (AuthorId)) SELECT collection_id, label, term_display, round(sum(relevance_score), 5) AS relevance, count(relevance_score) AS freq FROM w JOIN terms USING (PaperId) GROUP BY ALL",
    "topics_by_score": "SELECT l_suppkey AS AuthorId, p_brand AS topic, round(sum(l_discount), 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 4 <> 0 GROUP BY ALL",
    "fos_mass": "SELECT p_brand AS field, round(sum(l_discount), 6) AS mass FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING round(sum(l_discount), 6) > 0",
    "fos_tfidf_paper": "WITH r AS (SELECT l_orderkey AS PaperId, p_brand AS field, sum(l_discount) AS tf FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING sum(l_discount) > 0), d AS (SELECT field, count(*) AS df FROM r GROUP BY 1), n AS (SELECT count(DISTINCT PaperId) AS n FROM r) SELECT PaperId, r.field, round(ln(1 + tf) * ln(n / df), 6) AS tfidf FROM r JOIN d ON r.field = d.field, n",
    "insufficient_terms": f"WITH {dm.SQL_PAPERS}, {dm.SQL_AUTHORSHIP}, {dm.SQL_TERMS} SELECT DISTINCT AuthorId FROM (SELECT AuthorId, label, count(DISTINCT (PaperId, term_id)) AS n FROM terms JOIN paa USING (PaperId) WHERE label IN ('Task', 'Method', 'Material') GROUP BY ALL) WHERE n < 10",
    "venue_overlap": f"WITH {_P}, {_A}, r AS (SELECT s_nationkey AS nation, VenueId FROM paa JOIN supplier ON AuthorId = s_suppkey JOIN papers USING (PaperId)), v AS (SELECT nation, list(DISTINCT VenueId) AS vs, count(*) AS n FROM r GROUP BY 1), f AS (SELECT * FROM v ORDER BY nation LIMIT 1) SELECT v.nation, round(len(list_intersect(v.vs, f.vs)) / len(list_distinct(list_concat(v.vs, f.vs))), 6) AS ratio FROM v, f WHERE v.n >= 3 AND v.nation <> f.nation",
    "jaccard_pairs": f"WITH {_T}, s AS (SELECT label, list(DISTINCT term_display) AS ts FROM terms GROUP BY 1) SELECT a.label AS label_1, b.label AS label_2, round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))), 6) AS jaccard FROM s a JOIN s b ON a.label < b.label",
    "js_divergence": f"WITH {_T}, c AS (SELECT label, term_display, count(*) AS n FROM terms GROUP BY ALL), p AS (SELECT term_display, n / sum(n) OVER () AS v FROM c WHERE label = 'Task'), q AS (SELECT term_display, n / sum(n) OVER () AS v FROM c WHERE label = 'Method'), b AS (SELECT coalesce(p.v, 0) AS x, coalesce(q.v, 0) AS y FROM p FULL JOIN q ON p.term_display = q.term_display) SELECT round(sum(CASE WHEN x > 0 THEN x * ln(2 * x / (x + y)) ELSE 0 END) / 2 + sum(CASE WHEN y > 0 THEN y * ln(2 * y / (x + y)) ELSE 0 END) / 2, 6) AS divergence FROM b",
    "affiliations_by_frequency": "SELECT p.AffiliationId, n, DisplayName FROM (SELECT AffiliationId, count(*) AS n FROM paper_author_affiliations WHERE AffiliationId IS NOT NULL GROUP BY 1) p JOIN (SELECT DISTINCT AffiliationId, DisplayName FROM affiliations) a ON p.AffiliationId = a.AffiliationId",
    "authors_per_paper_ordered": f"WITH {_A} SELECT PaperId, string_agg(CAST(AuthorId AS VARCHAR), ',' ORDER BY seq, AuthorId) AS author_ids FROM paa GROUP BY 1",
    "persona_letters": f"WITH {_P}, {_A}, r AS (SELECT AuthorId, VenueId, min(Rnk) AS best FROM paa JOIN papers USING (PaperId) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY AuthorId ORDER BY best, VenueId) AS p FROM r) SELECT AuthorId, VenueId, AuthorId || '-' || {_LETTERS} AS persona_id FROM p",
    "author_term_tfidf_s01": _TF + ", tf AS (SELECT AuthorId, term_id, count(*) AS tf FROM rows GROUP BY ALL)" + _SCORE,
    "author_term_tfidf_s02": _TF + _DIST + ", tf AS (SELECT AuthorId, term_id, count(*) AS tf FROM d GROUP BY ALL)" + _SCORE,
    "author_term_tfidf_s03": _TF + _DIST + _CUT + ", tf AS (SELECT AuthorId, term_id, count(*) AS tf FROM c GROUP BY ALL)" + _SCORE.replace("FROM rows)", "FROM c)"),
    "author_term_tfidf_s04": _TF + _DIST + _MERGE.format(rows="d") + ", tf AS (SELECT AuthorId, term_id, count(*) AS tf FROM merged GROUP BY ALL)" + _SCORE,
    "author_term_tfidf_s05": _TF + _DIST + _CUT + _MERGE.format(rows="c") + ", tf AS (SELECT AuthorId, term_id, count(*) AS tf FROM merged GROUP BY ALL)" + _SCORE.replace("FROM rows)", "FROM c)"),
}
