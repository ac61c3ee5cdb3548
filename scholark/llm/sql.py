"""SQL that gives the same rows as the queries of this subpackage, where SQL can express them."""

_TOP = """
        WITH t AS (SELECT AuthorId, term_id, tfidf_score, term_display FROM tfidf_dfs
                   WHERE AuthorId IS NOT NULL AND term_id IS NOT NULL AND term_display IS NOT NULL
                     AND tfidf_score IS NOT NULL AND NOT isnan(tfidf_score)),
             b AS (SELECT *, row_number() OVER (PARTITION BY AuthorId, term_id ORDER BY tfidf_score DESC, term_display) AS k FROM t),
             r AS (SELECT *, row_number() OVER (PARTITION BY AuthorId ORDER BY tfidf_score DESC, term_display, term_id) AS rk FROM b WHERE k = 1)"""

_FORMS = """
        WITH RECURSIVE t AS (SELECT DISTINCT PaperId, title, lower(regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g')) AS f FROM paper WHERE title IS NOT NULL),
             k AS (SELECT * FROM t WHERE length(regexp_replace(f, '[^\\p{L}]', '', 'g')) >= 4),
             cut AS (SELECT DISTINCT f, title, unnest(range(1, length(title) + 1)) AS i FROM k),
             sw AS (SELECT DISTINCT f, lower(regexp_replace(substr(title, i + 1), '[^\\p{L}\\p{N}]', '', 'g'))
                                    || lower(regexp_replace(substr(title, 1, i - 1), '[^\\p{L}\\p{N}]', '', 'g')) AS g
                    FROM cut WHERE regexp_matches(substr(title, i, 2), '^[:;|/\\p{Pd}−：][\\s\\x{00a0}\\x{2009}]')),
             e AS (SELECT f AS a, g AS b FROM sw WHERE g IN (SELECT f FROM k) AND f <> g),
             s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
             reach AS (SELECT f AS a, f AS b FROM k UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
             root AS (SELECT a AS f, min(b) AS c FROM reach GROUP BY a),
             m AS (SELECT DISTINCT PaperId, c FROM k JOIN root USING (f))"""

_COUNTS = """
        WITH t AS (SELECT s2_id, label, nullif(trim(regexp_replace(lower(term_cleaned), '[\\s\\x{85}\\p{Z}\\x1c-\\x1f]+', ' ', 'g')), '') AS v FROM df_ner),
             c AS (SELECT label, v AS term_cleaned, count(*) AS occurrences, count(DISTINCT s2_id) AS records FROM t
                   WHERE label IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
             f AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.04 * (SELECT count(DISTINCT s2_id) FROM df_ner) THEN 'common' END AS band FROM c)"""

ORACLES = {
    "p3_found": _TOP + " SELECT AuthorId, term_id FROM r WHERE rk <= 5",
    "p3_top_terms": _TOP + " SELECT AuthorId, term_id, tfidf_score, term_display, rk AS \"rank\" FROM r WHERE rk <= 5",
    "p5_found": _FORMS + " SELECT x.PaperId AS PaperId_1, y.PaperId AS PaperId_2 FROM m x JOIN m y ON x.c = y.c AND x.PaperId < y.PaperId",
    "p5_copies": _FORMS + " SELECT min(PaperId) AS representative, count(*) AS n_records FROM m GROUP BY c",
    "p9_within": "SELECT source, true AS within_cap, true AS on_share, true AS shards_even FROM mix_targets",
    "p7_found": _COUNTS + " SELECT label, term_cleaned, band FROM f WHERE band IS NOT NULL",
    "p7_frequencies": _COUNTS + """,
             g AS (SELECT DISTINCT chunk_id, label, nullif(trim(regexp_replace(lower(term_cleaned), '[\\s\\x{85}\\p{Z}\\x1c-\\x1f]+', ' ', 'g')), '') AS term_cleaned, term_count FROM grp_counts),
             s AS (SELECT label, term_cleaned, CAST(sum(term_count) AS BIGINT) AS stored_count FROM g GROUP BY ALL)
        SELECT f.*, stored_count FROM f LEFT JOIN s ON f.label = s.label AND f.term_cleaned = s.term_cleaned""",
}
