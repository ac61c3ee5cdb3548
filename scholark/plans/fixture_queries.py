"""Operators without tables of their own, on rows written down here, against the rows that must come out."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from scholark.functions import arrays, text
from scholark.functions.vectors import unit
from scholark.operators import extraction as ex
from scholark.operators import ranking as rk
from scholark.operators import terms as tm
from scholark.operators import tfidf as ti
from scholark.operators.graph import clusters as cl
from scholark.operators.graph import coauthors as co
from scholark.plans import recommend as rc
from scholark.plans import runs, study
from scholark.plans import cards as cd
from scholark.session import scratch_path
from scholark.sources import readers

QUERIES, ORACLES = {}, {}


def query(columns: str, rows: str):
    """Registers a query under its function's name with the rows (SQL values) that it must give."""

    def add(run):
        QUERIES[run.__name__] = run
        doubles = re.sub(r"(?<=[ (])(\d+\.\d+)(?=[,)])", r"\1e0", rows)
        ORACLES[run.__name__] = f"SELECT * FROM (VALUES {doubles}) t({columns})"
        return run

    return add


def _text(spark, name: str, lines: list[str]) -> str:
    path = f"{scratch_path(spark, 'fixture')}/{name}"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@query("doc, abbrv, long_form", "(1, 'RRR', 'rule-based rank rounding'), (2, 'CNN', 'convolutional neural network'), (2, 'HTTP', 'Hypertext Transfer Protocol'), (3, 'TD', 'training data')")
def fx_abbreviations(spark, d):
    """Long forms by aligning letters; a bracketed remark and a short form of one sign are none."""
    rows = [(1, "we use rule-based rank rounding (RRR) here"), (2, "A convolutional neural network (CNN) over the Hypertext Transfer Protocol (HTTP)."), (3, "training data (TD) and a set (see below) of benchmark (B)"), (4, None), (5, "(ABC)")]
    return ex.abbreviations(spark.createDataFrame(rows, "doc int, t string"), "doc", "t").drop("freq")


@query("doc, n_sentences, n_tokens, first", "(1, 2, 8, 'Deep nets work .'), (3, 1, 1, 'x')")
def fx_tokens(spark, d):
    docs = tm.tokenise(spark.createDataFrame([(1, "Deep nets work. So, do trees"), (2, "  "), (3, "x")], "doc int, t string"), "doc", "t")
    return docs.select("doc", F.size("sentences").alias("n_sentences"), F.size(F.flatten("sentences")).alias("n_tokens"), F.array_join(F.col("sentences")[0], " ").alias("first"))


@query("doc, text", "(1, 'a rule-based rank rounding works'), (2, 'RRR stays')")
def fx_tokens_expanded(spark, d):
    """A document's abbreviations written out before it is cut into tokens."""
    docs = spark.createDataFrame([(1, "a RRR works"), (2, "RRR stays")], "doc int, t string")
    pairs = spark.createDataFrame([(1, "RRR", "rule-based rank rounding")], "doc int, abbrv string, long_form string")
    expanded = docs.join(tm.expand_terms(docs, pairs, "doc", "t").select("doc", "expanded"), "doc", "left").select("doc", F.coalesce("expanded", "t").alias("text"))
    return tm.tokenise(expanded, "doc", "text").select("doc", F.regexp_replace(F.array_join(F.flatten("sentences"), " "), " - ", "-").alias("text"))


@query("doc_key, n", "('a', 2), ('b', 1)")
def fx_long_sentences(spark, d):
    docs = spark.createDataFrame([("a", [["x"], ["y"], ["z"]]), ("b", [["u"]])], "doc_key string, sentences array<array<string>>")
    bad = spark.createDataFrame([("a", 1), ("c", 0)], "doc_key string, sentence_idx int")
    return tm.drop_long_sentences(docs, bad).select("doc_key", F.size("sentences").alias("n"))


@query("s2_id, label, src_term, dst_term, src_label, dst_label", "(7, 'USED-FOR', 'deep nets', 'vision', 'Method', 'Task'), (7, 'USED-FOR', 'vision', 'deep', 'Task', NULL)")
def fx_relations(spark, d):
    docs = [("7", [["deep", "nets", "for"], ["vision"]], [[["0", "1", "Method", "0", "0.9"]], [["3", "3", "Task", "0", "0.8"]]], [[["0", "1", "3", "3", "USED-FOR", "0", "0.7"], ["0", "1", "3", "3", "PART-OF", "0", "0.7"], ["3", "3", "0", "0", "USED-FOR", "0", "0.5"]]])]
    return tm.relation_rows(spark.createDataFrame(docs, "doc_key string, sentences array<array<string>>, predicted_ner array<array<array<string>>>, predicted_relations array<array<array<string>>>")).drop("softmax_score")


@query("node, component, neighbour", "(1, 0, 2), (1, 0, 3), (1, 1, 4), (9, 0, 1)")
def fx_ego_files(spark, d):
    return readers.read_ego_partitions(spark, _text(spark, "ego.jsonl", [json.dumps({"1": {"0": [2, 3], "1": [4]}}), json.dumps({"9": {"0": [1]}})]))


@query("query, AuthorId", "('11', '5'), ('11', '6'), ('12-A', '5'), ('12-A', '6')")
def fx_evaluation_file(spark, d):
    return readers.read_evaluation(spark, _text(spark, "e.csv", ["author2,ground_truth_authors", '"[\'11\', \'12-A\']","5 | 6"', "[],7"]))


@query("author_id, paper_id, title, abstract, citations, position, n_authors", "('9', 'p', 'T', '', 0, 2, 3)")
def fx_graph_files(spark, d):
    authors = _text(spark, "a.json", [json.dumps({"9": {"neighbors": {"papers": ["p", "q", "r"]}}})])
    papers = {"p": {"features": {"Title": "T", "Abstract": "nan", "CitedCount": "x", "AuthorNum": "3"}, "neighbors": {"author": {"9": [2]}}}, "q": {"features": {"Title": "nan", "Abstract": "", "CitedCount": "1", "AuthorNum": "1"}, "neighbors": {"author": {}}}}
    return readers.read_graph_papers(spark, f"{authors}/part-*", f"{_text(spark, 'p.json', [json.dumps(papers)])}/part-*")


@query("focal_id, n_events, first", "('f', 2, 1), ('g', 1, 5)")
def fx_session_logs(spark, d):
    log = lambda focal, t: json.dumps({"sessionInfo": {"focalId": focal, "conditions": {}, "distances": {}}, "feedbackList": [], "tracked": [{"action": "a", "nodeId": "n", "timestamp": t}]})
    paths = [_text(spark, f"{i}.json", [line]) for i, line in enumerate([log("f", 1), log("f", 2), log("g", 5)])]
    logs = readers.read_session_logs(spark, paths)
    return logs.select("focal_id", F.size("tracked").alias("n_events"), F.array_min(F.transform("tracked", lambda t: t["timestamp"])).alias("first"))


@query("id, value", "(1, '{\"a\":1}'), (2, '{\"b\":2}')")
def fx_keyed_json(spark, d):
    home = scratch_path(spark, "fixture")
    for name, line in (("x_1", '{"a":1}'), ("y_1", '{"a":9}'), ("2", '{"b":2}')):
        path, system = f"{home}/{name}.json", spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/{name}.json").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = system.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
        out.writeBytes(line)
        out.close()
    return readers.keyed_json(spark, f"{home}/*.json", spark.createDataFrame([(1,), (2,), (3,)], "id int"))


@query("PaperId, abstract", "(1, 'we map old maps')")
def fx_inverted_abstracts(spark, d):
    rows = [(1, json.dumps({"IndexLength": 4, "InvertedIndex": {"we": [0], "map": [1], "old": [2], "maps": [3]}})), (2, "no json")]
    return readers.inverted_abstracts(spark.createDataFrame(rows, "PaperId bigint, IndexedAbstract string"))


@query("k, distance, left_over, n_ids, renamed, merged", "(1, 0.5, 1, 1, '12-C', 3), (2, NULL, 2, 0, 'Persona B', 2)")
def fx_nested(spark, d):
    """Entry of a focal, papers taken away, ids as lists, personas renamed, maps merged."""
    kind = "k int, es array<struct<focal_id:string,d:double>>, ps array<struct<PaperId:bigint>>, gone array<bigint>, id string, persona string, letter string, a map<string,int>, b map<string,int>"
    rows = [(1, [("f", 0.5), ("f", 0.7)], [(1,), (2,)], [2, 3], "x", "12-A", "C", {"p": 1, "q": 2}, {"q": 3, "r": 4}), (2, [("g", 0.5)], [(1,), (2,)], None, None, "Persona A", "B", {"p": 1}, {"q": 1})]
    df = spark.createDataFrame(rows, kind)
    return df.select("k", arrays.match_focal(F.col("es"), F.lit("f"))["d"].alias("distance"), F.size(arrays.without_ids(F.col("ps"), F.col("gone"))).alias("left_over"), F.size(arrays.id_list(F.col("id"))).alias("n_ids"), arrays.rename_persona(F.col("persona"), F.col("letter")).alias("renamed"), F.size(arrays.merged_map(F.col("a"), F.col("b"))).alias("merged"))


@query("v, x", "(1, 0.6), (2, 0.0)")
def fx_unit_vectors(spark, d):
    return spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "v int, a array<double>").select("v", F.round(unit(F.col("a"))[0], 6).alias("x"))


@query("place, name", "(1, 'A'), (26, 'Z'), (27, 'AA'), (702, 'ZZ'), (703, 'AAA')")
def fx_letters(spark, d):
    return spark.createDataFrame([(p,) for p in (1, 26, 27, 702, 703)], "place int").select("place", text.letters(F.col("place")).alias("name"))


@query("AuthorId, term_id", "(1, 20), (1, 21), (2, 20)")
def fx_generic_tails(spark, d):
    """Generic last words go where a term without them is known: a component methodology of x becomes x, y's method stays."""
    rows = [(1, 1, 20, "x"), (1, 2, 22, "x component methodology"), (1, 3, 21, "y method"), (2, 4, 22, "x component methodology")]
    scored = ti.strategy_merged(spark.createDataFrame(rows, "AuthorId bigint, PaperId bigint, term_id bigint, term_display string"))
    return scored.select("AuthorId", "term_id")


@query("g, term_display, rank", "(1, 'a', 1), (1, 'c', 2), (1, 'e', 3)")
def fx_diversified(spark, d):
    """``b`` is too like the last chosen, ``d`` too like the first; a repeated term is passed over."""
    terms = spark.createDataFrame([(1, t, 9.0 - i) for i, t in enumerate(["a", "b", "c", "d", " a", "e"])], "g int, term_display string, relevance double")
    graph = spark.createDataFrame([(1, "a", "b", 0.7), (1, "a", "d", 0.8), (1, "c", "d", 0.1), (1, "c", "e", 0.5)], "g int, term_1 string, term_2 string, similarity double")
    return rk.diversified_terms(terms, graph, "g")


@query("g, term_display, rank, score", "(1, 'b', 1, 0.486486), (1, 'a', 2, 0.256757), (1, 'c', 3, 0.256757), (2, 'x', 1, 0.0), (2, 'y', 2, 0.0)")
def fx_text_rank(spark, d):
    """A star: its centre first; a group without edges in order of relevance."""
    terms = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0), (2, "x", 2.0), (2, "y", 1.0)], "g int, term_display string, relevance double")
    graph = spark.createDataFrame([(1, "a", "b", 0.5), (1, "b", "c", 0.5)], "g int, term_1 string, term_2 string, similarity double")
    return rk.text_rank(terms, graph, "g").withColumn("score", F.round("score", 6))


_TWO_CLIQUES = [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (4, 5, 1.0), (4, 6, 1.0), (5, 6, 1.0), (3, 4, 1.0)]


def _ego_graph(spark):
    return spark.createDataFrame([(0, i, 1.0) for i in range(1, 7)] + _TWO_CLIQUES, "src long, dst long, weight double")


@query("node, component, neighbour", "(0, 0, 1), (0, 0, 2), (0, 0, 3), (0, 1, 4), (0, 1, 5), (0, 1, 6)")
def fx_ego_split(spark, d):
    """The net of a node that knows two cliques joined by one edge falls into the cliques."""
    return co.split_egos(_ego_graph(spark)).where("node = 0").select("node", "component", "neighbour")


@query("src_node, src_component, dst_node, n", "(0, 0, 1, 1), (0, 0, 2, 1), (0, 0, 3, 1), (0, 1, 4, 1), (0, 1, 5, 1), (0, 1, 6, 1)")
def fx_persona_graph(spark, d):
    graph = _ego_graph(spark)
    return co.persona_graph(graph, co.split_egos(graph)).where("src_node = 0").groupBy("src_node", "src_component", "dst_node").agg(F.count(F.lit(1)).alias("n"))


@query("node, clusters", "(1, 'a,b'), (2, 'a')")
def fx_memberships(spark, d):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "a")], "node int, cluster string")
    return co.overlapping_memberships(rows).withColumn("clusters", F.array_join("clusters", ","))


@query("distance", "(0.25)")
def fx_partition_distance(spark, d):
    rows = lambda pairs: spark.createDataFrame(pairs, "node int, cluster int")
    return co.partition_distance(rows([(1, 0), (2, 0), (3, 1), (4, 1)]), rows([(1, 0), (2, 0), (3, 1), (4, 2)])).withColumn("distance", F.round("distance", 6))


@query("cluster, AuthorId, pagerank", "(1, 1, 0.256757), (1, 2, 0.486486), (1, 3, 0.256757), (2, 9, 1.0)")
def fx_cluster_pagerank(spark, d):
    graph = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 9, 7.0)], "src bigint, dst bigint, weight double")
    clusters = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "cluster int, AuthorId bigint")
    return cl.cluster_pagerank(graph, clusters).withColumn("pagerank", F.round("pagerank", 6))


@query("AuthorId, persona_id, n", "(1, '1-A', 2), (1, '1-B', 2)")
def fx_ward_personas(spark, d):
    """Two groups of papers far apart are two personas, lettered by their best rank; a lone paper is left out."""
    rows = [(1, 10, 5, [0.0, 0.0]), (1, 11, 6, [0.1, 0.0]), (1, 12, 1, [9.0, 9.0]), (1, 13, 9, [9.1, 9.0]), (1, 14, 0, [99.0, 0.0])]
    papers = spark.createDataFrame(rows, "AuthorId bigint, PaperId bigint, Rank int, vector array<double>")
    return rc.ward_personas(papers, 2.0, 2).groupBy("AuthorId", "persona_id").agg(F.count(F.lit(1)).alias("n"))


@query("AuthorId, persona_id, papers", "(1, '1-A', '1,2'), (1, '1-B', '3'), (2, '2-A', '7,8')")
def fx_adaptive_personas(spark, d):
    """The second threshold adds a persona where two are wanted; one who had none in the first round has none."""
    kind = "AuthorId bigint, persona_id string, PaperId bigint"
    first = spark.createDataFrame([(1, "1-A", 1), (1, "1-A", 2), (2, "2-A", 7), (2, "2-A", 8)], kind)
    second = spark.createDataFrame([(1, "1-A", 3), (1, "1-B", 1), (1, "1-B", 2), (3, "3-A", 5)], kind)
    kept = runs.adaptive_personas([first, second], 2)
    return kept.groupBy("AuthorId", "persona_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("PaperId")), lambda p: p.cast("string")), ",").alias("papers"))


@query("query, AuthorId, rank", "('1', '2', 1), ('1', '3', 2)")
def fx_persona_results(spark, d):
    rows = spark.createDataFrame([("1-A", "2-B", 3), ("1-B", "2-A", 1), ("1-A", "3-A", 2), ("1-A", "1-B", 1)], "query string, AuthorId string, rank int")
    return runs.persona_results(rows)


@query("metric, old, new, change", "('hit_at_k', 0.0, 0.5, 0.0), ('mrr', 0.25, 0.5, 100.0)")
def fx_compared_evaluations(spark, d):
    rows = lambda h, m: spark.createDataFrame([(h, m, 4)], "hit_at_k double, mrr double, n_queries long")
    return runs.compared_evaluations(rows(0.0, 0.25), rows(0.5, 0.5))


@query("dataset, hit_at_k, n_queries", "('a', 0.5, 2), ('b', 1.0, 1)")
def fx_batch_evaluation(spark, d):
    ranked = spark.createDataFrame([("q", 1, 3), ("r", 2, 11), ("s", 1, 1)], "query string, AuthorId int, rank int")
    truth = lambda pairs: spark.createDataFrame(pairs, "query string, AuthorId int")
    return runs.batch_evaluation({"a": rc.evaluation(ranked, truth([("q", 1), ("r", 2), ("q", None)])), "b": rc.evaluation(ranked, truth([("s", 1)]))}).drop("mrr")


@query("collection_id, n", "('c', 2), ('d', 1)")
def fx_card_update(spark, d):
    """A focal distance is added once; a card that wasn't there comes in."""
    have = spark.createDataFrame([("c", [("f", 0.1)])], "collection_id string, distances array<struct<focal_id:string,distance:double>>")
    more = spark.createDataFrame([("c", "g", 0.2), ("d", "g", 0.3)], "collection_id string, focal_id string, distance double")
    return cd.add_focal(cd.add_focal(have, more), more).select("collection_id", F.size("distances").alias("n"))


@query("focal_id, collection_id, distance, n_terms", "('f', 1, 0.25, 2), ('f', 2, 0.5, NULL)")
def fx_similar_cards(spark, d):
    cards = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "collection_id int, name string")
    near = spark.createDataFrame([("f", 1, "simTask", 0.25), ("f", 2, "simTask", 0.5)], "focal_id string, AuthorId int, condition string, distance double")
    shared = spark.createDataFrame([("f", 1, ["a", "b"])], "focal_id string, collection_id int, sim_terms array<string>")
    return cd.similar_cards(cards, near, shared).select("focal_id", "collection_id", "distance", F.when(F.col("sim_terms").isNotNull(), F.size("sim_terms")).alias("n_terms"))


@query("s, card_id, condition, hide_terms, profile", "('u', '1A', 'simTask', true, 'persona A'), ('u', '2', 'simspecter', false, 'overall')")
def fx_condition_rows(spark, d):
    logs = spark.createDataFrame([("u", {"1A": "simTask_hideTerms", "2": "simspecter"})], "s string, conditions map<string,string>")
    return study.condition_rows(logs, "s")


@query("collection_id, task, n_affiliations, n_topics", "(1, 'b,a', 2, 15), (2, '', 0, 0)")
def fx_author_cards(spark, d):
    cards = spark.createDataFrame([(1,), (2,)], "collection_id int")
    terms = spark.createDataFrame([(1, "Task", "a", 2), (1, "Task", "b", 1), (1, "Metric", "z", 1)], "collection_id int, label string, term_display string, rank int")
    topics = spark.createDataFrame([(1, f"t{i}", float(i)) for i in range(20)], "collection_id int, topic string, score double")
    places = spark.createDataFrame([(1, "x", 3), (1, "y", 4)], "collection_id int, affiliation string, n int")
    full = cd.author_cards(cards, terms, topics, places)
    return full.select("collection_id", F.array_join("Task", ",").alias("task"), F.size("affiliations").alias("n_affiliations"), F.size("topics").alias("n_topics"))
