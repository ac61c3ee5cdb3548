"""Hand-made rows, one trap each."""

import json
import math

import pytest
from pyspark.sql import functions as F

from scholark.functions import scores, text, vectors
from scholark.operators import relational as rel
from scholark.operators import terms as tm
from scholark.operators import tfidf as ti
from scholark.operators.graph import coauthors as co
from scholark.operators.graph.components import connected_components, pairs_within
from scholark.plans import cards, recommend, study
from scholark.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_constant_scaler(spark):
    df = spark.createDataFrame([(1, 1, True, 0.3)], "AuthorId int, seq int, is_last_author boolean, rank_scaled double")
    assert scores.author_paper_scores(df, ["AuthorId"]).first()["score"] == 0.5


def test_author_position(spark):
    df = scores.author_positions(spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "PaperId int, seq int"))
    weights = df.select("seq", scores.position_weight(F.col("seq"), F.col("is_last_author")).alias("w"))
    assert rows(weights) == [(1, 1.0), (2, 0.75), (3, 1.0)]


def test_year_window_and_rank_before_it(spark):
    df = spark.createDataFrame([(1, 2014, 10), (2, 2016, 20), (3, 2016, 30), (4, None, 15)], "PaperId int, Year int, Rank int")
    assert rows(rel.year_window(scores.rank_scaled(df), 2015, 2022).select("PaperId", "rank_scaled")) == [(2, 0.5), (3, 0.0)]
    years = spark.createDataFrame([(y,) for y in (2014, 2015, 2021, 2022)] + [(None,)], "Year int")
    assert rows(rel.year_window(years, 2015, 2022)) == [(2015,), (2021,)]


def test_projection(spark):
    edges = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a")], "PaperId int, AuthorId string")
    assert rows(co.project(edges)) == [("a", "b", 1.5), ("a", "c", 0.5), ("b", "c", 0.5)]
    assert dict(co.publications(edges).collect())["a"] == 3


def test_title_dedup(spark):
    df = spark.createDataFrame([(1, "ab c", None), (2, "a bc", "Conference"), (3, "abc", "Journal"), (4, None, "Book"), (5, None, None)], "PaperId int, title string, DocType string")
    assert [r[0] for r in rows(rel.drop_duplicate_titles(df))] == [3, 4]


def test_tfidf(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, 7)], "AuthorId int, term_id int")
    got = {(r[0], r[1]): round(r[2], 6) for r in ti.author_tfidf(df).collect()}
    assert got == {(1, 10): 0.81818, (1, 11): 0.574962, (2, 10): 1.0}


def test_mean_is_not_divided_by_weights(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0.5), (1, [0.0, 1.0], 1.0), (None, [1.0, 1.0], 1.0), (2, None, 1.0)], "k int, v array<double>, w double")
    assert rows(vectors.mean_vectors(df, ["k"], "v", "w")) == [(1, [0.25, 0.5])]


def test_two_stage_top(spark):
    df = spark.createDataFrame([("A", 0.1, 0.2), ("B", 0.2, 0.9), ("C", 0.3, 0.95), ("D", None, 1.0)], "AuthorId string, task_dist double, method_dist double")
    assert [r["AuthorId"] for r in rel.two_stage_top(df, "task_dist", "method_dist", 2, "AuthorId").orderBy("rank").collect()] == ["B", "A"]


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 2.0]


def test_display_term(spark):
    df = spark.createDataFrame([("datum science", "data science", "Data Science")] * 3 + [("datum science", "datum science", "datum science"), ("x", "x", "x"), (None, "y", "y")], "term_normalized string, term_cleaned string, term string")
    assert rows(tm.display_terms(df)) == [("datum science", "data science")]


def test_cleaning_and_abbreviations(spark):
    df = spark.createDataFrame([("Deep net  (DN) foo (bar", [("DN", "deep net")])], "t string, p array<struct<abbrv:string,long_form:string>>")
    assert df.select(text.clean_term(F.col("t"))).first()[0] == "deep net foo"
    two = spark.createDataFrame([("a DN and dn", [("DN", "deep net")]), ("plain", None)], "t string, p array<struct<abbrv:string,long_form:string>>")
    assert [r[0] for r in two.select(text.expand_abbreviations(F.col("t"), F.col("p"))).collect()] == ["a deep net and dn", "plain"]
    upper = spark.createDataFrame([("big DNA",), ("Dna",), ("",)], "t string")
    assert [r[0] for r in upper.select(text.mostly_upper(F.col("t"))).collect()] == [True, False, False]


def test_segments(spark):
    df = spark.createDataFrame([(1, i, t, k) for i, (t, k) in enumerate([("view", 0), ("click", 1), ("view", 0), ("click", 2), ("view", 0)])], "u int, i int, t string, k int")
    got = study.click_segments(df, "u", ["i"], F.col("t") == "click", F.col("k"))
    assert rows(got.select("i", "segment", "node_id")) == [(1, 1, 1), (2, 1, 1), (3, 2, 2), (4, 2, 2)]


def test_null_group_key_is_absent(spark):
    terms = spark.createDataFrame([(1, None), (1, "t")], "PaperId int, term_display string")
    weights = spark.createDataFrame([(1, 9, 0.5), (1, 9, None)], "PaperId int, collection_id int, relevance_score double")
    assert rows(tm.term_relevance(terms, weights, ["collection_id", "term_display"])) == [(9, "t", 0.5, 1)]


def test_novelty(spark):
    df = spark.createDataFrame([(1, "f", 0.5), (1, "n", 0.5), (2, "f", 0.9), (2, "n", 0.1), (3, "f", 0.9)], "u int, c string, v double")
    assert rows(study.novelty_wins(df, ["u"], "c", "v", "f", "n")) == [(1, None), (2, 1), (3, 0)]


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert rows(rel.upsert(old, new, "k")) == [(1, "x"), (2, "z")]
    kind = "s2_id int, label string, term_normalized string, term_display string, freq int"
    a, b = spark.createDataFrame([(1, "T", "n", "Old", 1)], kind), spark.createDataFrame([(2, "T", "n", "New", 1)], kind)
    assert {r.term_display for r in tm.upsert_terms(a, b).collect()} == {"Old"}


def test_partition_distance_and_jaccard(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, cluster int")
    assert co.partition_distance(df, df).first()[0] == 0.0
    pair = spark.createDataFrame([([], ["a"]), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in pair.select(scores.overlap_ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5]


def test_js_divergence(spark):
    p, q = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("b", 3)], "k string, v int")
    assert math.isclose(scores.js_divergence(p, q, "k", "v").first()[0], math.log(2))
    assert math.isclose(scores.js_divergence(p, p, "k", "v").first()[0], 0.0)


def test_components_against_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (4, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect())
    assert got == {v: find(v) for v in root if v in got} and set(got) == {v for e in edges if e[0] is not None and e[0] != e[1] for v in e}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_pairs_within(spark, monkeypatch):
    from scholark.operators.graph import components as module

    monkeypatch.setattr(module, "CLASS_BLOCK", 2)
    df = spark.createDataFrame([(i, "x") for i in range(7)] + [(3, "x"), (9, "y"), (None, "x"), (8, None)], "id int, c string")
    assert rows(pairs_within(df, "id", "c", "a", "b")) == sorted(((a, b) for a in range(7) for b in range(a + 1, 7)), key=str)


def test_exclusive_selection(spark):
    table = spark.createDataFrame([(0, i, i / 10, 1 - i / 20) for i in range(1, 8)], "collection_id int, AuthorId int, task_dist double, method_dist double")
    got = recommend.select_exclusive(table, ["simTask", "simMethod"], 2).collect()
    assert sorted((r.condition, r.AuthorId) for r in got) == [("simMethod", 6), ("simMethod", 7), ("simTask", 1), ("simTask", 2)]


def test_persona_letters(spark):
    papers = spark.createDataFrame([(1, i, 100 - i, [float(i // 3), 0.0]) for i in range(6)], "AuthorId bigint, PaperId bigint, Rank int, vector array<double>")
    assert rows(recommend.ward_personas(papers, 0.5, 3)) == sorted([(1, "1-B", i) for i in range(3)] + [(1, "1-A", i) for i in range(3, 6)], key=str)
    assert recommend.ward_personas(papers, 0.5, 4).count() == 0
    assert {r.persona_id for r in recommend.ward_personas(papers, 0.5, 4, keep_all=True).collect()} == {"1-A"}


def test_entities_and_relations(spark):
    doc = ("7", [["deep", "nets"], ["map", "pixels"]], [[["0", "1", "Method", "1", "0.9"]], [["2", "3", "Task", "1", "0.8"]]], [[], [["0", "1", "2", "3", "USED-FOR", "1", "0.7"], ["0", "0", "2", "3", "PART-OF", "1", "0.7"], ["0", "0", "2", "3", "USED-FOR", "1", "0.6"]]])
    df = spark.createDataFrame([doc], "doc_key string, sentences array<array<string>>, predicted_ner array<array<array<string>>>, predicted_relations array<array<array<string>>>")
    assert rows(tm.entity_rows(df)) == [(7, "Method", "deep nets", 0.9), (7, "Task", "map pixels", 0.8)]
    assert rows(tm.relation_rows(df)) == [(7, "USED-FOR", "deep nets", "map pixels", "Method", "Task", 0.7), (7, "USED-FOR", "deep", "map pixels", None, "Task", 0.6)]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "PaperReferences.txt").write_text("1\t2\n3\t4\n")
    (tmp_path / "in" / "Unknown.txt").write_text("x\n")
    assert readers.convert_dump(spark, f"{tmp_path}/in", f"{tmp_path}/out") == ["PaperReferences"]
    assert readers.convert_dump(spark, f"{tmp_path}/in", f"{tmp_path}/out") == []
    assert rows(spark.read.parquet(f"{tmp_path}/out/PaperReferences.parquet")) == [(1, 2), (3, 4)]
    (tmp_path / "tables" / "x_Papers_1.parquet").mkdir(parents=True)
    assert readers.parquet_path(spark, f"{tmp_path}/tables", "Papers").endswith("x_Papers_1.parquet")
    with pytest.raises(ValueError):
        readers.parquet_path(spark, f"{tmp_path}/tables", "Authors")
    (tmp_path / "ego.jsonl").write_text(json.dumps({"1": {"0": [2, 3], "1": [4]}}) + "\n")
    assert rows(readers.read_ego_partitions(spark, f"{tmp_path}/ego.jsonl")) == [(1, 0, 2), (1, 0, 3), (1, 1, 4)]
    (tmp_path / "edges.csv").write_text("1,2,0.5\n2,3,0.02\n")
    vertices, edges = readers.read_edges(spark, f"{tmp_path}/edges.csv", 0.02)
    assert vertices.count() == 3 and rows(edges) == [(1, 2, 0.5)]
    (tmp_path / "eval.csv").write_text('author2,ground_truth_authors\n"[\'11\', \'12-A\']","5 | 6"\n[],7\n')
    assert rows(readers.read_evaluation(spark, f"{tmp_path}/eval.csv")) == [("11", "5"), ("11", "6"), ("12-A", "5"), ("12-A", "6")]


def test_graph_papers_and_logs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"9": {"neighbors": {"papers": ["p", "q", "r"]}}}))
    (tmp_path / "p.json").write_text(json.dumps({"p": {"features": {"Title": "T", "Abstract": "nan", "CitedCount": "x", "AuthorNum": "3"}, "neighbors": {"author": {"9": [2]}}}, "q": {"features": {"Title": "nan", "Abstract": "", "CitedCount": "1", "AuthorNum": "1"}, "neighbors": {"author": {}}}}))
    assert rows(readers.read_graph_papers(spark, f"{tmp_path}/a.json", f"{tmp_path}/p.json")) == [("9", "p", "T", "", 0, 2, 3)]
    log = lambda t: json.dumps({"sessionInfo": {"focalId": "f", "conditions": {}, "distances": {}}, "feedbackList": [], "tracked": [{"action": "a", "nodeId": "n", "timestamp": t}]})
    (tmp_path / "l1.json").write_text(log(1))
    (tmp_path / "l2.json").write_text(log(2))
    merged = readers.read_session_logs(spark, [f"{tmp_path}/l2.json", f"{tmp_path}/l1.json"]).first()
    assert [t.timestamp for t in merged.tracked] == [1, 2]


def test_sinks_and_cards(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    writers.write_parquet(df, f"{tmp_path}/t")
    writers.write_parquet(df.unionByName(df), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    nan = spark.createDataFrame([("A b", float("nan"))], "collection_id string, score double")
    card = cards.to_json_lines(nan, ["score"]).first()
    assert card["name"] == "a-b" and "NaN" not in card["value"]
    have = spark.createDataFrame([("c", [("f", 0.1)])], "collection_id string, distances array<struct<focal_id:string,distance:double>>")
    more = spark.createDataFrame([("c", "g", 0.2), ("d", "g", 0.3)], "collection_id string, focal_id string, distance double")
    once = cards.add_focal(have, more)
    assert rows(cards.add_focal(once, more).select("collection_id", F.size("distances"))) == [("c", 2), ("d", 1)]


def test_stream_windows(spark, tmp_path):
    from scholark.streaming.segments import latest, session_counts, windowed_counts

    df = spark.createDataFrame([("2024-01-01 00:00:10", 1), ("2024-01-01 00:00:50", 1), ("2024-01-01 00:07:00", 1)], "ts string, k int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, counted in (("windows", windowed_counts(stream, "ts", "k", "1 minute", "1 minute")), ("sessions", session_counts(stream, "ts", "k", "2 minutes", "1 minute"))):
        query = counted.writeStream.outputMode("complete" if name == "windows" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]
    assert sorted(r["n"] for r in spark.table("sessions").collect())[-1:] == [2]
    versions = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 0)], "k int, v string, batch int, o int")
    assert rows(latest(versions, "k", "o").select("k", "v")) == [(1, "b")]


# session


def test_no_machine_local_folder_on_a_cluster(spark):
    from scholark import session

    class Unset:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Unset()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    copy = session.cut_lineage(spark.range(3))
    assert copy.count() == 3
    session.release(copy)
    with pytest.raises(Exception):
        spark.read.parquet(copy._cut_path).count()
