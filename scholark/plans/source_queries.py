"""Round trips through every format: a table is written to the shared folder, read back, and must be what it was."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholark.corpus import Corpus, field_subset
from scholark.operators import terms as tm
from scholark.plans import cards as cd
from scholark.schema import DECLARED
from scholark.session import scratch_path
from scholark.sources import readers, writers
from scholark.sources.catalog import Catalog, Entry
from scholark.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query under its function's name with the SQL that must give the same rows."""

    def add(run):
        QUERIES[run.__name__] = run
        ORACLES[run.__name__] = sql
        return run

    return add


def _references(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("PaperId"), F.col("l_partkey").alias("PaperReferenceId"))


@query("SELECT l_orderkey AS PaperId, l_partkey AS PaperReferenceId FROM lineitem")
def trip_dump(spark, d):
    """Tab-separated dump, converted once, found by its name."""
    home = scratch_path(spark, "trip")
    writers.write_csv(_references(spark, d), f"{home}/in/PaperReferences.txt", header=False, sep="\t")
    for _ in range(2):  # the second time finds the work done
        readers.convert_dump(spark, f"{home}/in", f"{home}/out")
    return spark.read.parquet(readers.parquet_path(spark, f"{home}/out", "PaperReferences"))


@query("""SELECT PaperId, AuthorId, AffiliationId, AuthorSequenceNumber, count(*) AS n FROM paper_author_affiliations WHERE AuthorId IS NOT NULL
    AND PaperId IN (SELECT PaperId FROM paper WHERE "Year" >= 2015 AND "Year" < 2022) GROUP BY ALL""")
def trip_corpus(spark, d):
    """Papers and authorships as dumps, converted and loaded as a corpus with a window of years."""
    home = scratch_path(spark, "trip")
    papers = table(spark, d, "paper").select("PaperId", "Rank", "Year").dropDuplicates(["PaperId"])
    names = [c.split(" ")[0] for c in DECLARED["Papers"].replace("\n", " ").replace("        ", "").split(", ")]
    full = papers.select(*[F.col(c) if c in papers.columns else F.lit(None).cast("string").alias(c) for c in names])
    writers.write_csv(full, f"{home}/in/Papers.txt", header=False, sep="\t")
    rows = table(spark, d, "paper_author_affiliations").where("AuthorId is not null").select("PaperId", "AuthorId", "AffiliationId", "AuthorSequenceNumber", F.lit("").alias("a"), F.lit("").alias("b"))
    writers.write_csv(rows, f"{home}/in/PaperAuthorAffiliations.txt", header=False, sep="\t")
    readers.convert_dump(spark, f"{home}/in", f"{home}/out")
    corpus = Corpus.of_directory(spark, f"{home}/out", (2015, 2022))
    return corpus.authorship().groupBy("PaperId", "AuthorId", "AffiliationId", "AuthorSequenceNumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def trip_named_csv(spark, d):
    home = scratch_path(spark, "trip")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice").write.option("compression", "gzip").csv(home, sep="\t", header=False)
    return readers.read_named_csv(spark, home, "id bigint, price double", sep="\t")


@query("""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, l_discount AS weight FROM lineitem), k AS (SELECT * FROM e WHERE weight > 0.02)
    SELECT 'edge' AS kind, src, dst, weight FROM k UNION ALL SELECT 'vertex', id, NULL, NULL FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)""")
def trip_edges(spark, d):
    """A weighted edge list: light edges go, their ends stay."""
    home = scratch_path(spark, "trip")
    writers.write_csv(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount"), home, header=False)
    vertices, edges = readers.read_edges(spark, home, 0.02)
    return edges.select(F.lit("edge").alias("kind"), "src", "dst", "weight").unionByName(vertices.select(F.lit("vertex").alias("kind"), F.col("id").alias("src")), allowMissingColumns=True)


@query("SELECT vec_id AS id, i, x FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings)")
def trip_embeddings(spark, d):
    """Vectors as JSON lines, a thousand a file."""
    home = scratch_path(spark, "trip")
    writers.write_json_lines(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), home, 1000)
    return readers.read_embeddings(spark, home).select("id", F.posexplode("embedding").alias("i", "x"))


@query("""WITH t AS (SELECT DISTINCT s2_id, term FROM df_ner WHERE s2_id IS NOT NULL AND term IS NOT NULL), p AS (SELECT s2_id, regexp_extract(term, '\\(([A-Z]{2,8})\\)', 1) AS abbrv, trim(regexp_extract(term, '^(.*?)\\s*\\([A-Z]{2,8}\\)', 1)) AS long_form FROM t WHERE regexp_matches(term, '\\([A-Z]{2,8}\\)')),
    o AS (SELECT s2_id, abbrv, min(long_form) AS long_form FROM p WHERE long_form <> '' GROUP BY ALL) SELECT s2_id, abbrv, long_form, 1 AS freq FROM o WHERE NOT regexp_matches(long_form, '[()<>{}]')""")
def trip_abbreviations(spark, d):
    """Abbreviations as JSON lines, read, ranked and cleaned."""
    home = scratch_path(spark, "trip")
    pairs = tm.bracket_abbreviations(table(spark, d, "df_ner").where("s2_id is not null").select("s2_id", "term").distinct(), "s2_id", "term")
    lists = pairs.groupBy(F.col("s2_id").alias("id")).agg(F.collect_list(F.create_map("abbrv", "long_form")).alias("abbreviations"))
    writers.write_json_lines(lists, home)
    return tm.rank_abbreviations(readers.read_abbreviations(spark, home)).select("s2_id", "abbrv", "long_form", "freq")


@query("""SELECT s2_id, label, term, CAST(softmax_score AS DOUBLE) AS softmax_score FROM (SELECT DISTINCT s2_id, label, array_to_string(list_filter(regexp_split_to_array(trim(term), '\\s+'), lambda t: t <> ''), ' ') AS term, softmax_score FROM df_ner
    WHERE s2_id IS NOT NULL AND label IS NOT NULL AND trim(term) <> '')""")
def trip_predictions(spark, d):
    """Terms as nested predictions with token spans, read back as entity rows."""
    home = scratch_path(spark, "trip")
    rows = table(spark, d, "df_ner").where("s2_id is not null and label is not null and trim(term) <> ''")
    rows = rows.select("s2_id", "label", F.filter(F.split(F.trim("term"), r"\s+"), lambda t: t != "").alias("tokens"), "softmax_score").distinct()
    docs = rows.groupBy("s2_id").agg(F.collect_list(F.struct("tokens", "label", "softmax_score")).alias("x"))
    starts = F.transform("x", lambda e, i: F.aggregate(F.slice("x", F.lit(1), i), F.lit(0), lambda a, y: a + F.size(y["tokens"])))
    entities = F.transform(F.arrays_zip(F.col("x"), starts.alias("s")), lambda z: F.array(z["s"].cast("string"), (z["s"] + F.size(z["x"]["tokens"]) - 1).cast("string"), z["x"]["label"], F.lit("0"), z["x"]["softmax_score"].cast("string")))
    nested = docs.select(F.col("s2_id").cast("string").alias("doc_key"), F.transform("x", lambda e: e["tokens"]).alias("sentences"), F.array(entities).alias("predicted_ner"), F.array().cast("array<array<array<string>>>").alias("predicted_relations"))
    writers.write_json_lines(nested, f"{home}/deep")
    return tm.entity_rows(readers.read_predictions(spark, home, recursive=True, pattern="part-*"))


@query("SELECT DISTINCT trim(term_display) AS term_display FROM df_ner WHERE trim(term_display) <> '' AND NOT contains(term_display, chr(10)) AND NOT contains(term_display, chr(13))")
def trip_stop_terms(spark, d):
    """A list of terms, one a line."""
    home = scratch_path(spark, "trip")
    terms = table(spark, d, "df_ner").where("trim(term_display) <> ''").select("term_display").where(~F.contains("term_display", F.lit("\n")) & ~F.contains("term_display", F.lit("\r")))
    terms.write.text(home)
    return readers.read_stop_terms(spark, home)


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name FROM customer""")
def trip_upsert(spark, d):
    """A table whose every third key is replaced."""
    home = scratch_path(spark, "trip")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    writers.write_parquet(rows, f"{home}/old")
    writers.write_parquet(rows.where("k < 0"), f"{home}/old")  # what exists stays
    writers.upsert_parquet(rows.where("k % 3 = 0").withColumn("name", F.lit("new")), f"{home}/old", f"{home}/new", "k")
    return spark.read.parquet(f"{home}/new")


@query("SELECT 'customer' AS sheet, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def trip_sheets(spark, d):
    """Sheets as a folder of CSV files each."""
    home = scratch_path(spark, "trip")
    sheets = {"customer": table(spark, d, "customer").select("c_custkey", "c_name"), "supplier": table(spark, d, "supplier").select("s_suppkey", "s_name")}
    writers.write_sheets(sheets, home)
    parts = [spark.read.csv(f"{home}/{name}", header=True, schema="k bigint, name string").select(F.lit(name).alias("sheet"), "k", "name") for name in sheets]
    return parts[0].unionByName(parts[1])


@query("""SELECT DISTINCT CAST(AuthorId AS VARCHAR) AS name, CASE WHEN AuthorId % 2 = 0 THEN 'null' ELSE 'number' END AS score FROM authors""")
def trip_cards(spark, d):
    """Cards as JSON in a folder a name, NaN as null."""
    home = scratch_path(spark, "trip")
    cards = table(spark, d, "authors").select(F.col("AuthorId").alias("collection_id"), F.when(F.col("AuthorId") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("score")).distinct()
    lines = cd.to_json_lines(cards, ["score"])
    writers.write_cards(lines.select(F.concat(F.lit("n"), F.pmod(F.xxhash64("name"), F.lit(8)).cast("string")).alias("name"), "value"), home)
    read = spark.read.text(home).select(F.get_json_object("value", "$.collection_id").alias("name"), F.get_json_object("value", "$.score").alias("s"))
    return read.select("name", F.when(F.col("s").isNull(), "null").otherwise("number").alias("score"))


@query("""SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def catalog_counts(spark, d):
    """Tables of a catalogue in a version built on another, one of them left out."""
    base = Catalog("first", d, {t: Entry(f"{t}.parquet") for t in ("nation", "region", "part")})
    later = base.with_entries("second", {"supplier": Entry("supplier.parquet")})
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in later.load_all(spark, without=["part"]).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('a.csv'), ('b.csv')) t(value)")
def folder_listing(spark, d):
    home = scratch_path(spark, "trip")
    for name in ("b.csv", "a.csv", "c.txt"):
        writers.write_csv(table(spark, d, "region"), f"{home}/{name}")
    writers.write_listing(spark, home, ".csv")
    return spark.read.text(f"{home}/directory.txt")


@query("""SELECT coalesce(a.PaperId, b.PaperId) AS PaperId, CASE WHEN a.PaperId IS NULL THEN 'right_only' WHEN b.PaperId IS NULL THEN 'left_only' ELSE 'both' END AS _merge
    FROM (SELECT DISTINCT l_orderkey AS PaperId FROM lineitem WHERE l_partkey % 97 = 3) a FULL JOIN (SELECT o_orderkey AS PaperId FROM orders WHERE contains(o_orderpriority, 'HIGH')) b ON a.PaperId = b.PaperId""")
def field_papers(spark, d):
    """Papers of a field by two catalogues, with where they are listed."""
    first = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("PaperId"), F.when(F.col("l_partkey") % 97 == 3, F.lit(3)).alias("FieldOfStudyId"))
    second = table(spark, d, "orders").select(F.col("o_orderkey").alias("PaperId"), F.col("o_orderpriority").alias("fields_of_study"))
    return field_subset(first, second, 3, "HIGH")
