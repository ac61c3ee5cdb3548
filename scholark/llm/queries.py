"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholark.llm.clusters import cluster_records, describe_clusters
from scholark.llm.counting import banded, folded, value_frequencies
from scholark.llm.encoding import encode_corpus
from scholark.llm.formatting import collapse_formatting, copy_counts
from scholark.llm.mixing import mix_report, mix_sources
from scholark.llm.names import link_names
from scholark.llm.neighbours import most_similar
from scholark.llm.residue import exclude_residue, mark_residue
from scholark.llm.sql import ORACLES
from scholark.llm.topn import top_n_per_group
from scholark.operators.graph.components import pairs_within
from scholark.session import cut_lineage
from scholark.sources.tables import table


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author id with a readable name and the smallest id of the person or group it stands for."""
    authors = table(spark, sf_dir, "authors").select("AuthorId", "DisplayName", "NormalizedName")
    typed = table(spark, sf_dir, "paper_author_affiliations").select("AuthorId", F.col("OriginalAuthor").alias("name"))
    shown = authors.select("AuthorId", F.coalesce("DisplayName", "NormalizedName").alias("name"))
    # Combined before the join, which then leaves the rows placed as the linking wants them.
    names = shown.unionByName(typed).dropna().distinct().join(authors.select("AuthorId"), "AuthorId", "left_semi")
    return link_names(names, "AuthorId", "name", table(spark, sf_dir, "given_name_forms"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(p2_entities(spark, sf_dir), "AuthorId", "entity", "AuthorId_1", "AuthorId_2")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "tfidf_dfs")
    return top_n_per_group(scores, "AuthorId", "term_id", "tfidf_score", ["term_display"], 5).select("AuthorId", "term_id")


def p3_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best terms of every author with their rank and score."""
    scores = table(spark, sf_dir, "tfidf_dfs")
    return top_n_per_group(scores, "AuthorId", "term_id", "tfidf_score", ["term_display"], 5)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every persona and kind of vector the five most similar personas with similarity and rank."""
    personas = table(spark, sf_dir, "persona_embeddings").select("persona_id", "task_embedding", "method_embedding")
    kinds = [most_similar(personas, "persona_id", f"{kind}_embedding", 5, 64).withColumn("vector_kind", F.lit(kind)) for kind in ("task", "method")]
    return kinds[0].unionByName(kinds[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p4_neighbours(spark, sf_dir)
    return near.select("vector_kind", F.least("persona_id", "neighbour").alias("persona_id_1"), F.greatest("persona_id", "neighbour").alias("persona_id_2")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "paper").select("PaperId", "title")
    groups = collapse_formatting(papers, "PaperId", ["title"], swaps=True).select("PaperId", F.element_at("tuple", 1).alias("code"))
    return pairs_within(groups, "PaperId", "code", "PaperId_1", "PaperId_2")


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title class with the number of papers it stands for."""
    papers = table(spark, sf_dir, "paper").select("PaperId", "title")
    return copy_counts(papers, "PaperId", ["title"], swaps=True).select("representative", "n_records")


def _paper_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "paper").select("PaperId", "title", "abstract")
    return cluster_records(papers, "PaperId", "title", "abstract")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(_paper_clusters(spark, sf_dir), "PaperId", "cluster", "PaperId_1", "PaperId_2")


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and three most typical papers."""
    return describe_clusters(_paper_clusters(spark, sf_dir), "PaperId")


#: A value in fewer papers is rare, one in a larger share of all papers common.
RARE_BELOW, COMMON_SHARE = 3, 0.04


def _term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "df_ner").select("s2_id", "label", "term_cleaned")
    counts = value_frequencies(terms, "label", folded(F.col("term_cleaned")), "s2_id").withColumnRenamed("value", "term_cleaned")
    return banded(counts, terms.agg(F.countDistinct("s2_id")), RARE_BELOW, COMMON_SHARE)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_frequencies(spark, sf_dir).where("band is not null").select("label", "term_cleaned", "band")


def p7_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its counts, its band and what ``grp_counts`` holds for it, repeated tallies taken once."""
    stored = table(spark, sf_dir, "grp_counts").select("chunk_id", "label", folded(F.col("term_cleaned")).alias("term_cleaned"), "term_count").distinct()
    tallies = stored.groupBy("label", "term_cleaned").agg(F.sum("term_count").alias("stored_count"))
    return _term_frequencies(spark, sf_dir).join(tallies, ["label", "term_cleaned"], "left")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mix in which every listed source reaches its share, with copy, shard and position."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(documents, table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every listed source in that mix."""
    return mix_report(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every listed source whether its mix keeps to its cap, and to its share but for a document of each source; and
    whether shards are of one size and numbered without gaps."""
    mix, targets = cut_lineage(p9_mix(spark, sf_dir)), table(spark, sf_dir, "mix_targets")
    slack = mix.groupBy("source").agg(F.max("n_tokens").alias("m")).agg(F.sum("m").alias("slack"))
    shards = mix.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"), F.countDistinct("position").alias("different"))
    whole = shards.agg(((F.max("n") - F.min("n") <= 1) & F.min((F.col("n") == F.col("last")) & (F.col("n") == F.col("different")))).alias("shards_even"))
    report = mix_report(mix, targets).join(targets.select("source", "max_repeats"), "source").crossJoin(F.broadcast(slack)).crossJoin(F.broadcast(whole))
    total = F.sum("n_tokens").over(Window.partitionBy())  # a row a source
    on_share = F.abs(F.col("n_tokens") - F.col("target_share") * total) <= F.col("slack")
    return report.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), on_share.alias("on_share"), "shards_even")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_residue(table(spark, sf_dir, "documents"), "doc_id", "text").where("residue is not null").select("doc_id").distinct()


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what their text is, content included."""
    marked = mark_residue(table(spark, sf_dir, "documents"), "doc_id", "text")
    return marked.groupBy(F.coalesce("residue", F.lit("content")).alias("residue")).agg(F.count(F.lit(1)).alias("n_documents"))


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left once residue is excluded."""
    return exclude_residue(table(spark, sf_dir, "documents"), "text").select("doc_id", "source", "n_chars")


QUERIES = {
    "p2_found": p2_found,
    "p2_entities": p2_entities,
    "p3_found": p3_found,
    "p3_top_terms": p3_top_terms,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_copies": p5_copies,
    "p6_found": p6_found,
    "p6_clusters": p6_clusters,
    "p7_found": p7_found,
    "p7_frequencies": p7_frequencies,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_within": p9_within,
    "p10_found": p10_found,
    "p10_kinds": p10_kinds,
    "p10_kept": p10_kept,
}
