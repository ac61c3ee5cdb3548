"""Whole recommendation runs: exclusions, adaptive personas, other authors, evaluation of several result sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholark.constants import RANK_POOL, RING, VENUE_RATIO, VENUES_LEAST
from scholark.functions.arrays import rename_persona
from scholark.functions.scores import overlap_ratio
from scholark.functions.text import letters
from scholark.operators.graph.coauthors import distances_from
from scholark.operators.relational import hash_order
from scholark.plans.recommend import select_exclusive, select_similar

#: Recommendations a condition for an author and for each of its personas.
AUTHOR_COUNTS = {"simTask": 4, "simMethod": 4, "simTask_distMethod": 4}
PERSONA_COUNTS = {"simTask": 2, "simTask_distMethod": 2}


def exclusion_set(focal: DataFrame, poor: DataFrame, strong: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``collection_id``, ``AuthorId`` that a run leaves out: authors with too few terms (``poor``, one column, for every
    collection), the focal authors (``focal``: both columns), their strong co-authors and those ``taken`` by earlier runs."""
    asked = focal.select("collection_id").distinct()
    parts = [asked.join(poor.toDF("AuthorId").distinct()), focal, strong]
    if taken is not None:
        parts.append(taken)
    result = parts[0].select("collection_id", "AuthorId")
    for part in parts[1:]:
        result = result.unionByName(part.select("collection_id", "AuthorId"))
    return result.distinct()


def full_run(table: DataFrame, excluded: DataFrame, counts: dict[str, int] | None = None, pool: int | str = RANK_POOL) -> DataFrame:
    """``collection_id``, ``condition``, ``AuthorId``, ``rank``: each condition's recommendations in turn, none twice, none excluded."""
    open_table = table.join(excluded, ["collection_id", "AuthorId"], "left_anti")
    counts = AUTHOR_COUNTS if counts is None else counts
    chosen = select_exclusive(open_table, list(counts), max(counts.values()), pool)
    least = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(n))])
    return chosen.where(F.col("rank") <= least[F.col("condition")])


def distance_tables(table: DataFrame, conditions: Sequence[str], n: int, pool: int | str = RANK_POOL) -> DataFrame:
    """``collection_id``, ``condition``, ``AuthorId``, ``rank``: the first ``n`` of every condition, without regard to the others."""
    parts = [select_similar(table, c, pool).where(F.col("rank") <= n).select("collection_id", F.lit(c).alias("condition"), "AuthorId", "rank") for c in conditions]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def adaptive_personas(rounds: Sequence[DataFrame], wanted: int) -> DataFrame:
    """Personas of falling thresholds, relettered: ``AuthorId``, ``persona_id``, ``PaperId``.

    ``rounds`` are the personas by each threshold in turn (same columns). An author's later rounds add personas of other
    papers while it has fewer than ``wanted``; an author without any in the first round has none.
    """
    all_rounds = None
    for i, personas in enumerate(rounds):
        part = personas.groupBy("AuthorId", "persona_id").agg(F.array_sort(F.collect_set("PaperId")).alias("papers")).withColumn("round", F.lit(i))
        all_rounds = part if all_rounds is None else all_rounds.unionByName(part)
    once = all_rounds.groupBy("AuthorId", "papers").agg(F.min(F.struct("round", "persona_id")).alias("f")).select("AuthorId", "papers", "f.round", "f.persona_id")
    counts = once.groupBy("AuthorId", "round").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("AuthorId").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = F.min("round").over(Window.partitionBy("AuthorId")) == 0
    open_rounds = counts.withColumn("before", before).withColumn("begun", begun).where((F.col("before") < wanted) & F.col("begun")).select("AuthorId", "round")
    place = F.row_number().over(Window.partitionBy("AuthorId").orderBy("round", "persona_id"))
    kept = once.join(open_rounds, ["AuthorId", "round"]).withColumn("persona_id", rename_persona(F.col("persona_id"), letters(place)))
    return kept.select("AuthorId", "persona_id", F.explode("papers").alias("PaperId"))


def venue_ratios(authorship: DataFrame, venues: DataFrame, focal_venues: DataFrame, least: int = VENUES_LEAST) -> DataFrame:
    """``AuthorId``, ``ratio``: Jaccard index of each author's venues with the focal ones (one column), for authors with at
    least ``least`` rows with a venue. ``venues`` has ``PaperId``, ``venue``."""
    rows = authorship.select("PaperId", "AuthorId").distinct().join(venues.where("venue is not null"), "PaperId")
    own = rows.groupBy("AuthorId").agg(F.count(F.lit(1)).alias("n"), F.collect_set("venue").alias("vs")).where(F.col("n") >= least)
    asked = focal_venues.toDF("venue").where("venue is not null").agg(F.collect_set("venue").alias("fs"))
    return own.crossJoin(F.broadcast(asked)).select("AuthorId", overlap_ratio(F.col("vs"), F.col("fs")).alias("ratio"))


def other_authors(graph: DataFrame, focal: DataFrame, strong: DataFrame, ratios: DataFrame, n: int, seed: int, ring: tuple[int, int] = RING, least: float = VENUE_RATIO) -> DataFrame:
    """``AuthorId``, ``distance``, ``ratio``: ``n`` authors in a ring around the focal one (one column) that share enough venues
    with it and aren't strong co-authors, in an order that only the seed decides."""
    near = distances_from(graph, focal, ring[1] - 1).where(F.col("distance") >= ring[0]).withColumnRenamed("id", "AuthorId")
    kept = near.join(strong.toDF("AuthorId"), "AuthorId", "left_anti").join(ratios.where(F.col("ratio") >= least), "AuthorId")
    return kept.orderBy(hash_order("AuthorId", seed), "AuthorId").limit(n)


def author_of(key: Column, sign: str = "-") -> Column:
    return F.split_part(key, F.lit(sign), F.lit(1))


def has_personas(embeddings: DataFrame, key: str, sign: str = "-") -> DataFrame:
    """One row ``persona_mode``: whether any key holds the sign of personas."""
    return embeddings.agg(F.coalesce(F.max(F.contains(F.col(key).cast("string"), F.lit(sign)).cast("int")), F.lit(0)).cast("boolean").alias("persona_mode"))


def of_authors(embeddings: DataFrame, key: str, authors: DataFrame, sign: str = "-") -> DataFrame:
    """Embeddings of the evaluated authors (one column of strings), by the author part of a persona's key or the key itself."""
    return embeddings.withColumn("__a", author_of(F.col(key).cast("string"), sign)).join(authors.toDF("__a").distinct(), "__a", "left_semi").drop("__a")


def persona_results(ranked: DataFrame, sign: str = "-") -> DataFrame:
    """Ranked personas as ranked authors: each author at its best persona's rank, persona queries as their authors'."""
    rows = ranked.select(author_of(F.col("query").cast("string"), sign).alias("query"), author_of(F.col("AuthorId").cast("string"), sign).alias("AuthorId"), "rank")
    best = rows.where("query <> AuthorId").groupBy("query", "AuthorId").agg(F.min("rank").alias("best"))
    return best.select("query", "AuthorId", F.row_number().over(Window.partitionBy("query").orderBy("best", "AuthorId")).alias("rank"))


def batch_evaluation(results: dict[str, DataFrame]) -> DataFrame:
    """``dataset``, ``hit_at_k``, ``mrr``, ``n_queries`` of several evaluations."""
    parts = [df.select(F.lit(name).alias("dataset"), "hit_at_k", "mrr", "n_queries") for name, df in results.items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def compared_evaluations(old: DataFrame, new: DataFrame) -> DataFrame:
    """``metric``, ``old``, ``new``, ``change`` in percent of the old value, 0 where that is not positive."""
    flat = lambda df, name: df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in ("hit_at_k", "mrr")])))
    joined = flat(old, "old").join(flat(new, "new"), "metric")
    return joined.withColumn("change", F.when(F.col("old") > 0, (F.col("new") - F.col("old")) / F.col("old") * 100).otherwise(F.lit(0.0)))


def shared_with(scored: DataFrame, members: DataFrame) -> DataFrame:
    """``scored`` cut to papers that some of ``members`` (one column ``AuthorId``) wrote too: the papers of a persona."""
    papers = scored.join(members.toDF("AuthorId").distinct(), "AuthorId", "left_semi").select("PaperId").distinct()
    return scored.join(papers, "PaperId", "left_semi")


def subset_weights(collections: DataFrame, papers: DataFrame) -> DataFrame:
    """``collections`` cut to listed papers (``collection_id``, ``PaperId``) with the weights they have; unknown papers go."""
    return collections.join(papers.select("collection_id", "PaperId").distinct(), ["collection_id", "PaperId"], "left_semi")


def main(argv: Sequence[str] | None = None) -> None:
    """``python -m scholark.plans.runs DIRECTORY AUTHOR [--method ST|sTdM] [--top N] [--exclude ID ...]`` prints recommendations."""
    import argparse

    from scholark.plans.flagship import recommend_for
    from scholark.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("directory")
    parser.add_argument("author", type=int)
    parser.add_argument("--method", choices=("ST", "sTdM"), default="ST")
    parser.add_argument("--top", type=int, default=10)
    parser.add_argument("--exclude", type=int, nargs="*", default=())
    asked = parser.parse_args(argv)
    spark = build_session("recommend")
    for place, row in enumerate(recommend_for(spark, asked.directory, asked.author, asked.method, asked.top, asked.exclude).collect(), 1):  # at most --top rows
        print(f"{place:3} {row['AuthorId']} {row['name'] or ''} task {row['task_dist']:.4f} method {row['method_dist']:.4f}")


if __name__ == "__main__":
    main()
