"""Nested profile documents of authors and collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholark.constants import LABELS
from scholark.functions.text import slug
from scholark.plans import standin as st

CARD_PAPERS, CARD_TOPICS = 5, 15


def paper_structs(papers: DataFrame, authorship: DataFrame) -> DataFrame:
    """``PaperId``, ``paper`` (struct with ``authors`` in order). ``authorship`` has ``PaperId``, ``AuthorId``, ``seq``; each
    paper's author list becomes one array, so papers should be filtered by a bound on authors first."""
    authors = authorship.select("PaperId", "seq", "AuthorId").distinct().groupBy("PaperId").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "AuthorId"))), lambda a: a["AuthorId"]).alias("authors"))
    rest = [c for c in papers.columns if c != "PaperId"]
    return papers.join(authors, "PaperId", "left").select("PaperId", F.struct("PaperId", *rest, "authors").alias("paper"))


def collection_cards(collections: DataFrame, structs: DataFrame, rank: str = "Rank", n: int | None = CARD_PAPERS) -> DataFrame:
    """``collection_id``, ``papers``: the ``n`` papers of best (lowest) rank of each collection, all of them for ``n`` None."""
    rows = collections.join(structs, "PaperId")
    if n is not None:
        place = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.col(f"paper.{rank}").asc_nulls_last(), "PaperId"))
        rows = rows.withColumn("__r", place).where(F.col("__r") <= n)
    return rows.groupBy("collection_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"paper.{rank}").alias("r"), F.col("PaperId").alias("i"), "paper"))), lambda p: p["paper"]).alias("papers"))


def with_lists(cards: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Cards with further arrays (``collection_id``, ``items``), by name; empty where a card has none."""
    for name, df in lists.items():
        cards = cards.join(df.select("collection_id", F.col("items").alias(name)), "collection_id", "left")
    return cards


def first_items(rows: DataFrame, key: str, item: str, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """``collection_id``, ``items``: each key's items in order, the first ``n`` of them if given."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    placed = rows.withColumn("__r", place)
    kept = placed if n is None else placed.where(F.col("__r") <= n)
    return kept.groupBy(F.col(key).alias("collection_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", item))), lambda x: x[item]).alias("items"))


def author_cards(cards: DataFrame, terms: DataFrame, topics: DataFrame, affiliations: DataFrame, n_topics: int | None = CARD_TOPICS) -> DataFrame:
    """Cards with ``topics`` (the ``n_topics`` of highest ``score``), ``affiliations`` (by frequency) and an array of terms a label.

    ``terms`` has ``collection_id``, ``label``, ``term_display``, ``rank``; ``topics`` ``collection_id``, ``topic``, ``score``;
    ``affiliations`` ``collection_id``, ``affiliation``, ``n``. A card without any has empty arrays.
    """
    lists = {
        "topics": first_items(topics, "collection_id", "topic", [F.desc("score"), F.col("topic")], n_topics),
        "affiliations": first_items(affiliations, "collection_id", "affiliation", [F.desc("n"), F.col("affiliation")]),
    }
    for label in LABELS[:3]:
        lists[label] = first_items(terms.where(F.col("label") == label), "collection_id", "term_display", [F.col("rank"), F.col("term_display")])
    joined = with_lists(cards, lists)
    return joined.withColumns({name: F.coalesce(name, F.array().cast("array<string>")) for name in lists})


def compare_cards(strategies: DataFrame) -> DataFrame:
    """``collection_id``, ``strategies``: a map from strategy to its terms in order; ``strategies`` has ``collection_id``, ``strategy``,
    ``rank``, ``term_display``."""
    lists = strategies.groupBy("collection_id", "strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term_display"))), lambda x: x["term_display"]).alias("terms"))
    return lists.groupBy("collection_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "terms")))).alias("strategies"))


def rank_sheet(strategies: DataFrame, names: Sequence[str], blind: bool = False) -> DataFrame:
    """A sheet: ``collection_id``, ``rank`` and a column a strategy; ``blind`` ones are named by letters in the order given."""
    wide = strategies.groupBy("collection_id", "rank").pivot("strategy", list(names)).agg(F.first("term_display"))
    return wide.toDF("collection_id", "rank", *[chr(65 + i) for i in range(len(names))]) if blind else wide


def similar_cards(cards: DataFrame, distances: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Cards of recommended authors with their distance from each focal collection and the terms they share with it."""
    joined = distances.select("focal_id", F.col("AuthorId").alias("collection_id"), "condition", "distance").join(cards, "collection_id")
    return joined if terms is None else joined.join(terms.select("focal_id", "collection_id", "sim_terms"), ["focal_id", "collection_id"], "left")


def add_focal(existing: DataFrame, update: DataFrame, key: str = "collection_id") -> DataFrame:
    """Cards with a further focal distance: ``update`` (``key``, ``focal_id``, ``distance``) is appended to ``distances`` unless
    that focal is there already; unknown cards are added."""
    added = update.select(key, F.struct("focal_id", "distance").alias("__new"))
    joined = existing.join(added, key, "full")
    have = F.coalesce("distances", F.array().cast("array<struct<focal_id:string,distance:double>>"))
    known = F.exists(have, lambda x: x["focal_id"] == F.col("__new.focal_id"))
    return joined.withColumn("distances", F.when(F.col("__new").isNull() | known, have).otherwise(F.array_append(have, F.col("__new")))).drop("__new")


def finite(column: Column) -> Column:
    """NaN as null, so that JSON has a value it can read."""
    return F.when(~F.isnan(column), column)


def to_json_lines(cards: DataFrame, doubles: Sequence[str] = ()) -> DataFrame:
    """``name`` (slug of the id) and ``value`` (the card as JSON, NaN as null)."""
    for column in doubles:
        cards = cards.withColumn(column, finite(F.col(column)))
    return cards.select(slug(F.col("collection_id").cast("string")).alias("name"), F.to_json(F.struct(*cards.columns)).alias("value"))


def cards_flat(spark, d):
    """The five best-ranked papers of every author as a card, flattened again."""
    structs = paper_structs(st.papers(spark, d).select("PaperId", "Rank", "Year"), st.authorship(spark, d))
    cards = collection_cards(st.authorship(spark, d).select(F.col("AuthorId").alias("collection_id"), "PaperId"), structs)
    flat = cards.select("collection_id", F.posexplode("papers").alias("place", "p"))
    return flat.select("collection_id", "place", F.col("p.PaperId").alias("PaperId"), F.col("p.Rank").alias("paper_rank"), F.array_join(F.transform("p.authors", lambda a: a.cast("string")), ",").alias("authors"))


QUERIES = {"cards_flat": cards_flat}

ORACLES = {
    "cards_flat": f"WITH {st.SQL_PAPERS}, {st.SQL_AUTHORSHIP}, a AS (SELECT PaperId, string_agg(CAST(AuthorId AS VARCHAR), ',' ORDER BY seq, AuthorId) AS authors FROM paa GROUP BY 1) SELECT AuthorId AS collection_id, CAST(row_number() OVER (PARTITION BY AuthorId ORDER BY Rnk, PaperId) - 1 AS INT) AS place, PaperId, Rnk AS paper_rank, authors FROM paa JOIN papers USING (PaperId) JOIN a USING (PaperId) QUALIFY row_number() OVER (PARTITION BY AuthorId ORDER BY Rnk, PaperId) <= 5"
}
