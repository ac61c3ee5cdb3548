"""Filters, joins, set operations and orderings with the domain's null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholark.constants import DOCTYPE_ORDER, ENOUGH_DATA
from scholark.functions.text import title_key


def year_window(df: DataFrame, low: int | None, high: int | None, year: str = "Year") -> DataFrame:
    """Rows with ``low`` <= year < ``high``; a null year goes once either bound is set."""
    if low is not None:
        df = df.where(F.col(year) >= low)
    return df if high is None else df.where(F.col(year) < high)


def in_list(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among the one-column ``values`` (a semi join, so any size)."""
    return df.join(values.toDF(column).distinct(), column, "left_semi")


def not_in_list(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among ``values``; null keys stay, whatever ``values`` holds."""
    return df.join(values.toDF(column).distinct(), column, "left_anti")


def either_end_in(df: DataFrame, a: str, b: str, ids: DataFrame, name: str = "id") -> DataFrame:
    """Rows with ``a`` or ``b`` among ``ids``, repeated rows kept: two existence joins, no union."""
    known = ids.select(F.col(name).alias("__id")).distinct()
    marked = df.join(known.select(F.col("__id").alias(a), F.lit(True).alias("__a")), a, "left").join(known.select(F.col("__id").alias(b), F.lit(True).alias("__b")), b, "left")
    return marked.where(F.coalesce("__a", F.lit(False)) | F.coalesce("__b", F.lit(False))).select(*df.columns)


def in_out_union(df: DataFrame, a: str, b: str, ids: DataFrame, name: str = "id") -> DataFrame:
    """Different rows that have ``a`` or ``b`` among ``ids``."""
    known = ids.select(F.col(name).alias("__id")).distinct()
    first = df.join(known, F.col(a) == F.col("__id"), "left_semi")
    return first.union(df.join(known, F.col(b) == F.col("__id"), "left_semi")).distinct()


def outer_with_origin(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with ``_merge``: ``both``, ``left_only`` or ``right_only``."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), list(on), "full")
    origin = F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), "both").when(F.col("__l").isNotNull(), "left_only").otherwise("right_only")
    return joined.withColumn("_merge", origin).drop("__l", "__r")


def doctype_rank(doctype: Column, order: Sequence[str] = DOCTYPE_ORDER) -> Column:
    """Place of a document type in ``order``; null for others, so they sort last."""
    pairs = [x for i, name in enumerate(order) for x in (F.lit(name), F.lit(i))]
    return F.create_map(*pairs)[doctype]


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in ``order``; equal nulls are one key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", place).where("__r = 1").drop("__r")


def drop_duplicate_titles(papers: DataFrame, title: str = "title", doctype: str = "DocType", key: str = "PaperId", order: Sequence[str] = DOCTYPE_ORDER) -> DataFrame:
    """One paper per title, spaces aside: best document type first, then the smallest key; all null titles are one."""
    return keep_first(papers, [title_key(F.col(title))], [doctype_rank(F.col(doctype), order).asc_nulls_last(), F.col(key)])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; columns missing on a side are null."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def dense_ids(values: DataFrame, column: str, alias: str = "term_id") -> DataFrame:
    """``column`` and its place (from 0) among the different values in order, without one task for all rows.

    Values are range-partitioned and sorted; a first pass counts each partition, a second adds the counts before it.
    """
    ranged = values.select(column).dropna().distinct().repartitionByRange(column).sortWithinPartitions(column)
    numbered = ranged.withColumn("__p", F.spark_partition_id())
    from scholark.session import cut_lineage

    written = cut_lineage(numbered)
    sizes = written.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__b", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__b", F.lit(0)).alias("__b"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1
    return written.withColumn("__l", local).join(F.broadcast(before), "__p").select(column, (F.col("__l") + F.col("__b")).alias(alias))


def two_stage_top(df: DataFrame, near: str, far: str | None, pool: int, key: str, group: Sequence[str] = ()) -> DataFrame:
    """The ``pool`` rows of smallest ``near`` (nulls last), reordered by largest ``far`` (nulls last) if given: ``rank``.

    With ``group``, each group has its own pool; without, the first stage is a distributed take.
    """
    ties = [F.col(near).asc_nulls_last(), F.col(key)]
    if group:
        first = df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*ties))).where(F.col("__r") <= pool).drop("__r")
        window = Window.partitionBy(*group)
    else:
        first, window = df.orderBy(*ties).limit(pool), Window.partitionBy(F.lit(1))
    last = [F.col(far).desc_nulls_last(), *ties] if far else ties
    return first.withColumn("rank", F.row_number().over(window.orderBy(*last)))


def hash_order(key: str, seed: int) -> Column:
    """An order of keys that only key and seed decide."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A sampling operator: ``n`` rows in an order that only key and seed decide."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def not_empty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is neither null nor an empty string."""
    return df.where(F.col(column) != "")


def contains_all(df: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` holds every one of ``parts``; nulls go."""
    for part in parts:
        df = df.where(F.col(column).isNotNull() & F.contains(column, F.lit(part)))
    return df


def enough_data(df: DataFrame, columns: Sequence[str], least: int = ENOUGH_DATA) -> DataFrame:
    """Rows whose arrays ``columns`` all have more than ``least`` elements; a null array has none."""
    for column in columns:
        df = df.where(F.coalesce(F.size(column), F.lit(0)) > least)
    return df


def high_pass(df: DataFrame, papers: str = "num_papers_overall", citations: str | None = None, more_than: int = 5, below: int = 2000) -> DataFrame:
    """Rows of subjects with more than ``more_than`` papers and, where ``citations`` is given, fewer than ``below`` citations."""
    df = df.where(F.col(papers) > more_than)
    return df if citations is None else df.where(F.col(citations) < below)


def with_group_max(df: DataFrame, keys: Sequence[str], column: str, alias: str) -> DataFrame:
    """``df`` with the largest ``column`` of its group, by an aggregate and a join, so a large group is no task's burden."""
    return df.join(df.groupBy(*keys).agg(F.max(column).alias(alias)), list(keys))


def first_rows(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """Each key once, by its first row in ``order``, and of these the first ``n`` in that order."""
    return keep_first(df, [key], order).orderBy(*order).limit(n)


def cascade_terms(terms: DataFrame, keys: Sequence[str], term: str, category: str, place: str, priority: Sequence[str]) -> DataFrame:
    """Terms that no earlier category of ``priority`` (nor an earlier place of their own) holds, letter case aside."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(category))
    known = terms.where(F.col(category).isin(list(priority)) & F.col(term).isNotNull())
    return keep_first(known, [*keys, F.lower(F.col(term))], [rank, F.col(place), F.col(term)])
