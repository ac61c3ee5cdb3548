"""Duplicates that differ only in formatting, by dictionary encoding.

Every distinct value is canonicalised once and given an integer; records become sorted tuples of such integers and are
grouped on them, so the expensive text work is done once a distinct value and the shuffle carries integers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholark.operators.graph.components import connected_components
from scholark.operators.skew import skew_join
from scholark.session import cut_lineage

#: Share of the rows from which on a value is joined by itself.
HOT_SHARE = 0.015
#: Canonical values with fewer letters are fillers.
LEAST_LETTERS = 4
#: A separator is one of these signs with white space after it.
SEPARATOR = regex.compile(r"[:;|/\p{Pd}−](?=\s)")
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_LETTER = regex.compile(r"\p{L}")


def canonical(text: str) -> str:
    """Letters and digits of ``text`` in order, compatibility forms and case folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _OTHER.sub("", text.casefold())


def swapped(text: str) -> list[str]:
    """Canonical forms of ``text`` after its two parts around one separator changed places, one for each separator."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    found = set()
    for sign in SEPARATOR.finditer(text):
        before, after = canonical(text[: sign.start()]), canonical(text[sign.end() :])
        if before and after:
            found.add(after + before)
    return sorted(found)


def _canonicalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        forms = batch["value"].map(canonical)
        keep = [len(_LETTER.findall(f)) >= LEAST_LETTERS for f in forms]
        yield pd.DataFrame({"value": batch["value"], "form": forms, "swaps": batch["value"].map(swapped)})[keep]


def value_dictionary(values: DataFrame, column: str, swaps: bool) -> DataFrame:
    """``value``, ``code``: an integer for each distinct value of ``column``, equal for values equal but for formatting.

    With ``swaps``, values that come to each other by changing places around one separator also share a code, and so do
    chains of such values. Null values and fillers have no entry. Codes are assigned on a written table, so a lost
    executor can't change them.
    """
    distinct = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    forms = cut_lineage(distinct.mapInPandas(_canonicalise, "value string, form string, swaps array<string>"))
    codes = cut_lineage(forms.select("form").distinct().withColumn("code", F.monotonically_increasing_id()))
    known = forms.join(codes, "form")
    if swaps:
        turned = known.select("code", F.explode("swaps").alias("form")).distinct()
        edges = turned.join(codes.withColumnRenamed("code", "other"), "form").select(F.col("code").alias("src"), F.col("other").alias("dst"))
        merged = connected_components(edges).select(F.col("id").alias("code"), "component")
        known = known.join(merged, "code", "left").withColumn("code", F.coalesce("component", "code"))
    return known.select("value", "code")


def collapse_formatting(df: DataFrame, key: str, fields: Sequence[str], swaps: bool = False) -> DataFrame:
    """``key``, ``tuple`` (array<bigint>): records equal but for case, white space, punctuation or the order of ``fields``
    share a tuple, the sorted codes of their field values.

    A null or filler field takes no place in the tuple; records with no other field have no row. Repeated (key, tuple)
    rows count once. An empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    rows = df.select(F.col(key).alias("k"), F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("value")) for i, c in enumerate(fields)]))).where("value is not null")
    # A value may be a third of all rows: such rows meet their one dictionary entry by broadcast.
    coded = skew_join(rows, value_dictionary(rows, "value", swaps), "value", HOT_SHARE, right_heavy=[])
    if len(fields) == 1:
        return coded.select(F.col("k").alias(key), F.array("code").alias("tuple")).distinct()
    record = coded.groupBy("k", "f").agg(F.collect_set("code").alias("codes")).select("k", F.explode("codes").alias("code"), "f")
    return record.groupBy("k").agg(F.array_sort(F.collect_list("code")).alias("tuple")).select(F.col("k").alias(key), "tuple")


def copy_counts(df: DataFrame, key: str, fields: Sequence[str], swaps: bool = False) -> DataFrame:
    """One row per group of formatting duplicates: ``representative`` (the smallest key), ``n_records``, ``tuple``.

    The count is combined before the shuffle, so a group that holds a third of all rows costs no task more than its
    share. ``n_records`` counts different keys.
    """
    return collapse_formatting(df, key, fields, swaps).groupBy("tuple").agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("n_records")).select("representative", "n_records", "tuple")
