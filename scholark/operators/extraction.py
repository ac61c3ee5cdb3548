"""Term candidates, normal forms and abbreviations taken from running text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholark.functions.text import scientific_term
from scholark.operators.terms import classify_by_weight

# Words that bound a candidate.
STOP_WORDS = (
    "a an the of for and or in on to by with from at as is are was were be been it its this that these those we our their they you he she his her not no how what when which who why do does did "
    "can could may might will would should has have had than then so such into over under between about after before via per also more most some any all each both other very only"
).split()
#: Words of a candidate.
CANDIDATE_WORDS = (2, 4)


def normal_form(term: Column) -> Column:
    """Lower-case tokens of letters and digits, plural endings taken off, joined by spaces; null stays null.

    A dictionary-free lemmatiser: ``ies`` becomes ``y``, ``es`` goes after a hissing sound, a single ``s`` goes unless it
    follows ``s``, ``u`` or ``i``; tokens of up to three letters stay.
    """
    tokens = F.regexp_extract_all(F.lower(term), F.lit(r"([a-z0-9]+(?:[-'][a-z0-9]+)*)"), F.lit(1))

    def lemma(t: Column) -> Column:
        short = F.length(t) <= 3
        return F.when(short, t).when(t.rlike("ies$"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(t, "es$", "")).when(t.rlike("[^sui]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)

    return F.array_join(F.transform(tokens, lemma), " ")


def candidates(rows: DataFrame, key: str, text: str, words: tuple[int, int] = CANDIDATE_WORDS, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``key``, ``term``: different runs of ``words`` tokens without a stop word or a bare number, as noun phrases are.

    Runs end at any sign but spaces and inner hyphens. Null texts have none.
    """
    runs = rows.where(F.col(text).isNotNull()).select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}\s-]+")).alias("run"))
    tokens = runs.select(key, F.filter(F.split(F.trim("run"), r"\s+"), lambda t: F.length(t) > 0).alias("ts"))
    stops = F.array(*[F.lit(w) for w in stop])

    def grams(n: int) -> Column:
        runs_of_n = F.transform(F.sequence(F.lit(1), F.size("ts") - (n - 1)), lambda i: F.slice("ts", i, n))
        return F.when(F.size("ts") >= n, runs_of_n).otherwise(F.array().cast("array<array<string>>"))

    many = [grams(n) for n in range(words[0], words[1] + 1)]
    found = tokens.select(key, F.explode(F.concat(*many)).alias("g")).where(~F.arrays_overlap("g", stops) & ~F.exists("g", lambda t: t.rlike(r"^[\d-]+$")))
    return found.select(key, F.array_join("g", " ").alias("term")).distinct()


def extract_terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``term``, ``class``: candidates that show a sign of science, classed with their text as context."""
    found = candidates(rows, key, text).where(scientific_term(F.col("term")))
    context = rows.where(F.col(text).isNotNull()).groupBy(key).agg(F.min(F.lower(text)).alias("context"))
    return found.join(context, key).select(key, "term", classify_by_weight(F.col("term"), F.col("context")).alias("class"))


def author_terms(terms: DataFrame, authorship: DataFrame) -> DataFrame:
    """``AuthorId``, ``class``, ``n_terms``: different terms of each author by class; ``terms`` has ``PaperId``, ``term``, ``class``."""
    return authorship.select("PaperId", "AuthorId").join(terms, "PaperId").select("AuthorId", "class", "term").distinct().groupBy("AuthorId", "class").agg(F.count(F.lit(1)).alias("n_terms"))


def coverage(counts: DataFrame, authors: DataFrame) -> DataFrame:
    """``class``, ``n_authors`` with at least one term of it, ``n_terms`` in all, ``share`` of ``authors`` (one column)."""
    total = authors.distinct().agg(F.count(F.lit(1)).alias("all"))
    sums = counts.groupBy("class").agg(F.count(F.lit(1)).alias("n_authors"), F.sum("n_terms").alias("n_terms"))
    return sums.crossJoin(F.broadcast(total)).select("class", "n_authors", "n_terms", (F.col("n_authors") / F.col("all")).alias("share"))


_SHORT = regex.compile(r"\(([^()]{2,20})\)")


def align_abbreviation(short: str, before: str) -> str | None:
    """The long form at the end of ``before`` that ``short`` abbreviates, or None.

    The short form's letters and digits are found from right to left in at most min(n + 5, 2 n) words, the first at the
    beginning of a word; a long form must be longer than the short one and not hold it.
    """
    signs = [c.lower() for c in short if c.isalnum()]
    if not 2 <= len(short) <= 10 or not signs or not any(c.isalpha() for c in short) or not short[0].isalnum() or len(short.split()) > 2:
        return None
    words = before.split()
    text = " ".join(words[-min(len(signs) + 5, 2 * len(signs)) :])
    at = len(text)
    for i, sign in reversed(list(enumerate(signs))):
        at -= 1
        while at >= 0 and (text[at].lower() != sign or (i == 0 and at > 0 and text[at - 1].isalnum())):
            at -= 1
        if at < 0:
            return None
    begin = text.rfind(" ", 0, at + 1) + 1
    long = text[begin:].strip()
    if len(long) <= len(short) or short in long.split():
        return None
    return long


def abbreviations(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``abbrv``, ``long_form``, ``freq``: bracketed short forms aligned with the words before them."""
    kind = rows.schema[key].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["k"], batch["t"]):
                for m in _SHORT.finditer(t):
                    if long := align_abbreviation(m[1].strip(), t[: m.start()]):
                        out.append((i, m[1].strip(), long))
            yield pd.DataFrame(out, columns=["k", "abbrv", "long_form"])

    marked = rows.where(F.col(text).rlike(r"\([^()]{2,20}\)")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return marked.mapInPandas(find, f"k {kind}, abbrv string, long_form string").groupBy(F.col("k").alias(key), "abbrv", "long_form").agg(F.count(F.lit(1)).alias("freq"))
