"""Term extraction, normalisation, classification and relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholark.constants import IN_CONTEXT, IN_TERM, LABELS, METHOD_PATTERNS, METHOD_WORDS, SOFTMAX_LEAST, TASK_WORDS, TERMS_LEAST, TIE_WORDS
from scholark.functions.text import expand_abbreviations, has_bracket, mostly_upper, span_text
from scholark.operators.relational import dense_ids, keep_first


def display_terms(rows: DataFrame, norm: str = "term_normalized", cleaned: str = "term_cleaned", raw: str = "term") -> DataFrame:
    """``norm``, ``term_display``: the cleaned form of the most frequent (norm, cleaned, raw) triple, ties by cleaned then raw.

    Rows with a null in the triple don't count; a norm with a single triple has no row (its cleaned form stands).
    """
    triples = rows.select(norm, cleaned, raw).dropna().groupBy(norm, cleaned, raw).agg(F.count(F.lit(1)).alias("freq"))
    best = triples.groupBy(norm).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.negative("freq").alias("f"), F.col(cleaned).alias("c"), F.col(raw).alias("r"))).alias("b"))
    return best.where("n > 1").select(norm, F.col("b.c").alias("term_display"))


def bracket_abbreviations(rows: DataFrame, doc: str, term: str) -> DataFrame:
    """``doc``, ``abbrv``, ``long_form`` from terms written as ``long form (ABC)``; the smallest long form of each."""
    pattern = r"^(.*?)\s*\([A-Z]{2,8}\)"
    found = rows.where(F.col(term).rlike(r"\([A-Z]{2,8}\)")).select(doc, F.regexp_extract(term, r"\(([A-Z]{2,8})\)", 1).alias("abbrv"), F.trim(F.regexp_extract(term, pattern, 1)).alias("long_form"))
    return found.where("long_form <> ''").groupBy(doc, "abbrv").agg(F.min("long_form").alias("long_form"))


def rank_abbreviations(pairs: DataFrame, doc: str = "s2_id") -> DataFrame:
    """Per document and abbreviation the most frequent long form; afterwards, forms without capitals, in brackets or null go."""
    best = keep_first(pairs, [doc, "abbrv"], [F.desc("freq"), F.asc("long_form")])
    return best.dropna(subset=["abbrv", "long_form"]).where(mostly_upper(F.col("abbrv")) & ~has_bracket(F.col("abbrv")) & ~has_bracket(F.col("long_form")))


def expand_terms(rows: DataFrame, pairs: DataFrame, doc: str, term: str) -> DataFrame:
    """``doc``, ``term``, ``expanded`` for documents that have pairs: their abbreviations written out, in order of name."""
    lists = pairs.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("abbrv", "long_form"))).alias("pairs"))
    return rows.where(F.col(term).isNotNull()).join(lists, doc).select(doc, term, expand_abbreviations(F.col(term), F.col("pairs")).alias("expanded"))


def term_frequencies(rows: DataFrame) -> DataFrame:
    """Confident terms of the four labels per paper with ``freq``; of several display forms the smallest."""
    kept = rows.where(F.col("label").isin(*LABELS) & (F.col("softmax_score") >= SOFTMAX_LEAST)).dropna(subset=["s2_id", "term_normalized", "term_display"])
    return kept.groupBy("s2_id", "label", "term_normalized").agg(F.min("term_display").alias("term_display"), F.count(F.lit(1)).alias("freq"))


def finalize_terms(rows: DataFrame) -> DataFrame:
    """``term_frequencies`` with one display form per normalised term and dense ids in order of the term."""
    counted = term_frequencies(rows)
    shown = counted.groupBy("term_normalized").agg(F.min("term_display").alias("term_display"))
    ids = dense_ids(shown, "term_normalized")
    return counted.drop("term_display").join(shown.join(ids, "term_normalized"), "term_normalized")


def conflicting_displays(rows: DataFrame, display: str = "term_display") -> DataFrame:
    """``term_normalized``, ``n``: normal forms with ``n`` > 1 display forms; none may be left where one depends on the other."""
    return rows.where(F.col("term_normalized").isNotNull()).groupBy("term_normalized").agg(F.countDistinct(display).alias("n")).where("n > 1")


def upsert_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """New papers' terms replace the old ones of the same papers; normalised terms already known keep their display form."""
    known = old.groupBy("term_normalized").agg(F.min("term_display").alias("__known"))
    fresh = new.join(known, "term_normalized", "left").withColumn("term_display", F.coalesce("__known", "term_display")).drop("__known")
    stale = old.join(new.select("s2_id").distinct(), "s2_id", "left_anti")
    stale = stale.join(known, "term_normalized").withColumn("term_display", F.col("__known")).drop("__known")
    return stale.unionByName(fresh)


def _any(term: Column, words) -> Column:
    result = F.lit(False)
    for word in dict.fromkeys(words):
        result = result | F.contains(term, F.lit(word))
    return result


def _hits(term: Column, words, weight: float) -> Column:
    result = F.lit(0.0)
    for word in dict.fromkeys(words):
        result = result + F.when(F.contains(term, F.lit(word)), F.lit(weight)).otherwise(F.lit(0.0))
    return result


def classify_by_priority(term: Column) -> Column:
    """``task`` with a task word in the term, else ``method`` with a method word or pattern, else ``task``."""
    return F.when(_any(term, TASK_WORDS), "task").when(_any(term, [*METHOD_WORDS, *METHOD_PATTERNS]), "method").otherwise("task")


def classify_by_weight(term: Column, context: Column) -> Column:
    """The class with more keyword weight in term (1) and context (1/2); on a tie ``task`` if over two words, else ``method``."""
    method = _hits(term, METHOD_WORDS, IN_TERM) + _hits(context, METHOD_WORDS, IN_CONTEXT)
    task = _hits(term, TASK_WORDS, IN_TERM) + _hits(context, TASK_WORDS, IN_CONTEXT)
    long = F.size(F.split(F.trim(term), r"\s+")) > TIE_WORDS
    return F.when(method > task, "method").when(task > method, "task").when(long, "task").otherwise("method")


def _sql_any(words) -> str:
    return " OR ".join(f"contains(term, '{w}')" for w in dict.fromkeys(words))


def _sql_hits(column: str, words, weight: float) -> str:
    return " + ".join(f"CASE WHEN contains({column}, '{w}') THEN {weight} ELSE 0 END" for w in dict.fromkeys(words))


def sql_priority(source: str) -> str:
    return f"SELECT term, CASE WHEN {_sql_any(TASK_WORDS)} THEN 'task' WHEN {_sql_any([*METHOD_WORDS, *METHOD_PATTERNS])} THEN 'method' ELSE 'task' END AS class FROM ({source})"


def sql_weighted(source: str) -> str:
    score = lambda words: f"{_sql_hits('term', words, IN_TERM)} + {_sql_hits('context', words, IN_CONTEXT)}"
    return f"""WITH s AS (SELECT term, context, {score(METHOD_WORDS)} AS m, {score(TASK_WORDS)} AS t FROM ({source}))
        SELECT term, context, CASE WHEN m > t THEN 'method' WHEN t > m THEN 'task' WHEN len(regexp_split_to_array(trim(term), '\\s+')) > {TIE_WORDS} THEN 'task' ELSE 'method' END AS class FROM s"""


def term_relevance(terms: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """``relevance`` (sum) and ``freq`` (non-null weights) of terms over weighted papers; rows with a null key don't count."""
    return weights.join(terms, "PaperId").dropna(subset=keys).groupBy(*keys).agg(F.sum("relevance_score").alias("relevance"), F.count("relevance_score").alias("freq"))


def insufficient_terms(terms: DataFrame, authorship: DataFrame, least: int = TERMS_LEAST, labels: tuple[str, ...] = ("Task", "Method", "Material")) -> DataFrame:
    """``AuthorId`` of authors with under ``least`` different (paper, term) pairs of one of ``labels``; a label of which an
    author has none at all doesn't count against it."""
    rows = terms.where(F.col("label").isin(*labels)).select("PaperId", "term_id", "label").join(authorship.select("PaperId", "AuthorId"), "PaperId")
    counts = rows.distinct().groupBy("AuthorId", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") < least).select("AuthorId").distinct()


def entity_rows(docs: DataFrame) -> DataFrame:
    """``s2_id``, ``label``, ``term``, ``softmax_score`` from nested predictions (``doc_key``, ``sentences``, ``predicted_ner``
    whose items are (start, end, label, raw, softmax) as strings; offsets count over the document)."""
    flat = docs.select("doc_key", "sentences", F.explode(F.flatten("predicted_ner")).alias("e"))
    return flat.select(F.col("doc_key").cast("bigint").alias("s2_id"), F.col("e")[2].alias("label"), span_text(F.col("sentences"), F.col("e")[0].cast("int"), F.col("e")[1].cast("int")).alias("term"), F.col("e")[4].cast("double").alias("softmax_score"))


def relation_rows(docs: DataFrame, kept: str = "USED-FOR") -> DataFrame:
    """Relations of one kind with both ends' terms and labels; a label is null where no entity has exactly that span."""
    item = lambda i: F.col("r")[i].cast("int")
    flat = docs.select("doc_key", "sentences", F.flatten("predicted_ner").alias("ner"), F.explode(F.flatten("predicted_relations")).alias("r")).where(F.col("r")[4] == kept)

    def label(a: Column, b: Column) -> Column:
        same = F.filter("ner", lambda e: (e[0].cast("int") == a) & (e[1].cast("int") == b))
        return F.get(same, F.lit(0))[2]

    return flat.select(
        F.col("doc_key").cast("bigint").alias("s2_id"), F.col("r")[4].alias("label"), span_text(F.col("sentences"), item(0), item(1)).alias("src_term"), span_text(F.col("sentences"), item(2), item(3)).alias("dst_term"),
        label(item(0), item(1)).alias("src_label"), label(item(2), item(3)).alias("dst_label"), F.col("r")[6].cast("double").alias("softmax_score"),
    )


def drop_long_sentences(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the sentences listed in ``bad`` (``doc_key``, ``sentence_idx``)."""
    lists = bad.groupBy("doc_key").agg(F.collect_set("sentence_idx").alias("__bad"))
    kept = F.filter("sentences", lambda s, i: ~F.array_contains(F.coalesce("__bad", F.array().cast("array<int>")), i.cast("int")))
    return docs.join(lists, "doc_key", "left").withColumn("sentences", kept).drop("__bad")


def tokenise(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``sentences`` (array of arrays of tokens): words and signs apart, empty sentences and documents dropped."""
    parts = F.split(F.col(text), r"(?<=[.!?])\s+")
    tokens = F.transform(parts, lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), F.lit(1)), lambda t: F.length(t) > 0))
    return docs.select(F.col(key), F.filter(tokens, lambda s: F.size(s) > 0).alias("sentences")).where(F.size("sentences") > 0)


def concat_terms(rows: DataFrame, key: str, term: str) -> DataFrame:
    """``key``, ``terms``: all terms of a key (with repeats) in order, joined by spaces: what a text vectoriser would read."""
    return rows.where(F.col(term).isNotNull()).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(term)), lambda t: t.cast("string")), " ").alias("terms"))
