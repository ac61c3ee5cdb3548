"""Text expressions on columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholark.constants import METHOD_WORDS, PREFIXES, SUFFIXES, TASK_WORDS, UPPER_SHARE


def clean_term(term: Column) -> Column:
    """Bracketed parts and an unclosed bracket go, runs of spaces become one, then trim and lower case."""
    text = F.regexp_replace(term, r"\s\(.*?\)", "")
    text = F.regexp_replace(text, r"\s\(.*", "")
    return F.lower(F.trim(F.regexp_replace(text, " +", " ")))


def clean_term_min3(term: Column) -> Column:
    """``clean_term``, empty where under three characters are left."""
    cleaned = clean_term(term)
    return F.when(F.length(cleaned) < 3, F.lit("")).otherwise(cleaned)


def expand_abbreviations(term: Column, pairs: Column) -> Column:
    """``pairs`` (array of struct ``abbrv``, ``long_form``) applied in order, each where the original term holds it as a word."""

    def step(acc: Column, pair: Column) -> Column:
        pattern = F.concat(F.lit("\\b\\Q"), pair["abbrv"], F.lit("\\E\\b"))
        return F.when(F.contains(term, pair["abbrv"]), F.regexp_replace(acc, pattern, pair["long_form"])).otherwise(acc)

    return F.aggregate(F.coalesce(pairs, F.expr("cast(array() as array<struct<abbrv:string,long_form:string>>)")), term, step)


def mostly_upper(term: Column, share: float = UPPER_SHARE) -> Column:
    """Whether some token is made of ASCII capitals to at least ``share``."""
    return F.exists(F.split(term, r"\s+"), lambda t: (F.length(t) > 0) & (F.length(F.regexp_replace(t, "[^A-Z]", "")) / F.length(t) >= share))


def strip_generic_tail(term: Column, words: Iterable[str]) -> Column:
    """Generic last words stripped one after another, in the order given."""
    for word in words:
        term = F.regexp_replace(term, f" {word}$", "")
    return term


def title_key(title: Column) -> Column:
    """The title without its spaces (only those), letter case kept."""
    return F.replace(title, F.lit(" "), F.lit(""))


def join_title_abstract(title: Column, abstract: Column) -> Column:
    """``title. abstract``; the title alone where the abstract is null or empty."""
    return F.when(F.coalesce(F.length(abstract), F.lit(0)) == 0, F.coalesce(title, F.lit(""))).otherwise(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), abstract))


def id_part(persona: Column, sign: str = "-") -> Column:
    """What stands before the first ``sign`` of a persona id."""
    return F.split_part(persona, F.lit(sign), F.lit(1))


def span_text(sentences: Column, start: Column, end: Column) -> Column:
    """Tokens ``start`` to ``end`` (inclusive, counted over the whole document) joined by spaces."""
    return F.array_join(F.slice(F.flatten(sentences), start + 1, end - start + 1), " ")


def letters(place: Column, most: int = 4) -> Column:
    """A, B, ..., Z, AA, AB, ... for places from 1 on, up to ``most`` letters."""
    signs = []
    for i in reversed(range(most)):
        shorter = sum(26**k for k in range(1, i + 1))  # names of fewer letters than this sign needs
        signs.append(F.when(place > shorter, F.chr(F.lit(65) + F.floor((place - 1 - shorter) / 26**i) % 26)).otherwise(F.lit("")))
    return F.concat(*signs)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def has_bracket(text: Column) -> Column:
    """Whether a round, angle or curly bracket stands in the text; square ones don't count."""
    return F.coalesce(text.rlike(r"[()<>{}]"), F.lit(False))


def scientific_term(term: Column) -> Column:
    """Whether a term shows a sign of science: a keyword, a technical prefix or suffix, or a digit (terms are lower case)."""
    signs = [F.contains(term, F.lit(w)) for w in dict.fromkeys([*METHOD_WORDS, *TASK_WORDS])]
    signs += [F.endswith(term, F.lit(x)) for x in SUFFIXES] + [F.startswith(term, F.lit(x)) for x in PREFIXES] + [term.rlike(r"\d|[A-Z]{2,}")]
    result = signs[0]
    for sign in signs[1:]:
        result = result | sign
    return result
