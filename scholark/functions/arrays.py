"""Expressions on arrays and maps of nested documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_focal(entries: Column, focal: Column, field: str = "focal_id") -> Column:
    """The first of an array of structs whose ``field`` equals ``focal``; null where there is none."""
    return F.get(F.filter(entries, lambda x: x[field] == focal), F.lit(0))


def without_ids(entries: Column, ids: Column, field: str = "PaperId") -> Column:
    """An array of structs without those whose ``field`` is among ``ids``; null ids take nothing away."""
    return F.filter(entries, lambda x: ~F.coalesce(F.array_contains(ids, x[field]), F.lit(False)))


def ordered_distinct(values: Column) -> Column:
    """An array with each value at its first place only."""
    return F.array_distinct(values)


def id_list(value: Column) -> Column:
    """A single id as an array of it."""
    return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))


def rename_persona(persona: Column, letter: Column) -> Column:
    """A persona id or name with its letter replaced: ``12-A`` and ``... Persona A``."""
    renamed = F.regexp_replace(persona, r"-[A-Z]+$", F.concat(F.lit("-"), letter))
    return F.regexp_replace(renamed, r"Persona [A-Z]+", F.concat(F.lit("Persona "), letter))


def merged_map(first: Column, second: Column) -> Column:
    """Two maps as one; the second wins."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)
