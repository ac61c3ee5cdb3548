"""A corpus of bibliographic tables within a year window, every table lazy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholark.functions.scores import rank_scaled
from scholark.operators.relational import either_end_in, keep_first, outer_with_origin, year_window


@dataclass
class Corpus:
    """Tables by name from a loader; papers carry ``rank_scaled`` over all years before the window cuts them."""

    load: Callable[[str], DataFrame]
    years: tuple[int | None, int | None] = (None, None)
    kept: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of_directory(cls, spark: SparkSession, directory: str, years: tuple[int | None, int | None] = (None, None)) -> Corpus:
        from scholark.sources.readers import parquet_path

        return cls(lambda name: spark.read.parquet(parquet_path(spark, directory, name)), years)

    def table(self, name: str) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = self.load(name)
        return self.kept[name]

    def papers(self) -> DataFrame:
        """Papers of the window with ``rank_scaled`` and the name of their journal or else conference as ``venue``."""
        papers = year_window(rank_scaled(self.table("Papers")), *self.years)
        for name, key, alias in (("Journals", "JournalId", "__j"), ("ConferenceSeries", "ConferenceSeriesId", "__c")):
            if name in self.kept:
                papers = papers.join(self.table(name).select(key, F.col("DisplayName").alias(alias)), key, "left")
            else:
                papers = papers.withColumn(alias, F.lit(None).cast("string"))
        return papers.withColumn("venue", F.coalesce("__j", "__c")).drop("__j", "__c")

    def authorship(self) -> DataFrame:
        return self.table("PaperAuthorAffiliations").join(self.papers().select("PaperId"), "PaperId", "left_semi")

    def references(self) -> DataFrame:
        """References with either end in the window."""
        return either_end_in(self.table("PaperReferences"), "PaperId", "PaperReferenceId", self.papers(), "PaperId")

    def subset(self, paper_ids: DataFrame) -> dict[str, DataFrame]:
        """All tables cut to some papers (one column ``PaperId``) and what these refer to."""
        papers = self.table("Papers").join(paper_ids.distinct(), "PaperId", "left_semi")
        rows = self.table("PaperAuthorAffiliations").join(papers.select("PaperId"), "PaperId", "left_semi")
        fields = self.table("PaperFieldsOfStudy").join(papers.select("PaperId"), "PaperId", "left_semi")
        semi = lambda name, key, source: self.table(name).join(source.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
        return {
            "Papers": papers,
            "PaperAuthorAffiliations": rows,
            "PaperFieldsOfStudy": fields,
            "PaperReferences": either_end_in(self.table("PaperReferences"), "PaperId", "PaperReferenceId", papers, "PaperId").distinct(),
            "Authors": semi("Authors", "AuthorId", rows),
            "Affiliations": semi("Affiliations", "AffiliationId", rows),
            "FieldsOfStudy": semi("FieldsOfStudy", "FieldOfStudyId", fields),
            "Journals": semi("Journals", "JournalId", papers),
            "ConferenceSeries": semi("ConferenceSeries", "ConferenceSeriesId", papers),
        }

    def find_author(self, name: str) -> DataFrame:
        """The best-ranked author whose display name holds ``name``, no row where there is none."""
        found = self.table("Authors").where(F.col("DisplayName").isNotNull() & F.contains("DisplayName", F.lit(name)))
        return keep_first(found, [F.lit(1)], [F.col("Rank").asc_nulls_last(), F.col("AuthorId")])


def field_subset(first: DataFrame, second: DataFrame, field_id: int, field_name: str) -> DataFrame:
    """Papers of a field by two catalogues: ``first`` has ``PaperId`` and ``FieldOfStudyId``, ``second`` has ``PaperId`` and
    ``fields_of_study``; ``_merge`` says which of them lists the paper under the field."""
    a = first.where(F.col("FieldOfStudyId") == field_id).select("PaperId").distinct()
    b = second.where(F.col("fields_of_study").isNotNull() & F.contains("fields_of_study", F.lit(field_name))).select("PaperId").distinct()
    return outer_with_origin(a, b, ["PaperId"])
