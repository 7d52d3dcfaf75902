"""Judge numbered leads: violations, corrections, duplicate groups, scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.operators import quality as rules
from leadspark.operators.resolve import duplicate_groups, group_listing
from leadspark.operators.staging import materialize
from leadspark.plans.organize import Organized, as_date
from leadspark.profile import load_quality


@dataclass
class Refined:
    organized: Organized
    settings: dict

    @cached_property
    def judged(self) -> DataFrame:
        """Leads with repaired e-mails and their violations."""
        return rules.judge(self.organized.leads, self.settings, as_date(self.organized.as_of))

    def materialized(self) -> Refined:
        self.__dict__["judged"] = materialize(self.judged)
        return self

    def fix_results(self) -> Refined:
        """Fix group members and scores as well."""
        self.__dict__["members"] = materialize(self.members)
        self.__dict__["scores"] = materialize(self.scores)
        return self

    @property
    def violations(self) -> DataFrame:
        return rules.violation_rows(self.judged)

    @property
    def email_corrections(self) -> DataFrame:
        if "email_fix" not in self.judged.columns:
            return self.judged.sparkSession.createDataFrame(
                [], "file_id string, row bigint, field string, original string, suggested string, "
                    "applied boolean, confidence double")
        return rules.email_corrections(self.judged)

    @cached_property
    def members(self) -> DataFrame:
        """Members of duplicate groups, one row each."""
        return duplicate_groups(self.judged, self.settings)

    @property
    def groups(self) -> DataFrame:
        return group_listing(self.members)

    @cached_property
    def scores(self) -> DataFrame:
        return rules.score(self.judged, self.members, self.organized.profile, self.settings)

    @property
    def verticals(self) -> DataFrame:
        facts = self.organized.facts
        unmapped = facts.select("file_id", "unmapped_headers") if facts is not None else \
            self.judged.sparkSession.createDataFrame([], "file_id string, unmapped_headers array<string>")
        return rules.vertical(self.judged, unmapped, self.organized.profile, self.settings)

    @property
    def totals(self) -> DataFrame:
        """Per file: average score (halves to even), leads in review, group count, vertical."""
        marks = self.scores.groupBy("file_id").agg(
            F.bround(F.avg("score")).cast("int").alias("avg_score"), F.count_if("review").alias("review_rows"),
            F.count_if(F.col("status") == "invalid").alias("invalid_phones"))
        groups = self.members.groupBy("file_id").agg(F.max("group").alias("duplicate_groups"))
        return self.organized.summary.join(marks, "file_id", "left").join(groups, "file_id", "left").join(
            self.verticals, "file_id", "left").withColumns({
                "avg_score": F.coalesce("avg_score", F.lit(0)),
                **{c: F.coalesce(c, F.lit(0).cast("bigint"))
                   for c in ("review_rows", "invalid_phones", "duplicate_groups")}})


def refine(organized: Organized, settings: str | dict | None = None) -> Refined:
    return Refined(organized, load_quality(settings))
