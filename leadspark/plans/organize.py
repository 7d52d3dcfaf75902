"""From raw target columns to clean, de-duplicated, numbered leads and their change log."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions import values
from leadspark.operators import mapping
from leadspark.operators.rows import any_present, col, mark_duplicates, number_leads
from leadspark.operators.staging import materialize
from leadspark.profile import Profile, load_profile


def as_date(as_of: str | Column) -> Column:
    """The processing day. Accepts ISO text or a Column."""
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp").cast("date")


def as_stamp(as_of: str | Column) -> Column:
    """The processing time as printed in a synthesized timestamp (midnight shows no time)."""
    moment = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
    return F.when(F.date_format(moment, "HHmm") == "0000", F.date_format(moment, "MM/dd/yyyy")).otherwise(
        F.date_format(moment, "MM/dd/yyyy HH:mm"))


def _reason(changed_to: Column, type_name: str) -> Column:
    return F.when(changed_to.isNull(), fv.CHANGE_REASON_NA).otherwise(
        fv.CHANGE_REASONS.get(type_name, fv.CHANGE_REASON_OTHER))


@dataclass
class Organized:
    """Lazy result tables. ``raw`` holds (file_id, src) and one string column per sourced target.

    Every target column exists in ``raw``; auxiliary columns exist where some input feeds them.
    """

    raw: DataFrame
    profile: Profile
    as_of: str | Column
    facts: DataFrame | None = None  # per file: skipped rows, header_inferred, timestamp_synthesized, header lists

    @cached_property
    def names(self) -> list[str]:
        return [c for c in self.profile.all_columns if c in self.raw.columns]

    @cached_property
    def standardized(self) -> DataFrame:
        """One row per input row: standardized values by name, stripped originals in ``raw``, ``empty`` flag."""
        today = as_date(self.as_of)
        cleaned = self.raw.select(
            "file_id", "src",
            *[values.standardize(col(c), self.profile.types[c], today).alias(c) for c in self.names],
            F.struct(*[F.coalesce(values.strip(col(c)), F.lit("")).alias(c) for c in self.profile.columns]).alias("raw"))
        return cleaned.withColumn("empty", ~any_present(self.profile.columns))

    @cached_property
    def stored(self) -> DataFrame:
        """The standardized rows, written once: duplicate keys, numbering and reports all read them, and
        none of them should repeat the value work (or have it inlined into their filters)."""
        return materialize(self.standardized)

    @cached_property
    def changes(self) -> Column:
        def change(name: str) -> Column:
            before, after = F.col("raw").getField(name), col(name)
            return F.when((before != "") & (before != F.coalesce(after, F.lit(fv.NA_TEXT))), F.struct(
                F.lit(name).alias("field"), before.alias("original"),
                F.coalesce(after, F.lit(fv.NA_TEXT)).alias("new"),
                _reason(after, self.profile.types[name]).alias("reason")))

        return F.array_compact(F.array(*[change(c) for c in self.profile.columns]))

    @cached_property
    def marked(self) -> DataFrame:
        """Rows with some value, each flagged whether an earlier row duplicates it."""
        keys = [k for k in self.profile.dedupe_on if k in self.names]
        filled = self.stored.where(~F.col("empty")).withColumn("changes", self.changes).drop("raw", "empty")
        return mark_duplicates(filled, keys)

    @cached_property
    def leads(self) -> DataFrame:
        """Surviving rows with their final 1-based ``row``."""
        return number_leads(self.marked.where(~F.col("duplicate")).drop("duplicate"),
                            self.profile.sort_by, self.profile.types)

    def materialize_leads(self) -> Organized:
        self.__dict__["leads"] = materialize(self.leads)
        return self

    @property
    def organized(self) -> DataFrame:
        """Exactly the target columns, NA printed, with file and row number."""
        return self.leads.select("file_id", "row", *[F.coalesce(col(c), F.lit(fv.NA_TEXT)).alias(c)
                                                     for c in self.profile.columns])

    @property
    def removed_duplicates(self) -> DataFrame:
        labels = list(dict.fromkeys([c for c in ["Full Name"] if c in self.names] + self.profile.dedupe_on))
        return self.marked.where("duplicate").select("file_id", "src", *[col(c) for c in labels if c in self.names])

    @property
    def row_changes(self) -> DataFrame:
        """One row per changed cell of a surviving row."""
        return self.leads.select("file_id", "row", F.posexplode("changes").alias("seq", "c")).select(
            "file_id", "row", "seq", "c.field", "c.original", "c.new", "c.reason")

    @property
    def column_issues(self) -> DataFrame:
        """Per file and target column: missing and altered values, counted before any row is removed."""
        def counts(name: str) -> Column:
            after = col(name)
            return F.struct(
                F.lit(name).alias("column"),
                F.count_if(after.isNull()).alias("na"),
                F.count_if(after.isNotNull() & (after != F.col("raw").getField(name))).alias("fixed"))

        wide = self.stored.groupBy("file_id").agg(F.array(*[counts(c) for c in self.profile.columns]).alias("c"))
        return wide.select("file_id", F.explode("c").alias("c")).select("file_id", "c.column", "c.na", "c.fixed")

    @property
    def invalid_phones(self) -> DataFrame:
        return self.leads.where(~values.phone_valid(col("Phone Number"))).select(
            "file_id", "row", col("Phone Number").alias("phone"))

    @property
    def counts(self) -> DataFrame:
        """Row counts per file."""
        totals = self.stored.groupBy("file_id").agg(
            F.count("*").alias("input_rows"), F.count_if("empty").alias("empty_rows_skipped"))
        repeats = self.marked.groupBy("file_id").agg(F.count_if("duplicate").alias("duplicates_removed"))
        joined = totals.join(repeats, "file_id", "left").withColumn(
            "duplicates_removed", F.coalesce("duplicates_removed", F.lit(0).cast("bigint")))
        return joined.withColumn("output_rows", F.col("input_rows") - F.col("empty_rows_skipped")
                                 - F.col("duplicates_removed"))

    @property
    def summary(self) -> DataFrame:
        """One row per file: counts, layout facts, and whether nothing was recognized."""
        numbers = ["input_rows", "output_rows", "duplicates_removed", "empty_rows_skipped"]
        if self.facts is None:
            full = self.counts
        else:  # files without any row keep zeroed counts
            full = self.facts.join(self.counts, "file_id", "left")
        full = full.select([c for c in full.columns if c not in numbers]
                           + [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers])
        return full.withColumn("unrecognized", (F.col("output_rows") == 0) & (F.col("input_rows") > 0))


def map_table(df: DataFrame, profile: Profile, skip: tuple[str, ...] = ("file_id", "src"),
              fuzzy: bool = True) -> list:
    """Classified headers of one table (a row per column, so collecting them is bounded by its width)."""
    names = F.array(*[F.lit(c) for c in df.columns if c not in skip])
    table = df.sparkSession.range(0, 1, 1, 1).select(F.lit("table").alias("file_id"),
                                                     F.posexplode(names).alias("ordinal", "header"))
    return sorted(mapping.classify_headers(table, profile, fuzzy).collect(), key=lambda r: r["ordinal"])


def _composed(parts: list[Column], separator: str) -> Column:
    """Join the parts that hold a value."""
    trimmed = F.transform(F.array(*parts), lambda p: values.strip(p.cast("string")))
    return F.array_join(F.filter(trimmed, lambda p: ~values.is_missing(p)), separator)


def raw_table(df: DataFrame, profile: Profile, as_of: str | Column, headers: list) -> DataFrame:
    """Project a headed table to the profile's raw target columns. Columns never read are pruned by Spark."""
    sources: dict[str, list] = {}
    for h in headers:
        if h["target"] is not None:
            sources.setdefault(h["target"], []).append(h)
    columns = []
    for target in profile.all_columns:
        found = sorted(sources.get(target, []), key=lambda h: h["part"])
        if len(found) > 1 or (found and found[0]["status"] == "composed"):
            value = _composed([col(h["header"]) for h in found], profile.separator(target))
        elif found:
            value = col(found[0]["header"]).cast("string")
        elif target in profile.aux_columns:
            continue
        elif target == profile.synthesized_column:
            value = as_stamp(as_of)
        else:
            value = F.lit(None).cast("string")
        columns.append(value.alias(target))
    return df.select("file_id", "src", *columns)


def organize_table(df: DataFrame, profile: str | dict | Profile = "default", as_of: str = "now",
                   order_col: str | None = None, file_col: str | None = None) -> Organized:
    """Clean any DataFrame. ``order_col`` is a unique BIGINT giving the row order; ``file_col`` names the source."""
    profile = load_profile(profile)
    skip = tuple(c for c in (order_col, file_col) if c)
    body = [c for c in df.columns if c not in skip]
    position = F.col(order_col).cast("bigint") if order_col else F.monotonically_increasing_id()
    origin = col(file_col) if file_col else F.lit("table")
    headed = df.select(origin.alias("file_id"), position.alias("src"), *[col(c) for c in body]).where(any_present(body))
    headers = map_table(df, profile, skip)
    raw = raw_table(headed, profile, as_of, headers)
    dropped = [h["header"] for h in headers if h["status"] == "dropped"]
    unmapped = [h["header"] for h in headers if h["status"] == "unmapped"]
    mapped = {h["target"] for h in headers if h["target"]}

    def listed(items: list[str]) -> Column:
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    facts = raw.select("file_id").distinct().select(
        "file_id", F.lit("table").alias("layout"), F.lit(0).cast("bigint").alias("skipped_non_lead_rows"),
        F.lit(False).alias("header_inferred"),
        F.lit(bool(profile.synthesized_column) and profile.synthesized_column not in mapped)
        .alias("timestamp_synthesized"),
        listed(dropped).alias("dropped_headers"), listed(unmapped).alias("unmapped_headers"))
    return Organized(raw, profile, as_of, facts)
