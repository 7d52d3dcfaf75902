"""From a folder of messy files to organized leads: route every file by layout, reshape, unite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators import infer, mapping
from leadspark.operators.cards import CARD_COLUMNS, extract_leads
from leadspark.operators.labeled import labeled_leads
from leadspark.operators.layout import (banner_blocks, count_blocks, grid_cells, layout_counts, linear_cells,
                                        locate_header, of_layout, route)
from leadspark.operators.rows import col
from leadspark.operators.staging import materialize, small_side
from leadspark.plans.organize import Organized, as_date, as_stamp
from leadspark.profile import Profile, load_profile, normalize_header
from leadspark.sources.intake import INNER_BREAKS, Intake, files_of, ragged_rows, read_lines

FACTS = "file_id string, skipped bigint"


def header_table(rows: DataFrame, routed: DataFrame) -> DataFrame:
    """``(file_id, ordinal, header)`` of the located header rows, blanks and repeats named."""
    at = routed.where("layout = 'header'").select("file_id", F.col("header_src").alias("src"))
    return mapping.name_headers(rows.join(at, ["file_id", "src"]).select(
        "file_id", F.posexplode("cells").alias("ordinal", "header")))


def header_plan(classified: DataFrame, profile: Profile) -> DataFrame:
    """Projection plan rows of headed files."""
    separators = F.element_at(F.create_map(*[F.lit(x) for t in profile.compose for x in (t, profile.separator(t))]),
                              F.col("target")) if profile.compose else F.lit("")
    composed = F.col("status") == "composed"
    return classified.where("target IS NOT NULL").select(
        "file_id", "target", "part", "ordinal", composed.alias("joined"),
        F.when(composed, separators).otherwise("").alias("separator"))


def project_rows(rows: DataFrame, plan: DataFrame, profile: Profile, stamp: Column) -> DataFrame:
    """Raw target columns of table rows. The plan is one small row per file."""
    entry = F.struct(F.sort_array(F.collect_list(F.struct("part", "ordinal"))).alias("parts"),
                     F.first("joined").alias("joined"), F.first("separator").alias("separator"))
    per_target = plan.groupBy("file_id", "target").agg(entry.alias("entry"))
    per_file = per_target.groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.struct("target", "entry"))).alias("_plan"))
    joined = rows.join(small_side(per_file), "file_id", "left")

    def value(target: str) -> Column:
        e = F.element_at("_plan", target)
        ordinals = F.transform(e["parts"], lambda p: p["ordinal"])
        found = F.when(e["joined"], infer.join_parts(F.col("cells"), ordinals, e["separator"])).when(
            e.isNotNull(), F.get("cells", F.get(ordinals, F.lit(0))))
        return F.when(e.isNull(), stamp).otherwise(found) if target == profile.synthesized_column else found

    return joined.select("file_id", "src", *[value(t).alias(t) for t in profile.all_columns])


def role_plan(plan: DataFrame, profile: Profile) -> DataFrame:
    """The plan of claimed roles under a profile's own column names: a role is a header like any other. Roles that the
    profile knows no column for are left out."""
    known = {r: profile.aliases[normalize_header(r)] for r in infer.ROLES if normalize_header(r) in profile.aliases}
    if not known:
        return plan.limit(0)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return plan.withColumn("target", F.element_at(names, F.col("target"))).where("target IS NOT NULL")


def project_cards(leads: DataFrame, profile: Profile, stamp: Column) -> DataFrame:
    """Raw target columns of card leads, whose columns carry target names already."""
    sources = {profile.aliases[normalize_header(c)]: c for c in CARD_COLUMNS if normalize_header(c) in profile.aliases}
    none = F.lit(None).cast("string")
    missing = {t: stamp if t == profile.synthesized_column else none for t in profile.all_columns}
    return leads.select("file_id", "src", *[(col(sources[t]) if t in sources else missing[t]).alias(t)
                                            for t in profile.all_columns])


def organize_files(spark: SparkSession, path: str, profile: str | dict | Profile = "default",
                   as_of: str = "now", layout: str | None = None) -> tuple[Organized, Intake]:
    """Organize every file below ``path``. ``layout`` forces one layout on all non-linear files."""
    lines = read_lines(spark, path)
    return organize_lines(Intake(lines, files_of(lines)), profile, as_of, layout)


def organize_lines(intake: Intake, profile: str | dict | Profile = "default", as_of: str = "now",
                   layout: str | None = None) -> tuple[Organized, Intake]:
    profile = load_profile(profile)
    spark = intake.profile.sparkSession
    rows, stamp, today = intake.filled_rows, as_stamp(as_of), as_date(as_of)
    routed = route(layout_counts(rows), locate_header(rows, profile))
    if layout:
        routed = routed.withColumn("layout", F.lit(layout))
    routed = small_side(routed)
    present = {r["layout"] for r in routed.select("layout").distinct().collect()}
    frames, skipped, listed, synthesized = [], [], [], []

    if "header" in present:
        headed = rows.join(routed.where("layout = 'header'").select("file_id", "header_src"), "file_id")
        classified = materialize(mapping.classify_headers(header_table(rows, routed), profile))
        plan = header_plan(classified, profile)
        frames.append(project_rows(headed.where("src > header_src").select("file_id", "src", "cells"), plan, profile, stamp))
        skipped.append(routed.where("layout = 'header'").select("file_id", F.col("header_index").alias("skipped")))
        listed.append(mapping.header_report(classified))
        synthesized.append(plan)
    if "inferred" in present:
        body = of_layout(rows, routed, "inferred")
        leads = infer.lead_rows(body)
        plan = materialize(role_plan(infer.claim_roles(infer.profile_columns(infer.column_samples(leads), today)), profile))
        frames.append(project_rows(leads, plan, profile, stamp))
        few = F.count_if(F.size(F.filter("cells", lambda c: c.isNotNull())) < infer.fv.LEAD_MIN_CELLS)
        skipped.append(body.groupBy("file_id").agg(few.alias("skipped")))
        synthesized.append(plan)
    if "grid" in present:
        body = of_layout(rows, routed, "grid")
        frames.append(project_cards(extract_leads(grid_cells(body)), profile, stamp))
        skipped.append(banner_blocks(body).groupBy("file_id").agg(F.count_if("banner").alias("skipped")))
    if "labeled" in present:
        frames.append(project_cards(labeled_leads(of_layout(rows, routed, "labeled")), profile, stamp))
    if intake.profile.where("linear").limit(1).count():
        cells = linear_cells(intake.linear_lines, INNER_BREAKS)
        leads = materialize(extract_leads(cells))
        frames.append(project_cards(leads, profile, stamp))
        found = leads.groupBy("file_id").agg(F.count("*").alias("found"))
        skipped.append(count_blocks(cells).join(found, "file_id", "left").select(
            "file_id", F.greatest(F.col("blocks") - F.coalesce("found", F.lit(0)), F.lit(0)).alias("skipped")))

    raw = _united(frames, spark, profile)
    facts = _facts(intake, routed, skipped, listed, synthesized, profile)
    return Organized(materialize(raw), profile, as_of, facts), intake


def _united(frames: list[DataFrame], spark: SparkSession, profile: Profile) -> DataFrame:
    if not frames:
        columns = ", ".join(f"`{c}` string" for c in profile.all_columns)
        return spark.createDataFrame([], f"file_id string, src bigint, {columns}")
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame)
    return united


def _facts(intake: Intake, routed: DataFrame, skipped: list[DataFrame], listed: list[DataFrame],
           synthesized: list[DataFrame], profile: Profile) -> DataFrame:
    """One row per file, files without rows included."""
    spark = intake.profile.sparkSession
    none = F.array().cast("array<string>")

    def union(frames: list[DataFrame], schema: str) -> DataFrame:
        result = spark.createDataFrame([], schema)
        for frame in frames:
            result = result.unionByName(frame.select(result.columns))
        return result

    stamped = union(synthesized, infer.PLAN_SCHEMA).where(
        F.col("target") == (profile.synthesized_column or "")).select("file_id", F.lit(True).alias("_stamped")).distinct()
    layout = F.when(F.col("linear"), "linear").when(F.col("kind") != "text", F.col("kind")).otherwise(
        F.coalesce("layout", F.lit("empty")))
    ragged = ragged_rows(intake.rows)
    lists = union(listed, "file_id string, dropped_headers array<string>, unmapped_headers array<string>")
    table = (intake.profile.select("file_id", "kind", "linear").join(routed, "file_id", "left")
             .join(union(skipped, FACTS), "file_id", "left").join(intake.blank_rows, "file_id", "left")
             .join(lists, "file_id", "left").join(stamped, "file_id", "left").join(ragged, "file_id", "left"))
    inferred = F.col("layout").isin("linear", "grid", "labeled", "inferred")
    return materialize(table.select(
        "file_id", layout.alias("layout"),
        F.when(layout.isin("empty", "xlsx", "xls"), F.lit(0).cast("bigint")).otherwise(
            F.coalesce("skipped", F.lit(0).cast("bigint")) + F.coalesce("blank_rows", F.lit(0).cast("bigint")))
        .alias("skipped_non_lead_rows"),
        F.coalesce("ragged_rows", F.lit(0).cast("bigint")).alias("ragged_rows"),
        F.coalesce("dropped_headers", none).alias("dropped_headers"),
        F.coalesce("unmapped_headers", none).alias("unmapped_headers"),
        (F.col("_stamped").isNull() & ~layout.isin("empty", "xlsx", "xls")
         & F.lit(profile.synthesized_column is not None)).alias("timestamp_synthesized"),
    ).withColumn("header_inferred", inferred))
