"""Write results: target CSV, change report, status table, and the quality log."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.operators.rows import col
from leadspark.operators.staging import materialize
from leadspark.plans.refine import Refined

CHANGE_COLUMNS = ["row", "field", "original", "new", "reason"]


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows ordered within each file; a large file spreads over consecutive part files."""
    return df.repartitionByRange("file_id", *order).sortWithinPartitions("file_id", *order)


def folder_per_file(df: DataFrame, by: str = "file_id") -> DataFrameWriter:
    """A writer of one folder per value of ``by``. Tasks put their files in place as they end; the default commit leaves all
    folders to the driver, one after the other. A task that runs again writes the same names."""
    return df.write.partitionBy(by).option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def write_csv(df: DataFrame, path: str) -> None:
    (folder_per_file(df).mode("overwrite").option("header", "true").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


def organized_csv(refined: Refined, path: str) -> None:
    """The target columns only, in file order."""
    write_csv(in_order(refined.organized.organized, "row").drop("row"), path)


def changes_csv(refined: Refined, path: str) -> None:
    write_csv(in_order(refined.organized.row_changes, "row", "seq").select("file_id", *CHANGE_COLUMNS), path)


def status_table(refined: Refined) -> DataFrame:
    """The target columns with Score and Status beside them."""
    marks = refined.scores.select("file_id", "row", F.col("score").alias("Score"), F.col("status").alias("Status"))
    return refined.organized.organized.join(marks, ["file_id", "row"])


def sections(refined: Refined) -> dict[str, DataFrame]:
    """The lists of the quality log, one table each."""
    organized = refined.organized
    return {
        "scores": refined.scores.withColumn("name", F.coalesce("name", F.lit(fv.NA_TEXT))).drop("status"),
        "violations": refined.violations.drop("penalty"),
        "email_corrections": refined.email_corrections,
        "duplicate_groups": refined.members,
        "removed_duplicates": organized.removed_duplicates,
        "invalid_phone_rows": organized.invalid_phones.select("file_id", (F.col("row") - 1).alias("index")),
    }


def error_log(refined: Refined) -> DataFrame:
    """The quality log of every file as ordered lines ``(file_id, section, position, item)``, whatever its size.

    ``item`` is JSON. The section ``totals`` has one item per file with its counts and header lists; the others have one
    item per entry, ordered by ``position`` and, within one row, ``part``: scores, review_rows, violations, email_corrections,
    duplicate_groups (one item per member), removed_duplicates and invalid_phone_rows. No list is gathered into one row.
    """
    parts = sections(refined)
    parts["review_rows"] = parts["scores"].where("review").select("file_id", "row")
    order = {"scores": "row", "review_rows": "row", "violations": "row", "email_corrections": "row", "duplicate_groups": "group",
             "removed_duplicates": "src", "invalid_phone_rows": "index"}
    within = {"violations": "seq", "duplicate_groups": "row"}

    def lines(name: str, df: DataFrame) -> DataFrame:
        at = F.col(order[name]).cast("bigint") if name in order else F.lit(0).cast("bigint")
        part = F.col(within[name]).cast("bigint") if name in within else F.lit(0).cast("bigint")
        kept = [col(c) for c in df.columns if c not in ("file_id", "seq", "src")]
        return df.select("file_id", F.lit(name).alias("section"), at.alias("position"), part.alias("part"),
                         F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("item"))

    log = lines("totals", refined.totals.drop("review_rows", "duplicate_groups", "invalid_phones"))
    for name, df in parts.items():
        log = log.unionByName(lines(name, df))
    return log


def write_quality_log(refined: Refined, path: str) -> None:
    """Section tables, per-file totals, and all of it once more as ordered JSON lines per file."""
    for name, table in sections(refined).items():
        table.write.mode("overwrite").json(f"{path}/{name}")
    refined.totals.write.mode("overwrite").json(f"{path}/totals")
    # Written first: finding the ranges would work the whole log out once more.
    log = in_order(materialize(error_log(refined)), "section", "position", "part")
    folder_per_file(log).mode("overwrite").json(f"{path}/log")
