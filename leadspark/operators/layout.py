"""Layout detection and reshaping of sheets into lead rows.

Row input is ``(file_id, src, cells)`` without blank rows; line input is ``(file_id, src, text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions.values import strip
from leadspark.operators.mapping import exact_target, header_key, is_drop_name
from leadspark.operators.ordering import running
from leadspark.profile import Profile

COLUMN_BITS = 20  # a lead's place is (block, column) packed into one BIGINT


def _cells_like(test) -> Column:
    return F.size(F.filter("cells", lambda c: F.coalesce(test(c), F.lit(False))))


def is_name_cell(cell: Column) -> Column:
    return cell.rlike(f"(?idU){fv.CARD_NAME}")


def is_birth_cell(cell: Column) -> Column:
    return ~is_name_cell(cell) & cell.rlike(f"(?idU){fv.GRID_DOB}")


def layout_counts(rows: DataFrame) -> DataFrame:
    """Per file the counts that decide its layout. One map-side combined aggregation, no unpivot."""
    word = lambda text: lambda c: F.lower(strip(c)) == text
    return rows.groupBy("file_id").agg(
        F.sum(_cells_like(is_name_cell)).alias("name_cells"), F.sum(_cells_like(is_birth_cell)).alias("birth_cells"),
        F.sum(_cells_like(word(fv.LABELED_BANNER))).alias("contact_cells"),
        F.sum(_cells_like(word("first name"))).alias("first_name_cells"))


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """First rows of each file with their 0-based index (the limit is applied before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("src"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).withColumn(
        "index", F.col("_rank") - 1).drop("_rank")


def locate_header(rows: DataFrame, profile: Profile) -> DataFrame:
    """``(file_id, header_src, header_index)``: the row among the first ten that names the most known headers."""
    def is_header(cell: Column) -> Column:
        key = header_key(cell)
        return exact_target(key, profile).isNotNull() | is_drop_name(key, profile)

    scored = first_rows(rows, fv.HEADER_SEARCH_ROWS).withColumn("hits", _cells_like(is_header))
    best = scored.groupBy("file_id").agg(F.max_by(F.struct("src", "index", "hits"),
                                                  F.struct("hits", -F.col("src"))).alias("b"))
    return best.where(F.col("b.hits") >= fv.HEADER_MIN_HITS).select(
        "file_id", F.col("b.src").alias("header_src"), F.col("b.index").cast("bigint").alias("header_index"))


def route(counts: DataFrame, headers: DataFrame) -> DataFrame:
    """``(file_id, layout, header_src, header_index)``: grid, labeled, header or inferred."""
    grid = (F.col("name_cells") >= fv.CARD_MIN_LABELS) & (F.col("birth_cells") >= fv.CARD_MIN_LABELS)
    labeled = (F.col("contact_cells") >= 1) & (F.col("first_name_cells") >= fv.CARD_MIN_LABELS)
    layout = F.when(grid, "grid").when(labeled, "labeled").when(F.col("header_src").isNotNull(), "header") \
        .otherwise("inferred")
    return counts.join(headers, "file_id", "left").select("file_id", layout.alias("layout"), "header_src", "header_index")


def of_layout(rows: DataFrame, routed: DataFrame, layout: str) -> DataFrame:
    return rows.join(routed.where(F.col("layout") == layout).select("file_id"), "file_id", "left_semi")


def long_cells(rows: DataFrame) -> DataFrame:
    """``(file_id, src, col, text)`` of every non-empty trimmed cell."""
    keep = [c for c in rows.columns if c != "cells"]
    return rows.select(*keep, F.posexplode("cells").alias("col", "_v")).where("_v IS NOT NULL").select(
        *keep, "col", strip(F.col("_v")).alias("text")).where("text != ''")


def is_banner_row() -> Column:
    return _cells_like(lambda c: F.lower(c).contains(fv.CARD_BANNER)) >= 3


def banner_blocks(rows: DataFrame) -> DataFrame:
    """Add ``banner`` and the running block number of each row."""
    flagged = rows.withColumn("banner", is_banner_row())
    return running(flagged, ["file_id"], "src", {"block": ("sum", F.col("banner").cast("bigint"))})


def grid_cells(rows: DataFrame) -> DataFrame:
    """Cells of grid sheets as card cells: one lead per block and column."""
    body = long_cells(banner_blocks(rows).where("NOT banner"))
    return body.select("file_id", (F.shiftleft("block", COLUMN_BITS) + F.col("col")).alias("lead"),
                       F.col("src").alias("ord"), "text")


def linear_cells(lines: DataFrame, breaks: str) -> DataFrame:
    """Lines of linear card files as card cells: blocks end at banner and rule lines."""
    def is_rule(part: Column) -> Column:
        return part.rlike(f"(?idU){fv.LINE_BANNER}") | part.rlike(fv.LINE_RULE)

    parts = lines.withColumn("_parts", F.transform(F.split("text", breaks), strip)).withColumn(
        "_rules", F.transform("_parts", is_rule))
    here = F.size(F.filter("_rules", lambda r: r))
    parts = running(parts.withColumn("_here", here), ["file_id"], "src", {"_until": ("sum", here.cast("bigint"))})
    exploded = parts.select("file_id", "src", "_until", "_here", "_rules", F.posexplode("_parts").alias("pos", "text"))
    passed = F.size(F.filter(F.slice("_rules", F.lit(1), F.col("pos") + 1), lambda r: r))
    kept = exploded.where((F.col("text") != "") & ~F.get("_rules", F.col("pos")))
    return kept.select("file_id", (F.col("_until") - F.col("_here") + passed).alias("lead"),
                       F.struct("src", "pos").alias("ord"), "text")


def count_blocks(cells: DataFrame) -> DataFrame:
    return cells.select("file_id", "lead").distinct().groupBy("file_id").agg(F.count("*").alias("blocks"))
