"""Read folders of messy text files into ordered rows of cells.

Two passes over the text. The first profiles every file in one aggregation (kind by leading bytes,
encoding, delimiter, quoted line breaks, card labels); the second decodes and splits lines. Files are
never read whole: a single huge file is split by Spark like any other text, and cells that hold line breaks are
stitched by a distributed running state instead of a one-task multi-line reader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions.values import fold_read_nulls, strip
from leadspark.operators.ordering import running
from leadspark.operators.staging import materialize, small_side

# The characters Windows-1252 puts where ISO-8859-1 has controls 80..9F, and the bytes it lacks.
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = r"[\x81\x8d\x8f\x90\x9d]"
# Line breaks inside a text line (those besides CR and LF).
INNER_BREAKS = r"[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def with_places(text: DataFrame) -> DataFrame:
    """``(file_id, src, line)`` from a text scan carrying ``value``, ``file_path`` and ``file_block_start``.

    ``src`` increases within a file: a line starts at its own byte, so twice the block's byte offset plus the
    line's index in the block is unique and ordered.
    """
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return text.select(F.col("file_path").alias("file_id"), (F.col("file_block_start") * 2 + index).alias("src"),
                       F.col("value").alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line below ``path``, blank ones included."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return with_places(text.select("value", "_metadata.file_path", "_metadata.file_block_start"))


def _plain_path(path: Column) -> Column:
    """A file's path as the text scan names it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def files_of(lines: DataFrame) -> DataFrame:
    """Every file that ``lines`` scans, empty ones too (names only; taken from the scan's own listing)."""
    names = [(n,) for n in lines.inputFiles()]
    return lines.sparkSession.createDataFrame(names, "file_id string").select(_plain_path(F.col("file_id")).alias("file_id"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path``, empty ones too."""
    return files_of(read_lines(spark, path))


def logged_files(spark: SparkSession, checkpoint: str, batch_id: int) -> DataFrame:
    """Every file of one micro-batch, those without any line too, from the file log that the file source keeps in the checkpoint.

    A micro-batch covers the log entries between the offsets of the batch before and its own. Entries stay in a DataFrame; a compacted
    log repeats entries.
    """
    def until(batch: int) -> Column:
        if batch < 0:
            return F.lit(-1)
        lines = spark.read.text(f"{checkpoint}/offsets/{batch}").where("value like '{\"logOffset\"%'")
        return F.lit(int(lines.select(F.get_json_object("value", "$.logOffset")).first()[0]))

    entries = spark.read.text(f"{checkpoint}/sources/0").where("value like '{%'").select(
        F.from_json("value", "path string, batchId bigint").alias("e")).select("e.*")
    mine = entries.where((F.col("batchId") > until(batch_id - 1)) & (F.col("batchId") <= until(batch_id)))
    return mine.select(_plain_path(F.col("path")).alias("file_id")).distinct()


# ------------------------------------------------------------------------------------ quoting

def _fields(delimiter: str) -> str:
    """Pattern of zero or more complete fields."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    return rf'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^{d}]*+|[^"{d}][^{d}]*+)?(?:{d}|$))*+$'


def ends_open(line: Column, delimiter: str) -> Column:
    """A line begun outside quotes ends inside a quoted cell."""
    return line.contains('"') & ~line.rlike("(?s)^" + _fields(delimiter))


def closes(line: Column, delimiter: str) -> Column:
    """A line begun inside a quoted cell ends outside quotes."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    return line.contains('"') & line.rlike(
        rf'(?s)^[^"]*+(?:""[^"]*+)*+"[^{d}]*+(?:$|{d}{_fields(delimiter)})')


def per_delimiter(delimiter: Column, build) -> Column:
    """Evaluate ``build(candidate)`` for the file's own delimiter."""
    chain = F.when(delimiter == fv.DELIMITERS[0], build(fv.DELIMITERS[0]))
    for candidate in fv.DELIMITERS[1:]:
        chain = chain.when(delimiter == candidate, build(candidate))
    return chain


def split_cells(text: Column, delimiter: Column) -> Column:
    """ARRAY of cell texts of one record; quotes removed, doubled quotes restored."""
    def unquote(cell: Column) -> Column:
        quoted = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'
        body = F.replace(F.regexp_extract(cell, quoted, 1), F.lit('""'), F.lit('"'))
        return F.when(cell.rlike(quoted), F.concat(body, F.regexp_extract(cell, quoted, 2))).otherwise(cell)

    def build(candidate: str) -> Column:
        d = "\\" + candidate if candidate == "|" else candidate
        pattern = rf'{d}("[^"]*+(?:""[^"]*+)*+"[^{d}]*+|[^{d}]*+)'
        found = F.regexp_extract_all(F.concat(F.lit(candidate), text), F.lit(pattern), 1)
        return F.when(text.contains('"'), F.transform(found, unquote)).otherwise(F.split(text, d, -1))

    return per_delimiter(delimiter, build)


# ------------------------------------------------------------------------------------ profiling

def label_count(line: Column, pattern: str, unless: str | None = None) -> Column:
    def hit(part: Column) -> Column:
        found = strip(part).rlike(f"(?idU){pattern}")
        return found & ~strip(part).rlike(f"(?idU){unless}") if unless else found

    maybe = line.rlike(r"(?i)^\s*[nd]|" + INNER_BREAKS)
    return F.when(maybe, F.size(F.filter(F.split(line, INNER_BREAKS), hit))).otherwise(0)


def profile_files(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per file: kind, encoding, delimiter, first position, card label counts."""
    line, raw = F.col("line"), F.col("line").cast("binary")
    valid = F.is_valid_utf8(line)
    bare = F.when(line.contains('"'), F.regexp_replace(line, r'"[^"]*"', "")).otherwise(line)
    # Every line votes: how Spark splits a file must not decide its delimiter.
    counts = [(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias(f"c{i}")
              for i, d in enumerate(fv.DELIMITERS)]
    broken = reduce(lambda a, b: a | b, [ends_open(line, d) for d in fv.DELIMITERS])
    seen = lines.select(
        "file_id", "src", *counts, valid.alias("valid"), broken.alias("broken"),
        F.when(~valid, F.decode(raw, "ISO-8859-1").rlike(CP1252_UNDEFINED)).otherwise(F.lit(False)).alias("undefined"),
        F.hex(F.substring(raw, 1, 8)).alias("magic"), (strip(line) != "").alias("filled"),
        label_count(line, fv.LINE_NAME).alias("names"),
        label_count(line, fv.LINE_DOB, fv.LINE_NAME).alias("births"))
    # distinct delimiter counts are few, so this first grouping is small after the map-side combine
    folded = seen.groupBy("file_id", *[f"c{i}" for i in range(len(fv.DELIMITERS))]).agg(
        F.count("*").alias("n"), F.min("src").alias("first_src"), F.min_by("magic", "src").alias("magic"),
        F.bool_and("valid").alias("valid"), F.bool_or("broken").alias("broken"),
        F.bool_or("undefined").alias("undefined"), F.bool_or("filled").alias("filled"),
        F.sum("names").alias("names"), F.sum("births").alias("births"))
    folded = materialize(folded)
    whole = folded.groupBy("file_id").agg(
        F.min("first_src").alias("first_src"), F.min_by("magic", "first_src").alias("magic"),
        F.bool_and("valid").alias("valid"), F.bool_or("broken").alias("broken"),
        F.bool_or("undefined").alias("undefined"), F.bool_or("filled").alias("filled"),
        F.sum("names").alias("names"), F.sum("births").alias("births"))
    kind = (F.when(F.col("magic").startswith(fv.XLSX_MAGIC), "xlsx").when(F.col("magic") == fv.XLS_MAGIC, "xls")
            .when(F.col("filled"), "text").otherwise("empty"))
    encoding = F.when(F.coalesce("valid", F.lit(True)), "utf-8").when(F.col("undefined"), "iso-8859-1").otherwise("windows-1252")
    linear = (F.col("names") >= fv.CARD_MIN_LABELS) & (F.col("births") >= fv.CARD_MIN_LABELS)
    if files is not None:
        whole = files.join(whole, "file_id", "left")
    return whole.join(vote_delimiter(folded), "file_id", "left").select(
        "file_id", F.coalesce(kind, F.lit("empty")).alias("kind"), encoding.alias("encoding"),
        F.coalesce("delimiter", F.lit(fv.DELIMITERS[0])).alias("delimiter"), "first_src",
        F.coalesce("broken", F.lit(False)).alias("broken"), F.coalesce(linear, F.lit(False)).alias("linear"))


def vote_delimiter(folded: DataFrame) -> DataFrame:
    """Per file the delimiter whose usual count per line is shared by most lines (then: the larger count)."""
    options = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(-i).alias("rank"), F.col(f"c{i}").alias("k"))
                        for i, d in enumerate(fv.DELIMITERS)])
    votes = folded.select("file_id", "n", F.explode(options).alias("o")).where("o.k > 0").groupBy(
        "file_id", "o.delimiter", "o.rank", "o.k").agg(F.sum("n").alias("lines"))
    return votes.groupBy("file_id").agg(F.max_by("delimiter", F.struct("lines", "k", "rank")).alias("delimiter"))


# ------------------------------------------------------------------------------------ decoding and records

def decode_lines(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """Text of every line of the text files: encoding applied, byte order mark removed."""
    single_byte = F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    text = (F.when(F.col("encoding") == "utf-8", F.col("line")).when(F.col("encoding") == "iso-8859-1", single_byte)
            .otherwise(F.translate(single_byte, CP1252_BYTES, CP1252_CHARS)))
    marked = F.when(F.col("src") == F.col("first_src"), F.regexp_replace(text, r"^\ufeff", "")).otherwise(text)
    wanted = profile.where("kind = 'text'").select("file_id", "encoding", "delimiter", "first_src", "broken", "linear")
    return lines.join(wanted, "file_id").select("file_id", "src", marked.alias("text"), "delimiter", "broken", "linear")


def stitch_records(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join the lines of cells that contain line breaks. Returns (records, files left with an open quote).

    A line maps the quoting state before it to the state after it: keep, set open, set closed, or flip.
    The state after any line is that of the last setting line, flipped once per flip since, and both are
    running aggregates.
    """
    opened = per_delimiter(F.col("delimiter"), lambda d: ends_open(F.col("text"), d))
    closed = per_delimiter(F.col("delimiter"), lambda d: closes(F.col("text"), d))
    lines = texts.withColumns({"_o": opened, "_c": closed})
    lines = lines.withColumns({"_flip": F.col("_o") & F.col("_c"), "_set": F.col("_o") != F.col("_c")})
    lines = running(lines, ["file_id"], "src", {"_flips": ("sum", F.col("_flip").cast("bigint"))})
    last_set = F.when(F.col("_set"), F.col("src") * 4 + F.when(F.col("_o"), 2).otherwise(0) + F.col("_flips") % 2)
    lines = running(lines, ["file_id"], "src", {"_last": ("max", F.coalesce(last_set, F.lit(0).cast("bigint")))})
    set_open, flips_then = F.floor(F.col("_last") / 2) % 2, F.col("_last") % 2
    after = (set_open + flips_then + F.col("_flips")) % 2
    # a record ends with each line that leaves the state closed
    lines = materialize(lines.withColumn("_after", after))
    ends = running(lines, ["file_id"], "src", {"_ends": ("sum", (F.col("_after") == 0).cast("bigint"))})
    record = F.col("_ends") - (F.col("_after") == 0).cast("bigint")
    left_open = lines.groupBy("file_id").agg(F.max_by("_after", "src").alias("_after")).where("_after = 1").select("file_id")
    whole = ends.withColumn("_record", record).join(left_open, "file_id", "left_anti")
    parts = F.sort_array(F.collect_list(F.struct("src", "text")))
    records = whole.groupBy("file_id", "_record", "delimiter").agg(F.min("src").alias("src"), parts.alias("_parts"))
    return records.select("file_id", "src", F.array_join(F.transform("_parts", lambda p: p["text"]), "\n").alias("text"),
                          "delimiter"), left_open


def cell_rows(records: DataFrame) -> DataFrame:
    """``(file_id, src, cells)`` with null tokens folded."""
    cells = split_cells(F.col("text"), F.col("delimiter"))
    return records.select("file_id", "src", F.transform(cells, fold_read_nulls).alias("cells"))


def has_cells(cells: str = "cells") -> Column:
    return F.exists(cells, lambda c: c.isNotNull())


class Intake:
    """Files given by their lines: their profile, decoded lines of card files, and cell rows of the others."""

    def __init__(self, lines: DataFrame, files: DataFrame | None = None) -> None:
        # Written once: profile and records read it, and opening many small files costs more than their lines.
        lines = materialize(lines)
        self.profile = small_side(profile_files(lines, files))
        texts = decode_lines(lines, self.profile)
        self.linear_lines = texts.where("linear").select("file_id", "src", "text")
        tables = texts.where("NOT linear")
        self.left_open = self.profile.select("file_id").limit(0)
        records = tables.where("NOT broken").select("file_id", "src", "text", "delimiter")
        if self.profile.where("broken AND kind = 'text' AND NOT linear").limit(1).count():
            stitched, self.left_open = stitch_records(tables.where("broken").drop("linear"))
            records = records.unionByName(stitched)
        self.rows = materialize(cell_rows(records))

    @property
    def rejects(self) -> DataFrame:
        """Files that yield no rows because of what they are: workbooks, or text with an unclosed quote."""
        return self.profile.where("kind IN ('xlsx', 'xls')").select("file_id", "kind").unionByName(
            self.left_open.select("file_id", F.lit("unclosed quote").alias("kind")))

    @property
    def blank_rows(self) -> DataFrame:
        return self.rows.groupBy("file_id").agg(F.count_if(~has_cells()).alias("blank_rows"))

    @property
    def filled_rows(self) -> DataFrame:
        return self.rows.where(has_cells())


def ragged_rows(rows: DataFrame) -> DataFrame:
    """Rows per file that hold more cells than its first row (kept, not fatal)."""
    first = rows.groupBy("file_id").agg(F.min_by(F.size("cells"), "src").alias("_width"))
    return rows.join(first, "file_id").groupBy("file_id").agg(
        F.count_if(F.size("cells") > F.col("_width")).alias("ragged_rows"))
