"""Queries over sheets: every layout, rendered from the messy leads and read back.

The sheets are derived from all leads, a hundred leads per file, so their number grows with the data. Reading
them back is checked against what was put in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.catalog.base import (AS_OF, LEADS_CTE, PROFILE, SHORT, STD_CTE, TARGETS, query, raw_leads, short,
                                    sql_digits, sql_list, sql_text)
from leadspark.functions.values import fold_read_nulls
from leadspark.operators import infer, mapping
from leadspark.operators.cards import auto_count, extract_leads
from leadspark.operators.labeled import labeled_leads as read_labeled
from leadspark.operators.layout import (banner_blocks as mark_blocks, grid_cells, layout_counts as count_layouts,
                                        linear_cells, locate_header, route)
from leadspark.operators.rows import col
from leadspark.operators.staging import materialize, spread, staging_folder
from leadspark.plans.files import header_plan, header_table, organize_files, project_rows
from leadspark.plans.organize import Organized, as_stamp
from leadspark.sources.intake import (INNER_BREAKS, cell_rows, files_of, has_cells, label_count, profile_files,
                                      read_lines)
from leadspark.sources.sinks import folder_per_file

# ------------------------------------------------------------------------------------ headed and header-less sheets

HEADER = ["Created", "NAME", "DOB", "Street", "City", "Phone", "Zip", "Own/Rent", "Vehicles", "Carrier", "car info", "E-mail"]
FIELDS = ["raw_timestamp", "raw_name", "raw_dob", "raw_street", "raw_city", "raw_phone", "raw_zip", "raw_homeowner",
          "raw_autos", "raw_carrier", "raw_vehicles", "raw_email"]
_FILE = "(src - src % 100)"
_SHEET_LINES = f"""
  SELECT CAST({_FILE} AS VARCHAR(20)) AS file_id, CAST({_FILE} * 1000 + 10 + src % 100 AS BIGINT) AS src,
    {{list}}({', '.join(FIELDS)}) AS cells FROM {{leads}}
  UNION ALL SELECT CAST({_FILE} AS VARCHAR(20)), CAST({_FILE} * 1000 + src % 100 AS BIGINT),
    CASE WHEN src % 100 = ({_FILE} / 100) % 3 THEN {{list}}({sql_list(HEADER)})
      WHEN src % 100 = 0 THEN {{list}}('Paused', NULL, 'NA') ELSE {{list}}('Table', 'name') END
  FROM {{leads}} WHERE src % 100 <= ({_FILE} / 100) % 3
  UNION ALL SELECT CAST({_FILE} AS VARCHAR(20)), CAST({_FILE} * 1000 + 500 AS BIGINT), {{list}}(NULL, '', 'NA')
  FROM {{leads}} WHERE src % 100 = 0"""
_FOLDED = f"list_transform(cells, lambda c: CASE WHEN c NOT IN ({sql_list(fv.READ_NULL_TOKENS)}) THEN c END)"
SHEETS_CTE = f"""{STD_CTE},
sheet_all AS (SELECT file_id, src, {_FOLDED} AS cells FROM ({_SHEET_LINES.format(list="list_value", leads="raw_leads")})),
sheet AS (SELECT * FROM sheet_all WHERE len(list_filter(cells, lambda c: c IS NOT NULL)) > 0),
headerless AS (SELECT file_id, src, cells FROM sheet WHERE src % 100000 >= 10)"""


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of headed sheets: junk rows, a header, a hundred leads, a blank row."""
    rows = spark.sql(_SHEET_LINES.format(list="array", leads="{leads}"), leads=raw_leads(spark, sf_dir))
    return rows.withColumn("cells", F.transform("cells", fold_read_nulls))


def filled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_rows(spark, sf_dir).where(has_cells())


def headerless_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_rows(spark, sf_dir).where(F.col("src") % 100000 >= 10)


@query("blank_rows", f"{SHEETS_CTE} SELECT file_id, count(*) - count(s.src) AS blank_rows FROM sheet_all LEFT JOIN sheet s USING (file_id, src) GROUP BY file_id")
def blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_rows(spark, sf_dir).groupBy("file_id").agg(F.count_if(~has_cells()).alias("blank_rows"))


_KNOWN = sorted({*PROFILE.aliases, *PROFILE.drop_names})


@query("header_locate", f"""{SHEETS_CTE} SELECT file_id, src AS header_src, i AS header_index FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY hits DESC, src) AS best FROM (
    SELECT file_id, src, row_number() OVER (PARTITION BY file_id ORDER BY src) - 1 AS i,
      len(list_filter(cells, lambda c: trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) IN ({sql_list(_KNOWN)}))) AS hits
    FROM sheet) WHERE i < 10) WHERE best = 1 AND hits >= 2""")
def header_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate_header(filled_rows(spark, sf_dir), PROFILE)


@query("layout_counts", f"""{SHEETS_CTE} SELECT file_id,
  CAST(sum(len(list_filter(cells, lambda c: regexp_matches(c, '(?i)^\\s*name\\b')))) AS BIGINT) AS name_cells,
  CAST(sum(len(list_filter(cells, lambda c: regexp_matches(c, '(?i)^\\s*d\\.?\\s*o\\.?\\s*b\\.?\\b')))) AS BIGINT) AS birth_cells,
  CAST(sum(len(list_filter(cells, lambda c: lower(trim(c)) = 'contact details'))) AS BIGINT) AS contact_cells,
  CAST(sum(len(list_filter(cells, lambda c: lower(trim(c)) = 'first name'))) AS BIGINT) AS first_name_cells FROM sheet GROUP BY file_id""")
def layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_layouts(filled_rows(spark, sf_dir))


@query("layout_route", f"{SHEETS_CTE} SELECT DISTINCT file_id, 'header' AS layout FROM sheet")
def layout_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled_rows(spark, sf_dir)
    return route(count_layouts(rows), locate_header(rows, PROFILE)).select("file_id", "layout")


_SHEET_STD = f"""SELECT CAST({_FILE} AS VARCHAR(20)) AS file_id, CAST({_FILE} * 1000 + 10 + src % 100 AS BIGINT) AS src,
  {', '.join(TARGETS)}, email FROM std"""


@query("headed_sheets", f"{SHEETS_CTE} {_SHEET_STD}")
def headed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headed sheets standardized: header found, mapped, projected."""
    rows = materialize(filled_rows(spark, sf_dir))
    routed = route(count_layouts(rows), locate_header(rows, PROFILE))
    plan = header_plan(mapping.classify_headers(header_table(rows, routed), PROFILE), PROFILE)
    body = rows.join(routed.select("file_id", "header_src"), "file_id").where("src > header_src")
    raw = project_rows(body.select("file_id", "src", "cells"), plan, PROFILE, as_stamp(AS_OF))
    return short(Organized(materialize(raw), PROFILE, AS_OF).standardized, "file_id", "src", *PROFILE.columns, "Email")


@query("lead_row_filter", f"""{SHEETS_CTE} SELECT file_id, src FROM sheet WHERE len(list_filter(cells, lambda c: c IS NOT NULL)) >= 3""")
def lead_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.lead_rows(filled_rows(spark, sf_dir)).select("file_id", "src")


_SAMPLES = f"""samples AS (SELECT * FROM (SELECT file_id, col, v, row_number() OVER (PARTITION BY file_id, col ORDER BY src) AS rank FROM (
  SELECT file_id, src, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS col, trim(unnest(cells)) AS v FROM headerless
  WHERE len(list_filter(cells, lambda c: c IS NOT NULL)) >= 3)
  WHERE v <> '' AND lower(v) NOT IN ({sql_list(fv.MISSING_WORDS)})) WHERE rank <= {fv.PROFILE_SAMPLES})"""
_PREDICATES = {
    "phone": f"length({sql_digits('v')}) = 10 OR regexp_matches({sql_digits('v')}, '^1[0-9]{{10}}$')",
    "email": "regexp_matches(v, '@[^@]*[.][^@]*$')",
    "zip": r"regexp_matches(v, '^\d{5}(-\d{4})?$')",
    "date": r"regexp_matches(v, '[/-]') AND try_strptime(v, ['%m/%d/%Y', '%Y-%m-%d', '%m-%d-%Y', '%Y-%m-%d %H:%M']) IS NOT NULL",
    "digit": r"regexp_matches(v, '^\d$')",
    "home": f"lower(v) IN ({sql_list(fv.EXPLICIT_HOME_WORDS)})",
    "vehicle": r"regexp_matches(v, '^(19|20)\d{2}\s+\S')",
    "alpha": r"length(v) <= 40 AND regexp_matches(v, '^[A-Za-z][A-Za-z .,''\-]*$')",
    "street": r"regexp_matches(v, '^\d+\s+\S+')",
    "state": "regexp_matches(v, '^[A-Za-z]{2}$')",
}


@query("column_profile", f"""{SHEETS_CTE}, {_SAMPLES} SELECT file_id, col,
  {', '.join(f'count(*) FILTER ({p}) / count(*) AS {n}' for n, p in _PREDICATES.items())} FROM samples GROUP BY file_id, col""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = infer.column_samples(infer.lead_rows(headerless_rows(spark, sf_dir)))
    found = infer.profile_columns(samples, F.lit(AS_OF).cast("date"))
    return found.select("file_id", "col", *_PREDICATES)


@query("date_median", f"""{SHEETS_CTE}, {_SAMPLES}, years AS (SELECT file_id, col, CAST(year(
    try_strptime(v, ['%m/%d/%Y', '%Y-%m-%d', '%m-%d-%Y', '%Y-%m-%d %H:%M'])) AS INTEGER) AS y FROM samples WHERE rank <= {fv.YEAR_SAMPLES}),
  dated AS (SELECT file_id, col FROM samples GROUP BY file_id, col HAVING count(*) FILTER ({_PREDICATES["date"]}) / count(*) >= 0.7)
  SELECT file_id, col, list_sort(list(y))[len(list(y)) // 2 + 1] AS median_year FROM years JOIN dated USING (file_id, col)
  WHERE y IS NOT NULL GROUP BY file_id, col""")
def date_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = infer.column_samples(infer.lead_rows(headerless_rows(spark, sf_dir)))
    return infer.profile_columns(samples, F.lit(AS_OF).cast("date")).where("date >= 0.7").select("file_id", "col", "median_year")


@query("headerless_leads", f"""{SHEETS_CTE} SELECT file_id, s.src, name, dob, {sql_text('raw_street')} AS address, phone, carrier, vehicles, email
  FROM ({_SHEET_STD}) s JOIN raw_leads r ON r.src = CAST(file_id AS BIGINT) + s.src % 1000 - 10""")
def headerless_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheets without their headers: columns recognized by content. Cities with digits are no city column."""
    rows = materialize(infer.lead_rows(headerless_rows(spark, sf_dir)))
    plan = materialize(infer.claim_roles(infer.profile_columns(infer.column_samples(rows), F.lit(AS_OF).cast("date"))))
    raw = project_rows(rows, plan, PROFILE, as_stamp(AS_OF))
    done = Organized(materialize(raw), PROFILE, AS_OF).standardized
    return short(done, "file_id", "src", "Full Name", "Date of Birth", "Address", "Phone Number", "Current Insurance",
                 "Cars Make and Model", "Email")


@query("csv_records", f"""{LEADS_CTE} SELECT CAST(src AS BIGINT) AS src, CASE WHEN raw_name NOT IN ({sql_list(fv.READ_NULL_TOKENS)}) THEN raw_name END AS a,
  'say "' || coalesce(raw_city, '') || '"; ' || coalesce(raw_street, '') AS b, note AS c FROM raw_leads""")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted delimited lines written from all leads and split again, three delimiters."""
    leads = raw_leads(spark, sf_dir).fillna("", ["raw_street", "raw_city", "raw_name"])
    delimiter = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("|")), (F.col("src") % 3 + 1).cast("int"))
    middle = F.concat(F.lit('"say ""'), "raw_city", F.lit('""; '), "raw_street", F.lit('"'))
    lines = leads.select(F.lit("f").alias("file_id"), "src", delimiter.alias("delimiter"), middle.alias("m"), "raw_name", "note")
    lines = lines.withColumn("text", F.concat_ws("", "raw_name", "delimiter", "m", "delimiter", F.lit('"'), "note", F.lit('"')))
    cells = cell_rows(lines)
    return cells.select("src", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query("recombine", f"""{LEADS_CTE} SELECT src, array_to_string(list_filter([trim(raw_street), trim(raw_city), trim(raw_homeowner)],
  lambda p: lower(p) NOT IN ({sql_list(fv.MISSING_WORDS)})), ', ') AS joined FROM raw_leads""")
def recombine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split columns joined again, missing bits skipped."""
    cells = raw_leads(spark, sf_dir).select("src", F.array("raw_street", "raw_city", "raw_homeowner").alias("cells"))
    return cells.select("src", infer.join_parts(F.col("cells"), F.array(*[F.lit(i) for i in range(3)]), F.lit(", ")).alias("joined"))


# ------------------------------------------------------------------------------------ files

_DELIMITED = ["raw_timestamp", "raw_name", "raw_dob", "raw_street", "raw_city", "raw_phone", "raw_zip", "raw_homeowner",
              "raw_autos", "raw_carrier", "quoted_vehicles", "raw_email"]


def folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(f, at, value)``: all leads as lines of delimited files of a hundred (three delimiters, quoted cells with line breaks, junk
    above the header)."""
    place = F.col("src") - F.col("src") % 100
    leads = raw_leads(spark, sf_dir).withColumn("f", place).withColumn(
        "quoted_vehicles", F.concat(F.lit('"'), F.replace("raw_vehicles", F.lit(" / "), F.lit("\n/ ")), F.lit('"')))
    delimiter = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("|")), (F.col("f") / 100 % 3 + 1).cast("int"))

    def joined(cells: list) -> Column:
        texts = [F.coalesce(c, F.lit("")) for c in cells]
        return F.concat(texts[0], *[part for t in texts[1:] for part in (delimiter, t)])

    body = leads.select("f", (F.col("src") * 2 + 1).alias("at"), joined([F.col(c) for c in _DELIMITED]).alias("value"))
    head = leads.where("src % 100 = 0").select(
        "f", (F.col("src") * 2).alias("at"), F.concat(F.lit("LEADS EXPORT\n\n"), joined([F.lit(h) for h in HEADER])).alias("value"))
    return body.unionByName(head)


def write_lines(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Write lines ``(f, at, value)`` as one text file per ``f`` below the staging folder; returns their folder."""
    folder = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder_per_file(spread(lines, "f").sortWithinPartitions("f", "at").select("f", "value"), "f").text(folder)
    return folder


def write_folder(spark: SparkSession, sf_dir: str) -> str:
    """Write the files of ``folder_lines``; returns their folder."""
    return write_lines(spark, folder_lines(spark, sf_dir), "folder-leads")


def write_encoded_folder(spark: SparkSession, sf_dir: str) -> str:
    """The same files with a line in their own encoding at the end (UTF-8, Windows-1252, and Latin-1 with a byte that Windows-1252
    lacks, by turns), and a file without any byte."""
    turn = (F.col("f") / 100 % 3).cast("int")
    endings = [bytearray("é€,x".encode()), bytearray("é€,x".encode("cp1252")), bytearray("é\x81,x".encode("latin-1"))]
    last = F.get(F.array(*[F.lit(e) for e in endings]), turn)
    files = raw_leads(spark, sf_dir).where("src % 100 = 0").select((F.col("src") - F.col("src") % 100).alias("f"))
    ends = files.select("f", ((F.col("f") + 100) * 2).alias("at"), last.cast("string").alias("value"))
    encoded = write_lines(spark, folder_lines(spark, sf_dir).unionByName(ends), "encoded-leads")
    # A table without rows is one file without bytes.
    files.limit(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{encoded}/f=-1")
    return encoded


def file_number() -> Column:
    return F.regexp_extract("file_id", "f=(-?[0-9]+)/", 1).cast("bigint").alias("f")


@query("file_profiles", f"""{LEADS_CTE} SELECT CAST(src - src % 100 AS BIGINT) AS f, 'text' AS kind,
  ['utf-8', 'windows-1252', 'iso-8859-1'][CAST((src - src % 100) / 100 % 3 + 1 AS INT)] AS encoding,
  [',', ';', '|'][CAST((src - src % 100) / 100 % 3 + 1 AS INT)] AS delimiter, FALSE AS linear FROM raw_leads WHERE src % 100 = 0
  UNION ALL SELECT -1, 'empty', 'utf-8', ',', FALSE""")
def file_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, encoding and delimiter of delimited files written from all leads in three encodings, and of an empty file."""
    lines = read_lines(spark, write_encoded_folder(spark, sf_dir))
    found = profile_files(lines, files_of(lines)).where("file_id LIKE '%/f=%'")
    return found.select(file_number(), "kind", "encoding", "delimiter", "linear")


@query("folder_leads", f"""{STD_CTE}, refiled AS (SELECT * EXCLUDE (file_id), CAST(src - src % 100 AS BIGINT) AS f FROM std
    WHERE coalesce({", ".join(TARGETS)}) IS NOT NULL),
  kept AS (SELECT * FROM (SELECT *, coalesce(phone IS NOT NULL AND name IS NOT NULL AND src > min(src) OVER (
    PARTITION BY f, lower(phone), lower(name)), FALSE) AS dup FROM refiled) WHERE NOT dup)
  SELECT f, row_number() OVER (PARTITION BY f ORDER BY src) AS row, {", ".join(TARGETS)}, email FROM kept""")
def folder_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written files read back by the folder intake: detected, mapped, standardized, de-duplicated, numbered."""
    done, _ = organize_files(spark, write_folder(spark, sf_dir), PROFILE, AS_OF)
    return done.leads.select(file_number(), "row", *[col(c).alias(SHORT[c]) for c in [*PROFILE.columns, "Email"]])


# ------------------------------------------------------------------------------------ cards

_CARD = ["'Name: ' || raw_name", "'D.O.B : ' || raw_dob", "'Number: ' || raw_phone", "'Email: ' || raw_email",
         "'Address: ' || raw_street", "'City: ' || raw_city", "'0 Accidents'", "'Home Owner: ' || raw_homeowner",
         "'CAR: ' || CAST(src % 4 AS VARCHAR(2))", "raw_vehicles", "'Insurance: ' || raw_carrier", "'Lead Source: web'"]


def lines_of(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """``(src, i, text)``: one line per lead and text expression."""
    leads = raw_leads(spark, sf_dir)
    return leads.select("src", F.posexplode(F.array(*[F.expr(t) for t in texts])).alias("i", "text"))


def _nonempty(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {x} END"


def _mention(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{c}'" for p, c in fv.CARRIER_MENTIONS) + " END"


def _mention_or_text(x: str) -> str:
    return f"coalesce({_mention(x)}, {_nonempty(f"trim(replace({x}, '/', ' '))")})"


_VEHICLE = "trim(regexp_replace(raw_vehicles, '\\s+', ' ', 'g'))"
_CARD_EXPECTED = f"""{_nonempty("trim(raw_name, ' :=,')")} AS name, {_nonempty("replace(raw_dob, ' ', '')")} AS dob, {_nonempty(sql_digits('raw_phone'))} AS phone,
  CASE WHEN contains(raw_email, '@') THEN trim(raw_email) END AS email,
  array_to_string(list_filter([trim(raw_street, ' ,'), CASE WHEN contains(lower(raw_street), lower(trim(raw_city))) THEN '' ELSE trim(raw_city, ' :=,') END], lambda p: p <> ''), ', ') AS address,
  CASE WHEN regexp_matches(lower(trim(raw_homeowner)), '^no\\b') THEN 'Rented' ELSE 'Owner' END AS home, CAST(src % 4 AS VARCHAR) AS autos,
  {_mention_or_text('raw_carrier')} AS carrier, coalesce({_VEHICLE}, '') AS vehicles"""
_CARD_OUT = ["Full Name", "Date of Birth", "Phone Number", "Email", "Address", "Homeowner", "Autos", "Current Insurance", "Cars Make and Model"]


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, i, text)``: the label card of every lead, a field per line."""
    return lines_of(spark, sf_dir, _CARD).where("text IS NOT NULL")


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid sheets of three columns: banner rows between blocks of three cards."""
    n = F.col("src")
    place = {"file_id": (F.floor(n / 99) * 99).cast("string"), "block": F.floor(n % 99 / 3), "col": (n % 3).cast("int")}
    cells = card_lines(spark, sf_dir).withColumns(place)
    # Dealt out before they are grouped: the greatest of texts is found by sorting, and a task's leads hold many lines.
    placed = cells.withColumn("src", (F.col("block") * 20 + F.col("i") + 1).cast("bigint")).repartition("file_id", "src")
    rows = placed.groupBy("file_id", "src").agg(
        *[F.max(F.when(F.col("col") == c, F.col("text"))).alias(f"c{c}") for c in range(3)])
    body = rows.select("file_id", "src", F.array("c0", "c1", "c2").alias("cells"))
    starts = cells.where("block > 0").select("file_id", (F.col("block") * 20).cast("bigint").alias("src")).distinct()
    banner = F.array(*[F.lit("Live Call Transfer :")] * 3)
    return materialize(body.unionByName(starts.select("file_id", "src", banner.alias("cells"))))


@query("banner_blocks", f"""{LEADS_CTE}, placed AS (SELECT CAST((src - src % 99) AS VARCHAR) AS file_id, (src % 99 - src % 3) // 3 AS block FROM raw_leads)
  SELECT file_id, count(DISTINCT block) - 1 AS banners, CAST(max(dense) AS BIGINT) AS last_block FROM (
    SELECT file_id, block, dense_rank() OVER (PARTITION BY file_id ORDER BY block) - 1 AS dense FROM placed) GROUP BY file_id""")
def banner_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_blocks(grid_rows(spark, sf_dir)).groupBy("file_id").agg(
        F.count_if("banner").alias("banners"), F.max("block").alias("last_block"))


@query("grid_leads", f"""{LEADS_CTE} SELECT * EXCLUDE (src) FROM (SELECT src, {_CARD_EXPECTED} FROM raw_leads) WHERE name IS NOT NULL""")
def grid_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(extract_leads(grid_cells(grid_rows(spark, sf_dir))), *_CARD_OUT)


def linear_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear card files: a hundred cards per file, rules between them."""
    n = F.col("src")
    lines = card_lines(spark, sf_dir).select((F.floor(n / 100) * 100).cast("string").alias("file_id"),
                                             (n * 20 + F.col("i") + 1).alias("src"), "text")
    rules = raw_leads(spark, sf_dir).select((F.floor(n / 100) * 100).cast("string").alias("file_id"), (n * 20).alias("src"),
                                            F.when(n % 2 == 0, "_______").otherwise(" Live call transfer :").alias("text"))
    return materialize(lines.unionByName(rules))


@query("linear_leads", f"""{LEADS_CTE} SELECT * EXCLUDE (src) FROM (SELECT src, {_CARD_EXPECTED} FROM raw_leads) WHERE name IS NOT NULL""")
def linear_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(extract_leads(linear_cells(linear_lines(spark, sf_dir), INNER_BREAKS)), *_CARD_OUT)


@query("linear_detect", f"""{LEADS_CTE} SELECT CAST(src - src % 100 AS VARCHAR) AS file_id, count(*) FILTER (raw_name IS NOT NULL) AS names,
  count(*) FILTER (raw_dob IS NOT NULL) AS births FROM raw_leads GROUP BY 1""")
def linear_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and birth label lines per file, which tell linear card files from tables."""
    return linear_lines(spark, sf_dir).groupBy("file_id").agg(
        F.sum(label_count(F.col("text"), fv.LINE_NAME)).alias("names"),
        F.sum(label_count(F.col("text"), fv.LINE_DOB, fv.LINE_NAME)).alias("births"))


@query("autos_fallback", f"""{LEADS_CTE} SELECT src, CASE WHEN src % 4 = 0 THEN '2' WHEN len(v) > 0 THEN CAST(len(v) AS VARCHAR) END AS autos
  FROM (SELECT src, list_filter(string_split(coalesce(raw_vehicles, ''), ' / '), lambda x: x <> '') AS v FROM raw_leads)""")
def autos_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = F.filter(F.split(F.coalesce("raw_vehicles", F.lit("")), " / "), lambda v: v != "")
    return raw_leads(spark, sf_dir).select("src", auto_count(F.when(F.col("src") % 4 == 0, "2"), vehicles).alias("autos"))


# ------------------------------------------------------------------------------------ labeled columns

_FIRST = "split_part(trim(raw_name), ' ', 1)"
_TOKENS = ["'Contact Details'", "'First Name'", _FIRST, "'Last Name'", "'Testlast'", "'Primary Phone'", "raw_phone", "'Email'", "raw_email",
           "'Address'", "raw_street", "'City'", "raw_city", "'ZipCode'", "raw_zip", "'Date of Birth'", "raw_dob", "'Drivers'",
           "'First Name'", "'Somebody'", "'Year'", "'2020'", "'Make'", "'Honda'", "'Model'", "'Accord'", "'Year'", "'1999'", "'Model'", "'Lost'", "note"]


def labeled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form exports of four columns with leads below each other."""
    n = F.col("src")
    tokens = lines_of(spark, sf_dir, _TOKENS).select(
        (F.floor(n / 100) * 100).cast("string").alias("file_id"), (F.floor(n / 4) * 40 + F.col("i")).cast("bigint").alias("place"),
        (n % 4).cast("int").alias("col"), "text")
    # Dealt out before they are grouped, as in grid_rows.
    return tokens.withColumnRenamed("place", "src").repartition("file_id", "src").groupBy("file_id", "src").agg(
        *[F.max(F.when(F.col("col") == c, F.col("text"))).alias(f"c{c}") for c in range(4)]).select(
        "file_id", "src", F.array(*[F.col(f"c{c}") for c in range(4)]).alias("cells")).transform(materialize)


def _after(label_empty: str, value: str) -> str:
    """A value is lost when the empty value before its label made that label a value."""
    return f"CASE WHEN coalesce(trim({label_empty}), '') = '' THEN NULL ELSE {_nonempty(f'trim({value})')} END"


@query("labeled_leads", f"""{LEADS_CTE} SELECT {_FIRST} || ' Testlast' AS name, {_nonempty('trim(raw_dob)')} AS dob, {_nonempty('trim(raw_phone)')} AS phone,
  {_after('raw_phone', 'raw_email')} AS email, concat_ws(', ', {_nonempty('trim(raw_street)')}, {_nonempty('trim(raw_city)')}) AS address,
  CASE WHEN coalesce(trim(raw_street), '') = '' THEN {_nonempty('trim(raw_zip)')} ELSE {_after('raw_city', 'raw_zip')} END AS zip, '1' AS autos, {_mention('note')} AS mention, '2020 Honda Accord' AS vehicles
  FROM raw_leads""")
def labeled_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_labeled(labeled_rows(spark, sf_dir))
    return short(found, "Full Name", "Date of Birth", "Phone Number", "Email", "Address", "ZIP Code", "Autos", "Current Insurance",
                 "Cars Make and Model").withColumnRenamed("carrier", "mention")


# ------------------------------------------------------------------------------------ all layouts together

_MIN = fv.CARD_MIN_LABELS


@query("layout_route_all", f"""{SHEETS_CTE} SELECT DISTINCT 'headed ' || file_id AS file_id, CAST(0 AS BIGINT) AS contact_cells, CAST(0 AS BIGINT) AS first_name_cells, 'header' AS layout FROM sheet
  UNION ALL SELECT DISTINCT 'plain ' || file_id, 0, 0, 'inferred' FROM headerless
  UNION ALL SELECT 'grid ' || CAST(src - src % 99 AS VARCHAR), 0, 0, CASE WHEN count(raw_name) >= {_MIN} AND count(raw_dob) >= {_MIN} THEN 'grid' ELSE 'inferred' END FROM raw_leads GROUP BY 1
  UNION ALL SELECT 'form ' || CAST(src - src % 100 AS VARCHAR), count(*), 2 * count(*), CASE WHEN 2 * count(*) >= {_MIN} THEN 'labeled' ELSE 'inferred' END FROM raw_leads GROUP BY 1""")
def layout_route_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router over sheets of four kinds in one table: headed, header-less, card grids, labeled columns."""
    kinds = {"headed": filled_rows(spark, sf_dir), "plain": headerless_rows(spark, sf_dir), "grid": grid_rows(spark, sf_dir),
             "form": labeled_rows(spark, sf_dir)}
    rows = None
    for kind, sheets in kinds.items():
        named = sheets.select(F.concat(F.lit(f"{kind} "), "file_id").alias("file_id"), "src", "cells")
        rows = named if rows is None else rows.unionByName(named)
    rows = materialize(rows)
    counts = count_layouts(rows)
    routed = route(counts, locate_header(rows, PROFILE))
    return routed.join(counts, "file_id").select("file_id", "contact_cells", "first_name_cells", "layout")
