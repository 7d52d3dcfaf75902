"""Queries that run whole jobs on files written from the given tables and read the written results back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.catalog.base import AS_OF, LEADS_CTE, PROFILE, SHORT, STD_CTE, TARGETS, query, raw_leads, sql_list, sql_text
from leadspark.catalog.layouts import file_number, write_folder, write_lines
from leadspark.functions import values
from leadspark.operators.rows import col
from leadspark.operators.staging import staging_folder
from leadspark.plans.files import organize_files
from leadspark.plans.job import run_job
from leadspark.sources.intake import list_files, profile_files, read_lines
from leadspark.streaming.dropfolder import watch_folder

_KEPT = f"""{STD_CTE}, refiled AS (SELECT * EXCLUDE (file_id), CAST(src - src % 100 AS BIGINT) AS f FROM std
    WHERE coalesce({", ".join(TARGETS)}) IS NOT NULL),
  kept AS (SELECT * FROM (SELECT *, coalesce(phone IS NOT NULL AND name IS NOT NULL AND src > min(src) OVER (
    PARTITION BY f, lower(phone), lower(name)), FALSE) AS dup FROM refiled) WHERE NOT dup)"""
_WRITTEN = f"{_KEPT} SELECT f, {', '.join(f'''coalesce({t}, 'NA') AS {t}''' for t in TARGETS)} FROM kept"


def _out(spark: SparkSession) -> str:
    return f"{staging_folder(spark)}/job-{uuid.uuid4().hex}"


def _read_organized(spark: SparkSession, path: str) -> DataFrame:
    written = (spark.read.option("header", "true").option("escape", '"').option("recursiveFileLookup", "true")
               .schema(", ".join(f"`{c}` string" for c in PROFILE.columns)).csv(path).withColumn("path", F.col("_metadata.file_path")))
    number = F.regexp_extract(F.url_decode(F.replace("path", F.lit("%25"), F.lit("%"))), "f=([0-9]+)/", 1).cast("bigint").alias("f")
    return written.select(number, *[col(c).alias(SHORT[c]) for c in PROFILE.columns])


@query("job_leads", _WRITTEN)
def job_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean CSV files of a batch job over a folder, read back."""
    out = _out(spark)
    run_job(spark, write_folder(spark, sf_dir), out, as_of=AS_OF)
    return _read_organized(spark, f"{out}/organized")


@query("stream_leads", _WRITTEN)
def stream_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean CSV files that the drop-folder stream writes until the folder is drained, read back."""
    out = _out(spark)
    stream = watch_folder(spark, write_folder(spark, sf_dir), out, f"{out}-state", as_of=AS_OF)
    stream.awaitTermination()
    if stream.exception() is not None:
        raise RuntimeError("the drop-folder stream failed") from stream.exception()
    return _read_organized(spark, f"{out}/batch=*/organized")


@query("job_log_sections", f"{_KEPT} SELECT f, 'totals' AS section, CAST(1 AS BIGINT) AS items FROM kept GROUP BY f "
       "UNION ALL SELECT f, 'scores', count(*) FROM kept GROUP BY f")
def job_log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per file in the totals and scores sections of a job's quality log."""
    out = _out(spark)
    run_job(spark, write_folder(spark, sf_dir), out, as_of=AS_OF)
    log = spark.read.schema("file_id string, section string, position bigint, part bigint, item string").json(f"{out}/errors/log")
    return log.where("section IN ('totals', 'scores')").groupBy(file_number(), "section").agg(F.count("*").alias("items"))


_FOLDED = f"""{STD_CTE}, refiled AS (SELECT * EXCLUDE (file_id), CAST(src - src % 100 AS BIGINT) AS f FROM std
    WHERE coalesce({", ".join(TARGETS)}) IS NOT NULL),
  checked AS (SELECT *, coalesce(phone IS NOT NULL AND name IS NOT NULL AND src > min(src) OVER (
    PARTITION BY f, lower(phone), lower(name)), FALSE) AS dup FROM refiled),
  placed AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY src) AS row FROM checked WHERE NOT dup)"""


@query("job_log_items", f"""{_FOLDED} SELECT f, 'removed_duplicates' AS section,
    CAST(json_object('Full Name', name, 'Phone Number', phone) AS VARCHAR) AS item FROM checked WHERE dup
  UNION ALL SELECT f, 'invalid_phone_rows', CAST(json_object('index', row - 1) AS VARCHAR) FROM placed WHERE length(phone) <> 14""")
def job_log_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of two sections of a job's quality log, as written."""
    out = _out(spark)
    run_job(spark, write_folder(spark, sf_dir), out, as_of=AS_OF)
    log = spark.read.schema("file_id string, section string, position bigint, part bigint, item string").json(f"{out}/errors/log")
    return log.where("section IN ('removed_duplicates', 'invalid_phone_rows')").select(file_number(), "section", "item")


# A cell of the written files as the intake gives it: vehicles with line breaks, words for nothing left out.
_CELL = {t: f"r_{t}" for t in TARGETS} | {"vehicles": "replace(r_vehicles, ' / ', chr(10) || '/ ')"}
_CHANGES = " UNION ALL ".join(f"""SELECT f, row, '{name}' AS field, {_CELL[t]} AS original, coalesce({t}, 'NA') AS new
  FROM placed WHERE {_CELL[t]} <> coalesce({t}, 'NA') AND {_CELL[t]} <> '' AND {_CELL[t]} NOT IN ({sql_list(fv.READ_NULL_TOKENS)})""" for name, t in SHORT.items() if t in TARGETS)


@query("job_changes", f"{_FOLDED} {_CHANGES}")
def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change reports that a batch job writes, read back."""
    out = _out(spark)
    run_job(spark, write_folder(spark, sf_dir), out, as_of=AS_OF)
    written = (spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("recursiveFileLookup", "true")
               .schema("row bigint, field string, original string, new string, reason string").csv(f"{out}/changes")
               .withColumn("file_id", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("%25"), F.lit("%")))))
    return written.select(file_number(), "row", "field", "original", "new")


@query("ragged_rows", f"""{LEADS_CTE} SELECT CAST(src - src % 100 AS BIGINT) AS f, count(*) AS input_rows,
  count(*) FILTER (src % 4 > 1) AS ragged_rows FROM raw_leads GROUP BY 1""")
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose rows hold up to three cells more than their header: rows are kept and counted."""
    f = (F.col("src") - F.col("src") % 100).alias("f")
    leads = raw_leads(spark, sf_dir)
    body = leads.select(f, (F.col("src") + 1).alias("at"), F.concat(F.lit("Lead "), F.col("src"), F.lit(",4045550100,a"),
                                                                   F.expr("repeat(',b', int(src % 4) - 1)")).alias("value"))
    head = leads.where("src % 100 = 0").select(f, F.col("src").alias("at"), F.lit("Name,Phone,Note").alias("value"))
    done, _ = organize_files(spark, write_lines(spark, body.unionByName(head), "ragged"), PROFILE, AS_OF)
    return done.summary.where("file_id LIKE '%/f=%'").select(file_number(), "input_rows", "ragged_rows")


@query("file_kinds", f"""{LEADS_CTE} SELECT DISTINCT CAST(src - src % 50 AS BIGINT) AS f,
  ['text', 'xlsx', 'empty', 'text'][CAST((src - src % 50) / 50 % 4 + 1 AS INT)] AS kind FROM raw_leads""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files of fifty leads each: text, text that begins like a workbook, and blank lines only."""
    f = F.col("src") - F.col("src") % 50
    kind = (f / 50 % 4).cast("int")
    name = F.coalesce("raw_name", F.lit("x"))
    value = F.when(kind == 1, F.concat(F.lit("PK\x03\x04"), name)).when(kind == 2, " ").otherwise(F.concat(name, F.lit(",1")))
    folder = f"{staging_folder(spark)}/kinds-{uuid.uuid4().hex}"
    raw_leads(spark, sf_dir).select(f.alias("f"), value.alias("value")).repartition("f").write.partitionBy("f").text(folder)
    return profile_files(read_lines(spark, folder), list_files(spark, folder)).where("file_id LIKE '%/f=%'").select(file_number(), "kind")


@query("user_type", f"{LEADS_CTE} SELECT src, upper(substr({sql_text('raw_city')}, 1, 3)) AS code FROM raw_leads")
def user_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value type that a user adds to the registry."""
    values.register_type("city code", lambda v, as_of: F.upper(F.substring(values.text(v), 1, 3)))
    return raw_leads(spark, sf_dir).select("src", values.standardize(F.col("raw_city"), "city code", F.current_date()).alias("code"))
