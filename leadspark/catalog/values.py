"""Queries over single values: standardizers, fuzzy lookups, mentions in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.catalog.base import (AS_OF, LEADS_CTE, QUALITY, STD_CTE, query, raw_leads, sql_canon, sql_clean,
                                    sql_date, sql_datetime, sql_home_exact, sql_int, sql_key, sql_list,
                                    sql_name, sql_phone, sql_ratio, sql_text, sql_zip, table)
from leadspark.functions import values
from leadspark.functions.similarity import similarity
from leadspark.operators.cards import clean_insurance
from leadspark.operators.ordering import number_rows
from leadspark.operators.quality import email_valid
from leadspark.operators.staging import materialize


def _today() -> Column:
    return F.lit(AS_OF).cast("date")


def _scalar(name: str, source: str, output: str, build, sql: str, prelude: str = LEADS_CTE) -> None:
    """Register a query that applies one value function to one column of all messy leads."""
    @query(name, f"{prelude} SELECT src, {sql} AS {output} FROM raw_leads")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw_leads(spark, sf_dir).select("src", build(F.col(source)).alias(output))


_scalar("std_text", "raw_vehicles", "vehicles", values.text, sql_text("raw_vehicles"))
_scalar("std_name", "raw_name", "name", values.name, sql_name("raw_name"))
_scalar("std_date", "raw_dob", "dob", lambda v: values.date(v, _today()), sql_date("raw_dob"))
_scalar("std_datetime", "raw_timestamp", "ts", lambda v: values.datetime(v, _today()), sql_datetime("raw_timestamp"))
_scalar("std_phone", "raw_phone", "phone", values.phone, sql_phone("raw_phone"))
_scalar("phone_valid", "raw_phone", "ok", lambda v: values.phone_valid(values.phone(v)),
        f"coalesce(length({sql_phone('raw_phone')}) = 14, TRUE)")
_scalar("std_zip", "raw_zip", "zip", values.zip_code, sql_zip("raw_zip"))
_scalar("std_int", "raw_autos", "autos", values.integer, sql_int("raw_autos"))
_scalar("std_email", "raw_email", "email", values.email, f"lower({sql_text('raw_email')})")
_scalar("std_homeowner", "raw_homeowner", "home", values.homeowner_exact, sql_home_exact("raw_homeowner"))
_scalar("std_carrier_exact", "raw_carrier", "carrier", values.carrier_exact,
        f"(SELECT v FROM carriers WHERE k = {sql_key('raw_carrier')})", STD_CTE)
_scalar("whitespace", "raw_name", "cleaned", values.clean, sql_clean("raw_name"))
_scalar("missing_fold", "raw_homeowner", "cell", values.fold_read_nulls,
        f"CASE WHEN raw_homeowner NOT IN ({sql_list(fv.READ_NULL_TOKENS)}) THEN raw_homeowner END")
_scalar("canonical_name", "raw_name", "canon", lambda v: values.canonical_name(v, QUALITY["nicknames"]),
        sql_canon("raw_name"), STD_CTE)


@query("homeowner_fuzzy", f"{STD_CTE} SELECT src, home FROM std")
def homeowner_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_leads(spark, sf_dir).select("src", values.homeowner(F.col("raw_homeowner")).alias("home"))


@query("carrier_fuzzy", f"{STD_CTE} SELECT src, carrier FROM std")
def carrier_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_leads(spark, sf_dir).select("src", values.carrier(F.col("raw_carrier")).alias("carrier"))


@query("age_years", f"""{STD_CTE} SELECT src, CAST(date_diff('year', strptime(dob, '%m/%d/%Y'), DATE '{AS_OF}')
  - CASE WHEN strftime(DATE '{AS_OF}', '%m%d') < strftime(strptime(dob, '%m/%d/%Y'), '%m%d') THEN 1 ELSE 0 END AS INTEGER)
  AS age FROM std""")
def age_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = F.try_to_timestamp(values.date(F.col("raw_dob"), _today()), F.lit("MM/dd/yyyy")).cast("date")
    return raw_leads(spark, sf_dir).select("src", born.alias("born")).select(
        "src", values.age_years(F.col("born"), _today()).alias("age"))


@query("insurance_cleanup", LEADS_CTE + r""" SELECT src, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(note, '(?i)\b(insurance|ins|inc)\b\.?', ' ', 'g'), '(?i)\b(for|more\s+than|more\s+thena)\b', ' ', 'g'),
  '(?i)\d+\s*(years?|yrs?|yr|yers|months?)\b\.?', ' ', 'g'), '\b\d+\b', ' ', 'g'), '[/:=.,]+', ' ', 'g')) AS cleaned
  FROM raw_leads""")
def insurance_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_leads(spark, sf_dir).select("src", clean_insurance(F.col("note")).alias("cleaned"))


def _sql_mention(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN {sql_list([c])}"
                              for p, c in fv.CARRIER_MENTIONS) + " END"


@query("carrier_spotting", f"""{LEADS_CTE} SELECT 'note' AS origin, src AS id, {_sql_mention('note')} AS carrier FROM raw_leads
  UNION ALL SELECT 'document', doc_id, {_sql_mention('text')} FROM documents""")
def carrier_spotting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier mentioned in every note and every whole document."""
    notes = raw_leads(spark, sf_dir).select(F.lit("note").alias("origin"), F.col("src").alias("id"), F.col("note").alias("text"))
    documents = table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text")
    return notes.unionByName(documents).select("origin", "id", values.carrier_mention(F.col("text")).alias("carrier"))


@query("document_emails", r"""SELECT doc_id, token AS email,
    regexp_matches(token, '^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$') AS ok, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\r\f\v]+')) AS token FROM documents)
  WHERE contains(token, '@') GROUP BY ALL""")
def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with an at sign in all documents, and whether they are valid addresses."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[ \t\n\r\f\x0b]+")).alias("email"))
    return words.where(F.col("email").contains("@")).select(
        "doc_id", "email", email_valid(F.col("email")).alias("ok")).groupBy("doc_id", "email", "ok").agg(
        F.count("*").alias("n"))


@query("document_phones", rf"""SELECT doc_id, found, {sql_phone('found')} AS phone, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[(]?[0-9][0-9 ().-]{{6,}}[0-9]')) AS found FROM documents) GROUP BY ALL""")
def document_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone-like runs in all documents, standardized."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(r"[(]?[0-9][0-9 ().-]{6,}[0-9]"), F.lit(0))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(runs).alias("found"))
    return found.select("doc_id", "found", values.phone(F.col("found")).alias("phone")).groupBy(
        "doc_id", "found", "phone").agg(F.count("*").alias("n"))


@query("name_similarity", STD_CTE + """, pairs AS (SELECT src, lower(name) AS a,
    coalesce(lower(lag(name) OVER (ORDER BY src)), '') AS b FROM std),
""" + sql_ratio("rated", "SELECT a, b FROM pairs WHERE a IS NOT NULL") + """
SELECT src, ratio FROM pairs LEFT JOIN rated USING (a, b)""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every name to the one before it: names are numbered over all rows, and each distinct pair is compared once."""
    names = raw_leads(spark, sf_dir).select(F.lit("").alias("file_id"), "src", F.lower(values.name(F.col("raw_name"))).alias("a"))
    numbered = materialize(number_rows(names, ["file_id"], "src", "n"))
    before = numbered.select((F.col("n") + 1).alias("n"), F.coalesce("a", F.lit("")).alias("b"))
    pairs = materialize(numbered.join(before, "n", "left").select("src", "a", F.coalesce("b", F.lit("")).alias("b")))
    rated = pairs.select("a", "b").where("a IS NOT NULL").distinct().withColumn("ratio", similarity(F.col("a"), F.col("b")))
    return pairs.join(rated, ["a", "b"], "left").select("src", "ratio")
