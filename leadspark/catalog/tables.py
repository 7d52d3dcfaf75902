"""Queries over the organized table: mapping, row removal, numbering, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.catalog.base import (AS_OF, PROFILE, SHORT, STD_CTE, TARGETS, headed_leads, organized, query,
                                    short, sql_closest, sql_list, sql_name, sql_values, table)
from leadspark.operators import mapping
from leadspark.operators.ordering import number_rows
from leadspark.operators.rows import any_present, col, mark_duplicates, number_leads
from leadspark.plans.organize import organize_table

# ------------------------------------------------------------------------------------ header mapping

# Header spellings met in practice; each customer stands for a file that uses eight of them.
SPELLINGS = [
    "Time stamp", "FULL NAME", "D.O.B", "Street Address", "Phone#", "Zip", "Home Owner", "Vehicles", "Current Ins",
    "Leads Note", "Agent Name", "Make and Model", "First Name", "Last Name", "City", "Street", "State", "E-mail",
    "phone nmber", "carier", "Budget", "address 1", "Agent Nme", "Zip  Code", "Surname", "Lead  Score",
]
HEADERS_SQL = f"""SELECT CAST(c_custkey AS VARCHAR(20)) AS file_id, CAST(o AS INT) AS ordinal, h AS header
  FROM customer JOIN (VALUES {", ".join(f"({o})" for o in range(8))}) AS os(o) ON TRUE
  JOIN (VALUES {", ".join(f"({i}, '{h}')" for i, h in enumerate(SPELLINGS))}) AS hs(i, h)
    ON (c_custkey * 7 + o * (3 + c_custkey % 5)) % {len(SPELLINGS)} = i"""


def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HEADERS_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


def _mapping_sql(fuzzy: bool) -> str:
    """Header classification in SQL: exact and close names, first claim, composed parts."""
    key = "trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g'))"
    words = f"SELECT DISTINCT {key} FROM headers"
    near = (sql_closest("near_drop", words, PROFILE.drop_names, fv.DROP_CUTOFF) + ","
            + sql_closest("near_alias", words, PROFILE.aliases, fv.ALIAS_CUTOFF)) if fuzzy else \
        "near_drop AS (SELECT '' AS w, '' AS entry), near_alias AS (SELECT '' AS w, '' AS entry)"
    parts = [(t, n, a) for t, ps in PROFILE.compose.items() for n, names in enumerate(ps) for a in names]
    return f"""WITH RECURSIVE headers AS ({HEADERS_SQL}),
aliases(a, t) AS ({sql_values(PROFILE.aliases.items())}),
parts(t, n, a) AS (VALUES {", ".join(f"('{t}', {n}, '{a}')" for t, n, a in parts)}),
{near},
keyed AS (SELECT *, {key} AS key FROM headers),
cand AS (SELECT k.*, (key IN ({sql_list(PROFILE.drop_names)}) OR key IN (SELECT w FROM near_drop)) AS dropped,
    coalesce((SELECT t FROM aliases WHERE a = key), (SELECT t FROM aliases WHERE a = (SELECT entry FROM near_alias WHERE w = key))) AS cand
  FROM keyed k),
claimed AS (SELECT *, CASE WHEN dropped THEN 'dropped' WHEN cand IS NOT NULL AND row_number() OVER (
    PARTITION BY file_id, CASE WHEN dropped THEN NULL ELSE cand END ORDER BY ordinal) = 1 THEN 'mapped' ELSE 'unmapped' END AS s
  FROM cand),
pieces AS (SELECT c.file_id, c.ordinal, p.t, p.n, row_number() OVER (PARTITION BY c.file_id, p.t, p.n ORDER BY c.ordinal) AS nth
  FROM claimed c JOIN parts p ON p.a = c.key WHERE c.s = 'unmapped'
    AND NOT EXISTS (SELECT 1 FROM claimed m WHERE m.file_id = c.file_id AND m.s = 'mapped' AND m.cand = p.t)),
used AS (SELECT * FROM pieces p WHERE nth = 1 AND (SELECT count(DISTINCT n) FROM pieces q WHERE q.file_id = p.file_id AND q.t = p.t) >= 2),
classified AS (SELECT c.file_id, c.ordinal, c.header, c.key,
    CASE WHEN u.t IS NOT NULL THEN 'composed' ELSE c.s END AS status,
    CASE WHEN u.t IS NOT NULL THEN u.t WHEN c.s = 'mapped' THEN c.cand END AS target,
    CAST(CASE WHEN u.t IS NOT NULL THEN u.n WHEN c.s = 'mapped' THEN 0 END AS INTEGER) AS part
  FROM claimed c LEFT JOIN used u USING (file_id, ordinal))"""


@query("header_map_exact", _mapping_sql(False) + " SELECT * FROM classified")
def header_map_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.classify_headers(file_headers(spark, sf_dir), PROFILE, fuzzy=False)


@query("header_map_fuzzy", _mapping_sql(True) + " SELECT * FROM classified")
def header_map_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.classify_headers(file_headers(spark, sf_dir), PROFILE)


@query("header_claims", _mapping_sql(True) + " SELECT file_id, target, header FROM classified WHERE status = 'mapped'")
def header_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one header each target takes in each file."""
    found = mapping.classify_headers(file_headers(spark, sf_dir), PROFILE)
    return found.where("status = 'mapped'").select("file_id", "target", "header")


@query("header_report", _mapping_sql(True) + """ SELECT file_id,
  coalesce(string_agg(header, '|' ORDER BY ordinal) FILTER (status = 'dropped'), '') AS dropped,
  coalesce(string_agg(header, '|' ORDER BY ordinal) FILTER (status = 'unmapped'), '') AS unmapped FROM classified GROUP BY file_id""")
def header_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mapping.header_report(mapping.classify_headers(file_headers(spark, sf_dir), PROFILE))
    return report.select("file_id", F.array_join("dropped_headers", "|").alias("dropped"),
                         F.array_join("unmapped_headers", "|").alias("unmapped"))


_REPEATS = f"""SELECT file_id, ordinal, CASE WHEN ordinal % 4 = 3 THEN NULL
  ELSE substr(header, 1, 1) END AS header FROM ({HEADERS_SQL}) AS t"""


@query("header_names", f"""SELECT file_id, ordinal, CASE WHEN n > 0 THEN h || '.' || n ELSE h END AS header FROM (
  SELECT file_id, ordinal, h, row_number() OVER (PARTITION BY file_id, h ORDER BY ordinal) - 1 AS n FROM (
    SELECT file_id, ordinal, coalesce(header, 'column_' || ordinal) AS h FROM ({_REPEATS})))""")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank and repeated headers get distinct names."""
    repeats = spark.sql(_REPEATS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return mapping.name_headers(repeats)


# ------------------------------------------------------------------------------------ projection

@query("target_projection", f"{STD_CTE} SELECT file_id, src, {', '.join(f'r_{t} AS {t}' for t in TARGETS)} FROM std")
def target_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw target columns in profile order, Address composed from street and city."""
    full = organized(spark, sf_dir).standardized
    return full.select("file_id", "src", *[F.col("raw").getField(c).alias(SHORT[c]) for c in PROFILE.columns])


@query("compose_address", f"{STD_CTE} SELECT src, address FROM std")
def compose_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address from street and city columns, missing parts skipped."""
    return short(organized(spark, sf_dir).standardized, "src", "Address")


@query("standardized", f"{STD_CTE} SELECT file_id, src, {', '.join(TARGETS)}, email, age, job FROM std")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All target and auxiliary columns of every input row."""
    return short(organized(spark, sf_dir).standardized, "file_id", "src", *PROFILE.columns, "Email", "Age", "Occupation")


_FIRST, _LAST = "split_part(raw_name, ' ', 1)", "trim(substr(raw_name, length(split_part(raw_name, ' ', 1)) + 1))"


@query("compose_name", f"""{STD_CTE} SELECT src, {sql_name('joined')} AS name FROM (SELECT src, array_to_string(list_filter(
  [{_FIRST}, CASE WHEN src % 3 = 0 THEN 'NA' ELSE 'q.' END, {_LAST}],
  lambda p: lower(p) NOT IN ({sql_list(fv.MISSING_WORDS)})), ' ') AS joined FROM raw_leads)""")
def compose_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full Name from first, middle and last name columns, missing parts skipped."""
    first = F.substring_index("NAME", " ", 1)
    parts = headed_leads(spark, sf_dir).select(
        "src", first.alias("First"), F.when(F.col("src") % 3 == 0, "NA").otherwise("q.").alias("Middle"),
        F.col("NAME").substr(F.length(first) + 1, F.length("NAME")).alias("Surname"))
    done = organize_table(parts, PROFILE, AS_OF, order_col="src").standardized
    return done.select("src", col("Full Name").alias("name"))


@query("ts_synth", f"{STD_CTE} SELECT src, '07/01/2026 08:15' AS ts, name FROM std")
def ts_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No timestamp column: every row gets the processing time."""
    done = organize_table(headed_leads(spark, sf_dir).drop("Time stamp"), PROFILE, "2026-07-01 08:15:00", order_col="src",
                          file_col="file").standardized
    return short(done, "src", "Timestamp", "Full Name")


# ------------------------------------------------------------------------------------ rows

@query("table_intake", """SELECT CASE WHEN conv_id % 3 = 0 THEN NULL ELSE role END AS role,
    CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN NULL ELSE text END AS text FROM conversations
  WHERE NOT (conv_id % 3 = 0 AND turn % 2 = 0)""")
def table_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table that hold any value."""
    gaps = table(spark, sf_dir, "conversations").select(
        F.when(F.col("conv_id") % 3 != 0, F.col("role")).alias("role"),
        F.when((F.col("conv_id") % 3 != 0) | (F.col("turn") % 2 != 0), F.col("text")).alias("text"))
    return gaps.where(any_present(["role", "text"]))


@query("drop_all_na", f"{STD_CTE} SELECT file_id, src FROM std WHERE coalesce({', '.join(TARGETS)}) IS NOT NULL")
def drop_all_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organized(spark, sf_dir).standardized.where(~F.col("empty")).select("file_id", "src")


@query("exact_dedupe", f"{STD_CTE} SELECT file_id, src, name, phone FROM marked WHERE NOT duplicate")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(organized(spark, sf_dir).marked.where(~F.col("duplicate")), "file_id", "src", "Full Name", "Phone Number")


@query("removed_duplicates", f"{STD_CTE} SELECT file_id, src, name, phone FROM marked WHERE duplicate")
def removed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(organized(spark, sf_dir).removed_duplicates, "file_id", "src", "Full Name", "Phone Number")


@query("order_dedupe", """SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, o_orderkey > min(o_orderkey) OVER (
  PARTITION BY o_custkey, lower(o_orderpriority)) AS dup FROM orders) WHERE NOT dup""")
def order_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order per customer and priority."""
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("file_id"), F.col("o_orderkey").alias("src"), F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderpriority").alias("priority"))
    kept = mark_duplicates(orders, ["customer", "priority"]).where(~F.col("duplicate"))
    return kept.select(F.col("src").alias("o_orderkey"), F.col("customer").cast("bigint").alias("o_custkey"),
                       F.col("priority").alias("o_orderpriority"))


@query("row_numbers", f"{STD_CTE} SELECT file_id, src, row FROM leads")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organized(spark, sf_dir).leads.select("file_id", "src", "row")


@query("lineitem_numbers", """SELECT l_returnflag, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 16 + l_linenumber) AS row FROM lineitem""")
def lineitem_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers in three large groups, computed in chunks."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber",
                                                    (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("place"))
    return number_rows(items, ["l_returnflag"], "place", "row").drop("place")


_SORT = f"""row_number() OVER (PARTITION BY file_id ORDER BY coalesce(try_strptime(ts, '%m/%d/%Y %H:%M'), try_strptime(ts, '%m/%d/%Y'))
  NULLS LAST, coalesce(name, 'NA'), src)"""


@query("sorted_leads", f"{STD_CTE} SELECT file_id, src, {_SORT} AS row FROM marked WHERE NOT duplicate")
def sorted_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers under a profile that sorts by timestamp and name."""
    kept = organized(spark, sf_dir).marked.where(~F.col("duplicate"))
    return number_leads(kept.select("file_id", "src", "Timestamp", col("Full Name")), ["Timestamp", "Full Name"],
                        PROFILE.types).select("file_id", "src", "row")


@query("organized_leads", f"""{STD_CTE} SELECT file_id, row, {', '.join(f"coalesce({t}, 'NA') AS {t}" for t in TARGETS)} FROM leads""")
def organized_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organized output: target columns only, NA printed."""
    return short(organized(spark, sf_dir).organized, "file_id", "row", *PROFILE.columns)


# ------------------------------------------------------------------------------------ reports

_NAMES = dict(zip(TARGETS, PROFILE.columns))
_ISSUES_SQL = " UNION ALL ".join(
    f"""SELECT file_id, '{_NAMES[t]}' AS "column", count(*) FILTER ({t} IS NULL) AS na,
  count(*) FILTER ({t} IS NOT NULL AND {t} <> r_{t}) AS fixed FROM std GROUP BY file_id""" for t in TARGETS)


@query("column_issues", f"{STD_CTE} {_ISSUES_SQL}")
def column_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organized(spark, sf_dir).column_issues


def _reason_sql(t: str) -> str:
    reason = fv.CHANGE_REASONS[PROFILE.types[_NAMES[t]]]
    return f"CASE WHEN {t} IS NULL THEN '{fv.CHANGE_REASON_NA}' ELSE '{reason}' END"


_DIFFS_SQL = " UNION ALL ".join(
    f"""SELECT file_id, row, '{_NAMES[t]}' AS field, r_{t} AS original, coalesce({t}, 'NA') AS new, {_reason_sql(t)} AS reason
  FROM leads WHERE r_{t} <> '' AND r_{t} <> coalesce({t}, 'NA')""" for t in TARGETS)


@query("row_diffs", f"{STD_CTE} {_DIFFS_SQL}")
def row_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organized(spark, sf_dir).row_changes.drop("seq")


@query("invalid_phones", f"{STD_CTE} SELECT file_id, row, phone FROM leads WHERE phone IS NOT NULL AND length(phone) <> 14")
def invalid_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organized(spark, sf_dir).invalid_phones


SUMMARY_SQL = f"""SELECT s.file_id, count(*) AS input_rows, count(m.src) - count(*) FILTER (m.duplicate) AS output_rows,
    count(*) FILTER (m.duplicate) AS duplicates_removed, count(*) FILTER (m.src IS NULL) AS empty_rows_skipped
  FROM std s LEFT JOIN marked m USING (file_id, src) GROUP BY s.file_id"""


@query("run_summary", f"""{STD_CTE} SELECT *, CAST(0 AS BIGINT) AS skipped_non_lead_rows, FALSE AS header_inferred,
  FALSE AS timestamp_synthesized, 'Leads Note' AS dropped, '' AS unmapped FROM ({SUMMARY_SQL})""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = organized(spark, sf_dir).summary
    return s.select("file_id", "input_rows", "output_rows", "duplicates_removed", "empty_rows_skipped",
                    "skipped_non_lead_rows", "header_inferred", "timestamp_synthesized",
                    F.array_join("dropped_headers", "|").alias("dropped"), F.array_join("unmapped_headers", "|").alias("unmapped"))


@query("unrecognized", """SELECT lang AS file_id, count(*) AS input_rows, CAST(0 AS BIGINT) AS output_rows, TRUE AS unrecognized
  FROM documents GROUP BY lang""")
def unrecognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables none of whose columns is a lead column: nothing recognized."""
    profile = {"columns": [{"name": "Phone Number", "type": "phone"}], "dedupe_on": []}
    texts = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return organize_table(texts, profile, AS_OF, order_col="doc_id", file_col="lang").summary.select(
        "file_id", "input_rows", "output_rows", "unrecognized")


@query("recognized", """SELECT CAST(c_nationkey AS VARCHAR) AS file_id, count(*) AS input_rows,
  count(*) FILTER (c_nationkey % 2 = 1) AS output_rows, c_nationkey % 2 = 0 AS unrecognized FROM customer GROUP BY c_nationkey""")
def recognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one table with and without anything recognized: every other nation's phones are blank."""
    profile = {"columns": [{"name": "Phone Number", "type": "phone"}], "dedupe_on": []}
    phone = F.when(F.col("c_nationkey") % 2 == 1, F.concat(F.lit("404555"), F.lpad(F.col("c_custkey") % 10000, 4, "0"))).otherwise(" ")
    calls = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), phone.alias("Phone Number"))
    return organize_table(calls, profile, AS_OF, order_col="c_custkey", file_col="nation").summary.select(
        "file_id", "input_rows", "output_rows", "unrecognized")
