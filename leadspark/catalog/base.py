"""Shared inputs of the registered queries: messy leads derived from the given tables, and oracle SQL parts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions.values import carrier_vocabulary
from leadspark.operators.rows import col
from leadspark.operators.staging import spread
from leadspark.plans.organize import Organized, organize_table
from leadspark.plans.refine import Refined, refine
from leadspark.profile import load_profile

AS_OF = "2026-07-01"
PROFILE = load_profile()

# Messy leads from customer, nation and orders: one text that Spark and DuckDB both run.
RAW_LEADS = """
WITH f AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d FROM orders GROUP BY o_custkey),
k AS (SELECT CAST(c_custkey AS BIGINT) AS src, n_name, c_nationkey,
        CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END AS k,
        CAST(c_acctbal AS BIGINT) AS bal
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT k.*, d,
        CAST(2000000000 + ((CASE WHEN k % 10 IN (0, 1) THEN k - k % 2 ELSE k END) * 7919) % 1000000000 AS VARCHAR(10)) AS ph,
        CASE CAST(k % 12 AS INT) WHEN 0 THEN 'John' WHEN 1 THEN 'Jon' WHEN 2 THEN 'Robert' WHEN 3 THEN 'Bob'
          WHEN 4 THEN 'Elizabeth' WHEN 5 THEN 'Liz' WHEN 6 THEN 'William' WHEN 7 THEN 'Bill'
          WHEN 8 THEN 'Katherine' WHEN 9 THEN 'Catherine' WHEN 10 THEN 'Ann-Marie' ELSE 'McKenna' END AS g,
        CASE CAST(((k - k % 12) / 12) % 7 AS INT) WHEN 0 THEN 'Testone' WHEN 1 THEN 'Testtwo' WHEN 2 THEN 'Sampleparsa'
          WHEN 3 THEN 'O''Testly' WHEN 4 THEN 'Testwasson' WHEN 5 THEN 'Fakehughes' ELSE 'Testgentilho' END AS s,
        CAST(1940 + k % 72 AS VARCHAR(4)) AS yy, CAST(1 + k % 12 AS VARCHAR(2)) AS mm, CAST(1 + k % 28 AS VARCHAR(2)) AS dd
      FROM k LEFT JOIN f ON src = o_custkey)
SELECT src,
  CASE WHEN src % 50 = 33 THEN 'junkdate' WHEN src % 3 = 0 THEN CAST(d AS VARCHAR(10)) || ' 10:30' ELSE CAST(d AS VARCHAR(10)) END AS raw_timestamp,
  CASE WHEN src % 50 = 33 THEN 'n/a' WHEN src % 41 = 7 THEN g || '  ' || s || ' 3'
       WHEN src % 3 = 0 THEN upper(g || ' ' || s) WHEN src % 3 = 1 THEN lower(g || '  ' || s) ELSE g || ' ' || s END AS raw_name,
  CASE WHEN src % 50 = 33 OR src % 17 = 5 THEN '--' WHEN src % 4 = 0 THEN mm || '/' || dd || '/' || yy
       WHEN src % 4 = 1 THEN yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0')
       WHEN src % 4 = 2 THEN lpad(mm, 2, '0') || '/' || lpad(dd, 2, '0') || '/' || yy ELSE mm || '-' || dd || '-' || yy END AS raw_dob,
  CASE WHEN src % 50 = 33 THEN NULL ELSE CAST(100 + k % 900 AS VARCHAR(4)) || ' Fake  St' END AS raw_street,
  CASE WHEN src % 50 = 33 OR src % 9 = 4 THEN '' ELSE n_name END AS raw_city,
  CASE WHEN src % 50 = 33 THEN '---' WHEN src % 13 = 6 THEN '' WHEN src % 7 = 0 THEN ph
       WHEN src % 7 = 1 THEN '(' || substr(ph, 1, 3) || ') ' || substr(ph, 4, 3) || '-' || substr(ph, 7, 4)
       WHEN src % 7 = 2 THEN substr(ph, 1, 3) || '-' || substr(ph, 4, 3) || '-' || substr(ph, 7, 4)
       WHEN src % 7 = 3 THEN substr(ph, 1, 3) || '.' || substr(ph, 4, 3) || '.' || substr(ph, 7, 4)
       WHEN src % 7 = 4 THEN '1-' || substr(ph, 1, 3) || '-' || substr(ph, 4, 7)
       WHEN src % 7 = 5 THEN ph || '.0' WHEN src % 21 = 6 THEN substr(ph, 1, 8) ELSE '+1 ' || ph END AS raw_phone,
  CASE WHEN src % 50 = 33 THEN 'none' WHEN src % 5 = 0 THEN CAST(2100 + k % 700 AS VARCHAR(4)) WHEN src % 5 = 1 THEN '30016-1234'
       WHEN src % 5 = 2 THEN '303491234' WHEN src % 5 = 3 THEN '123456' ELSE CAST(30000 + k % 999 AS VARCHAR(5)) || '.0' END AS raw_zip,
  CASE WHEN src % 50 = 33 THEN 'null' WHEN src % 6 = 0 THEN 'OWNER' WHEN src % 6 = 1 THEN 'rented' WHEN src % 6 = 2 THEN ' own '
       WHEN src % 6 = 3 THEN 'Tenant' WHEN src % 6 = 4 THEN 'homeowners' ELSE 'banana' END AS raw_homeowner,
  CASE WHEN src % 50 = 33 THEN '-' WHEN src % 23 = 9 THEN '1e20' WHEN src % 23 = 10 THEN '12345678901234567890' WHEN src % 4 = 0 THEN '2' WHEN src % 4 = 1 THEN '2.7' WHEN src % 4 = 2 THEN '3 cars' ELSE 'many' END AS raw_autos,
  CASE WHEN src % 50 = 33 THEN 'N/A' WHEN src % 29 = 3 THEN 'NA' WHEN src % 29 = 4 THEN ' NA ' WHEN src % 8 = 0 THEN 'STATE FARM' WHEN src % 8 = 1 THEN 'gieco' WHEN src % 8 = 2 THEN 'Liberty'
       WHEN src % 8 = 3 THEN 'auto owners' WHEN src % 8 = 4 THEN 'ACME MUTUAL' WHEN src % 8 = 5 THEN 'Progressve' WHEN src % 8 = 6 THEN 'usaa' ELSE '' END AS raw_carrier,
  CASE WHEN src % 50 = 33 THEN NULL WHEN src % 6 = 5 THEN '' ELSE CAST(1990 + k % 35 AS VARCHAR(4)) || ' Ford F150 / 2020  Kia Soul' END AS raw_vehicles,
  CASE WHEN src % 11 = 2 THEN 'not-an-email' WHEN src % 11 = 3 THEN 'no@gmail.com'
       ELSE lower(replace(g, '-', '')) || CAST(k AS VARCHAR(12)) || '@' || CASE WHEN src % 7 = 1 THEN 'GMIAL.com' WHEN src % 7 = 2 THEN 'yaho.com' WHEN src % 7 = 3 THEN 'corp.example' ELSE 'gmail.com' END END AS raw_email,
  CASE WHEN src % 6 = 0 THEN CAST(2026 - (1940 + k % 72) AS VARCHAR(4)) WHEN src % 6 = 1 THEN '20' WHEN src % 6 = 2 THEN 'abc' ELSE '' END AS raw_age,
  CASE WHEN src % 5 = 0 THEN 'Student' WHEN src % 5 = 1 THEN 'Retired nurse' WHEN src % 5 = 2 THEN 'Engineer' ELSE '' END AS raw_occupation,
  CASE WHEN src % 4 = 0 THEN 'StateFarm 1 year' WHEN src % 4 = 1 THEN 'has Nation Wide ins. for 3 yrs' WHEN src % 4 = 2 THEN 'farm bureau, was geico' ELSE 'hot lead' END AS note
FROM p
"""

# Column heads under which the messy leads enter the engine.
HEADS = {
    "raw_timestamp": "Time stamp", "raw_name": "NAME", "raw_dob": "D.O.B", "raw_street": "Street", "raw_city": "City",
    "raw_phone": "Phone#", "raw_zip": "Zip", "raw_homeowner": "Own/Rent", "raw_autos": "Vehicles",
    "raw_carrier": "Carrier", "raw_vehicles": "car info", "raw_email": "E-mail", "raw_age": "Age",
    "raw_occupation": "Job", "note": "Leads Note",
}
# Short output names of the target columns.
SHORT = {
    "Timestamp": "ts", "Full Name": "name", "Date of Birth": "dob", "Address": "address", "Phone Number": "phone",
    "ZIP Code": "zip", "Homeowner": "home", "Autos": "autos", "Current Insurance": "carrier",
    "Cars Make and Model": "vehicles", "Email": "email", "Age": "age", "Occupation": "job",
}
TARGETS = [SHORT[c] for c in PROFILE.columns]
# Two source files, one of which holds two thirds of all rows.
FILE_OF = "CASE WHEN src % 30 < 20 THEN 'export-a' ELSE 'export-b' END"


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and its oracle SQL."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(build, oracle)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy leads. Customers are dealt out first: a file of one row group would leave all the work on a lead to one task."""
    text = RAW_LEADS
    for name in ("customer", "nation", "orders"):
        text = text.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "orders")}
    tables["customer"] = spread(tables["customer"].select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey", "c_acctbal")
    return spark.sql(text, **tables)


def headed_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy leads as a headed table with its source file."""
    return raw_leads(spark, sf_dir).select(
        "src", F.expr(FILE_OF).alias("file"), *[F.col(c).alias(h) for c, h in HEADS.items()])


# Queries over the same leads share their stored tables within one Spark application.
_SHARED: dict[tuple[str, str, str], object] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget_shared() -> None:
    """Make the next query compute everything from the given tables again."""
    _SHARED.clear()


def organized(spark: SparkSession, sf_dir: str) -> Organized:
    return shared(spark, sf_dir, "organized", lambda: organize_table(
        headed_leads(spark, sf_dir), PROFILE, AS_OF, order_col="src", file_col="file"))


def refined(spark: SparkSession, sf_dir: str) -> Refined:
    """Refinement over stored leads: its outputs read them several times."""
    return shared(spark, sf_dir, "refined", lambda: refine(organized(spark, sf_dir).materialize_leads()).materialized())


def short(df: DataFrame, *columns: str) -> DataFrame:
    """Select ``columns`` with target columns renamed to their short names."""
    return df.select(*[col(c).alias(SHORT.get(c, c)) for c in columns])


# ------------------------------------------------------------------------------------ oracle SQL parts

def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_values(pairs) -> str:
    return "VALUES " + ", ".join(f"({sql_list(p)})" for p in pairs)


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_text(x: str) -> str:
    return f"CASE WHEN lower({sql_clean(x)}) NOT IN ({sql_list(fv.MISSING_WORDS)}) THEN {sql_clean(x)} END"


def sql_name(x: str) -> str:
    part = "list_transform(string_split(w, '-'), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2)))"
    return (f"array_to_string(list_transform(string_split({sql_text(x)}, ' '), lambda w: "
            f"CASE WHEN w = upper(w) OR w = lower(w) THEN array_to_string({part}, '-') ELSE w END), ' ')")


DATE_FORMATS = "['%m/%d/%Y', '%Y-%m-%d', '%m-%d-%Y']"
STAMP_FORMATS = "['%Y-%m-%d %H:%M', '%Y-%m-%d']"


def sql_date(x: str) -> str:
    return f"strftime(try_strptime({sql_text(x)}, {DATE_FORMATS}), '%m/%d/%Y')"


def sql_datetime(x: str) -> str:
    t = f"try_strptime({sql_text(x)}, {STAMP_FORMATS})"
    return (f"CASE WHEN hour({t}) + minute({t}) > 0 THEN strftime({t}, '%m/%d/%Y %H:%M') "
            f"ELSE strftime({t}, '%m/%d/%Y') END")


def sql_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def sql_bare_digits(x: str) -> str:
    bare = f"regexp_replace({sql_clean(x)}, '\\.0$', '')"
    return f"CASE WHEN lower({bare}) NOT IN ({sql_list(fv.MISSING_WORDS)}) THEN {sql_digits(bare)} END"


def sql_phone(x: str) -> str:
    d = f"regexp_replace({sql_bare_digits(x)}, '^1([0-9]{{10}})$', '\\1')"
    return (f"CASE WHEN length({d}) = 10 THEN '(' || substr({d}, 1, 3) || ') ' || substr({d}, 4, 3) || '-' || "
            f"substr({d}, 7, 4) WHEN {d} <> '' THEN {d} END")


def sql_zip(x: str) -> str:
    d = sql_bare_digits(x)
    return (f"CASE WHEN length({d}) = 9 THEN substr({d}, 1, 5) "
            f"WHEN length({d}) BETWEEN 3 AND 5 THEN lpad({d}, 5, '0') END")


def sql_home_exact(x: str) -> str:
    return (f"CASE WHEN lower({sql_clean(x)}) IN ({sql_list(fv.OWNER_WORDS)}) THEN 'Owner' "
            f"WHEN lower({sql_clean(x)}) IN ({sql_list(fv.RENTED_WORDS)}) THEN 'Rented' END")


def sql_int(x: str) -> str:
    t = sql_text(x)
    return (f"CASE WHEN try_cast({t} AS DOUBLE) IS NOT NULL THEN CAST(CAST(trunc(CAST({t} AS DOUBLE)) AS HUGEINT) AS VARCHAR) "
            f"WHEN {sql_digits(t)} <> '' THEN {sql_digits(t)} END")


def sql_key(x: str) -> str:
    return f"regexp_replace(lower({sql_text(x)}), '[^a-z]', '', 'g')"


def sql_canon(x: str) -> str:
    flat = f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"
    return (f"array_to_string(list_prepend(coalesce((SELECT v FROM nicknames WHERE n = string_split({flat}, ' ')[1]), "
            f"string_split({flat}, ' ')[1]), string_split({flat}, ' ')[2:]), ' ')")


def _longest(a: str, b: str) -> str:
    """Longest common piece of two texts: its length, and minus its first place in ``a``."""
    return (f"list_aggregate(flatten([[{{'k': k, 'i': -i}} for k in range(1, length({a}) - i + 2) "
            f"if contains({b}, substr({a}, i, k))] for i in range(1, length({a}) + 1)]), 'max')")


def sql_ratio(name: str, pairs: str) -> str:
    """CTEs computing the Ratcliff/Obershelp ratio of all (a, b) in the ``pairs`` query, as table ``name``."""
    cut = "substr(a, -m.i, m.k)"
    return f"""
{name}_work AS (
  SELECT a AS p, b AS q, a, b, {_longest('a', 'b')} AS m FROM (SELECT DISTINCT a, b FROM ({pairs}))
  UNION ALL
  SELECT p, q, c.a, c.b, {_longest('c.a', 'c.b')} AS m FROM (
    SELECT p, q, unnest([{{'a': substr(a, 1, -m.i - 1), 'b': substr(b, 1, strpos(b, {cut}) - 1)}},
                         {{'a': substr(a, -m.i + m.k), 'b': substr(b, strpos(b, {cut}) + m.k)}}]) AS c
    FROM {name}_work WHERE m IS NOT NULL)),
{name} AS (SELECT p AS a, q AS b, CASE WHEN length(p) + length(q) = 0 THEN 1.0
    ELSE 2.0 * coalesce(sum(m.k), 0) / (length(p) + length(q)) END AS ratio FROM {name}_work GROUP BY p, q)"""


def sql_closest(name: str, words: str, vocabulary, cutoff: float) -> str:
    """CTEs mapping each word ``w`` of the ``words`` query to its closest vocabulary entry, as table ``name``."""
    entries = "(VALUES " + ", ".join(f"({sql_list([v])})" for v in vocabulary) + ")"
    pairs = f"SELECT v AS a, w AS b FROM ({words}) AS ws(w) CROSS JOIN {entries} AS vs(v) WHERE w IS NOT NULL"
    return sql_ratio(f"{name}_ratio", pairs) + f""",
{name} AS (SELECT b AS w, max_by(a, {{'r': ratio, 'a': a}}) AS entry FROM {name}_ratio WHERE ratio >= {cutoff} GROUP BY b)"""


QUALITY = fv.DEFAULT_QUALITY
LEADS_CTE = f"WITH RECURSIVE raw_leads AS ({RAW_LEADS})"
STD_CTE = LEADS_CTE + f""",
nicknames(n, v) AS ({sql_values(QUALITY["nicknames"].items())}),
carriers(k, v) AS ({sql_values(carrier_vocabulary().items())}),
{sql_closest("near_carrier", f"SELECT DISTINCT {sql_key('raw_carrier')} FROM raw_leads", carrier_vocabulary(), fv.CARRIER_CUTOFF)},
{sql_closest("near_owner", f"SELECT DISTINCT lower({sql_text('raw_homeowner')}) FROM raw_leads", fv.OWNER_WORDS, fv.HOMEOWNER_CUTOFF)},
{sql_closest("near_rented", f"SELECT DISTINCT lower({sql_text('raw_homeowner')}) FROM raw_leads", fv.RENTED_WORDS, fv.HOMEOWNER_CUTOFF)},
std AS (SELECT {FILE_OF} AS file_id, src,
  {sql_datetime('raw_timestamp')} AS ts, {sql_name('raw_name')} AS name, {sql_date('raw_dob')} AS dob,
  {sql_text("array_to_string(list_filter([trim(raw_street), trim(raw_city)], lambda p: lower(p) NOT IN (" + sql_list(fv.MISSING_WORDS) + ")), ', ')")} AS address,
  {sql_phone('raw_phone')} AS phone, {sql_zip('raw_zip')} AS zip,
  coalesce({sql_home_exact('raw_homeowner')},
    CASE WHEN lower({sql_text('raw_homeowner')}) IN (SELECT w FROM near_owner) THEN 'Owner'
         WHEN lower({sql_text('raw_homeowner')}) IN (SELECT w FROM near_rented) THEN 'Rented' END) AS home,
  {sql_int('raw_autos')} AS autos,
  coalesce((SELECT v FROM carriers WHERE k = {sql_key('raw_carrier')}),
    (SELECT v FROM carriers WHERE k = (SELECT entry FROM near_carrier WHERE w = {sql_key('raw_carrier')})),
    {sql_name('raw_carrier')}) AS carrier,
  {sql_text('raw_vehicles')} AS vehicles, lower({sql_text('raw_email')}) AS email, {sql_int('raw_age')} AS age,
  {sql_text('raw_occupation')} AS job,
  coalesce(trim(raw_timestamp), '') AS r_ts, coalesce(trim(raw_name), '') AS r_name, coalesce(trim(raw_dob), '') AS r_dob,
  array_to_string(list_filter([trim(raw_street), trim(raw_city)], lambda p: lower(p) NOT IN ({sql_list(fv.MISSING_WORDS)})), ', ') AS r_address,
  coalesce(trim(raw_phone), '') AS r_phone, coalesce(trim(raw_zip), '') AS r_zip, coalesce(trim(raw_homeowner), '') AS r_home,
  coalesce(trim(raw_autos), '') AS r_autos, coalesce(trim(raw_carrier), '') AS r_carrier,
  coalesce(trim(raw_vehicles), '') AS r_vehicles
  FROM raw_leads),
marked AS (SELECT *, coalesce(phone IS NOT NULL AND name IS NOT NULL AND src > min(src) OVER (
    PARTITION BY file_id, lower(phone), lower(name)), FALSE) AS duplicate
  FROM std WHERE coalesce({", ".join(TARGETS)}) IS NOT NULL),
leads AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY src) AS row FROM marked WHERE NOT duplicate)"""
