"""Queries over judged leads: rules, e-mail repair, duplicate groups, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.catalog.base import (AS_OF, PROFILE, QUALITY, SHORT, STD_CTE, organized, query, refined, short,
                                    sql_canon, sql_closest, sql_digits, sql_list, sql_ratio, table)
from leadspark.catalog.tables import SUMMARY_SQL
from leadspark.operators import quality as rules
from leadspark.operators import resolve
from leadspark.operators.components import connected_components
from leadspark.operators.staging import materialize
from leadspark.profile import load_profile

_R, _SCORING = QUALITY["rules"], QUALITY["scoring"]
_LOW, _HIGH = _R["dob_implausible"]["min_age"], _R["dob_implausible"]["max_age"]
_DOMAINS = QUALITY["email_domains"]
_VALID = r"regexp_matches(email, '^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$')"
_AGE = f"""(date_diff('year', strptime(dob, '%m/%d/%Y'), DATE '{AS_OF}')
  - CASE WHEN strftime(DATE '{AS_OF}', '%m%d') < strftime(strptime(dob, '%m/%d/%Y'), '%m%d') THEN 1 ELSE 0 END)"""

# Violations, e-mail fixes and duplicate groups in SQL, on top of the organized leads.
JUDGED_CTE = STD_CTE + f""",
{sql_closest("near_domain", f"SELECT DISTINCT lower(split_part(email, '@', 2)) FROM leads WHERE {_VALID} AND lower(split_part(email, '@', 2)) NOT IN ({sql_list(_DOMAINS)})", _DOMAINS, QUALITY["email_suggest_ratio"])},
{sql_ratio("back_ratio", "SELECT w AS a, entry AS b FROM near_domain")},
fixes AS (SELECT file_id, row, email AS original, split_part(email, '@', 1) || '@' || entry AS suggested, w AS domain, entry,
    ratio >= {QUALITY["email_autofix_ratio"]} AS applied, round(ratio, 2) AS confidence
  FROM leads JOIN near_domain ON {_VALID} AND lower(split_part(email, '@', 2)) = w JOIN back_ratio ON a = w AND b = entry),
aged AS (SELECT *, {_AGE} AS years FROM leads),
viol AS (
  SELECT file_id, row, 'email_invalid' AS rule, 'Email' AS fields, 'not a valid email: ' || email AS message FROM leads WHERE NOT {_VALID}
  UNION ALL SELECT file_id, row, 'email_domain_typo', 'Email', domain || ' looks like ' || entry FROM fixes
  UNION ALL SELECT file_id, row, 'dob_implausible', 'Date of Birth', 'derived age ' || years || ' outside {_LOW}-{_HIGH}'
    FROM aged WHERE years NOT BETWEEN {_LOW} AND {_HIGH}
  UNION ALL SELECT file_id, row, 'dob_vs_age', 'Date of Birth|Age', 'DOB implies ' || years || ' but Age column says ' || CAST(age AS BIGINT)
    FROM aged WHERE abs(CAST(age AS BIGINT) - years) > {_R["dob_vs_age"]["tolerance_years"]}
  UNION ALL SELECT file_id, row, 'dob_vs_occupation', 'Date of Birth|Occupation', 'occupation ''student'' but derived age ' || years
    FROM aged WHERE contains(lower(job), 'student') AND years > {_R["dob_vs_occupation"]["student_max_age"]}
  UNION ALL SELECT file_id, row, 'dob_vs_occupation', 'Date of Birth|Occupation', 'occupation ''retired'' but derived age ' || years
    FROM aged WHERE contains(lower(job), 'retired') AND years < {_R["dob_vs_occupation"]["retired_min_age"]}
  UNION ALL SELECT file_id, row, 'name_suspicious', 'Full Name', 'name looks malformed: ' || name
    FROM leads WHERE regexp_matches(name, '[0-9]') OR length(replace(name, ' ', '')) < 2
  UNION ALL SELECT file_id, row, 'phone_invalid', 'Phone Number', 'phone number is not 10 digits'
    FROM leads WHERE phone IS NOT NULL AND length(phone) <> 14),
penalty(rule, p) AS (VALUES {", ".join(f"('{r}', {v['penalty']})" for r, v in _R.items())}),
repaired AS (SELECT l.file_id, l.row, l.name, l.phone, CASE WHEN f.applied THEN f.suggested ELSE l.email END AS email
  FROM leads l LEFT JOIN fixes f USING (file_id, row)),
blocks AS (SELECT file_id, row, 0 AS kind, {sql_digits('phone')} AS key, {sql_canon('name')} AS canon FROM repaired WHERE {sql_digits('phone')} <> ''
  UNION ALL SELECT file_id, row, 1, lower(email), {sql_canon('name')} FROM repaired WHERE contains(email, '@') AND NOT starts_with(lower(email), 'no@')),
named AS (SELECT * FROM blocks WHERE canon IS NOT NULL),
met AS (SELECT x.file_id, x.kind, x.key, x.row AS a, y.row AS b, x.canon AS ca, y.canon AS cb
  FROM named x JOIN named y USING (file_id, kind, key) WHERE x.row < y.row),
{sql_ratio("name_ratio", "SELECT ca AS a, cb AS b FROM met WHERE ca <> cb")},
matched AS (SELECT m.* FROM met m LEFT JOIN name_ratio r ON r.a = ca AND r.b = cb
  WHERE ca = cb OR ratio >= {QUALITY["name_fuzzy_threshold"]}),
reach(file_id, r, m) AS (SELECT file_id, a, a FROM matched UNION SELECT file_id, b, b FROM matched
  UNION SELECT s.file_id, CASE WHEN s.r = t.a THEN t.b ELSE t.a END, s.m FROM reach s JOIN matched t
    ON s.file_id = t.file_id AND (s.r = t.a OR s.r = t.b)),
comp AS (SELECT file_id, r AS row, min(m) AS first_row FROM reach GROUP BY file_id, r),
starts AS (SELECT file_id, kind, key, min(row) AS start FROM blocks GROUP BY ALL),
reason AS (SELECT file_id, a AS first_row, arg_min(CASE kind WHEN 0 THEN 'phone ' ELSE 'email ' END || key, start * 2 + kind) AS matched_on
  FROM matched JOIN starts USING (file_id, kind, key) GROUP BY file_id, a),
groups AS (SELECT file_id, row, first_row, dense_rank() OVER (PARTITION BY file_id ORDER BY first_row) AS "group" FROM comp),
weights AS (SELECT file_id, row, name, CAST(round_even(({" + ".join(
    f"CASE WHEN {SHORT[c]} IS NOT NULL THEN {w} ELSE 0 END" for c, w in _SCORING["weights"].items())}) * 100.0 / {sum(_SCORING["weights"].values())}, 0) AS INTEGER)
  AS completeness, phone IS NOT NULL AND length(phone) <> 14 AS bad_phone FROM leads),
charged AS (SELECT file_id, row, rule FROM viol UNION ALL SELECT file_id, row, 'duplicate_group' FROM comp),
charges AS (SELECT file_id, row, CAST(sum(p) AS INTEGER) AS penalty, string_agg(DISTINCT rule, '|' ORDER BY rule) AS issues
  FROM charged JOIN penalty USING (rule) GROUP BY file_id, row),
scored AS (SELECT file_id, row, name, completeness, coalesce(penalty, 0) AS penalty, coalesce(issues, '') AS issues,
    greatest(0, least(100, completeness - coalesce(penalty, 0))) AS score, bad_phone FROM weights LEFT JOIN charges USING (file_id, row))"""


def _violations(df: DataFrame) -> DataFrame:
    return df.select("file_id", "row", "rule", F.array_join("fields", "|").alias("fields"), "message")


@query("violations", f"{JUDGED_CTE} SELECT * FROM viol")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(refined(spark, sf_dir).violations)


def _one_rule(name: str, rule: str) -> None:
    @query(name, f"{JUDGED_CTE} SELECT file_id, row, fields, message FROM viol WHERE rule = '{rule}'")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _violations(refined(spark, sf_dir).violations)
        return found.where(F.col("rule") == rule).drop("rule")


for _name, _rule in (("email_invalid", "email_invalid"), ("rule_age", "dob_implausible"), ("rule_age_stated", "dob_vs_age"),
                     ("rule_occupation", "dob_vs_occupation"), ("rule_name", "name_suspicious"), ("rule_phone", "phone_invalid")):
    _one_rule(_name, _rule)


@query("email_typos", f"{JUDGED_CTE} SELECT file_id, row, original, suggested, applied, confidence FROM fixes")
def email_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refined(spark, sf_dir).email_corrections.drop("field")


@query("email_autofix", f"{JUDGED_CTE} SELECT file_id, row, email FROM repaired")
def email_autofix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(refined(spark, sf_dir).judged, "file_id", "row", "Email")


@query("vertical", f"""{STD_CTE} SELECT file_id, CASE WHEN (count(carrier) > 0)::INT + (count(autos) > 0)::INT
  + (count(vehicles) > 0)::INT + (count(home) > 0)::INT >= 2 THEN 'insurance' ELSE 'general' END AS vertical FROM leads GROUP BY file_id""")
def vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refined(spark, sf_dir).verticals


_SIGNS = ["Carrier", "Premium", "MLS", "Bedrooms", "Company", "Product"]


@query("verticals", """WITH held AS (SELECT o_orderpriority AS file_id, bool_or(substr(o_orderpriority, 1, 1) IN ('1', '5')) AS a,
    bool_or(substr(o_orderpriority, 1, 1) IN ('2', '5')) AS b, bool_or(substr(o_orderpriority, 1, 1) = '3') AS c FROM orders GROUP BY 1)
  SELECT file_id, CASE WHEN a THEN 'insurance' WHEN b THEN 'real_estate' WHEN c THEN 'general_sales' ELSE 'general' END AS vertical FROM held""")
def verticals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries of files by the columns they fill, one file per order priority: each alone, two at once, and one column only."""
    filled = {"Carrier": "15", "Premium": "15", "MLS": "25", "Bedrooms": "25", "Company": "34", "Product": "3"}
    kind = F.substring("o_orderpriority", 1, 1)
    leads = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file_id"), *[
        F.when(kind.isin(*filled[c]), F.col("o_orderkey").cast("string")).alias(c) for c in _SIGNS])
    unmapped = leads.select("file_id").distinct().withColumn("unmapped_headers", F.array().cast("array<string>"))
    profile = load_profile({"columns": [{"name": c, "type": "text"} for c in _SIGNS], "dedupe_on": []})
    return rules.vertical(leads, unmapped, profile, QUALITY)


# ------------------------------------------------------------------------------------ duplicates

@query("block_keys", f"{JUDGED_CTE} SELECT * FROM blocks")
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block_keys(refined(spark, sf_dir).judged, QUALITY)


@query("pairs_equal_name", f"""{JUDGED_CTE} SELECT file_id, kind, key, canon, min(row) AS lo, max(row) AS hi, count(*) AS n
  FROM named GROUP BY file_id, kind, key, canon""")
def pairs_equal_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a block with one canonical name, folded to one entity."""
    keys = resolve.block_keys(refined(spark, sf_dir).judged, QUALITY)
    return resolve.fold_entities(keys).drop("vertex")


@query("pairs_similar", f"""{JUDGED_CTE} SELECT file_id, kind, key, least(ca, cb) AS name_1, greatest(ca, cb) AS name_2
  FROM matched WHERE ca <> cb GROUP BY ALL""")
def pairs_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different names of one block that some pair of rows matches."""
    keys = resolve.block_keys(refined(spark, sf_dir).judged, QUALITY)
    links = resolve.similar_links(materialize(resolve.fold_entities(keys)), QUALITY["name_fuzzy_threshold"])
    return links.select("file_id", "kind", "key", F.least("canon_a", "canon_b").alias("name_1"),
                        F.greatest("canon_a", "canon_b").alias("name_2")).distinct()


@query("dup_groups", f"""{JUDGED_CTE} SELECT file_id, "group", row, name, matched_on FROM groups
  JOIN leads USING (file_id, row) JOIN reason USING (file_id, first_row)""")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refined(spark, sf_dir).members


@query("dup_group_listing", f"""{JUDGED_CTE} SELECT file_id, "group", first_row, count(*) AS members, any_value(matched_on) AS matched_on
  FROM groups JOIN reason USING (file_id, first_row) GROUP BY file_id, "group", first_row""")
def dup_group_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refined(spark, sf_dir).groups


_EDGES = """SELECT 'all' AS file_id, CAST(o_custkey AS BIGINT) * 2 AS a, CAST(o_orderkey AS BIGINT) * 2 + 1 AS b FROM orders"""


@query("dup_components", f"""WITH RECURSIVE e AS ({_EDGES}), both_ways AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
  reach(r, m) AS (SELECT u, u FROM both_ways UNION SELECT v, m FROM reach JOIN both_ways ON u = r)
  SELECT 'all' AS file_id, r AS vertex, min(m) AS component FROM reach GROUP BY r""")
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of the customer-order graph."""
    orders = table(spark, sf_dir, "orders")
    return connected_components(spark.sql(_EDGES.replace("FROM orders", "FROM {orders}"), orders=orders))


# ------------------------------------------------------------------------------------ scores

@query("completeness", f"{JUDGED_CTE} SELECT file_id, row, completeness FROM weights")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = organized(spark, sf_dir).leads
    return leads.select("file_id", "row", rules.completeness(leads, QUALITY, PROFILE.columns).alias("completeness"))


@query("scores", f"""{JUDGED_CTE} SELECT file_id, row, name, completeness, penalty, issues, score,
  score < {_SCORING["review_threshold"]} AS review FROM scored""")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refined(spark, sf_dir).scores
    return found.withColumn("issues", F.array_join("issues", "|")).drop("status")


@query("penalties", f"{JUDGED_CTE} SELECT file_id, row, penalty, issues FROM scored WHERE penalty > 0")
def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refined(spark, sf_dir).scores.where("penalty > 0")
    return found.select("file_id", "row", "penalty", F.array_join("issues", "|").alias("issues"))


@query("avg_score", f"""{JUDGED_CTE} SELECT file_id, CAST(round_even(avg(score), 0) AS INTEGER) AS avg_score,
  count(*) FILTER (score < {_SCORING["review_threshold"]}) AS review_rows FROM scored GROUP BY file_id""")
def avg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refined(spark, sf_dir).scores
    return found.groupBy("file_id").agg(F.bround(F.avg("score")).cast("int").alias("avg_score"),
                                        F.count_if("review").alias("review_rows"))


_STATUS = f"CASE WHEN bad_phone THEN 'invalid' WHEN score < {_SCORING['review_threshold']} THEN 'review' ELSE 'ok' END"


@query("row_status", f"{JUDGED_CTE} SELECT file_id, row, score, {_STATUS} AS status FROM scored")
def row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refined(spark, sf_dir).scores.select("file_id", "row", "score", "status")


@query("ui_summary", f"""{JUDGED_CTE} SELECT s.*, avg_score, review_rows, invalid_phones, coalesce(g.n, 0) AS duplicate_groups,
  'insurance' AS vertical FROM ({SUMMARY_SQL}) s
  JOIN (SELECT file_id, CAST(round_even(avg(score), 0) AS INTEGER) AS avg_score,
    count(*) FILTER (score < {_SCORING["review_threshold"]}) AS review_rows, count(*) FILTER (bad_phone) AS invalid_phones
    FROM scored GROUP BY file_id) USING (file_id)
  LEFT JOIN (SELECT file_id, max("group") AS n FROM groups GROUP BY file_id) g USING (file_id)""")
def ui_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = refined(spark, sf_dir).fix_results().totals
    return totals.select("file_id", "input_rows", "output_rows", "duplicates_removed", "empty_rows_skipped", "avg_score",
                         "review_rows", "invalid_phones", "duplicate_groups", "vertical")


