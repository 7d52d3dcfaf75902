"""Cross-field rules, e-mail repair, vertical detection and scoring of numbered leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import values
from leadspark.functions.similarity import closest_with_confidence
from leadspark.operators.rows import col
from leadspark.profile import Profile

EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
VIOLATION = "struct<rule:string,fields:array<string>,message:string,penalty:int>"


def email_valid(email: Column) -> Column:
    return email.rlike(rf"(?U){EMAIL_PATTERN}")


def email_domain(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", -1))


def enabled(quality: dict, rule: str, default: bool = False) -> bool:
    return quality.get("rules", {}).get(rule, {}).get("enabled", default)


def penalty(quality: dict, rule: str, default: int = 5) -> int:
    return int(quality.get("rules", {}).get(rule, {}).get("penalty", default))


def _violation(quality: dict, rule: str, fields: list[str], message: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), F.array(*[F.lit(f) for f in fields]).alias("fields"),
                                 message.alias("message"), F.lit(penalty(quality, rule)).alias("penalty")))


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def repair_emails(leads: DataFrame, quality: dict) -> DataFrame:
    """Add ``email_fix`` (domain, suggestion, confidence, applied) and apply confident fixes to Email."""
    if not _has(leads, "Email"):
        return leads
    domains = quality.get("email_domains", [])
    suspect = email_valid(col("Email")) & ~email_domain(col("Email")).isin(domains)
    found = closest_with_confidence(F.when(suspect, email_domain(col("Email"))), domains,
                                    quality.get("email_suggest_ratio", 0.75))
    local = F.regexp_replace(F.col("email_original"), "@[^@]*$", "")
    suggested = F.concat(local, F.lit("@"), F.col("_near.entry"))
    applied = F.col("_near.ratio") >= quality.get("email_autofix_ratio", 0.85)
    fix = F.when(F.col("_near.entry").isNotNull(), F.struct(
        F.col("email_original").alias("original"), suggested.alias("suggested"),
        email_domain(F.col("email_original")).alias("domain"), F.col("_near.entry").alias("near"),
        F.col("_near.confidence").alias("confidence"), applied.alias("applied")))
    return (leads.withColumn("_near", found).withColumn("email_original", col("Email"))
            .withColumn("email_fix", fix)
            .withColumn("Email", F.when(F.col("email_fix.applied"), F.col("email_fix.suggested"))
                        .otherwise(col("Email")))
            .drop("_near"))


def email_corrections(judged: DataFrame) -> DataFrame:
    fix = F.col("email_fix")
    return judged.where(fix.isNotNull()).select(
        "file_id", "row", F.lit("Email").alias("field"), fix["original"].alias("original"),
        fix["suggested"].alias("suggested"), fix["applied"].alias("applied"), fix["confidence"].alias("confidence"))


def _email_rules(df: DataFrame, quality: dict) -> list[Column]:
    if not _has(df, "email_fix"):
        return []
    original, fix = F.col("email_original"), F.col("email_fix")
    rules = []
    if enabled(quality, "email_invalid", True):
        rules.append(_violation(quality, "email_invalid", ["Email"], F.concat(F.lit("not a valid email: "), original),
                                ~email_valid(original)))
    if enabled(quality, "email_domain_typo", True):
        rules.append(_violation(quality, "email_domain_typo", ["Email"],
                                F.concat(fix["domain"], F.lit(" looks like "), fix["near"]), fix.isNotNull()))
    return rules


def _field_rules(df: DataFrame, quality: dict, as_of: Column) -> list[Column]:
    rules, out = quality.get("rules", {}), []
    age = F.col("_age")
    shown_age = age.cast("string")
    if _has(df, "Date of Birth"):
        if enabled(quality, "dob_implausible"):
            low, high = (rules["dob_implausible"].get(k, d) for k, d in (("min_age", 16), ("max_age", 105)))
            out.append(_violation(quality, "dob_implausible", ["Date of Birth"],
                                  F.concat(F.lit("derived age "), shown_age, F.lit(f" outside {low}-{high}")),
                                  ~age.between(low, high)))
        if enabled(quality, "dob_vs_age") and _has(df, "Age"):
            stated = col("Age").try_cast("double").try_cast("bigint")
            out.append(_violation(quality, "dob_vs_age", ["Date of Birth", "Age"],
                                  F.concat(F.lit("DOB implies "), shown_age, F.lit(" but Age column says "),
                                           stated.cast("string")),
                                  F.abs(stated - age) > rules["dob_vs_age"].get("tolerance_years", 2)))
        if enabled(quality, "dob_vs_occupation") and _has(df, "Occupation"):
            setting, job = rules["dob_vs_occupation"], F.lower(col("Occupation"))
            for word, clash in (("student", age > setting.get("student_max_age", 60)),
                                ("retired", age < setting.get("retired_min_age", 40))):
                out.append(_violation(quality, "dob_vs_occupation", ["Date of Birth", "Occupation"],
                                      F.concat(F.lit(f"occupation '{word}' but derived age "), shown_age),
                                      job.contains(word) & clash))
    if enabled(quality, "name_suspicious") and _has(df, "Full Name"):
        name = col("Full Name")
        out.append(_violation(quality, "name_suspicious", ["Full Name"],
                              F.concat(F.lit("name looks malformed: "), name),
                              name.rlike(r"(?U)\d") | (F.length(F.replace(name, F.lit(" "), F.lit(""))) < 2)))
    if enabled(quality, "phone_invalid", True) and _has(df, "Phone Number"):
        out.append(_violation(quality, "phone_invalid", ["Phone Number"],
                              F.lit("phone number is not 10 digits"), ~values.phone_valid(col("Phone Number"))))
    return out


def judge(leads: DataFrame, quality: dict, as_of: Column) -> DataFrame:
    """Repair e-mails and add ``violations``, the row's rule breaches in report order. No shuffle."""
    df = repair_emails(leads, quality)
    if _has(df, "Date of Birth"):
        born = F.try_to_timestamp(F.substring(col("Date of Birth"), 1, 10), F.lit("MM/dd/yyyy")).cast("date")
        df = df.withColumn("_born", born).withColumn("_age", values.age_years(F.col("_born"), as_of))
    rules = _email_rules(df, quality) + _field_rules(df, quality, as_of)
    found = F.array_compact(F.array(*rules)) if rules else F.array().cast(f"array<{VIOLATION}>")
    by_rule = F.array_sort(found, lambda a, b: F.when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1)
                           .otherwise(0)) if rules else found
    return df.withColumn("violations", by_rule).drop("_born", "_age")


def violation_rows(judged: DataFrame) -> DataFrame:
    """One row per violation, ordered by (row, rule) through ``seq``."""
    return judged.select("file_id", "row", F.posexplode("violations").alias("seq", "v")).select(
        "file_id", "row", "seq", "v.rule", "v.fields", "v.message", "v.penalty")


def completeness(df: DataFrame, quality: dict, columns: list[str]) -> Column:
    """Weighted share of filled target columns, 0..100, halves to even."""
    weights = quality.get("scoring", {}).get("weights", {})
    used = [c for c in columns if c in weights]
    total = sum(weights[c] for c in used) or 1
    filled = reduce(lambda a, b: a + b, [F.when(col(c).isNotNull(), weights[c]).otherwise(0) for c in used], F.lit(0))
    return F.bround(filled * F.lit(100.0) / F.lit(total)).cast("int")


def score(judged: DataFrame, members: DataFrame, profile: Profile, quality: dict) -> DataFrame:
    """Completeness minus penalties per lead. ``members`` holds (file_id, row) of grouped leads."""
    use_groups = enabled(quality, "duplicate_group", True)
    grouped = members.select("file_id", "row", F.lit(use_groups).alias("_grouped"))
    extra = penalty(quality, "duplicate_group", 10)
    threshold = quality.get("scoring", {}).get("review_threshold", 70)
    own = F.aggregate("violations", F.lit(0), lambda total, v: total + v["penalty"])
    rules = F.transform("violations", lambda v: v["rule"])
    in_group = F.coalesce(F.col("_grouped"), F.lit(False))
    named = col("Full Name") if "Full Name" in judged.columns else F.lit(None).cast("string")
    narrow = judged.select("file_id", "row", named.alias("name"),
                           completeness(judged, quality, profile.columns).alias("completeness"),
                           own.alias("_own"), rules.alias("_rules"),
                           (~values.phone_valid(col("Phone Number")) if "Phone Number" in judged.columns
                            else F.lit(False)).alias("phone_invalid"))
    issues = F.when(in_group, F.array_append("_rules", F.lit("duplicate_group"))).otherwise(F.col("_rules"))
    scored = narrow.join(grouped, ["file_id", "row"], "left").select(
        "file_id", "row", "name", "completeness",
        (F.col("_own") + F.when(in_group, extra).otherwise(0)).alias("penalty"),
        F.array_sort(F.array_distinct(issues)).alias("issues"), "phone_invalid")
    value = F.greatest(F.lit(0), F.least(F.lit(100), F.col("completeness") - F.col("penalty")))
    scored = scored.withColumn("score", value).withColumn("review", F.col("score") < threshold)
    return scored.withColumn("status", F.when(F.col("phone_invalid"), "invalid").when(F.col("review"), "review")
                             .otherwise("ok")).drop("phone_invalid")


def vertical(leads: DataFrame, unmapped: DataFrame, profile: Profile, quality: dict) -> DataFrame:
    """Industry of each file: most signature headers present, at least the minimum, first listed on ties."""
    names = [c for c in profile.all_columns if c in leads.columns]
    filled = leads.groupBy("file_id").agg(*[F.bool_or(col(c).isNotNull()).alias(f"_p{i}")
                                            for i, c in enumerate(names)])
    present = F.array_compact(F.array(*[F.when(F.col(f"_p{i}"), F.lit(c.lower().strip()))
                                        for i, c in enumerate(names)]))
    seen = filled.select("file_id", present.alias("_present")).join(unmapped, "file_id", "full").select(
        "file_id", F.array_union(F.coalesce("_present", F.array().cast("array<string>")),
                                 F.transform(F.coalesce("unmapped_headers", F.array().cast("array<string>")),
                                             lambda h: values.strip(F.lower(h)))).alias("_seen"))
    signatures = quality.get("verticals", {})
    hits = F.array(*[F.struct(F.size(F.array_intersect("_seen", F.array(*[F.lit(s) for s in words]))).alias("hits"),
                              F.lit(-i).alias("rank"), F.lit(v).alias("vertical"))
                     for i, (v, words) in enumerate(signatures.items())])
    best = F.array_max(hits)
    chosen = F.when(best["hits"] >= quality.get("vertical_min_hits", 2), best["vertical"]).otherwise("general") \
        if signatures else F.lit("general")
    return seen.select("file_id", chosen.alias("vertical"))
