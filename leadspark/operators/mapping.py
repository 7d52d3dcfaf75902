"""Header mapping: which input columns feed which target column.

Input is a header table ``(file_id, ordinal, header)``, one row per column of each file, so millions of
files are mapped by the same few joins and windows as one file, which run over the different header lists only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions.similarity import closest
from leadspark.functions.values import literal_map
from leadspark.operators.staging import materialize
from leadspark.profile import Profile


def header_key(header: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(header), "[^a-z0-9]+", " "))


def exact_target(key: Column, profile: Profile) -> Column:
    return F.element_at(literal_map(profile.aliases), key)


def is_drop_name(key: Column, profile: Profile) -> Column:
    return key.isin(profile.drop_names) if profile.drop_names else F.lit(False)


def name_headers(headers: DataFrame) -> DataFrame:
    """Name blank headers ``column_j`` and number repeats ``h.1``, ``h.2``, … per file."""
    named = headers.withColumn("header", F.coalesce("header", F.concat(F.lit("column_"), F.col("ordinal").cast("string"))))
    earlier = F.row_number().over(Window.partitionBy("file_id", "header").orderBy("ordinal")) - 1
    return named.withColumn("_n", earlier).withColumn(
        "header", F.when(F.col("_n") > 0, F.concat("header", F.lit("."), F.col("_n").cast("string")))
        .otherwise(F.col("header"))).drop("_n")


def classify_headers(headers: DataFrame, profile: Profile, fuzzy: bool = True) -> DataFrame:
    """Add ``key``, ``status`` (dropped | mapped | unmapped | composed), ``target`` and ``part``.

    Files of one export share their header list: lists are worked out once each, under their signature, and handed to all their files.
    """
    listed = headers.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "header"))).alias("list"))
    signed = materialize(listed.withColumn("signature", F.sha2(F.to_json("list"), 256)))
    found = classify_lists(distinct_lists(signed), profile, fuzzy).withColumnRenamed("file_id", "signature")
    return signed.select("file_id", "signature").join(found, "signature").drop("signature")


def distinct_lists(signed: DataFrame) -> DataFrame:
    """``(file_id, ordinal, header)`` of each different header list, its signature in the place of a file."""
    lists = signed.groupBy("signature").agg(F.first("list").alias("list"))
    return lists.select(F.col("signature").alias("file_id"), F.inline("list"))


def classify_lists(headers: DataFrame, profile: Profile, fuzzy: bool = True) -> DataFrame:
    """``classify_headers`` of header lists that are worked out one by one."""
    keyed = headers.withColumn("key", header_key(F.col("header")))
    exact = exact_target(F.col("key"), profile)
    drop = is_drop_name(F.col("key"), profile)
    if fuzzy:
        open_key = F.when(~drop, F.col("key"))
        near_drop = closest(open_key, profile.drop_names, fv.DROP_CUTOFF) if profile.drop_names else F.lit(None)
        near_alias = closest(F.when(~drop & exact.isNull(), F.col("key")), list(profile.aliases), fv.ALIAS_CUTOFF)
        candidate = F.coalesce(exact, F.element_at(literal_map(profile.aliases), near_alias))
        drop = drop | near_drop.isNotNull()
    else:
        candidate = exact
    judged = keyed.select("*", drop.alias("_drop"), candidate.alias("_candidate")).withColumn(
        "_target", F.when(~F.col("_drop"), F.col("_candidate")))
    # the leftmost header wins a target; later ones stay unmapped
    first = F.row_number().over(Window.partitionBy("file_id", "_target").orderBy("ordinal")) == 1
    claimed = judged.withColumn("status", F.when(F.col("_drop"), "dropped")
                                .when(F.col("_target").isNotNull() & first, "mapped").otherwise("unmapped"))
    claimed = claimed.withColumn("target", F.when(F.col("status") == "mapped", F.col("_target")))
    result = claimed.withColumn("part", F.when(F.col("status") == "mapped", F.lit(0)))
    for target, parts in profile.compose.items():
        result = _compose(result, target, parts)
    return result.select("file_id", "ordinal", "header", "key", "status", "target", "part")


def _compose(claimed: DataFrame, target: str, parts: list[list[str]]) -> DataFrame:
    """Build an unclaimed target from two or more parts found among the unmapped headers."""
    table = {}
    for n, names in enumerate(parts):
        for alias in names:
            table.setdefault(alias, n)
    lookup = literal_map({a: str(n) for a, n in table.items()})
    whole = Window.partitionBy("file_id")
    part = F.when(F.col("status") == "unmapped", F.element_at(lookup, F.col("key")).cast("int"))
    taken = F.max(F.when(F.col("target") == target, 1).otherwise(0)).over(whole)
    first = F.row_number().over(Window.partitionBy("file_id", "_part").orderBy("ordinal")) == 1
    found = F.size(F.collect_set("_part").over(whole))
    use = F.col("_part").isNotNull() & F.col("_first") & (F.col("_found") >= 2) & (F.col("_taken") == 0)
    return (claimed.withColumn("_part", part)
            .withColumns({"_taken": taken, "_first": first, "_found": found})
            .withColumns({"status": F.when(use, "composed").otherwise(F.col("status")),
                          "target": F.when(use, F.lit(target)).otherwise(F.col("target")),
                          "part": F.when(use, F.col("_part")).otherwise(F.col("part"))})
            .drop("_part", "_taken", "_first", "_found"))


def header_report(classified: DataFrame) -> DataFrame:
    """Dropped and unmapped header lists per file, in column order."""
    def listed(status: str) -> Column:
        rows = F.collect_list(F.when(F.col("status") == status, F.struct("ordinal", "header")))
        return F.transform(F.sort_array(rows), lambda r: r["header"])

    return classified.groupBy("file_id").agg(listed("dropped").alias("dropped_headers"),
                                             listed("unmapped").alias("unmapped_headers"))
