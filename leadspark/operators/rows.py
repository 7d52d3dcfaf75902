"""Row operators: drop empty rows, drop exact duplicates, sort, number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.operators.ordering import number_rows, number_sorted


def col(name: str) -> Column:
    """A column whose name may hold spaces or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def any_present(columns: list[str]) -> Column:
    """At least one of the columns holds a value."""
    return reduce(lambda a, b: a | b, [col(c).isNotNull() for c in columns])


def mark_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``duplicate``: an earlier row of the same file agrees on every key (case folded).

    A NULL key never matches. The earliest position per key is a map-side combined minimum over the key
    columns alone; only keys that repeat are joined back, so a key held by a large share of the
    rows costs one row on the build side and its probe side may be split.
    """
    if not keys:
        return df.withColumn("duplicate", F.lit(False))
    folded = [F.trim(F.lower(col(k))).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    repeated = (df.select("file_id", "src", *folded).dropna(subset=names)
                .groupBy("file_id", *names).agg(F.min("src").alias("_first"), F.count("*").alias("_n"))
                .where("_n > 1").drop("_n"))
    marked = df.select("*", *folded).join(repeated, ["file_id", *names], "left")
    return marked.select(*[col(c) for c in df.columns],
                         F.coalesce(F.col("src") > F.col("_first"), F.lit(False)).alias("duplicate"))


def sort_keys(sort_by: list[str], types: dict[str, str]) -> list[Column]:
    """Dates by time with missing last, texts by code point with missing as its printed form."""
    def key(name: str) -> Column:
        if types.get(name) in ("date", "datetime"):
            shown = F.concat(col(name), F.when(F.length(col(name)) == 10, F.lit(" 00:00")).otherwise(F.lit("")))
            return F.try_to_timestamp(shown, F.lit("MM/dd/yyyy HH:mm")).asc_nulls_last()
        return F.coalesce(col(name), F.lit(fv.NA_TEXT)).asc()

    return [key(n) for n in sort_by]


def number_leads(df: DataFrame, sort_by: list[str], types: dict[str, str]) -> DataFrame:
    """Final 1-based ``row`` per file: input order, or the profile's sort order."""
    known = [c for c in sort_by if c in df.columns]
    if not known:
        return number_rows(df, ["file_id"], "src", "row")
    return number_sorted(df, ["file_id"], sort_keys(known, types), "src", "row")
