"""Header-less tables: recognize columns by their content and say which of them feed which target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions import dates, values
from leadspark.functions.similarity import closest
from leadspark.operators.layout import long_cells
from leadspark.operators.staging import spread

# The targets that columns can claim, by the names of the default profile.
ROLES = ("Phone Number", "Email", "ZIP Code", "Date of Birth", "Timestamp", "Autos", "Current Insurance", "Homeowner",
         "Cars Make and Model", "Full Name", "Address")
PLAN_SCHEMA = "file_id string, target string, part int, ordinal int, joined boolean, separator string"


def lead_rows(rows: DataFrame) -> DataFrame:
    """Rows with enough filled cells to be a lead."""
    return rows.where(F.size(F.filter("cells", lambda c: c.isNotNull())) >= fv.LEAD_MIN_CELLS)


def column_samples(rows: DataFrame) -> DataFrame:
    """First non-missing values of every column: ``(file_id, col, rank, text)``, limited before the shuffle."""
    present = long_cells(rows).where(~values.is_missing(F.col("text")))
    rank = F.row_number().over(Window.partitionBy("file_id", "col").orderBy("src"))
    return present.withColumn("rank", rank).where(F.col("rank") <= fv.PROFILE_SAMPLES).select(
        "file_id", "col", "rank", "text")


def predicates(text: Column, as_of: Column) -> dict[str, Column]:
    """What a cell can look like."""
    found = values.digits(text)
    is_date = text.rlike(r"[/\-]") & dates.parse_date(values.clean(text), as_of).isNotNull()
    return {
        "phone": (F.length(found) == 10) | ((F.length(found) == 11) & found.startswith("1")),
        "email": text.contains("@") & F.substring_index(text, "@", -1).contains("."),
        "zip": text.rlike(r"(?U)^\d{5}(-\d{4})?$"),
        "date": is_date,
        "digit": text.rlike(r"(?U)^\d$"),
        "home": F.lower(text).isin(fv.EXPLICIT_HOME_WORDS),
        "vehicle": text.rlike(r"(?U)^(19|20)\d{2}\s+\S"),
        "alpha": (F.length(text) <= 40) & text.rlike(r"^[A-Za-z][A-Za-z .,'\-]*$"),
        "street": text.rlike(r"(?U)^\d+\s+\S+"),
        "state": text.rlike(r"^[A-Za-z]{2}$"),
    }


def is_carrier(text: Column) -> Column:
    """Carrier name, exact or close."""
    exact = values.carrier_exact(text)
    near = closest(F.when(exact.isNull(), values.carrier_key(text)), list(values.carrier_vocabulary()),
                   fv.CARRIER_COLUMN_CUTOFF)
    return exact.isNotNull() | near.isNotNull()


def profile_columns(samples: DataFrame, as_of: Column) -> DataFrame:
    """Share of samples per predicate and the upper median year of the first samples, per file and column."""
    tests = predicates(F.col("text"), as_of)
    year = F.when(F.col("rank") <= fv.YEAR_SAMPLES, F.year(dates.parse_date(values.clean(F.col("text")), as_of)))
    judged = samples.select("file_id", "col", *[t.alias(n) for n, t in tests.items()],
                            is_carrier(F.col("text")).alias("carrier"), year.alias("year"))
    shares = [F.avg(F.col(n).cast("int")).alias(n) for n in [*tests, "carrier"]]
    years = F.sort_array(F.collect_list("year"))
    return judged.groupBy("file_id", "col").agg(*shares, years.alias("_years")).withColumn(
        "median_year", F.get("_years", F.floor(F.size("_years") / 2).cast("int"))).drop("_years")


def claim_roles(profile: DataFrame) -> DataFrame:
    """Greedy role assignment per file over its column profile (a row per column): the projection plan."""
    birth_before = fv.BIRTH_YEAR_BEFORE
    columns = [f.split(" ")[0] for f in PLAN_SCHEMA.split(", ")]

    def assign(pdf):
        import pandas as pd

        table = pdf.set_index("col").sort_index()
        free = list(table.index)
        plan = []

        def fits(test, share, among=None):
            return [c for c in (free if among is None else among) if c in free and table.at[c, test] >= share]

        def give(target, chosen, joiner=None):
            for part, c in enumerate(chosen):
                plan.append((table["file_id"].iloc[0], target, part, int(c), joiner is not None, joiner or ""))
            for c in chosen:
                free.remove(c)

        def with_neighbour(chosen, test, share):
            return chosen + fits(test, share, [chosen[-1] + 1]) if chosen else chosen

        phones = fits("phone", 0.7)
        give("Phone Number", phones[:1])
        for c in phones[1:]:
            free.remove(c)
        give("Email", fits("email", 0.5)[:1])
        give("ZIP Code", sorted(fits("zip", 0.7), key=lambda c: -table.at[c, "zip"])[:1])
        table["median_year"] = table["median_year"].fillna(fv.NO_YEAR)
        dated = sorted(fits("date", 0.7), key=lambda c: table.at[c, "median_year"])
        births = [c for c in dated if table.at[c, "median_year"] < birth_before]
        recent = [c for c in dated if c not in births]
        give("Date of Birth", births[:1])
        give("Timestamp", recent[:1])
        for c in births[1:] + recent[1:]:
            free.remove(c)
        for target, test, share in (("Autos", "digit", 0.7), ("Current Insurance", "carrier", 0.5),
                                    ("Homeowner", "home", 0.6)):
            give(target, fits(test, share)[:1])
        give("Cars Make and Model", fits("vehicle", 0.5)[:3], " / ")
        give("Full Name", with_neighbour(fits("alpha", 0.8)[:1], "alpha", 0.8), " ")
        place = fits("street", 0.6)[:1]
        place = with_neighbour(with_neighbour(place, "alpha", 0.8), "state", 0.8) if place else place
        give("Address", place, ", ")
        return pd.DataFrame(plan, columns=columns)

    return spread(profile, "file_id").groupBy("file_id").applyInPandas(assign, PLAN_SCHEMA)


def join_parts(cells: Column, ordinals: Column, separator: Column) -> Column:
    """Join the cells at ``ordinals`` that hold a value."""
    parts = F.transform(ordinals, lambda o: values.strip(F.get(cells, o)))
    return F.concat_ws("", F.transform(
        F.filter(parts, lambda p: p.isNotNull() & ~values.is_missing(p)), lambda p, i: F.concat(
            F.when(i > 0, separator).otherwise(F.lit("")), p)))
