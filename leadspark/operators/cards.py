"""Field extraction from label cards: every cell is classified on its own, first value per field wins.

Input is ``(file_id, lead, ord, text)``, one row per non-empty cell or line. Scalar fields are ordered
minimums (combined map-side); the short lists (vehicles, address parts) are ranked first, so a lead never
gathers more than a handful of cells however long its card is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions.binding import let
from leadspark.functions.values import SPACE, carrier_mention, digits, strip
from leadspark.operators.staging import materialize

FLAGS = "(?idU)"
CARD_COLUMNS = ["Full Name", "Email", "Date of Birth", "Phone Number", "Address", "ZIP Code", "Homeowner", "Autos",
                "Current Insurance", "Cars Make and Model"]


def trim_of(value: Column, characters: str) -> Column:
    return F.regexp_replace(value, f"^[{characters}]+|[{characters}]+$", "")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def tail(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, FLAGS + pattern, group)


def filled(value: Column) -> Column:
    return let(value, lambda v: F.when(v != "", v))


def home_phrase(text: Column) -> Column:
    """Owner or Rented when the cell is an ownership phrase, else NULL."""
    def judge(low: Column) -> Column:
        refused = F.regexp_extract(low, FLAGS + fv.CARD_OWN_PHRASE, 2).rlike(r"(?U)^no\b")
        return (F.when(matches(low, fv.CARD_RENT_PHRASE), "Rented")
                .when(matches(low, fv.CARD_OWN_PHRASE), F.when(refused, "Rented").otherwise("Owner"))
                .when(matches(low, fv.CARD_SINGLE_FAMILY), "Owner"))

    return let(strip(F.regexp_replace(F.lower(strip(text)), "^[:= ]+", "")), judge)


def clean_insurance(text: Column) -> Column:
    """Insurance free text without filler words, durations, numbers and punctuation."""
    for pattern in (r"(?iU)\b(insurance|ins|inc)\b\.?", r"(?iU)\b(for|more\s+than|more\s+thena)\b",
                    r"(?iU)\d+\s*(years?|yrs?|yr|yers|months?)\b\.?", r"(?U)\b\d+\b", r"[/:=.,]+"):
        text = F.regexp_replace(text, pattern, " ")
    return strip(text)


def is_vehicle(text: Column) -> Column:
    """A make and a year somewhere in the text."""
    return text.rlike("(?iU)" + fv.VEHICLE_MAKES) & text.rlike("(?U)" + fv.CARD_YEAR)


def _cut_at_carrier(text: Column) -> Column:
    """Text before the mention of the first carrier pattern that occurs."""
    chain = None
    for pattern, _ in fv.CARRIER_MENTIONS:
        head = trim_of(F.regexp_extract(text, f"(?isU)^(.*?)(?:{pattern})", 1), " ,/")
        hit = text.rlike(f"(?iU){pattern}")
        chain = F.when(hit, head) if chain is None else chain.when(hit, head)
    return chain.otherwise(text)


def vehicle_label_removed(text: Column) -> Column:
    return strip(F.regexp_replace(text, FLAGS + fv.CARD_VEHICLE_LABEL, ""))


def vehicle_text(unlabeled: Column) -> Column:
    """Vehicle description: cut at a carrier mention, first line, single spaces."""
    bare = trim_of(F.regexp_replace(let(unlabeled, _cut_at_carrier), r"(?iU)\binsurance\b\s*:?\s*$", ""), " ,/")
    line = F.substring_index(bare, "\n", 1)
    return F.trim(F.regexp_replace(line, f"(?U){SPACE}+", " "))


def classify_cells(cells: DataFrame) -> DataFrame:
    """Add ``kind`` (what the cell is) and ``value`` (NULL when it yields nothing)."""
    t = F.col("text")
    number = digits(tail(t, fv.CARD_PHONE))
    steps: list[tuple[str, Column, Column]] = [
        ("email", matches(t, fv.CARD_EMAIL), F.when(tail(t, fv.CARD_EMAIL).contains("@"), strip(tail(t, fv.CARD_EMAIL)))),
        ("skip", matches(t, fv.CARD_SKIP), F.lit(None).cast("string")),
        ("name", matches(t, fv.CARD_NAME), filled(trim_of(tail(t, fv.CARD_NAME), " :=,"))),
        ("birth", matches(t, fv.CARD_DOB),
         filled(F.regexp_replace(F.replace(tail(t, fv.CARD_DOB), F.lit(";"), F.lit("/")), f"(?U){SPACE}+", ""))),
        ("phone", matches(t, fv.CARD_PHONE), filled(number)),
        ("address", matches(t, fv.CARD_ADDRESS),
         F.when(trim_of(tail(t, fv.CARD_ADDRESS), " :=,") != "", trim_of(tail(t, fv.CARD_ADDRESS), " ,"))),
        ("city", matches(t, fv.CARD_CITY), filled(trim_of(tail(t, fv.CARD_CITY), " :=,"))),
        ("state", matches(t, fv.CARD_STATE), filled(trim_of(tail(t, fv.CARD_STATE), " :=,"))),
        ("zip", matches(t, fv.CARD_ZIP), filled(F.regexp_extract(tail(t, fv.CARD_ZIP), r"(?U)(\d{5})", 1))),
        ("home", home_phrase(t).isNotNull(), home_phrase(t)),
        ("autos", matches(t, fv.CARD_AUTOS),
         F.coalesce(filled(tail(t, fv.CARD_AUTOS, 1)), tail(t, fv.CARD_AUTOS, 2))),
        ("vehicle", is_vehicle(t), vehicle_label_removed(t)),
        ("carrier", carrier_mention(t).isNotNull(), carrier_mention(t)),
        ("carrier", matches(t, fv.CARD_INSURANCE), filled(clean_insurance(tail(t, fv.CARD_INSURANCE)))),
        ("state", matches(trim_of(t, " ,"), fv.CARD_GEORGIA), F.lit("GA")),
        ("address_zip", t.rlike("(?U)" + fv.CARD_GEORGIA_ZIP) & t.rlike("[A-Za-z]"), trim_of(t, " ,")),
        ("address", t.rlike("(?U)" + fv.CARD_STREET), trim_of(t, " ,")),
    ]
    found = F.when(steps[0][1], F.struct(F.lit(steps[0][0]).alias("kind"), steps[0][2].alias("value")))
    for kind, test, value in steps[1:]:
        found = found.when(test, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    return cells.withColumn("_f", found).select("*", F.col("_f.kind").alias("kind"),
                                                F.col("_f.value").alias("value")).drop("_f")


def _short_lists(found: DataFrame) -> DataFrame:
    """First vehicles and address parts of each lead."""
    group = F.when(F.col("kind") == "vehicle", "vehicle").otherwise("address")
    part = F.when(F.col("kind") == "vehicle", vehicle_text(F.col("value"))).otherwise(F.col("value"))
    rows = found.where("kind IN ('vehicle', 'address', 'address_zip')").select(
        "file_id", "lead", "ord", group.alias("group"), part.alias("part")).where("part != ''")

    def first(name: str, limit: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("file_id", "lead", "group").orderBy("ord"))
        return rows.where(F.col("group") == name).withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")

    kept = first("vehicle", fv.MAX_VEHICLES).unionByName(first("address", fv.MAX_ADDRESS_PARTS))

    def listed(name: str) -> Column:
        parts = F.collect_list(F.when(F.col("group") == name, F.struct("ord", "part")))
        return F.transform(F.sort_array(parts), lambda p: p["part"])

    return kept.groupBy("file_id", "lead").agg(listed("vehicle").alias("vehicles"), listed("address").alias("parts"))


def _with_state(parts: Column, city: Column, state: Column) -> Column:
    """Append the city unless some part contains it, then the state unless some part has it as a word."""
    def add_city(p: Column) -> Column:
        there = F.exists(p, lambda x: F.contains(F.lower(x), F.lower(city)))
        return F.when(city.isNotNull() & ~there, F.array_append(p, city)).otherwise(p)

    def add_state(p: Column) -> Column:
        word = F.concat(F.lit(r"(?iU)\b\Q"), state, F.lit(r"\E\b"))
        there = F.exists(p, lambda x: F.regexp_like(x, word))
        return F.when(state.isNotNull() & ~there, F.array_append(p, state)).otherwise(p)

    return let(let(parts, add_city), add_state)


def extract_leads(cells: DataFrame) -> DataFrame:
    """``(file_id, src, <card columns>)``, one row per card that has a name; ``src`` is the lead's place."""
    # the lists and every scalar read the classified cells, so classify once
    found = materialize(classify_cells(cells).where("value IS NOT NULL"))

    def first(kind_test: Column, value: Column) -> Column:
        return F.min_by(value, F.when(kind_test & value.isNotNull(), F.col("ord")))

    kind, value = F.col("kind"), F.col("value")
    georgia = F.regexp_extract(F.col("text"), "(?U)" + fv.CARD_GEORGIA_ZIP, 1)
    part_zip = filled(F.regexp_extract(value, "(?U)" + fv.CARD_GEORGIA_ZIP, 1))
    carrier = F.when(kind == "vehicle", carrier_mention(value)).when(kind == "carrier", value)
    zip_value = F.when(kind == "address_zip", georgia).when(kind == "zip", value)
    scalars = found.groupBy("file_id", "lead").agg(
        first(kind == "name", value).alias("name"), first(kind == "email", value).alias("email"),
        first(kind == "birth", value).alias("birth"), first(kind == "phone", value).alias("phone"),
        first(kind == "city", value).alias("city"), first(kind == "state", value).alias("state"),
        first(kind.isin("zip", "address_zip"), zip_value).alias("zip"),
        first(kind.isin("address", "address_zip"), part_zip).alias("part_zip"),
        first(kind == "home", value).alias("home"), first(kind == "autos", value).alias("autos"),
        first(kind.isin("vehicle", "carrier"), carrier).alias("carrier")).where("name IS NOT NULL")
    nothing = F.array().cast("array<string>")
    leads = scalars.join(_short_lists(found), ["file_id", "lead"], "left").withColumns({
        "vehicles": F.coalesce("vehicles", nothing), "parts": F.coalesce("parts", nothing),
        "state": F.when(F.lower("state").isin("ga", "georgia", "ga."), "GA").otherwise(F.col("state"))})
    address = F.filter(F.transform(_with_state(F.col("parts"), F.col("city"), F.col("state")),
                                   lambda p: trim_of(p, " ,")), lambda p: p != "")
    return leads.select(
        "file_id", F.col("lead").alias("src"), F.col("name").alias("Full Name"), F.col("email").alias("Email"),
        F.col("birth").alias("Date of Birth"), F.col("phone").alias("Phone Number"),
        F.array_join(address, ", ").alias("Address"), F.coalesce("zip", "part_zip").alias("ZIP Code"),
        F.col("home").alias("Homeowner"), auto_count(F.col("autos"), F.col("vehicles")).alias("Autos"),
        F.col("carrier").alias("Current Insurance"), F.array_join("vehicles", " / ").alias("Cars Make and Model"))


def auto_count(stated: Column, vehicles: Column) -> Column:
    """The stated count, else the number of vehicles found, else NULL."""
    return F.coalesce(stated, F.when(F.size(vehicles) > 0, F.size(vehicles).cast("string")))
