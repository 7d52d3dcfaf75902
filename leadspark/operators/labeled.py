"""Form exports: each column is a sequence of label and value tokens, one or more leads below each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions.values import carrier_mention, literal_map
from leadspark.operators.cards import auto_count
from leadspark.operators.layout import long_cells
from leadspark.operators.ordering import running
from leadspark.operators.staging import materialize, release

FIELDS = list(dict.fromkeys(fv.LABELED_FIELDS.values()))
SEGMENT_BITS = 40  # a lead's place is (column, segment) packed into one BIGINT

VEHICLE_LABELS = ["year", "make", "model"]
PLACE = ["file_id", "lead"]


def segments(rows: DataFrame) -> DataFrame:
    """Tokens ``(file_id, lead, n, text, low, field, labels, models)``: every column cut at each contact banner.

    ``n`` is the token's number, ``labels`` and ``models`` are how many field labels and how many model labels came up to it.
    """
    marked = long_cells(rows).withColumn("low", F.lower("text"))
    marked = marked.withColumn("field", F.element_at(literal_map(fv.LABELED_FIELDS), F.col("low")))

    def times(condition: Column) -> tuple[str, Column]:
        return "sum", condition.cast("bigint")

    cut = running(marked, ["file_id", "col"], "src", {
        "segment": times(F.col("low") == fv.LABELED_BANNER), "n": times(F.lit(True)),
        "labels": times(F.col("field").isNotNull()), "models": times(F.col("low") == "model")})
    with_banner = marked.where(F.col("low") == fv.LABELED_BANNER).select("file_id", "col").distinct()
    headless = cut.where("segment = 0").join(with_banner, ["file_id", "col"], "left_anti")
    return cut.where("segment > 0").unionByName(headless.select(cut.columns)).select(
        "file_id", (F.shiftleft(F.col("col").cast("bigint"), SEGMENT_BITS) + F.col("segment")).alias("lead"),
        "n", "text", "low", "field", "labels", "models")


def label_runs(labels: DataFrame) -> DataFrame:
    """Runs of labels right behind each other whose last one has a value: ``(*PLACE, n, size, field, value, at)``.

    ``n``, ``field`` and ``value`` are those of the last label, ``at`` says for each field where the run named it last.
    """
    at = F.struct(*[F.max(F.when(F.col("field") == f, F.col("n"))).alias(f) for f in FIELDS])
    runs = labels.groupBy(*PLACE, (F.col("n") - F.col("labels")).alias("run")).agg(
        F.max("n").alias("n"), F.count("*").alias("size"), F.max_by("field", "n").alias("field"),
        F.max_by("next", "n").alias("value"), F.max_by("next_is_label", "n").alias("open"), at.alias("at"))
    return runs.where("value IS NOT NULL AND NOT open").drop("run", "open")


def walk_fields(labels: DataFrame) -> DataFrame:
    """``(*PLACE, f)``: what the walk down the contact section gives every field, as a struct of ``(n, value)``.

    The walk: a label whose field has no value yet takes the next token, which is then no label; the field has the token as its
    value unless that is a label itself. So a field gets its value at the end of a run of labels only, and there if an odd number
    of labels goes back from the end to the run's last label of a field that has a value already, or to its start. A run of one
    label gives its field a value wherever that has none, which is a minimum per field. Of the longer runs, those that
    give a value are found one per lead and round, the first ones first, until a round finds none: at most one per field. No
    list of a form's labels is gathered.
    """
    runs = materialize(label_runs(labels))

    def first_of(f: str) -> Column:
        return F.min(F.when((F.col("size") == 1) & (F.col("field") == f), F.struct("n", "value"))).alias(f)

    held, given = F.col("f"), F.col("given")
    back = F.greatest(*[F.when(held[f]["n"] < F.col("n"), F.col("at")[f]) for f in FIELDS])
    free = F.coalesce(F.col("n") - back, F.col("size")) % 2 == 1
    unseen = F.coalesce(*[F.when(F.col("field") == f, F.coalesce(held[f]["n"] > F.col("n"), F.lit(True))) for f in FIELDS])
    # ``since`` is where the last round gave a lead a value; leads that a round gave nothing get nothing later.
    known = materialize(runs.groupBy(*PLACE).agg(*[first_of(f) for f in FIELDS], F.max("size").alias("_longest")).select(
        *PLACE, F.struct(*FIELDS).alias("f"), F.when(F.col("_longest") > 1, F.lit(-1).cast("bigint")).alias("since")))
    while known.where("since IS NOT NULL").limit(1).count():
        open_leads = known.where("since IS NOT NULL")
        gives = runs.where("size > 1").join(open_leads, PLACE).where((F.col("n") > F.col("since")) & unseen & free)
        first = gives.groupBy(*PLACE).agg(F.min(F.struct("n", "field", "value")).alias("given"))
        mine = F.struct(given["n"].alias("n"), given["value"].alias("value"))
        before, known = known, materialize(known.join(first, PLACE, "left").select(*PLACE, F.struct(*[
            F.when(given["field"] == f, mine).otherwise(held[f]).alias(f) for f in FIELDS]).alias("f"), given["n"].alias("since")))
        release(before)
    return known.drop("since")


def walk_vehicles(labels: DataFrame) -> DataFrame:
    """``(*PLACE, vehicles)``: the first Year / Make / Model runs anywhere in the lead, each closed by its model; a make is needed."""
    def last(label: str) -> Column:
        return F.max_by(F.when(F.col("low") == label, F.col("next")), F.when((F.col("low") == label) & F.col("next").isNotNull(), F.col("n")))

    # Model labels are counted up to and with their own row, so one closes the stretch that the count before it opened.
    stretch = F.col("models") - (F.col("low") == "model").cast("bigint")
    closed = labels.where(F.col("low").isin(VEHICLE_LABELS)).groupBy(*PLACE, stretch.alias("stretch")).agg(
        *[last(label).alias(label) for label in VEHICLE_LABELS])
    good = closed.where(F.col("make").isNotNull() & (F.lower("model") != "model"))
    words = F.filter(F.array(*VEHICLE_LABELS), lambda w: w.isNotNull() & ~F.lower(w).isin("year", "make"))
    order = Window.partitionBy(*PLACE).orderBy("stretch")
    named = good.select(*PLACE, "stretch", F.array_join(words, " ").alias("vehicle"), F.row_number().over(order).alias("_rank"))
    listed = named.where(F.col("_rank") <= fv.MAX_VEHICLES).groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("stretch", "vehicle"))).alias("v"))
    return listed.select(*PLACE, F.col("v.vehicle").alias("vehicles"))


def labeled_leads(rows: DataFrame) -> DataFrame:
    """``(file_id, src, <card columns>)`` of labeled-column sheets.

    The walk depends on order, but only on label tokens and what follows each: the follower is joined by
    token number. One form may be a whole file: its tokens are grouped by run and by vehicle, never gathered.
    """
    tokens = materialize(segments(rows))
    following = tokens.select(*PLACE, (F.col("n") - 1).alias("n"), F.col("text").alias("next"),
                              F.col("field").isNotNull().alias("next_is_label"))
    # Never broadcast: the followers are as many as the tokens, however small their file is.
    labels = materialize(tokens.where(F.col("field").isNotNull() | F.col("low").isin(VEHICLE_LABELS))
                         .join(following.hint("merge"), [*PLACE, "n"], "left"))
    ends = tokens.where(F.col("low") == fv.LABELED_BOUNDARY).groupBy(*PLACE).agg(F.min("n").alias("end"))
    mentions = tokens.select(*PLACE, "n", carrier_mention(F.col("text")).alias("mention")).where("mention IS NOT NULL")
    carriers = mentions.join(ends, PLACE).where("n >= end").groupBy(*PLACE).agg(F.min_by("mention", "n").alias("carrier"))
    # The token behind a section's last label is its end.
    section = labels.where("field IS NOT NULL").join(ends, PLACE, "left").where("end IS NULL OR n + 1 < end")
    walked = walk_fields(section).join(walk_vehicles(labels), PLACE, "left").join(carriers, PLACE, "left").select(
        "file_id", F.col("lead").alias("src"), F.struct(*[F.col(f"f.{f}.value").alias(f) for f in FIELDS]).alias("f"),
        F.coalesce("vehicles", F.array().cast("array<string>")).alias("vehicles"), "carrier")

    def joined(names: list[str], separator: str) -> Column:
        return F.concat_ws(separator, *[F.col(f"f.{n}") for n in names])

    none = F.lit(None).cast("string")
    return walked.where(joined(["first", "last"], " ") != "").select(
        "file_id", "src", joined(["first", "last"], " ").alias("Full Name"), F.col("f.email").alias("Email"),
        F.col("f.dob").alias("Date of Birth"), F.col("f.phone").alias("Phone Number"),
        joined(["address", "city", "state"], ", ").alias("Address"), F.col("f.zip").alias("ZIP Code"),
        none.alias("Homeowner"), auto_count(none, F.col("vehicles")).alias("Autos"),
        F.col("carrier").alias("Current Insurance"), F.array_join("vehicles", " / ").alias("Cars Make and Model"))
