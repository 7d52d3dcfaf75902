"""Form exports: the walk over labels against a plain walk, token by token."""

import random

from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.operators.labeled import FIELDS, labeled_leads, segments, walk_fields

WORDS = ["First Name", "Last Name", "Phone", "Primary Phone", "Email", "City", "ZipCode", "Drivers", "Year", "Make", "Model",
         "Ann", "Testlast", "4045550100", "a@b.test", "2020", "Honda", "Accord", "Geico"]


def _walk(tokens):
    """Fields, vehicles and the first name for one lead's tokens, one after the other."""
    fields, taken = {}, -1
    low = [t.lower() for t in tokens]
    end = low.index(fv.LABELED_BOUNDARY) if fv.LABELED_BOUNDARY in low else len(tokens)
    for i in range(end - 1):
        field = fv.LABELED_FIELDS.get(low[i])
        if field is None or i == taken or field in fields:
            continue
        taken = i + 1
        if low[i + 1] not in fv.LABELED_FIELDS:
            fields[field] = tokens[i + 1]
    year = make = None
    vehicles = []
    for i in range(len(tokens) - 1):
        if low[i] == "year":
            year = tokens[i + 1]
        elif low[i] == "make":
            make = tokens[i + 1]
        elif low[i] == "model":
            if make is not None and low[i + 1] != "model" and len(vehicles) < fv.MAX_VEHICLES:
                vehicles.append(" ".join(w for w in (year, make, tokens[i + 1]) if w is not None and w.lower() not in ("year", "make")))
            year = make = None
    return fields, vehicles


def _rows(spark, columns):
    """Columns of tokens as the rows of one sheet."""
    data = [("f", i, [c[i] if i < len(c) else None for c in columns]) for i in range(max(map(len, columns)))]
    return spark.createDataFrame(data, "file_id string, src bigint, cells array<string>")


def test_random_forms_equal_the_plain_walk(spark):
    rng = random.Random(3)
    leads = [[rng.choice(WORDS[:rng.choice([8, 19])] + WORDS[11:13]) for _ in range(rng.randint(1, 40))] for _ in range(700)]
    columns = [["Contact Details"] + [t for k, lead in enumerate(leads[c::8]) for t in (["Contact Details"] if k else []) + lead] for c in range(8)]
    want = []
    for lead in leads:
        fields, vehicles = _walk(["Contact Details", *lead])
        name = " ".join(fields[f] for f in ("first", "last") if f in fields)
        if name:
            want.append((name, fields.get("phone"), fields.get("email"), fields.get("city"), fields.get("zip"), " / ".join(vehicles)))
    got = [(r["Full Name"], r["Phone Number"], r["Email"], r["Address"] or None, r["ZIP Code"], r["Cars Make and Model"])
           for r in labeled_leads(_rows(spark, columns)).collect()]
    assert len(want) > 100 and sorted(got, key=str) == sorted(want, key=str)


def test_one_form_of_a_whole_file(spark):
    """200,000 tokens of one lead: labels in pairs all the way down, read without gathering them."""
    n = 200_000
    word = F.element_at(F.array(*[F.lit(w) for w in ("Phone", "Email", "x", "City")]), (F.col("id") % 4 + 1).cast("int"))
    text = F.when(F.col("id") == n - 5, "x").when(F.col("id") == n - 4, "First Name").when(F.col("id") == n - 3, "Ann").when(F.col("id") >= n - 2, "end").otherwise(word)
    rows = spark.range(n).select(F.lit("f").alias("file_id"), F.col("id").alias("src"), F.array(text).alias("cells"))
    lead = labeled_leads(rows).collect()[0]
    # City takes Phone from the second run on, so that Email takes x.
    assert (lead["Full Name"], lead["Email"], lead["Phone Number"], lead["Address"]) == ("Ann", "x", None, "")


def test_no_labels(spark):
    assert labeled_leads(_rows(spark, [["Contact Details", "x", "y"], [None]])).count() == 0
    tokens = segments(_rows(spark, [["x"]])).withColumns({"next": F.lit("y"), "next_is_label": F.lit(False)})
    assert walk_fields(tokens.where("field IS NOT NULL")).count() == 0 and len(FIELDS) == 9
