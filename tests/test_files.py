"""Files end to end: layouts, encodings, delimiters, header mapping, row removal."""

import csv
import io
import os
import random
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from leadspark.plans.files import organize_files
from leadspark.profile import load_profile
from leadspark.sources.intake import Intake, list_files, ragged_rows, read_lines

TARGETS = load_profile().columns
CARD = """Live Call Transfer :
Name: {name}
DOB: {dob}
Number: 404555{n}
Email: {email}
Address: {n} Fake St
City: Testville
State: GA
Zip Code: 3{n}
Information:
0 Accident
{home}
1 CAR
{car}
Insurance: {ins}
Lead Source: web
______________
"""
PEOPLE = [
    dict(name="ADA TESTCARD", dob="01/02/1960", n="0301", email="ada@x.com", home="homeowner: YES", car="2015 Toyota Camry", ins="prograssive"),
    dict(name="Ben Testcard", dob="3;4/1971", n="0302", email="NA", home="Renter", car="CAR: 2012 honda civic Insurance: geico", ins="ACME for 2 years"),
    dict(name=": Cy Testcard", dob="05 /06/1982", n="0303", email="no", home="Home Owner: no", car="2018 Ford F150", ins="STATEFARM 1 year"),
    dict(name="Di Testcard", dob="07/08/1990", n="0304", email="di@x.com", home="single family home", car="no car", ins=""),
]


def _labeled():
    def lead(first, last, n, **extra):
        out = ["Contact Details", "First Name", first, "Last Name", last, "Primary Phone", f"404555{n}", "Email", f"{first}@x.com",
               "Address", f"{n} Fake St", "City", "Testville", "State", "GA", "ZipCode", f"3{n}", "Date of Birth", "01/02/1970", "Drivers"]
        return out + extra.get("tail", [])
    columns = [
        lead("Al", "Testone", "0101", tail=["First Name", "Noise", "Year", "2020", "Make", "Honda", "Model", "Accord", "State Farm Ins."])
        + lead("Bo", "Testtwo", "0102", tail=["Year", "1999", "Model", "Orphan"]),
        lead("Cy", "Testthree", "0103", tail=["Make", "Ford", "Model", "Model", "GEICO"]), lead("Di", "Testfour", "0104"),
        [t for t in lead("Ed", "Testfive", "0105") if t != "Ed@x.com"],
    ]
    return "\n".join(",".join(r) for r in zip_longest(*columns, fillvalue=""))


def _grid():
    cards = [[line for line in CARD.format(**p).splitlines()[1:-1]] for p in PEOPLE] + [[], ["Name: Eve Testcard", "DOB: 9/9/1950", "rent"]]
    banner = ["Live Call Transfer"] * 3
    rows = [banner, *zip_longest(*cards[:3], fillvalue=""), ["", "", ""], banner, *zip_longest(*cards[3:], fillvalue="")]
    return "\n".join(",".join(r) for r in rows)


FILES = {
    "aliases.csv": "Created At,Lead Name,Birthdate,Home Address,Cell Phone,Postal Code,Own or Rent,Number of Autos,Insurance Company,Vehicle Details\n"
                   '01/05/2026,ALI TEST,02/03/1980,"9 Fake St, Testville",4045550400,30301,own,2,geico,2020 Kia Rio\n',
    "junk.csv": "LEADS,,,,\n,,,,\nTimestamp,Full Name,Phone,Email,Agent Name\n01/05/2026,MIX TEST,4045550470,m@gmail.com,Zed\n,,,,\n"
                "note to self,,,,\n01/06/2026,Two Test,55,,\n01/06/2026,two  TEST,55,,\n",
    "order.csv": "Phone,Zip,Full Name,Timestamp\n4045550151,2116,Zoe Test,03/01/2026\n4045550152,,Bob Test,01/01/2026\n",
    "split.csv": "Created,First Name,Last Name,DOB,Phone,Street,City,State,ZIP\n2026-01-05 10:30,ETHAN,TEST,06/12/1990,4045550500,8 Oak St,n/a,CO,80633\n",
    "headerless.csv": ",legend,,,,,,,,,,\n" + "".join(
        f"{a},{b},{d},NA,{p},{p},{s},Testville,CO,8{i}123,{c}\n" for i, (a, b, d, p, s, c) in enumerate([
            ("Jo", "Testa", "1/14/1997", "3035550201", "80 W Fake Dr", "ROOT INSURANCE"),
            ("Al", "Testb", "2/4/1952", "3035550202", "42 Fake St", "State Farm"),
            ("MO", "TESTC", "12/19/1983", "3035550203", "71 Fake Way", "Progresive")])),
    "linear.txt": "INTRO LINE\n\n" + "\n".join(CARD.format(**p) for p in PEOPLE),
    "grid.csv": _grid(),
    "labeled.csv": _labeled(),
    "tabs.tsv": "Timestamp\tFull Name\tPhone\n01/05/2026\tTab Test\t4045550530\n",
    "semi.csv": "Timestamp;Full Name;Phone\n01/05/2026;Semi Test;4045550531\n",
    "pipe.csv": "Timestamp|Full Name|Phone\n01/05/2026|Pipe Test|4045550532\n",
    "quoted.csv": 'Timestamp,Full Name,Phone,Address\n01/05/2026,"Mul ""Q"" Test",4045550101,"1 A St\nUnit 2, Rome"\n\n01/06/2026,Next Test,4045550102,5" x\n',
    "open.csv": 'Timestamp,Full Name,Phone\n01/05/2026,"Open,4045550101\n01/06/2026,Next,4045550102\n',
    "empty.csv": "",
    "notes.txt": "remember\n",
}
BYTES = {"latin.csv": b"Timestamp,Full Name,Phone\n01/05/2026,Ren\xe9 O\x92Test,4045550540\n",
         "bom.csv": "﻿Timestamp,Full Name,Phone\n01/05/2026,Bom Test,4045550541\n".encode(),
         "book.csv": b"PK\x03\x04\x00rest"}


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("drop box")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    for name, data in BYTES.items():
        (folder / name).write_bytes(data)
    organized, intake = organize_files(spark, str(folder), as_of="2026-07-01")
    base = F.regexp_extract("file_id", "([^/]+)$", 1)
    leads, facts = {}, {}
    for r in organized.organized.withColumn("file_id", base).orderBy("file_id", "row").collect():
        leads.setdefault(r.file_id, []).append([r[c] for c in TARGETS])
    for r in organized.summary.withColumn("file_id", base).collect():
        facts[r.file_id] = r
    return leads, facts, intake, organized, str(folder)


STAMP = "07/01/2026"
EXPECTED = {
    "aliases.csv": [["01/05/2026", "Ali Test", "02/03/1980", "9 Fake St, Testville", "(404) 555-0400", "30301", "Owner", "2", "GEICO", "2020 Kia Rio"]],
    "junk.csv": [["01/05/2026", "Mix Test", "NA", "NA", "(404) 555-0470", "NA", "NA", "NA", "NA", "NA"],
                 ["01/06/2026", "Two Test", "NA", "NA", "55", "NA", "NA", "NA", "NA", "NA"]],
    "order.csv": [["03/01/2026", "Zoe Test", "NA", "NA", "(404) 555-0151", "02116", "NA", "NA", "NA", "NA"],
                  ["01/01/2026", "Bob Test", "NA", "NA", "(404) 555-0152", "NA", "NA", "NA", "NA", "NA"]],
    "split.csv": [["01/05/2026 10:30", "Ethan Test", "06/12/1990", "8 Oak St, CO", "(404) 555-0500", "80633", "NA", "NA", "NA", "NA"]],
    "headerless.csv": [
        [STAMP, "Jo Testa", "01/14/1997", "80 W Fake Dr, Testville, CO", "(303) 555-0201", "80123", "NA", "NA", "Root Insurance", "NA"],
        [STAMP, "Al Testb", "02/04/1952", "42 Fake St, Testville, CO", "(303) 555-0202", "81123", "NA", "NA", "State Farm", "NA"],
        [STAMP, "Mo Testc", "12/19/1983", "71 Fake Way, Testville, CO", "(303) 555-0203", "82123", "NA", "NA", "Progressive", "NA"]],
    "labeled.csv": [
        [STAMP, "Al Testone", "01/02/1970", "0101 Fake St, Testville, GA", "(404) 555-0101", "30101", "NA", "1", "State Farm", "2020 Honda Accord"],
        [STAMP, "Bo Testtwo", "01/02/1970", "0102 Fake St, Testville, GA", "(404) 555-0102", "30102", "NA", "NA", "NA", "NA"],
        [STAMP, "Cy Testthree", "01/02/1970", "0103 Fake St, Testville, GA", "(404) 555-0103", "30103", "NA", "NA", "GEICO", "NA"],
        [STAMP, "Di Testfour", "01/02/1970", "0104 Fake St, Testville, GA", "(404) 555-0104", "30104", "NA", "NA", "NA", "NA"],
        # an empty e-mail makes the next label its value: the address is lost
        [STAMP, "Ed Testfive", "01/02/1970", "Testville, GA", "(404) 555-0105", "30105", "NA", "NA", "NA", "NA"]],
    "tabs.tsv": [["01/05/2026", "Tab Test", "NA", "NA", "(404) 555-0530", "NA", "NA", "NA", "NA", "NA"]],
    "semi.csv": [["01/05/2026", "Semi Test", "NA", "NA", "(404) 555-0531", "NA", "NA", "NA", "NA", "NA"]],
    "pipe.csv": [["01/05/2026", "Pipe Test", "NA", "NA", "(404) 555-0532", "NA", "NA", "NA", "NA", "NA"]],
    "quoted.csv": [["01/05/2026", 'Mul "q" Test', "NA", "1 A St Unit 2, Rome", "(404) 555-0101", "NA", "NA", "NA", "NA", "NA"],
                   ["01/06/2026", "Next Test", "NA", '5" x', "(404) 555-0102", "NA", "NA", "NA", "NA", "NA"]],
    "latin.csv": [["01/05/2026", "René O’Test", "NA", "NA", "(404) 555-0540", "NA", "NA", "NA", "NA", "NA"]],
    "bom.csv": [["01/05/2026", "Bom Test", "NA", "NA", "(404) 555-0541", "NA", "NA", "NA", "NA", "NA"]],
}
CARDS = [
    [STAMP, "Ada Testcard", "01/02/1960", "0301 Fake St, Testville, GA", "(404) 555-0301", "30301", "Owner", "1", "Progressive", "2015 Toyota Camry"],
    [STAMP, "Ben Testcard", "03/04/1971", "0302 Fake St, Testville, GA", "(404) 555-0302", "30302", "Rented", "1", "GEICO", "2012 honda civic"],
    [STAMP, "Cy Testcard", "05/06/1982", "0303 Fake St, Testville, GA", "(404) 555-0303", "30303", "Rented", "1", "State Farm", "2018 Ford F150"],
    [STAMP, "Di Testcard", "07/08/1990", "0304 Fake St, Testville, GA", "(404) 555-0304", "30304", "Owner", "1", "NA", "NA"],
]


@pytest.mark.parametrize("name", list(EXPECTED))
def test_file(result, name):
    assert result[0][name] == EXPECTED[name]


def test_cards(result):
    assert result[0]["linear.txt"] == CARDS
    assert result[0]["grid.csv"] == [*CARDS, [STAMP, "Eve Testcard", "09/09/1950", *["NA"] * 3, "Rented", *["NA"] * 3]]


def test_facts(result):
    facts = result[1]
    layouts = {n: f.layout for n, f in facts.items()}
    assert layouts["linear.txt"] == "linear" and layouts["grid.csv"] == "grid" and layouts["labeled.csv"] == "labeled"
    assert layouts["headerless.csv"] == "inferred" and layouts["empty.csv"] == "empty" and layouts["book.csv"] == "xlsx"
    skipped = {n: f.skipped_non_lead_rows for n, f in facts.items()}
    assert (skipped["junk.csv"], skipped["headerless.csv"], skipped["grid.csv"], skipped["linear.txt"]) == (3, 1, 3, 1)
    junk = facts["junk.csv"]
    assert (junk.input_rows, junk.output_rows, junk.duplicates_removed, junk.empty_rows_skipped) == (4, 2, 1, 1)
    assert junk.dropped_headers == ["Agent Name"] and junk.unmapped_headers == [] and not junk.header_inferred
    assert facts["grid.csv"].header_inferred and facts["grid.csv"].timestamp_synthesized
    assert facts["empty.csv"].output_rows == 0 and facts["aliases.csv"].unmapped_headers == []
    assert set(facts) == set(FILES) | set(BYTES)


def test_rejects(result):
    kinds = {os.path.basename(r.file_id): r.kind for r in result[2].rejects.collect()}
    assert kinds == {"book.csv": "xlsx", "open.csv": "unclosed quote"}


def test_issue_counts_match_rows(result):
    organized = result[3]
    total = organized.column_issues.where("column = 'Full Name'").agg(F.sum("na"), F.sum("fixed")).first()
    names = organized.standardized
    assert total[0] == names.where("`Full Name` IS NULL").count()
    assert total[1] == names.where("`Full Name` IS NOT NULL AND raw.`Full Name` <> `Full Name`").count()


def test_forced_layout(spark, result):
    organized, _ = organize_files(spark, os.path.join(result[4], "headerless.csv"), as_of="2026-07-01", layout="inferred")
    assert organized.organized.count() == 3


def test_quoted_records_equal_csv_module(spark, tmp_path):
    """Random cells with quotes, delimiters and line breaks survive the distributed stitching."""
    rng = random.Random(8)
    cells = ["a", 'q"q', "x,y", "l1\nl2", 'm"\n"n,', "", " p ", "z;z", '""', "end\n"]
    rows = [[rng.choice(cells) for _ in range(4)] for _ in range(120)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["h1", "h2", "h3", "h4"], *rows])
    (tmp_path / "q.csv").write_text(out.getvalue())
    intake = Intake(read_lines(spark, str(tmp_path)), list_files(spark, str(tmp_path)))
    got = [[c or "" for c in r.cells] for r in intake.rows.orderBy("src").collect()]
    assert got[1:] == rows
    assert ragged_rows(intake.rows).first().ragged_rows == 0


def test_delimiter_does_not_depend_on_splits(spark, tmp_path):
    from leadspark.sources.intake import profile_files, read_lines

    head = "".join(f"a;b;c{i},\n" for i in range(40))
    (tmp_path / "f.txt").write_text(head + "".join(f"x{i},y,z,w;\n" for i in range(4000)))
    found = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(profile_files(read_lines(spark, str(tmp_path))).first()["delimiter"])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [",", ","]


def test_roles_map_through_a_custom_profile(spark, tmp_path):
    (tmp_path / "x.csv").write_text("".join(f"Jane Tester,404555{i:04d},{i % 4 + 1}\n" for i in range(20)))
    profile = {"columns": [{"name": "Caller", "type": "name", "aliases": ["full name"]},
                           {"name": "Phone", "type": "phone", "aliases": ["phone number"]}]}
    done, _ = organize_files(spark, str(tmp_path), profile, "2026-07-01")
    rows = done.leads.collect()
    assert len(rows) == 20 and {r["Caller"] for r in rows} == {"Jane Tester"} and all(r["Phone"].startswith("(404)") for r in rows)
