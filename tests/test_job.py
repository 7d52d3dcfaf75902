"""Refinement results, written artifacts, and the drop-folder stream."""

import csv
import glob
import json
import os

import pytest
from pyspark.errors import DateTimeException

from leadspark.operators.staging import staging_folder
from leadspark.plans.job import run_job
from leadspark.plans.organize import organize_table
from leadspark.plans.refine import refine
from leadspark.streaming.dropfolder import watch_folder

HEADS = "src bigint, Timestamp string, `Full Name` string, DOB string, Phone string, Email string, Age string, Occupation string"
ROWS = [
    (1, "01/05/2026", "Jon Testsmith", "01/01/1990", "4045550420", "typo@gmial.com", "20", "Engineer"),
    (2, "01/05/2026", "John Testsmith", "01/01/1950", "4045550420", "not-an-email", "", "Student"),
    (3, "01/05/2026", "Sal Test 9", "01/01/2000", "55", "fine@gmail.com", "26", "Retired"),
    (4, "01/05/2026", "X", "01/01/1900", "", "far@unknown.example", "abc", ""),
    (5, "01/05/2026", "John Testsmith", "", "4045550420", "", "", ""),
]


@pytest.fixture(scope="module")
def refined(spark):
    return refine(organize_table(spark.createDataFrame(ROWS, HEADS), as_of="2026-07-01", order_col="src").materialize_leads())


def test_violations(refined):
    found = {(r.row, r.rule) for r in refined.violations.collect()}
    assert found == {(1, "dob_vs_age"), (1, "email_domain_typo"), (2, "email_invalid"), (2, "dob_vs_occupation"),
                     (3, "dob_vs_occupation"), (3, "name_suspicious"), (3, "phone_invalid"),
                     (4, "dob_implausible"), (4, "name_suspicious")}
    ordered = [(r.row, r.seq, r.rule) for r in refined.violations.orderBy("row", "seq").collect()]
    assert ordered == sorted(ordered, key=lambda v: (v[0], v[2]))


def test_email_repair(refined):
    fix = refined.email_corrections.collect()
    assert [(f.row, f.original, f.suggested, f.applied, f.confidence) for f in fix] == \
        [(1, "typo@gmial.com", "typo@gmail.com", True, 0.89)]
    assert refined.judged.where("row = 1").first().Email == "typo@gmail.com"


def test_groups_and_scores(refined):
    assert {(r.row, r.group, r.matched_on) for r in refined.members.collect()} == {
        (1, 1, "phone 4045550420"), (2, 1, "phone 4045550420")}  # row 5 was an exact duplicate
    scores = {r.row: r for r in refined.scores.collect()}
    assert scores[1].completeness == 55 and scores[1].penalty == 25 and scores[1].score == 30 and scores[1].review
    assert scores[1].issues == ["dob_vs_age", "duplicate_group", "email_domain_typo"]
    assert scores[3].status == "invalid" and scores[4].status == "review"
    totals = refined.totals.first()
    assert (totals.input_rows, totals.output_rows, totals.duplicates_removed, totals.duplicate_groups) == (5, 4, 1, 1)
    assert totals.vertical == "general"


def test_half_to_even(spark):
    profile = {"columns": [{"name": "Full Name", "type": "name"}, {"name": "Homeowner", "type": "homeowner"}]}
    settings = {"scoring": {"weights": {"Full Name": 5, "Homeowner": 3}, "review_threshold": 70}, "rules": {}}
    rows = spark.createDataFrame([(1, "Al Test", None), (2, "Bo Test", "own")], "src bigint, `Full Name` string, Homeowner string")
    done = refine(organize_table(rows, profile, as_of="2026-07-01", order_col="src"), settings)
    assert {r.row: r.completeness for r in done.scores.collect()} == {1: 62, 2: 100}


TEXT = "Timestamp,Full Name,Phone,Email\n01/05/2026,JON TESTSMITH,4045550420,a@gmial.com\n01/05/2026,John Testsmith,4045550420,bad\n"


def _read(pattern):
    rows = []
    for name in sorted(glob.glob(pattern)):
        with open(name, newline="", encoding="utf-8") as handle:
            rows += list(csv.DictReader(handle))
    return rows


def test_job_writes_everything(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text(TEXT)
    run_job(spark, str(source), str(out), as_of="2026-07-01")
    clean = _read(f"{out}/organized/*/*.csv")
    assert [r["Full Name"] for r in clean] == ["Jon Testsmith", "John Testsmith"] and "Email" not in clean[0]
    assert list(clean[0])[0] == "Timestamp" and len(clean[0]) == 10
    changes = _read(f"{out}/changes/*/*.csv")
    assert list(changes[0]) == ["row", "field", "original", "new", "reason"]
    assert {"row": "1", "field": "Full Name", "original": "JON TESTSMITH", "new": "Jon Testsmith", "reason": "name recased/cleaned"} in changes
    document = {}
    for name in sorted(glob.glob(f"{out}/errors/log/*/*.json")):
        with open(name, encoding="utf-8") as handle:
            for line in map(json.loads, handle):
                document.setdefault(line["section"], []).append(json.loads(line["item"]))
    assert [m["row"] for m in document["duplicate_groups"]] == [1, 2] and {m["group"] for m in document["duplicate_groups"]} == {1}
    assert document["totals"][0]["input_rows"] == 2 and [s["row"] for s in document["scores"]] == [1, 2]
    assert {"vertical", "avg_score", "unmapped_headers", "dropped_headers", "skipped_non_lead_rows", "header_inferred",
            "output_rows", "duplicates_removed"} <= set(document["totals"][0])
    assert [v["rule"] for v in document["violations"]] == ["email_domain_typo", "email_invalid"]


def test_job_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run_job(spark, str(tmp_path / "missing"), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        run_job(spark, str(tmp_path), str(tmp_path / "out"), profile="nosuch")


def staged(spark):
    return {f for f in os.listdir(staging_folder(spark).removeprefix("file:")) if f.startswith("leadspark-")}


def test_jobs_leave_nothing_staged(spark, tmp_path):
    before = staged(spark)
    source = tmp_path / "in"
    source.mkdir()
    (source / "a [1] é.csv").write_text(TEXT)
    (source / "empty.csv").write_text("")
    run_job(spark, str(source), str(tmp_path / "out"), as_of="2026-07-01")
    assert staged(spark) == before
    stream = watch_folder(spark, str(source), str(tmp_path / "streamed"), str(tmp_path / "state"), as_of="2026-07-01")
    stream.awaitTermination()
    assert stream.exception() is None and staged(spark) == before
    for out in ("out", "streamed/batch=0"):
        assert len(_read(f"{tmp_path}/{out}/organized/*/*.csv")) == 2
    with pytest.raises(DateTimeException):
        run_job(spark, str(source), str(tmp_path / "bad"), as_of="no date")
    assert staged(spark) == before


def test_drop_folder(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    (drop / "a.csv").write_text(TEXT)

    def run():
        stream = watch_folder(spark, str(drop), str(out), str(tmp_path / "state"), as_of="2026-07-01")
        stream.awaitTermination()
        assert stream.exception() is None

    run()
    (drop / "b.csv").write_text(TEXT.replace("JON", "DON"))
    run()
    (drop / "empty.csv").write_text("")
    run()
    facts = [json.loads(line) for name in glob.glob(f"{out}/batch=2/errors/log/*/*.json") for line in open(name, encoding="utf-8")]
    totals = [json.loads(f["item"]) for f in facts if f["section"] == "totals"]
    assert [(t["input_rows"], t["output_rows"], t["skipped_non_lead_rows"]) for t in totals] == [(0, 0, 0)]
    assert not glob.glob(f"{out}/batch=3")
    names = [[r["Full Name"] for r in _read(f"{out}/batch={b}/organized/*/*.csv")] for b in (0, 1)]
    assert names == [["Jon Testsmith", "John Testsmith"], ["Don Testsmith", "John Testsmith"]]
