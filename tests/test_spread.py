"""Work on leads and files is dealt out over the tasks, and files are opened once."""

import inspect
import shutil

import pytest
from pyspark.sql import functions as F

from leadspark.catalog import layouts
from leadspark.catalog.base import raw_leads
from leadspark.operators import infer
from leadspark.sources.intake import Intake, files_of, read_lines
from leadspark.streaming.dropfolder import watch_folder


@pytest.fixture
def tables(spark, tmp_path):
    """Customers in a file of one row group, their nations and orders."""
    customers = spark.range(0, 400, 1, 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 5).alias("c_nationkey"),
                                                 F.lit(1.5).alias("c_acctbal"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 5, 1, 1).select(F.col("id").alias("n_nationkey"), F.lit("TESTLAND").alias("n_name")).write.parquet(
        f"{tmp_path}/nation.parquet")
    spark.range(0, 400, 1, 1).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"),
                                     F.lit("1997-01-02").cast("date").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_leads_of_one_row_group_are_dealt_out(spark, tables):
    held = raw_leads(spark, tables).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in held) == 400
    assert len(held) > 4 and max(r["count"] for r in held) < 200


@pytest.mark.parametrize("build", [layouts.grid_rows, layouts.labeled_rows])
def test_exploded_lines_are_dealt_out_before_they_are_sorted(spark, tables, build, monkeypatch):
    monkeypatch.setattr(layouts, "materialize", lambda df: df)
    plan = build(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "max(CASE" in plan and "REPARTITION_BY_COL" in plan
    for part in plan.split("SortAggregate")[1:]:
        assert "Generate" not in part.split("Exchange")[0]


def test_roles_are_claimed_in_many_tasks(spark):
    shares = [*infer.predicates(F.lit("x"), F.current_date()), "carrier"]
    profile = spark.range(0, 60, 1, 1).select(F.col("id").cast("string").alias("file_id"), F.lit(0).alias("col"), *[
        F.lit(1.0 if s == "phone" else 0.0).alias(s) for s in shares], F.lit(None).cast("int").alias("median_year"))
    held = infer.claim_roles(profile).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 60 and len(held) > 1


def test_files_are_opened_once(spark, tmp_path):
    """Rows and card lines come from what was staged: the folder may be gone."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "table.csv").write_bytes(b"Name,Phone\nAnn Testone,4045550100\nJos\xe9 Testtwo,4045550101\n")
    (folder / "cards.txt").write_text("Name: Ann Testone\nDOB: 1/2/1980\n____\n" * 5)
    (folder / "nothing.csv").write_bytes(b"")
    lines = read_lines(spark, str(folder))
    intake = Intake(lines, files_of(lines))
    shutil.rmtree(folder)
    assert intake.linear_lines.count() == 15
    cells = {tuple(r["cells"]) for r in intake.rows.collect()}
    assert ("José Testtwo", "4045550101") in cells and len(cells) == 3
    assert intake.profile.where("kind = 'empty'").count() == 1


def test_a_micro_batch_holds_many_files():
    assert inspect.signature(watch_folder).parameters["max_files"].default >= 100_000
