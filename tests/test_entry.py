"""The entry without the training-data operators, and staged tables that go when nothing reads them."""

import os
import shutil
import subprocess
import sys

from leadspark.catalog import QUERIES
from leadspark.operators.staging import materialize, release, scratch, staging_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_folders(tmp_path):
    keep = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=keep)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    n, oracles, dealt = done.stdout.split()[-3:]
    assert (int(n), dealt) == (len(QUERIES), "False") and int(oracles) == sum(q.oracle is not None for q in QUERIES.values())


def tables(spark):
    folder = staging_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("leadspark-")}


def test_scopes_remove_what_they_staged(spark):
    before = tables(spark)
    with scratch(spark) as outer:
        first = materialize(spark.range(5))
        with scratch(spark) as keep:
            second = materialize(first.selectExpr("id * 2 AS id"))
            kept = keep(second.where("id > 2"))
        assert len(tables(spark) - before) == 2 and kept.count() == 3
        last = outer(kept.union(first))
        release(first, spark.range(3))
        assert len(tables(spark) - before) == 2
    assert len(tables(spark) - before) == 1 and last.count() == 8
    release(last)
    assert tables(spark) == before


def test_a_failed_scope_leaves_nothing(spark):
    before = tables(spark)
    try:
        with scratch(spark):
            materialize(spark.range(2))
            raise ValueError
    except ValueError:
        pass
    assert tables(spark) == before
