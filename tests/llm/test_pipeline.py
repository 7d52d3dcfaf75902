"""The corpus pipeline on a small table: every stage's decisions, and registered queries with SQL."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from leadspark.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    good, single, cut, mixed, encoded = seen
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert sum((k in kept) == bool(q) for k, q in labels.items()) >= 0.95 * len(labels)
    assert single.count() == single.select("doc_id").distinct().count() <= good.count()
    assert cut.count() == single.count() and cut.selectExpr("bool_and(n_chars = length(text))").first()[0]
    assert mixed.join(cut, columns, "left_anti").count() == 0
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert encoded.count() == mixed.count()


def test_stages_pass_empty_tables(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def first_of_near_copies(rows):
    """Least id of each component of texts whose sets of five-word runs are at least 0.8 alike, all pairs compared."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = [k for k, _ in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0]
    for _ in rows:
        for a, b in alike:
            label[a] = label[b] = min(label[a], label[b])
    return set(label), [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in alike]


def test_near_copies_are_told_by_five_words(spark):
    rng = random.Random(8)
    first = [f"v{k}" for k in range(100)]
    second = ["x" if k in (30, 70) else w for k, w in enumerate(first)]  # 86 of 106 runs of five words, 92 of 104 of three
    texts = [" ".join(first), " ".join(second)]
    bases = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (60, 100, 100, 160, 240, 500)]
    for k in range(120):
        words = list(bases[k % len(bases)])
        for _ in range(rng.randrange(1, 3 + len(words) // 60)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(900)}"
        texts.append(" ".join(words))
    texts += ["a b c", "A b C", "a b c d", "a b c d e", "a b c d e f", "", " "]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    wanted, found = first_of_near_copies(rows)
    assert sum(0.8 <= x < 0.9 for x in found) > 20 and 1 not in wanted
    kept = [r[0] for r in corpus_pipeline.near_copies(spark, docs, SF).select("doc_id").collect()]
    assert sorted(kept) == sorted(wanted)


def test_mix_equals_sql(spark):
    name = "op7_source_mix"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    found = entry.queries()[name](spark, SF)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(answer.fetchall())
