"""Operators that stay distributed, against brute force on small data."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from leadspark.operators import components
from leadspark.operators.components import connected_components
from leadspark.operators.mapping import classify_headers, classify_lists, distinct_lists
from leadspark.operators.ordering import number_rows, running
from leadspark.operators.resolve import block_keys, duplicate_groups, fold_entities, similar_links
from leadspark.operators.rows import mark_duplicates, number_leads
from leadspark.operators.staging import materialize
from leadspark.profile import load_profile, load_quality


def test_running_totals_over_chunks(spark):
    rng = random.Random(1)
    places = sorted(rng.sample(range(5000), 400))
    data = [("a" if rng.random() < 0.8 else "b", p, rng.randint(0, 5)) for p in places]
    df = spark.createDataFrame(data, "file_id string, src bigint, v bigint").repartition(7)
    out = running(df, ["file_id"], "src", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, parts=7)
    out = number_rows(out, ["file_id"], "src", "n", parts=7)
    totals = {}
    want = {}
    for f, p, v in data:
        s, m, n = totals.get(f, (0, -1, 0))
        totals[f] = want[p] = (s + v, max(m, v), n + 1)
    assert {r.src: (r.s, r.m, r.n) for r in out.collect()} == want


@pytest.mark.parametrize("partitions", [1, 9])
def test_duplicates_do_not_depend_on_partitioning(spark, partitions):
    rng = random.Random(2)
    data = [("f", i, rng.choice(["Ann", "ann", "Bob", None]), rng.choice(["1", "2", None])) for i in range(200)]
    df = spark.createDataFrame(data, "file_id string, src bigint, name string, phone string").repartition(partitions)
    got = {r.src for r in mark_duplicates(df, ["phone", "name"]).where("duplicate").collect()}
    seen, want = set(), set()
    for _, i, name, phone in data:
        if name and phone:
            key = (name.lower(), phone)
            (want.add(i) if key in seen else seen.add(key))
    assert got == want


def test_sorted_numbers(spark):
    rng = random.Random(3)
    stamps = [None, "01/05/2026", "01/05/2026 10:30", "03/01/2025", "12/31/2024"]
    data = [("f", i, rng.choice(stamps), rng.choice(["Al", "Bo", None])) for i in range(120)]
    df = spark.createDataFrame(data, "file_id string, src bigint, Timestamp string, `Full Name` string")
    got = number_leads(df, ["Timestamp", "Full Name"], {"Timestamp": "datetime", "Full Name": "name"}).collect()
    order = {"12/31/2024": 0, "03/01/2025": 1, "01/05/2026": 2, "01/05/2026 10:30": 3, None: 4}
    want = sorted(data, key=lambda d: (order[d[2]], d[3] or "NA", d[1]))
    assert [r.src for r in sorted(got, key=lambda r: r.row)] == [d[1] for d in want]


def test_components_of_random_graph(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    edges += [(300, 300 + i) for i in range(1, 80)]  # a hub
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([("f", a, b) for a, b in edges], "file_id string, a bigint, b bigint")
    got = {r.vertex: r.component for r in connected_components(df).collect()}
    assert got == {v: find(v) for v in parent if v in got} and set(got) == {v for a, b in edges if a != b for v in (a, b)}


def _random_names(rng, n):
    firsts = ["jon", "john", "johnny", "maria", "mario", "marta", "ann", "anne", "li", "chris", "tide", "diet"]
    lasts = ["testone", "testtwo", "samplesmith", "sampelsmith", "fakehughes", "fakehuges", "o'testly", "su"]
    out = []
    for _ in range(n):
        s = f"{rng.choice(firsts)} {rng.choice(lasts)}"
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            p = rng.randrange(len(s))
            s = s[:p] + rng.choice(["", rng.choice("abest"), s[p] + s[p]]) + s[p + 1:]
        out.append(s)
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_similar_links_find_every_pair(spark, threshold):
    """The signature join misses nothing: one hot block against all pairs of its names."""
    rng = random.Random(6)
    names = _random_names(rng, 260)
    rows = spark.createDataFrame([("f", i + 1, n, "4045550100") for i, n in enumerate(names)],
                                 "file_id string, row bigint, `Full Name` string, `Phone Number` string")
    settings = {**load_quality(), "nicknames": {}, "name_fuzzy_threshold": threshold}
    entities = materialize(fold_entities(block_keys(rows, settings)))
    got = {frozenset((r.canon_a, r.canon_b)) for r in similar_links(entities, threshold).collect()}
    canon = [" ".join("".join(c for c in n if c.isalpha() or c == " ").split()) for n in names]
    want = {frozenset((a, b)) for a, b in itertools.combinations(canon, 2)
            if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= threshold}
    assert got == want


def _brute_groups(rows, settings):
    """All pairs of all blocks, then closure; returns {row: (group, matched_on)}."""
    blocks = {}
    for row, name, phone, email in rows:
        digits = "".join(c for c in phone or "" if c.isdigit())
        if digits:
            blocks.setdefault("phone " + digits, []).append(row)
        if email and "@" in email and not email.startswith("no@"):
            blocks.setdefault("email " + email, []).append(row)
    by_row = {r[0]: r for r in rows}

    def canon(name):
        words = "".join(c for c in name.lower() if "a" <= c <= "z" or c == " ").split()
        return " ".join([settings["nicknames"].get(words[0], words[0]), *words[1:]]) if words else ""

    links, reason = [], {}
    for key, members in blocks.items():
        for a, b in itertools.combinations(members, 2):
            if by_row[a][1] is None or by_row[b][1] is None:
                continue
            x, y = canon(by_row[a][1]), canon(by_row[b][1])
            if x == y or difflib.SequenceMatcher(None, x, y).ratio() >= settings["name_fuzzy_threshold"]:
                links.append((a, b))
                reason.setdefault(a, key)
    root = {r: r for r in by_row}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    linked = sorted({x for pair in links for x in pair})
    ids = {f: i + 1 for i, f in enumerate(sorted({find(r) for r in linked}))}
    return {r: (ids[find(r)], reason[find(r)]) for r in linked}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    """A placeholder phone holds a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i, name in enumerate(_random_names(rng, 240), 1):
        phone = "0000000000" if rng.random() < 0.33 else rng.choice([None, "(404) 555-01%02d" % rng.randrange(30)])
        email = rng.choice([None, "no@gmail.com", "p%d@x.com" % rng.randrange(60)])
        rows.append((i, None if rng.random() < 0.05 else name.title(), phone, email))
    settings = load_quality()
    df = spark.createDataFrame([("f", *r) for r in rows], "file_id string, row bigint, `Full Name` string, "
                                                          "`Phone Number` string, Email string").repartition(5)
    got = {r.row: (r.group, r.matched_on) for r in duplicate_groups(df, settings).collect()}
    assert got == _brute_groups(rows, settings)


def test_numbering_keeps_null_keys_and_positions(spark):
    from leadspark.operators.ordering import number_rows, number_sorted

    rows = [(None, 5, "b"), (None, None, "a"), ("f", 1 << 60, "c"), ("f", -3, "d"), ("f", 7, "a")]
    df = spark.createDataFrame(rows, "file_id string, src bigint, v string")
    got = {(r["file_id"], r["src"]): r["n"] for r in number_rows(df, ["file_id"], "src", "n", parts=3).collect()}
    assert got == {(None, None): 1, (None, 5): 2, ("f", -3): 1, ("f", 7): 2, ("f", 1 << 60): 3}
    got = {(r["file_id"], r["src"]): r["n"] for r in number_sorted(df, ["file_id"], [F.col("v")], "src", "n").collect()}
    assert got == {(None, None): 1, (None, 5): 2, ("f", 7): 1, ("f", 1 << 60): 2, ("f", -3): 3}


def test_header_lists_are_worked_out_once(spark, monkeypatch):
    lists = [["NAME", "Phone", "Zip", "Name"], ["First Name", "Last Name", "Telephone"], ["Blah", None, "Phone"]]
    data = [(f"f{k}", i, h) for k in range(1000) for i, h in enumerate(lists[k % 3])]
    headers = spark.createDataFrame(data, "file_id string, ordinal int, header string").repartition(5)
    profile = load_profile("default")
    seen = []

    def counted(table):
        seen.append(distinct_lists(table).select("file_id").distinct().count())
        return distinct_lists(table)

    monkeypatch.setattr("leadspark.operators.mapping.distinct_lists", counted)
    got = classify_headers(headers, profile)
    want = classify_lists(headers, profile)
    assert seen == [3] and got.columns == want.columns
    rows = [sorted(map(repr, map(tuple, df.collect()))) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) == len(data)


def _path(spark, n):
    """The edges of a path of n vertices, in no order."""
    edges = spark.range(n - 1).select(F.lit("f").alias("file_id"), F.xxhash64("id").alias("_o"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return edges.orderBy("_o").drop("_o")


def _counting_tables(monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df: written.append(1) or materialize(df))
    return written


def test_long_path_that_fits_a_task_is_one_table(spark, monkeypatch):
    written = _counting_tables(monkeypatch)
    n = 100_000
    found = connected_components(_path(spark, n))
    assert found.agg(F.count("*"), F.max("component"), F.countDistinct("vertex")).first() == (n, 0, n)
    assert len(written) == 1


def test_contraction_saves_rounds_over_many_tasks(spark, monkeypatch):
    """The same path over tasks of few edges, with contraction and by star rounds alone."""
    n, setting = 1_000, "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(components, "SLICE", 200)
    spark.conf.set(setting, "false")
    try:
        rounds = []
        for contract in (components.contracted, lambda edges: edges):
            monkeypatch.setattr(components, "contracted", contract)
            with monkeypatch.context() as counted:
                written = _counting_tables(counted)
                assert connected_components(_path(spark, n)).agg(F.max("component")).first()[0] == 0
            rounds.append(len(written))
    finally:
        spark.conf.unset(setting)
    assert rounds[0] < rounds[1]


def test_components_by_file_of_texts_in_small_slices(spark, monkeypatch):
    """Vertices that are texts, files that share them, loops, null ends and repeated edges; slices of few edges."""
    monkeypatch.setattr(components, "SLICE", 3)
    edges = [("f", "b", "a"), ("f", "b", "c"), ("g", "c", "d"), ("g", "c", "d"), ("g", "z", "z"), ("f", None, "a"), ("f", "é", "c"), ("g", "y", "x")]
    df = spark.createDataFrame(edges, "file_id string, a string, b string")
    got = {(r.file_id, r.vertex): r.component for r in connected_components(df).collect()}
    assert got == {**{("f", v): "a" for v in "abcé"}, ("g", "c"): "c", ("g", "d"): "c", ("g", "x"): "x", ("g", "y"): "x"}
    assert connected_components(df.limit(0)).count() == 0
