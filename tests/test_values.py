import difflib
import random

import pytest
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions import values
from leadspark.functions.similarity import closest, closest_with_confidence, hopeful, similarity

CASES = {
    "name": [("MARTA TESTBERG", "Marta Testberg"), ("li wei testsu", "Li Wei Testsu"), ("Roy McTest", "Roy McTest"),
             ("  two   gaps ", "Two Gaps"), ("ANN-MARIE o'test", "Ann-Marie O'test"), ("N/A", None), ("", None), (None, None)],
    "date": [("1971-03-09", "03/09/1971"), ("7/4/1960", "07/04/1960"), ("May 3, 1991", "05/03/1991"),
             ("3 May 1991", "05/03/1991"), ("13/01/2026", "01/13/2026"), ("02/30/1990", None), ("1990", "01/01/1990"),
             ("5/1990", "05/01/1990"), ("20260105", "01/05/2026"), ("1/2/62", "01/02/2062"), ("1/2/76", "01/02/1976"),
             ("1600-01-01", None), ("today", None), ("NaT", None), ("not a date", None), ("05.06.1982", "05/06/1982")],
    "datetime": [("2026-01-05 10:30", "01/05/2026 10:30"), ("2026-01-05 00:00:45", "01/05/2026"),
                 ("1/5/2026 1:05 PM", "01/05/2026 13:05"), ("2026-01-05T10:30:00Z", "01/05/2026 10:30"),
                 ("1/5/2026 25:00", None), ("01/05/2026", "01/05/2026")],
    "phone": [("4045550191", "(404) 555-0191"), ("404.555.0191", "(404) 555-0191"), ("1-404-555-0191", "(404) 555-0191"),
              ("4045550191.0", "(404) 555-0191"), ("55519", "55519"), ("---", None), ("none", None)],
    "zip": [("02116", "02116"), ("2116", "02116"), ("30016-1234", "30016"), ("303491234", "30349"), ("30303.0", "30303"),
            ("12", None), ("123456", None)],
    "homeowner": [("OWNER", "Owner"), (" own ", "Owner"), ("yes", "Owner"), ("tenant", "Rented"), ("homeowners", "Owner"),
                  ("rentd", "Rented"), ("banana", None), ("-", None)],
    "int": [("2", "2"), ("2.7", "2"), ("-3.9", "-3"), ("1e3", "1000"), ("3 cars", "3"), ("many", None), ("inf", None)],
    "carrier": [("GIECO", "GEICO"), ("STATE FARM", "State Farm"), ("progresive", "Progressive"), ("liberty", "Liberty Mutual"),
                ("auto owners", "Auto-Owners"), ("ACME MUTUAL", "Acme Mutual"), ("n/a", None)],
    "email": [(" A@B.Com ", "a@b.com"), ("null", None)],
    "text": [("a   b", "a b"), ("--", None), ("---", "---")],
}


@pytest.mark.parametrize("kind", list(CASES))
def test_standardizer(spark, kind):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES[kind])], "i int, v string")
    got = rows.select("i", values.standardize(F.col("v"), kind, F.lit("2026-07-01").cast("date")).alias("o")).orderBy("i")
    assert [(CASES[kind][r.i][0], r.o) for r in got.collect()] == CASES[kind]


def test_standardizers_are_idempotent(spark):
    for kind in ("name", "phone", "zip", "homeowner", "date"):
        rows = spark.createDataFrame([(v,) for v, _ in CASES[kind]], "v string")
        today = F.lit("2026-07-01").cast("date")
        once = values.standardize(F.col("v"), kind, today)
        twice = rows.select(once.alias("a")).select("a", values.standardize(F.col("a"), kind, today).alias("b"))
        assert twice.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0, kind


def test_fuzzy_lookup_equals_difflib(spark):
    rng = random.Random(5)
    vocabulary = list(values.carrier_vocabulary())
    words = [rng.choice(vocabulary) for _ in range(300)]
    words = ["".join(c for c in w if rng.random() > 0.15) + rng.choice(["", "x"]) for w in words] + ["", "tide"]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = rows.select("w", closest(F.col("w"), vocabulary, fv.CARRIER_CUTOFF).alias("c")).collect()
    for r in got:
        want = difflib.get_close_matches(r.w, vocabulary, n=1, cutoff=fv.CARRIER_CUTOFF) if r.w is not None else []
        assert r.c == (want[0] if want else None)
    scored = rows.select("w", closest_with_confidence(F.col("w"), vocabulary, 0.75).alias("c")).where("c.entry IS NOT NULL")
    for r in scored.collect():
        assert r.c.ratio == difflib.SequenceMatcher(None, r.w, r.c.entry).ratio()


def test_similarity_is_ordered(spark):
    got = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("a", None)], "a string, b string").select(
        similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [0.25, 0.5, None]


def test_carrier_mentions_follow_precedence(spark):
    texts = [("was geico, now farm bureau", "Farm Bureau"), ("Stat e farm", "State Farm"), ("grass roots", None),
             ("the ROOT app", "Root Insurance"), ("nation  wide", "Nationwide")]
    rows = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [(r.t, r.c) for r in rows.select("t", values.carrier_mention(F.col("t")).alias("c")).collect()] == texts


def test_registered_type(spark):
    values.register_type("shout", lambda v, as_of: F.upper(v))
    assert spark.range(1).select(values.standardize(F.lit("a"), "shout", F.lit(None)).alias("x")).first().x == "A"
    with pytest.raises(ValueError):
        values.standardize(F.lit("a"), "nosuch", F.lit(None))


def test_large_numbers_keep_their_digits(spark):
    texts = ["1e20", "-1e20", "12345678901234567890", "9007199254740993", "2.7", "-0.5", "1e39", "3 cars", "9e18"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", values.integer(F.col("t"))).collect()}
    assert got == {**{t: str(int(float(t))) for t in texts if t not in ("1e39", "3 cars")}, "1e39": None, "3 cars": "3"}


def test_date_notations_of_the_reference(spark):
    notations = {
        "date": [("Mon Jan 5 2026", "01/05/2026"), ("Monday, January 5, 2026", "01/05/2026"), ("2026-Jan-05", "01/05/2026"),
                 ("Jan-05-2026", "01/05/2026"), ("Jan 5 26", "01/05/2026"), ("6/7/8", "06/07/2008"), ("1990 March 3", "03/03/1990"),
                 ("010526", "01/05/2026"), ("990105", "01/05/1999"), ("Tue 1/6/2026", "01/06/2026"), ("1/5/2026 3pm", "01/05/2026"),
                 ("Monday", None), ("Mon Jan 2026", None), ("13/13/26", None), ("Jan 32 2026", None)],
        "datetime": [("1/5/2026 3 PM", "01/05/2026 15:00"), ("1/5/2026 3pm", "01/05/2026 15:00"), ("1/5/2026 12 am", "01/05/2026"),
                     ("20260105T103000", "01/05/2026 10:30"), ("1/5/2026 13 PM", None), ("20260105T253000", None),
                     ("Mon Jan 5 2026 10:30", "01/05/2026 10:30"), ("1/5/2026 10:30 PM", "01/05/2026 22:30")],
    }
    for kind, cases in notations.items():
        rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
        got = rows.select("i", values.standardize(F.col("v"), kind, F.lit("2026-07-01").cast("date")).alias("o")).orderBy("i")
        assert [(cases[r["i"]][0], r["o"]) for r in got.collect()] == cases


def test_hopeless_words_are_told_before_python(spark):
    """Exactly the words that length and letters rule out are NULL, and the closest entry stays that of the plain search."""
    rng = random.Random(5)
    words = ["owner", "home owner", "rented", "o'neil \"q\"", "aab"]
    texts = [None, "", "zzzz", "ownr", "rentd", "homeowner", "x" * 300, "é", "q\"o'neil", "baa", " "]
    texts += ["".join(rng.choice("ownerhtda b'") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    for cutoff in (0.6, 0.86):
        got = rows.select("v", hopeful(F.col("v"), words, cutoff).alias("h"), closest(F.col("v"), words, cutoff).alias("c")).collect()
        for r in got:
            held = [min(sum(c in w for c in r.v or ""), sum(c in (r.v or "") for c in w)) for w in words]
            near = r.v is not None and any(2.0 * h / (len(w) + len(r.v)) >= cutoff for h, w in zip(held, words))
            assert r.h == (r.v if near else None), r
            assert r.c == (next(iter(difflib.get_close_matches(r.v, words, 1, cutoff)), None) if r.v is not None else None), r
