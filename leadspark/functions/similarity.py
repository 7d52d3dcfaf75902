"""Ratcliff/Obershelp similarity: the one place where values visit Python.

Spark has no built-in with these semantics (2 x matched characters / total characters, longest
block first), so the comparisons run as Arrow-batched functions. Every factory builds a
self-contained function (no reference to this package), so executors need nothing installed.
A batch is first reduced to its distinct inputs, and callers pass NULL for rows which need no
comparison, so the cost follows distinct unresolved values and not rows. Values whose length or letters already rule out every
entry of the vocabulary are told by Column expressions and come as NULL too.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


# Words a task remembers before it starts afresh, so that its memory stays bounded.
REMEMBERED = 100_000


def hopeful(value: Column, vocabulary: list[str], cutoff: float) -> Column:
    """The value if its ratio to some entry may reach the cutoff, else NULL.

    No more characters can match than the value has of the entry's letters, nor than the entry has of the value's.
    """
    # A JSON constant is parsed and folded in one go. No lambda lies in another: arguments of Python functions do not bear that.
    entries = F.from_json(F.lit(json.dumps(list(vocabulary))), "array<string>")

    def held(text: Column, letters: Column) -> Column:
        return F.length(text) - F.length(F.call_function("translate", text, letters, F.lit("")))

    def reaches(entry: Column, text: Column) -> Column:
        return 2.0 * F.least(held(text, entry), held(entry, text)) / (F.length(text) + F.length(entry)) >= cutoff

    return F.when(F.array_contains(F.zip_with(entries, F.array_repeat(value, len(vocabulary)), reaches), True), value)


def closest(value: Column, vocabulary: list[str], cutoff: float) -> Column:
    """Best vocabulary entry with ratio >= cutoff (ties: the largest entry), else NULL."""
    words, limit = list(vocabulary), REMEMBERED
    known = {None: None}  # filled by each task for the words it meets

    @F.pandas_udf("string")
    def closest_entry(values):
        import difflib

        import pandas as pd

        if len(known) > limit:
            known.clear()
            known[None] = None
        for word in values.unique():
            if word not in known:
                hit = difflib.get_close_matches(word, words, n=1, cutoff=cutoff)
                known[word] = hit[0] if hit else None
        return pd.Series([known[v] for v in values], dtype=object)

    return closest_entry(hopeful(value, words, cutoff))


def closest_with_confidence(value: Column, vocabulary: list[str], cutoff: float) -> Column:
    """As ``closest`` plus ratio(value, entry), the other argument order, exact and rounded to 2 places."""
    words = list(vocabulary)

    @F.pandas_udf("struct<entry string, ratio double, confidence double>")
    def closest_scored(values):
        import difflib

        import pandas as pd

        best = {None: (None, None, None)}
        for word in values.dropna().unique():
            hit = difflib.get_close_matches(word, words, n=1, cutoff=cutoff)
            ratio = difflib.SequenceMatcher(None, word, hit[0]).ratio() if hit else None
            best[word] = (hit[0], ratio, round(ratio, 2)) if hit else best[None]
        return pd.DataFrame([best[v] for v in values], columns=["entry", "ratio", "confidence"])

    return closest_scored(hopeful(value, words, cutoff))


def similarity(left: Column, right: Column) -> Column:
    """ratio(left, right) in this argument order; NULL when either side is NULL."""

    @F.pandas_udf("double")
    def pair_ratio(lefts, rights):
        import difflib

        import pandas as pd

        known = {}
        out = []
        for a, b in zip(lefts, rights):
            if a is None or b is None:
                out.append(None)
                continue
            if (a, b) not in known:
                known[(a, b)] = difflib.SequenceMatcher(None, a, b).ratio()
            out.append(known[(a, b)])
        return pd.Series(out, dtype="float64")

    return pair_ratio(left, right)
