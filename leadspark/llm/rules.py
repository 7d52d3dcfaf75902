"""Quality rules as weak supervision: rules vote or abstain, and a posterior probability decides.

Every rule looks at one measure of a text and votes good, bad, or abstains. Rules that detect one kind of junk vote only
bad, as the absence of that kind says little. No rule is trusted by itself: expectation-maximisation over the votes of
all documents estimates how often each rule is right when it votes, without labels. A
document's posterior probability then weighs each vote by the log-odds of its rule's accuracy.

All work on texts is done by DataFrame functions. The driver sees the table of vote patterns only, at most
2 ** len(RULES) rows whatever the input, and iterates over it.

Null texts count as empty; an empty text has no words, every rule abstains, and its posterior is the class prior.
An empty table gives an empty result. Repeated rows are judged one by one. Columns of the input other than the text are
carried along untouched, unless they bear the name of a result column, which then replaces them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.binding import let
from leadspark.llm.common import GAPS, whole_text
from leadspark.operators.staging import materialize

WINDOW = 8
# The class prior: one half lets the votes alone decide.
PRIOR = 0.5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Votes ``says`` (1 good, -1 bad) where the condition holds, else abstains; so do texts of fewer than ``few`` words."""

    name: str
    condition: str
    says: int = -1
    few: int = 1

    def vote(self) -> Column:
        holds = (F.col("n_words") >= self.few) & F.expr(self.condition)
        return F.when(holds, self.says).otherwise(0).cast("tinyint")


RULES = (
    Rule("symbols", "n_symbols > 0.05 * word_chars"),
    Rule("shouting", "n_upper > 0.40 * word_chars"),
    Rule("repeated_words", "n_repeat_words > 0.30 * n_words", few=WINDOW),
    Rule("repeated_lines", "n_dup_lines >= 3 and n_dup_lines > 0.30 * n_lines", few=WINDOW),
    Rule("sameness", "n_distinct < 0.50 * pow(n_words, 0.9)", few=20),
    Rule("word_length", "abs(word_chars - 5 * n_words) > 2 * n_words", few=5),
    Rule("sentence_marks", "n_marks > 0.60 * n_words", few=5),
    Rule("plain_prose", "n_symbols <= 0.005 * word_chars and n_upper <= 0.15 * word_chars and n_marks <= 0.30 * n_words "
         "and n_repeat_words <= 0.05 * n_words", says=1),
)


def _without(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _covered(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: repeated starts, sorted, each covering WINDOW words."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        kept = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
        return F.array_sort(F.transform(kept, lambda x: x["i"]))

    steps = let(let(ordered, starts), lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda total, x: total + x))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), steps).otherwise(0)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read to ``docs``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct"]
    own = [c for c in docs.columns if c not in names and c != text]
    t = F.col("_text")
    split = docs.select(*own, whole_text(text).alias("_text")).select(
        *own, "_text", F.when(F.btrim(t, F.lit(_SPACES)) == "", F.array().cast("array<string>"))
        .otherwise(F.split(F.btrim(t, F.lit(_SPACES)), GAPS)).alias("_words"),
        F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(_SPACES)) != "").alias("_lines"))
    hashed = split.select(
        *own, F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate(t, _SPACES, "")).cast("bigint").alias("word_chars"),
        _without(t, SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).alias("n_upper"), _without(t, ".!?").alias("n_marks"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    hashes = F.col("_hashes")
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")),
        lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    windowed = hashed.select(*[c for c in hashed.columns if c != "_hashes"], F.size(F.array_distinct(hashes)).alias("n_distinct"),
                             windows.alias("_windows"))
    return windowed.select(*own, *[c for c in names if c != "n_repeat_words"],
                           _covered(F.col("_windows")).cast("bigint").alias("n_repeat_words"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], prior: float = PRIOR, rounds: int = 100) -> list[float]:
    """EM over vote patterns and their counts: each rule's accuracy when it votes.

    Given the class, rules err independently, and abstaining says nothing. The start trusts each rule four times in five;
    five pseudo-votes of that kind keep accuracies off 0 and 1. An accuracy is not let below one half, which fixes what
    "good" means.
    """
    n_rules = len(patterns[0][0]) if patterns else len(RULES)
    accuracy = [0.8] * n_rules
    for _ in range(rounds):
        right, voted = [4.0] * n_rules, [5.0] * n_rules
        for votes, n in patterns:
            p = posterior(votes, prior, accuracy)
            for j, v in enumerate(votes):
                if v:
                    voted[j] += n
                    right[j] += n * (p if v > 0 else 1 - p)
        was, accuracy = accuracy, [min(0.999, max(0.5, r / v)) for r, v in zip(right, voted, strict=True)]
        if max(abs(a - b) for a, b in zip(accuracy, was, strict=True)) < 1e-9:
            break
    return accuracy


def posterior(votes: tuple[int, ...], prior: float, accuracy: list[float]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True))
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prior: float = PRIOR) -> DataFrame:
    """``docs`` without the text, with its counts, one vote column per rule and ``p_good``, the posterior probability."""
    measured = measures(docs.drop("p_good", *[f"vote_{r.name}" for r in rules]), text)
    voted = materialize(measured.select("*", *[r.vote().alias(f"vote_{r.name}") for r in rules]))
    columns = [f"vote_{r.name}" for r in rules]
    patterns = sorted((tuple(row[:-1]), row[-1]) for row in voted.groupBy(*columns).count().collect())
    accuracy = estimate(patterns, prior)
    odds = F.lit(math.log(prior / (1 - prior)))
    for c, a in zip(columns, accuracy, strict=True):
        odds = odds + F.col(c) * F.lit(math.log(a / (1 - a)))
    return voted.withColumn("p_good", 1 / (1 + F.exp(-odds)))
