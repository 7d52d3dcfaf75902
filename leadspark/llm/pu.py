"""Quality classifier from positive and unlabelled texts.

Trusted positives are few, and all other text is unlabelled: a mixture of good and bad in which the share of good, the
class prior, is estimated. A small network is fitted by minimising the non-negative unbiased risk (Kiryo et al.,
"Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017)::

    prior * loss(positives, +) + max(0, loss(unlabelled, -) - prior * loss(positives, -))

Only measures of the text go in. They are column expressions, as is the fitted score, so all texts are measured in one
pass and scored without Python. The unlabelled part of the risk is taken over every row: rows are summed up in cells of the
standardized measures (each measure low, usual or high, so 3^10 cells at most, whatever the input), and a cell enters with its number of
rows and their mean. Sums are of whole numbers, so they do not depend on the order of rows. Only the trusted positives are a bounded
sample: at most ``POSITIVES`` of them, those of least id hash. A failed non-negativity step goes back along the negative part
alone, as the paper has it.

The class prior comes from the unlabelled texts too (Garg et al., "Mixture Proportion Estimation and PU Learning: A Modern
Approach", 2021): a first network tells half of the positives from the unlabelled; where the other half scores highest, hardly
any unlabelled text is bad, so the share of unlabelled above a threshold divided by that of these positives bounds the prior, and the
threshold of the least upper confidence bound is taken. With fewer than ``FEW`` positives it is the share of positive labels.

Null texts count as empty and are scored like any text. Equal texts get equal scores. Without positives or documents the score is
the prior (one half if no label says otherwise). A document labelled twice counts as positive only if all its labels say so; repeated
rows of a document count as often as they stand. Extra columns of either input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.binding import let
from leadspark.llm.common import GAPS, whole_text
from leadspark.operators.staging import materialize

POSITIVES = 10_000
# Positives without which the prior is not estimated from scores.
FEW = 20
HIDDEN = 12
STEPS = 400
# Standardized measures beyond this are as far out as can be, those within USUAL are usual.
FAR = 4.0
USUAL = 1.0
# Standardized measures are summed as whole multiples of 1 / GRAIN.
GRAIN = 1 << 20
# Bins of scores in which positives and all rows are counted for the prior.
BINS = 1000
# One minus the confidence of the bound on the prior.
DOUBT = 0.1
_SPACES = " \t\n\x0b\x0c\r"


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / whole, F.lit(0.0))


NAMES = ["length", "word_length", "symbols", "capitals", "marks", "pauses", "digits", "same_lines", "variety", "stutter"]


def measured(text: Column) -> Column:
    """STRUCT of the measures ``NAMES`` of a text (DOUBLE, never null), worked out once wherever the optimizer moves it."""
    def whole(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(_SPACES))
        hashes = F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, GAPS), lambda w: F.xxhash64(w)))
        lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(_SPACES)) != "")
        chars = F.length(F.translate(t, _SPACES, "")).cast("double")
        return let(F.struct(hashes.alias("h"), lines.alias("lines"), chars.alias("chars")), lambda parts: of_parts(t, parts))

    def of_parts(t: Column, parts: Column) -> Column:
        h, lines = parts["h"], parts["lines"]
        n, chars = F.nullif(F.size(h), F.lit(0)).cast("double"), F.nullif(parts["chars"], F.lit(0.0))

        def of(signs: str) -> Column:
            return F.length(t) - F.length(F.translate(t, signs, ""))

        found = [
            F.log1p(F.size(h).cast("double")),
            _share(chars, n),
            _share(of("#*$%&|<>{}[]=~^_\\@+"), chars),
            _share(F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")), chars),
            _share(of(".!?"), n),
            _share(of(",;:"), n),
            _share(of("0123456789"), chars),
            _share(F.size(lines) - F.size(F.array_distinct(lines)), F.nullif(F.size(lines), F.lit(0))),
            _share(F.size(F.array_distinct(h)).cast("double"), F.pow(n, F.lit(0.9))),
            _share(F.size(F.filter(h, lambda x, i: x == F.get(h, i - 1))), n),
        ]
        return F.struct(*[e.cast("double").alias(k) for k, e in zip(NAMES, found, strict=True)])

    return let(text, whole)


def _standardized(value: Column, mean: float, scale: float) -> Column:
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), (value - float(mean)) / float(scale)))


def cells(table: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean standardized measures and number of rows of every cell that has rows, over all rows of ``table``."""
    z = [_standardized(F.col(f"m.{c}"), m, s) for c, m, s in zip(NAMES, mean, scale, strict=True)]
    level = F.lit(0)
    for x in z:
        level = level * 3 + F.when(x < -USUAL, 0).when(x > USUAL, 2).otherwise(1)
    whole = table.select(level.alias("_cell"), *[F.round(x * GRAIN).cast("bigint").alias(c) for c, x in zip(NAMES, z, strict=True)])
    found = whole.groupBy("_cell").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in NAMES])
    rows = sorted(tuple(r) for r in found.collect())
    n = np.array([r[1] for r in rows], dtype=float)
    return np.array([r[2:] for r in rows], dtype=float).reshape(-1, len(NAMES)) / n[:, None] / GRAIN, n


def _forward(x: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rows: np.ndarray, prior: float | None, seed: int = 17) -> list[np.ndarray]:
    """Weights of a one-layer network, by full-batch Adam on the logistic loss; ``unlabelled`` are cells of so many ``rows``.

    With a prior the risk is the non-negative one of good against bad, without it that of positive against unlabelled, both halves alike.
    """
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    w = [rng.normal(0, 1 / math.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    x = np.vstack([positive, unlabelled])
    n_p, part = len(positive), rows / rows.sum()
    moment, square = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, STEPS + 1):
        hidden, p = _forward(x, w)
        # The logistic loss of calling a text bad grows with slope p, that of calling it good falls with slope 1 - p.
        slope = np.zeros_like(p)
        slope[n_p:] = p[n_p:] * part
        if prior is None:
            slope[:n_p] = -(1 - p[:n_p]) / n_p
        else:
            as_bad = -np.log1p(-np.minimum(p, 1 - 1e-12))
            slope[:n_p] = -prior * p[:n_p] / n_p
            if as_bad[n_p:] @ part < prior * as_bad[:n_p].mean():
                slope = -slope
            else:
                slope[:n_p] -= prior * (1 - p[:n_p]) / n_p
        back = slope[:, None] * w[2] * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ slope + 1e-4 * w[2], slope.sum(keepdims=True)]
        for k, g in enumerate(grads):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            w[k] = w[k] - 0.03 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, rows: int) -> float:
    """Share of good among the unlabelled, from counts of held-out positives and of all rows by score (lowest bin first)."""
    of_p, of_u = (np.cumsum(n[::-1])[::-1] / n.sum() for n in (positive, unlabelled))
    slack = sum(math.sqrt(math.log(4 / DOUBT) / 2 / n) for n in (rows, positive.sum()))
    seen = of_p > 0
    best = np.argmin((of_u[seen] + slack) / of_p[seen])
    return float(min(0.99, max(0.01, of_u[seen][best] / of_p[seen][best])))


def _learnt(table: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """The score as a function of the struct of measures; ``table`` has ``doc_id`` and the measures ``m`` of every text."""
    known = materialize(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    share = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    prior = 0.5 if share is None else min(0.99, max(0.01, share))
    own = [F.col(f"m.{c}") for c in NAMES]
    trusted = table.join(known.where("quality = 1").select("doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *own).limit(POSITIVES)
    positive = np.array([tuple(r) for r in trusted.select(*own).collect()], dtype=float).reshape(-1, len(NAMES))
    if not len(positive):
        return lambda m: F.lit(prior)
    # Nine digits are left, which the order of additions does not reach.
    spread = [float(f"{x:.9g}") for x in table.agg(*[f(c) for c in own for f in (F.avg, F.stddev_pop)]).first()]
    mean, scale = np.array(spread[::2]), np.maximum(np.array(spread[1::2]), 1e-9)
    unlabelled, rows = cells(table, mean, scale)
    positive = np.clip((positive - mean) / scale, -FAR, FAR)
    if len(positive) >= FEW:
        against = fit(positive[::2], unlabelled, rows, None)
        held = np.bincount((_forward(positive[1::2], against)[1] * BINS).astype(int), minlength=BINS + 1)
        bins = F.floor(network(F.col("m"), mean, scale, against) * BINS)
        found = dict(map(tuple, table.groupBy(bins.alias("bin")).count().collect()))
        prior = estimated_prior(held, np.array([found.get(k, 0) for k in range(BINS + 1)]), int(rows.sum()))
    weights = fit(positive, unlabelled, rows, prior)
    return lambda m: network(m, mean, scale, weights)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` and ``score`` (0 to 1, higher where the text is likelier good) of every row of ``docs``.

    ``labels`` holds ``doc_id`` and ``quality`` of the rows to learn from.
    """
    table = materialize(docs.select("doc_id", F.xxhash64(whole_text(text)).alias("text_hash"), measured(whole_text(text)).alias("m")))
    return table.select("doc_id", "text_hash", _learnt(table, labels)(F.col("m")).alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``.

    Texts are measured a second time as they are read, instead of being shuffled to meet their scores.
    """
    score = _learnt(materialize(docs.select("doc_id", measured(whole_text(text)).alias("m"))), labels)
    return docs.where(let(measured(whole_text(text)), score) >= least)


def network(m: Column, mean: np.ndarray, scale: np.ndarray, w: list[np.ndarray]) -> Column:
    """The fitted score as a column expression over the struct of measures."""
    def scored(v: Column) -> Column:
        total = F.lit(float(w[3][0]))
        for k in range(HIDDEN):
            unit = F.lit(float(w[1][k]))
            for i in range(len(NAMES)):
                unit = unit + F.get(v, F.lit(i)) * float(w[0][i, k])
            total = total + F.tanh(unit) * float(w[2][k])
        return 1 / (1 + F.exp(-total))

    return let(F.array(*[_standardized(m[c], mu, s) for c, mu, s in zip(NAMES, mean, scale, strict=True)]), scored)
