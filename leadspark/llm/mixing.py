"""Mixing sources to target weights along a time-varying curriculum.

A mix takes as many words as there are. Sources share them by weight; no source is repeated more than ``MOST`` times, and
what exceeds that is reshared by weight until no source is above (``targets``). Each source is a stream of its documents
in a fixed shuffled order, repeated as often as its target needs; where the target ends inside a document, the mix takes
the first words of it. Each source's weight also changes over training time t in [0, 1], from the first to the
second number of its ramp. The integral of that schedule is the source's cumulative demand; inverting it turns
the place of a document in its stream into the training position at which the document is due, and sorting all placements by
position (a range sort) gives the order of training.

The order within a source is by the MD5 of ``doc_id``, then by id, size and the text's hash, so reruns agree. Sizes are
words; null and empty texts have none and are never placed. A null source is a source of its own, ranked last. Repeated
rows are placed each by itself. An empty table gives an empty mix. Other columns are carried along unless
they bear the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import GAPS, running_totals, whole_text
from leadspark.operators.staging import materialize

MOST = 3
# By the source's rank, repeating: its weight, and the ramp of its schedule over time (mean 1).
WEIGHTS = (5, 2, 1)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
_SPACES = " \t\n\x0b\x0c\r"


def n_words(text: str = "text") -> Column:
    trimmed = F.btrim(whole_text(text), F.lit(_SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAPS))).cast("bigint")


def _by_rank(values, rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(rank, F.lit(len(values))).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target, ramp_from, ramp_to)`` from rows of ``(source, size)``.

    The level L with target = min(most * size, L * weight) rises until the targets use all words; each round looks
    at the whole source table, of which only two sums reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = running_totals(sources, [], [F.col("source").asc_nulls_last()], "_one", "rank")
    table = materialize(ranked.select("source", "source_size", _by_rank(weights, F.col("rank")).cast("bigint").alias("weight"),
                                      _by_rank([float(r[0]) for r in ramps], F.col("rank")).alias("ramp_from"),
                                      _by_rank([float(r[1]) for r in ramps], F.col("rank")).alias("ramp_to")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, was = 0.0, None
    while level != was:
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
        used, open_weight = table.agg(F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)),
                                      F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        was, level = level, (total - used) / open_weight if open_weight else level
    target = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"), "ramp_from", "ramp_to")


def due(share: Column, ramp_from: Column, ramp_to: Column) -> Column:
    """The time at which a source has met this share of its demand: the inverse of the integral of its linear schedule."""
    tilt = (ramp_to - ramp_from) / (ramp_to + ramp_from)
    return 2 * share / ((1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share))


def mix(docs: DataFrame, text: str = "text", weights=WEIGHTS, ramps=RAMPS, most: int = MOST) -> DataFrame:
    """``docs`` without the text, with its hash ``_text``, ``size``, ``source_size``, ``target``, ``taken`` and ``placements``.

    ``placements`` is an array of (pass, position, words), one for each time the mix takes the document.
    """
    own = [c for c in docs.columns if c not in (text, "size", "source_size", "target", "taken", "placements")]
    # Other columns travel under names of their own, which clash with nothing here.
    held = {c: f"_own_{i}" for i, c in enumerate(own)}
    sized = materialize(docs.select("doc_id", "source", *[F.col(c).alias(h) for c, h in held.items()], n_words(text).alias("size"), F.xxhash64(whole_text(text)).alias("_text"),
                                    F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order")))
    goals = targets(sized.select("source", "size"), weights, ramps, most).withColumnRenamed("source", "_source")
    placed = running_totals(sized, ["source"], [F.col(c) for c in ("_order", "doc_id", "size", "_text")], "size", "_before")
    j = placed.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    wanted = F.floor(F.col("target") + 0.5).cast("bigint")
    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.struct(
        p.alias("pass"),
        due((p * F.col("source_size") + F.col("_before")) / wanted, F.col("ramp_from"), F.col("ramp_to")).alias("position"),
        F.least(F.col("size"), wanted - p * F.col("source_size") - F.col("_before")).alias("words"))), lambda x: x["words"] > 0)
    taken = F.aggregate(F.col("placements"), F.lit(0).cast("bigint"), lambda total, x: total + x["words"])
    # Written before anything reads parts of it: the optimizer, when it prunes fields of these structs, loses their values.
    placed = materialize(j.select(*held.values(), "_text", "size", "source_size", "target", passes.alias("placements")))
    return placed.select(*[F.col(h).alias(c) for c, h in held.items()], "_text", "size", "source_size", "target", taken.alias("taken"), "placements")


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row per placement in the order of training: the rows of ``mix``, exploded and range-sorted by position."""
    keep = [c for c in mixed.columns if c != "placements"]
    return mixed.select(*keep, F.explode("placements").alias("_p")).select(*keep, "_p.*").orderBy("position", "source", "doc_id", "pass")


def in_order(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, in ranges of training positions, sorted inside each.

    A pass of which the mix takes less than half is left out. Positions are even in words, so equal ranges of them make
    equal partitions; partition k holds the k-th range. ``mixed`` has rows of the same ids and texts.
    """
    own = docs.columns
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passes = F.filter("placements", lambda p: 2 * p["words"] >= F.col("size"))
    due_ = mixed.select(F.col("doc_id").alias("_doc_id"), "_text", F.transform(passes, lambda p: p["position"]).alias("_at")).where("size(_at) > 0")
    due_ = due_.groupBy("_doc_id", "_text").agg(F.flatten(F.collect_list("_at")).alias("_at"))
    keyed = docs.withColumn("_key", F.xxhash64(whole_text(text))).dropDuplicates(["doc_id", "_key"])
    placed = keyed.join(due_, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_text"))).select(*own, F.explode("_at").alias("_position"))
    part = F.least(F.lit(ranges - 1), F.floor(F.col("_position") * ranges)).cast("int")
    return placed.withColumn("_range", part).repartitionById(ranges, "_range").sortWithinPartitions("_position", "doc_id").select(*own)


# What ``mix`` gives for documents, in DuckDB.
ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    [-0.5, 0.0, 0.5][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS tilt
  FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, tilt, least(3.0 * source_size, weight *
    (SELECT level FROM l WHERE weight * level <= 3 * source_size
      ORDER BY 3.0 * source_size / weight, source NULLS LAST LIMIT 1))::DOUBLE AS target FROM s),
r AS (SELECT d.doc_id, size, source_size, target, tilt, CAST(floor(target + 0.5) AS BIGINT) AS wanted,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, greatest(0, least(size, wanted - before)) AS w0, greatest(0, least(size, wanted - source_size - before)) AS w1,
    greatest(0, least(size, wanted - 2 * source_size - before)) AS w2 FROM r)
SELECT doc_id, size, source_size, target, CAST(w0 + w1 + w2 AS BIGINT) AS taken,
  CASE WHEN w0 > 0 THEN round(2 * (before / wanted) / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (before / wanted))), 6) END AS position
FROM p
"""
