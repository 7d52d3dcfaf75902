"""Hard negatives from an R-tree packed by sort-tile-recursive, searched best first.

The tree's upper level is made by Spark, its lower ones inside tasks:

* Rows are tiled into *regions* of at most ``REGION`` rows: each level cuts the cells that are still too large into ``SLABS`` slabs
  at quantiles of one coordinate, the label first and then those of largest variance. Equal values are parted by a hash, so
  one common vector fills as many regions as it needs. A region's minimum bounding box also holds its labels.
* A box gives an interval of inner products with an anchor: every coordinate adds its least and its largest product. An anchor visits
  the regions whose interval meets its score windows and whose labels can hold what it looks for. Positives are looked for in the
  anchor's own region first; the fifth score found there prunes the other regions.
* Inside a region's task the rows are packed into leaves of ``LEAF`` rows below nodes of ``FAN`` children. A queue per anchor takes the
  node of highest upper bound; nodes outside every window, or strictly below the k-th score that a window has, are
  pruned; ties stay, as a smaller id may win. The best k of each region meet in one more ranking.

Anchors are a stated query set; they meet regions in blocks of hash buckets, and a task holds one region, past which the anchors
stream. Products are exact: in doubles while they fit 53 bits, else in unbounded integers; scores beyond 63 bits stay at the bound.

Every row stands for itself: repeated rows are several rows, and "other" means another row. Rows with a null label, a null vector or a
component that is null or not finite take no part. A null ``vec_id`` is no anchor and comes last among equal scores. Empty
vectors have product 0; vectors of different lengths never meet. An empty table, or one without anchors, gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.common import slices
from leadspark.operators.staging import materialize, small_side

REGION = 4096
SLABS = 4
LEAF = 256
FAN = 8
# Coordinates that tiling goes through, besides the label.
TILED = 12
# Hash buckets in which anchors and region boxes meet; anchors per task of a region.
BUCKETS = 64
ANCHORS = 8192
_LAST = (1 << 63) - 1

_FOUND = "row bigint, win int, other bigint, other_id bigint, score bigint"


def points(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, vector): the rows that take part, components floored after scaling."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(good, F.lit(False)))
    return materialize(kept.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("vector")))


def _spread(rows: DataFrame) -> list[int]:
    """The coordinates of largest variance, at most TILED, largest first."""
    parts = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("v"))
    return [r["at"] for r in parts.orderBy(F.desc("v"), "at").limit(TILED).collect()]


def tile(rows: DataFrame, region: int = REGION) -> DataFrame:
    """Rows of ``points`` with their ``region``."""
    coordinates = [F.col("label").cast("double"), *(F.coalesce(F.get("vector", F.lit(i)), F.lit(0)).cast("double") for i in _spread(rows)), F.lit(0.0)]
    cells = rows.select("row", F.size("vector").cast("bigint").alias("cell"), F.array(*coordinates).alias("at"))
    level = 0
    while True:
        # The fraction parts rows whose coordinates, whole numbers, are equal.
        value = F.col("at")[level % len(coordinates)] + F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(1 << 20)) / F.lit(1 << 20)
        valued = cells.withColumn("value", value)
        cuts = valued.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("value", [k / SLABS for k in range(1, SLABS)], 10_000).alias("cuts"))
        large = small_side(cuts.where(F.col("n") > region).select("cell", "cuts"))
        if large.isEmpty():
            placed = rows.join(cells.select("row", F.col("cell").alias("region")), "row")
            return materialize(placed.repartition("region").sortWithinPartitions("region"))
        slab = F.size(F.filter("cuts", lambda c: c < F.col("value")))
        cells = materialize(valued.join(large, "cell", "left").select(
            "row", F.when(F.col("cuts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", slab, F.lit(level))).alias("cell"), "at"))
        level += 1


def boxes(placed: DataFrame) -> DataFrame:
    """(region, box, label_lo, label_hi): the least and largest of every coordinate and of the labels of each region."""
    def bound(batches):
        for batch in slices(batches, 4096):
            where, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(2)
            out = []
            for region in np.unique(where):
                mine = np.flatnonzero(where == region)
                v = _matrix(vectors.take(pa.array(mine)))
                out.append((int(region), v.min(0).tolist(), v.max(0).tolist(), int(labels[mine].min()), int(labels[mine].max())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()))], names=["region", "lo", "hi", "a", "b"])

    parts = placed.select("region", "label", "vector").mapInArrow(bound, "region bigint, lo array<bigint>, hi array<bigint>, a bigint, b bigint")
    met = parts.groupBy("region").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"), F.min("a").alias("label_lo"), F.max("b").alias("label_hi"))
    side = F.expr("""transform(los[0], (x, i) -> struct(double(array_min(transform(los, l -> l[i]))) AS lo,
                                                        double(array_max(transform(his, h -> h[i]))) AS hi))""")
    return materialize(met.select("region", side.alias("box"), "label_lo", "label_hi"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def _largest(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))


class Tree:
    """A packed tree over the rows of one region."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        spread = np.argsort(-vectors.astype(float).var(0), kind="stable")[:TILED] if vectors.shape[1] else []
        order = np.concatenate(list(self._pack(np.arange(len(rows)), [labels, *(vectors[:, c] for c in spread)])))
        self.rows, self.ids, self.labels = rows[order], ids[order], labels[order]
        self.vectors, self.kinds = vectors[order], {}
        self.largest = _largest(vectors)
        starts = np.arange(0, len(order), LEAF)
        lo, hi = (f.reduceat(self.vectors, starts) for f in (np.minimum, np.maximum))
        a, b = (f.reduceat(self.labels, starts) for f in (np.minimum, np.maximum))
        self.children: list[range | None] = [None] * len(starts)
        boxes = [(lo, hi, a, b)]
        first = 0
        while len(lo) > 1:
            starts = np.arange(0, len(lo), FAN)
            self.children += [range(first + s, first + min(s + FAN, len(lo))) for s in starts.tolist()]
            first += len(lo)
            lo, hi, a, b = (f.reduceat(x, starts) for f, x in ((np.minimum, lo), (np.maximum, hi), (np.minimum, a), (np.maximum, b)))
            boxes.append((lo, hi, a, b))
        self.lo, self.hi, self.a, self.b = (np.concatenate(x) for x in zip(*boxes, strict=True))

    @staticmethod
    def _pack(rows: np.ndarray, coordinates: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Sort by one coordinate, cut into slabs of whole leaves, go on with the next coordinate in each."""
        if len(rows) <= LEAF or not coordinates:
            yield rows
            return
        rows = rows[np.argsort(coordinates[0][rows], kind="stable")]
        slab = -(-len(rows) // (LEAF * SLABS)) * LEAF
        for at in range(0, len(rows), slab):
            yield from Tree._pack(rows[at:at + slab], coordinates[1:])

    def _as(self, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self.kinds:
            self.kinds[kind] = tuple(x.astype(kind) for x in (self.vectors, self.lo, self.hi))
        return self.kinds[kind]

    def search_all(self, rows: list[int], anchors: np.ndarray, labels: list[int], windows: list[list[tuple[int, int]]], same: bool, k: int) -> Iterator[tuple]:
        """(row, window, found row, found id, score): for every anchor and window the first k, by their boxes' intervals."""
        # Sums of products stay exact in doubles below 2 ** 53.
        kind = np.float64 if self.largest * _largest(anchors) * max(1, anchors.shape[1]) < 1 << 53 else object
        anchors = anchors.astype(kind)
        low, high = self.intervals(anchors)
        for i, row in enumerate(rows):
            for w, (at, scores) in enumerate(self.search(row, anchors[i], labels[i], windows[i], same, k, low[i], high[i])):
                for p, score in zip(at.tolist(), scores.tolist(), strict=True):
                    yield row, w, int(self.rows[p]), int(self.ids[p]), int(score)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every anchor and node the least and the largest inner product that the box allows."""
        _, lo, hi = self._as(anchors.dtype.type if anchors.dtype != object else object)
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T

    def search(self, row: int, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], same: bool, k: int,
               low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every window the first k (positions, scores) in it, highest score first, ties by smaller id."""
        kind = anchor.dtype.type if anchor.dtype != object else object
        vectors = self._as(kind)[0]
        floors, found = [w[0] for w in windows], [(np.zeros(0, int), np.zeros(0, kind))] * len(windows)
        root = len(self.children) - 1
        queue = [(-high[root], root)]
        while queue:
            bound, node = heapq.heappop(queue)
            live = [w for w in range(len(windows)) if -bound >= floors[w]]
            if not live:
                break
            if low[node] > max(windows[w][1] for w in live):
                continue
            if (not self.a[node] <= label <= self.b[node]) if same else self.a[node] == label == self.b[node]:
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(queue, (-high[child], child))
                continue
            here = slice(node * LEAF, (node + 1) * LEAF)
            scores = np.clip(vectors[here] @ anchor, -_LAST, _LAST) if kind is object else vectors[here] @ anchor
            fits = (scores >= min(floors[w] for w in live)) & (scores <= max(windows[w][1] for w in live))
            at = np.flatnonzero(fits.astype(bool))
            at = at[((self.labels[here][at] == label) == same) & (self.rows[here][at] != row)]
            if not len(at):
                continue
            for w in live:
                s = scores[at]
                mine = ((s >= floors[w]) & (s <= windows[w][1])).astype(bool)
                if mine.any():
                    where, s = np.concatenate([found[w][0], at[mine] + node * LEAF]), np.concatenate([found[w][1], s[mine]])
                    best = np.lexsort((self.rows[where], self.ids[where], -s))[:k]
                    found[w] = where[best], s[best]
                    if len(best) == k:
                        floors[w] = max(floors[w], s[best[-1]])
        return found


def _search(placed: DataFrame, visits: DataFrame, same: bool, k: int, parts: int) -> DataFrame:
    """The best k of each visited region for every window of an anchor; visits are (region, row, label, vector, windows)."""
    def run(batches):
        key, held, tree = None, [], None
        for batch in slices(batches, 1024):
            regions, part_of, kinds = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((np.diff(regions) != 0) | (np.diff(part_of) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                here = batch.slice(a, b - a)
                if (regions[a], part_of[a]) != key:
                    key, held, tree = (regions[a], part_of[a]), [], None
                if kinds[a] == 0:
                    held.append(here)
                    continue
                if tree is None:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    tree = Tree(*(whole[c].to_numpy() for c in ("row", "id", "label")), _matrix(whole["vector"].combine_chunks()))
                windows = [[(w["lo"], w["hi"]) for w in row] for row in here.column(7).to_pylist()]
                out = list(tree.search_all(here.column(3).to_pylist(), _matrix(here.column(6)), here.column(5).to_pylist(), windows, same, k))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["row", "win", "other", "other_id", "score"])

    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")
    trees = placed.select("region", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "row",
                          F.coalesce("vec_id", F.lit(_LAST)).alias("id"), "label", "vector", none.alias("windows"))
    asked = visits.select("region", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "row", F.lit(0).cast("bigint").alias("id"),
                          "label", "vector", "windows")
    # Only regions that are visited are sent.
    wanted = asked.select("region", "part").distinct()
    both = trees.join(wanted, ["region", "part"], "left_semi").unionByName(asked)
    return both.repartition("region", "part").sortWithinPartitions("region", "part", "kind").mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of every window over all regions, with their ``rank`` from 1."""
    order = Window.partitionBy("row", "win").orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _may_hold(same: bool) -> Column:
    inside = F.col("label").between(F.col("label_lo"), F.col("label_hi"))
    return inside if same else ~((F.col("label_lo") == F.col("label")) & (F.col("label_hi") == F.col("label")))


def _visits(anchors: DataFrame, walls: DataFrame, same: bool) -> DataFrame:
    """The regions of the top level that an anchor has to visit; a margin covers the rounding of the interval's sums."""
    dealt = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    met = dealt.join(walls.withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(BUCKETS)).cast("int")), "bucket").where(
        (F.size("vector") == F.size("box")) & _may_hold(same))
    bound = "aggregate(zip_with(vector, box, (x, b) -> {0}(x * b.lo, x * b.hi)), double(0), (s, x) -> s + x)"
    slack = "aggregate(zip_with(vector, box, (x, b) -> greatest(abs(x * b.lo), abs(x * b.hi))), double(1), (s, x) -> s + x) * 1e-12"
    held = met.withColumns({"_up": F.expr(bound.format("greatest")), "_low": F.expr(bound.format("least")), "_slack": F.expr(slack)})
    return held.where("exists(windows, w -> _up + _slack >= double(w.lo) and _low - _slack <= double(w.hi))").select("region", "row", "label", "vector", "windows")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, margin: int = 80, scale: int = 256) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score
    is at least ``margin`` per cent of the positive's, and at most all of it.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. ``vectors`` has vec_id, label,
    embedding; ``anchors`` tells by vec_id which rows ask.
    """
    rows = points(vectors, scale)
    placed = tile(rows)
    walls = boxes(placed)
    asking = placed.where(F.col("vec_id").isNotNull() & anchors)
    parts = max(1, -(-asking.count() // ANCHORS))
    everything = F.array(F.struct(F.lit(-_LAST).alias("lo"), F.lit(_LAST).alias("hi")))
    home = asking.select("region", "row", "label", "vector", everything.alias("windows"))
    near = materialize(_first(_search(placed, home, True, positives, parts), positives))
    # The k-th score at home, where there are so many, prunes the other regions.
    kth = near.where(F.col("rank") == positives).select("row", F.col("score").alias("kth"))
    told = home.withColumnRenamed("region", "home").join(kth, "row", "left").withColumn("windows", F.array(F.struct(
        F.coalesce("kth", F.lit(-_LAST)).alias("lo"), F.lit(_LAST).alias("hi"))))
    away = _visits(told.select("home", "row", "label", "vector", "windows"), walls, True).join(
        home.select("region", "row"), ["region", "row"], "left_anti")
    first = materialize(_first(near.drop("rank").unionByName(_search(placed, away, True, positives, parts)), positives))
    # A window per positive: scores are whole numbers, and none fits a negative one.
    window = F.struct("rank", F.expr(f"(decimal({margin}) * score + 99) div 100").cast("bigint").alias("lo"), F.col("score").alias("hi"))
    windows = first.where("score >= 0").groupBy("row").agg(F.array_sort(F.collect_list(window)).alias("_w")).select(
        "row", F.expr("transform(_w, w -> struct(w.lo AS lo, w.hi AS hi))").alias("windows"), F.expr("transform(_w, w -> w.rank)").alias("ranks"))
    asked = asking.select("row", "label", "vector").join(windows, "row")
    found = materialize(_first(_search(placed, _visits(asked, walls, False), False, negatives, parts), negatives))
    named = found.join(windows.select("row", "ranks"), "row").select(
        "row", F.get("ranks", F.col("win")).alias("_rank"), "rank", F.nullif("other_id", F.lit(_LAST)).alias("negative_id"), F.col("score").alias("negative_score"))
    matched = first.select("row", F.col("rank").alias("_rank"), F.nullif("other_id", F.lit(_LAST)).alias("positive_id"), F.col("score").alias("positive_score"))
    ids = asking.select("row", F.col("vec_id").alias("anchor_id"))
    return named.join(matched, ["row", "_rank"]).join(ids, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# As the query applies it: anchors by hundreds, labels of every seventh row moved on.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT ar, anchor_id, br, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id, br) <= 5),
neg AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other_id, n.br) AS INTEGER) AS rank
  FROM pos p JOIN pairs n ON n.ar = p.ar AND NOT n.same
   AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
