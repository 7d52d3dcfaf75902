"""Exact similarity join of shingle sets: Voronoi regions of pivots in the Jaccard metric.

Documents link when the Jaccard similarity of their sets of shingles (``length`` words in a row; a shorter text is one
shingle) is at least ``near`` per cent, that is, when their Jaccard distance, a metric, is at most 1 - near / 100. In a space
of so many dimensions nearly all documents are about 1 apart, where no triangle inequality tells them apart, so those that can
have no partner are told first:

* A partner lacks at most 100 - near per cent (``_lost``) of a set's shingles. Of the least hashes of a set, that many and
  ``_extra`` more, at least ``_extra`` must therefore be shared with other documents. Counts of these hashes leave few *suspects*.
* Suspects are put into *regions*: in the global order of shingles, rare ones first, the first shingle that two partners have in
  common is among the first ``_lost + 1`` of either. A region holds the sets that have one such shingle in front.

Where a region's shingle stands in the orders of two members bounds what they share, as it is the first that they have in common; else another
region joins them. So members *meet* only if enough follows in both. The member that least of the rare shingles precede is near the
middle of a group of near copies; in a first round all others meet it, and most of the group is one component. In a second one those outside
a region's most frequent component, ``DRAWS`` at most, meet those of other components, and more of them in further rounds as long as few pairs meet.

Other regions join recursively. Each round draws pivots in every region and computes the distance of each member to them. A member
within the join distance of a pivot is linked to it. A member belongs to the cell of its nearest pivot and, where it
is nearly as close to another one (triangle inequality: within twice the join distance), to that cell too. Members far from every
pivot form an outer cell, joined by those near its boundary. Cells are the regions of the next round, without the
pivots, which have met everyone. Where cells overlap too much to be a division, the region goes on whole, without its pivots. A region
whose members are already connected is done, as components only are asked for, regions of the same members are joined once, and
pivots are drawn outside a region's most frequent component; so a large group of near copies ends after a round or two and
never becomes pairs.

Equal sets are one point of the space. Null and empty texts have no shingles and are linked with nothing. Repeated rows are equal
sets. An empty table gives an empty result. A null ``doc_id`` takes part, and gives way to any other as the least of its
component. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import slices, whole_text
from leadspark.operators.components import connected_components
from leadspark.operators.staging import materialize, release, scratch

# Words per shingle and least similarity in per cent, unless a caller names others.
SHINGLE = 3
NEAR = 90
# Pivots per region of the second round.
DRAWS = 1024
# Pivots per region grow by this factor from round to round.
MORE = 16
# A region is divided into its cells if these have at most so many times its members.
OVERLAP = 1.25
SLAB = 1 << 20

_GAPS = np.zeros(256, bool)
_GAPS[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(90).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def _lost(n, near):
    """Shingles of a set of n that a partner may lack."""
    return n * (100 - near) // 100


def _extra(n, near):
    return _lost(n, near) + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        up, down = np.full(2 * n, _BASE, np.uint64), np.full(2 * n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts laid end to end, and the number of words up to each text's end."""
    gap = _GAPS[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = gap[:-1]
    fresh[ends[ends < len(data)]] = True
    starts = np.flatnonzero(~gap & fresh)
    last = np.ones(len(data), bool)
    last[:-1] = gap[1:]
    last[ends[ends > 0] - 1] = True
    stops = np.flatnonzero(~gap & last) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[:len(data)], out=sums[1:])
    return _mixed((sums[stops] - sums[starts]) * down[starts]), np.searchsorted(starts, ends)


def _grams(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` words in a row."""
    a, b, c = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    grams = words[length - 1:] * c
    for k in range(length - 2, -1, -1):
        grams = _mixed(words[k:k + len(grams)] * (b if k else a) + grams)
    return grams if length > 1 else _mixed(grams)


def shingle_sets(texts: list[bytes], length: int = SHINGLE):
    """The distinct shingle hashes of each text, sorted."""
    first = 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (stop == first or size + len(texts[stop]) <= SLAB):
            size += len(texts[stop])
            stop += 1
        part = texts[first:stop]
        data = np.frombuffer(b"".join(part), np.uint8)
        words, upto = word_hashes(data, np.cumsum([len(t) for t in part])) if len(data) else (np.zeros(0, np.uint64), np.zeros(len(part), int))
        grams = _grams(words, length)
        begin = 0
        for end in upto.tolist():
            n = end - begin
            if n >= length:
                yield np.unique(grams[begin:end - length + 1])
            elif n:
                yield _grams(words[begin:end], n)
            else:
                yield words[:0]
            begin = end
        first = stop


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64), pa.int64()))


def suspects(texts: DataFrame, length: int, near: int) -> tuple[DataFrame, DataFrame]:
    """One row per text with the size and 128-bit checksum (hi, lo) of its set, and the ``lo`` of sets that may have a partner.

    ``texts`` has id, tie, doc_id and text (bytes).
    """
    def measure(batches):
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column(3).to_pylist(), length))
            marks = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8") for s in sets]
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n), pa.array([int(m[0]) for m in marks], pa.int64()), pa.array([int(m[1]) for m in marks], pa.int64()),
                 _arrays([s[:_lost(len(s), near) + _extra(len(s), near)] for s in sets])], names=["id", "tie", "doc_id", "n", "hi", "lo", "least"])

    sized = materialize(texts.select("id", "tie", "doc_id", "text").mapInArrow(
        measure, "id bigint, tie bigint, doc_id bigint, n bigint, hi bigint, lo bigint, least array<bigint>"))
    least = sized.select("lo", "n", F.explode("least").alias("hash"))
    # Written, so that both sides of the join are shuffled for it and a hot key can be split.
    common = materialize(least.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1").select("hash"))
    # Two partners share what the smaller one has to; it has ``near`` per cent of this set's shingles at least.
    need = F.expr(f"((n * {near} + 99) div 100 * {100 - near} div 100) + 1")
    found = least.join(common, "hash").groupBy("lo", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= need)
    return sized.drop("least"), found.select("lo").distinct()


def _regions(sets: DataFrame, near: int) -> DataFrame:
    """(region, sid, n, after, lead): the shingles that stand first in each set's rare-first order and in that of another set.

    ``after`` counts the region's shingle and those behind it: what follows a pair's first common shingle bounds how much they share. ``lead`` marks members of whom enough follows for a partner of
    their own size or more; the smaller of two partners has it, so members without it need not meet each other.
    """
    def listed(batches):
        for batch in slices(batches):
            hashes = [np.frombuffer(data, np.uint64) for data in batch.column(1).to_pylist()]
            which = np.repeat(batch.column(0).to_numpy(), [len(h) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64), pa.int64())],
                                             names=["sid", "hash"])

    rows = materialize(sets.select("sid", "shingles").mapInArrow(listed, "sid bigint, hash bigint"))
    common = materialize(rows.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1"))
    # Shingles of one set alone come first in its order and link it to nobody: their number shortens the rest.
    order = rows.join(common, "hash").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("order"))
    # The place of a shingle in the whole order, and how many of the set it and its followers are.
    alone = F.col("n") - F.size("order")
    front = order.join(sets.select("sid", "n"), "sid").select("sid", "n", alone.alias("_alone"), F.posexplode(F.slice("order", 1, F.greatest(
        F.lit(0), (F.expr(f"n * {100 - near} div 100") + 1 - alone).cast("int")))).alias("_at", "_s")).select(
        F.col("_s")["hash"].alias("region"), "sid", "n", (F.col("n") - F.col("_alone") - F.col("_at")).alias("after"))
    return materialize(front.withColumn("lead", F.col("after") * (100 + near) >= 2 * near * F.col("n")))


def _distances(pairs: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """(sid, pivot, distance, linked) of pairs of sets; links are told in whole numbers."""
    def measure(batches):
        for batch in slices(batches):
            out, linked = [], []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                out.append(1 - both / union)
                linked.append(100 * both >= near * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array(linked, pa.bool_())],
                                             names=["sid", "pivot", "distance", "linked"])

    pivots = sets.select(F.col("sid").alias("pivot"), F.col("shingles").alias("other"))
    both = pairs.join(pivots, "pivot").join(sets.select("sid", "shingles"), "sid").select("sid", "pivot", "shingles", "other")
    return materialize(both.mapInArrow(measure, "sid bigint, pivot bigint, distance double, linked boolean"))


def _meet_round(members: DataFrame, sets: DataFrame, draws: int, near: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs that met and their links, of members with up to ``draws`` pivots a region, those that most follows in, and the members of regions with more to draw.

    ``members`` has region, sid, n, after, lead, component, minor and the number of a region's ``minors``. Only members of different
    components whose followers suffice for a link are compared.
    """
    draw = F.when(F.col("minors") <= draws, F.col("sid")).otherwise(F.pmod(F.xxhash64("sid"), F.lit(draws)))
    ahead = F.struct(F.col("after") - F.col("n"), F.col("after"), -F.col("sid"))
    pivots = materialize(members.where("minor").groupBy("region", draw.alias("draw")).agg(
        F.max_by(F.struct(F.col("sid").alias("pivot"), F.col("n").alias("m"), F.col("after").alias("left"), F.col("component").alias("home")), ahead).alias("_p"))
        .select("region", "_p.*"))
    met = members.join(pivots, (members["region"] == pivots["region"]) & (F.col("component") != F.col("home")) & (
        F.least("after", "left") * (100 + near) >= near * (F.col("n") + F.col("m"))))
    pairs = materialize(met.select(F.least("sid", "pivot").alias("sid"), F.greatest("sid", "pivot").alias("pivot")).distinct())
    links = _distances(pairs, sets, near).where("linked").drop("linked")
    rest = members.where(F.col("minors") > draws).join(pivots.select("region", F.col("pivot").alias("sid")), ["region", "sid"], "left_anti")
    return pairs, links, rest.select("region", "sid", "n", "after", "lead")


def _join_round(members: DataFrame, sets: DataFrame, draws: int, seed: int, near: int) -> tuple[DataFrame, DataFrame]:
    """Links found with this round's pivots, and the members of the next round's regions, from rows of (region, sid, lead, minor)."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "sid"), F.lit(draws))
    pivots = materialize(members.where("minor").groupBy("region", draw.alias("draw")).agg(F.min("sid").alias("pivot")).select("region", "pivot"))
    met = materialize(members.select("region", "sid", "lead").join(pivots, "region").where("sid <> pivot"))
    eps = (100 - near) / 100
    reach = 3 * eps
    # Sets of so different sizes that their distance is beyond any window are not compared.
    sizes = sets.select("sid", "n")
    pairs = met.select("sid", "pivot").distinct().join(sizes, "sid").join(sizes.select(F.col("sid").alias("pivot"), F.col("n").alias("m")), "pivot")
    measured = _distances(pairs.where(1 - F.least("n", "m") / F.greatest("n", "m") <= reach + eps + 1e-9).select("sid", "pivot"), sets, near)
    links = measured.where("linked").drop("linked")
    # Pivots have met their whole region; the others go on.
    rest = met.join(pivots.select("region", F.col("pivot").alias("sid")), ["region", "sid"], "left_anti")
    known = materialize(rest.join(measured.drop("linked"), ["sid", "pivot"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0))))
    home = materialize(known.groupBy("region", "sid").agg(F.min("distance").alias("nearest"), F.max("lead").alias("lead")))
    cells = known.drop("lead").join(home, ["region", "sid"]).where(
        (F.col("nearest") <= reach) & (F.col("distance") <= F.col("nearest") + 2 * eps + 1e-9)).select(
        "region", "sid", "lead", F.xxhash64("region", "pivot").alias("cell"))
    outer = home.where(F.col("nearest") > reach - eps - 1e-9).select("region", "sid", "lead", F.xxhash64("region", F.lit("outer")).alias("cell"))
    parts = materialize(cells.unionByName(outer))
    # Where the cells overlap too much to be a division, the region goes on whole.
    placed = parts.groupBy("region").agg(F.count("*").alias("_placed"))
    divided = home.groupBy("region").agg(F.count("*").alias("_all")).join(placed, "region").select(
        "region", (F.col("_placed") <= OVERLAP * F.col("_all")).alias("divided"))
    whole = home.join(divided.where("not divided"), "region").select("region", "sid", "lead")
    return links, whole.unionByName(parts.join(divided.where("divided"), "region").select(F.col("cell").alias("region"), "sid", "lead"))


def _labels(found: DataFrame) -> DataFrame:
    """(sid, component): the least set within three links. Equal labels mean connected; unequal ones only cost comparisons."""
    both = materialize(found.select("sid", "pivot").unionByName(found.select(F.col("pivot").alias("sid"), F.col("sid").alias("pivot"))))
    label = both.groupBy("sid").agg(F.least(F.min("pivot"), F.col("sid")).alias("component"))
    for _ in range(2):
        step = both.join(label.select(F.col("sid").alias("pivot"), F.col("component").alias("there")), "pivot")
        label = step.groupBy("sid").agg(F.min("there").alias("near")).join(label, "sid").select(
            "sid", F.least("near", "component").alias("component"))
    return materialize(label)


def _open_regions(members: DataFrame, found: DataFrame | None, once: bool = False) -> DataFrame:
    """``members`` of regions that are not one component yet, with component, minor and the number of ``minors`` of the region.

    Only ``minor`` members need to be pivots. A link has a leading member, and members of one component need not meet, so it is enough that
    all leading members are pivots, or all members outside the region's most frequent component, whichever are fewer; a region without
    leading members is done. Before there are links, every member stands alone. With ``once`` regions of the same members are one.
    """
    if found is None:
        counts = members.groupBy("region").agg(F.count("*").alias("all"), F.count_if("lead").alias("minors")).where("all > 1 and minors > 0")
        return materialize(members.join(counts.drop("all"), "region").withColumns({"component": F.col("sid"), "minor": F.col("lead")}))
    known = materialize(members.join(_labels(found), "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    shares = known.groupBy("region", "component").agg(F.count("*").alias("n"), F.count_if("lead").alias("leads"))
    kept = shares.groupBy("region").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("components"),
                                        F.sum("n").alias("all"), F.sum("leads").alias("leads")).where("components > 1 and leads > 0")
    if once:
        mark = F.xxhash64("sid", "lead").cast("decimal(38,0)")
        sums = known.groupBy("region").agg(F.count("*").alias("size"), F.sum(mark).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "sid", "lead")).alias("xor"))
        kept = kept.join(sums, "region").groupBy("size", "sum", "xor").agg(
            F.min_by("main", "region").alias("main"), F.min("region").alias("region"), F.first("all").alias("all"), F.first("leads").alias("leads"))
    others = F.col("all") - F.col("main")["n"]
    minor = F.when(others < F.col("leads"), F.col("component") != F.col("main")["component"]).otherwise(F.col("lead"))
    return materialize(known.join(kept.select("region", "main", "all", "leads"), "region").select(
        *members.columns, "component", minor.alias("minor"), F.least(others, "leads").alias("minors")))


def links(sets: DataFrame, near: int) -> DataFrame | None:
    """(sid, pivot, distance): links enough to connect whatever is linked, from rows of (sid, n, shingles); None if there are none."""
    members, found, draws, seed, meeting = _regions(sets, near), None, 1, 0, True
    while True:
        members = _open_regions(members, found, once=not meeting)
        if members.isEmpty():
            return found
        with scratch(sets.sparkSession) as keep:
            if meeting:
                pairs, new, rest = _meet_round(members, sets, draws, near)
                # Where a round meets more pairs than there are members, what follows tells too few apart.
                meeting = found is None or pairs.count() <= members.count()
                draws = DRAWS if found is None else draws * MORE if meeting else MORE
            else:
                new, rest = _join_round(members, sets, draws, seed, near)
                draws, seed = draws * MORE, seed + 1
            before = found, members
            found = keep(new if found is None else found.unionByName(new))
            members = keep(rest if meeting else rest.select("region", "sid", "lead"))
        release(*before)


def near_components(docs: DataFrame, text: str = "text", length: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the least ``doc_id`` reachable by links, for every row of ``docs``.

    Besides, ``id`` and ``tie`` (the row's key) and ``stays``: whether the row is the first of its component.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, text, length, near))


def _components(docs: DataFrame, text: str, length: int, near: int) -> DataFrame:
    data = whole_text(text).cast("binary")
    doc_id = F.col("doc_id").cast("bigint")
    texts = docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(data).alias("tie"), doc_id.alias("doc_id"), data.alias("text"))
    sized, suspected = suspects(texts, length, near)
    points = sized.where("n > 0").join(suspected, "lo").groupBy("hi", "lo", "n").agg(F.min(F.struct("id", "tie")).alias("one"))
    points = materialize(points.withColumn("sid", F.monotonically_increasing_id()).select("sid", "hi", "lo", "n", "one.*"))

    def gather(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([s.tobytes() for s in shingle_sets(batch.column(2).to_pylist(), length)], pa.binary())],
                                             names=["sid", "n", "shingles"])

    sets = materialize(texts.select("id", "tie", "text").join(points.select("id", "tie", "sid", "n"), ["id", "tie"]).select("sid", "n", "text")
                       .mapInArrow(gather, "sid bigint, n bigint, shingles binary").dropDuplicates(["sid"]))
    found = links(sets, near)
    if found is None:
        group = points.select("hi", "lo", F.col("sid").alias("component")).limit(0)
    else:
        label = connected_components(found.select(F.lit("").alias("file_id"), F.col("sid").alias("a"), F.col("pivot").alias("b")))
        group = points.select("sid", "hi", "lo").join(label.select(F.col("vertex").alias("sid"), "component"), "sid").select("hi", "lo", "component")
    # A set's group is its component, or the set itself.
    def place(kind: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))

    row = F.struct(F.col("doc_id").isNull().alias("later"), "id", "tie")
    rows = materialize(sized.join(group, ["hi", "lo"], "left").select("id", "tie", "doc_id", "n", F.when(
        F.col("n") == 0, place(0, F.col("id"), F.col("tie"))).when(F.col("component").isNotNull(), place(1, F.col("component"), F.lit(0))).otherwise(
        place(2, F.col("hi"), F.col("lo"))).alias("group")))
    least = rows.groupBy("group").agg(F.min("doc_id").alias("least"), F.min(row).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = rows.join(least.withColumnRenamed("group", "_group"), F.col("group") == F.col("_group"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "id", "tie",
                         F.coalesce(row == F.col("_first"), F.lit(True)).alias("stays"))


def one_of_each(docs: DataFrame, text: str = "text", length: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """``docs`` with one row of each component: that of least ``doc_id`` (null last), and of least text hash among equal ids.

    Rows without shingles are components of their own; rows repeated exactly count once.
    """
    data = whole_text(text).cast("binary")
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), "_tie": F.xxhash64(data)})
    staying = near_components(docs, text, length, near).where("stays").select(F.col("id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    return keyed.join(staying, ["_id", "_tie"]).dropDuplicates(["_id", "_tie"]).select(*docs.columns)
