"""Shards of equal size that keep linked documents together: balanced label propagation.

Documents are linked through a group (here: equal texts); a group of n documents stands for all links among them and is
never expanded into pairs. Groups above a part (``LARGE``) of a shard are few; they are planned first, largest first, and fill as many
shards as they need, one after the other. The others start dealt by falling size, forth and back over the shards' room, which is
balanced but blind. In each round every such group counts its members per shard and wishes for the shard that holds most of them and
has room for all, or else for any with room (Ugander and Backstrom, "Balanced Label Propagation for Partitioning Massive Graphs",
2013). A shard admits wishes whole, in order of a hash, up to a quota: its even share less the groups it has admitted already;
all other documents are mere filling, which makes room afterwards. Rounds end when none admits anything; the groups that then fit
nowhere stay as they were dealt. At last shards above the even share hand documents to those below, unlinked ones first.

Quotas are met by cells: wishes are summed per shard and hash bucket, a running sum over these sums (``CELLS`` per shard at most,
whatever the input) finds how far a shard may admit. The driver holds a few numbers per shard and per large group. Sizes thus come out
equal up to about one document or 1/CELLS of a shard.

Null sizes count as none, a null group means no links. Repeated rows are sharded each by itself. A table with fewer documents
than shards leaves shards empty. An empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.common import running_totals
from leadspark.operators.staging import materialize

CELLS = 4096
EVENINGS = 4
# A group above this part of a shard is planned ahead; there are at most shards / LARGE of them.
LARGE = 1 / 16


def _bucket(seed: int, *keys) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(CELLS)).cast("int")


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = dict(map(tuple, state.groupBy("shard").agg(F.sum("size")).collect()))
    return [int(found.get(s) or 0) for s in range(shards)]


def _spread(items: DataFrame, turns: list[int]) -> DataFrame:
    """Deal rows by falling size, forth and back over the shards of ``turns``."""
    ordered = running_totals(items.withColumn("_one", F.lit(1)), [], [F.col("size").desc(), F.col("group"), F.col("doc_id")], "_one", "_at")
    turn = F.pmod(F.col("_at"), F.lit(2 * len(turns)))
    at = F.least(turn, 2 * len(turns) - 1 - turn).cast("int")
    return ordered.withColumn("shard", F.get(F.array(*[F.lit(t) for t in turns]), at)).drop("_one", "_at")


def _plan(large: list[tuple], free: list[float]) -> list[tuple]:
    """(group, from, until, shard): which bytes of each large group go where; takes them off ``free``."""
    pieces = []
    for group, weight in sorted(large, key=lambda g: (-g[1], str(g[0]))):
        done = 0.0
        while done < weight:
            left = weight - done
            fits = [s for s, x in enumerate(free) if x >= left]
            to = min(fits, key=free.__getitem__) if fits else max(range(len(free)), key=free.__getitem__)
            # Rounding may leave a rest when all is full.
            take = left if fits or free[to] < 1 else free[to]
            pieces.append((group, done, done + take, to))
            free[to] -= take
            done += take
        pieces[-1] = (group, pieces[-1][1], float("inf"), pieces[-1][3])
    return pieces


def _turns(free: list[float]) -> list[int]:
    """Shards in turn, as often as they have room."""
    room = [max(0.0, x) for x in free]
    if min(room) == max(room):
        return list(range(len(free)))
    often = [round(16 * len(free) * x / sum(room)) for x in room]
    return [s for _, s in sorted(((k + 0.5) / n, s) for s, n in enumerate(often) for k in range(n))]


def _propagate(linked: DataFrame, free: list[float]) -> DataFrame | None:
    """(_group, to): the shards of the groups that fit into one; None if none does. Rows have group, shard and size."""
    held = linked.groupBy("group", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # At most one entry per shard.
    most = F.sort_array(F.collect_list(F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")), asc=False)
    waiting = materialize(held.groupBy("group").agg(most.alias("held"), F.sum("bytes").alias("weight")))
    shards, placed, seed, idle = len(free), None, 0, 0
    while idle < 2:
        room = _numbers(free)
        near = F.get(F.filter("held", lambda h: F.get(room, h["shard"]) >= F.col("weight")), F.lit(0))["shard"]
        able = F.filter(F.array(*[F.lit(s) for s in range(shards)]), lambda s: F.get(room, s) >= F.col("weight"))
        other = F.get(able, F.pmod(F.xxhash64(F.lit(seed), "group", F.lit("other")), F.greatest(F.size(able), F.lit(1))).cast("int"))
        wished = materialize(waiting.withColumn("wish", F.coalesce(near, other)).where("wish is not null").withColumn("_bucket", _bucket(seed, "group")))
        cells = wished.groupBy("wish", "_bucket").agg(F.sum("weight").alias("_bytes"))
        total = F.sum("_bytes").over(Window.partitionBy("wish").orderBy("_bucket"))
        admitted = cells.withColumn("_total", total).where(F.col("_total") <= F.get(room, F.col("wish")))
        ends = {r[0]: (r[1], r[2]) for r in admitted.groupBy("wish").agg(F.max("_bucket"), F.max("_total")).collect()}
        until = F.get(F.array(*[F.lit(ends.get(s, (-1, 0))[0]) for s in range(shards)]), F.col("wish"))
        if ends:
            new = wished.where(F.col("_bucket") <= until).select(F.col("group").alias("_group"), F.col("wish").alias("to"))
            placed = new if placed is None else placed.unionByName(new)
            free = [x - ends.get(s, (0, 0))[1] for s, x in enumerate(free)]
        # Room only shrinks, so a group that found none is out.
        waiting = wished.where(F.col("_bucket") > until).drop("wish", "_bucket")
        if waiting.isEmpty():
            break
        seed, idle = seed + 1, 0 if ends else idle + 1
    return placed


def _even_out(state: DataFrame, shards: int, seed: int) -> DataFrame:
    """Hand documents from shards above the even share to those below; at last those of groups that were placed."""
    loads = _loads(state, shards)
    even = sum(loads) / shards
    above = [max(0.0, x - even) for x in loads]
    below = [max(0.0, even - x) for x in loads]
    mine = F.get(_numbers(above), F.col("shard"))
    able = state.withColumn("_bucket", F.when(F.col("size") <= mine, _bucket(seed, "group", "doc_id") + F.when(
        F.col("settled"), 2 * CELLS).when(F.col("linked"), CELLS).otherwise(0)))
    cells = able.where("_bucket is not null").groupBy("shard", "_bucket").agg(F.sum("size").alias("_bytes"))
    total = F.sum("_bytes").over(Window.partitionBy("shard").orderBy("_bucket"))
    leaving = materialize(cells.withColumn("_total", total).where(F.col("_total") <= mine))
    handed = dict(map(tuple, leaving.groupBy("shard").agg(F.max("_total")).collect()))
    # All that leaves stands in one line, by shard and bucket, and is poured into the shards below one after the other.
    before = [0, *accumulate(int(handed.get(s) or 0) for s in range(shards))][:shards]
    poured = before[-1] + int(handed.get(shards - 1) or 0)
    scale = poured / sum(below) if sum(below) else 0.0
    ends = list(accumulate(b * scale for b in below))
    middle = F.get(_numbers(before), F.col("shard")) + F.col("_total") - F.col("_bytes") / 2
    to = F.least(F.size(F.filter(_numbers(ends), lambda e: e <= middle)), F.lit(shards - 1))
    moves = leaving.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), to.cast("int").alias("_to"))
    return able.join(moves, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left").withColumn(
        "shard", F.coalesce("_to", "shard")).drop("_bucket", "_s", "_b", "_to")


def assign(items: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard, by ``doc_id``) to rows of ``doc_id``,
    ``size`` and ``group``. Other columns are carried along; any of the names added is replaced."""
    # They travel under names of their own, which clash with nothing here.
    held = {c: f"_own_{i}" for i, c in enumerate(items.columns) if c not in ("doc_id", "size", "group", "shard", "slot")}
    items = items.select("doc_id", "size", "group", *[F.col(c).alias(h) for c, h in held.items()])
    sized = items.withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint"))
    sizes = sized.groupBy("group").agg((F.count("*") > 1).alias("linked"), F.sum("size").alias("weight")).select(
        F.col("group").alias("_g"), "linked", "weight")
    known = materialize(sized.join(sizes, F.col("group") == F.col("_g"), "left").withColumn("linked", F.coalesce("linked", F.lit(False))).drop("_g"))
    even = (known.agg(F.sum("size")).first()[0] or 0) / shards
    large = F.col("linked") & (F.col("weight") > even * LARGE)
    free = [even] * shards
    pieces = _plan([tuple(r) for r in known.where(large).groupBy("group").agg(F.first("weight")).collect()], free)
    state = _spread(materialize(known.where(~large | large.isNull())), _turns(free)).withColumn("settled", F.lit(False))
    if pieces:
        kind = items.schema["group"].dataType.simpleString()
        ranges = F.broadcast(items.sparkSession.createDataFrame(pieces, f"_g {kind}, _from double, _until double, shard int"))
        middle = F.col("_before") + F.col("size") / 2
        run = running_totals(materialize(known.where(large)), ["group"], [F.col("doc_id")], "size", "_before")
        state = state.unionByName(run.join(ranges, (F.col("group") == F.col("_g")) & (middle >= F.col("_from")) & (middle < F.col("_until"))).drop(
            "_before", "_g", "_from", "_until").withColumn("settled", F.lit(True)))
    state = materialize(state)
    placed = _propagate(state.where("linked and not settled"), free)
    if placed is not None:
        state = materialize(state.join(placed, (F.col("group") == F.col("_group")) & ~F.col("settled"), "left").withColumns(
            {"shard": F.coalesce("to", "shard"), "settled": F.col("settled") | F.col("to").isNotNull()}).drop("_group", "to"))
    for seed in range(EVENINGS):
        state = materialize(_even_out(state, shards, 100 + seed))
    one = state.drop("linked", "weight", "settled").withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, ["shard"], [F.col("doc_id"), F.col("group")], "_one", "slot").select(
        "doc_id", "size", "group", *[F.col(h).alias(c) for c, h in held.items()], "shard", "slot")
