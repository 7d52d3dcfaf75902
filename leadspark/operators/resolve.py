"""Probable duplicates: block on phone and e-mail, match names, close transitively.

Rows are first folded into *entities*, the rows of one block that share one canonical name. Folding is
a map-side combined aggregation, so a placeholder phone held by a third of all rows becomes a few entities
and never a group in one task. Similar names are found by an exact signature join (below), and the
component search runs over entities only.

Similarity join. ratio(x, y) >= t means that M = t (|x| + |y|) / 2 characters match at least and d = |x| + |y| - 2 M at most do not. The
matched ones stand in the same order in both names, so an unmatched one destroys two bigrams at most: the names share
M - 1 - d bigrams. Bigrams are put in one global order, rare ones first; of a name of n characters all but the last
n - 1 - (M - 1 - d) - 1 can then be missed, so any two of those first bigrams that both names have are a signature by which
they meet. A name has some thirty signatures whatever its length allows, and what meets is pruned by lengths and by a
mask of its letters (bits in which two masks differ are unmatched characters) before Spark's bounded edit distance, never above d
for a passing pair, and then the ratio. Where a threshold is too low for bigrams, single letters take their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import values
from leadspark.functions.similarity import similarity
from leadspark.operators.components import connected_components
from leadspark.operators.ordering import number_rows
from leadspark.operators.rows import col
from leadspark.operators.staging import materialize

BLOCK = ["file_id", "kind", "key"]
ENTITY = [*BLOCK, "canon"]
PHONE, EMAIL = 0, 1
KIND_NAMES = {PHONE: "phone ", EMAIL: "email "}


def block_keys(leads: DataFrame, quality: dict) -> DataFrame:
    """``(file_id, row, kind, key, canon)``: the blocks of each lead and its canonical name."""
    def optional(name: str) -> Column:
        return col(name) if name in leads.columns else F.lit(None).cast("string")

    phone, email = values.digits(optional("Phone Number")), F.lower(optional("Email"))
    usable = email.contains("@") & ~email.startswith("no@")
    keys = F.array_compact(F.array(
        F.when(phone != "", F.struct(F.lit(PHONE).alias("kind"), phone.alias("key"))),
        F.when(usable, F.struct(F.lit(EMAIL).alias("kind"), email.alias("key")))))
    canon = values.canonical_name(optional("Full Name"), quality.get("nicknames", {}))
    return leads.select("file_id", "row", canon.alias("canon"), F.explode(keys).alias("k")).select(
        "file_id", "row", "k.kind", "k.key", "canon")


def fold_entities(keys: DataFrame) -> DataFrame:
    """One row per block and canonical name: first row, last row, row count, and a vertex number.

    A row is in one phone and one e-mail entity at most, so (first row, kind) names an entity.
    """
    return keys.where("canon IS NOT NULL").groupBy(*ENTITY).agg(
        F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("n")
    ).withColumn("vertex", F.col("lo") * 2 + F.col("kind"))


def _budget(short: Column, long: Column, threshold: float) -> Column:
    """Most unmatched characters a passing pair of these lengths can have (same parity as the length gap)."""
    most = F.floor((short + long) * (1.0 - threshold) + 1e-9).cast("int")
    return most - F.pmod(most - (long - short), F.lit(2))


# Canonical names hold these characters alone.
LETTERS = " abcdefghijklmnopqrstuvwxyz"


def _partners(n: int, threshold: float) -> list[tuple[int, int]]:
    """(most unmatched characters, least matched ones) for every length that a different partner of a name of n characters can have."""
    out = []
    for other in range(int(n * threshold / (2 - threshold)), int(n * (2 - threshold) / threshold + 1e-9) + 1):
        d = int((n + other) * (1 - threshold) + 1e-9)
        d -= (d - (n - other)) % 2
        if d > 0 and d >= abs(n - other):
            out.append((d, (n + other - d) // 2))
    return out


def gram_width(threshold: float) -> int:
    """2 if all pairs of names that reach the threshold share a bigram, else 1. Longer names share more."""
    return 2 if all(m - 1 - d >= 1 for n in range(1, 60) for d, m in _partners(n, threshold)) else 1


def _codes(width: int) -> Column:
    """The grams of ``canon``, in place order, as numbers whose digits are the places of their letters in the alphabet."""
    letters = f"transform(split(canon, ''), c -> instr('{LETTERS}', c) - 1)"
    if width == 1:
        return F.expr(letters)
    return F.expr(f"transform(sequence(1, length(canon) - 1), i -> element_at({letters}, i) * {len(LETTERS)} + element_at({letters}, i + 1))")


def _mask() -> Column:
    """Two bits per letter: whether the name has it once, and twice. Each bit in which two names differ is an unmatched character."""
    held = [f"least(2, length(canon) - length(replace(canon, '{c}', '')))" for c in LETTERS]
    return F.expr(" + ".join(f"shiftleft(bigint(array(0, 1, 3)[{h}]), {2 * k})" for k, h in enumerate(held)))


def _rarity(names: DataFrame, width: int) -> list[int]:
    """The place of every gram in the global order, rare ones first. There are as many as the alphabet allows, 729 at most."""
    counts = dict(map(tuple, names.select(F.explode("codes").alias("g")).groupBy("g").count().collect()))
    ordered = sorted(range(len(LETTERS) ** width), key=lambda g: (counts.get(g, 0), g))
    place = [0] * len(ordered)
    for k, g in enumerate(ordered):
        place[g] = k
    return place


def signatures(entities: DataFrame, threshold: float) -> DataFrame:
    """(sig, block, file_id, vertex, canon, n, mask): names of blocks that hold several, once for each of their signatures."""
    width = gram_width(threshold)
    several = entities.groupBy(*BLOCK).agg(F.count("*").alias("_names")).where("_names > 1").drop("_names")
    stretch = (2.0 - threshold) / threshold
    n = F.length("canon")
    names = materialize(entities.join(several, BLOCK).where(n > width - 1).select(
        "file_id", F.xxhash64(*BLOCK).alias("block"), "vertex", "canon", n.alias("n"), _mask().alias("mask"), _codes(width).alias("codes")))
    # For every length of a partner: unmatched characters d, matched ones, and so grams in common.
    partner = F.transform(F.sequence(F.ceil(F.col("n") / stretch - 1e-9).cast("int"), F.floor(F.col("n") * stretch + 1e-9).cast("int")), lambda other: F.struct(
        other.alias("other"), _budget(F.least(F.col("n"), other), F.greatest(F.col("n"), other), threshold).alias("d")))
    partner = F.filter(partner, lambda p: (p["d"] > 0) & (p["d"] >= F.abs(F.col("n") - p["other"])))
    common = F.transform(partner, lambda p: ((F.col("n") + p["other"] - p["d"]) / 2).cast("int") - (width - 1) * (1 + p["d"]))
    place = F.lit(_rarity(names, width))
    # The k-th of equal grams of a name is a token of its own.
    ranked = F.expr(f"transform(codes, (g, i) -> struct(get(_place, g) AS place, size(filter(slice(codes, 1, i), h -> h = g)) AS time))")
    tokens = names.withColumns({"_common": common, "_place": place}).where("size(_common) > 0").withColumn("_tokens", F.array_sort(ranked))
    # Two of the first so many tokens are shared, or, where names may share one only, one of the first.
    tokens = tokens.withColumns({
        "_two": F.expr("slice(_tokens, 1, size(_tokens) + 2 - greatest(2, array_min(_common)))"),
        "_one": F.expr("if(array_min(_common) < 2, slice(_tokens, 1, size(_tokens) + 1 - greatest(1, array_min(_common))), slice(_tokens, 1, 0))")})
    pairs = F.expr("flatten(transform(_two, (x, i) -> transform(slice(_two, i + 2, size(_two)), y -> xxhash64(block, x, y))))")
    single = F.expr("transform(_one, x -> xxhash64(block, x))")
    return tokens.select(F.explode(F.concat(pairs, single)).alias("sig"), "block", "file_id", "vertex", "canon", "n", "mask")


def similar_candidates(entities: DataFrame, threshold: float) -> DataFrame:
    """Pairs of entities of one block whose names may reach the ratio: ``x`` and ``y``, in order of their vertices."""
    index = materialize(signatures(entities, threshold))
    x, y = (index.select("sig", "block", "file_id", *[F.col(c).alias(f"{c}_{side}") for c in ("vertex", "canon", "n", "mask")]) for side in "xy")
    most = F.floor((F.col("n_x") + F.col("n_y")) * (1.0 - threshold) + 1e-9).cast("int")
    met = x.join(y, ["sig", "block", "file_id"]).where(
        (F.col("vertex_x") < F.col("vertex_y")) & (F.abs(F.col("n_x") - F.col("n_y")) <= most)
        & (F.bit_count(F.col("mask_x").bitwiseXOR(F.col("mask_y"))) <= most) & (F.levenshtein("canon_x", "canon_y") <= most))
    found = met.select("file_id", F.col("vertex_x").alias("a"), F.col("vertex_y").alias("b")).distinct()
    record = entities.select("file_id", "vertex", F.struct(*BLOCK, "vertex", "canon", "lo", "hi").alias("record"))
    return found.join(record.select("file_id", F.col("vertex").alias("a"), F.col("record").alias("x")), ["file_id", "a"]).join(
        record.select("file_id", F.col("vertex").alias("b"), F.col("record").alias("y")), ["file_id", "b"]).select("file_id", "a", "b", "x", "y")


def similar_links(entities: DataFrame, threshold: float) -> DataFrame:
    """Entity pairs linked by at least one pair of rows. The ratio takes the earlier row's name first."""
    pairs = similar_candidates(entities, threshold)
    x, y = F.col("x"), F.col("y")
    forward = F.when(x["lo"] < y["hi"], x["canon"])
    backward = F.when(y["lo"] < x["hi"], y["canon"])
    rated = pairs.select("file_id", "a", "b", "x", "y",
                         (similarity(forward, y["canon"]) >= threshold).alias("_f"),
                         (similarity(backward, x["canon"]) >= threshold).alias("_b"))
    rated = rated.select("*", F.coalesce("_f", F.lit(False)).alias("forward"),
                         F.coalesce("_b", F.lit(False)).alias("backward"))
    return rated.where("forward OR backward").select(
        "file_id", "a", "b", F.col("x.kind").alias("kind"), F.col("x.key").alias("key"),
        F.col("x.canon").alias("canon_a"), F.col("y.canon").alias("canon_b"), "forward", "backward",
        F.col("x.hi").alias("hi_a"), F.col("y.hi").alias("hi_b"))


def duplicate_groups(leads: DataFrame, quality: dict) -> DataFrame:
    """Members of duplicate groups: ``(file_id, group, row, name, matched_on)``, one row per member.

    Groups are numbered per file by their first row; ``matched_on`` names the block that first matched it.
    """
    threshold = quality.get("name_fuzzy_threshold", 0.85)
    keys = materialize(block_keys(leads, quality))
    entities = materialize(fold_entities(keys))
    links = materialize(similar_links(entities, threshold))

    linked = links.select("file_id", F.col("a").alias("vertex")).unionByName(
        links.select("file_id", F.col("b").alias("vertex"))).distinct().withColumn("_linked", F.lit(True))
    useful = entities.join(linked, ["file_id", "vertex"], "left").where("n > 1 OR _linked")
    # each row meets at most one phone and one e-mail entity
    rows = keys.join(useful.select(*ENTITY, "vertex"), ENTITY).groupBy("file_id", "row").agg(
        F.min("vertex").alias("a"), F.max("vertex").alias("b"))
    rows = materialize(rows)
    edges = rows.where("a < b").select("file_id", "a", "b").distinct().unionByName(links.select("file_id", "a", "b"))
    labels = connected_components(edges).withColumnRenamed("vertex", "a")
    members = rows.join(labels, ["file_id", "a"], "left").select(
        "file_id", "row", F.floor(F.coalesce("component", "a") / 2).cast("bigint").alias("first_row"))
    members = materialize(members)

    firsts = members.select("file_id", "first_row").distinct()
    numbered = number_rows(firsts, ["file_id"], "first_row", "group")
    named = numbered.join(_matched_on(firsts, keys, entities, links), ["file_id", "first_row"], "left")
    names = leads.select("file_id", "row", col("Full Name").alias("name"))
    return members.join(named, ["file_id", "first_row"]).join(names, ["file_id", "row"]).select(
        "file_id", "group", "row", "name", "matched_on")


def _matched_on(firsts: DataFrame, keys: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """The block in which each group's first row met its first partner, blocks ordered by their first row."""
    own = keys.join(firsts.withColumnRenamed("first_row", "row"), ["file_id", "row"])
    starts = keys.groupBy(*BLOCK).agg(F.min("row").alias("_start"))
    named = links.select(*BLOCK, F.col("canon_a").alias("canon"), F.when(F.col("forward"), F.col("hi_b")).alias("hi")) \
        .unionByName(links.select(*BLOCK, F.col("canon_b").alias("canon"), F.when(F.col("backward"), F.col("hi_a")).alias("hi")))
    partners = named.groupBy(*ENTITY).agg(F.max("hi").alias("_reach"))
    candidates = (own.join(entities.select(*ENTITY, "n"), ENTITY).join(partners, ENTITY, "left")
                  .where((F.col("n") > 1) | (F.col("_reach") > F.col("row"))).join(starts, BLOCK))
    shown = F.concat(F.when(F.col("kind") == PHONE, KIND_NAMES[PHONE]).otherwise(KIND_NAMES[EMAIL]), F.col("key"))
    return candidates.groupBy("file_id", F.col("row").alias("first_row")).agg(
        F.min_by(shown, F.struct("_start", "kind")).alias("matched_on"))


def group_listing(members: DataFrame) -> DataFrame:
    """One row per group with its size and first row; the members stay in their own table."""
    return members.groupBy("file_id", "group").agg(
        F.min("row").alias("first_row"), F.count("*").alias("members"), F.min("matched_on").alias("matched_on"))
