"""Document fingerprints: one-permutation MinHash, optimally densified, stored as packed low-order bits.

The distinct word shingles of a text are hashed once; the top bits of a hash name its bin and the least hash of each bin
is kept. An empty bin takes the value of a filled one, found along the bin's own probe sequence (Shrivastava, "Optimal
Densification for Fast and Accurate Minwise Hashing", 2017), so two texts that lack the same bin borrow alike. Each
value is hashed with its bin, so that copies of one value give independent bits, of which the low ``BITS`` bits stay (Li and Koenig, "b-Bit Minwise Hashing", 2010); unlike hashes agree in them with
probability 2 ** -BITS, which ``likeness`` corrects for.

Everything is a DataFrame expression. A text of fewer than ``SHINGLE`` words has its whole sequence of words as its one
shingle; a text without words, or null, has the empty fingerprint, which is like itself (1) and unlike any other (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import GAPS, running_totals, whole_text
from leadspark.operators.staging import materialize

SHINGLE = 5
BINS = 256
BITS = 4
# Probes of a bin before it falls back to the filled bin of least probe hash.
PROBES = 8
_IN_WORD = 64 // BITS
_SHIFT = 64 - (BINS - 1).bit_length()
# The low bit of every code in a packed word.
_LOW = sum(1 << (BITS * i) for i in range(_IN_WORD))
_SPACES = " \t\n\x0b\x0c\r"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _probe(bin_no: Column, filled: Column) -> Column:
    """The value that an empty bin takes: the first filled bin of its probes, else the one of least hash with it."""
    tries = [F.get(filled, F.pmod(F.xxhash64(bin_no, F.lit(j)), F.lit(BINS)).cast("int")) for j in range(PROBES)]
    ranked = F.transform(filled, lambda v, b: F.when(v.isNotNull(), F.struct(
        F.xxhash64(bin_no, b, F.lit(-1)).alias("rank"), v.alias("value"))))
    return F.coalesce(*tries, F.array_min(ranked)["value"])


def with_fingerprints(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Replace text columns by their fingerprints: packed words (array of BIGINT, empty for no words); new name by text column."""
    own = [c for c in df.columns if c not in texts]

    def step(frame: DataFrame, expression) -> DataFrame:
        return frame.select(*own, *[expression(F.col(new)).alias(new) for new in texts.values()])

    bounds = F.lit([_signed((b << _SHIFT) + (1 << _SHIFT) - 1) for b in range(BINS)])

    def words(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(_SPACES))
        return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(
            F.transform(F.split(trimmed, GAPS), lambda w: F.xxhash64(w)))

    def shingles(w: Column) -> Column:
        return (F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)),
                                                         lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))
                .when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))

    # The greatest hash of each bin joins the shingles, so that every bin has a least hash; that one marks it as empty.
    def ordered(s: Column) -> Column:
        return F.when(F.size(s) > 0, F.sort_array(F.concat(s, bounds)))

    def least(s: Column) -> Column:
        first = F.filter(s, lambda x, i: ~F.shiftright(x, _SHIFT).eqNullSafe(F.shiftright(F.get(s, i - 1), _SHIFT)))
        top = F.lit((1 << _SHIFT) - 1)
        return F.transform(first, lambda x: F.when(x.bitwiseAND(top) != top, x))

    def dense(filled: Column) -> Column:
        return F.transform(filled, lambda v, b: F.xxhash64(F.coalesce(v, _probe(b, filled)), b).bitwiseAND(
            F.lit((1 << BITS) - 1)))

    def packed(codes: Column) -> Column:
        return F.when(codes.isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.lit(BINS // _IN_WORD - 1)), lambda k: F.aggregate(
                F.slice(codes, k * _IN_WORD + 1, _IN_WORD), F.lit(0).cast("bigint"),
                lambda all_, c: F.shiftleft(all_, BITS).bitwiseOR(c))))

    frame = df.select(*own, *[F.col(old).alias(new) for old, new in texts.items()])
    for expression in (words, shingles, ordered, least, dense, packed):
        frame = step(frame, expression)
    return frame


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    def unlike(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in [1 << i for i in range(BITS.bit_length() - 1)]:
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(_LOW))).cast("int")

    differing = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda total, n: total + n)
    chance = 1.0 / (1 << BITS)
    estimate = (1 - differing / F.lit(float(BINS)) - chance) / (1 - chance)
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate))))


def compare_with_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare each with its own edit and with the next document.

    The edit replaces the last third of a text's code points by the first as many of the next document (by descending
    ``doc_id``, null last, texts of one id by hash; after the last comes the first). Repeated rows (equal id and text) are
    one document for this order and come out as often as they went in. Returns ``doc_id``, ``n_chars``,
    ``edited_sha256``, the packed fingerprints ``fp`` and ``edited_fp``, ``near_edited``, ``near_next``.

    The order is worked out on ids and lengths alone; whole texts are shuffled once, to their own key, and only the heads of
    texts a second time. One window over one row per partition turns partition sizes into positions.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    tie = F.xxhash64("text")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), tie.cast("string"))
    texts = base.select(key.alias("key"), "text")
    ids = base.select(key.alias("key"), "doc_id", tie.alias("tie"), F.length("text").cast("bigint").alias("n_chars"))
    ids = ids.groupBy("key", "doc_id", "tie", "n_chars").agg(F.count("*").alias("times")).withColumn("one", F.lit(1))
    ordered = materialize(running_totals(ids, [], [F.col("doc_id").desc_nulls_last(), F.col("tie")], "one", "at"))
    n = ordered.agg(F.count("*").alias("n")).first()["n"]
    follows = ordered.select(F.pmod(F.col("at") - 1, F.lit(max(n, 1))).alias("at"), F.col("key").alias("next_key"))
    order = materialize(ordered.join(follows, "at").select("key", "doc_id", "n_chars", "times", "next_key"))

    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("owner"), F.expr("n_chars div 3").cast("int").alias("m"))
    heads = (texts.join(wanted, "key").select("key", "owner", F.expr("substring(text, 1, m)").alias("head"))
             .dropDuplicates(["key", "owner"]).select(F.col("owner").alias("key"), "head"))
    both = texts.join(heads, "key").select(
        "key", "text", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), "head").alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    prints = materialize(with_fingerprints(both, {"text": "fp", "edited": "edited_fp"}).dropDuplicates(["key"]))

    rows = order.join(prints, "key").select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy"))
    after = prints.select(F.col("key").alias("next_key"), F.col("fp").alias("next_fp"))
    return rows.join(after, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
