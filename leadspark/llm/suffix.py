"""Removal of repeated strings, of bytes or of words, by sorting suffixes in buckets around a cover sample.

A symbol goes if it lies in a string of ``length`` symbols that also starts elsewhere, in the same text or another one. To know
which suffixes agree over that length it is not needed to sort them all at once:

* A *cover sample* of positions is fixed first. Like a difference cover it guarantees that two places that agree over
  the length have, at one and the same small shift, sample positions both; unlike residues of a modulus it is chosen by
  content (a position whose first ``name`` symbols hash least within some window), which needs an eighth of the positions.
  Each sample suffix gets the hash of its first symbols as its name; names that occur once end there.
* All suffixes that start at most one window before a sample suffix belong to the *bucket* of its name. One block of buckets is
  sorted at a time, by hashes of the strings from each start, which a short context around the sample
  position suffices to compute. Memory holds one block.
* Long ties, buckets with more members than ``BLOCK``, are split at random into blocks. A block settles what agrees
  inside it, and hands on one suffix of each tie it found and those without a partner, by ranges of neighbouring starts. What the
  strings from a range have in common meets over all blocks first; most ranges that reach into a text's own words end there. The
  suffixes of the others meet by their hash, in one more grouping.

Copies of a whole text are settled by their checksums, and only one copy takes part in the rest; equal contexts inside one
batch of texts are settled there. Texts are cut where the name hash says so, never at a fixed size; matches do not cross texts.

Null and empty texts have no bytes and lose none. Repeated rows are copies of each other, so all of their bytes go if the text is
long enough. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import GAPS, slices, whole_text
from leadspark.operators.staging import materialize, scratch

LENGTH = 400
BLOCK = 512
# Texts are hashed in slabs of about this many symbols, and contexts sorted in blocks of about this many rows.
SLAB = 1 << 20
ROWS = 1024

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_rng = np.random.default_rng(400)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2 ** 64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclasses.dataclass(frozen=True)
class Unit:
    """What strings consist of, bytes or words, and how long those are that go if they repeat."""

    length: int = LENGTH
    words: bool = False

    @property
    def name(self) -> int:
        """Symbols that a sample position is chosen and named by."""
        return max(1, self.length * 4 // 25)

    @property
    def window(self) -> int:
        return self.length - self.name + 1

    @property
    def before(self) -> int:
        return self.window - 1

    @property
    def context(self) -> int:
        return self.before + self.length

    @property
    def stride(self) -> int:
        """Neighbouring starts that are handed on together."""
        return -(-self.window // 8)

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u8" if self.words else "u1")

    def symbols(self, text: bytes) -> np.ndarray:
        """The text's bytes, or 64-bit hashes of its words."""
        if not self.words:
            return np.frombuffer(text, np.uint8)
        return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64)

    def size(self, text: Column) -> Column:
        """The number of symbols of a text column (binary)."""
        if not self.words:
            return F.octet_length(text)
        return F.size(F.filter(F.split(text.cast("string"), GAPS), lambda w: w != ""))

    def places(self, text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans of symbols as spans of bytes; a word goes with the white space after it."""
        if not self.words or not spans:
            return spans
        starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
        return [(starts[a], starts[b]) for a, b in spans]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of ``length`` along the last axis of ``data`` (bytes, or hashes of words)."""
    n = data.shape[-1]
    up, down = _POWERS.get(n)
    sums = np.zeros((*data.shape[:-1], n + 1), np.uint64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * up, axis=-1, out=sums[..., 1:])
    return _mixed((sums[..., length:] - sums[..., :-length]) * down[:n - length + 1])


def _sliding(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """``best`` over every window of ``width``: running values from block starts and towards block ends, combined."""
    n = len(values)
    padded = np.full(-(-n // width) * width, worst, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n - width + 1], ahead[width - 1:n])


def sample_positions(names: np.ndarray, window: int) -> np.ndarray:
    """Positions whose name is the least of some window of so many names."""
    least = _sliding(names, window, np.minimum, (1 << 64) - 1)
    padded = np.zeros(len(names) + window - 1, np.uint64)
    padded[window - 1:window - 1 + len(least)] = least
    return np.flatnonzero(_sliding(padded, window, np.maximum, 0) == names)


def _samples(text: bytes, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Positions and names of the cover sample of a text, slab by slab; a text shorter than the unit's length has none."""
    data = unit.symbols(text)
    positions, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(data) - unit.length + 1, SLAB):
        names = string_hashes(data[at:at + SLAB + unit.length - 1], unit.name)
        here = sample_positions(names, unit.window)
        positions.append(here + at)
        found.append(names[here].view(np.int64))
    positions, first = np.unique(np.concatenate(positions), return_index=True)
    return positions, np.concatenate(found)[first]


def _own_starts(contexts: np.ndarray, unit: Unit) -> np.ndarray:
    """Starts whose window has its least name, the leftmost if equal, at the sample position: each start is one sample's own."""
    names, before = string_hashes(contexts, unit.name), unit.before
    least = names[:, before:before + 1]
    own = np.ones((len(contexts), unit.window), bool)
    if before:
        own[:, :-1] = np.minimum.accumulate(names[:, before - 1::-1], axis=1)[:, ::-1] > least
        own[:, 1:] &= np.minimum.accumulate(names[:, before + 1:], axis=1) >= least
    return own


def _settle(contexts: np.ndarray, before: np.ndarray, after: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of contexts: hashes of the unit's strings from each start, which starts agree with another one here, and the first
    start of each hash.

    Column c stands for the start ``unit.before`` - c symbols before the sample position.
    """
    hashes = string_hashes(contexts, unit.length)
    back = unit.before - np.arange(unit.window)
    real = (back[None, :] <= before[:, None]) & (unit.length - back[None, :] <= after[:, None]) & _own_starts(contexts, unit)
    flat = np.flatnonzero(real)
    order = flat[np.argsort(hashes.ravel()[flat], kind="stable")]
    sorted_ = hashes.ravel()[order]
    same = sorted_[1:] == sorted_[:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    agree = np.zeros(hashes.size, bool)
    agree[order[tied]] = True
    first = np.ones(len(order), bool)
    first[1:] = ~same
    lead = np.zeros(hashes.size, bool)
    lead[order[first]] = True
    return hashes, agree.reshape(hashes.shape), lead.reshape(hashes.shape)


def _runs(agree: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the symbols that runs of agreeing starts cover."""
    edges = np.diff(np.pad(agree.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    origin = at[rows] - unit.before
    return rows, origin + starts, origin + ends - 1 + unit.length


def _ranges(contexts: np.ndarray, hashes: np.ndarray, chosen: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """The chosen starts of rows of contexts by ranges of ``unit.stride``: the row, the hash of what all strings from the range have
    in common, and the starts and their hashes. Equal strings start in the same range, as their sample positions are equal."""
    stride = unit.stride
    cores = string_hashes(contexts, unit.length - stride + 1)
    which, c = np.nonzero(chosen)
    group = c // stride
    fresh = np.ones(len(which), bool)
    fresh[1:] = (which[1:] != which[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(fresh)
    ends = pa.array(np.append(first, len(which)), pa.int32())
    starts, found = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (at[which] - unit.before + c, hashes[which, c].view(np.int64)))
    return which[first], cores[which[first], (group[first] + 1) * stride - 1].view(np.int64), starts, found


_KEY = ["id", "tie"]
_SPAN = "id bigint, tie bigint, start bigint, stop bigint"


def _column(values, kind):
    return pa.array(values, kind)


def repeated_spans(texts: DataFrame, left_out: DataFrame, largest: int = BLOCK, unit: Unit = Unit()) -> DataFrame:
    """(id, tie, start, stop) in symbols of repeated strings, overlapping, from rows of (id, tie, text) without the keys ``left_out``."""
    def sample(batches):
        for batch in slices(batches):
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = [_samples(t.as_py(), unit) for t in batch.column(2)]
            which = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
            if len(which):
                yield pa.RecordBatch.from_arrays(
                    [_column(ids[which], pa.int64()), _column(ties[which], pa.int64()),
                     _column(np.concatenate([p for p, _ in parts]), pa.int64()), _column(np.concatenate([n for _, n in parts]), pa.int64())],
                    names=["id", "tie", "at", "name"])

    drawn = texts.select("id", "tie", "text").mapInArrow(sample, "id bigint, tie bigint, at bigint, name bigint")
    samples = materialize(drawn).join(left_out, _KEY, "left_anti")
    # Written, so that both sides of the join are shuffled for it and a hot key can be split.
    names = materialize(samples.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"))
    mine = samples.join(names, "name").groupBy(*_KEY).agg(F.collect_list(F.struct("at", "name", "n")).alias("samples"))

    def contexts(batches):
        """Contexts of the samples of each text; equal whole contexts in the batch are settled, and one of them goes on."""
        for batch in slices(batches):
            out, seen = [], {}
            for id_, tie, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                symbols = unit.symbols(text)
                for s in found:
                    at = s["at"]
                    lo, hi = max(0, at - unit.before), min(len(symbols), at + unit.length)
                    context = symbols[lo:hi].tobytes()
                    row = [s["name"], s["n"], id_, tie, at, at - lo, context, False]
                    if hi - lo == unit.context:
                        mark = xxhash.xxh3_128_digest(context)
                        other = seen.setdefault(mark, row)
                        if other is not row:
                            other[7] = True
                            row[6:] = [None, True]
                    out.append(row)
            yield pa.RecordBatch.from_arrays(
                [_column([r[i] for r in out], kind) for i, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))],
                names=["name", "n", "id", "tie", "at", "before", "context", "settled"])

    found = texts.join(mine, _KEY).select("id", "tie", "text", "samples").mapInArrow(
        contexts, "name bigint, n bigint, id bigint, tie bigint, at bigint, before int, context binary, settled boolean")
    salt = F.pmod(F.xxhash64("id", "tie"), F.ceil(F.col("n") / largest))
    blocks = found.withColumn("salt", F.when(F.col("context").isNull(), F.xxhash64("id", "at")).otherwise(salt)).repartition(
        "name", "salt").sortWithinPartitions("name", "salt")

    def settle(batches):
        def solve(block: pa.Table):
            whole = block.filter(pa.compute.is_valid(block["context"]))
            gone = block.filter(pa.compute.invert(pa.compute.is_valid(block["context"])))
            if len(gone):
                at = gone["at"].to_numpy()
                yield gone["id"], gone["tie"], at - unit.before, at + unit.length
            if not len(whole):
                return
            at, before = whole["at"].to_numpy(), whole["before"].to_numpy()
            rows = whole["context"].to_pylist()
            wide = unit.kind.itemsize
            after = np.array([len(r) // wide for r in rows]) - before
            padded = b"".join(bytes((unit.before - b) * wide) + r + bytes((unit.length - a) * wide) for r, b, a in zip(rows, before.tolist(), after.tolist(), strict=True))
            contexts = np.frombuffer(padded, unit.kind).reshape(-1, unit.context)
            hashes, agree, lead = _settle(contexts, before, after, unit)
            agree[whole["settled"].to_numpy()] = True
            which, start, stop = _runs(agree, at, unit)
            yield whole["id"].take(pa.array(which)), whole["tie"].take(pa.array(which)), start, stop
            large = whole["n"].to_numpy() > largest
            if large.any():
                which, core, starts, found = _ranges(contexts, hashes, lead & large[:, None], at, unit)
                yield whole["id"].take(pa.array(which)), whole["tie"].take(pa.array(which)), None, None, _column(core, pa.int64()), starts, found

        def emit(block: pa.Table):
            many = pa.list_(pa.int64())
            for id_, tie, start, stop, *handed in solve(block):
                id_, tie = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (id_, tie))
                span = [pa.nulls(len(id_), pa.int64()) if x is None else _column(x, pa.int64()) for x in (start, stop)]
                yield pa.RecordBatch.from_arrays([id_, tie, *span, *(handed or [pa.nulls(len(id_), kind) for kind in (pa.int64(), many, many)])],
                                                 names=["id", "tie", "start", "stop", "core", "starts", "hashes"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                held.append(part)
                n += len(part)
                if n >= ROWS:
                    block = pa.Table.from_batches(held)
                    name, part_of = block["name"].to_numpy(), block["salt"].to_numpy()
                    other = np.flatnonzero((name != name[-1]) | (part_of != part_of[-1]))
                    if len(other):
                        cut = int(other[-1]) + 1
                        yield from emit(block.slice(0, cut))
                        held, n = block.slice(cut).to_batches(), len(block) - cut
        if held:
            yield from emit(pa.Table.from_batches(held))

    spans = materialize(blocks.mapInArrow(settle, _SPAN + ", core bigint, starts array<bigint>, hashes array<bigint>"))
    handed = spans.where("core is not null").select(*_KEY, "core", "starts", "hashes")
    shared = handed.groupBy("core").agg(F.count("*").alias("_n")).where("_n > 1").select("core")
    alone = materialize(handed.join(shared, "core").select(*_KEY, F.explode(F.arrays_zip("starts", "hashes")).alias("_s")).select(
        *_KEY, F.col("_s")["starts"].alias("start"), (F.col("_s")["starts"] + unit.length).alias("stop"), F.col("_s")["hashes"].alias("hash")))
    met = alone.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1").select("hash")
    return spans.where("core is null").select(*_KEY, "start", "stop").unionByName(alone.join(met, "hash").drop("hash"))


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs that the spans make up."""
    kept, at, runs = [], 0, 0
    for start, stop in sorted(spans):
        if start > at or not runs:
            kept.append(text[at:start])
            runs += 1
        at = max(at, stop)
    kept.append(text[at:])
    return b"".join(kept), runs


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The merged spans without characters that they cover in part."""
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    for span in merged:
        for end, step in ((0, 1), (1, -1)):
            while 0 < span[end] < len(text) and text[span[end]] & 0xC0 == 0x80:
                span[end] += step
    return [(a, b) for a, b in merged if a < b]


def dedup(docs: DataFrame, text: str = "text", largest: int = BLOCK, characters: bool = False, unit: Unit = Unit()) -> DataFrame:
    """``docs`` without the text, with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the other bytes).

    ``unit`` says how long the strings are that go, and whether in bytes or in words; words are told apart by their bytes alone, whatever
    white space lies between. A run of bytes may begin or end inside a character; with ``characters`` such a character stays whole.
    """
    own = [c for c in docs.columns if c not in (text, "n_bytes", "n_removed", "n_spans", "kept")]
    # A row's key: its id (null as the least number) and its text's hash.
    data = whole_text(text).cast("binary")
    held = [f"_own_{i}" for i in range(len(own))]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(data).alias("tie"),
                        *[F.col(c).alias(h) for c, h in zip(own, held, strict=True)], data.alias("_text"))
    with scratch(docs.sparkSession) as keep:
        sizes = materialize(texts.select("id", "tie", unit.size(F.col("_text")).alias("n"), F.hash("_text").alias("check")).where(F.col("n") >= unit.length))
        copies = sizes.groupBy("tie", "n", "check").agg(F.count("*").alias("times"), F.min("id").alias("first")).where("times > 1")
        copied = materialize(sizes.join(copies, ["tie", "n", "check"]).select("id", "tie", "n", (F.col("id") == F.col("first")).alias("stays")).distinct())
        found = repeated_spans(texts.select("id", "tie", F.col("_text").alias("text")), copied.where("not stays").select(*_KEY), largest, unit)
        whole = copied.select(*_KEY, F.lit(0).cast("bigint").alias("start"), F.col("n").cast("bigint").alias("stop"))
        spans = keep(found.unionByName(whole).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "stop")).alias("_spans")))

    def cut(batches):
        for batch in slices(batches):
            out = []
            for t, spans in zip(batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist(), strict=True):
                spans = unit.places(t, [(s["start"], s["stop"]) for s in spans or ()])
                out.append((t, *remove(t, whole_characters(t, spans) if characters else spans)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(own)], _column([len(t) for t, _, _ in out], pa.int64()),
                 _column([len(t) - len(k) for t, k, _ in out], pa.int64()), _column([r for *_, r in out], pa.int64()),
                 _column([k for _, k, _ in out], pa.binary())], names=[*own, "n_bytes", "n_removed", "n_spans", "kept"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in own), "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"])
    return texts.join(spans, _KEY, "left").select(*held, "_text", "_spans").mapInArrow(cut, schema)
