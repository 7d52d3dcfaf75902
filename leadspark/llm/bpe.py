"""BPE encoding and decoding that encodes content shared across documents once.

Texts are cut into chunks where a rolling hash of the last ``SPAN`` bytes hits a pattern (content-defined chunking), so equal
passages fall into equal chunks wherever they stand. Chunks that occur more than once are encoded once, by one of the
documents that hold them, and their ids travel to the others; chunks of their own are encoded in place. A cut may run
through a word, and through a word its ids depend on both sides: at every join the words that touch the cut are put together
from the texts of as many chunks as it takes to reach white space on both sides, and encoded anew. From there on
the ids of joined chunks agree with those of the whole text, as the tokenizer never merges across white space.

Texts are shuffled once, by a key of their own, and that exchange serves both the documents that encode for others and the
assembly. Besides, only chunk hashes and the ids of shared chunks are shuffled; a chunk that very many documents
hold is a skewed join key that adaptive execution splits, with nothing above the join that needs a key's rows in one task.

Null texts count as empty and have no ids. Repeated rows are encoded each by itself. An empty table gives an empty result.
Only ``doc_id`` and the text are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm import codec
from leadspark.llm.common import slices, whole_text
from leadspark.operators.staging import materialize

SPAN = 16
# One position in 2 ** CUT_BITS ends a chunk, but none within LEAST bytes of the last cut.
CUT_BITS = 11
LEAST = 64
_SPACES = b" \t\n\r\x0b\x0c"
_GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length. No chunk ends inside a character."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    step = 1
    while step < SPAN:
        longer = rolled.copy()
        longer[step:] += rolled[:-step] << np.uint32(step)
        rolled, step = longer, 2 * step
    ends, last = [], 0
    for at in (np.flatnonzero(rolled[SPAN - 1:] >> np.uint32(32 - CUT_BITS) == 0) + SPAN).tolist():
        if at - last >= LEAST:
            while at < n and raw[at] & 0xC0 == 0x80:
                at += 1
            if at < n:
                ends.append(at)
                last = at
    return [*ends, n]


def _edges(piece: bytes) -> tuple[int, int]:
    """Lengths of the word parts that a piece with white space begins and ends with."""
    head = 0 if piece[:1] in _SPACES else len(piece.split(None, 1)[0])
    tail = 0 if piece[-1:] in _SPACES else len(piece.rsplit(None, 1)[-1])
    return head, tail


def inner_ids(words: codec.WordCodec, piece: bytes) -> bytes:
    """Ids of a chunk between its first and its last white space; none if it has no white space."""
    if len(piece.split(None, 1)) < 2 and not (piece[:1] in _SPACES or piece[-1:] in _SPACES):
        return b""
    head, tail = _edges(piece)
    return words.encode(piece[head:len(piece) - tail])


def assemble(words: codec.WordCodec, data: bytes, known: list[tuple[int, int, bytes]]) -> bytes:
    """Ids of a whole text, given the inner ids of some of its chunks as (start, stop, ids)."""
    out, open_from, at = [], 0, 0
    for start, stop, ids in sorted(known):
        piece = data[start:stop]
        if start < at or not ids:
            continue
        head, tail = _edges(piece)
        # From the last white space that is settled up to this chunk's first one: joins, and chunks of the text's own.
        out += [words.encode(data[open_from:start + head]), ids]
        open_from, at = stop - tail, stop
    out.append(words.encode(data[open_from:]))
    return b"".join(out)


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of INT) and ``decoded``, the text that decoding these ids gives, for every row of ``docs``."""
    data = whole_text(text).cast("binary")
    doc_id = F.col("doc_id").cast("bigint")
    # A row's key: its id (null as the least number) and its text's hash.
    texts = docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(data).alias("tie"), doc_id.alias("doc_id"), data.alias("text"))

    def chunk(batches):
        for batch in slices(batches):
            which, starts, stops, hashes = [], [], [], []
            for k, value in enumerate(batch.column(2)):
                data, at = value.as_py(), 0
                for end in chunk_ends(data):
                    which.append(k)
                    starts.append(at)
                    stops.append(end)
                    hashes.append(xxhash.xxh3_128_digest(data[at:end]))
                    at = end
            which = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(starts, pa.int32()),
                                              pa.array(stops, pa.int32()), pa.array(hashes, pa.binary())], names=["id", "tie", "start", "stop", "hash"])

    chunks = materialize(texts.select("id", "tie", "text").mapInArrow(chunk, "id bigint, tie bigint, start int, stop int, hash binary"))
    # Written, so that both sides of the join are shuffled for it and a hot key can be split.
    repeated = materialize(chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    shared = materialize(chunks.join(repeated, "hash"))
    owners = shared.groupBy("hash").agg(F.min(F.struct("id", "tie", "start", "stop")).alias("owner"))
    owned = owners.select("owner.*", "hash").groupBy("id", "tie").agg(F.collect_list(F.struct("start", "stop", "hash")).alias("owned"))

    def encode_owned(batches):
        words = codec.for_file(tokenizer)
        for batch in slices(batches):
            hashes, ids = [], []
            for data, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for part in parts:
                    hashes.append(part["hash"])
                    ids.append(inner_ids(words, data[part["start"]:part["stop"]]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], names=["hash", "ids"])

    once = texts.join(owned, ["id", "tie"]).select("doc_id", "text", "owned").mapInArrow(encode_owned, "hash binary, ids binary")
    uses = shared.join(once, "hash").groupBy("id", "tie").agg(F.collect_list(F.struct("start", "stop", "ids")).alias("known"))

    def encode_all(batches):
        words = codec.for_file(tokenizer)
        for batch in slices(batches):
            found = [np.frombuffer(assemble(words, data, [(x["start"], x["stop"], x["ids"]) for x in known or ()]), words.kind)
                     for data, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            decoded = words.tokenizer.decode_batch([x.tolist() for x in found], skip_special_tokens=False)
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return texts.join(uses, ["id", "tie"], "left").select("doc_id", "text", "known").mapInArrow(
        encode_all, "doc_id bigint, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id`` with the count and the checksums of its ids and of its decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
