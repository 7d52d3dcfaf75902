"""Alignment of two tokenizations of the same texts by coalescing token intervals.

Both token sequences of a text are byte intervals. All of them are sorted together by start (lexsort); a running maximum of their ends
(``maximum.accumulate``) tells where a group breaks: where a start reaches the maximum of all ends before, tokens of both
sides end. Overlaps are then expanded inside the groups only, where each side's tokens are laid against the other's.

Corpus-wide counts of id pairs come from three passes over written tables, none with a row per link: a task gathers texts into
*chunks* of at most ``CHUNK`` links and writes each chunk's distinct pairs with their counts beside the texts' links, which are packed as
places in that list; the lists are summed over the corpus; and each chunk gets the sums of its own pairs back, read by
the task that holds the chunk's texts. A frequent pair is one row per chunk, and a chunk's list is bounded.

A text that is null or empty, or whose joined tokens on either side differ from its bytes after the added space, has no tokens: its numbers
are 0 and its digest is empty. Repeated rows count as often as they stand. An empty table gives an empty result. Very long texts make a
chunk of their own. Null and repeated ``doc_id`` are kept as they are. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.codec import byte_letters
from leadspark.llm.common import slices, whole_text
from leadspark.operators.staging import materialize

# Links per chunk, and so the most rows of a chunk's list of pairs.
CHUNK = 1 << 19
# Letters or gaps in a row beyond which the slower encoder takes a text, as its merges are not quadratic.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


class Side:
    """Token ids and byte lengths of a text."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.sizes = np.array([len(b) for b in token_bytes], np.int64)
        # Every id as decimal text followed by each separator, so that a digest's text is one lookup per token.
        self.texts = [f"{i}{sep}" for i in range(len(token_bytes)) for sep in (",", "|", ";", "")]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class ByteLevel(Side):
    """A byte-level BPE from a tokenizers file. Ids of merges stand in the order of the merges, so that the ids serve as
    ranks of a faster encoder, which is compared with the file's own one on a few texts."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        special = {t["id"]: t["content"].encode() for t in described.get("added_tokens", [])}
        vocabulary = {i: t for t, i in described["model"]["vocab"].items()}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        n = max([*special, *vocabulary]) + 1
        super().__init__([special[i] if i in special else bytes(map(byte_of.__getitem__, vocabulary.get(i, ""))) for i in range(n)])
        ranks = {self.bytes[i]: i for i in vocabulary if i not in special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for text in (" In eaenat, the  ouat.\n\n Été!! don't x1y22\t", " <|endoftext|> a ß 漢字 😀\r\n  z'll 've"):
            if self.fast.encode_ordinary(text) != self._own(text):
                raise ValueError(f"{path}: ids are not the ranks of its merges")

    def _own(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        return self._own(" " + text) if LONG_RUN.search(text) else self.fast.encode_ordinary(" " + text)


class Pieces(Side):
    """A sentencepiece model, which puts the space before the text itself."""

    _BYTE = re.compile("<0x([0-9A-F]{2})>")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(m[1], 16)]) if (m := self._BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces])

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Sides:
    """Both sides, and the texts of A's ids followed by those of B's."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b, self.texts = a, b, [*a.texts, *b.texts]


@functools.lru_cache(maxsize=2)
def sides(a: str, b: str) -> Sides:
    return Sides(ByteLevel(a), Pieces(b))


def tokens(text: str, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both sides; none where the joined tokens are not the text's bytes after a space."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    first, second, data = a.encode(text), b.encode(text), (" " + text).encode()
    if a.joined(first) != data or b.joined(second) != data:
        return none, none
    return np.array(first, np.int64), np.array(second, np.int64)


def coalesce(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and B interval, from 0: groups break where a start reaches the running maximum of all ends before."""
    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    side = np.repeat([0, 1], [len(starts_a), len(starts_b)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:len(starts_a)], group[len(starts_a):]


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all A and B intervals that share a byte, for sides whose own intervals lie one after the other.

    A's interval overlaps a run of B's intervals; runs lie inside a group, whose edges no interval crosses.
    """
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(starts_a)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def align(ids_a: np.ndarray, ids_b: np.ndarray, both: Sides) -> tuple[int, str, np.ndarray]:
    """Number of groups, the text of the groups, and links (A id << 32 | B id): overlapping pairs that end together."""
    if not len(ids_a):
        return 0, "", np.zeros(0, np.int64)
    a, b = both.a, both.b
    ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    starts_a, starts_b = ends_a - a.sizes[ids_a], ends_b - b.sizes[ids_b]
    group_a, group_b = coalesce(starts_a, ends_a, starts_b, ends_b)
    i, j = overlaps(starts_a, ends_a, starts_b, ends_b)
    together = ends_a[i] == ends_b[j]
    links = ids_a[i[together]] << 32 | ids_b[j[together]]
    # A's tokens, then B's, group by group; the separator after a token depends on what follows it.
    last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    last_a[:-1], last_b[:-1] = np.diff(group_a) != 0, np.diff(group_b) != 0
    code_a, code_b = ids_a * 4 + np.where(last_a, 1, 0), ids_b * 4 + np.where(last_b, 2, 0)
    code_b[-1] = ids_b[-1] * 4 + 3
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    texts = np.concatenate([code_a, code_b + len(a.texts)])[order]
    return int(group_a[-1]) + 1, "".join(map(both.texts.__getitem__, texts.tolist())), links


_DOCS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary"
_CHUNKS = f"chunk string, kind int, at int, pair bigint, n bigint, {_DOCS}"


def _chunks(docs: DataFrame, path_a: str, path_b: str, text: str, chunk: int) -> DataFrame:
    """Rows of kind 1, a text with its links as places in its chunk's list, and of kind 0, the list: (at, pair, n)."""
    schema = pa.schema([("chunk", pa.string()), ("kind", pa.int32()), ("at", pa.int32()), ("pair", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()),
                        ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())])

    def run(batches):
        both = sides(path_a, path_b)
        task = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = number = 0

        def close() -> Iterator[pa.RecordBatch]:
            links = np.concatenate([np.zeros(0, np.int64), *(r[-1] for r in held)])
            pairs, at, n = np.unique(links, return_inverse=True, return_counts=True)
            name, ends = f"{task}-{number}", np.cumsum([len(r[-1]) for r in held])
            places = [x.astype("<u4").tobytes() for x in np.split(at.astype(np.int64), ends[:-1])]
            k = len(held)
            columns = [[r[i] for r in held] for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * k), pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                 *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[5:], strict=False)), pa.array(places, pa.binary())], schema=schema)
            k = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * k, pa.string()), pa.array(np.zeros(k, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(pairs), pa.array(n.astype(np.int64)),
                 *(pa.nulls(k, f.type) for f in list(schema)[5:])], schema=schema)

        for batch in slices(batches):
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids_a, ids_b = tokens(value, both.a, both.b)
                groups, written, links = align(ids_a, ids_b, both)
                digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
                held.append((doc_id, len(ids_a), len(ids_b), groups, digest, links))
                size += len(links)
                if size >= chunk or len(held) >= chunk:
                    yield from close()
                    held, size, number = [], 0, number + 1
        if held:
            yield from close()

    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, _CHUNKS))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold a pair of ids, and whether no pair of the same B id has more."""
    summed = chunks.where("kind = 0").groupBy("pair").agg(F.sum("n").alias("count"))
    # Rows are distinct pairs of vocabulary ids, so a B id has at most as many as A has entries.
    most = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))
    return materialize(summed.withColumn("best", F.col("count") == F.max("count").over(most)))


def align_texts(docs: DataFrame, path_a: str, path_b: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    chunks = _chunks(docs, path_a, path_b, text, chunk)
    counts = pair_counts(chunks)
    told = chunks.where("kind = 0").select("chunk", "at", "pair").join(counts, "pair").select(
        "chunk", F.lit(0).alias("kind"), "at", "count", "best", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _DOCS.split(", "))])
    texts = chunks.where("kind = 1").select("chunk", "kind", F.lit(None).cast("int").alias("at"), F.lit(None).cast("bigint").alias("count"),
                                           F.lit(None).cast("boolean").alias("best"), *[x.split()[0] for x in _DOCS.split(", ")])

    def add_up(batches):
        chunk, known, lists = None, [], None
        for batch in slices(batches, 4096):
            names = np.asarray(batch.column(0).to_pylist(), object)
            kinds = batch.column(1).to_numpy()
            edges = np.flatnonzero((names[1:] != names[:-1]) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                here = batch.slice(lo, hi - lo)
                if names[lo] != chunk:
                    chunk, known, lists = names[lo], [], None
                if kinds[lo] == 0:
                    known.append((here.column(2).to_numpy(), here.column(3).to_numpy(), here.column(4).to_numpy(zero_copy_only=False)))
                    continue
                if lists is None:
                    at = np.concatenate([np.zeros(0, np.int32), *(x[0] for x in known)])
                    lists = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                    for k, values in enumerate(lists):
                        values[at] = np.concatenate([np.zeros(0, values.dtype), *(x[k + 1] for x in known)])
                places = [np.frombuffer(x, "<u4") for x in here.column(10).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(here.column(i) for i in (5, 6, 7, 8, 9)), *(pa.array(x, pa.int64()) for x in (
                        [len(p) for p in places], [int(lists[1][p].sum()) for p in places], [int(lists[0][p].sum()) for p in places]))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"])

    gathered = told.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return gathered.mapInArrow(add_up, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
