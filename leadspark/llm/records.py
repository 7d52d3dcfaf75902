"""Token-ID output as length-delimited binary records with a separate offset index.

A file holds ``MAGIC``, one byte with the width of an id (2 or 4), then one frame per document::

    uint64 length | uint32 masked checksum of these 8 bytes | ids, little-endian | uint32 masked checksum of the ids

all little-endian; the checksum is CRC-32, masked by a rotation of 15 bits plus a constant, so that data which themselves
contain checksums stay safe. Beside each file lies ``<file>.idx`` with (offset, length) of every frame as two uint64, for
readers that shuffle without this library; the same facts come back as an index table.

Files are made in ascending order of ``doc_id`` (null first, equal ids by the text's hash): rows are range-partitioned, sorted inside
their partition, and encoded and framed by one task per file. A task writes under a name of its own attempt and
only the index of the attempt that succeeded names the file, so lost executors leave unnamed files at worst. Null texts
count as empty and give a frame that holds the end id alone. An empty table gives no files. Columns other than ``doc_id``
and the text are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm import codec
from leadspark.llm.common import slices, whole_text
from leadspark.operators.staging import materialize, staging_folder

# The format's first bytes and its checksum mask.
MAGIC = b"LSTOKEN1"
MASK_DELTA = 0xA282EAD8
HEAD = len(MAGIC) + 1

INDEX = "doc_id bigint, file string, file_no int, offset bigint, length bigint, in_file bigint, n_tokens bigint"


class BadRecord(ValueError):
    """A frame whose length or checksum does not hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; BadRecord if it is damaged."""
    if len(data) < 16 or struct.unpack_from("<I", data, 8)[0] != masked(data[:8]):
        raise BadRecord("damaged length")
    payload = data[12:-4]
    if struct.unpack_from("<Q", data)[0] != len(payload) or struct.unpack_from("<I", data, len(data) - 4)[0] != masked(payload):
        raise BadRecord("damaged record")
    return payload


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write the files; the index table, one row per document.

    ``folder`` must be one that all executors share (a path or URI that pyarrow's file systems open); unset, a new
    one below ``spark.checkpoint.dir`` is taken.
    """
    folder = folder or f"{staging_folder(docs.sparkSession)}/records-{uuid.uuid4().hex}"

    def write(batches):
        task = TaskContext.get()
        store, root = pa.fs.FileSystem.from_uri(folder)
        words = codec.for_file(tokenizer)
        end = np.array([end_id], words.kind).tobytes()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tok"
        out, places, at, tokens = None, [], HEAD, 0
        for batch in slices(batches):
            ids, offsets, lengths, starts, counts = batch.column(0), [], [], [], []
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
                out.write(MAGIC + bytes([words.kind.itemsize]))
            for encoded in words.encode_all(batch.column(1)):
                payload = encoded + end
                data = frame(payload)
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                starts.append(tokens)
                counts.append(len(payload) // words.kind.itemsize)
                at += len(data)
                tokens += counts[-1]
            places += [np.array([offsets, lengths], "<u8").T.tobytes()]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array([task.partitionId()] * n, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (offsets, lengths, starts, counts)]],
                names=["doc_id", "file", "file_no", "offset", "length", "in_file", "n_tokens"])
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(b"".join(places))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    placed = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    return materialize(placed.mapInArrow(write, INDEX))


def read_records(index: DataFrame) -> DataFrame:
    """Read the documents of an index table, in any order or subset: its rows plus ``ids`` (little-endian uint32)."""

    def read(batches):
        opened, data, kind = None, None, None
        for batch in slices(batches):
            found = []
            files, offsets, lengths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "length"))
            for file, offset, length in zip(files, offsets, lengths, strict=True):
                if file != opened:
                    if data is not None:
                        data.close()
                    store, path = pa.fs.FileSystem.from_uri(file)
                    data, opened = store.open_input_file(path), file
                    head = data.read_at(HEAD, 0)
                    if head[:-1] != MAGIC:
                        raise BadRecord(f"{file} is not a record file")
                    kind = np.dtype(f"<u{head[-1]}")
                found.append(np.frombuffer(unframe(data.read_at(length, offset)), kind).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "ids"])
        if data is not None:
            data.close()

    schema = ", ".join(f"`{n}` {t}" for n, t in index.dtypes) + ", ids binary"
    return index.mapInArrow(read, schema)


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before. One window runs over one row per file."""
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("file_no").agg(F.sum("n_tokens").alias("_sum")).select(
        "file_no", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    return index.join(bases, "file_no").withColumn("start", F.col("_base") + F.col("in_file")).drop("_base")
