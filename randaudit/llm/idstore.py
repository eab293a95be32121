"""Token-id output: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Documents are range-partitioned and sorted by doc_id, encoded whole, and written as blocks of whole documents
(a document beyond BLOCK_IDS ids is cut over blocks). A block ranks the ids that occur in it by falling frequency;
each id is written as its rank in 1 to 4 bytes, and its length goes to a control stream of 2 bits an id. A reader
decodes four ids for each control byte by a numpy table lookup. Blocks are rows of a Parquet table, which Spark writes
and commits on any shared store, in ascending order of (part, block).

Row of a block: part, block, before (ids of the part's earlier blocks), begun (block where its first document
begins), closes (whether its last document ends here), doc_ids, lengths (ids of each document in this block),
ranked (ids by rank, little-endian uint32), control, data.
Null texts are empty; null doc_ids sort first; rows that repeat a doc_id stand next to each other, ordered by a
hash of the text. An empty table gives no block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from randaudit.llm.common import bounded_batches, local_parts, shared_dir, texts
from randaudit.llm.subwords import encoder

#: Ids of a block, about; a task holds one block at a time.
BLOCK_IDS = 1 << 20
END_ID = 1

#: For each control byte: bytes of its four numbers, and where each begins.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_SUMS = _LENGTHS.sum(axis=1)
_STARTS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of ids. Ids of equal frequency are ranked by id. Counts are a table over the vocabulary."""
    counts = np.bincount(ids)
    values = np.flatnonzero(counts)
    values = values[np.argsort(-counts[values], kind="stable")]
    rank_of = np.zeros(len(counts), dtype=np.uint32)
    rank_of[values] = np.arange(len(values), dtype=np.uint32)
    ranks = rank_of[ids]
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return values.astype("<u4").tobytes(), control.tobytes(), raw[np.arange(4) < sizes[:, None]].tobytes()


def unpack(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of a block. Padding numbers of the last control byte have one byte each that data doesn't hold."""
    c = np.frombuffer(control, dtype=np.uint8)
    # Four bytes from any place on, as one number: the data seen with a stride of one byte.
    anywhere = np.ndarray((len(data) + 5,), dtype="<u4", buffer=data + b"\0" * 8, strides=(1,))
    base = np.cumsum(_SUMS[c], dtype=np.int64) - _SUMS[c]
    at = np.minimum((base[:, None] + _STARTS[c]).ravel()[:n], len(data))
    ranks = anywhere[at] & _MASKS[(_LENGTHS[c] - 1).ravel()[:n]]
    return np.frombuffer(ranked, dtype="<u4")[ranks].astype(np.uint32)


_BLOCK = (
    "part int, block int, before bigint, begun int, closes boolean, doc_ids array<bigint>, lengths array<int>, "
    "ranked binary, control binary, data binary"
)
_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("begun", pa.int32()), ("closes", pa.bool_())]
    + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ranked", pa.binary()), ("control", pa.binary()), ("data", pa.binary())]
)


class _Writer:
    """Gathers whole documents to blocks; a document of more than BLOCK_IDS ids has blocks of its own."""

    def __init__(self, part: int):
        self.part, self.block, self.before = part, 0, 0
        self.names: list[int | None] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.size and self.size + len(ids) > BLOCK_IDS:
            yield self.flush()
        begun = self.block
        while len(ids) > BLOCK_IDS:
            self.names, self.held, self.size = [doc_id], [ids[:BLOCK_IDS]], BLOCK_IDS
            ids = ids[BLOCK_IDS:]
            yield self.flush(begun, closes=False)
        self.names.append(doc_id)
        self.held.append(ids)
        self.size += len(ids)
        if begun < self.block:
            yield self.flush(begun)

    def flush(self, begun: int | None = None, closes: bool = True) -> pa.RecordBatch:
        row = (self.part, self.block, self.before, self.block if begun is None else begun, closes, self.names, [len(x) for x in self.held])
        made = pa.RecordBatch.from_arrays(
            [pa.array([v], type=f.type) for v, f in zip((*row, *pack(np.concatenate(self.held))), _ARROW, strict=True)], schema=_ARROW
        )
        self.block, self.before, self.names, self.held, self.size = self.block + 1, self.before + self.size, [], [], 0
        return made


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> str:
    """Write the blocks of all documents to path (a new folder in the shared one if none is given) and return it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or f"{shared_dir(spark)}/token-blocks-{uuid.uuid4().hex}"
    own = texts(docs).withColumn("tie", F.xxhash64("text"))
    dealt = own.repartitionByRange(local_parts(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _Writer(TaskContext.get().partitionId())
        encode, end = encoder(tokenizer).encode, np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                yield from writer.add(doc_id, np.concatenate((ids, end)))
        if writer.size:
            yield writer.flush()

    dealt.select("doc_id", "text").mapInArrow(run, _BLOCK).write.option("compression", "zstd").parquet(path)
    return path


def _located(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with part_start, the ids of all earlier parts: sums of a row for each part the writer had, broadcast."""
    bounded_batches(spark)
    blocks = spark.read.schema(_BLOCK).parquet(path)
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.max(F.col("before") + n).alias("n"))
    ordered = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(ordered), F.lit(0)).cast("long").alias("part_start"))
    return blocks.join(F.broadcast(offsets), "part")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, bytes]]:
    """(block, lengths, ends, ids as little-endian uint32) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            counts = np.array(r["lengths"], dtype=np.int64)
            ends = np.cumsum(counts)
            yield r, counts, ends, unpack(r["ranked"], r["control"], r["data"], int(ends[-1])).astype("<u4").tobytes()


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, begun, doc_id, start, n_tokens, ids (binary, little-endian uint32): a row for each document of a block.

    start counts the ids before this row. Rows of equal (part, begun, doc_id) and different start are one long document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, counts, ends, raw in _decoded(batches):
            out = {
                "part": pa.array([r["part"]] * len(counts), type=pa.int32()),
                "begun": pa.array([r["begun"]] * len(counts), type=pa.int32()),
                "doc_id": pa.array(r["doc_ids"], type=pa.int64()),
                "start": pa.array(r["part_start"] + r["before"] + ends - counts, type=pa.int64()),
                "n_tokens": pa.array(counts, type=pa.int64()),
                "ids": pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], type=pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return _located(spark, path).mapInArrow(run, "part int, begun int, doc_id long, start long, n_tokens long, ids binary")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the whole documents of a token table, from its decoded ids.

    A document of several blocks has these to itself; only such blocks are shuffled, to be decoded in order.
    """
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, counts, ends, raw in _decoded(batches):
            view = memoryview(raw)
            sums = [zlib.crc32(view[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            starts = r["part_start"] + r["before"] + ends - counts
            columns = r["doc_ids"], starts, counts, sums
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)

    def joined(blocks: pa.Table) -> pa.Table:
        value, total, first = 0, 0, None
        for r, counts, _, raw in _decoded(blocks.sort_by("block").combine_chunks().to_batches()):
            first = first or (r["doc_ids"][0], r["part_start"] + r["before"])
            value, total = zlib.crc32(raw, value), total + int(counts.sum())
        return pa.table([pa.array([x], type=pa.int64()) for x in (*first, total, value)], names=names)

    blocks = _located(spark, path)
    several = (F.col("begun") != F.col("block")) | ~F.col("closes")
    cut = blocks.where(several).groupBy("part", "begun").applyInArrow(joined, kind)
    return blocks.where(~several).mapInArrow(run, kind).unionByName(cut)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from blocks that were written and read back."""
    return checksums(docs.sparkSession, write(docs, tokenizer))
