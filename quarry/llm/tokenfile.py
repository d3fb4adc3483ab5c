"""Token-id output: Elias-Fano document boundaries over a concatenated id array.

A table of token ids is written as shards in ascending order of document id; a shard is a run of blocks. A block is one
byte string that stands for itself:

    bytes 0-3    the letters EFID
    byte 4       version 1
    byte 5       bytes of an id, 2 or 4, little-endian
    byte 6       low bits of each boundary, l
    byte 7       0
    8-15         documents n, unsigned 64-bit little-endian
    16-23        ids u, the same
    then         document ids: n signed 64-bit integers, and a bitmap of ceil(n / 8) bytes of those that are null
    then         select samples: for every 256th boundary the place of its bit in the upper bits, unsigned 32-bit
    then         lower bits: n numbers of l bits, packed from the lowest bit, ceil(n * l / 8) bytes
    then         upper bits: ceil((n + (u >> l) + 1) / 8) bytes; boundary i sets bit (end_i >> l) + i
    then         ids: u numbers

The boundary of a document is the number of ids of the block up to its end, so n boundaries take about
2 + log2(u / n) bits each instead of 64. Blocks are rows of a Parquet dataset: Spark's committer then makes the write
whole even if executors are lost, and any store that Spark reaches will do.

Defined results: a null or empty text is its end id alone; rows that share an id follow each other in the order of
their texts' hash; a null id comes first; equal rows are kept each; an empty table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small, strings, task
from .tokenizing import encoder

MAGIC, END = b"EFID", 2
HEAD = struct.Struct("<4sBBBxQQ")
EVERY = 256
#: A block ends with the document that reaches so many ids.
BLOCK_IDS = 1 << 20


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))


def encode_block(docs: list[int | None], ids: list[bytes], dtype: np.dtype) -> bytes:
    """``ids``: for each document its ids as bytes of ``dtype``."""
    n, size = len(docs), dtype.itemsize
    ends = np.cumsum([len(x) // size for x in ids], dtype=np.int64) if n else np.zeros(0, np.int64)
    u = int(ends[-1]) if n else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    place = (ends >> low) + np.arange(n)
    upper = np.zeros(n + (u >> low) + 1, np.uint8)
    upper[place] = 1
    null = np.packbits(np.array([d is None for d in docs], np.uint8), bitorder="little").tobytes()
    return b"".join(
        (
            HEAD.pack(MAGIC, 1, size, low, n, u),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            null,
            place[::EVERY].astype("<u4").tobytes(),
            pack_bits(ends & ((1 << low) - 1), low),
            np.packbits(upper, bitorder="little").tobytes(),
            *ids,
        )
    )


class Block:
    """Reads a block in place: ``end(i)`` finds one boundary from the nearest sample, ``ends()`` all of them."""

    def __init__(self, data: bytes):
        magic, version, size, self.low, self.n, self.u = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1 or size not in (2, 4):
            raise ValueError("not a block of token ids")
        n, at = self.n, HEAD.size
        self.docs = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        self.null = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n, bitorder="little").astype(bool)
        at += (n + 7) // 8
        self.samples = np.frombuffer(data, "<u4", -(-n // EVERY), at)
        at += 4 * len(self.samples)
        self.lower = data[at : at + (n * self.low + 7) // 8]
        at += len(self.lower)
        self.upper = np.frombuffer(data, np.uint8, (n + (self.u >> self.low) + 8) // 8, at)
        at += len(self.upper)
        self.ids = np.frombuffer(data, f"<u{size}", self.u, at)
        if at + size * self.u != len(data):
            raise ValueError("a block of token ids has the wrong length")

    def end(self, i: int) -> int:
        """select: the place of the i-th set bit, less i, above the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // EVERY]), i % EVERY
        byte, first = place // 8, place % 8
        value = int(self.upper[byte]) >> first << first
        while (ones := value.bit_count()) <= left:
            left -= ones
            byte += 1
            value = int(self.upper[byte])
        for _ in range(left):
            value &= value - 1
        high = 8 * byte + (value & -value).bit_length() - 1 - i
        bit, low = i * self.low, 0
        if self.low:
            low = int.from_bytes(self.lower[bit // 8 : (bit + self.low + 7) // 8], "little") >> bit % 8 & ((1 << self.low) - 1)
        return high << self.low | low

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.end(i - 1) if i else 0 : self.end(i)]

    def ends(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n] - np.arange(self.n)
        return high << self.low | unpack_bits(self.lower, self.n, self.low)


BLOCKS = "shard long, before long, documents long, ids long, block binary"


def write(docs: DataFrame, file: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, block_ids: int = BLOCK_IDS, joined_space: bool = True) -> None:
    """Encodes all texts and writes the blocks to ``path``.

    The texts are ranged over the tasks by id, so that shard s is the s-th range; each task holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, before = encoder(file, joined_space), task(), 0
        last = np.array([end], e.dtype).tobytes()
        names, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            block = encode_block(names, ids, e.dtype)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, before, len(names), held)] + [pa.array([block], pa.binary())], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for b in small(batches):
            for doc, got in zip(b.column(0).to_pylist(), e.encode(strings(b.column(1)))):
                names.append(doc)
                ids.append(got + last)
                held += len(ids[-1]) // e.dtype.itemsize
                if held >= block_ids:
                    yield flush()
                    before += held
                    names, ids, held = [], [], 0
        if names:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = slim.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ranged.mapInArrow(run, BLOCKS).write.parquet(path)


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the blocks at ``path``.

    A block's row says how many ids its shard has before it, so blocks are read where they lie. Only the shards' totals, a row for each writing task, are summed in one place.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals, base, at = blocks.groupBy("shard").agg(F.sum("ids").alias("n")).collect(), {}, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        base[r["shard"]] = at
        at += r["n"]
    shared = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for b in small(batches):
            for shard, before, data in zip(*(c.to_pylist() for c in b.columns)):
                block = Block(data)
                ends = block.ends()
                starts = np.r_[0, ends[:-1]][: block.n]
                wide = block.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.docs, mask=block.null), pa.array(starts + before + base[shard]), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("shard", "before", "block").mapInArrow(run, DOCUMENTS)


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """Writes the file format to the shared folder and reads it back."""
    import uuid

    from .common import scratch_dir

    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/quarry-tokens-{uuid.uuid4().hex}"
    write(docs, file, path)
    return read(spark, path)
