"""Binary token files with Elias-Fano coded document borders.

A table of token files is a Parquet table with one *block* a row: documents in
ascending order of identifier, their ids concatenated in the narrowest unsigned
width that holds the vocabulary, and the document borders as an Elias-Fano
sequence.  Blocks are written and read by Spark, so they may lie in any store.

Layout of a block (little endian)::

    magic "CFT2" | u8 id width | u8 low bits of borders | u8 low bits of identifiers | u8 0
    u32 documents | u32 of them without identifier | u32 ids | u64 ids before it in its part
    i64 first identifier | u64 last identifier less the first
    borders: low bits | high bits | select samples, u32 each
    identifiers less the first, the same way
    ids

A part is one range of identifiers, written by one task.  What lies before a part is
one number a part, so reading needs no second pass over the blocks.

Edge cases: a null text counts as empty, and every document has at least its end
id.  Equal identifiers keep all their rows, ordered by text.  Null identifiers
come first.  A document longer than a block gets a block of its own.  An empty
table gives no block.  Other input columns, whatever their names, are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicforms.llm.chunks import chunk_encoder
from civicforms.llm.common import Workspace, read, shuffle_width, text_slices

MAGIC = b"CFT2"
HEADER = struct.Struct("<4sBBBBIIIQqQ")
BLOCK_IDS = 1 << 20
SAMPLE = 64  # one select sample for so many borders


class EliasFano:
    """A non-decreasing sequence of integers in about ``2 + log2(largest / count)`` bits each."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        covering = self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes()
        return int.from_bytes(covering, "little") >> (start & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: go to the nearest sample before it and count ones from there."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = start >> 3
        word = int(self.high[byte]) >> (start & 7) << (start & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (places - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high.view(np.int64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
        return (high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).view(np.int64)

    def tobytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def frombytes(cls, data: memoryview, count: int, low_bits: int, last: int) -> tuple[EliasFano, int]:
        """Read a sequence whose greatest value is ``last``; also the number of bytes it took."""
        a = (count * low_bits + 7) // 8
        b = a + ((last >> low_bits) + count + 7) // 8
        c = b + 4 * ((count + SAMPLE - 1) // SAMPLE)
        low, high, samples = np.frombuffer(data[:a], np.uint8), np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:c], "<u4")
        return cls(count, low_bits, low, high, samples), c


def pack_block(doc_ids: list[int | None], ids: list[bytes], width: int, before: int) -> bytes:
    """``doc_ids`` ascend, nulls first; ``before`` counts the ids before this block in its part."""
    ends = np.cumsum([len(x) // width for x in ids])
    borders = EliasFano.build(ends)
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    # The distance of two 64-bit identifiers fits in 64 bits without a sign.
    numbers = EliasFano.build(np.array([d - first for d in known], np.uint64))
    last = known[-1] - first if known else 0
    head = HEADER.pack(MAGIC, width, borders.low_bits, numbers.low_bits, 0, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]), before, first, last)
    return head + borders.tobytes() + numbers.tobytes() + b"".join(ids)


class Block:
    """A block read back: documents by place, through ``select`` on the borders."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        magic, width, low_bits, id_bits, _, count, self.missing, total, self.before, self.first, last = HEADER.unpack(view[: HEADER.size])
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEADER.size
        self.borders, taken = EliasFano.frombytes(view[at:], count, low_bits, total)
        at += taken
        self.numbers, taken = EliasFano.frombytes(view[at:], count - self.missing, id_bits, last)
        self.ids = np.frombuffer(view[at + taken :], f"<u{width}", total)

    def __len__(self) -> int:
        return self.borders.count

    def doc_id(self, i: int) -> int | None:
        return None if i < self.missing else self.first + self.numbers.select(i - self.missing)

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.borders.select(i - 1) if i else 0 : self.borders.select(i)]


def write_blocks(docs: DataFrame, path: str, end_id: int, space: Workspace, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode texts in ascending order of identifier and write them as token blocks; returns the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path, "<u2" if end_id < 1 << 16 else "<u4")
        width, end = encoder.dtype.itemsize, np.array([end_id], encoder.dtype).tobytes()
        part_no, before, numbers, parts, total = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            row = [[part_no], [len(numbers)], [total], [pack_block(numbers, parts, width, before)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "n_docs", "n_ids", "payload"])

        for part, texts in text_slices(batches, text_col, 2 << 20):
            for number, ids in zip(part.column(id_col).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                if parts and total + len(ids) // width > block_ids:
                    yield flush()
                    before, numbers, parts, total = before + total, [], [], 0
                numbers.append(number)
                parts.append(ids)
                total += len(ids) // width
        if parts:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    ordered = ordered.repartitionByRange(shuffle_width(docs.sparkSession), id_col).sortWithinPartitions(id_col, text_col)
    blocks = ordered.mapInArrow(run, "part int, n_docs long, n_ids long, payload binary")
    return space.write(blocks, "blocks", codec="none")


def part_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each part: one row a part, of which there are as many as tasks that wrote."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Per document of the token blocks: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, first in zip(batch.column("payload"), batch.column("part_start").to_pylist(), strict=True):
                block = Block(payload.as_py())
                ends = block.borders.values()
                starts = np.concatenate([[0], ends[:-1]])
                wide = memoryview(block.ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                numbers = pa.array(block.numbers.values().view(np.int64) + np.int64(block.first), pa.int64())
                doc_ids = pa.concat_arrays([pa.nulls(block.missing, pa.int64()), numbers])
                columns = [doc_ids, pa.array(starts + (first + block.before), pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # Two numbers for each writing task, whatever the input: a bounded broadcast that spares the blocks a shuffle.
    placed = blocks.select("part", "payload").join(F.broadcast(part_starts(blocks)), "part")
    return placed.select("payload", "part_start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    space = Workspace(spark, "token-output")
    return read_blocks(write_blocks(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, space))
