"""Bounded-space online packing of documents into training sequences.

Every partition keeps a fixed number of open windows.  A document longer than a
window first fills whole windows of its own; what is left goes to the open window
it fits best.  When it fits none and no further window may be opened, the fullest
window is closed: its gap is filled with the head of the piece, so closed windows
hold no padding, and the rest of the piece is placed again.

Windows still open at the end of a partition are merged in rounds of at most
``FAN_IN`` partitions each by the same rule, until one group is left.  That group
is bounded by ``FAN_IN * windows`` windows.  Its open windows are joined, and the
last stretch is cut at powers of two, which need no padding.

Edge cases: a null text counts as empty, and each document has at least its end
id, so every row is packed.  Repeated rows are packed each on their own.  Texts
of any length are cut freely, ids are never dropped.  An empty table gives an
empty result.  Other input columns are dropped.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.bpe import byte_alphabet
from civicforms.llm.common import Workspace, read, text_slices

WINDOW = 2048
OPEN_WINDOWS = 32
FAN_IN_BITS = 6
_ROW = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("node", pa.int64()), ("ids", pa.binary()),
]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, node long, ids binary"

#: The pattern of the pieces takes one step back for each sign of a run of white space, and tiktoken fails near a million.
SAFE_SPACES = 100_000
_SPACES = re.compile(r"\s+")

#: doc_id, start, packed ids (u32), ids of the whole document
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Best fit over a fixed number of open windows.  ``rows`` gathers the pieces of closed windows."""

    def __init__(self, first_sequence: int, window: int = WINDOW, windows: int = OPEN_WINDOWS) -> None:
        self.next_sequence, self.window, self.windows = first_sequence, window, windows
        self.open: list[tuple[int, list[Piece]]] = []  # ids in it, pieces
        self.rows: list[tuple] = []

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, zlib.crc32(ids), total, self.next_sequence, offset, None, None))
            offset += length
        self.next_sequence += 1

    def add(self, piece: Piece) -> None:
        doc_id, start, ids, total = piece
        while len(ids) >= 4 * self.window:
            self._close([(doc_id, start, ids[: 4 * self.window], total)])
            ids, start = ids[4 * self.window :], start + self.window
        while ids:
            length = len(ids) // 4
            fits = [(used, k) for k, (used, _) in enumerate(self.open) if used + length <= self.window]
            if fits:
                used, k = max(fits)
                self.open[k][1].append((doc_id, start, ids, total))
                if used + length == self.window:
                    self._close(self.open.pop(k)[1])
                else:
                    self.open[k] = (used + length, self.open[k][1])
                return
            if len(self.open) < self.windows:
                self.open.append((length, [(doc_id, start, ids, total)]))
                return
            used, k = max((used, k) for k, (used, _) in enumerate(self.open))
            gap = self.window - used
            _, pieces = self.open.pop(k)
            self._close([*pieces, (doc_id, start, ids[: 4 * gap], total)])
            ids, start = ids[4 * gap :], start + gap

    def leave(self, node: int) -> None:
        """Hand the open windows on to the next round."""
        for _, pieces in self.open:
            for doc_id, start, ids, total in pieces:
                self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, None, None, node, ids))
        self.open = []

    def finish(self) -> None:
        """Join the open windows to full ones; cut the rest at powers of two."""
        pieces = [p for _, ps in self.open for p in ps]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.open = []
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= room
            taken: list[Piece] = []
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                head = ids[: 4 * room]
                taken.append((doc_id, start, head, total))
                room -= len(head) // 4
                if len(head) < len(ids):
                    pieces.insert(0, (doc_id, start + len(head) // 4, ids[len(head) :], total))
            self._close(taken)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [[] for _ in _ROW]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _ROW, strict=True)], names=[n for n, _ in _ROW])


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """An encoder for a byte-level vocabulary file: its tokens as ranks, special tokens taken as such in texts."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {char: b for b, char in byte_alphabet().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    import public_tokenizers

    return tiktoken.Encoding(f"bytes-{base64.b16encode(path.encode()).decode()}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def whole_encoder(path: str):
    """The library's own encoder for a vocabulary file; slower, but takes any text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids of a whole text, packed in u32."""
    if len(text) > SAFE_SPACES and any(m.end() - m.start() > SAFE_SPACES for m in _SPACES.finditer(text)):
        return np.array(whole_encoder(path).encode(text, add_special_tokens=False).ids, "<u4")
    return byte_encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4")


def _sequence_base(level: int, node: int) -> int:
    return (level << 56) + (node << 32)


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        packer = Packer(_sequence_base(0, node), window, windows)
        for part, texts in text_slices(batches, text_col, 4 << 20):
            for doc_id, text in zip(part.column(id_col).to_pylist(), texts, strict=True):
                ids = token_ids(path, text).tobytes() + end
                packer.add((doc_id, 0, ids, len(ids) // 4))
            yield packer.batch()
        packer.leave(node)
        yield packer.batch()

    def later(level: int, last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            node = key[0].as_py()
            packer = Packer(_sequence_base(level, node), window, windows)
            pieces = table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist()
            # Fixed order, long pieces first, so that a run again gives the same sequences.
            for p in sorted(pieces, key=lambda p: (-len(p["ids"]), p["doc_id"] is None, p["doc_id"] or 0, p["start"], p["ids"])):
                packer.add((p["doc_id"], p["start"], p["ids"], p["doc_tokens"]))
            packer.finish() if last else packer.leave(node)
            return pa.Table.from_batches([packer.batch()])

        return run

    space = Workspace(docs.sparkSession, "packing")
    rows = space.write(docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(first, _DDL), "round-0")
    results, level = [], 0
    last_node = rows.agg(F.max("node")).first()[0] or 0
    while True:
        results.append(rows.where(F.col("node").isNull()))
        level, last = level + 1, last_node < 1 << FAN_IN_BITS
        last_node >>= FAN_IN_BITS
        open_rows = rows.where(F.col("node").isNotNull())
        merged = open_rows.groupBy(F.shiftright("node", FAN_IN_BITS).alias("to")).applyInArrow(later(level, last), _DDL)
        rows = merged if last else space.write(merged, f"round-{level}")
        if last:
            results.append(rows)
            break
    packed = results[0]
    for more in results[1:]:
        packed = packed.unionByName(more)
    return packed.drop("node", "ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)
