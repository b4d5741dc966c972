"""Byte-pair encoding by speculation and verification.

Tokens of a word are first *proposed* by greedy longest match.  A proposal is
right exactly when each token survives on its own and no merge crosses the border
of two neighbours, so it is *verified* by testing every adjacent pair at once:
the right edge of the left token's merge tree and the left edge of the right
token's tree are walked in order of merge rank, and the pair fails when a merge
between the two current edge symbols would come before either of them is
consumed.  Only words with a failing pair are merged exactly, with a heap.

Edge cases: null text counts as empty and gives no token, the empty id list and
the empty decoded text.  The strings of special tokens become their ids and are
kept on decoding, as the tokenizers library does by default.  Texts of any length
are processed whole; memory is bounded by the slice size and the bytes of the word cache.
Repeated rows give repeated results, an empty table an empty one, and other input
columns are dropped unless they are named in ``keep``, which refuses those called as results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicforms.llm.chunks import ENTRY_BYTES, TwoGenerations, lower_chunks
from civicforms.llm.common import read, text_slices
from civicforms.llm.merges import END, SUFFIX, MergeRules, byte_alphabet, plain_words  # noqa: F401  some for other modules

class SpeculativeBPE(MergeRules):
    """An encoder and decoder for a word-level BPE file with a word-end suffix."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.matcher = ahocorasick.Automaton()
        for token, text in self.shape.items():
            self.matcher.add_word(text, token)
        self.matcher.make_automaton()

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (its bytes in the printable alphabet)."""
        proposals, last, fail = [], [], []
        for word in words:
            ids, end = [], -1
            for end, token in self.matcher.iter_long(word + END):  # noqa: B007
                ids.append(token)
            proposals.append(ids)
            last.append(end)
        counts = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for ids in proposals for t in ids), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        bad = np.zeros(len(words), bool)
        # The proposal must cover the word and its end mark, with tokens that stand alone.
        bad |= np.bincount(owner, self.lengths[flat], len(words)).astype(np.int64) != sizes
        bad |= np.array(last, np.int64) != sizes - 1
        bad |= self.wrong(flat, owner, len(words))
        for k in np.flatnonzero(bad):
            word = words[k]
            proposals[k] = self.exact([self.base[c] for c in word[:-1]] + [self.base[word[-1] + END]])
        return proposals

    def split(self, chunk: str) -> list[str | int]:
        """Words (in the printable alphabet) and special ids of a stretch of text."""
        parts = self.special_split.split(chunk) if self.special_split is not None and "<|" in chunk else [chunk]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word in plain_words(part):
                out.append(word if word.isascii() and word.isalnum() else "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]))
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of stretches of text that border on blanks."""
        split = [[c] if c.isascii() and c.isalpha() and c.islower() else self.split(c) for c in chunks]
        words = list({w for parts in split for w in parts if isinstance(w, str)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        return [ids[p[0]] if len(p) == 1 and isinstance(p[0], str) else [t for w in p for t in (ids[w] if isinstance(w, str) else (w,))] for p in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_chunks([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The tokens' names joined by blanks: what the vocabulary file, which names no decoder, stands for."""
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(maxsize=2)
def encoder(path: str) -> SpeculativeBPE:
    return SpeculativeBPE(path)


def _entries(bpe: SpeculativeBPE, chunks: list[str]) -> list[tuple[int, str, str]]:
    """Number of ids, decimal ids and decoded text of each chunk."""
    return [(len(ids), " ".join(map(str, ids)), bpe.decode(ids)) for ids in bpe.encode_chunks(chunks)]


@lru_cache(maxsize=1)
def _round_trip_cache(path: str) -> TwoGenerations:
    weigh = lambda entries: sum([len(ids) + 4 * len(decoded) + ENTRY_BYTES for _, ids, decoded in entries])
    return TwoGenerations(lambda chunks: _entries(encoder(path), chunks), weigh=weigh)


def _round_trips(path: str, texts: list[str]) -> Iterator[tuple[int, str, str]]:
    for values in _round_trip_cache(path).values_of(map(lower_chunks, texts)):
        hits = [e for e in values if e[0]]
        yield sum([e[0] for e in hits]), " ".join([e[1] for e in hits]), " ".join([e[2] for e in hits])


def _types(docs: DataFrame, keep: tuple[str, ...], more: str) -> T.StructType:
    return T.StructType([docs.schema[k] for k in keep] + T.StructType.fromDDL(more).fields)


def _free(keep: tuple[str, ...], *results: str) -> None:
    if taken := set(keep) & set(results):
        raise ValueError(f"columns to keep are called as results: {sorted(taken)}")


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Encode and decode each text: ``keep`` columns, n_tokens, ids_text (decimal ids joined by a blank), decoded."""
    _free(keep, "n_tokens", "ids_text", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text_col, 2 << 20):
            counts, ids, decoded = zip(*_round_trips(path, texts), strict=True)
            columns = [*(part.column(k) for k in keep), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids_text", "decoded"])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, _types(docs, keep, "n_tokens long, ids_text string, decoded string"))


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns and ids (array of int) of each text."""
    _free(keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part, texts in text_slices(batches, text_col, 2 << 20):
            ids = pa.array(bpe.encode_chunks(texts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), ids], names=[*keep, "ids"])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, _types(docs, keep, "ids array<int>"))


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and the text of each id list; ids outside the vocabulary are skipped, null gives ''."""
    _free(keep, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = pa.array([bpe.decode(ids or []) for ids in part.column(ids_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), texts], names=[*keep, "decoded"])

    return encoded.select(*dict.fromkeys([*keep, ids_col])).mapInArrow(run, _types(encoded, keep, "decoded string"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
