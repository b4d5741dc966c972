"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them,
hashed into 2**BITS places; each counts once a document, whatever its length.
FTRL-proximal keeps a learning rate for every coordinate, and its L1 term leaves
most weights at exactly zero, so the model is a short list of places and weights
that is small enough to broadcast.  L1 is large because a long document has thousands
of features and few of them tell anything.

The model is fitted on at most ``SAMPLE_DOCS`` labelled documents, the ones with the
smallest hash of their identifier.  That bounds the labels that are broadcast, the
features that the one training task reads, and the model.  Every document is
scored on its whole text.

Edge cases: a null text counts as empty; without any word the score is the bias
alone.  Rows without a label are not learned from.  A document with several labels
counts for each.  With no labelled row the score is 0.5 for all and ``predicted``
follows the threshold.  Repeated rows get equal results; an empty table gives an
empty one.  Other input columns are dropped unless named in ``keep``, where their
names must not be that of ``out``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.bpe import _free, _types
from civicforms.llm.chunks import numbered
from civicforms.llm.common import fewest_hashes, id_hash, read, text_slices

BITS = 20
SAMPLE_DOCS = 16_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.6, 1.0, 12.0, 0.2
THRESHOLD = 0.3
#: Chunks of text whose words are kept from slice to slice, and their letters: a bound on memory, not on texts.
CACHE_CHUNKS, CACHE_LETTERS = 200_000, 8 << 20
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordTable:
    """The words of chunks of text as hashes, packed in one array.

    With ``weights`` only features of non-zero weight are given.  It is emptied between
    two slices of texts when it holds more than ``CACHE_CHUNKS`` chunks or
    ``CACHE_LETTERS`` letters, so it never outgrows those by more than one slice.
    """

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.letters = 0
        self.ends, self.words = np.zeros(1, np.int64), np.zeros(0, np.uint64)

    def _add(self, new: list[str]) -> None:
        words, counts = [], []
        for chunk in new:
            found = [chunk] if chunk.isascii() and chunk.isalnum() else _WORD.findall(chunk)
            words += [xxhash.xxh3_64_intdigest(w) for w in found]
            counts.append(len(found))
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.letters += sum(map(len, new))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts, dtype=np.int64)])
        self.words = np.concatenate([self.words, np.array(words, np.uint64)])

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the distinct features of some texts, in order of both."""
        if len(self.row) > CACHE_CHUNKS or self.letters > CACHE_LETTERS:
            self.clear()
        rows, sizes = numbered(self.row, [t.lower().split() for t in texts], self._add)
        at, owner = _spread(self.ends, rows, np.repeat(np.arange(len(texts)), sizes))
        words = self.words[at]
        everywhere = np.ones(len(words), bool)
        found = []
        for hashes, of, inside in (
            (words, owner, everywhere),
            (words[:-1] * _PAIR + words[1:], owner[:-1], owner[:-1] == owner[1:]),
            (words[:-2] * _SKIP + words[2:], owner[:-2], owner[:-2] == owner[2:]),
        ):
            places = _places(hashes)
            if self.weights is not None:
                inside = inside & (self.weights[places] != 0)
            found.append(of[inside] << BITS | places[inside])
        keys = np.unique(np.concatenate(found))
        return keys >> BITS, keys & ((1 << BITS) - 1)


def _places(hashes: np.ndarray) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(29))) * _PAIR) >> np.uint64(64 - BITS)).astype(np.int64)


def _spread(ends: np.ndarray, rows: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of some rows, one after another, and the text of each."""
    first, counts = ends[rows], ends[rows + 1] - ends[rows]
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(int(counts.sum())), np.repeat(text_of, counts)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last place is the bias."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == len(self.z) - 1, 0.0, L1), 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, len(self.z) - 1)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient * gradient


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, text and label of the documents of at most ``sample`` labels, those with the smallest hash of their identifier."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # At most ``sample`` rows of two numbers: a bounded broadcast.
    chosen = fewest_hashes(chosen, sample, "toxicity")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero places, their weights, and the bias."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for part, texts in text_slices(batches, limit=1 << 20):
            text, place = table.features(texts)
            ends = np.searchsorted(text, np.arange(1, len(texts)))
            places = pa.array([x.tobytes() for x in np.split(place.astype("<i4"), ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), places], names=["doc_id", "toxic", "places"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), batch.column("places").to_pylist(), strict=True)
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[1], r[2]))
        model = Ftrl()
        for _ in range(epochs):
            for _, label, places in rows:
                model.learn(np.frombuffer(places, "<i4"), label)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])

    found = labelled_sample(docs, labels, sample).mapInArrow(extract, "doc_id long, toxic int, places binary")
    model = found.repartition(1).mapInArrow(train, "place long, weight double").toPandas()
    places, weights = model["place"].to_numpy(), model["weight"].to_numpy()
    bias = weights[places == 1 << BITS].sum()
    return places[places < 1 << BITS], weights[places < 1 << BITS], float(bias)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns and, named by ``out``, the probability of being toxic."""
    _free(keep, out)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias = spread.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[places] = weights
        table = WordTable(dense)
        for part, texts in text_slices(batches, text_col, 1 << 20):
            text, place = table.features(texts)
            sums = bias + np.bincount(text, dense[place], len(texts))
            scores = pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), scores], names=[*keep, out])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, _types(docs, keep, f"`{out}` double"))


def trainable(labels: DataFrame) -> DataFrame:
    """The labels that a model may learn from."""
    return labels.where(F.coalesce(id_hash(), F.lit(0)) % 4 != 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, fit(docs, trainable(read(spark, sf_dir, "labels"))))
    return done.select(
        "doc_id",
        (F.coalesce(id_hash(), F.lit(0)) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
