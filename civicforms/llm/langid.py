"""Language identification by unigram piece models that sum over all segmentations.

The pieces are the tokens of a fixed public vocabulary, read as plain text.  Each
language has its own piece probabilities.  The probability of a word is the sum,
over every way to cut it into pieces, of the product of their probabilities; the
forward algorithm gives it in one pass.  Piece probabilities are learned by
expectation maximisation (forward-backward over the distinct words of the training
sample, weighted by their counts).  A document's words are independent, so its
score is the posterior of the languages given all of its words.

The model is fitted on at most ``SAMPLE_DOCS`` labelled documents, those with the
smallest hash of their identifier, and holds languages x pieces floats.  That is
broadcast, so more than ``MOST_LANGS`` languages are refused.  Every document is
scored on its whole text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.  Words
of any length are summed over all their segmentations, in learning as in scoring:
short ones of one length together, longer ones from stretch to stretch, carrying the
probabilities of the last letters.  Letters outside the vocabulary get a floor probability, the same in all languages.  Ties
go to the alphabetically first language.  With no training document every text is
``und``.  Repeated rows get equal results; an empty table gives an empty one.  Other
input columns are dropped unless named in ``keep``, where their names must not be
those of ``out``.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.bpe import SUFFIX, _free, _types, byte_alphabet
from civicforms.llm.chunks import lower_chunks, numbered
from civicforms.llm.common import fewest_hashes, id_hash, read, text_slices

SAMPLE_DOCS = 20_000
#: More distinct values of ``lang`` than any list of languages has say that the column is not clean.
MOST_LANGS = 1_000
ROUNDS = 3
#: Words of more letters are scored one by one, STRETCH letters at a time.
SHORT, STRETCH = 32, 1 << 14
FLOOR = 1e-8
TABLE_BITS = 20
#: Bytes of scores that are kept from text to text, chunks that are scored together, and numbers held for words of
#: one length: bounds on memory, not on texts.
CACHE_BYTES, CHUNKS_AT_ONCE, CELLS = 24 << 20, 50_000, 1 << 20
#: Distinct words, and letters of texts, that one task counts before it hands them on.
WORDS_HELD, LETTERS_HELD = 200_000, 1 << 25
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The fixed vocabulary, with a lookup for all substrings of many words at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {char: b for b, char in byte_alphabet().items()}
        texts = set()
        for token in vocab:
            try:
                text = bytes(byte_of[c] for c in token.removesuffix(SUFFIX)).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if _LETTERS.fullmatch(text):
                texts.add(text)
        self.texts = sorted(texts)
        self.longest = max(map(len, self.texts), default=1)
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        keys = np.array([self._key(t) for t in self.texts], np.uint64)
        # Two hash tables without chains: what finds its place taken in the first goes to the second.
        order = np.arange(len(keys))
        self.tables, left = [], order
        for multiplier in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            slots, first = np.unique(self._slots(keys[left], multiplier), return_index=True)
            held, number = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int32)
            held[slots], number[slots] = keys[left[first]], left[first]
            self.tables.append((multiplier, held, number))
            left = np.delete(left, first)
        if len(left):
            raise ValueError("the vocabulary needs larger tables")

    @staticmethod
    def _slots(keys: np.ndarray, multiplier: int) -> np.ndarray:
        return ((keys * np.uint64(multiplier)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        for multiplier, held, number in self.tables:
            slots = self._slots(keys, multiplier)
            out = np.where(held[slots] == keys, number[slots], out)
        return out

    @staticmethod
    def _key(text: str) -> int:
        key = 0
        for c in text:
            key = (key * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def __len__(self) -> int:
        return len(self.texts)

    def prefixes(self, words: list[str]) -> np.ndarray:
        """For words of one length: the key of the first i letters of each, in row i."""
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n + 1, len(words)), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * _BASE + points[:, i]
        return prefix

    def between(self, prefix: np.ndarray, start: int, end: int) -> np.ndarray:
        """The piece number of the letters from ``start`` to ``end`` of each word, or -1."""
        return self.find(prefix[end] - prefix[start] * self.powers[end - start])

    def ending_at(self, word: str, start: int) -> np.ndarray:
        """For STRETCH letters of a word: the numbers of the pieces that end there, by size, or -1."""
        low = max(0, start - self.longest + 1)
        points = np.frombuffer(word[low : start + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        out = np.full((len(points), self.longest), -1, np.int32)
        keys = points.copy()
        out[:, 0] = self.find(keys)
        for size in range(2, min(len(points), self.longest) + 1):
            keys = keys[1:] + points[: len(points) - size + 1] * self.powers[size - 1]
            out[size - 1 :, size - 1] = self.find(keys)
        return out[start - low :]


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return groups


def _slices(members: list[int], cells_each: int) -> Iterator[list[int]]:
    """Members in slices that hold about CELLS numbers together."""
    step = max(1, CELLS // max(1, cells_each))
    for start in range(0, len(members), step):
        yield members[start : start + step]


def _long_steps(table: Pieces, probs: np.ndarray, word: str) -> Iterator[np.ndarray]:
    """For one word of any length: by how much log P(letters so far) grows with each letter, in each language.

    Only the alphas of the last letters are carried on, scaled to the newest.
    """
    before = np.zeros((table.longest, probs.shape[1]))
    before[0] = 1.0
    for start in range(0, len(word), STRETCH):
        for ids in table.ending_at(word, start):
            sizes = np.flatnonzero(ids >= 0)
            alpha = (before[sizes] * probs[ids[sizes]]).sum(axis=0)
            if not len(sizes) or sizes[0] > 0:
                alpha = alpha + before[0] * probs[-1]
            before = np.vstack([np.ones((1, len(alpha))), before[:-1] / alpha])
            yield np.log(alpha)


def _long_score(table: Pieces, probs: np.ndarray, word: str) -> np.ndarray:
    """As ``word_scores`` for one word of any length."""
    return sum(_long_steps(table, probs, word), np.zeros(probs.shape[1]))


def _long_counts(table: Pieces, probs: np.ndarray, word: str) -> np.ndarray:
    """As ``expected_counts`` for one word of any length in one language; holds some numbers a letter.

    Backwards, each place passes on the probability that a cut lies there to the places
    where the piece that ends there can begin.
    """
    total = np.zeros(len(table) + 1)
    logs = np.zeros(len(word) + 1)
    logs[1:] = np.cumsum([step[0] for step in _long_steps(table, probs[:, None], word)])
    cut = np.zeros(len(word) + 1)
    cut[-1] = 1.0
    for start in reversed(range(0, len(word), STRETCH)):
        ending = table.ending_at(word, start)
        for end in range(start + len(ending), start, -1):
            ids = ending[end - start - 1]
            # A letter that is no piece is one all the same: the last row of ``probs``.
            sizes = np.union1d(np.flatnonzero(ids >= 0), [0])
            begins = end - 1 - sizes
            uses = cut[end] * probs[ids[sizes]] * np.exp(logs[begins] - logs[end])
            cut[begins] += uses
            total[ids[sizes]] += uses
    return total[:-1]


def word_scores(table: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), summed over all segmentations: one row a word."""
    out = np.zeros((len(words), probs.shape[1]))
    for n, same_length in _by_length(words).items():
        if n > SHORT:
            for k in same_length:
                out[k] = _long_score(table, probs, words[k])
            continue
        for members in _slices(same_length, n * probs.shape[1]):
            prefix = table.prefixes([words[k] for k in members])
            alpha = [np.ones((len(members), probs.shape[1]))]
            for end in range(1, n + 1):
                # The last row of ``probs`` is for letters that are no piece.
                total = alpha[end - 1] * probs[table.between(prefix, end - 1, end)]
                for size in range(2, min(end, table.longest) + 1):
                    ids = table.between(prefix, end - size, end)
                    hit = np.flatnonzero(ids >= 0)
                    if len(hit):
                        total[hit] += alpha[end - size][hit] * probs[ids[hit]]
                alpha.append(total)
            out[members] = np.log(alpha[n])
    return out


class ChunkScores:
    """Scores of chunks of text, kept from document to document; grows with the distinct chunks of one slice of texts."""

    def __init__(self, table: Pieces, probs: np.ndarray, limit: int = CACHE_BYTES) -> None:
        # A chunk's text and place in the table take about as much as 16 scores.
        self.table, self.probs, self.limit = table, probs, limit // (8 * (probs.shape[1] + 16))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        # Row 0 stands for chunks without a letter.
        self.scores, self.used = np.zeros((1 << 12, self.probs.shape[1])), 1

    def _add(self, new: list[str]) -> None:
        if self.used + len(new) > len(self.scores):
            more = max(len(self.scores), self.used + len(new) - len(self.scores))
            self.scores = np.concatenate([self.scores, np.zeros((more, self.probs.shape[1]))])
        for start in range(0, len(new), CHUNKS_AT_ONCE):
            self._add_some(new[start : start + CHUNKS_AT_ONCE])

    def _add_some(self, new: list[str]) -> None:
        words = [letter_words(c) for c in new]
        distinct = list({w for ws in words for w in ws})
        langs = self.probs.shape[1]
        score = dict(zip(distinct, word_scores(self.table, self.probs, distinct), strict=True)) if langs else {}
        for chunk, ws in zip(new, words, strict=True):
            self.place[chunk] = self.used if ws and langs else 0
            if self.place[chunk]:
                self.scores[self.used] = score[ws[0]] if len(ws) == 1 else sum(score[w] for w in ws)
                self.used += 1

    def of(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """The summed scores of the chunks of each text; nothing where no chunk has a letter."""
        if len(self.place) > self.limit:
            self.clear()
        rows, sizes = numbered(self.place, [lower_chunks(t) for t in texts], self._add)
        ends = np.cumsum(sizes).tolist()
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            own = rows[start:end]
            yield self.scores[own].sum(axis=0) if own.any() else None


def expected_counts(table: Pieces, probs: np.ndarray, words: list[str], lang: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, given word counts of one language each."""
    total = np.zeros((len(table), probs.shape[1]))
    for n, same_length in _by_length(words).items():
        if n > SHORT:
            for k in same_length:
                total[:, lang[k]] += counts[k] * _long_counts(table, probs[:, lang[k]], words[k])
            continue
        for members in _slices(same_length, n * table.longest):
            rows = np.array(members)
            own, weight = lang[rows], counts[rows]
            prefix = table.prefixes([words[k] for k in members])
            alpha, beta, steps = [np.ones(len(rows))], [np.zeros(len(rows)) for _ in range(n)] + [np.ones(len(rows))], {}
            for end in range(1, n + 1):
                alpha.append(np.zeros(len(rows)))
                for size in range(1, min(end, table.longest) + 1):
                    ids = table.between(prefix, end - size, end)
                    hit = np.arange(len(rows)) if size == 1 else np.flatnonzero(ids >= 0)
                    if len(hit):
                        step = probs[ids[hit], own[hit]]
                        steps[end - size, end] = hit, ids[hit], step
                        alpha[end][hit] += alpha[end - size][hit] * step
            for (start, end), (hit, _, step) in sorted(steps.items(), reverse=True):
                beta[start][hit] += step * beta[end][hit]
            for (start, end), (hit, ids, step) in steps.items():
                use = alpha[start][hit] * step * beta[end][hit] / alpha[n][hit] * weight[hit]
                known = ids >= 0
                np.add.at(total, (ids[known], own[hit][known]), use[known])
    return total


def letter_words(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower())


def training_words(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, word, n) over at most ``sample`` labelled documents."""
    labelled = fewest_hashes(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), sample, "language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        letters = 0
        for part, texts in text_slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                seen.setdefault(lang, Counter()).update(letter_words(text))
                letters += len(text)
            if sum(map(len, seen.values())) > WORDS_HELD or letters > LETTERS_HELD:
                yield counts(seen)
                seen.clear()
                letters = 0
        if seen:
            yield counts(seen)

    def counts(seen: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64()], strict=True)], names=["lang", "word", "n"])

    words = labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return words.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their prior and piece probabilities; its size is languages x pieces."""

    def __init__(self, langs: list[str], prior: np.ndarray, probs: np.ndarray) -> None:
        self.langs, self.prior, self.probs = langs, prior, probs


def _normalise(counts: np.ndarray) -> np.ndarray:
    share = (counts + 1e-3) / (counts + 1e-3).sum(axis=0)
    return np.vstack([np.maximum(share, FLOOR), np.full((1, counts.shape[1]), FLOOR)])


def fit(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Learn piece probabilities of each language from labelled documents."""
    words = training_words(docs, sample).persist()
    mass = sorted((r["lang"], r["n"]) for r in words.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST_LANGS + 1).collect())
    if len(mass) > MOST_LANGS:
        words.unpersist()
        raise ValueError(f"more than {MOST_LANGS} distinct values of lang: clean the column first")
    langs = [lang for lang, _ in mass]
    number = {lang: k for k, lang in enumerate(langs)}
    prior = np.array([n for _, n in mass], float) / max(1, sum(n for _, n in mass))
    size = len(pieces(path))
    probs = _normalise(np.zeros((size, len(langs))))

    for _ in range(rounds if langs else 0):
        spread = docs.sparkSession.sparkContext.broadcast(probs)

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            table = pieces(path)
            total = np.zeros((len(table), len(langs)))
            for batch in batches:
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
                total += expected_counts(table, spread.value, batch.column("word").to_pylist(), lang, batch.column("n").to_numpy().astype(float))
            piece, own = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(own), pa.array(total[piece, own])], names=["piece", "lang", "uses"])

        uses = words.mapInArrow(run, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        # At most pieces x languages rows: the size of the model.
        found = uses.toPandas()
        counts = np.zeros((size, len(langs)))
        counts[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["uses"].to_numpy()
        probs = _normalise(counts)
    words.unpersist()
    return Model(langs, prior, probs)


def predict(docs: DataFrame, model: Model, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns and, named by ``out``, the predicted language and its posterior (0 for ``und``)."""
    _free(keep, *out)
    spread = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, probs = spread.value
        cache = ChunkScores(pieces(path), probs)

        for part, texts in text_slices(batches, text_col, 1 << 20):
            names, scores = [], []
            for total in cache.of(texts):
                if total is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = np.log(prior) + total
                best = int(total.argmax())
                names.append(langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            columns = [*(part.column(k) for k in keep), pa.array(names), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *out])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, _types(docs, keep, f"`{out[0]}` string, `{out[1]}` double"))


def trainable(docs: DataFrame) -> DataFrame:
    """The documents that a language model may learn from."""
    return docs.where(F.coalesce(id_hash(), F.lit(0)) % 3 != 1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(trainable(docs), path)
    done = predict(docs.select("doc_id", "text"), model, path)
    return done.select("doc_id", (F.coalesce(id_hash(), F.lit(0)) % 3 == 1).alias("held_out"), "lang_pred", "score")
