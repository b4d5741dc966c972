"""Language-model scores from a weighted backoff automaton over words.

States are histories: the root (no history), every word seen in training and the
start of a text, and every pair of words seen there at least ``LEAST_SEEN`` times.  A
state has an arc for each word that followed its history in training, weighted with
the log of the smoothed probability and leading to the longest history that the words
read so far end in.  Where it has no arc, its failure arc leads to the history
without its first word, weighted with the log of the mass that the state leaves to
backing off; the root has an arc for every word.  A text is read once from left to
right, carrying the state and adding up the weights of the arcs taken.

Smoothing is interpolated, and each conditional distribution sums to one:
    p(w)      = (c(w) + 0.1) / (N + 0.1 (V + 1))      one share is for unknown words
    p(w | h)  = (1 - b) c(h w) / c(h) + b p(w | h'),    b = 1 / (1 + KEEP ln(1 + c(h)))
with h' the history without its first word, so that rare histories lean on shorter
ones.  For words that never followed h that is b p(w | h'): the failure arc.

Counts cover the whole training text and are exact.  No table is gathered in one
place.  Texts become *stretches* of word numbers, written once.  Each stretch sends
its distinct n-grams with their counts to buckets by hash, buckets add up and send
back totals in the order they came, so a stretch gets exactly the part of the
automaton that its texts can reach.  Words and pairs go first; then the triples of
those pairs that became states.  A hot n-gram is one number from each stretch, however
often it occurs.  There are as many messages as an aggregation by n-gram over the same
partitions would have shuffle blocks; the largest task depends on the size of a
stretch and on the number of buckets (the session's shuffle width), which
should grow with the input.

Edge cases: a null or blank text is its end token alone.  Only A-Z are lower-cased.
Unknown words take failure arcs down to the root and the unknown share there.  With no
training text all words share the unknown mass.  A text longer than a stretch is a
stretch.  Repeated rows are scored and counted each; an empty table gives an empty
result.  Null identifiers are kept.  Other input columns, whatever their names, are
dropped.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.common import Workspace, cuts, id_hash, read, shuffle_width, text_slices

ADDED = 0.1
#: Trust in pairs and in triples, and how often a pair is seen before it is a state.
KEEP_2, KEEP_3, LEAST_SEEN = 0.12, 0.6, 2
STRETCH_TOKENS, SEGMENT = 1 << 19, 512
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.uint64(3)


def _pack(values: np.ndarray) -> bytes:
    """Integers by planes of bytes, which makes ascending or small ones short."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return struct.pack("<I", len(values)) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    count, size = struct.unpack_from("<I", data)[0], np.dtype(dtype).itemsize
    planes = pa.decompress(data[4:], decompressed_size=count * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, count).T).view(dtype).ravel()


_STRETCH = "group long, doc_ids array<long>, held array<boolean>, sizes array<long>, words binary, tokens binary"


def stretches(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, held_out, text) as rows of many: identifiers, numbers of tokens, hashes of distinct words, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        ids, held, sizes, found = [], [], [], []

        def flush() -> pa.RecordBatch:
            counts = Counter(found)
            # Frequent words get small numbers.
            order = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0] is None, x[0] or b""))]
            number = {w: k for k, w in enumerate(order)}
            tokens = np.fromiter(map(number.__getitem__, found), "<u4", len(found))
            words = np.array([END if w is None else xxhash.xxh3_64_intdigest(w) for w in order], "<u8")
            row = [[group], [list(ids)], [list(held)], [list(sizes)], [words.tobytes()], [_pack(tokens)]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in _STRETCH.split(", ")])

        for part, texts in text_slices(batches, limit=1 << 20):
            for doc_id, out, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts, strict=True):
                # ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at [\\x20\\x09-\\x0D] only.
                words = text.encode("utf-8", "surrogatepass").lower().split()
                if ids and len(found) + len(words) >= STRETCH_TOKENS:
                    yield flush()
                    group += 1
                    for kept in (ids, held, sizes, found):
                        kept.clear()
                ids.append(doc_id)
                held.append(out)
                sizes.append(len(words) + 1)
                found += words
                found.append(None)
        if ids:
            yield flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _STRETCH)


def _mixed(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """Hashes of n-grams from those of their first words and of their last; the lowest bits tell the order."""
    h = (a * _MULT + b) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) & ~_ORDER | np.uint64(order)


class _Stretch:
    """The tokens of a stretch, and its distinct pairs and triples by number."""

    def __init__(self, row: dict) -> None:
        self.ids, self.held, self.sizes = row["doc_ids"], np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        self.words = np.frombuffer(row["words"], "<u8")
        self.tokens = _unpack(row["tokens"], "<u4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # The number after the last word's stands for the start of a text.
        self.base = len(self.words) + 1
        self.end = int(np.flatnonzero(self.words == END)[0])
        history = np.empty_like(self.tokens)
        history[1:] = self.tokens[:-1]
        history[self.starts] = self.base - 1
        self.pairs, self.pair_of = np.unique(history * self.base + self.tokens, return_inverse=True)
        self.training = np.repeat(~self.held, self.sizes)

    def words_and_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and training counts of the distinct words, then pairs."""
        words = self.words & ~_ORDER | np.uint64(1)
        counts = [np.bincount(x[self.training], minlength=n) for x, n in ((self.tokens, len(words)), (self.pair_of, len(self.pairs)))]
        return np.concatenate([words, self._pair_hashes()]), np.concatenate(counts)

    def _pair_hashes(self) -> np.ndarray:
        hashes = np.append(self.words, START)
        return _mixed(hashes[self.pairs // self.base], hashes[self.pairs % self.base], 2)

    def find_triples(self, pair_totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and training counts of the distinct triples whose first two words are a state."""
        states = self.are_states(pair_totals)
        after = np.ones(len(self.tokens), bool)
        after[self.starts] = False
        after[1:] &= states[self.pair_of[:-1]]
        at = np.flatnonzero(after)
        self.triples, triple_of = np.unique(self.pair_of[at - 1] * self.base + self.tokens[at], return_inverse=True)
        hashes = _mixed(self._pair_hashes()[self.triples // self.base], self.words[self.triples % self.base], 3)
        return hashes, np.bincount(triple_of[self.training[at]], minlength=len(self.triples))

    def are_states(self, pair_totals: np.ndarray) -> np.ndarray:
        return (pair_totals >= LEAST_SEEN) & (self.pairs % self.base != self.end)


_MESSAGE = "bucket int, group long, grams binary, counts binary"
_TOTALS = "group long, bucket int, totals binary, tokens long, types long"


def _messages(group: int, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order].astype("<u4")
    at = cuts(hashes, buckets).tolist()
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        if a < b:
            yield k, group, _pack(hashes[a:b]), _pack(counts[a:b])


def _table(rows: Iterator[tuple] | list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    """Totals for each message of a bucket, in its order; the first row also has what the bucket's words add up to."""
    rows = table.sort_by("group").to_pylist()
    grams = [_unpack(r["grams"], "<u8") for r in rows]
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(place, np.concatenate([_unpack(r["counts"], "<u4") for r in rows]), len(distinct)).astype("<u8")
    of_words = totals[distinct & _ORDER == 1]
    ends = np.cumsum([len(g) for g in grams])
    return _table([
        (r["group"], key[0].as_py(), _pack(totals[place[e - len(g) : e]]), int(of_words.sum()) if not k else 0, int((of_words > 0).sum()) if not k else 0)
        for k, (r, e, g) in enumerate(zip(rows, ends.tolist(), grams, strict=True))
    ], _TOTALS)


def _received(totals: pa.Table, hashes: np.ndarray) -> np.ndarray:
    """The totals of n-grams, in the order of their hashes here."""
    rows = totals.sort_by("bucket").to_pylist()
    out = np.zeros(len(hashes), np.int64)
    out[np.argsort(hashes)] = np.concatenate([_unpack(r["totals"], "<u8") for r in rows] or [np.zeros(0, "<u8")])
    return out


class Automaton:
    """States with failure arcs and weighted arcs; an arc's key is its state times ``base`` plus the word."""

    def __init__(self, s: _Stretch, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, tokens: int, types: int) -> None:
        self.base = s.base
        unigram = (words + ADDED) / (tokens + ADDED * (types + 1))
        self.unigram = unigram
        # As a history, the start of a text is as frequent as its end; an end is no history.
        seen = np.append(words, words[s.end]).astype(float)
        seen[s.end] = 0
        left = 1 / (1 + KEEP_2 * np.log1p(seen))
        first, last = s.pairs // s.base, s.pairs % s.base
        pair = (1 - left[first]) * pairs / np.maximum(seen[first], 1) + left[first] * unigram[last]
        states = s.are_states(pairs)
        left_2 = 1 / (1 + KEEP_3 * np.log1p(pairs))
        of_word, of_pair = np.cumsum(seen > 0) * (seen > 0), np.cumsum(states) * states
        of_pair[states] += int((seen > 0).sum())
        self.start = int(of_word[s.base - 1])

        owner, word = s.triples // s.base, s.triples % s.base
        low = np.searchsorted(s.pairs, last[owner] * s.base + word)
        triple = (1 - left_2[owner]) * triples / np.maximum(pairs[owner], 1) + left_2[owner] * pair[low]

        longest = np.where(of_pair > 0, of_pair, of_word[last])
        has_2, has_3 = (pairs > 0) & (of_word[first] > 0), triples > 0
        root = np.arange(len(words))
        keys = np.concatenate([root, of_word[first[has_2]] * s.base + last[has_2], of_pair[owner[has_3]] * s.base + word[has_3]])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.weight = np.log10(np.concatenate([unigram, pair[has_2], triple[has_3]]))[order]
        self.target = np.concatenate([of_word[: len(words)], longest[has_2], longest[low[has_3]]])[order]
        self.failure = np.concatenate([[0], np.zeros(int((seen > 0).sum()), np.int64), of_word[last[states]]])
        self.failure_weight = np.log10(np.concatenate([[1.0], left[seen > 0], left_2[states]]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word in each of some places: the weights of the arcs taken, and the states reached."""
        weight, state = np.zeros(len(state)), state.copy()
        live = np.arange(len(state))
        while len(live):
            key = state[live] * self.base + word[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            weight[live[found]] += self.weight[at[found]]
            state[live[found]] = self.target[at[found]]
            live = live[~found]
            weight[live] += self.failure_weight[state[live]]
            state[live] = self.failure[state[live]]
        return weight, state

    def walk(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """The weight of each token, reading texts from left to right.

        Long texts are read in segments, all at once.  No history is longer than two
        words, so a later segment's state is found by reading the two words before it.
        """
        pieces = -(-sizes // segment)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(starts, pieces) + segment * nth
        length = np.minimum(np.repeat(starts + sizes, pieces) - begin, segment)
        order = np.argsort(-length, kind="stable")
        begin, length, later = begin[order], length[order], nth[order] > 0
        state = np.where(later, 0, self.start)
        for back in (2, 1):
            _, state[later] = self.step(state[later], tokens[begin[later] - back])
        out = np.zeros(len(tokens))
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, side="left"))
            out[begin[:live] + k], state[:live] = self.step(state[:live], tokens[begin[:live] + k])
        return out


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _ask_triples(buckets: int):
    def run(key: tuple, texts: pa.Table, totals: pa.Table) -> pa.Table:
        rows = []
        for row in texts.to_pylist():
            stretch = _Stretch(row)
            known = _received(totals, stretch.words_and_pairs()[0])
            rows += _messages(row["group"], *stretch.find_triples(known[len(stretch.words) :]), buckets)
        return _table(rows, _MESSAGE)

    return run


def _score(tokens: int, types: int, segment: int):
    def run(key: tuple, texts: pa.Table, totals: pa.Table) -> pa.Table:
        tables = []
        for row in texts.to_pylist():
            s = _Stretch(row)
            known = _received(totals.filter(pa.compute.equal(totals["round"], 1)), s.words_and_pairs()[0])
            words, pairs = known[: len(s.words)], known[len(s.words) :]
            triples = _received(totals.filter(pa.compute.equal(totals["round"], 2)), s.find_triples(pairs)[0])
            automaton = Automaton(s, words, pairs, triples, tokens, types)
            add = lambda x: np.add.reduceat(x, s.starts)  # noqa: B023, E731
            columns = [s.ids, s.held.tolist(), s.sizes, add((words[s.tokens] > 0).astype(np.int64)), np.full(len(s.ids), tokens)]
            columns += [add(np.log10(automaton.unigram)[s.tokens]), add(automaton.walk(s.tokens, s.starts, s.sizes, segment))]
            tables.append(_table(list(zip(*columns, strict=True)), _RESULT))
        return pa.concat_tables(tables) if tables else _table([], _RESULT)

    return run


def score(docs: DataFrame, held_out: Column, buckets: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Train on the rows where ``held_out`` is false and score every row.

    ``buckets`` should make a bucket's n-grams a few millions; the default is the session's shuffle width.
    """
    spark = docs.sparkSession
    buckets = buckets or shuffle_width(spark)
    space = Workspace(spark, "lm")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    texts = space.write(stretches(plain), "stretches")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield from _table(_messages(row["group"], *_Stretch(row).words_and_pairs(), buckets), _MESSAGE).to_batches()

    asked = texts.mapInArrow(ask, _MESSAGE)
    first = space.write(asked.groupBy("bucket").applyInArrow(_add_up, _TOTALS), "totals-1", codec="none")
    del asked
    space.release()
    tokens, types = first.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    asked = texts.groupBy("group").cogroup(first.groupBy("group")).applyInArrow(_ask_triples(buckets), _MESSAGE)
    second = space.write(asked.groupBy("bucket").applyInArrow(_add_up, _TOTALS), "totals-2", codec="none")
    del asked
    space.release()
    totals = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2))).select("group", "bucket", "totals", "round")
    return texts.groupBy("group").cogroup(totals.groupBy("group")).applyInArrow(_score(tokens, types, segment), _RESULT)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score(read(spark, sf_dir, "documents"), id_hash() % 10 == 0)
    # Sums of many logarithms: what differs by their order is rounded away.
    return done.withColumns({k: F.round(k, 6) for k in ("base_score", "score")})


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, doc_id::VARCHAR AS i,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), e AS (
  -- crc32 of the identifier, bit by bit
  SELECT r, doc_id, ws, xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(i))), lambda c, k:
    xor(xor(c, CASE WHEN k % 8 = 0 THEN ascii(i[k // 8 + 1]) ELSE 0 END::BIGINT) >> 1,
      CASE WHEN xor(c, CASE WHEN k % 8 = 0 THEN ascii(i[k // 8 + 1]) ELSE 0 END::BIGINT) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 10 = 0 AS held_out
  FROM d
), t AS (
  SELECT r, held_out, unnest(list_append(ws, ' ')) AS w, generate_subscripts(list_append(ws, ' '), 1) AS pos FROM e
), h AS (
  SELECT *, CASE WHEN pos = 1 THEN '  ' ELSE lag(w) OVER o END AS v, CASE WHEN pos = 2 THEN '  ' WHEN pos > 2 THEN lag(w, 2) OVER o END AS u
  FROM t WINDOW o AS (PARTITION BY r ORDER BY pos)
), c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM h WHERE NOT held_out GROUP BY ALL),
c3 AS (SELECT u, v, w, count(*) AS c FROM h WHERE NOT held_out AND pos > 1 GROUP BY ALL),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1),
histories AS (SELECT CASE WHEN w = ' ' THEN '  ' ELSE w END AS w, c FROM c1),
j AS (
  SELECT h.r, n.n, coalesce(a.c, 0) AS c1, (coalesce(a.c, 0) + 1e-1) / (n.n + 1e-1 * (n.v + 1)) AS p1,
    coalesce(x.c, 0)::DOUBLE AS cv, coalesce(b.c, 0) AS c2, coalesce(y.c, 0)::DOUBLE AS cuv, coalesce(z.c, 0) AS c3
  FROM h JOIN n ON true LEFT JOIN c1 a ON a.w = h.w LEFT JOIN histories x ON x.w = h.v LEFT JOIN c2 b ON b.v = h.v AND b.w = h.w
    LEFT JOIN c2 y ON y.v = h.u AND y.w = h.v LEFT JOIN c3 z ON z.u = h.u AND z.v = h.v AND z.w = h.w
), k AS (SELECT *, 1 / (1 + {KEEP_2} * ln(1 + cv)) AS b1, 1 / (1 + {KEEP_3} * ln(1 + cuv)) AS b2 FROM j),
l AS (SELECT *, CASE WHEN cv > 0 THEN (1 - b1) * c2 / cv + b1 * p1 ELSE p1 END AS p2 FROM k),
s AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, any_value(n) AS train_tokens, sum(log10(p1)) AS base_score,
    sum(log10(CASE WHEN cuv >= {LEAST_SEEN} THEN (1 - b2) * c3 / cuv + b2 * p2 ELSE p2 END)) AS score
  FROM l GROUP BY r
)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM e JOIN s USING (r)
"""
