"""Similarity join on word n-grams: adaptive multi-match prefixes, exact verification.

A document is the set of its distinct word n-grams, as 64-bit hashes.  All sets are
sorted by one global order, rare n-grams first; document frequencies are exact and
cover the whole corpus.  Two sets that meet the threshold share at
least ``l`` n-grams within their prefixes of length ``n - ceil(t n) + l``.  Each
document picks the ``l`` with the least estimated cost, so one whose prefix holds
frequent n-grams gets a longer prefix, and a pair is verified only if it shares
the smaller of its two ``l`` within the prefixes.

Equal sets (by 64-bit digest) are joined once, as one node.  Links matter for
components, so pairs are not listed: rounds of *stars* verify, for each prefix
n-gram, one member of every component against one of the largest, as long as that
finds more than a few links; this joins big groups of near copies with few
comparisons.  Only pairs that still lie in different components are then compared
exhaustively, so no link between components is lost.  Those pairs meet by n-gram and
are let through by size, by place, and by a parity sketch of the two sets: bits that
differ can't outnumber the n-grams that differ, so it never refuses a link.

Edge cases: a null or blank text has the empty set, links with nothing and is its
own component.  A text with fewer words than n is one n-gram of all its words.
Repeated rows and equal sets are one component.  A null identifier takes part and
counts as the greatest.  An empty table gives an empty result.  Other input columns
are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.common import SPACES, Workspace, cuts, read, shuffle_width, text_or_empty, text_slices
from civicforms.llm.components import connected

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Cost of one prefix row that meets another, and of one verification.
MEET_COST, VERIFY_COST, MOST_MATCHES = 1.0, 8.0, 4
#: Rounds of stars at most, and the share of sets that a round must have linked for another one.
STAR_ROUNDS, STAR_YIELD = 6, 0.01
SKETCH_WORDS = 16
_MULT = np.uint64(0x9E3779B97F4A7C15)


_DOC = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def deal(docs: DataFrame, groups: int) -> DataFrame:
    """(group, payload): compressed stretches of documents, dealt by a hash of the identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[pa.RecordBatch]] = [[] for _ in range(groups)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for group, parts in enumerate(waiting):
                if parts:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, _DOC, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(pa.Table.from_batches(parts).combine_chunks())
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["group", "payload"])
                    parts.clear()

        for batch in batches:
            to = batch.column("to").to_numpy()
            plain = batch.select(["doc_id", "held_out", "text"])
            for group in np.unique(to):
                waiting[group].append(plain.filter(pa.array(to == group)).cast(_DOC) if hasattr(pa.RecordBatch, "cast") else plain.filter(pa.array(to == group)))
            size += batch.nbytes
            if size > 64 << 20:
                yield from flush()
                size = 0
        yield from flush()

    to = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")), F.lit("deal")), F.lit(groups)).cast("int")
    return docs.select("doc_id", "held_out", "text", to.alias("to")).mapInArrow(run, "group int, payload binary")


def shingles(text: str, words: _WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at [\\x20\\x09-\\x0D] only.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(n, len(hashes))
    count = len(hashes) - size + 1
    total = np.full(count, size, np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(31))) * _MULT + hashes[k : k + count]
    total = (total ^ (total >> np.uint64(29))) * _MULT
    return np.unique(total ^ (total >> np.uint64(32)))


def prefix(grams: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The n-grams of a set that stand for it in the join, their places in its order, and how many a partner must share.

    N-grams of one set alone meet nothing, so they take up places but are left out.
    """
    size = len(grams)
    if not size:
        return grams, np.zeros(0, np.int64), 0
    order = np.lexsort((grams, frequency))
    least = size - -(-NUMERATOR * size // DENOMINATOR)  # n - ceil(t n)
    longest = min(size, least + MOST_MATCHES)
    met = np.cumsum(frequency[order[:longest]].astype(np.int64) - 1)
    # A partner must share all l, so about a l-th of those met are verified.
    costs = [met[least + k - 1] * (MEET_COST + VERIFY_COST / k) for k in range(1, longest - least + 1)]
    matches = int(np.argmin(costs)) + 1
    chosen = order[: least + matches]
    places = np.flatnonzero(frequency[chosen] > 1)
    return grams[chosen[places]], places, matches


def _set_id(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of n-grams that fall on each bit."""
    bits = 64 * SKETCH_WORDS
    places = ((grams * _MULT) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<i8")


class _Group:
    """A group's documents, their sets, and the distinct n-grams of its distinct sets in order of hash."""

    def __init__(self, payloads: list[bytes], n: int) -> None:
        words = _WordHashes()
        self.ids: list[int | None] = []
        self.text_keys: list[bytes] = []
        self.sets: list[np.ndarray] = []
        for payload in sorted(payloads):
            for batch in pa.ipc.open_stream(payload):
                for part, texts in text_slices([batch]):
                    self.ids += part.column("doc_id").to_pylist()
                    self.text_keys += [hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in texts]
                    self.sets += [shingles(t, words, n) for t in texts]
        self.set_ids = [_set_id(g) if len(g) else None for g in self.sets]
        first = {s: k for k, s in reversed(list(enumerate(self.set_ids))) if s is not None}
        self.first = sorted(first.values())
        together = np.concatenate([self.sets[k] for k in self.first] or [np.zeros(0, np.uint64)])
        self.grams, self.place, self.counts = np.unique(together, return_inverse=True, return_counts=True)


_SENT = "bucket int, group int, grams binary, counts binary"


def _send(n: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = _Group(table.column("payload").to_pylist(), n)
        at = cuts(group.grams, buckets)
        rows = [(k, key[0].as_py(), group.grams[a:b].tobytes(), zlib.compress(group.counts[a:b].astype("<u4").tobytes(), 1)) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
        types = {"bucket": pa.int32(), "group": pa.int32(), "grams": pa.binary(), "counts": pa.binary()}
        columns = zip(*rows, strict=True) if rows else ((),) * len(types)
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))

    return run


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    """Document frequency of each n-gram that a group asked for, in the order asked."""
    rows = table.sort_by("group").to_pylist()
    grams = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), "<u4") for r in rows])
    _, place = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(place, counts).astype("<u4")[place]
    ends = np.cumsum([len(g) for g in grams])
    answers = [zlib.compress(totals[e - len(g) : e].tobytes(), 1) for e, g in zip(ends, grams, strict=True)]
    return pa.table({"group": pa.array([r["group"] for r in rows], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "totals": pa.array(answers, pa.binary())})


_SIGNED = "doc_id long, text_key binary, n_shingles int, set_id long, matches int, prefix array<struct<token: long, place: int>>"


def _sign(n: int):
    arrow = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_shingles", pa.int32()), ("set_id", pa.int64()), ("matches", pa.int32()), ("prefix", pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32())])))])

    def run(key: tuple, texts: pa.Table, totals: pa.Table) -> pa.Table:
        group = _Group(texts.column("payload").to_pylist(), n)
        answers = [zlib.decompress(r["totals"]) for r in totals.sort_by("bucket").to_pylist()]
        frequency = np.frombuffer(b"".join(answers), "<u4")[group.place]
        found, at = {}, 0
        for k in group.first:
            size = len(group.sets[k])
            tokens, places, matches = prefix(group.sets[k], frequency[at : at + size])
            found[k] = (matches, [{"token": t, "place": i} for t, i in zip(tokens.view(np.int64).tolist(), places.tolist(), strict=True)])
            at += size
        rows = [(i, t, len(g), s, *found.get(k, (0, []))) for k, (i, t, g, s) in enumerate(zip(group.ids, group.text_keys, group.sets, group.set_ids, strict=True))]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return run


def text_key() -> Column:
    """Tells rows with one identifier, or none, apart by their text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def signatures(docs: DataFrame, space: Workspace, n: int = WORDS) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id, matches, prefix.  Equal sets of one group have the prefix once.

    Groups of documents send their distinct n-grams to buckets by hash, and get the totals back in the same order.
    """
    width = shuffle_width(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = deal(plain, width)
    sent = dealt.groupBy("group").applyInArrow(_send(n, width), _SENT)
    totals = space.write(sent.groupBy("bucket").applyInArrow(_add_up, "group int, bucket int, totals binary"), "totals", codec="none")
    del sent
    space.release()
    return dealt.groupBy("group").cogroup(totals.groupBy("group")).applyInArrow(_sign(n), _SIGNED)


def whole_sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """set_id, matches, prefix (n-grams), grams and sketch of documents (text, expected set_id, matches, prefix) whose set is as expected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for part, texts in text_slices(batches):
            grams = [shingles(t, words, n) for t in texts]
            right = pa.array([_set_id(g) == e for g, e in zip(grams, part.column("expected").to_pylist(), strict=True)])
            columns = [part.column("expected"), part.column("matches"), part.column("prefix"), *(pa.array(x, pa.list_(pa.int64())) for x in ([g.view(np.int64) for g in grams], [sketch(g) for g in grams]))]
            yield pa.RecordBatch.from_arrays(columns, names=["set_id", "matches", "prefix", "grams", "sketch"]).filter(right)

    return docs.select("text", "expected", "matches", "prefix").mapInArrow(run, "set_id long, matches int, prefix array<long>, grams array<long>, sketch array<long>")


def _candidates(signed: DataFrame) -> DataFrame:
    """(token, place, set_id, n_shingles, matches) of prefix n-grams that at least two different sets hold."""
    rows = signed.where(F.size("prefix") > 0).select("set_id", "n_shingles", "matches", F.inline("prefix"))
    # Grouped first, then joined: the sets of a frequent n-gram are never gathered in one task.
    shared = rows.groupBy("token").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).where("least <> most")
    return rows.join(shared.select("token"), "token", "left_semi").dropDuplicates(["token", "set_id"])


def _could_link(na: Column, ia: Column, nb: Column, ib: Column) -> Column:
    """Whether two sets can meet the threshold if they share an n-gram at these places as one of their first ``MOST_MATCHES``.

    By size, and because all that they share from there on lies behind these places.
    """
    by_size = DENOMINATOR * F.least(na, nb) >= NUMERATOR * F.greatest(na, nb)
    most = F.least(na - ia, nb - ib) + MOST_MATCHES - 1
    return by_size & ((DENOMINATOR + NUMERATOR) * most >= NUMERATOR * (na + nb))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that share enough prefix n-grams and meet the threshold."""
    left = sets.select(F.col("set_id").alias("a"), F.col("grams").alias("ga"), F.col("prefix").alias("pa"), F.col("matches").alias("ma"))
    right = sets.select(F.col("set_id").alias("b"), F.col("grams").alias("gb"), F.col("prefix").alias("pb"), F.col("matches").alias("mb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    both = both.where(F.size(F.array_intersect("pa", "pb")) >= F.least("ma", "mb"))
    common = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - common
    return both.where(DENOMINATOR * common.cast("long") >= NUMERATOR * union.cast("long")).select("a", "b")


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """For each n-gram one member of each component, paired with a member of its largest component."""
    drawn = F.xxhash64("set_id", "token", F.lit(turn))
    members = rows.groupBy("token", "label").agg(F.min_by(F.struct("set_id", "n_shingles", "place"), drawn).alias("m"), F.count(F.lit(1)).alias("size"))
    hub = members.groupBy("token").agg(F.max_by(F.struct("label", "m"), F.struct("size", -F.col("label"))).alias("hub"), F.count(F.lit(1)).alias("labels"))
    pairs = members.join(hub.where("labels > 1"), "token").where("label <> hub.label").select("m", F.col("hub.m").alias("o"))
    pairs = pairs.where(_could_link(*[F.col(c) for c in ("m.n_shingles", "m.place", "o.n_shingles", "o.place")]))
    return pairs.select(F.least("m.set_id", "o.set_id").alias("a"), F.greatest("m.set_id", "o.set_id").alias("b")).distinct()


def _few_differ(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Whether the sketches leave it possible that two sets meet the threshold."""
    differ = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, SKETCH_WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))
    return (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * (na + nb)


def _remaining_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs in different components that share enough prefix n-grams and could meet the threshold by size, place and sketch."""
    open_tokens = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    rows = rows.join(open_tokens, "token", "left_semi").join(sets.select("set_id", "sketch"), "set_id")
    side = lambda x: rows.select(F.col("token").alias(f"t{x}"), *[F.col(c).alias(f"{k}{x}") for c, k in (("set_id", "s"), ("label", "l"), ("n_shingles", "n"), ("matches", "m"), ("place", "i"), ("sketch", "p"))])
    apart = (F.col("sa") < F.col("sb")) & (F.col("la") != F.col("lb"))
    possible = _could_link(*[F.col(c) for c in ("na", "ia", "nb", "ib")]) & _few_differ(*[F.col(c) for c in ("pa", "pb", "na", "nb")])
    met = side("a").join(side("b"), (F.col("ta") == F.col("tb")) & apart & possible)
    shared = met.groupBy(F.col("sa").alias("a"), F.col("sb").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("ma", "mb")).alias("need"))
    return shared.where("shared >= need").select("a", "b")


def _relabel(labels: DataFrame, edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Merge the components that verified edges connect."""
    left = labels.select(F.col("set_id").alias("a"), F.col("label").alias("u"))
    right = labels.select(F.col("set_id").alias("b"), F.col("label").alias("v"))
    joined = connected(edges.join(left, "a").join(right, "b").select("u", "v"), space, f"{name}-parts")
    merged = labels.join(joined.withColumnRenamed("u", "label").withColumnRenamed("v", "into"), "label", "left")
    return space.write(merged.select("set_id", F.coalesce("into", "label").alias("label")), f"{name}-labels")


def _placed(docs: DataFrame, n: int, star_rounds: int) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, label (of its component; null if the set is empty)."""
    space = Workspace(docs.sparkSession, "ngram-join")
    signed = space.write(signatures(docs, space, n), "signatures")
    space.drop("totals")
    space.release()
    rows = space.write(_candidates(signed), "candidates")
    members = space.write(signed.select("doc_id", "text_key", "n_shingles", "set_id"), "members")
    if rows.isEmpty():  # no n-gram is in two prefixes, so nothing can link
        return members.select("doc_id", "text_key", "n_shingles", F.col("set_id").alias("label"))
    nodes = rows.select("set_id").distinct()

    # The whole sets of the candidates alone, from one document each; dealt once by set, for all rounds.
    highest, width = F.lit((1 << 63) - 1), shuffle_width(docs.sparkSession)
    source = F.struct(F.coalesce("doc_id", highest).alias("doc_id"), "text_key", "matches", F.col("prefix.token").alias("prefix"))
    chosen = signed.where(F.size("prefix") > 0).join(nodes, "set_id", "left_semi").groupBy("set_id").agg(F.min_by(source, F.struct(source["doc_id"], "text_key")).alias("of"))
    chosen = chosen.select(F.col("set_id").alias("expected"), "of.doc_id", "of.text_key", "of.matches", "of.prefix")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), highest).alias("doc_id"), text_key().alias("text_key"), "text")
    found = whole_sets(keyed.join(chosen, ["doc_id", "text_key"]), n)
    sets = space.write_bucketed(found.repartition(width, "set_id").dropDuplicates(["set_id"]), "sets", "set_id", width)
    del signed, chosen, found
    space.drop("signatures")
    space.release()

    labels = space.write(nodes.withColumn("label", F.col("set_id")), "labels")
    enough, turn, stars = STAR_YIELD * labels.count(), 0, star_rounds > 0
    while True:
        labelled = rows.join(labels, "set_id")
        pairs = _star_pairs(labelled, turn) if stars else _remaining_pairs(labelled, sets)
        edges = space.write(_verified(pairs, sets), f"edges-{turn}")
        linked = edges.count()
        if linked:
            labels = _relabel(labels, edges, space, f"turn-{turn}")
        turn += 1
        del labelled, pairs, edges
        space.release()
        if not stars:
            break
        stars = turn < star_rounds and linked > enough
    space.drop("sets")

    return members.join(labels, "set_id", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("label", "set_id").alias("label"))


def components(docs: DataFrame, n: int = WORDS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    placed = _placed(docs, n, star_rounds).drop("text_key")
    least = placed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    placed = placed.join(least, "label", "left")
    return placed.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component one with the smallest doc_id, and all blank texts."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_key").alias("__text")))
    stay = _placed(docs, n, STAR_ROUNDS).where("label IS NOT NULL").groupBy("label").agg(smallest.alias("of")).select("of.*")
    own_id, blank = F.col("doc_id").cast("long"), F.translate(text_or_empty(), SPACES, "") == ""
    key = {"__none": own_id.isNull(), "__id": F.coalesce(own_id, F.lit(0)), "__text": text_key()}
    linked = docs.where(~blank).withColumns(key).join(stay, list(key), "left_semi").dropDuplicates(list(key)).drop(*key)
    return linked.unionByName(docs.where(blank))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT x AS doc_id, x AS other FROM both_ways
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
