"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes has a Shannon entropy.  Entropies far from that
of ordinary prose are rare, so windows are ranked by how far theirs is.  In each
run of neighbouring windows the rarest (leftmost of equals) gets a vote; windows with
votes from a quarter of a run's length are the features.  A run has the fewest
windows, a power of two up to ``LONGEST_RUN``, that keep a text's runs apart within
``MOST`` windows: one in a short text, where every window is a feature, twice as many
whenever the text gets twice as long.  What stands out in long runs also stands out in
shorter ones, so texts of different lengths share their rarest windows.  Features are
hashed into a chain
of Bloom filters, a new one about every ``PER_FILTER`` features.  Two chains are compared
filter by filter: bits in common beyond those expected by chance, as a share of
the most there could be, best match for each filter of the shorter chain.

Counts in a sliding window change by one byte at each step, so entropies of whole
buffers come from ``WINDOW`` - 1 shifted comparisons and one running sum, all in integers:
the same text gives the same features wherever it lies.

Edge cases: a null text counts as empty, and an empty text has no feature; two
empty texts are alike (1), an empty and another are not (0).  A text shorter than a
window is one feature.  Windows of nearly constant bytes are features only in
texts that have no others.  Equal identifiers are ordered by text.  Repeated rows
follow each other.  A table of one row is its own next document; an empty table
gives an empty result.  Null identifiers come first.  Other input columns, whatever
their names, are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicforms.llm.common import Workspace, read, shuffle_width, text_slices

WINDOW, MOST, LONGEST_RUN = 16, 64, 64
PER_FILTER, FILTER_BITS, HASHES = 80, 1024, 5
#: Entropy in bits of a window of ordinary prose, and below which a window says too little.
TYPICAL, LEAST = 3.1, 1.0
BLOCK = 1 << 17

# c log2 c in fixed point, and its steps: what one more equal byte adds.
_COUNT = np.arange(WINDOW + 2)
_PART = np.rint(_COUNT * np.log2(np.maximum(_COUNT, 1)) * 65536).astype(np.int64)
_STEP = np.diff(_PART)
_TYPICAL_SUM = round((np.log2(WINDOW) - TYPICAL) * WINDOW * 65536)
_FLAT_SUM = round((np.log2(WINDOW) - LEAST) * WINDOW * 65536)
_FLAT_KEY = (1 << 20) + 1


def window_sums(data: np.ndarray) -> np.ndarray:
    """Sum of c log2 c over the byte counts of each window: high where entropy is low."""
    n = len(data) - WINDOW + 1
    out = np.empty(max(n, 0), np.int64)
    for at in range(0, n, BLOCK):
        part = data[at : at + BLOCK + WINDOW]
        after, before = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for k in range(1, WINDOW):
            same = (part[:-k] == part[k:]).view(np.uint8)
            after[:-k] += same
            before[k:] += same
        size = min(BLOCK, n - at)
        first = _PART[np.bincount(part[:WINDOW], minlength=256)].sum()
        steps = _STEP[before[WINDOW : WINDOW + size - 1]] - _STEP[after[: size - 1]]
        out[at] = first
        out[at + 1 : at + size] = first + np.cumsum(steps)
    return out


def run_length(size: int) -> int:
    """Windows to a run in a text of so many bytes."""
    windows, run = size - WINDOW + 1, 1
    while run < LONGEST_RUN and windows > MOST * run:
        run *= 2
    return run


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of each text in order, and the text each belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    hashes, owners = [], []
    if len(data) >= WINDOW:
        sums = window_sums(data)
        own = np.repeat(np.arange(len(texts)), sizes)[: len(sums)]
        place = np.arange(len(sums))
        left = ends[own] - place - WINDOW  # further windows of the same text
        # Rarest first: greatest distance from the typical entropy; flat windows last.
        flat = sums >= _FLAT_SUM
        keys = np.where(flat, _FLAT_KEY, (1 << 20) - np.minimum(np.abs(sums - _TYPICAL_SUM) >> 12, 1 << 20)) << 32 | place
        runs = np.array([run_length(n) for n in sizes.tolist()])
        run_of = runs[own]
        votes, span, low = np.zeros(len(sums), np.int64), 1, keys
        while True:
            whole = np.flatnonzero((run_of[: len(low)] == span) & (left[: len(low)] >= span - 1))
            if len(whole):
                votes += np.bincount(low[whole] & 0xFFFFFFFF, minlength=len(sums)) >= max(1, span // 4)
            if span == LONGEST_RUN or len(low) <= span or not (runs > span).any():
                break
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        at = np.flatnonzero(votes)
        others = np.zeros(len(texts), bool)
        others[own[at[~flat[at]]]] = True
        at = at[~flat[at] | ~others[own[at]]]
        words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].copy().view("<u8")
        h = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
        for k in range(words.shape[1]):
            h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        hashes.append(h)
        owners.append(own[at])
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    hashes.append(np.array([xxhash.xxh3_64_intdigest(texts[k]) for k in short], np.uint64))
    owners.append(short)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], owner[order]


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """Chained filters of each text, after the number of its features (u32)."""
    hashes, owner = features(texts)
    counts = np.bincount(owner, minlength=len(texts))
    # What would fill less than half of a last filter goes to the one before it.
    chains = np.where(counts > 0, np.maximum(1, (counts + PER_FILTER // 2) // PER_FILTER), 0)
    first_filter = np.cumsum(chains) - chains
    rank = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    filters = np.zeros((int(chains.sum()), FILTER_BITS), np.uint8)
    row = first_filter[owner] + np.minimum(rank // PER_FILTER, chains[owner] - 1)
    for k in range(HASHES):
        filters[row, (hashes >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = 1
    packed = np.packbits(filters, axis=1, bitorder="little")
    return [int(n).to_bytes(4, "little") + packed[a : a + c].tobytes() for n, a, c in zip(counts, first_filter, chains, strict=True)]


def _opened(digest: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = int.from_bytes(digest[:4], "little")
    filters = np.frombuffer(digest[4:], np.uint64).reshape(-1, FILTER_BITS // 64)
    sizes = np.full(len(filters), PER_FILTER)
    if len(filters):
        sizes[-1] = count - PER_FILTER * (len(filters) - 1)  # from a half to three halves of the others
    return filters, sizes


def likeness(a: bytes, b: bytes) -> float:
    """0 (nothing in common beyond chance) to 1 (the same features)."""
    if a == b:
        return 1.0
    (fa, na), (fb, nb) = sorted((_opened(a), _opened(b)), key=lambda x: len(x[0]))
    if not len(fa):
        return 0.0
    bits_a, bits_b = np.bitwise_count(fa).sum(axis=1), np.bitwise_count(fb).sum(axis=1)
    total = 0.0
    for k in range(len(fa)):
        common = np.bitwise_count(fa[k] & fb).sum(axis=1)
        most = np.minimum(bits_a[k], bits_b)
        chance = bits_a[k] * bits_b.astype(float) / FILTER_BITS
        share = (common - chance) / np.maximum(most - chance, 1e-9)
        total += na[k] * max(0.0, min(1.0, float(share.max())))
    return float(total / na.sum())


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, kind string, text string"
_NAMES = [field.split()[0] for field in _TYPES.split(", ")]
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]


def _done(rows: list[tuple[int | None, str, bytes]], following: list[tuple[str, bytes]]) -> list[tuple]:
    """Result rows of documents (id, text, digest) and what follows each (text, digest)."""
    changed = [edited(text, after) for (_, text, _), (after, _) in zip(rows, following, strict=True)]
    raw = [c.encode("utf-8", "surrogatepass") for c in changed]
    digests = fingerprints(raw)
    return [
        (doc_id, len(text), hashlib.sha256(r).hexdigest(), own, new, likeness(own, new), likeness(own, after), None, "done", None)
        for (doc_id, text, own), (_, after), r, new in zip(rows, following, raw, digests, strict=True)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ARROW, strict=True)], names=_NAMES)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint documents in order; the first and last of a partition go out with their text as well."""
    part_no, waiting = TaskContext.get().partitionId(), None
    for part, texts in text_slices(batches, limit=1 << 20):
        digests = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
        rows = list(zip(part.column("doc_id").to_pylist(), texts, digests, strict=True))
        out = []
        if waiting is None:
            out.append((rows[0][0], None, None, rows[0][2], None, None, None, part_no, "head", rows[0][1]))
        else:
            rows.insert(0, waiting)
        waiting = rows[-1]
        out += _done(rows[:-1], [(text, digest) for _, text, digest in rows[1:]])
        yield _batch(out)
    if waiting is not None:
        yield _batch([(waiting[0], None, None, waiting[2], None, None, None, part_no, "last", waiting[1])])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield _batch(_done([(r["doc_id"], r["text"], r["fingerprint"])], [(r["next_text"], r["next_fingerprint"])]))


def compare_with_edits(docs: DataFrame, space: Workspace) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they and the next document are."""
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = space.write(ordered.mapInArrow(_scan, _TYPES), "fingerprints")
    heads = rows.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = rows.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint")
    # One small row for each partition that has documents; the last is followed by the first.
    order = rows.where("kind = 'head'").select("part")
    following = F.lead("part").over(Window.orderBy("part"))
    order = order.select("part", F.coalesce(following, F.min("part").over(Window.partitionBy())).alias("next_part"))
    ends = lasts.join(order, "part").join(heads, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    return rows.where("kind = 'done'").unionByName(ends.mapInArrow(_finish, _TYPES)).drop("part", "kind", "text")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare_with_edits(read(spark, sf_dir, "documents"), Workspace(spark, "fingerprints"))
    return rows.withColumns({k: F.translate(F.base64(F.col(k)), "\r\n", "") for k in ("fingerprint", "edited_fingerprint")})
