"""Vector codes by product quantisation, with codebooks from ball k-means over integers.

Components are scaled to integers, so every sum, distance and tie is exact.  A vector is cut
into equal parts and each part position has a codebook.  An entry with the parts
assigned to it is a ball; its radius is the greatest distance of a part from the entry.
By the triangle inequality another entry can only win a part at distance d if it lies
within 2 d of the part's own entry, hence:

* entries beyond twice a ball's radius are no neighbours and are never looked at;
* a part in the stable core, nearer than half way to the nearest neighbour, skips all work;
* the others lie in annular rings, and a ring's parts are compared only with the
  neighbours that reach it, exactly;
* where an entry has not moved, only neighbours that have can win.

A ball is taken within a batch of rows, which makes its radius as small as can be.  Vectors
with their codes are a written table after each round, so a round reads its predecessor and
lost executors repeat only their share.  What goes to the driver and back is the
codebooks, at most ``parts * entries`` short vectors, and their partial sums.

Edge cases: vectors that are null, empty, or hold null, NaN or infinite components are
dropped, as are those with a component beyond 2**16 (their squares leave 64 bits) and those
whose length is no multiple of the number of parts or not that of the first kept one.
Null identifiers sort last; of equal identifiers the lesser vector comes first; repeated
rows count and are returned as often as they occur.  A label's error beyond 64 bits is null.  With fewer kept vectors than entries
the codebooks are as short.  An empty table gives an empty result.  Other input columns are
never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.common import Workspace, read

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
GREATEST = 1 << 16
#: Rings take in this many neighbours, then as many times more.
RING = 4


def kept_vectors(vectors: DataFrame, parts: int = PARTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and the scaled vector (array of long) of the rows that can be coded, whatever their length."""
    usable = lambda x: F.coalesce(F.abs(x.cast("double")) <= GREATEST, F.lit(False))  # noqa: E731  NaN is greater than all
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0) & F.forall("vector", usable))
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE)))


class Balls:
    """One part position's codebook with the distances between its entries."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None) -> None:
        self.entries = entries
        self.moved = np.ones(len(entries), bool) if before is None else (entries != before).any(axis=1)
        self.apart = squared(entries, entries)
        np.fill_diagonal(self.apart, -1)  # each entry comes first among its own neighbours
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(self.apart, self.order, axis=1)

    def assign(self, x: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, of several the first, and its squared distance; ``own`` was nearest before the entries moved."""
        if own is None:
            far = squared(x, self.entries)
            code = far.argmin(axis=1)
            return code, far[np.arange(len(x)), code]
        code = own.copy()
        away = ((x - self.entries[own]) ** 2).sum(axis=1)
        best = away.copy()
        rows = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[rows], np.arange(len(self.entries) + 1))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            ball = rows[ends[i] : ends[i + 1]]
            n = int(np.searchsorted(self.apart[i], 4 * away[ball].max(), "right"))
            others, reach = self.order[i, 1:n], self.apart[i, 1:n]
            if not self.moved[i]:
                others, reach = others[self.moved[others]], reach[self.moved[others]]
            near = np.searchsorted(reach, 4 * away[ball], "right")
            low, high = 0, RING
            while low < len(others):
                ring = ball[(near > low) & (near <= high)]
                if len(ring):
                    rivals = np.sort(others[:high])
                    far = squared(x[ring], self.entries[rivals])
                    at = far.argmin(axis=1)
                    least, rival = far[np.arange(len(ring)), at], rivals[at]
                    wins = (least < best[ring]) | ((least == best[ring]) & (rival < i))
                    code[ring[wins]], best[ring[wins]] = rival[wins], least[wins]
                low, high = high, high * RING
        return code, best


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; by floating-point products where these are exact."""
    reach = int(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    if 4 * reach * reach * x.shape[1] < 1 << 52:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _assign(rows: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """Rows with the codes of their parts (array of int) and their squared distance from what these stand for, by these codebooks."""
    spread = rows.sparkSession.sparkContext.broadcast((books, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, before = spread.value
        balls = [Balls(b, None if before is None else before[k]) for k, b in enumerate(books)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.split(_matrix(batch.column("vector")), len(books), axis=1)
            own = None if before is None else _matrix(batch.column("code"))
            done = [ball.assign(x[k], None if own is None else own[:, k]) for k, ball in enumerate(balls)]
            codes = np.stack([d[0] for d in done], axis=1).astype(np.int32)
            ends = pa.array(np.arange(0, codes.size + 1, len(books)), pa.int32())
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("vector"), pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), pa.array(sum(d[1] for d in done))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vector", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, vector array<long>, code array<int>, error long")


def _moved_books(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the whole-number mean of its parts; unused ones stay."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = np.split(_matrix(batch.column("vector")), parts, axis=1), _matrix(batch.column("code"))
            for k in range(parts):
                rows = np.argsort(codes[:, k], kind="stable")
                used, first = np.unique(codes[rows, k], return_index=True)
                sums[k, used] += np.add.reduceat(x[k][rows], first, axis=0)
                counts[k] += np.bincount(codes[:, k], minlength=entries)
        at = np.flatnonzero(counts)
        place = (at[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.reshape(-1)[place]), pa.array(np.repeat(counts.reshape(-1)[at], width))], names=["place", "total", "n"])

    sums = coded.select("vector", "code").mapInArrow(add, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = sums.toPandas()  # one row for each component of the codebooks at most
    new = books.reshape(-1).copy()
    new[found["place"].to_numpy(np.int64)] = np.floor_divide(found["total"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    return new.reshape(books.shape)


def quantize(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **columns: str) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (array of int) and error of every row that can be coded, and the codebooks (part, entry, component)."""
    space = Workspace(vectors.sparkSession, "ball-codes")
    kept = kept_vectors(vectors, parts, **columns)
    first = F.col("vec_id").asc_nulls_last(), F.col("vector")
    start = kept.orderBy(*first).select(F.size("vector").alias("n")).first()
    if start is None:
        return kept.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    kept = space.write(kept.where(F.size("vector") == start["n"]), "vectors")
    # The model: as many rows as a codebook has entries.
    seeds = np.array([r["vector"] for r in kept.orderBy(*first).limit(entries).select("vector").collect()], np.int64)
    books, before, rows, last = np.stack(np.split(seeds, parts, axis=1)), None, kept, "vectors"
    for k in range(rounds + 1):
        rows = space.write(_assign(rows, books, before), f"round-{k}")
        space.drop(last)
        last = f"round-{k}"
        if k < rounds:
            before, books = books, _moved_books(rows, books)
    return rows.select("vec_id", "label", "code", "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the sum of the error over the rows of a label, those without one together."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantize(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return with_label_error(coded).select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    """Every part against every entry, round by round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (
  SELECT r, x.p, e, (x.norm - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS d FROM x JOIN c{k} c ON c.p = x.p
), a{k} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM d{k} GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT p, e, j, floor(sum(v[j]) / count(*))::DOUBLE AS m FROM a{k} JOIN x USING (r, p), range(1, 1 + (SELECT max(len(v)) FROM x)) t(j) GROUP BY p, e, j),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS v FROM m{k} GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)""")
    return rf"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(y::DOUBLE * 1024)) AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), x AS MATERIALIZED (
  SELECT r, p, u AS v, list_inner_product(u, u) AS norm FROM (SELECT r, p::INT AS p, v[len(v) // 4 * p + 1 : len(v) // 4 * (p + 1)] AS u FROM kept, range(4) t(p))
), c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 256),{",".join(steps)},
books AS (SELECT sha256(string_agg(n::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS n, unnest(range(len(v))) AS j FROM c{rounds})),
f AS (SELECT r, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN f USING (r), books
"""


ORACLE = _oracle()
