"""Vector codes by product quantisation with ball k-means, in exact integers.

Vectors are scaled to integers, cut into equal consecutive parts and packed into
blocks, which keep their codes from round to round. In a round each block forms,
per part, the balls of its own vectors around the new codebook entries:

* a ball's radius r (its largest distance to its entry) gives its neighbour
  entries: only entries at a distance of 2 r or less can take a vector from it;
* vectors nearer to their entry than half the way to its nearest neighbour are
  the stable core: they stay and no other distance is computed;
* the others lie in rings: one at distance d only meets the neighbours at a
  distance of 2 d or less from its entry, and only these exact distances are
  computed (rings are cut where a further ``RING`` neighbours come in).

All tests are on squared integer distances and include equality, so ties go to
the lower index as they would in a full search. Per block sums and counts are
added up by Spark; the driver sees the codebooks only (entries x components).

Defined results: rows whose vector is null or holds null or non-finite
components are dropped; shorter vectors (and lengths that the number of parts
does not divide) are filled up with zeros; null ids come last in the order of
ids, equal ids are ordered by their vectors, and each row gets its code; scaled
components are held within +-sqrt(2^60 / part length) / 2 (beyond 131,000 for
parts of 16) so that distances fit into a long; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumflow.llm.common import drop_staged, salted_left_join, ship, staged

#: Vectors in a block, rows of one exact distance table, neighbours that a ring adds.
BLOCK, CHUNK, RING = 16_384, 4096, 16
_BLOCK = "ids array<bigint>, labels array<string>, vecs binary, codes binary, sums binary, counts binary"
_BLOCK_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vecs", pa.binary()),
                          ("codes", pa.binary()), ("sums", pa.binary()), ("counts", pa.binary())])


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, label, vec): floor(scale * x) of the usable vectors; labels as text."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return rows.where(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("bigint")).alias("vec"))


def squared_distances(x: np.ndarray, c: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Integer squared distances between the rows of x and of c; by floats where these are exact."""
    kind = np.float64 if exact_floats else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def full_search(x: np.ndarray, entries: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Number of each row's nearest entry, ties to the lower number."""
    return np.concatenate([squared_distances(x[a:a + CHUNK], entries, exact_floats).argmin(1) for a in range(0, len(x), CHUNK)]
                          or [np.zeros(0, np.int64)])


def own_distances(x: np.ndarray, entries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - entries[codes]
    return (d * d).sum(1)


class Balls:
    """An entry's neighbours, nearest first, and their squared distances from it."""

    def __init__(self, entries: np.ndarray, exact_floats: bool):
        self.entries, self.exact_floats = entries, exact_floats
        between = squared_distances(entries, entries, exact_floats)
        np.fill_diagonal(between, -1)                                       # the entry itself comes first
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, 1)

    def search(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """Nearest entries of rows that were in the balls ``codes``; and the number of distances computed."""
        own, out, work = own_distances(x, self.entries, codes), codes.copy(), len(x)
        by_ball = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[by_ball], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            members = by_ball[a:b]
            ball = int(codes[members[0]])
            near, far = self.order[ball], self.between[ball]
            reach = 4 * own[members]                                        # (2 d)^2
            n_near = int(np.searchsorted(far, reach.max(), side="right"))   # neighbours by the ball's radius
            if n_near < 2:
                continue
            ring = np.searchsorted(far[:n_near], reach, side="right")       # candidates of each member, itself first
            active = ring > 1                                               # the others are the stable core
            members, ring = members[active], ring[active]
            best, found = own[members], np.full(len(members), ball)
            for s in range(1, n_near, RING):
                rows = np.flatnonzero(ring > s)
                if not len(rows):
                    break
                candidates = np.sort(near[s:min(s + RING, n_near)])
                for t in range(0, len(rows), CHUNK):
                    some = rows[t:t + CHUNK]
                    d = squared_distances(x[members[some]], self.entries[candidates], self.exact_floats)
                    work += d.size
                    at = d.argmin(1)
                    d, at = d[np.arange(len(some)), at], candidates[at]
                    better = (d < best[some]) | ((d == best[some]) & (at < found[some]))
                    best[some[better]], found[some[better]] = d[better], at[better]
            out[members] = found
        return out, work


class Shape:
    """How vectors lie in blocks: parts, their width, number type; whether floats hold distances exactly."""

    def __init__(self, parts: int, dim: int, peak: float):
        self.parts, self.width = parts, max(1, -(-dim // parts))
        self.limit = math.isqrt(2 ** 60 // self.width) // 2
        peak = int(min(peak, self.limit))
        self.kind = np.int16 if peak < 2 ** 15 else np.int64
        self.exact_floats = (2 * peak) ** 2 * self.width < 2 ** 53

    def rows(self, vecs: bytes) -> np.ndarray:
        """(parts, vectors, width)"""
        return np.frombuffer(vecs, self.kind).reshape(-1, self.parts, self.width).swapaxes(0, 1)

    def pad(self, vecs: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(vecs), self.parts * self.width), np.int64)
        for row, v in zip(out, vecs):
            row[:len(v)] = v
        return np.clip(out, -self.limit, self.limit).astype(self.kind)


def _batch(values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK_ARROW)], schema=_BLOCK_ARROW)


def _pack(shape: Shape, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return _batch([t.column(0).to_pylist(), t.column(1).to_pylist(), shape.pad(t.column(2).to_pylist()).tobytes(), None, None, None])

        for batch in batches:
            while batch.num_rows:
                room = block - sum(h.num_rows for h in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(h.num_rows for h in held) == block:
                    yield packed()
                    held = []
        if held:
            yield packed()
    return run


def _assign(shape: Shape, books: np.ndarray, last: bool):
    """A round over blocks: new codes, and their sums and counts (in the last round errors instead)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = None
        for batch in batches:
            for ids, labels, vecs, codes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                parts = shape.rows(vecs)
                if codes is None:
                    found = [full_search(x, entries, shape.exact_floats) for x, entries in zip(parts, books)]
                else:
                    balls = balls or [Balls(entries, shape.exact_floats) for entries in books]
                    before = np.frombuffer(codes, np.uint8).reshape(shape.parts, -1).astype(np.int64)
                    found = [b.search(x, c)[0] for b, x, c in zip(balls, parts, before)]
                new = np.stack(found).astype(np.uint8)
                if last:
                    error = sum(own_distances(x, entries, c) for x, entries, c in zip(parts, books, found))
                    text = [bytes(c).hex() for c in new.T]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(text, pa.string()),
                                                      pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
                    continue
                sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
                for p, (x, c) in enumerate(zip(parts, found)):
                    np.add.at(sums[p], c, x.astype(np.int64))
                    counts[p] = np.bincount(c, minlength=books.shape[1])
                yield _batch([ids, labels, vecs, new.tobytes(), sums.tobytes(), counts.tobytes()])
    return run


def totals(blocks: DataFrame, shape: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, sums) of the used entries, added up over all blocks by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums += np.frombuffer(s, np.int64).reshape(shape)
                counts += np.frombuffer(c, np.int64).reshape(shape[:2])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
                                          pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    rows = blocks.select("sums", "counts").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    found = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(shape[2])]).alias("sums"))
    return {(r.part, r.entry): (r.n, r.sums) for r in found.collect()}          # parts x entries rows at most


def train_codes(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4,
                block: int = BLOCK) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error), codebooks): ``vectors`` is ``integer_vectors``."""
    spark = vectors.sparkSession
    ship(spark)
    size = vectors.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda e: F.abs(e.cast("double")))))).head()
    if size[0] is None:
        return spark.createDataFrame([], "vec_id bigint, label string, code string, error bigint"), None
    shape = Shape(parts, size[0], size[1] or 0)
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()   # ``entries`` rows
    books = shape.pad([r.vec for r in start]).astype(np.int64).reshape(-1, parts, shape.width).swapaxes(0, 1).copy()
    blocks = staged(vectors.mapInArrow(_pack(shape, block), _BLOCK), "codes-0")
    for n in range(rounds):
        coded = staged(blocks.mapInArrow(_assign(shape, books, False), _BLOCK), f"codes-{n + 1}")
        drop_staged(blocks)
        blocks = coded
        for (part, entry), (count, sums) in totals(blocks, books.shape).items():
            books[part, entry] = [s // count for s in sums]
    out = staged(blocks.mapInArrow(_assign(shape, books, True), "vec_id bigint, label string, code string, error bigint"), "codes-out")
    drop_staged(blocks)
    return out, books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = train_codes(integer_vectors(rows), **options)
    if books is None:
        return coded.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"))
    tag = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label")))
    coded = coded.withColumn("tag", tag)
    sums = staged(coded.groupBy("tag").agg(F.sum("error").alias("label_error")), "codes-labels")
    return salted_left_join(coded, sums, "tag").select("vec_id", "code", "error", "label_error",
                                                       F.lit(books_digest(books)).alias("codebooks_sha256"))
