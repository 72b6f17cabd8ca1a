"""Exact top-k search by inner product with norm-bucketed retrieval.

Candidates are sorted by norm and cut into buckets of close norms, each held as
blocks of ``block_rows`` vectors; queries are packed into packs, searched
``query_rows`` at a time. The buckets of the largest norms are searched first
and give each query a bound: its k-th best score so far, t. In a bucket with
largest norm l a candidate can only reach t if its cosine with the query is at
least c = t / (|q| * l):

* c > 1: the block is skipped for this query. Whole query packs are not even
  sent to blocks that no query of theirs needs.
* c >= ``coordinate_from``: coordinate pruning. A unit vector with cosine >= c
  has in coordinate f a value within c*q_f -+ sqrt((1-c^2)(1-q_f^2)); the
  largest coordinates of the query are tested (LEMP's feasible regions). It is
  done where the first test leaves at most ``FEW`` of a sample of the block;
  else the products are cheaper than the tests.
* else: length pruning, candidates with |p| < t / |q| go (a prefix of the
  sorted block stays).

What is left is verified by exact integer products; the bound rises from block
to block. Pruning keeps ties, so the result is exact.

Blocks and packs hold their vectors in the narrowest integers that fit. A query
pack is sent once to each shelf, a run of buckets, so what is shuffled is the
candidates once and the queries once per shelf; a task holds one shelf, a pack
and at most a few times k hits per query of it. The products are as many as
queries times candidates where norms are about equal.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do null ids; of several rows with one id the least vector (in
array order) counts; shorter vectors are padded with zeros; other columns are
ignored. Scores are exact as long as they fit into a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from forumflow.llm.common import drop_staged, ship, staged

_BLOCK = "bucket int, n int, dim int, top double, ids binary, vecs binary"
_BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("top", pa.float64()),
                          ("ids", pa.binary()), ("vecs", pa.binary())])
_HITS = "qb bigint, query_id bigint, vec_id bigint, score bigint"
_HITS_ARROW = pa.schema([("qb", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Coordinates tested by coordinate pruning; slack against rounding of the float bounds.
FOCUS, SLACK = 6, 1e-9
#: Coordinate pruning where the first test leaves this share of a sample of so many rows at most.
FEW, SAMPLE = 0.125, 64
#: Components of a block or pack at most; packs of so many times query_rows; bytes of a batch for Python.
ELEMENTS, PACK, BATCH_BYTES = 1 << 18, 8, 4 << 20
#: Shelves that are wanted, or 4 a core if that is more; bytes of a shelf of several buckets at most; partitions per key, so
#: that few of them get two.
SHELVES, SHELF_BYTES, SPREAD = 64, 32 << 20, 4
#: The first search takes one bucket in so many, and one shelf at most.
SEED_SHARE = 16


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vec, norm2): floor(scale * x) of usable vectors, one per id."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    vec = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("bigint"))
    return (rows.where(F.coalesce(usable, F.lit(False)))
            .select(F.col("vec_id").cast("bigint"), vec.alias("vec"))
            .groupBy("vec_id").agg(F.min("vec").alias("vec"))
            .withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))


def _narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _packer(block_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        ids = lens = values = np.zeros(0, np.int64)

        def block(ids: np.ndarray, lens: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            dim = int(lens.max())
            m = np.zeros((len(ids), dim), np.int64)
            m[np.arange(dim) < lens[:, None]] = values
            top = math.sqrt(float((m[0].astype(np.float64) ** 2).sum()))
            cells = [bucket, len(ids), dim, top, ids.tobytes(), _narrow(m).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(cells, _BLOCK_ARROW)], schema=_BLOCK_ARROW)

        def full() -> int:
            """Rows of the next block, 0 if it may get more."""
            head = lens[:block_rows]
            n = max(1, int(np.searchsorted(np.maximum.accumulate(head) * np.arange(1, len(head) + 1), ELEMENTS, side="right")))
            return n if n < len(head) or n == block_rows else 0

        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False)])
            lens = np.concatenate([lens, batch.column(1).value_lengths().to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).flatten().to_numpy(zero_copy_only=False)])
            while n := full():
                size = int(lens[:n].sum())
                yield block(ids[:n], lens[:n], values[:size])
                ids, lens, values = ids[n:], lens[n:], values[size:]
        if len(ids):
            yield block(ids, lens, values)
    return pack


class _Block:
    def __init__(self, dim: int, ids: bytes, vecs: bytes, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        size = len(vecs) // (len(self.ids) * dim) if len(self.ids) * dim else 8
        m = np.frombuffer(vecs, f"i{size}").reshape(len(self.ids), dim)
        self.vecs = np.pad(m, ((0, 0), (0, max(0, width - dim))))
        self.peak = max(-float(m.min(initial=0)), float(m.max(initial=0)))
        self.norms = np.sqrt((self.vecs.astype(np.float64) ** 2).sum(1))
        self._as: dict = {}

    def exact(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.vecs.astype(kind)
        return self._as[kind]

    @cached_property
    def units(self) -> np.ndarray:
        """Unit vectors, a row for each coordinate."""
        return np.ascontiguousarray((self.vecs.astype(np.float64) / np.where(self.norms > 0, self.norms, 1)[:, None]).T)

    @cached_property
    def focus(self) -> np.ndarray:
        """Each vector's largest coordinates."""
        return np.argsort(-np.abs(self.units), axis=0, kind="stable")[:FOCUS].T


def _exact_type(p: _Block, q: _Block) -> type:
    """A type in which inner products are exact: floats where they hold all sums."""
    peak = p.peak * q.peak * max(1, p.vecs.shape[1])
    return np.float32 if peak < 2 ** 24 else np.float64 if peak < 2 ** 53 else np.int64


def regions(unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values that a unit vector with ``cosine`` at least has beside the query's values ``unit``."""
    reach = np.sqrt(np.maximum(0.0, 1 - cosine * cosine)) * np.sqrt(np.maximum(0.0, 1 - unit ** 2))
    # cosine >= c leaves a cap around the query; where it holds an end of the axis, that side is open
    low = np.where(unit <= -cosine, -1.0, cosine * unit - reach)
    high = np.where(unit >= cosine, 1.0, cosine * unit + reach)
    return low - SLACK, high + SLACK


def feasible(block: _Block, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) numbers within the regions of all focus coordinates; a row of ``focus``, ``low``, ``high`` is a query."""
    if not focus.shape[1]:
        return np.repeat(np.arange(len(focus)), len(block.ids)), np.tile(np.arange(len(block.ids)), len(focus))
    x = block.units[focus[:, 0]]
    query, row = np.nonzero((x >= low[:, :1]) & (x <= high[:, :1]))
    for f in range(1, focus.shape[1]):
        x = block.units[focus[query, f], row]
        keep = (x >= low[query, f]) & (x <= high[query, f])
        query, row = query[keep], row[keep]
    return query, row


def _cosines(block: _Block, norms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least cosine with which one of the block's rows reaches each query's bound; 0 where all may."""
    top = float(block.norms[0])
    if top == 0:
        return np.where((bounds > 0) & (norms > 0), math.inf, 0.0)
    return np.where((bounds > 0) & (norms > 0), bounds / (np.maximum(norms, 1e-300) * top) - SLACK, 0.0)


def _long_enough(block: _Block, norms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the block's first rows (sorted by falling norm) each query needs by their length."""
    least = np.where((bounds > 0) & (norms > 0), bounds / np.maximum(norms, 1e-300), -1.0)
    return np.searchsorted(-block.norms, -least * (1 - SLACK), side="right")


def survivors(block: _Block, q: np.ndarray, q_norm: float, bound: float, coordinate_from: float) -> np.ndarray:
    """Numbers of the block's rows (sorted by falling norm) that may reach ``bound`` (ties stay)."""
    norm, bounds = np.array([q_norm]), np.array([bound], np.float64)
    cosine = float(_cosines(block, norm, bounds)[0])
    if cosine > 1:
        return np.arange(0)
    keep = int(_long_enough(block, norm, bounds)[0])
    if bound <= 0 or q_norm == 0 or cosine < coordinate_from:
        return np.arange(keep)
    unit = q / q_norm
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    low, high = regions(unit[focus], np.array(cosine))
    rows = feasible(block, focus[None], low[None], high[None])[1]
    return rows[rows < keep]


class _Best:
    """The k best hits so far of each query of a pack, and its bound."""

    def __init__(self, q: _Block, bounds: np.ndarray, k: int):
        self.q, self.k, self.bounds, self.parts, self.size = q, k, bounds.copy(), [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, ids, scores.astype(np.int64)))
            self.size += len(query)

    def cut(self) -> None:
        """Leaves k hits of each query and raises its bound to the k-th."""
        if not self.parts:
            return
        query, ids, scores = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        last = rank == self.k - 1
        self.bounds[query[last]] = np.maximum(self.bounds[query[last]], scores[last])
        keep = rank < self.k
        self.parts, self.size = [(query[keep], ids[keep], scores[keep])], int(keep.sum())

    def search(self, p: _Block, block_rows: int, query_rows: int, coordinate_from: float) -> None:
        kind = _exact_type(p, self.q)
        common = np.flatnonzero(np.isin(p.ids, self.q.ids))
        at = [(r, c) for r in common.tolist() for c in np.flatnonzero(self.q.ids == p.ids[r]).tolist()]
        for a in range(0, len(self.q.ids), query_rows):
            own = np.arange(a, min(a + query_rows, len(self.q.ids)))
            cosine = _cosines(p, self.q.norms[own], self.bounds[own])
            own, cosine = own[cosine <= 1], cosine[cosine <= 1]
            by_region = self._by_region(p, own, cosine, coordinate_from) if len(own) else None
            if by_region is not None:
                self._pairs(p, kind, own[by_region], cosine[by_region])
                own = own[~by_region]
            if len(own):
                self._products(p, kind, own, [(r, c) for r, c in at if a <= c < a + query_rows])
            if self.size > 4 * self.k * len(self.q.ids):
                self.cut()
        if self.size >= 2 * self.k * len(self.q.ids):
            self.cut()

    def _by_region(self, p: _Block, own: np.ndarray, cosine: np.ndarray, coordinate_from: float) -> np.ndarray | None:
        """Of which queries coordinate pruning leaves few rows."""
        near = (cosine >= coordinate_from) & (self.bounds[own] > 0) & (self.q.norms[own] > 0)
        if not near.any() or not self.q.focus.shape[1]:
            return None
        few, f = own[near], self.q.focus[own[near], 0]
        low, high = regions(self.q.units[f, few], cosine[near])
        x = p.units[f][:, ::max(1, len(p.ids) // SAMPLE)]
        near[near] = ((x >= low[:, None]) & (x <= high[:, None])).mean(1) <= FEW
        return near if near.any() else None

    def _pairs(self, p: _Block, kind: type, own: np.ndarray, cosine: np.ndarray) -> None:
        """Coordinate pruning, then products of single pairs."""
        focus = self.q.focus[own]
        low, high = regions(self.q.units[focus, own[:, None]], cosine[:, None])
        query, row = feasible(p, focus, low, high)
        query = own[query]
        other = self.q.ids[query] != p.ids[row]
        query, row = query[other], row[other]
        step = max(1, ELEMENTS // max(1, p.vecs.shape[1]))
        for a in range(0, len(query), step):
            j, r = query[a:a + step], row[a:a + step]
            scores = np.einsum("ij,ij->i", p.exact(kind)[r], self.q.exact(kind)[j])
            enough = scores >= self.bounds[j]
            self.add(j[enough], p.ids[r[enough]], scores[enough])

    def _products(self, p: _Block, kind: type, own: np.ndarray, same: list[tuple[int, int]]) -> None:
        """Length pruning, then products of all rows that are long enough."""
        n = int(_long_enough(p, self.q.norms[own], self.bounds[own]).max())
        scores = self.q.exact(kind)[own] @ p.exact(kind)[:n].T
        lowest = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
        place = {int(c): i for i, c in enumerate(own)} if same else {}
        for r, c in same:
            if c in place and r < n:
                scores[place[c], r] = lowest
        bounds = self.bounds[own] if kind is np.int64 else np.maximum(self.bounds[own].astype(kind), np.finfo(kind).min)
        hit = np.flatnonzero(scores >= bounds[:, None])
        if len(hit) > 2 * self.k * len(own) and n > self.k:
            kth = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
            hit = np.flatnonzero(scores >= np.maximum(bounds, kth)[:, None])
        query, row = np.divmod(hit, max(1, n))
        found = scores.ravel()[hit]
        if lowest in found:
            query, row, found = query[found != lowest], row[found != lowest], found[found != lowest]
        if len(query) > 4 * self.k * len(own):                  # many ties
            order = np.lexsort((p.ids[row], -found, query))
            starts = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            order = order[rank < self.k]
            query, row, found = query[order], row[order], found[order]
        self.add(own[query], p.ids[row], found)

    def hits(self, qb: int) -> pa.RecordBatch | None:
        self.cut()
        if not self.parts:
            return None
        query, ids, scores = self.parts[0]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(len(query), qb), self.q.ids[query], ids, scores)],
                                          schema=_HITS_ARROW)


def _search(k: int, block_rows: int, query_rows: int, coordinate_from: float):
    """Top k of each query over the blocks that stand beside its pack in neighbouring rows, given its bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, qb = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                width = max(r["q_dim"], r["dim"])
                if best is None or r["qb"] != qb or width != best.q.vecs.shape[1]:
                    if best is not None and (found := best.hits(qb)) is not None:
                        yield found
                    q, qb = _Block(r["q_dim"], r["q_ids"], r["q_vecs"], width), r["qb"]
                    best = _Best(q, np.frombuffer(r["bounds"], np.float64) if r["bounds"] else np.full(len(q.ids), -np.inf), k)
                best.search(_Block(r["dim"], r["ids"], r["vecs"], width), block_rows, query_rows, coordinate_from)
        if best is not None and (found := best.hits(qb)) is not None:
            yield found
    return run


def _bounds(k: int):
    """Per query pack: the k-th best score so far of each of its queries (-inf if there are fewer)."""
    def run(key, left, right):
        dim = left.column("q_dim")[0].as_py()
        q = _Block(dim, left.column("q_ids")[0].as_py(), left.column("q_vecs")[0].as_py(), dim)
        order = np.argsort(q.ids)
        best = _Best(q, np.full(len(q.ids), -np.inf), k)
        ids = right.column("query_id").to_numpy()
        best.add(order[np.searchsorted(q.ids[order], ids)], right.column("vec_id").to_numpy(), right.column("score").to_numpy())
        best.cut()
        need = np.where((q.norms > 0) & (best.bounds > 0), best.bounds / np.maximum(q.norms, 1e-300), 0)
        return pa.table({"qb": [key[0].as_py()], "bounds": [best.bounds.tobytes()], "need": [float(need.min()) * (1 - SLACK)]})
    return run


@contextmanager
def _bounded_batches(spark: SparkSession):
    """Rows of blocks and packs go to Python in batches of about ``BATCH_BYTES``."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, block_rows: int = 4096, query_rows: int = 256,
          max_buckets: int = 1024, coordinate_from: float = 0.6) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest products over every other vector.

    Both inputs are ``integer_vectors``. Buckets are at most ``max_buckets``
    (their norms are all that the driver sees); a larger bucket has more blocks.
    """
    ship(vectors.sparkSession)
    with _bounded_batches(vectors.sparkSession):
        return _top_k(vectors, queries, k, block_rows, query_rows, max_buckets, coordinate_from)


def _top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int, query_rows: int, max_buckets: int,
           coordinate_from: float) -> DataFrame:
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    vectors = staged(vectors, "topk-vectors")
    n = vectors.count()
    buckets = min(max_buckets, max(1, -(-n // block_rows)))
    blocks = staged(vectors.repartitionByRange(buckets, F.desc("norm2"), "vec_id")
                    .sortWithinPartitions(F.desc("norm2"), "vec_id").select("vec_id", "vec")
                    .mapInArrow(_packer(block_rows), _BLOCK), "topk-blocks")
    drop_staged(vectors)
    # hashing deals about so many queries to a partition; an eighth more still fits into one pack
    pack_rows = PACK * query_rows
    ids = staged(queries.select("vec_id", "vec"), "topk-ids")
    packs = max(1, -(-ids.count() * 8 // (7 * pack_rows)))
    packed = staged(ids.repartition(packs, "vec_id").mapInArrow(_packer(pack_rows), _BLOCK)
                    .select(F.monotonically_increasing_id().alias("qb"), F.col("bucket").alias("q_part"), F.col("dim").alias("q_dim"),
                            F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")), "topk-queries")
    drop_staged(ids)
    found = blocks.groupBy("bucket").agg(F.max("top").alias("top"), F.sum(F.octet_length("ids") + F.octet_length("vecs")).alias("size")).collect()
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    tops, room = {r.bucket: r.top for r in found}, max(1, SHELF_BYTES // max(r["size"] for r in found))
    search = _search(k, block_rows, query_rows, coordinate_from)
    columns = ["qb", "q_dim", "q_ids", "q_vecs", "bounds", "dim", "ids", "vecs"]
    # Spark sizes a repeated table by its files, many times too small, and would broadcast it: joins are by merging.
    # The first search: its few blocks are repeated per salt, so that packs are dealt to many tasks.
    seeds = sorted(tops)[:min(room, -(-len(tops) // SEED_SHARE))]
    salts = min(packs, SPREAD * cores)
    first = blocks.where(F.col("bucket") <= seeds[-1]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    seed = (packed.withColumn("bounds", F.lit(None).cast("binary")).withColumn("salt", F.pmod("q_part", F.lit(salts)))
            .repartition(SPREAD * salts, "salt").hint("merge").join(first.repartition(SPREAD * salts, "salt"), "salt")
            .select(*columns))
    seeded = staged(seed.mapInArrow(search, _HITS), "topk-seed")
    bounded = packed.groupBy("qb").cogroup(seeded.groupBy("qb")).applyInArrow(
        _bounds(k), "qb bigint, bounds binary, need double")
    bounded = staged(packed.hint("merge").join(bounded, "qb"), "topk-bounds")
    hits, later = seeded, [b for b in sorted(tops) if b > seeds[-1]]
    if later:
        # buckets come by falling norm: a pack goes to the shelves, and meets the blocks, whose largest norm reaches its least demand
        per = min(room, -(-len(later) // max(SHELVES, SPREAD * cores)))
        shelf = F.floor((F.col("bucket") - later[0]) / per).cast("int")
        reach: dict[int, float] = {}
        for b in later:
            reach[(b - later[0]) // per] = max(tops[b], reach.get((b - later[0]) // per, 0.0))
        sent = F.array(*[F.struct(F.lit(s).alias("shelf"), F.lit(t).alias("reach")) for s, t in reach.items()])
        wanted = (bounded.withColumn("w", F.explode(sent)).where(F.col("w.reach") >= F.col("need")).withColumn("shelf", F.col("w.shelf"))
                  .repartition(SPREAD * len(reach), "shelf"))
        stored = blocks.where(F.col("bucket") >= later[0]).withColumn("shelf", shelf).repartition(SPREAD * len(reach), "shelf")
        pairs = wanted.hint("merge").join(stored, "shelf").where(F.col("top") >= F.col("need")).select(*columns)
        hits = hits.unionByName(pairs.mapInArrow(search, _HITS))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = staged(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"), "topk-best")
    for done in (blocks, packed, seeded, bounded):
        drop_staged(done)
    return out
