"""Sharding by a minimax contiguous partition of ordered atomic groups.

Documents of equal text form one atomic group. Groups are ordered by their
least doc_id (then by text digest) and cut into contiguous shards so that the
largest shard is as small as possible: a binary search over the capacity, each
capacity checked greedily, then cuts where the greedy pass fills up.

Spark sorts the documents once by (group, doc_id) into ranges and adds running
sums within ranges and over the (few) ranges, so a group of any size spreads
over tasks. The greedy check only asks "the last group end at or before x".
It is answered from an index of at most ``bins`` rows per level: the least and
the greatest group end in each of ``bins`` equal slices. A question that falls
inside a slice is open; the open slices are refined by one aggregation over
the group ends, until the search meets none. No group list is collected.

DataFrame functions only. Defined results: null counts as the empty text; equal
texts (null and empty too) stay together; repeated doc_ids are rows of their
own; with fewer groups than shards the last shards are empty; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from forumflow.llm.common import doc_text, shuffle_parts, staged


class _Ends:
    """Predecessor search over the sorted group ends, by slices refined on demand."""

    def __init__(self, ends: DataFrame, total: int, bins: int):
        self.ends, self.bins = ends, bins
        self.slices: list[tuple[int, int]] = []      # (least end, greatest end), ascending
        self.open: set[tuple[int, int]] = set()
        self._replace([(1, total)])

    def _replace(self, ranges: list[tuple[int, int]]) -> None:
        """Cut each of the ranges into ``bins`` slices, with one aggregation."""
        per = max(2, self.bins // len(ranges))
        part, cond = None, None
        for i, (a, b) in enumerate(ranges):
            width = -(-(b - a + 1) // per)
            key = F.lit(i * per) + F.floor((F.col("end") - F.lit(a)) / F.lit(width)).cast("bigint")
            inside = F.col("end").between(a, b)
            part = F.when(inside, key) if part is None else part.when(inside, key)
            cond = inside if cond is None else cond | inside
        rows = (self.ends.where(cond).groupBy(part.alias("slice"))
                .agg(F.min("end").alias("lo"), F.max("end").alias("hi")).collect())
        gone = set(ranges)
        self.slices = sorted([s for s in self.slices if s not in gone] + [(r.lo, r.hi) for r in rows])
        self.los = [s[0] for s in self.slices]
        self.open.clear()

    def last_at_most(self, x: int) -> int:
        """The greatest end <= x (0 if none); notes the slice if it can't be told yet."""
        i = bisect_right(self.los, x) - 1
        if i < 0:
            return 0
        lo, hi = self.slices[i]
        if hi <= x:
            return hi
        if lo != hi:
            self.open.add((lo, hi))
        return lo

    def refine(self) -> bool:
        """Refine what was open; False if nothing was."""
        if not self.open:
            return False
        self._replace(sorted(self.open)[: self.bins // 2])
        return True


def _cuts(ends: _Ends, capacity: int, total: int, shards: int) -> list[int] | None:
    """Greedy cuts for a capacity; None if the groups don't fit."""
    at, cuts = 0, []
    for _ in range(shards):
        nxt = ends.last_at_most(at + capacity)
        if nxt <= at and at < total:
            return None
        at = nxt
        cuts.append(at)
        if at >= total:
            return cuts
    return None


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, bins: int = 4096) -> list[int]:
    """Ends of the shards for the smallest feasible capacity."""
    if not total:
        return []
    index = _Ends(ends, total, bins)
    while True:
        lo = max(largest, -(-total // shards))
        hi = lo + largest                       # always feasible
        while lo < hi:
            mid = (lo + hi) // 2
            if _cuts(index, mid, total, shards) is None:
                lo = mid + 1
            else:
                hi = mid
        cuts = _cuts(index, lo, total, shards)
        if not index.refine():
            return cuts


def shard_documents(docs: DataFrame, *, shards: int = 16, bins: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard, in group order)."""
    spark = docs.sparkSession
    rows = doc_text(docs).select(
        F.col("doc_id").cast("bigint"), (F.octet_length("text") + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.sha2("text", 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    rows = rows.join(first, "digest")
    n = shuffle_parts(spark)
    placed = staged(rows.repartitionByRange(n, "first_id", "digest", "doc_id")
                    .withColumn("part", F.spark_partition_id()), "shard-rows")
    order = ["first_id", "digest", "doc_id", "size"]
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
                          F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"))
    # one row per range: at most the number of shuffle partitions
    run = staged(placed.withColumn("size_in", F.sum("size").over(within))
                 .withColumn("row_in", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
                 .join(F.broadcast(offsets), "part")
                 .select("doc_id", "size", "text_crc32", "first_id", "digest",
                         (F.col("size_before") + F.col("size_in")).alias("end"),
                         (F.col("rows_before") + F.col("row_in") - 1).alias("pos")), "shard-run")
    groups = staged(run.groupBy("first_id", "digest").agg(F.max("end").alias("end"), F.sum("size").alias("size"))
                    .select("end", "size"), "shard-groups")
    top = groups.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
    cuts = minimax_cuts(groups.select("end"), top.total or 0, top.largest or 0, shards, bins)
    shard = sum([(F.col("end") > F.lit(c)).cast("int") for c in cuts[:-1]], F.lit(0))
    run = run.withColumn("shard", shard)
    starts = {r.shard: r.p for r in run.groupBy("shard").agg(F.min("pos").alias("p")).collect()}   # one row per shard
    start = F.lit(0)
    for k, p in starts.items():
        start = F.when(F.col("shard") == k, F.lit(p)).otherwise(start)
    return run.select("doc_id", "size", "text_crc32", "shard", (F.col("pos") - start).cast("bigint").alias("slot"))
