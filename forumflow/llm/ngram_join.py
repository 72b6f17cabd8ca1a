"""N-gram Jaccard self-join by MinHash banding.

Texts are compared as sets of shingles of ``n`` consecutive words (``common.words``;
a text of fewer words, but not none, is one shingle). Texts with equal word
sequences are one node. Bands and rows are chosen so that a pair at the
threshold meets in some band with probability ``recall``; every pair that meets
is verified on the full shingle sets.

No pair list is built. A bucket (band, hash) is a group of nodes; buckets with
the same members are processed once; a bucket beyond ``block_nodes`` nodes or
``block_bytes`` of shingles is dealt into blocks, and a task takes two blocks at
a time. It verifies the pairs whose first common band is the bucket's, so each
pair counts once, and returns each node's number of links and a spanning forest
of them. Classes are the connected components of the forests.

Defined results: null and empty texts (and texts without words) have no
shingles, no links, and are classes of their own; equal rows are documents of
their own; other columns are ignored. A class is named by its least doc_id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumflow.llm.common import free_name, doc_text, shuffle_parts, small_side, staged, text_slices, words

N, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 96
_SIG = "doc_id bigint, node binary, n_shingles bigint, bands array<bigint>"
_SIG_ARROW = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()),
                        ("bands", pa.list_(pa.int64()))])
_SET = "node binary, bands binary, shingles binary"
_SET_ARROW = pa.schema([("node", pa.binary()), ("bands", pa.binary()), ("shingles", pa.binary())])
_LINK = "a binary, b binary, texts bigint, docs bigint"
_LINK_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64())])


def band_plan(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, as many as ``recall`` asks for, take ``max_hashes`` at most."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


# -- shingles ---------------------------------------------------------------

_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _BASE_INV)):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
    return _powers[0], _powers[1]


def shingles(w: list[bytes], n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a word list."""
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    data = np.frombuffer(joined, np.uint8)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    blanks = np.flatnonzero(data == 32)
    starts, ends = np.r_[0, blanks + 1], np.r_[blanks, len(data)]
    k = max(1, len(starts) - n + 1)
    lo, hi = starts[:k], ends[-k:]
    return np.unique(_mix((sums[hi] - sums[lo]) * down[lo]))


def band_hashes(sh: np.ndarray, bands: int, rows: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    a = rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, 2 ** 64 - 1, np.uint64)
    for i in range(0, len(sh), 4096):
        x = sh[i:i + 4096]
        least = np.minimum(least, ((x[None, :] ^ b[:, None]) * a[:, None]).min(1))
    out = np.arange(1, bands + 1, dtype=np.uint64) * _BASE
    for r in range(rows):
        out = _mix(out + least.reshape(bands, rows)[:, r])
    return out.view(np.int64)


def _node(w: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(w), digest_size=16).digest()


def signatures(docs: DataFrame, *, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (digest of the word sequence), n_shingles, bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            out: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                w = words(text)
                sh = shingles(w, n)
                out[1].append(_node(w))
                out[2].append(len(sh))
                out[3].append(band_hashes(sh, bands, rows) if w else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out[1:], list(_SIG_ARROW)[1:]))],
                                             schema=_SIG_ARROW)
    return doc_text(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _SIG)


def _sets(docs: DataFrame, *, n: int, bands: int, rows: int) -> DataFrame:
    """node, bands, full shingle set of (text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            out: tuple[list, ...] = ([], [], [])
            size = 0
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                w = words(text)
                sh = shingles(w, n)
                for column, value in zip(out, (_node(w), band_hashes(sh, bands, rows).tobytes(), sh.tobytes())):
                    column.append(value)
                size += sh.nbytes
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], schema=_SET_ARROW)
                    out, size = ([], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], schema=_SET_ARROW)
    return docs.select("text").mapInArrow(run, _SET)


# -- verification -----------------------------------------------------------

def common_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair (rows of two numbers) of sets."""
    if len(pairs) <= 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[codes] > 1                                  # others are in no intersection
    codes, owner = codes[shared], owner[shared]
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    _, codes = np.unique(codes, return_inverse=True)
    total = np.zeros((len(sets), len(sets)), np.float32)        # sets are far below 2^24 shingles
    width = max(64, (1 << 23) // len(sets))
    for at in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        a, b = np.searchsorted(codes, [at, at + width])
        present = np.zeros((len(sets), width), np.float32)
        present[owner[a:b], codes[a:b] - at] = 1
        total += present @ present.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _links(band: int, sides: np.ndarray, two: bool, bands: np.ndarray, sets: list[np.ndarray],
           threshold: float) -> np.ndarray:
    """Verified pairs (i < j) whose first common band is ``band``."""
    n = len(sets)
    found = []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if two:
            j = j[sides[j] != sides[i]]
        same = bands[j] == bands[i]
        j = j[same[:, band] & ~same[:, :band].any(1)]
        found.append(np.stack([np.full(len(j), i), j], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(pairs):
        return pairs
    sizes = np.array([len(s) for s in sets])
    common = common_counts(sets, pairs)
    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common
    return pairs[common >= threshold * union - 1e-9]


def _verify(threshold: float):
    """Rows sorted by (band, hash, i, j) -> each node's links and a spanning forest of them."""
    def group(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        rows = list({r[0]: r for r in rows}.values())
        nodes, sides = [r[0] for r in rows], np.array([r[1] for r in rows])
        copies = np.array([r[2] for r in rows], np.int64)
        bands = np.array([np.frombuffer(r[3], np.int64) for r in rows])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        band, _, i, j = key
        pairs = _links(band, sides, i != j, bands, sets, threshold)
        texts, docs = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for a, b in ((0, 1), (1, 0)):
            np.add.at(texts, pairs[:, a], 1)
            np.add.at(docs, pairs[:, a], copies[pairs[:, b]])
        for k in np.flatnonzero(texts):
            yield nodes[k], None, int(texts[k]), int(docs[k])
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs.tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                yield nodes[a], nodes[b], 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out = []
        for key, some in groupby(rows(), key=lambda r: r[:4]):
            out += group(key, [r[4:] for r in some])
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _LINK_ARROW)], schema=_LINK_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _LINK_ARROW)], schema=_LINK_ARROW)
    return run


# -- components -------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large and small stars; root is the least node.

    Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        return (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(least.select("a", F.col("m").alias("b"))).distinct())

    def mark(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())

    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = mark(e)
    while before[0]:
        e = staged(stars(e), "cc")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# -- the join ---------------------------------------------------------------

def near_duplicates(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
                    max_hashes: int = MAX_HASHES, block_nodes: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, class_id, n_links (other documents at the threshold), n_texts (other texts among them)."""
    spark = docs.sparkSession
    bands, rows = band_plan(threshold, recall, max_hashes)
    sig = staged(signatures(docs, n=n, bands=bands, rows=rows), "nj-signatures")
    nodes = staged(sig.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")),
                   "nj-nodes")
    one = sig.join(nodes, (sig["node"] == nodes["node"]) & (sig["doc_id"] == nodes["rep"])).select(sig["node"], "n_shingles", "bands")
    member = one.select("node", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    h = F.xxhash64("node")
    bucket = (member.groupBy("band", "hash")
              .agg(F.count("*").alias("size"), F.sum(F.col("n_shingles") * 8).alias("bytes"),
                   F.sum(F.shiftright(h, 32)).alias("f1"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("f2"))
              .where("size > 1")
              # equal members: the first band's bucket holds all that the others would find
              .groupBy("size", "bytes", "f1", "f2").agg(F.min(F.struct("band", "hash")).alias("k"))
              .select("k.band", "k.hash", F.greatest(F.ceil(F.col("size") / block_nodes), F.ceil(F.col("bytes") / block_bytes))
                      .cast("int").alias("blocks")))
    member = staged(member.join(bucket, ["band", "hash"]).select("node", "band", "hash", "blocks"), "nj-members")
    needed = staged(member.select("node").distinct().join(nodes, "node").select("rep").distinct(), "nj-needed")
    text = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    sets = _sets(text.join(small_side(needed), "rep"), n=n, bands=bands, rows=rows)
    sets = sets.join(nodes.select("node", "copies"), "node")
    block = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")
    dealt = (member.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("node", "band", "hash", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    work = (dealt.join(sets, "node")
            .select("band", "hash", "i", "j", "node", F.col("block").alias("side"), "copies", "bands", "shingles")
            .repartition(shuffle_parts(spark), "band", "hash", "i", "j").sortWithinPartitions("band", "hash", "i", "j"))
    found = staged(work.mapInArrow(_verify(threshold), _LINK), "nj-links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    joined = components(found.where("b is not null").select("a", "b"))
    roots = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = roots.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = staged(roots.join(names, "root").join(links, "node", "left")
                   .select(F.col("node").alias("key"), "class_id", "copies", "texts", "docs"), "nj-classes")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (sig.select("doc_id", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
            .join(named, F.col("node") == F.col("key"), "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                    (zero("docs") + F.coalesce(F.col("copies"), F.lit(1)) - 1).cast("bigint").alias("n_links"),
                    zero("texts").cast("bigint").alias("n_texts")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: that with the least doc_id (null last), of several such rows any one.

    Rows are told apart by numbers of their own, so ids may be null or repeated;
    a row without words is in no class and stays.
    """
    number, row_id = free_name("_row", docs), free_name("_id", docs)
    numbered = staged(docs.withColumn(number, F.monotonically_increasing_id()), "nj-numbered")
    classes = staged(near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"), **options)
                     .where("n_links > 0").select(F.col("doc_id").alias(number), "class_id"), "nj-result")
    named = numbered.select(number, F.col("doc_id").cast("bigint").alias(row_id)).join(small_side(classes), number)
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col(row_id).isNull(), row_id, number)).alias("first"))
    gone = staged(classes.select(number).join(first.select(F.col(f"first.{number}").alias(number)), number, "left_anti"), "nj-gone")
    return numbered.join(small_side(gone), number, "left_anti").drop(number)
