"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct words and the words' beginnings of 4, 5 and 6
characters (so that endings not met in training count too), hashed into
``2**BITS`` buckets. The machine scores w0 + sum w_i + the pairwise
interactions <v_i, v_j> of the terms present, so that pairs of terms can mean
more than their sum.

It is fitted on a bounded sample of the labelled rows: the first
``max_toxic`` / ``max_clean`` labelled ids of each kind in the order of their
hashes, features computed where the documents lie, the fit in one task over the
sample only. Where a cap is reached the classes are sampled at different rates;
the log of the ratio of the two rates is then taken off w0, so that scores hold
at the ratio of all usable labels whatever the caps. The model (at most 2**BITS
rows) is broadcast and every whole text is scored.

Defined results: a null or empty text scores the model's constant; labels other
than 0 and 1 don't count, nor do labels without a document; a document with several
labels is toxic if one says so; equal rows of the sample are one row that weighs as many;
without any usable label of both kinds every score is the share of toxic
labels (0 without labels); repeated documents give a row each; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumflow.llm.common import doc_text, drop_texts, id_crc32, staged, text_digest, text_slices, words

BITS, RANK = 18, 4
MAX_TOXIC, MAX_CLEAN = 4000, 8000
STARTS = (4, 5, 6)
EPOCHS, RATE, L2_W, L2_V = 200, 0.3, 1e-4, 1e-4
#: A term takes part if it is in so many sampled texts, and its toxic share is so many
#: standard deviations off the sample's share, or a pair with it tells more than its terms
#: alone (``paired``): rare terms would only be learnt by heart.
MIN_DOCS, MIN_Z = 5, 4.0
#: Bound of the chance that any pair at all takes part without meaning, in each direction.
FALSE_PAIRS = 0.01
#: Words whose terms a task remembers.
CACHE_WORDS = 100_000
#: Terms in a block of ``paired``: two blocks of 12,000 texts take 48 MB.
PAIR_BLOCK = 512
THRESHOLD = 0.7


def _ids(word: bytes) -> tuple:
    mask = (1 << BITS) - 1
    text = word.decode("utf-8", "replace")
    return (zlib.crc32(b"w " + word) & mask,
            *(zlib.crc32(b"p " + text[:n].encode()) & mask for n in STARTS if len(text) > n))


def terms(text: bytes, cache: dict[bytes, tuple]) -> np.ndarray:
    """Sorted distinct hashed terms of a text; ``cache`` remembers words."""
    found: set[int] = set()
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in set(words(text)):
        ids = cache.get(w)
        if ids is None:
            ids = cache[w] = _ids(w)
        found.update(ids)
    return np.sort(np.fromiter(found, np.int32, len(found)))


def _segment_sums(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of x over rows; rows without terms sum to 0."""
    out = np.zeros((len(starts), *x.shape[1:]), np.float64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(x, starts[full], axis=0)
    return out


class Machine:
    """w0, w[2**BITS], v[2**BITS, RANK]; terms that training kept out stay 0."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margin(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        v = self.v[ids]
        pairs = (_segment_sums(v, starts, sizes) ** 2 - _segment_sums(v * v, starts, sizes)).sum(1) / 2
        return self.w0 + _segment_sums(self.w[ids], starts, sizes) + pairs

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return 1 / (1 + np.exp(-np.clip(self.margin(ids, np.r_[0, np.cumsum(sizes)[:-1]], sizes), -30, 30)))


def paired(rows: list[np.ndarray], y: np.ndarray, seen: np.ndarray, toxic: np.ndarray, block: int = PAIR_BLOCK,
           weight: np.ndarray | None = None) -> np.ndarray:
    """Terms of the pairs that are toxic more often than either term and the sample, or less often than all three.

    A pair in m texts, k of them toxic, counts if m * KL(k / m, the nearest of
    the three shares), which bounds the binomial tail, is at least the log of
    the number of pairs over FALSE_PAIRS. All pairs are counted, in blocks,
    whose size only bounds the memory; only terms that can't reach this with any partner are left out before.
    """
    weight = np.ones(len(y)) if weight is None else weight
    ids, share = np.flatnonzero(seen >= MIN_DOCS), np.average(y, weights=weight)
    least = np.log(max(1, len(ids) * (len(ids) - 1) / 2) / FALSE_PAIRS)
    own = np.clip(toxic[ids] / seen[ids], 1e-9, 1 - 1e-9)
    hi, lo = np.maximum(own, share), np.minimum(own, share)
    need1, need0 = -least / np.log(hi), -least / np.log1p(-lo)      # texts of one kind that a pair needs at least
    able = (toxic[ids] >= need1) | (seen[ids] - toxic[ids] >= need0)
    ids, (hi, lo, need1, need0) = ids[able], (x[able].astype(np.float32) for x in (hi, lo, need1, need0))
    place = np.full(len(seen), -1, np.int32)
    place[ids] = np.arange(len(ids))
    toxic_first = np.argsort(-y, kind="stable")
    first, copies = [place[rows[i]] for i in toxic_first], weight[toxic_first].astype(np.float32)[:, None]
    first, n1 = [c[c >= 0] for c in first], int(y.sum())
    column = np.concatenate(first)
    order = np.argsort(column, kind="stable")
    column, row = column[order], np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in first])[order]

    def dense(a: int) -> np.ndarray:
        s, e = np.searchsorted(column, (a, a + block))
        x = np.zeros((len(rows), min(block, len(ids) - a)), np.float32)
        x[row[s:e], column[s:e] - a] = 1
        return x

    found = np.zeros(len(ids), bool)
    for a in range(0, len(ids), block):
        x, at = dense(a), slice(a, a + block)
        x *= copies
        for b in range(a, len(ids), block):
            z, to = dense(b), slice(b, b + block)
            k1, k0 = x[:n1].T @ z[:n1], x[n1:].T @ z[n1:]
            del z                            # before the next is made
            top, low = np.maximum.outer(hi[at], hi[to]), np.minimum.outer(lo[at], lo[to])
            more = (k1 >= np.maximum.outer(need1[at], need1[to])) & (k1 > top * (k1 + k0))
            less = (k0 >= np.maximum.outer(need0[at], need0[to])) & (k1 < low * (k1 + k0))
            i, j = np.nonzero(more | less)
            k, n = k1[i, j].astype(np.float64), (k1[i, j] + k0[i, j]).astype(np.float64)
            q, p = k / n, np.where(more[i, j], top[i, j], low[i, j]).astype(np.float64)
            good = k * np.log(np.maximum(q, 1e-300) / p) + (n - k) * np.log(np.maximum(1 - q, 1e-300) / (1 - p)) >= least
            found[a + i[good]] = found[b + j[good]] = True
        del x
    return ids[found]


def loss_gradient(w0: float, w: np.ndarray, v: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray,
                  y: np.ndarray, weight: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Mean weighted logistic loss (without its L2 terms) and its gradient by w0, w and v."""
    vi = v[codes]
    sums = _segment_sums(vi, starts, sizes)
    margin = w0 + _segment_sums(w[codes], starts, sizes) + (sums ** 2 - _segment_sums(vi * vi, starts, sizes)).sum(1) / 2
    part = weight / weight.sum()
    loss = float((part * (np.logaddexp(0, margin) - y * margin)).sum())
    e = part * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
    dv = np.stack([np.bincount(codes, e[owner] * (sums[owner, f] - vi[:, f]), len(w)) for f in range(v.shape[1])], 1)
    return loss, float(e.sum()), np.bincount(codes, e[owner], len(w)), dv


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None) -> Machine:
    """Adagrad on the logistic loss over the whole sample, from zero weights and small random factors.
    A row counts ``weight`` times."""
    weight = np.ones(len(y)) if weight is None else weight.astype(np.float64)
    size, share = 1 << BITS, np.average(y, weights=weight)
    every, copies = np.concatenate(rows), np.repeat(weight, [len(r) for r in rows])
    seen = np.bincount(every, copies, minlength=size)
    toxic = np.bincount(every, copies * np.repeat(y, [len(r) for r in rows]), size)
    off = np.abs(toxic - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    kept = (seen >= MIN_DOCS) & (off >= MIN_Z)
    kept[paired(rows, y, seen, toxic, weight=weight)] = True
    rows = [r[kept[r]] for r in rows]
    used, codes = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    starts, owner = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(rows)), sizes)
    rng = np.random.default_rng(3)
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(len(used)), rng.normal(0, 0.01, (len(used), RANK))
    g0, gw, gv = 1e-8, np.full(len(used), 1e-8), np.full((len(used), RANK), 1e-8)
    for _ in range(EPOCHS):
        _, d0, d, dv = loss_gradient(w0, w, v, codes, starts, sizes, owner, y, weight)
        d, dv = d + L2_W * w, dv + L2_V * v
        g0, gw, gv = g0 + d0 ** 2, gw + d ** 2, gv + dv ** 2
        w0 -= RATE * d0 / np.sqrt(g0)
        w -= RATE * d / np.sqrt(gw)
        v -= RATE * 0.1 * dv / np.sqrt(gv)
    full_w, full_v = np.zeros(size, np.float32), np.zeros((size, RANK), np.float32)
    full_w[used], full_v[used] = w, v
    return Machine(w0, full_w, full_v)


def usable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that may train and have a document. Rows whose crc32(doc_id) mod 3 is 1 are held out."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")
            .where("doc_id is not null and toxic in (0, 1)").where(F.pmod(id_crc32(), F.lit(3)) != 1)
            .groupBy("doc_id").agg(F.max("toxic").alias("y")))
    return known.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_semi")


def rate_shift(known: DataFrame, max_toxic: int, max_clean: int) -> float:
    """Log of the ratio of the two sampling rates, toxic to clean; 0 where a class has no rows."""
    n = {int(r.y): r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}    # two rows at most
    taken = {y: min(n.get(y, 0), most) for y, most in ((1, max_toxic), (0, max_clean))}
    return float(np.log(taken[1] / n[1]) - np.log(taken[0] / n[0])) if all(taken.values()) else 0.0


def training_sample(docs: DataFrame, known: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(y, terms, n) of the sample: n rows have these terms. ``known`` is ``usable``."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = known.where("y = 1").orderBy(*order).limit(max_toxic).union(known.where("y = 0").orderBy(*order).limit(max_clean))
    ids = ids.withColumnRenamed("doc_id", "_id")           # at most max_toxic + max_clean rows
    rows = doc_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, tuple] = {}
        for batch in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array([terms(t, cache).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()],
                                                            pa.binary())], names=["y", "terms"])
    return rows.mapInArrow(run, "y int, terms binary").groupBy("y", "terms").agg(F.count("*").alias("n"))


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Machine:
    """The fitted machine; its parameters come back as one row of at most 2**BITS * (RANK + 1) floats."""
    def run(_, sample):
        y = sample.column("y").to_numpy().astype(np.float64)
        rows = [np.frombuffer(t, np.int32) for t in sample.column("terms").to_pylist()]
        order = sorted(range(len(y)), key=lambda i: (y[i], rows[i].tobytes()))     # the same fit whatever the order of tasks
        y, weight, rows = y[order], sample.column("n").to_numpy()[order], [rows[i] for i in order]
        if y.min() == y.max():
            m = Machine(30.0 if y[0] else -30.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, RANK), np.float32))
        else:
            m = fit(rows, y, weight)
        return pa.table({"w0": [float(m.w0)], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    known = staged(usable(docs, labels), "toxic-labels")
    sample = training_sample(docs, known, max_toxic, max_clean)
    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(run, "w0 double, w binary, v binary").collect()
    if not found:
        return Machine(-30.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, RANK), np.float32))
    r = found[0]
    return Machine(r.w0 - rate_shift(known, max_toxic, max_clean), np.frombuffer(r.w, np.float32), np.frombuffer(r.v, np.float32).reshape(-1, RANK))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every whole text."""
    return _scored(doc_text(docs).select(F.col("doc_id").cast("bigint"), "text"), machine, "doc_id bigint")


def _scored(docs: DataFrame, machine: Machine, key: str) -> DataFrame:
    """``docs`` is (key, text); ``key`` its name and type."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = Machine(*model.value), {}
        for batch in text_slices(batches, 1):
            rows = [terms(t, cache) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(rows), pa.float64())], names=[key.split()[0], "score"])

    return docs.mapInArrow(run, f"{key}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, **options))
    return scored.select("doc_id", (F.pmod(id_crc32(), F.lit(3)) == 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't predicted toxic; each row by its own text, whatever its id."""
    machine = train(docs, labels, **options)
    texts = docs.select(text_digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    bad = _scored(texts, machine, "digest string").where(F.col("score") >= THRESHOLD)
    return drop_texts(docs, staged(bad.select("digest").distinct(), "toxic"))
