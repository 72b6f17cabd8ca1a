"""Quality scores by a regularised quadratic discriminant over document statistics.

Statistics of a whole text (character classes, word and line shape, repetition)
are transformed to be near normal: counts by log1p, shares by the arc sine of
their root. Each class gets its mean and covariance over all labelled training
documents, added up by Spark (no sample, no cap). A class covariance is shrunk
towards the pooled one by ``n / (n + prior)`` and then towards a multiple of the
identity with the oracle-approximating weight (Chen et al., 2010). The score is
the logistic function of the log-density difference

    log pi_1 - log pi_0 + (log|S_0| - log|S_1| + M_0(x) - M_1(x)) / 2

with Mahalanobis distances M from Cholesky factors, inverted once when the model
is made and kept in it.

Defined results: a null or empty text is a text without characters; labels other
than 0 and 1 don't count, a document with several labels is of low quality if
one says so; every copy of a labelled document counts; labels without a
document don't count; without labelled documents of both kinds every score is
the share of label 1 (0 without labels); repeated rows get a score each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumflow.llm.common import doc_text, drop_staged, id_crc32, staged, text_slices

THRESHOLD = 0.7
#: Documents that the pooled covariance weighs in a class covariance; margin's bound.
PRIOR, BOUND = 50.0, 30.0

_CLASSES = np.zeros(256, np.intp)               # 0: beyond ASCII, lead bytes
_CLASSES[0x80:0xC0] = 1                         # continuation bytes
_CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 2
_CLASSES[0x0A] = 3
_CLASSES[0x61:0x7B] = 4
_CLASSES[0x41:0x5B] = 5
_CLASSES[0x30:0x3A] = 6
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 7
_CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 8
_CLASSES[[*range(0x09), *range(0x0E, 0x20), 0x7F]] = 9
STATS = ["chars", "words", "lines", "beyond", "blanks", "breaks", "upper", "digits", "marks", "symbols", "controls",
         "word_length", "word_spread", "distinct", "top_word", "same_next", "distinct_lines", "line_length", "long_words", "odd_ends"]


def _share(part: float, whole: float) -> float:
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text, in the order of ``STATS``."""
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_CLASSES, np.bincount(raw, minlength=256), 10)
    chars = len(raw) - kinds[1]
    words = text.split()
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.float64, n)
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    odd = sum(w[-1] in b"!#$%&*+/<=>@\\^_|~" for w in words)
    return [np.log1p(chars), np.log1p(n), np.log1p(len(lines)), _share(kinds[0], chars), _share(kinds[2], chars), _share(kinds[3], chars),
            _share(kinds[5], kinds[4] + kinds[5]), _share(kinds[6], chars), _share(kinds[7], chars), _share(kinds[8], chars),
            _share(kinds[9], chars), np.log1p(lengths.mean()) if n else 0.0, np.log1p(lengths.std()) if n else 0.0,
            _share(len(counts), n), _share(max(counts.values(), default=0), n), _share(same, n), _share(len(set(lines)), len(lines)),
            np.log1p(chars / len(lines)) if lines else 0.0, _share(int((lengths > 20).sum()), n), _share(odd, n)]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            x = [statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return doc_text(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, x array<double>")


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that may train. Rows whose crc32(doc_id) mod 4 is 2 are held out."""
    return (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
            .where("doc_id is not null and quality in (0, 1)").where(F.pmod(id_crc32(), F.lit(4)) != 2)
            .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """y -> (n, sums, sums of products) of (y, x), added up per task and then by Spark."""
    p = len(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(y), p)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.r_[len(z), z.sum(0), (z.T @ z).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["y", "m"])

    parts = labelled.select("y", "x").mapInArrow(run, "y int, m array<double>")
    rows = parts.select("y", F.posexplode("m").alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v")).collect()  # 2 x |m| rows
    out = np.zeros((2, 1 + p + p * p))
    for r in rows:
        out[r.y, r["at"]] = r.v
    return {k: (out[k, 0], out[k, 1:1 + p], out[k, 1 + p:].reshape(p, p)) for k in (0, 1)}


def shrunk(cov: np.ndarray, n: float) -> np.ndarray:
    """The covariance with the oracle-approximating weight of the identity times the mean variance."""
    p = len(cov)
    square, mean = float((cov * cov).sum()), float(np.trace(cov)) / p
    below = (n + 1 - 2 / p) * (square - mean * mean * p)
    weight = 1.0 if below <= 0 else min(1.0, ((1 - 2 / p) * square + (mean * p) ** 2) / below)
    return (1 - weight) * cov + max(weight * mean, 1e-9) * np.eye(p)


class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor, log determinant, over standardised statistics."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], prior: float = PRIOR):
        n0, n1 = sums[0][0], sums[1][0]
        self.share, self.classes = (n1 / (n0 + n1) if n0 + n1 else 0.0), []
        if not n0 or not n1:
            return
        p = len(sums[0][1])
        self.mean = (sums[0][1] + sums[1][1]) / (n0 + n1)
        spread = np.diag((sums[0][2] + sums[1][2]) / (n0 + n1)) - self.mean ** 2
        self.scale = np.where(spread > 1e-12, np.sqrt(np.maximum(spread, 1e-12)), 1.0)
        own = {}
        for k in (0, 1):
            n, s, s2 = sums[k]
            mean = (s / n - self.mean) / self.scale
            # products about the overall mean, then about the class mean
            about = (s2 - np.outer(s, self.mean) - np.outer(self.mean, s)) / n + np.outer(self.mean, self.mean)
            own[k] = (n, mean, about / np.outer(self.scale, self.scale) - np.outer(mean, mean))
        pooled = (n0 * own[0][2] + n1 * own[1][2]) / (n0 + n1)
        for k in (0, 1):
            n, mean, cov = own[k]
            cov = shrunk((n * cov + prior * pooled) / (n + prior), n + prior)
            factor = np.linalg.cholesky((cov + cov.T) / 2)
            self.classes.append((np.log(n / (n0 + n1)), mean, np.linalg.solve(factor, np.eye(p)), 2 * np.log(np.diag(factor)).sum()))

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Per class: log prior plus log density, without the constant that both share."""
        z = (x - self.mean) / self.scale
        return np.stack([prior - (log_det + (((z - mean) @ inverse.T) ** 2).sum(1)) / 2 for prior, mean, inverse, log_det in self.classes])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        d = self.log_densities(x)
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -BOUND, BOUND)))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score; ``stats`` is ``document_statistics``."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(x), pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id bigint, score double")


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    return Discriminant(moments(stats.where("doc_id is not null").join(usable(labels), "doc_id")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = staged(document_statistics(docs), "quality-statistics")
    scored = staged(score(stats, train(stats, labels)), "quality-scores")
    drop_staged(stats)
    return scored.select("doc_id", (F.pmod(id_crc32(), F.lit(4)) == 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
