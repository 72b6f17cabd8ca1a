"""Language-model scores by prediction by partial matching (PPM) over bytes.

Model. A context trie over bytes, held as one table per depth: (context of d
bytes, next symbol, training count) for d = ``order`` .. 0. The symbols are the
256 bytes and an end of text; contexts are padded at the start of a text.
A symbol seen in the longest context gets c / (T + q) (T: the context's count,
q: its distinct symbols). Otherwise the escape q / (T + q) is taken and the
next shorter context is asked without the symbols of the longer one (symbol
exclusion); beyond depth 0 the unseen symbols share what is left. Since a
shorter context has seen whatever the longer one has, the excluded symbols at a
depth are those of the next deeper context, so one join per depth, from the
root up, gives the code length of every (context, symbol) that the corpus holds.

Data flow. No vocabulary and no trie is broadcast. Tasks pack documents into
chunks of about ``chunk_bytes`` and write, per chunk, the documents and the
chunk's distinct keys (context+symbol codes and word hashes) with their training
counts. Keys are summed over all chunks, valued, and joined back to the chunks
that hold them; a chunk is then scored with its own dictionary, which its text
bounds.

Words are 63-bit hashes in these tables (a collision of two of V words has a
probability of about V^2 / 2e19). Counts cover all training documents: those
whose crc32(doc_id) mod 5 is not 1.

Defined results: null counts as the empty text (its end is still scored); repeated
documents count and are scored as often as they come; without training documents
all symbols are equally likely and no token is known; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from forumflow.llm.common import doc_text, id_crc32, staged, text_slices

END, SYMBOLS, BITS = 256, 257, 9
ORDER, CHUNK_BYTES = 4, 16 << 20
#: Positions coded at once.
SLICE = 1 << 20
#: A row holds a chunk's documents (a payload) or a key with its count: codes are >= 0, word hashes < 0.
_ROWS = "chunk bigint, key bigint, n bigint, payload binary"
_ROWS_ARROW = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary())])
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the end token is not among them."""
    return text.translate(_LOWER).split()


def word_key(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word) >> 1) - (1 << 63)


def _symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with ``order`` pads before each text, first and last+1 predicted position of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.r_[0, np.cumsum(sizes + order + 1)[:-1]] + order
    out = np.full(int((sizes + order + 1).sum()), END, np.uint16)
    for at, t in zip(first, texts):
        out[at:at + len(t)] = np.frombuffer(t, np.uint8)
    return out, first, first + sizes + 1


def _codes(symbols: np.ndarray, lo: int, hi: int, order: int) -> np.ndarray:
    """Code of (context, symbol) at the positions lo .. hi-1 (lo >= order)."""
    code = np.zeros(hi - lo, np.int64)
    for back in range(order, -1, -1):
        code = (code << BITS) | symbols[lo - back:hi - back]
    return code


def _flags(first: np.ndarray, last: np.ndarray, size: int, chosen: np.ndarray) -> np.ndarray:
    """Whether a position belongs to a chosen text's predicted symbols."""
    step = np.zeros(size + 1, np.int8)
    step[first[chosen]] += 1
    step[last[chosen]] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def gram_counts(texts: list[bytes], train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of all texts and their counts in the training texts."""
    symbols, first, last = _symbols(texts, order)
    wanted = _flags(first, last, len(symbols), np.ones(len(texts), bool))
    counted = _flags(first, last, len(symbols), train)
    keys, sums = [], []
    for lo in range(order, len(symbols), SLICE):
        hi = min(lo + SLICE, len(symbols))
        keep = wanted[lo:hi]
        at, uniques = pd.factorize(_codes(symbols, lo, hi, order)[keep])
        keys.append(uniques)
        sums.append(np.bincount(at, counted[lo:hi][keep], len(uniques)).astype(np.int64))
    if len(keys) == 1:
        return keys[0], sums[0]
    at, uniques = pd.factorize(np.concatenate(keys))
    return uniques, np.bincount(at, np.concatenate(sums), len(uniques)).astype(np.int64)


def gram_sums(texts: list[bytes], keys: np.ndarray, values: np.ndarray, order: int) -> np.ndarray:
    """Sum of the values of each text's codes."""
    symbols, first, last = _symbols(texts, order)
    wanted = _flags(first, last, len(symbols), np.ones(len(texts), bool))
    order_of = np.argsort(keys)
    keys, values = keys[order_of], values[order_of]
    total = np.zeros(len(texts))
    for lo in range(order, len(symbols), SLICE):
        hi = min(lo + SLICE, len(symbols))
        at, uniques = pd.factorize(_codes(symbols, lo, hi, order))
        place = np.searchsorted(keys, uniques)
        place[place == len(keys)] = 0
        value = np.where(keys[place] == uniques, values[place], 0.0)
        x = np.where(wanted[lo:hi], value[at], 0.0)
        a, b = np.searchsorted(last, lo, "right"), np.searchsorted(first, hi)
        starts = np.maximum(first[a:b] - lo, 0)
        if b > a:
            total[a:b] += np.add.reduceat(x, starts)
    return total


def chunk_rows(docs: DataFrame, order: int, chunk_bytes: int) -> DataFrame:
    """Chunks: a row with the documents, a row per distinct code and per distinct word with its training count."""
    rows = doc_text(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn(
        "held_out", F.pmod(id_crc32(), F.lit(5)) == 1)

    def pack(ids: list, held: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DOCS_ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, held, texts), _DOCS_ARROW)],
                                                     schema=_DOCS_ARROW))
        payload = sink.getvalue().to_pybytes()
        chunk = xxhash.xxh64_intdigest(payload) >> 1            # equal chunks may share a dictionary
        train = ~np.array(held, bool)
        counts: Counter = Counter()
        unseen: set[bytes] = set()
        for t, h in zip(texts, held):
            unseen.update(tokens(t)) if h else counts.update(tokens(t))
        for w in unseen:
            counts.setdefault(w, 0)
        grams, n = gram_counts(texts, train, order)
        words = np.fromiter(map(word_key, counts), np.int64, len(counts))
        for keys, values, load in ((np.zeros(1, np.int64), np.array([int(train.sum())]), payload), (grams, n, None),
                                   (words, np.fromiter(counts.values(), np.int64, len(counts)), None)):
            k = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, chunk, np.int64)), pa.array(keys.astype(np.int64)),
                 pa.array(values.astype(np.int64)), pa.array([load], pa.binary()) if load else pa.nulls(k, pa.binary())],
                schema=_ROWS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0
        for batch in text_slices(batches, 1):
            for i, t, h in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)))):
                ids.append(i)
                texts.append(t)
                held.append(h)
                size += len(t)
                if size >= chunk_bytes:
                    yield from pack(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield from pack(ids, held, texts)

    return rows.mapInArrow(run, _ROWS)


def code_lengths(grams: DataFrame, order: int) -> DataFrame:
    """(key, c) of the corpus' codes -> (key, value): log10 probability of the symbol in its context."""
    low = lambda d: F.col("key").bitwiseAND((1 << (BITS * (d + 1))) - 1)
    context = Window.partitionBy(F.shiftright("key", BITS))
    seen = F.col("c") > 0
    below = None
    for d in range(order + 1):
        level = grams.groupBy(low(d).alias("key")).agg(F.sum("c").alias("c")) if d < order else grams
        if below is None:
            level = (level.withColumn("T", F.sum("c").over(context)).withColumn("q", F.count_if(seen).over(context))
                     .withColumn("v", -F.log10(F.lit(SYMBOLS) - F.col("q"))))
        else:
            shorter = below.select(F.col("key").alias("k"), F.col("c").alias("c1"), F.col("T").alias("T1"),
                                   F.col("q").alias("q1"), F.col("v").alias("v1"))
            level = level.withColumn("k", low(d - 1)).join(shorter, "k")
            level = (level.withColumn("T", F.sum("c").over(context)).withColumn("q", F.count_if(seen).over(context))
                     .withColumn("E", F.sum(F.when(seen, F.col("c1")).otherwise(0)).over(context)))
            fresh = F.col("q1") - F.col("q")                    # symbols of the shorter context that are not excluded
            share = F.col("T1") - F.col("E") + fresh
            level = level.withColumn("v", F.when(fresh == 0, F.col("v1"))
                                     .when(F.col("c1") > 0, F.log10(F.col("c1") / share))
                                     .otherwise(F.log10(fresh / share) + F.col("v1")))
        below = level.select("key", "c", "T", "q", "v")
        if d < order:
            below = staged(below, f"ppm-depth{d}")
    total = F.col("T") + F.col("q")
    return below.select("key", F.when(seen, F.log10(F.col("c") / total))
                        .when(F.col("T") > 0, F.log10(F.col("q") / total) + F.col("v")).otherwise(F.col("v")).alias("value"))


def score_texts(docs: DataFrame, *, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    rows = staged(chunk_rows(docs, order, chunk_bytes), "ppm-chunks")
    packed, keyed = F.col("payload").isNotNull(), F.col("payload").isNull()
    n_train = rows.where(packed).agg(F.sum("n")).first()[0] or 0
    counts = staged(rows.where(keyed).groupBy("key").agg(F.sum("n").alias("c")), "ppm-counts")
    is_word = F.col("key") < 0
    total = counts.where(is_word).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_tokens = (total.n or 0) + n_train                          # every training document has one end token
    vocabulary = total.v + (n_train > 0)
    grams = code_lengths(counts.where(~is_word), order)
    values = grams.select("key", "value").unionByName(counts.where(is_word).select("key", F.col("c").cast("double").alias("value")))
    known = rows.where(keyed).select("chunk", "key").join(values, "key").select("chunk", "key", "value")
    texts = rows.where(packed).select(F.col("chunk").alias("doc_chunk"), "payload")
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    space = n_tokens + 0.5 * (vocabulary + 1)

    def score(left, right):
        key, value = (right.column(c).to_numpy() for c in ("key", "value"))
        gram = key >= 0
        grams_of, lengths = key[gram], value[gram]
        words_of = key[~gram]
        by_key = np.argsort(words_of)
        words_of, counts_of = words_of[by_key], value[~gram][by_key]
        log = lambda c: math.log10((c + 0.5) / space)
        done = []
        for payload in left.column("payload").to_pylist():
            docs_of = pa.ipc.open_stream(payload).read_all()
            ids, held, texts_of = (docs_of.column(i).to_pylist() for i in range(3))
            logs: dict[bytes, float] = {}                        # the chunk's words; texts are split one at a time
            for t in texts_of:
                logs.update(dict.fromkeys(tokens(t)))
            at = np.searchsorted(words_of, np.fromiter(map(word_key, logs), np.int64, len(logs)))
            c = counts_of[at]                                    # every word of a chunk has a row
            unknown = {w for w, n in zip(logs, c) if not n}
            logs = dict(zip(logs, np.log10((c + 0.5) / space).tolist()))
            sums = gram_sums(texts_of, grams_of, lengths, order)
            for i, h, t, s in zip(ids, held, texts_of, sums.tolist()):
                w = tokens(t)
                n_known = len(w) - (sum(map(unknown.__contains__, w)) if unknown else 0) + (n_train > 0)
                done.append((i, h, len(w) + 1, n_known, n_tokens, math.fsum(map(logs.__getitem__, w)) + log(n_train), s))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)] if done else
                                    [pa.array([], f.type) for f in out], schema=out)

    return texts.groupBy("doc_chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
               "base_score double, score double")
