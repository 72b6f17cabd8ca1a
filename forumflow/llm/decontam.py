"""Benchmark decontamination with an Aho-Corasick automaton.

The items' texts are normalised to words (see ``common.words``) and cut into
windows of ``window`` consecutive words; an item with fewer words, but not
none, is one window. All windows go into one automaton. Every document is
normalised the same way and scanned once; a match is mapped back to word
numbers and to code points of the original text.

The automaton is broadcast. Its size is bounded by ``block_bytes`` of item
text: a larger benchmark is dealt by hash into several blocks, each collected
and broadcast on its own, and each batch of documents is scanned once per
block, with one automaton in memory at a time.

Defined results: a null or empty text has no words and no hits; an item
without words has no window; equal windows of several items count for each of
them; repeated items (same id) count once, and so do all items without an id,
which come last in ``items``; repeated documents give a row each; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumflow.llm.common import blocks_for, doc_text, drop_texts, ship, staged, text_digest, text_slices, word_bytes, words

SCHEMA = ("doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>, "
          "spans array<struct<start:bigint,end:bigint>>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                    ("items", pa.list_(pa.int64())),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_WORD = re.compile(rb"[^ ]+")
_held: dict = {}


def windows(text: str | None, size: int) -> list[bytes]:
    w = words((text or "").encode())
    if not w:
        return []
    return [b" " + b" ".join(w[i:i + size]) + b" " for i in range(max(1, len(w) - size + 1))]


def build_automaton(items: list[tuple[int, str]], size: int):
    """Automaton whose values are (number of words, item ids); None without windows."""
    import ahocorasick
    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    a = ahocorasick.Automaton()
    for w, ids in owners.items():
        a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(ids)))
    a.make_automaton()
    return a


def _automaton(key: str, block, size: int):
    """One automaton per worker at a time, kept between tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = build_automaton(block.value, size)
    return _held[key]


def _matches(automaton, norm: bytes) -> list[tuple[int, int, tuple]]:
    """(first word, word after the last, items) of each match in ' w1 w2 ... '."""
    found = list(automaton.iter(norm.decode("latin-1")))
    if not found:
        return []
    blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    ends = np.searchsorted(blanks, [e for e, _ in found])
    return [(int(k) - n, int(k), ids) for k, (_, (n, ids)) in zip(ends, found)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code-point ranges of the original text."""
    at = [m.span() for m in _WORD.finditer(word_bytes(text))]
    out, pos, chars = [], 0, 0
    for a, b in ranges:
        lo, hi = at[a][0], at[b - 1][1]
        chars += len(text[pos:lo].decode("utf-8", "replace"))
        n = len(text[lo:hi].decode("utf-8", "replace"))
        out.append({"start": chars, "end": chars + n})
        chars, pos = chars + n, hi
    return out


def contaminated_spans(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: ``SCHEMA``. ``spans`` are the merged hit stretches."""
    return _scanned(doc_text(docs).select(F.col("doc_id").cast("bigint"), "text"), items, SCHEMA, _ARROW, **options)


def _scanned(docs: DataFrame, items: DataFrame, schema: str, arrow: pa.Schema, *, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` is (key, text); the key comes back as the first column of ``schema``."""
    spark = docs.sparkSession
    key = arrow.names[0]
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n = blocks_for(total, block_bytes)
    run, blocks = uuid.uuid4().hex, []
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        blocks.append(spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            split = [words(t) for t in texts]
            hits: dict[int, list] = {}
            for i, block in enumerate(blocks):
                automaton = _automaton(f"{run}-{i}", block, window)
                if automaton is None:
                    continue
                for k, w in enumerate(split):
                    if w and (m := _matches(automaton, b" " + b" ".join(w) + b" ")):
                        hits.setdefault(k, []).extend(m)
            rows = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                m = hits.get(k, ())
                ranges = merged([(a, b) for a, b, _ in m])
                rows.append({key: doc_id, "n_words": len(split[k]), "n_hit": sum(b - a for a, b in ranges),
                             "items": sorted({i for _, _, ids in m for i in ids}, key=lambda i: (i is None, i or 0)),
                             "spans": _char_spans(texts[k], ranges) if m else []})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, with their own columns; each row by its own text, whatever its id."""
    ship(docs.sparkSession)
    texts = docs.select(text_digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    found = _scanned(texts, items, SCHEMA.replace("doc_id bigint", "digest string"),
                     pa.schema([("digest", pa.string()), *list(_ARROW)[1:]]), **options)
    return drop_texts(docs, staged(found.where("n_hit > 0").select("digest").distinct(), "contaminated"))
