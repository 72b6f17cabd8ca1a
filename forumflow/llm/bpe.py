"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts longer than ``cut_chars`` are first cut at safe boundaries: a single
blank between two characters that are not white space always starts a match
of the pre-split pattern, so encoding the parts gives the ids of the whole.
A run of white space is one match, but for its last character where another
character follows; long runs are cut out so and encoded as one piece, since the
pattern's search would need stack in proportion to them.
Decoding joins the raw bytes of the ids; parts of a character come out as they
went in.

Defined results: null counts as the empty text, which has no ids; repeated
documents give a row each; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from forumflow.llm.common import doc_text, text_slices

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, ids array<int>, decoded binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: What the pattern's ``\s`` holds, 4,096 characters or more of it.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
#: Ids in one Arrow batch that goes back to Spark, about.
BATCH_IDS = 1 << 20


@lru_cache(maxsize=2)
def encoding(ranks_path: str):
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, cut_chars: int) -> Iterator[str]:
    """``text`` in parts of about ``cut_chars``; a stretch without a safe boundary stays whole."""
    start = 0
    while len(text) - start > cut_chars and (m := _SAFE.search(text, start + cut_chars - 1)):
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc, text: str, cut_chars: int) -> list[int]:
    ids, start = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += _encode_parts(enc, text[start:run.start()], cut_chars)
        ids += enc._encode_single_piece(text[run.start():end])
        start = end
    return ids + _encode_parts(enc, text[start:], cut_chars)


def _encode_parts(enc, text: str, cut_chars: int) -> list[int]:
    if len(text) <= cut_chars:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, cut_chars) for i in enc.encode_ordinary(part)]


def encode_decode(docs: DataFrame, *, ranks_path: str = RANKS, cut_chars: int = 1 << 16) -> DataFrame:
    """One row per document: its ids and the bytes that these decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for batch in text_slices(batches, 1):
            out, n = ([], [], []), 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode_text(enc, text, cut_chars)
                for column, value in zip(out, (doc_id, ids, enc.decode_bytes(ids))):
                    column.append(value)
                n += len(ids) + 1
                if n >= BATCH_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)
                    out, n = ([], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)

    return doc_text(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
