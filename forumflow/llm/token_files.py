"""Token-ID output in patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id; each range is one shard.
A shard's ids (every document followed by the end id) are cut into blocks of
``block_ids`` ids. A block stores the ids less the block's minimum, packed at
the width that holds ``percentile`` of them; ids that need more bits are
exceptions: their positions and their high bits follow in lists.

Layout of a block (little endian): u32 ids, u32 minimum, u8 width, u8 0, u16 0,
u32 exceptions, then the packed low bits (position i at bit i * width, first bit
lowest), the exceptions' positions as u32 and their high bits as u32.

The container is a Parquet table, so that commits are atomic and any store that
Spark writes will do: a row per block (with the shard, the block's number and
the number of the shard's first id in it: the index of block starts) and a row
per document (its order and number of ids in the shard).

Ids come from the tokenizers library. Its rules never join what a single blank
or line break between other characters parts, so texts are cut there and
equal parts are encoded once per worker, up to ``CACHE_PARTS`` parts at a time.

Defined results: null counts as the empty text, which holds the end id only;
a null doc_id sorts first; equal doc_ids sort by text; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from forumflow.llm.common import doc_text, shuffle_parts, text_slices
from forumflow.session import staging_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
CACHE_PARTS = 1_500_000
_HEAD = struct.Struct("<IIBBHI")
SCHEMA = "shard int, kind int, at bigint, doc_id bigint, n_ids bigint, payload binary"
_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()),
                    ("n_ids", pa.int64()), ("payload", pa.binary())])
DOC, BLOCK = 0, 1


def pack_block(ids: np.ndarray, percentile: float = 0.95) -> bytes:
    low = int(ids.min())
    rest = (ids - low).astype(np.uint32)
    width = int(np.sort(rest)[min(len(rest) - 1, int(len(rest) * percentile))]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    where = np.flatnonzero(high).astype(np.uint32)
    bits = ((rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return b"".join((_HEAD.pack(len(rest), low, width, 0, 0, len(where)),
                     np.packbits(bits, bitorder="little").tobytes(), where.tobytes(), high[where].tobytes()))


def unpack_block(block: bytes) -> np.ndarray:
    n, low, width, _, _, n_out = _HEAD.unpack_from(block)
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(block, np.uint8, size, _HEAD.size), count=n * width, bitorder="little")
    ids = bits.reshape(n, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width \
        else np.zeros(n, np.uint32)
    where = np.frombuffer(block, np.uint32, n_out, _HEAD.size + size)
    ids[where] |= np.frombuffer(block, np.uint32, n_out, _HEAD.size + size + 4 * n_out) << np.uint32(width)
    return ids + np.uint32(low)


# -- encoding ---------------------------------------------------------------

_ODD = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: Latin letters (a match of the pre-split rule whatever the Unicode version), then ASCII signs.
_LATIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF]+)([!-/:-@\[-`{-~]*)").fullmatch
_PLAIN = re.compile(r"\S{1,1000}").fullmatch


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs a task per core
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True                      # their strings in a text are ordinary text
    return t


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: 256 + i for i, b in enumerate(odd)}


class Encoder:
    """Ids (as bytes of little-endian u32) of texts by caches of parts.

    ``first`` holds parts as they are, ``later`` parts that follow a blank, by
    what follows it.
    """

    def __init__(self, path: str):
        self.tokenizer, self.letters = _tokenizer(path), _byte_letters()
        self.first, self.later = {}, {}
        plain = self._raw(["\n"])[0]
        self.newline = int(plain[0]) if len(plain) == 1 else None

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, word: str) -> bytes:
        """Ids of Latin letters, with a blank before them or not: straight from the merges."""
        ids = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, new: list[str], cache: dict, lead: str) -> None:
        """Encode new parts. Latin words go straight to the merges, also when ASCII signs follow;
        other parts without inner white space go many to a call, apart by line breaks, which are
        ids of their own."""
        rows, odd = [], []
        for p in dict.fromkeys(new):
            if m := _LATIN(p):
                core, tail = m.groups()
                if not tail:
                    cache[p] = self._merged(lead + core)
                    continue
                if (head := cache.get(core)) is None:
                    head = cache[core] = self._merged(lead + core)
                if (end := self.first.get(tail)) is None:
                    ids = self._raw([tail])[0]
                    end = self.first[tail] = struct.pack(f"<{len(ids)}I", *ids)
                cache[p] = head + end
            elif self.newline is not None and _PLAIN(p):
                rows.append(p)
            else:
                odd.append(p)
        for p, ids in zip(odd, self._raw([lead + p for p in odd])):
            cache[p] = struct.pack(f"<{len(ids)}I", *ids)
        for i in range(0, len(rows), 512):
            some = rows[i:i + 512]
            ids, at = [*self._raw(["\n".join([lead + p for p in some])])[0], self.newline], 0
            for p in some:
                end = ids.index(self.newline, at)
                cache[p] = struct.pack(f"<{end - at}I", *ids[at:end])
                at = end + 1

    def _ids(self, parts: list[str], cache: dict, lead: str) -> list[bytes]:
        out = list(map(cache.get, parts))
        if None in out:
            at = [i for i, x in enumerate(out) if x is None]
            if len(self.first) + len(self.later) + len(at) > CACHE_PARTS:
                self.first.clear()
                self.later.clear()
            self._learn([parts[i] for i in at], cache, lead)
            for i in at:
                out[i] = cache[parts[i]]
        return out

    def encode(self, text: str) -> bytes:
        if _ODD.search(text) or text[:1].isspace() or text[-1:].isspace():
            return b"".join(self._ids([p for p in _SAFE.split(text) if p], self.first, ""))
        out = []
        for i, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            out += self._ids(["\n", first] if i else [first] if first else [], self.first, "")
            out += self._ids(rest, self.later, " ")
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- files ------------------------------------------------------------------

def write_token_files(docs: DataFrame, path: str, *, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                      block_ids: int = 4096, percentile: float = 0.95, shards: int | None = None) -> None:
    """Encode the documents in ascending doc_id order and write their blocks to ``path``."""
    spark = docs.sparkSession
    rows = doc_text(docs).select(F.col("doc_id").cast("bigint"), "text")
    rows = rows.repartitionByRange(shards or shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        left, n_docs, n_blocks, end = np.zeros(0, np.uint32), 0, 0, struct.pack("<I", end_id)

        def blocks(ids: np.ndarray, start: int) -> pa.RecordBatch:
            packed = [pack_block(ids[i:i + block_ids], percentile) for i in range(0, len(ids), block_ids)]
            sizes = [min(block_ids, len(ids) - i) for i in range(0, len(ids), block_ids)]
            k = len(packed)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard] * k, pa.int32()), pa.array([BLOCK] * k, pa.int32()),
                 pa.array([(start + i) * block_ids for i in range(k)], pa.int64()), pa.nulls(k, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], schema=_ARROW)

        for batch in text_slices(batches, 1):
            ids_of = [enc.encode(t) for t in batch.column(1).to_pylist()]
            k = len(ids_of)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * k, pa.int32()), pa.array([DOC] * k, pa.int32()),
                 pa.array(range(n_docs, n_docs + k), pa.int64()), batch.column(0),
                 pa.array([len(x) // 4 + 1 for x in ids_of], pa.int64()), pa.nulls(k, pa.binary())], schema=_ARROW)
            n_docs += k
            left = np.concatenate([left, np.frombuffer(b"".join([y for x in ids_of for y in (x, end)]), "<u4")])
            full = len(left) // block_ids * block_ids
            if full:
                yield blocks(left[:full], n_blocks)
                n_blocks, left = n_blocks + full // block_ids, left[full:]
        if len(left):
            yield blocks(left, n_blocks)

    (rows.mapInArrow(run, SCHEMA).write.option("parquet.block.size", 16 << 20)
     .option("compression", "uncompressed").parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the files."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.where(F.col("kind") == DOC).groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard: at most the number of shards
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    ordered = (rows.join(F.broadcast(offsets), "shard").select(*rows.columns, "base")
               .repartition(shuffle_parts(spark), "shard").sortWithinPartitions("shard", "kind", "at"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        docs, left, pos, k = [], np.zeros(0, np.uint32), 0, 0
        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            for s, kind, doc_id, n, payload, base in zip(*columns):
                if s != shard:
                    shard, docs, left, pos, k = s, [], np.zeros(0, np.uint32), base, 0
                if kind == DOC:
                    docs.append((doc_id, n))
                    continue
                left, at = np.concatenate([left, unpack_block(payload)]), 0
                while k < len(docs) and docs[k][1] <= len(left) - at:
                    doc_id, n = docs[k]
                    done.append((doc_id, pos, n, zlib.crc32(left[at:at + n].astype("<u4").tobytes())))
                    pos, at, k = pos + n, at + n, k + 1
                left = left[at:]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.int64()) for i in range(4)], schema=out)

    return ordered.mapInArrow(cut, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the files below the shared folder and return what reading them back gives."""
    path = staging_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path)
