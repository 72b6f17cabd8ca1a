"""Token counts that follow edits: a segment tree of token counts per document.

A document's text is cut into leaves of about ``LEAF`` characters, always at
boundaries of the pre-split pattern (a single blank between characters that
are not white space), so the leaves' token counts add up to the text's count.
A tree holds characters and tokens of each leaf and the sums above them.

An edit (start, end, text) replaces code points [start, end) of the current
version. Only the leaves that it touches are encoded again, with a neighbour as
context where the edit comes within two characters of a leaf's boundary (a
boundary stays one as long as the three characters that make it stay). New
leaves take the place of the touched ones; sums are updated on the way up. A
tree is only laid out anew, from its leaves' sums, when a region has grown to
more leaves than it had.

Defined results: null counts as the empty text (one leaf, no tokens); null edits
are none, a null replacement is empty, positions are clipped to the current
version; edits apply in order; repeated documents are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F, types as T

from forumflow.llm.bpe import encode_text, encoding, safe_parts
from forumflow.llm.common import ship, text_slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LEAF = 256
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


class Tree:
    """Sums of (characters, tokens); node 1 is the root, leaves start at ``cap``."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.n = max(1, len(leaves))
        self.cap = 1 << (self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.cap, 2), np.int64)
        self.sums[self.cap:self.cap + len(leaves)] = leaves or [(0, 0)]
        level = self.cap
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        words = np.frombuffer(data, np.int64)
        tree.n, tree.sums = int(words[0]), words[1:].reshape(-1, 2).copy()
        tree.cap = len(tree.sums) // 2
        return tree

    def dump(self) -> bytes:
        return np.int64(self.n).tobytes() + self.sums.tobytes()

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character ``offset``; the last at the end."""
        node, start = 1, 0
        while node < self.cap:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if offset - start >= left:
                start += left
                node += 1
        leaf = node - self.cap
        if leaf >= self.n:
            leaf, start = self.n - 1, self.chars - int(self.sums[self.cap + self.n - 1, 0])
        return leaf, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.cap + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def leaves(self) -> list[tuple[int, int]]:
        return [tuple(x) for x in self.sums[self.cap:self.cap + self.n].tolist()]


def leaves_of(enc, text: str) -> list[tuple[int, int]]:
    return [(len(p), len(encode_text(enc, p, 1 << 16))) for p in safe_parts(text, LEAF)]


def apply_edit(enc, tree: Tree, text: str, start: int, end: int, new: str) -> tuple[Tree, str, int]:
    """(tree, text, characters encoded again) after one edit."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    first, lo = tree.leaf_at(start)
    last, hi = tree.leaf_at(max(start, end - 1))
    hi += int(tree.sums[tree.cap + last, 0])
    while first > 0 and start <= lo + 1:
        first -= 1
        lo -= int(tree.sums[tree.cap + first, 0])
    while last < tree.n - 1 and end >= hi:
        last += 1
        hi += int(tree.sums[tree.cap + last, 0])
    region = text[lo:start] + new + text[end:hi]
    fresh, room = leaves_of(enc, region), last - first + 1
    text = text[:start] + new + text[end:]
    if len(fresh) <= room:
        for i in range(room):
            tree.put(first + i, *(fresh[i] if i < len(fresh) else (0, 0)))
    else:
        old = tree.leaves()
        tree = Tree(old[:first] + fresh + old[last + 1:])
    return tree, text, len(region)


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _kind(spark_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(spark_type)


def build_trees(docs: DataFrame, *, ranks_path: str = RANKS) -> DataFrame:
    """Adds ``tree`` and ``n_tokens`` to (doc_id, text, edits); one pass over whole texts."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"),
                       F.col("edits").cast(EDITS).alias("edits"))
    fields = [*rows.schema.fields, T.StructField("tree", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    schema = pa.schema([(f.name, _kind(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for batch in text_slices(batches, 1):
            trees = [Tree(leaves_of(enc, t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, schema)),
                                              pa.array([t.dump() for t in trees], pa.binary()),
                                              pa.array([t.tokens for t in trees], pa.int64())], schema=schema)

    return rows.mapInArrow(run, T.StructType(fields))


def apply_edits(rows: DataFrame, *, ranks_path: str = RANKS, keep_version: bool = True) -> DataFrame:
    """(doc_id, text, edits, tree) -> doc_id, n_before, n_edits, n_tokens, n_encoded [, text, tree].

    Counts before and after the edits; ``n_encoded``: the characters that were
    encoded again; text and tree of the new version unless ``keep_version`` is off.
    """
    ship(rows.sparkSession)
    fields = "doc_id bigint, n_before bigint, n_edits bigint, n_tokens bigint, n_encoded bigint"
    kinds = [pa.int64()] * 5
    if keep_version:
        fields, kinds = fields + ", text string, tree binary", [*kinds, pa.string(), pa.binary()]
    schema = pa.schema([(f.split()[0], k) for f, k in zip(fields.split(", "), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for batch in text_slices(batches, 1):
            out = []
            for doc_id, text, edits, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tree, encoded = Tree.load(data), 0
                before = tree.tokens
                for e in edits or ():
                    if e is not None:
                        tree, text, n = apply_edit(enc, tree, text, e["start"] or 0, e["end"] or 0, e["text"] or "")
                        encoded += n
                row = (doc_id, before, len(edits or ()), tree.tokens, encoded)
                out.append((*row, text, tree.dump()) if keep_version else row)
            yield _frame(out, schema)

    return rows.select("doc_id", "text", "edits", "tree").mapInArrow(run, fields)


def derived_edits(docs: DataFrame, per_doc: int = 3, span: int = 40) -> DataFrame:
    """(doc_id, text, edits): ``per_doc`` replacements whose places follow from crc32 of the id.

    Each replaces up to ``span`` characters by a passage of the same text that
    starts elsewhere, so lengths change and boundaries break.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    edits = []
    for k in range(per_doc):
        h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(k))).cast("binary"))
        start = F.pmod(h, n + 1)
        source = F.pmod(F.shiftright(h, 4), n + 1) + 1
        edits.append(F.struct(start.alias("start"), (start + F.pmod(F.shiftright(h, 8), F.lit(span))).alias("end"),
                              F.substring(text, source.cast("int"), F.pmod(F.shiftright(h, 12), F.lit(span)).cast("int")).alias("text")))
    return docs.select("doc_id", text.alias("text"), F.array(*edits).alias("edits"))
