"""Ordered, case-insensitive literal rewriting of text fields.

``rewrite_expr`` folds one ``regexp_replace`` per (from, to) pair, in the
given order, with ``(?iu)`` (Unicode-aware case folding) and the source
quoted. NULL becomes ''. Entity decoding runs last and is exact everywhere,
inside arrays too.

``rewrite_text(df, paths, mapping)`` applies it to a list of field paths:
``"title"`` (top-level), ``"rules[].description"`` (field of an array of
structs), ``"members[].trophies[].title"`` (nested arrays). One generic
operator; no per-entity copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumflow.functions.entities import decode_entities

# The merge pass rewrite map, applied in this order.
MERGE_REWRITE_MAP = [
    ("subreddit", "voxsphere"),
    ("reddit", "voxpopuli"),
    ("r/", "v/"),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def _pattern(s: str) -> str:
    # \Q..\E quoting; a literal \E inside the source is split out.
    return "(?iu)\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replace_chain(c, mapping: Sequence[tuple[str, str]]) -> Column:
    """The ordered case-insensitive literal replacements, NULL -> ''."""
    out = F.coalesce(_c(c), F.lit(""))
    for src, dst in mapping:
        out = F.regexp_replace(out, F.lit(_pattern(src)), F.lit(_java_replacement(dst)))
    return out


def rewrite_expr(c, mapping: Sequence[tuple[str, str]]) -> Column:
    """The chain, then the decoding of its result, which is bound so that the chain runs once."""
    return F.get(F.transform(F.array(replace_chain(c, mapping)), decode_entities), F.lit(0))


def _rewritten(x: Column, parts: list[str], fn) -> Column:
    """``x`` with ``fn`` applied to the texts at the path ``parts`` below it."""
    if not parts:
        return fn(x)
    head, rest = parts[0], parts[1:]
    name = head.removesuffix("[]")
    if name != head:
        return x.withField(name, F.transform(x.getField(name), lambda e: _rewritten(e, rest, fn)))
    return x.withField(name, _rewritten(x.getField(name), rest, fn))


def rewrite_text(df: DataFrame, paths: Sequence[str], mapping: Sequence[tuple[str, str]]) -> DataFrame:
    """Apply the ordered rewrite at every path, with exact entity decoding."""
    fn = lambda c: rewrite_expr(c, mapping)
    for path in paths:
        parts = [p for p in path.split(".") if p]
        top = parts[0].removesuffix("[]")
        if parts[0] != top:
            new = F.transform(F.col(top), lambda e: _rewritten(e, parts[1:], fn))
        else:
            new = _rewritten(F.col(top), parts[1:], fn)
        df = df.withColumn(top, new)
    return df
