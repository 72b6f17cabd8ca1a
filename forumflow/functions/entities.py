"""Exact HTML5 entity decoding in the JVM.

A text is cut at every ``&``; each piece after the first starts with at most
one character reference, which is decoded as HTML5 does:

* decimal and hex references, with or without ``;``: Windows-1252 stands for
  128-159, zero, surrogates and numbers beyond Unicode become U+FFFD, control
  and non-characters go;
* a name with its ``;`` (or a legacy name without) is looked up whole;
* else the longest legacy name that the piece starts with, so ``&notit;`` is
  ``¬it;``; what starts no reference stays as it is.

The names come from the standard library's table, dealt by CRC-32 into
``_BUCKETS`` small maps in one array literal, so a lookup scans a few dozen
names. Everything is a built-in expression, so it works on columns, inside
``transform`` lambdas and, as SQL text, inside SQL lambdas; no row leaves the
JVM. ``decode_entities_native`` decodes a fixed subset by plain replacements.
"""

from __future__ import annotations

import html.entities
import json
import zlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entity subset of ``decode_entities_native``, in application
# order. ``&amp;`` must stay last.
NATIVE_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]

_BUCKETS = 64
_TABLE_TYPE = "array<map<string,string>>"
# A reference at the start of a piece, without its '&'.
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Control and non-characters that decode to nothing; both ends count.
_NOTHING = [(1, 8), (11, 11), (14, 31), (127, 127), (0xFDD0, 0xFDEF)]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_entities_native(c) -> Column:
    c = _c(c)
    out = c
    for src, dst in NATIVE_ENTITIES:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return F.when(F.instr(c, "&") == 0, c).otherwise(out)


@lru_cache(maxsize=1)
def _names_json() -> str:
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for name, text in html.entities.html5.items():
        buckets[zlib.crc32(name.encode()) % _BUCKETS][name] = text
    return json.dumps(buckets, ensure_ascii=False)


@lru_cache(maxsize=1)
def _legacy_pattern() -> str:
    """Names that need no ``;``, longest first."""
    names = [n for n in html.entities.html5 if not n.endswith(";")]
    return "^(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + ")"


@lru_cache(maxsize=1)
def _windows_1252() -> list[str]:
    """What the numbers 128-159 stand for."""
    def one(n: int) -> str:
        try:
            return bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(n)
    return [one(n) for n in range(128, 160)]


def _lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def _bound_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _named_sql(name: str) -> str:
    return (f"try_element_at(element_at(from_json({_lit(_names_json())}, '{_TABLE_TYPE}'), "
            f"CAST(crc32(CAST({name} AS BINARY)) % {_BUCKETS} AS INT) + 1), {name})")


def _numbered_sql(ref: str, n: str) -> str:
    """The character of a reference ``#..``; ``n`` is a free variable name."""
    def digits(pattern: str, most: int, base: int) -> str:
        d = f"regexp_extract({ref}, {_lit(pattern)}, 1)"
        return (f"CASE WHEN length({d}) > {most} THEN 1114112 WHEN {d} = '' THEN 0 "
                f"ELSE CAST(conv({d}, {base}, 10) AS BIGINT) END")
    number = (f"CASE WHEN substr({ref}, 2, 1) IN ('x', 'X') THEN {digits('^#[xX]0*([0-9a-fA-F]*)', 6, 16)} "
              f"ELSE {digits('^#0*([0-9]*)', 7, 10)} END")
    windows = "array(" + ", ".join(_lit(w) for w in _windows_1252()) + ")"
    nothing = " OR ".join(f"{n} BETWEEN {a} AND {b}" for a, b in _NOTHING)
    return _bound_sql(number, n, (
        f"CASE WHEN {n} = 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN '\ufffd' "
        f"WHEN {n} BETWEEN 128 AND 159 THEN element_at({windows}, CAST({n} AS INT) - 127) "
        f"WHEN {nothing} OR {n} & 65534 = 65534 THEN '' "
        f"ELSE decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') END"))


def decode_entities_sql(x: str, tag: str = "ent") -> str:
    """SQL text that decodes the SQL expression ``x``; lambda names start with ``tag``."""
    c, i, m, k, n, f = (f"{tag}_{v}" for v in "cimknf")
    whole_or_legacy = (f"filter(transform(array({m}, regexp_extract({m}, {_lit(_legacy_pattern())}, 0)), "
                       f"{k} -> named_struct('name', {k}, 'text', {_named_sql(k)})), {f} -> {f}.text IS NOT NULL)")
    named = _bound_sql(f"get({whole_or_legacy}, 0)", f, f"concat({f}.text, substr({c}, length({f}.name) + 1))")
    piece = _bound_sql(f"regexp_extract({c}, {_lit(_REFERENCE)}, 0)", m, (
        f"CASE WHEN {m} = '' THEN concat('&', {c}) "
        f"WHEN startswith({m}, '#') THEN concat({_numbered_sql(m, n)}, substr({c}, length({m}) + 1)) "
        f"ELSE coalesce({named}, concat('&', {c})) END"))
    pieces = f"transform(split({x}, '&'), ({c}, {i}) -> CASE WHEN {i} = 0 THEN {c} ELSE {piece} END)"
    return f"CASE WHEN instr({x}, '&') = 0 THEN {x} ELSE array_join({pieces}, '') END"


def _bound(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(name: Column) -> Column:
    table = F.from_json(F.lit(_names_json()), _TABLE_TYPE)
    at = (F.crc32(name.cast("binary")) % _BUCKETS).cast("int") + 1
    return F.try_element_at(F.element_at(table, at), name)


def _numbered(ref: Column) -> Column:
    def digits(pattern: str, most: int, base: int) -> Column:
        d = F.regexp_extract(ref, pattern, 1)
        return F.when(F.length(d) > most, F.lit(1114112)).when(d == "", F.lit(0)).otherwise(F.conv(d, base, 10).cast("bigint"))

    def character(n: Column) -> Column:
        nothing = (n.bitwiseAND(65534) == 65534)
        for a, b in _NOTHING:
            nothing = nothing | n.between(a, b)
        windows = F.array(*[F.lit(w) for w in _windows_1252()])
        return (F.when((n == 0) | (n > 1114111) | n.between(55296, 57343), F.lit("\ufffd"))
                .when(n.between(128, 159), F.element_at(windows, n.cast("int") - 127))
                .when(nothing, F.lit(""))
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    hexadecimal = F.substring(ref, 2, 1).isin("x", "X")
    return _bound(F.when(hexadecimal, digits("^#[xX]0*([0-9a-fA-F]*)", 6, 16)).otherwise(digits("^#0*([0-9]*)", 7, 10)), character)


def _after(c: Column, head: Column) -> Column:
    return F.substr(c, F.length(head) + 1)


def _piece(c: Column) -> Column:
    """A piece behind an '&', decoded."""
    def decoded(m: Column) -> Column:
        names = F.array(m, F.regexp_extract(m, _legacy_pattern(), 0))
        found = F.filter(F.transform(names, lambda k: F.struct(k.alias("name"), _named(k).alias("text"))), lambda f: f["text"].isNotNull())
        named = _bound(F.get(found, F.lit(0)), lambda f: F.concat(f["text"], _after(c, f["name"])))
        return (F.when(m == "", F.concat(F.lit("&"), c))
                .when(F.startswith(m, F.lit("#")), F.concat(_numbered(m), _after(c, m)))
                .otherwise(F.coalesce(named, F.concat(F.lit("&"), c))))
    return _bound(F.regexp_extract(c, _REFERENCE, 0), decoded)


def decode_entities(c) -> Column:
    """Exact decoding, in one pass: what a reference decodes to is not decoded again."""
    c = _c(c)
    pieces = F.transform(F.split(c, "&"), lambda p, i: F.when(i == 0, p).otherwise(_piece(p)))
    return F.when(F.instr(c, "&") == 0, c).otherwise(F.array_join(pieces, ""))


def decode_entity_arrays(c, depth: int = 1) -> Column:
    """Exact decoding of strings that lie ``depth`` arrays deep."""
    c = _c(c)
    if depth == 0:
        return decode_entities(c)
    return F.transform(c, lambda x: decode_entity_arrays(x, depth - 1))
