"""Media URL cleaning.

* blank / missing -> ''
* a media-redirect URL -> the first query value, percent- and plus-decoded
  (entities left as they are)
* anything else -> entity-decoded, then percent-decoded with '+' kept.

A ``%`` that starts no escape stays as it is and the valid escapes around it
are decoded. Entities are decoded exactly, and the function also works inside
``transform`` lambdas over resolution arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumflow.functions.entities import decode_entities, decode_entities_sql

# Fixed value: the host marker of media-redirect URLs.
MEDIA_REDIRECT_MARKER = "https://www.reddit.com/media"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# A ``%`` without two hex digits behind it.
BAD_PERCENT = "%(?![0-9A-Fa-f]{2})"


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, BAD_PERCENT, "%25")), c)


def clean_url(c) -> Column:
    c = _c(c)
    redirect = _decoded(F.regexp_extract(c, r"=([^&]+)", 1))
    plain = _decoded(F.replace(decode_entities(c), F.lit("+"), F.lit("%2B")))
    # fast path: without '%' or '&' there is nothing to decode
    untouched = (F.instr(c, "%") == 0) & (F.instr(c, "&") == 0)
    return (F.when(F.coalesce(c, F.lit("")) == "", F.lit(""))
            .when(F.instr(c, MEDIA_REDIRECT_MARKER) > 0, redirect)
            .when(untouched, c)
            .otherwise(plain))


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _decoded_sql(x: str) -> str:
    return f"coalesce(try_url_decode(regexp_replace({x}, '{BAD_PERCENT}', '%25')), {x})"


def clean_url_sql(x: str) -> str:
    """SQL text of ``clean_url`` for an SQL expression ``x`` (usable inside
    SQL lambdas); same semantics as the Column version."""
    rv = f"regexp_extract({x}, '=([^&]+)', 1)"
    ent = decode_entities_sql(x)
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' "
            f"WHEN instr({x}, {_lit(MEDIA_REDIRECT_MARKER)}) > 0 THEN {_decoded_sql(rv)} "
            f"WHEN instr({x}, '%') = 0 AND instr({x}, '&') = 0 THEN {x} "
            f"ELSE {_decoded_sql(f"replace({ent}, '+', '%2B')")} END")
