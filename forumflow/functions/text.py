"""Scalar text / number / date column functions (JVM-side expressions only).

Every function takes and returns ``Column`` so it stays inside whole-stage
codegen and can be used inside higher-order lambdas (``transform``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_YEAR = 365 * 24 * 60 * 60  # C3: no leap days


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_nonblank(c) -> Column:
    return F.coalesce(_c(c) != F.lit(""), F.lit(False))


def is_nonempty(c) -> Column:
    """C17 for arrays / maps: present and non-empty."""
    return F.coalesce(F.size(_c(c)) > 0, F.lit(False))


def strip_all(c, token: str) -> Column:
    """Remove ``token`` everywhere it occurs (not only as a prefix)."""
    return F.replace(_c(c), F.lit(token), F.lit(""))


def rstrip_slash(c) -> Column:
    """Strip trailing '/'."""
    return F.rtrim(_c(c), F.lit("/"))


def strip_newlines(c) -> Column:
    """Strip leading and trailing newlines."""
    return F.regexp_replace(_c(c), r"^\n+|\n+$", "")


def lt_gt_decode(c) -> Column:
    """Only ``&lt;`` and ``&gt;`` are decoded (post body html)."""
    return F.replace(F.replace(_c(c), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def epoch_seconds(ts) -> Column:
    """TIMESTAMP / TIMESTAMP_NTZ -> whole epoch seconds (session zone UTC)."""
    return F.unix_seconds(_c(ts).cast("timestamp"))


def human_date(epoch) -> Column:
    """Epoch -> 'D Month YYYY' (day not padded); '' when 0 or missing."""
    e = _c(epoch).cast("bigint")
    return F.when(F.coalesce(e, F.lit(0)) == 0, F.lit("")).otherwise(
        F.date_format(F.timestamp_seconds(e), "d MMMM yyyy"))


def shifted_date(epoch, hours: int = 8) -> Column:
    """Epoch minus ``hours`` -> 'DD Month YYYY' (day padded)."""
    e = _c(epoch).cast("bigint") - F.lit(hours * 3600)
    return F.date_format(F.timestamp_seconds(e), "dd MMMM yyyy")


def age_years(epoch, as_of: int) -> Column:
    """C3: '<n>yr(s)', n = floor((as_of - epoch) / 31,536,000).

    ``as_of`` is a parameter (not the clock) so reruns agree.
    """
    n = F.floor((F.lit(as_of).cast("bigint") - _c(epoch).cast("bigint")) / F.lit(SECONDS_PER_YEAR))
    return F.concat(n.cast("bigint").cast("string"), F.lit("yr(s)"))


def human_count(n) -> Column:
    """C4: count -> '999', '1.23K', '4.5M', '1B', '2.1T'; '' when 0 or missing.

    Two decimals, half-even rounding on exact decimals (no float error),
    trailing zeros dropped, no roll-over to the next suffix (999,999 -> 1000K).
    """
    v = _c(n).cast("bigint")
    size = F.when(v < 0, -F.greatest(v, F.lit(-(2 ** 63 - 1)))).otherwise(v)
    div = lambda a, b: F.call_function("div", a, b)  # noqa: E731  (whole-number division)

    def text(unit: int, suffix: str) -> Column:
        low, rest = div(size, F.lit(unit)), size % unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (low % 2 == 1))
        return _bound(F.when(up, low + 1).otherwise(low), lambda h: F.concat(
            F.when(v < 0, F.lit("-")).otherwise(F.lit("")), div(h, F.lit(100)).cast("string"),
            F.when(h % 100 == 0, F.lit("")).when(h % 10 == 0, F.concat(F.lit("."), div(h % 100, F.lit(10)).cast("string")))
            .otherwise(F.concat(F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))), F.lit(suffix)))

    # a unit is a hundredth of what the suffix stands for
    return (F.when(F.coalesce(v, F.lit(0)) == 0, F.lit("")).when(size < 1000, v.cast("string"))
            .when(size < 10 ** 6, text(10, "K")).when(size < 10 ** 9, text(10 ** 4, "M"))
            .when(size < 10 ** 12, text(10 ** 7, "B")).otherwise(text(10 ** 10, "T")))


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
