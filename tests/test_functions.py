"""Scalar functions against plain-Python restatements of the documented
semantics (property tests on random input plus named edge cases)."""

import html
import html.entities
import re
from decimal import ROUND_HALF_EVEN, Decimal
from urllib.parse import unquote

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from forumflow.functions.entities import decode_entities, decode_entities_native, decode_entities_sql, decode_entity_arrays
from forumflow.functions.rewrite import MERGE_REWRITE_MAP, rewrite_expr
from forumflow.functions.text import age_years, human_count, human_date, shifted_date, strip_all
from forumflow.functions.urls import clean_url


def numerize_spec(n: int) -> str:
    if not n:
        return ""
    if n < 1000:
        return str(n)
    for div, suf in ((10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K")):
        if n >= div:
            q = (Decimal(n) / Decimal(div)).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)
            s = format(q, "f")
            s = s.rstrip("0").rstrip(".") if "." in s else s
            return s + suf


def _one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_human_count_edges(spark):
    vals = [0, 1, 999, 1000, 1235, 1225000, 999999, 999995, 1005, 1015, 2500000000, 7 * 10**12, None]
    got = _one_col(spark, vals, human_count, "bigint")
    want = [numerize_spec(v or 0) for v in vals]
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**15), min_size=1, max_size=40))
def test_human_count_property(spark, xs):
    assert _one_col(spark, xs, human_count, "bigint") == [numerize_spec(x) for x in xs]


def test_dates(spark):
    vals = [0, 1, 86399, 1700000000, 951782400]
    d1 = _one_col(spark, vals, human_date, "bigint")
    d2 = _one_col(spark, vals, shifted_date, "bigint")
    assert d1 == ["", "1 January 1970", "1 January 1970", "14 November 2023", "29 February 2000"]
    assert d2 == ["31 December 1969", "31 December 1969", "01 January 1970", "14 November 2023", "28 February 2000"]
    assert _one_col(spark, [1700000000 - 3 * 31536000], lambda c: age_years(c, 1700000000), "bigint") == ["3yr(s)"]


def test_strip_everywhere(spark):
    assert _one_col(spark, ["t2_abc", "xt2_yt2_", None], lambda c: strip_all(c, "t2_")) == ["abc", "xy", None]


ENTITY_CASES = ["a &amp; b", "&amp;lt;", "&lt;p&gt;", "&copy 2020", "&amp</h1>", "AT&T", "&&& x",
                "&#233;t&#xe9;", "&eacute;", "&nbsp;", "&quot;q&quot;", "no entity", "", "&ampx", "&middot;"]


def test_entity_decode_exact(spark):
    assert _one_col(spark, ENTITY_CASES, decode_entities) == [html.unescape(s) for s in ENTITY_CASES]


def test_entity_decode_native_subset(spark):
    native_ok = ["a &amp; b", "&amp;lt;", "&lt;p&gt;", "&quot;q&quot;", "&nbsp;", "&middot;", "&&& x"]
    assert _one_col(spark, native_ok, decode_entities_native) == [html.unescape(s) for s in native_ok]


def handle_url_spec(u):
    import urllib.parse
    if not u:
        return ""
    if "https://www.reddit.com/media" in u:
        data = urllib.parse.parse_qs(u)
        return [data[k] for k in data][0][0]
    return urllib.parse.unquote(html.unescape(u))


URL_CASES = ["", "https://x.test/a?b=1&amp;c=2", "https://x.test/a%20b+c",
             "https://www.reddit.com/media?url=https%3A%2F%2Fi.test%2Fp.png%3Fw%3D1&s=x",
             "https://x.test/%E2%9C%93"]


def test_clean_url(spark):
    assert _one_col(spark, URL_CASES, clean_url) == [handle_url_spec(u) for u in URL_CASES]


def rewrite_spec(text, mapping):
    if text is None:
        return ""
    for a, b in mapping:
        text = re.compile(re.escape(a), re.IGNORECASE).sub(lambda _: b, text)
    return html.unescape(text)


def test_rewrite_merge_map(spark):
    cases = ["Subreddit r/Python on REDDIT", "for/against", None, "SubReddit $1 \\ &amp;", "reddit.com/r/x"]
    assert _one_col(spark, cases, lambda c: rewrite_expr(c, MERGE_REWRITE_MAP)) == \
        [rewrite_spec(c, MERGE_REWRITE_MAP) for c in cases]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aAbBrR/ $\\&;é", max_size=12), min_size=1, max_size=20))
def test_rewrite_property(spark, xs):
    mapping = [("ab", "$1"), ("b", "\\"), ("r/", "v/")]
    assert _one_col(spark, xs, lambda c: rewrite_expr(c, mapping)) == [rewrite_spec(x, mapping) for x in xs]


def test_clean_url_keeps_a_bad_percent_and_decodes_the_rest(spark):
    urls = ["https://a.test/100%/x%20y", "https://a.test/%zz%41+b", "https://a.test/%", "https://a.test/%C3%A9&amp;b=1"]
    want = [unquote(u.replace("&amp;", "&")) for u in urls]
    assert _one_col(spark, urls, clean_url) == want


def test_entity_arrays_are_decoded_exactly(spark):
    rows = [(["&hellip; &eacute", "a &amp; b", None],), ([],), (None,), (["&amp;hellip; &lt;"],)]
    df = spark.createDataFrame(rows, "a array<string>")
    got = [r.a for r in df.select(decode_entity_arrays("a").alias("a")).collect()]
    assert got == [None if r is None else [None if x is None else html.unescape(x) for x in r] for (r,) in rows]
    nested = spark.createDataFrame([([["&#8217;", "x"], [], None],)], "a array<array<string>>")
    assert nested.select(decode_entity_arrays("a", 2).alias("a")).first().a == [["’", "x"], [], None]


ODD_REFERENCES = [
    "&", "&&", "&;", "&#;", "&#x;", "&#xg", "&#99999999999999999999;", "&#0000000000000065;", "&#x000000000041g", "&notit;", "&notin;",
    "&amp;lt;", "&ampamp;", "&am p", "&" + "a" * 40 + ";", "&" + "é" * 40, "&CounterClockwiseContourIntegral;x",
    "&CounterClockwiseContourIntegral", "&lt\x0c;", "x&\n&copy2;", "&copy&reg;&#38;amp;", "&#x1F600;&#128512", "&#13;&#10;", "", "none",
]


def test_every_reference_in_the_jvm(spark):
    """All names with and without what follows, all odd numbers; as a column, as SQL text and in a lambda."""
    numbers = [*range(0, 300), *range(0xD7F0, 0xE010), *range(0xFDC8, 0xFDF8), 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFF, 0x110000, 10 ** 12]
    cases = [f"&{n}" for n in html.entities.html5] + [f"a&{n}b &amp" for n in html.entities.html5] + ODD_REFERENCES
    cases += [f"&#{n};&#x{n:x}&#X{n:X};" for n in numbers]
    want = [html.unescape(c) for c in cases]
    assert _one_col(spark, cases, decode_entities) == want
    assert _one_col(spark, cases, lambda c: F.expr(decode_entities_sql("v"))) == want
    assert _one_col(spark, cases, lambda c: F.get(decode_entity_arrays(F.array(c)), F.lit(0))) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["&", "amp", "lt", "not", "in", ";", "#", "x", "30", "1", "é", " ", "\n", "<", "A", "frac1", "4", "sup"]),
                         max_size=8).map("".join), min_size=1, max_size=60))
def test_references_property(spark, texts):
    assert _one_col(spark, texts, decode_entities) == [html.unescape(t) for t in texts]


def test_urls_with_any_entity(spark):
    """C5 decodes every entity, not a subset, also inside arrays."""
    urls = ["https://h/caf&eacute;&hellip;?a=1&amp;b=&#8217;", "https://h/&copy2&notit;%20+x", "https://h/&#x1F600;"]
    want = [unquote(html.unescape(u)) for u in urls]
    assert _one_col(spark, urls, clean_url) == want
    assert _one_col(spark, urls, lambda c: F.get(F.transform(F.array(c), clean_url), F.lit(0))) == want
