"""Golden payloads: hand-written raw API shapes covering each branch, with
the expected rows read off the documented semantics."""

import json
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from forumflow.operators.communities import community_columns, eligible, flair_rows
from forumflow.operators.media import POST_DETAIL, classify_media, media_assets, source_flags
from forumflow.operators.posts import not_deleted, post_columns
from forumflow.operators.threads import flatten_threads, nest_threads, thread_levels
from forumflow.sources.html import extract_sections, extract_table_rows, table_rows
from forumflow.sources.landed import (explode_post_listing, explode_rules, explode_topic_map,
                                      parse_community_about, parse_flairs, split_article, split_envelopes)


def node(author, body, replies=None, kind="t1", ups=0):
    data = {"author": author, "author_fullname": f"t2_{author}", "body": body, "ups": ups}
    data["replies"] = "" if not replies else {"kind": "Listing", "data": {"children": replies}}
    return {"kind": kind, "data": data}


def chain(depth):
    n = node("deep", f"d{depth}")
    for i in range(depth - 1, 0, -1):
        n = node("deep", f"d{i}", [n])
    return n


ROOTS = [
    node("ann", "a", [node("bob", "a.0"), {"kind": "more", "data": {"children": ["x"]}},
                      node("[deleted]", "gone", [node("cat", "hidden")]), node("dan", "a.3", [node("eve", "a.3.0")])]),
    node("[deleted]", "root gone", [node("zed", "hidden too")]),
    chain(13),
]


@pytest.mark.parametrize("levels_per_pass", [1, 3, 4])
def test_flatten_threads_golden(spark, levels_per_pass):
    art = spark.createDataFrame([("p1", json.dumps(ROOTS)), ("p2", "[]")], "post string, roots string")
    rows = flatten_threads(art, "post", "roots", levels_per_pass=levels_per_pass).collect()
    got = sorted((r.post_id, tuple(r.path), r.depth, r.body) for r in rows)
    expect = [("p1", (0,), 1, "a"), ("p1", (0, 0), 2, "a.0"), ("p1", (0, 3), 2, "a.3"), ("p1", (0, 3, 0), 3, "a.3.0")]
    expect += [("p1", (2,) + (0,) * i, i + 1, f"d{i + 1}") for i in range(13)]
    assert got == sorted(expect)
    assert {r.author_id for r in rows if r.body == "a"} == {"ann"}


def test_nest_then_flatten_round_trip(spark):
    edges = spark.createDataFrame(
        [("p", 0, None, "t1", "r0"), ("p", 1, 0, "t1", "c1"), ("p", 2, 0, "t1", "c2"), ("p", 3, 2, "t1", "c3"),
         ("p", 4, None, "t1", "r4"), ("q", 0, None, "t1", "q0")],
        "post string, node long, parent long, kind string, body string")
    lv = thread_levels(edges, "post", "node", "parent")
    nested = nest_threads(lv, "post", "node", "parent", "node", "depth", F.col("kind"),
                          [F.lit("a").alias("author"), F.col("body"), F.col("node").alias("ups")])
    flat = flatten_threads(nested, "post", "roots_json")
    got = sorted((r.post_id, r.ups, r.depth, tuple(r.path)) for r in flat.collect())
    assert got == [("p", 0, 1, (0,)), ("p", 1, 2, (0, 0)), ("p", 2, 2, (0, 1)), ("p", 3, 3, (0, 1, 0)),
                   ("p", 4, 1, (1,)), ("q", 0, 1, (0,))]


def detail_row(d):
    return json.dumps(d)


MEDIA = {
    "link_missing_urls": ({"permalink": "/r/x/1/"}, "link"),
    "link": ({"permalink": "/r/x/2/", "url": "https://o.test/a/", "url_overridden_by_dest": "https://o.test/a",
              "preview": {"images": [{"resolutions": [{"height": 2, "width": 1, "url": "u2"},
                                                      {"height": 1, "width": 1, "url": ""},
                                                      {"height": 1, "width": 9, "url": "u1"}],
                                      "source": {"height": 9, "width": 9, "url": "src"}}]}}, "link"),
    "multi_one_tag_falls_to_gallery": ({"url": "https://i.redd.it/x", "media_metadata": {
        "a": {"e": "Image", "p": [{"x": 1, "y": 1, "u": "m1"}]}, "b": {"e": "Image", "p": []}}}, "gallery"),
    "multi": ({"url": "https://i.redd.it/x", "media_metadata": {
        "a": {"e": "Image", "p": [{"x": 1, "y": 5, "u": "m1"}], "s": {"x": 9, "y": 9, "u": "ms"}},
        "b": {"e": "RedditVideo", "x": 3, "y": 4, "hlsUrl": "h&amp;1", "dashUrl": "d"},
        "c": {"e": "Other"}}}, "multi"),
    "gif": ({"url": "https://i.redd.it/x", "preview": {"images": [{"resolutions": [{"height": 1, "url": "r"}],
             "variants": {"gif": {"resolutions": [{"height": 3, "url": "g3"}, {"height": 2, "url": "g2"}]}}}]}},
            "gif"),
    "video": ({"url": "https://i.redd.it/x", "secure_media": {"reddit_video": {"hls_url": "h", "height": 7}}}, "video"),
    "image_source_without_url": ({"url": "https://i.redd.it/x", "preview": {"images": [
        {"resolutions": [{"height": 5, "width": 1, "url": "b"}, {"height": 5, "width": 2, "url": "a"}],
         "source": {"height": 9, "width": 9}}]}}, "image"),
    "gallery_with_preview": ({"url": "https://i.redd.it/x", "is_gallery": True,
                              "preview": {"images": [{"resolutions": []}]},
                              "media_metadata": {"g1": {"e": "Image", "p": [{"x": 1, "y": 3, "u": "y3"},
                                                                          {"x": 1, "y": 1, "u": "y1"}],
                                                        "s": {"x": 2, "y": 9, "u": "gs"}}}}, "gallery"),
    "none": ({"url": "https://i.redd.it/x"}, None),
}


def test_media_waterfall_golden(spark):
    df = spark.createDataFrame([(k, detail_row(v[0])) for k, v in MEDIA.items()], "k string, payload string")
    parsed = df.withColumn("d", F.from_json("payload", POST_DETAIL))
    out = classify_media(parsed, "d", "k")
    got = {r.k: r.media_type for r in out.select("k", "media_type").collect()}
    assert got == {k: v[1] for k, v in MEDIA.items()}
    assets = media_assets(source_flags(out.drop("media_type"), "d"), "k")
    by = {}
    for r in assets.collect():
        by.setdefault(r.post_id, []).append((r.item_ord, r.res_ord, r.url, r.is_source))
    assert sorted(by["link"]) == [(0, 0, "u1", False), (0, 1, "u2", False), (0, 2, "src", True)]
    assert sorted(by["gif"]) == [(0, 0, "g2", False), (0, 1, "g3", False)]
    assert sorted(by["image_source_without_url"]) == [(0, 0, "b", False), (0, 1, "a", False)]
    assert sorted(by["gallery_with_preview"]) == [(0, 0, "y1", False), (0, 1, "y3", False), (0, 2, "gs", True)]
    multi = out.where("k = 'multi'").select("media.multi").first()[0]
    assert [m["_type"] for m in multi] == ["image", "video"]
    assert multi[1]["hlsUrl"] == "h&1"
    link = out.where("k = 'link_missing_urls'").select("media.link.link").first()[0]
    assert link == ""


def test_post_listing_golden(spark):
    listing = {"data": {"children": [
        {"data": {"id": "a", "author": "[deleted]"}},
        {"data": {"id": "b", "selftext": "", "crosspost_parent_list": [], "created_utc": 0}},
        {"data": {"id": "c", "author": "x", "selftext": "", "crosspost_parent_list": [
            {"selftext": "cross", "selftext_html": "&lt;b&gt;"}]}},
        {"data": {"id": "d", "author": "y", "author_fullname": "t2_y", "subreddit_id": "t5_s",
                  "selftext": "own", "selftext_html": "&lt;p&gt;&amp;", "created_utc": 1700000000.7,
                  "link_flair_text": None}}]}}
    df = spark.createDataFrame([(json.dumps(listing),)], "payload string")
    rows = explode_post_listing(df).where(not_deleted(F.col("__post.author"))) \
        .select(*post_columns(F.col("__post"))).orderBy("id").collect()
    assert [r.id for r in rows] == ["b", "c", "d"]
    b, c, d = rows
    assert (b.author, b.text, b.text_html, b.created_human) == ("", "", "", "")
    assert (c.text, c.text_html) == ("cross", "&lt;b&gt;")
    assert (d.text, d.text_html, d.author_id, d.community_id, d.created_utc, d.created_human) == \
        ("own", "<p>&amp;", "y", "s", 1700000000, "14 November 2023")
    assert d.link_flair_text is None


def test_community_about_golden(spark):
    cases = [
        {"name": "t5_a", "display_name_prefixed": "r/a", "subreddit_type": "private", "subscribers": 999},
        {"name": "t5_b", "display_name_prefixed": "u/b", "subscribers": 1000},
        {"name": "t5_c", "display_name_prefixed": "r/c", "banner_img": "", "banner_background_image": "bg&amp;1",
         "subscribers": 1225000, "created_utc": 1.5e9},
        {"name": "t5_d", "display_name_prefixed": "r/d", "subscribers": 0, "key_color": "#fff"},
    ]
    df = spark.createDataFrame([(json.dumps({"data": c}),) for c in cases], "payload string")
    p = parse_community_about(df)
    rows = p.select(*community_columns(F.col("__about")),
                    eligible(F.col("__about.subreddit_type"), F.col("__about.display_name_prefixed")).alias("ok")) \
        .orderBy("id").collect()
    assert [r.ok for r in rows] == [False, False, True, True]
    assert [r.subscribers_human for r in rows] == ["999", "1K", "1.22M", ""]  # 1.225 rounds half-even
    assert rows[2].banner_background_image == "bg&1"
    assert rows[2].created_human == "14 July 2017"
    assert rows[3].banner_background_color == "#000000" and rows[3].key_color == "#fff"
    assert rows[0].primary_color is None


def test_rules_and_flairs(spark):
    df = spark.createDataFrame([("r/a", json.dumps({"rules": [{"short_name": "s1", "description": "d1"},
                                                              {"short_name": "s2", "description": "d2"}]})),
                                ("r/b", json.dumps({"rules": []}))], "title string, payload string")
    rules = explode_rules(df).select("title", "ord", "short_name").collect()
    assert sorted(tuple(r) for r in rules) == [("r/a", 0, "s1"), ("r/a", 1, "s2")]
    flairs = [{"background_color": "#1", "text": "Hi", "richtext": [{"e": "text", "t": "T"},
                                                                    {"e": "emoji", "a": ":x:", "u": "U"},
                                                                    {"e": "unknown", "t": "z"}]},
              {"text": ""}, {"background_color": "#2", "richtext": [{"e": "unknown"}]}]
    f = parse_flairs(spark.createDataFrame([(json.dumps(flairs),)], "payload string"))
    out = f.select(flair_rows(F.col("__flairs")).alias("x")).first()[0]
    assert [(p["text"], p["url"]) for p in out[0]["rich_text"]] == [("T", None), (":x:", "U")]
    assert out[0]["full_text"] == "Hi"
    assert out[1]["rich_text"] is None and out[1]["full_text"] is None and out[1]["background_color"] == ""
    assert out[2]["rich_text"] is None


def test_article_split_and_envelopes(spark):
    art = [{"data": {"children": [{"data": {"id": "p", "url": "https://i.redd.it/z"}}]}},
           {"data": {"children": [node("a", "x")]}}]
    env = [("articles", "p", json.dumps(art), 200, True, None), ("articles", "q", None, 404, False, "nf"),
           ("articles", "r", None, None, False, "timeout")]
    df = spark.createDataFrame(env, "endpoint string, key string, payload string, sc int, ok boolean, err string") \
        .select("endpoint", "key", "payload",
                F.struct(F.col("sc").alias("status_code"), F.col("ok").alias("success"),
                         F.col("err").alias("error")).alias("result_state"))
    ok, rej = split_envelopes(df)
    assert sorted((r.key, r.status_code) for r in rej.collect()) == [("q", 404), ("r", -1)]
    a = split_article(ok)
    r = a.select("article_found", "__detail.url", "__roots").first()
    assert r.article_found and r.url == "https://i.redd.it/z"
    assert flatten_threads(a, "key", "__roots").count() == 1


def test_topic_map(spark):
    df = spark.createDataFrame([(json.dumps({"Zeta": ["b", "a"], "Ünïcode": ["x"], "Empty": []}),)], "j string")
    got = sorted(tuple(r) for r in explode_topic_map(df, "j").collect())
    assert got == [("Zeta", 0, "b"), ("Zeta", 1, "a"), ("Ünïcode", 0, "x")]


TABLE_HTML = """<table><tr><td><img src="//img/a.png"></td><td><p>Gold &amp; Co</p></td></tr>
<tr><td>no image</td></tr>
<tr><td><img alt="t" src="//img/b.png"></td><td>Verified
Email</td></tr>
<tr><td><img src="//img/c.png"></td><td>Solo</td></tr>
<tr><td><img src="//img/d.png"></td><td>
Head

Tail
</td></tr></table>"""


def test_html_table_rows(spark):
    df = spark.createDataFrame([(1, TABLE_HTML)], "id long, html string")
    awards = extract_table_rows(df, "id", "html").collect()
    assert [(r.title, r.image_link) for r in awards][:1] == [("Gold & Co", "//img/a.png")]
    trophies = extract_table_rows(df, "id", "html", scheme="https:", two_line=True).collect()
    # lines are kept as they are: an empty second line is the description
    assert [(r.title, r.description, r.image_link) for r in trophies] == [
        ("Gold & Co", "Gold & Co", "https://img/a.png"), ("Verified", "Email", "https://img/b.png"),
        ("Solo", "Solo", "https://img/c.png"), ("Head", "", "https://img/d.png")]


class RowParser(HTMLParser):
    """Rows below every table by an explicit stack: [src of the first image, text, first paragraph's text]."""

    def __init__(self, page):
        super().__init__()
        self.tables, self.rows, self.paragraph = [], [], None
        self.feed(page)
        self.close()

    def open_rows(self):
        return [t[0] for t in self.tables if t[0] is not None]

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([None])
        if self.tables and tag in ("tr", "tbody"):
            self.tables[-1][0] = None
        if self.tables and tag == "tr":
            self.tables[-1][0] = {"level": len(self.tables), "src": None, "text": "", "p": None, "ptext": ""}
            self.rows.append(self.tables[-1][0])
        if tag in ("table", "tr", "td", "tbody", "div", "p"):
            self.paragraph = None
        if tag == "p":
            self.paragraph = object()
            for r in self.open_rows():
                r["p"] = r["p"] or self.paragraph
        if tag == "img":
            for r in self.open_rows():
                r["src"] = dict(reversed(attrs)).get("src") or "" if r["src"] is None else r["src"]

    def handle_endtag(self, tag):
        if tag in ("table", "tr", "td", "tbody", "div", "p"):
            self.paragraph = None
        if self.tables and tag in ("tr", "tbody"):
            self.tables[-1][0] = None
        if self.tables and tag == "table":
            self.tables.pop()

    def handle_data(self, text):
        for r in self.open_rows():
            r["text"] += text
            if r["p"] is not None and r["p"] is self.paragraph:
                r["ptext"] += text

    def listed(self):
        return [(n, r["level"], r["src"] or "", r["text"], None if r["p"] is None else r["ptext"]) for n, r in enumerate(self.rows)]


PIECES = ["<table>", "</table>", "<TABLE class='a>b'>", "<tr>", "</tr>", "<TR id=x>", "<td>", "</td>", "<tbody>", "</tbody>", "<p>", "</p>", "<div>",
          "<b>", "</b>", "<img src='a.png'>", '<IMG data-src="n" alt="src=\'q\'" SRC="b&amp;c.png"/>', "<img>", "<img src=d>", "x", "y &eacute;&lt", "\n",
          "<!-- <tr> -->", "<script>var a = '<tr><img src=z>';</script>", "a < b"]


def test_table_rows_against_a_parser(spark):
    rng = random.Random(7)
    pages = [("".join(["<table><tr>"] * (i % 3 > 0) + rng.choices(PIECES, k=rng.randrange(0, 30)))) for i in range(400)] + ["", None]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = sorted(tuple(r) for r in table_rows(df, "id", "html").collect())
    want = sorted((i, *r) for i, p in enumerate(pages) for r in RowParser(re.sub(r"<script.*?</script>", "<i>", p or "")).listed())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert got == want


def test_pages_are_dealt_by_the_size_of_their_tags(spark):
    page = "<table><tr><td><img src=a.png><p>x</p></table>"            # 6 or 7 tags of 128 bytes and more
    df = spark.createDataFrame([(i, page) for i in range(600)] + [(None, None)], "id int, html string")
    rows = table_rows(df, "id", "html", part_bytes=20_000)
    assert rows.rdd.getNumPartitions() > 20
    assert sorted(tuple(r) for r in rows.collect()) == sorted(tuple(r) for r in table_rows(df, "id", "html").collect())
    assert rows.count() == 600


def test_inner_rows_come_once_per_table_around_them(spark):
    page = "<TABLE><TR><TD><IMG SRC='o.png'><P>out</P><table><tr><td><img src=i.png><p>in</table></TD></TR></TABLE>"
    df = spark.createDataFrame([(1, page), (1, page)], "id int, html string")
    got = sorted((r.ord, r.title, r.image_link) for r in extract_table_rows(df, "id", "html").collect())
    assert got == [(0, "out", "o.png")] * 2 + [(1, "in", "i.png")] * 4


SECTIONS_HTML = ('<i data-topic="early"></i><h aria-labelledby="title-Games"></h><i data-topic="Chess"></i>'
                 '<i data-topic="Go &amp; Shogi"></i><h aria-labelledby="title-Empty"></h>'
                 '<h aria-labelledby="title-Games"></h><i data-topic="Poker"></i>')


def test_html_sections(spark):
    df = spark.createDataFrame([(1, SECTIONS_HTML)], "id long, html string")
    out = extract_sections(df, "id", "html", r'aria-labelledby="([^"]+)"', r'data-topic="([^"]+)"',
                           item_group=1, strip_token="title-")
    got = {r.section: list(r["items"]) for r in out.collect()}
    assert got == {"Games": ["Poker"], "Empty": []}


def test_flatten_without_partial_json_results(spark):
    art = spark.createDataFrame([("p1", json.dumps(ROOTS))], "post string, roots string")
    want = sorted((r.post_id, tuple(r.path), r.depth) for r in flatten_threads(art, "post", "roots").collect())
    spark.conf.set("spark.sql.json.enablePartialResults", "false")
    try:
        got = sorted((r.post_id, tuple(r.path), r.depth) for r in flatten_threads(art, "post", "roots").collect())
    finally:
        spark.conf.set("spark.sql.json.enablePartialResults", "true")
    assert got == want and len(got) == 17


def test_nest_flatten_round_trip_deep(spark):
    rows = [("p", 0, None, "t1", "n0")] + [("p", i, i - 1, "t1", f"n{i}") for i in range(1, 10)]
    rows += [("p", 100, 0, "t1", "side"), ("p", 101, 5, "more", "stub")]
    edges = spark.createDataFrame(rows, "post string, node long, parent long, kind string, body string")
    lv = thread_levels(edges, "post", "node", "parent")
    nested = nest_threads(lv, "post", "node", "parent", "node", "depth", F.col("kind"),
                          [F.lit("a").alias("author"), F.col("body"), F.col("node").alias("ups")])
    flat = {r.ups: (r.depth, tuple(r.path)) for r in flatten_threads(nested, "post", "roots_json").collect()}
    assert flat[9] == (10, (0,) * 10) and flat[100] == (2, (0, 1)) and 101 not in flat and len(flat) == 11
