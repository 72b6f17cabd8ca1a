"""End-to-end build over a small hand-written landing folder."""

import json
import os
import random
import tempfile

import pytest

from forumflow.plans.build import BuildOptions, build_forum, merge_datasets, split_users
from forumflow.sinks.writers import write_table


def env(endpoint, key, payload, status=200):
    ok = payload is not None
    return {"endpoint": endpoint, "key": key, "payload": None if payload is None else json.dumps(payload),
            "result_state": {"status_code": status, "success": ok, "error": None if ok else "failed"}}


def about(name, title, **kw):
    return {"name": f"t5_{name}", "display_name_prefixed": title, "subscribers": 1500, **kw}


def child(title, **kw):
    return {"data": {"subreddit_name_prefixed": title, "sr_detail": about(title[2:], title, **kw)}}


def post(pid, sub, author="bob", **kw):
    return {"data": {"id": pid, "author": author, "author_fullname": f"t2_{author}", "subreddit_id": f"t5_{sub}",
                     "subreddit_name_prefixed": f"r/{sub}", "title": f"T{pid}", "ups": 1, **kw}}


def comment(author, body, replies=None):
    return {"kind": "t1", "data": {"author": author, "author_fullname": f"t2_{author}", "body": body,
                                   "replies": {"data": {"children": replies}} if replies else ""}}


def article(pid, comments, **detail):
    return [{"data": {"children": [{"data": {"id": pid, **detail}}]}}, {"data": {"children": comments}}]


LANDING = [
    env("community_about", "OnDemandSub", {"data": about("od", "r/OnDemandSub")}),
    env("community_search", "alpha", {"data": {"children": [
        child("r/a1"), child("r/a2", subreddit_type="private"), child("u/a3"), child("r/shared"),
        child("r/a1"), child("r/a4")]}}),
    env("community_search", "beta", {"data": {"children": [
        child("r/shared"), {"data": {"subreddit_name_prefixed": "r/null", "sr_detail": None}},
        child("r/a4"), child("r/b1"), child("r/b2"), child("r/b3")]}}),
    env("community_search", "gamma", None, 500),
    env("rules", "a1", {"rules": [{"short_name": "be nice", "description": "no r/spam"}]}),
    env("link_flairs", "a1", [{"text": "F", "richtext": [{"e": "text", "t": "F"}]}]),
    env("moderators", "a1", {"data": {"children": [{"id": "t2_m1", "name": "mod1"}]}}),
    env("moderators", "b1", {"data": {"children": [{"id": "t2_m1", "name": "mod1"}]}}),
    env("post_listing", "OnDemandSub", {"data": {"children": [post("p1", "od"), post("p2", "od", "[deleted]"),
                                                              post("p3", "od")]}}),
    env("post_listing", "r/a1", {"data": {"children": [post("p4", "a1", "mod1"), post("p5", "a1", "cat")]}}),
    env("article", "p1", article("p1", [comment("cat", "hi", [comment("[deleted]", "x", [comment("z", "y")])]),
                                        comment("dan", "yo")], url="https://i.redd.it/1")),
    env("article", "p4", article("p4", [comment("bob", "c")], url="https://o.test/x",
                                 url_overridden_by_dest="https://o.test/x")),
    env("awards_page", "awards", "<table><tr><td><img src='x'></td></tr>"
                                  "<tr><td><img src=\"//a.png\"></td><td><p>Gold</p></td></tr></table>"),
]


def _landing_dir():
    d = tempfile.mkdtemp(prefix="ff-landing-")
    with open(os.path.join(d, "envelopes.jsonl"), "w") as f:
        for e in LANDING:
            f.write(json.dumps(e) + "\n")
    with open(os.path.join(d, "topics.json"), "w") as f:
        json.dump({"Cat1": ["beta", "alpha"], "Cat2": ["gamma"]}, f)
    with open(os.path.join(d, "ondemand.json"), "w") as f:
        json.dump([{"title": "OnDemandSub", "topic": "alpha", "posts_count": 2},
                   {"title": "", "topic": "x", "posts_count": 1}], f)
    return d


def test_build_forum_end_to_end(spark):
    d = _landing_dir()
    out = os.path.join(d, "out")
    t = build_forum(spark, os.path.join(d, "envelopes.jsonl"), os.path.join(d, "topics.json"),
                    os.path.join(d, "ondemand.json"), out, BuildOptions(communities_per_topic=2))
    comms = {(r.title, r.topic) for r in t["communities"].collect()}
    # r/a4 was past alpha's cap, so it stays free and beta takes it
    assert comms == {("r/OnDemandSub", "alpha"), ("r/a1", "alpha"), ("r/shared", "alpha"),
                     ("r/a4", "beta"), ("r/b1", "beta")}
    assert {r.category for r in t["communities"].collect()} == {"Cat1"}
    assert [(r.community_id, r.short_name) for r in t["community_rules"].collect()] == [("a1", "be nice")]
    assert {r.key for r in t["rejects"].collect()} == {"gamma"}
    posts = {r.id: r for r in t["posts"].collect()}
    assert set(posts) == {"p1", "p4", "p5"}          # p2 deleted within the top 2, p3 past the limit
    assert posts["p1"].num_comments == 2 and posts["p4"].num_comments == 1 and posts["p5"].num_comments == 0
    assert posts["p4"].media["_type"] == "link"
    assert sorted(r.body for r in t["comments"].collect()) == ["c", "hi", "yo"]
    members = {(r.community_id, r.name, r.is_moderator) for r in t["community_members"].collect()}
    assert members == {("od", "bob", False), ("od", "cat", False), ("od", "dan", False),
                       ("a1", "mod1", True), ("a1", "bob", False), ("b1", "mod1", True)}
    users = {r.id for r in t["users"].collect()}
    assert users == {"bob", "cat", "dan", "m1", "mod1"}  # users are keyed by id, members by name
    assert [r.title for r in t["awards"].collect()] == ["Gold"]
    assert all(len(r.awards) <= 1 and all(a.title == "Gold" for a in r.awards) for r in t["posts"].collect())
    assert os.path.isdir(os.path.join(out, "communities"))


def test_merge_and_split(spark):
    root = tempfile.mkdtemp(prefix="ff-merge-")
    a = spark.createDataFrame([("1", "Subreddit one", "x"), ("2", "two", "y"), ("", "blank", "z")],
                              "id string, title string, public_description string")
    b = spark.createDataFrame([("2", "dup", "w"), ("3", "r/three on reddit", "v")],
                              "id string, title string, public_description string")
    write_table(a, f"{root}/set1/communities")
    write_table(b, f"{root}/set2/Communities")
    for s in ("set1", "set2"):
        write_table(spark.createDataFrame([("t",)], "topic string"), f"{root}/{s}/topics")
        write_table(spark.createDataFrame([("9", "Reddit post", [("Reddit Gold", "i")])],
                                          "id string, title string, awards array<struct<title:string,image_link:string>>"),
                    f"{root}/{s}/posts")
        write_table(spark.createDataFrame([("9", "n", [("Subreddit Mod", "on r/x", "i")])],
                                          "id string, name string, "
                                          "trophies array<struct<title:string,description:string,image_link:string>>"),
                    f"{root}/{s}/users")
        write_table(spark.createDataFrame([("Reddit Gold", "i")], "title string, image_link string"),
                    f"{root}/{s}/awards")
        write_table(spark.createDataFrame([("T", "D", "i")], "title string, description string, image_link string"),
                    f"{root}/{s}/trophies")
    m = merge_datasets(spark, root, None)
    got = sorted((r.id, r.title) for r in m["communities"].collect())
    assert got == [("1", "voxsphere one"), ("2", "two"), ("3", "v/three on voxpopuli")]
    assert m["topics"].count() == 1 and [r.title for r in m["awards"].collect()] == ["voxpopuli Gold"]
    post = m["posts"].first()
    assert (post.title, post.awards[0].title) == ("voxpopuli post", "voxpopuli Gold")
    user = m["users"].first()
    assert (user.trophies[0].title, user.trophies[0].description) == ("voxsphere Mod", "on v/x")
    # idempotent: merging the merged output again changes nothing
    root2 = tempfile.mkdtemp(prefix="ff-merge2-")
    for k, v in m.items():
        write_table(v, f"{root2}/only/{k}")
    again = merge_datasets(spark, root2, None)
    for k in ("communities", "posts", "users", "awards"):
        assert sorted(map(str, again[k].collect())) == sorted(map(str, m[k].collect()))
    users = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    p1, p2 = split_users(users)
    assert sorted(r.id for r in p1.collect()) == ["0", "1", "2"] and sorted(r.id for r in p2.collect()) == ["3", "4"]


def test_sinks_partitioned_and_staged(spark):
    from forumflow.sinks.writers import stage_then_publish, write_by_topic
    d = tempfile.mkdtemp(prefix="ff-sink-")
    df = spark.createDataFrame([("t1", "r/b"), ("t1", "r/a"), ("t2", "r/c")], "topic string, title string")
    write_by_topic(df, f"{d}/communities", fmt="json")
    assert sorted(os.listdir(f"{d}/communities"))[-2:] == ["topic=t1", "topic=t2"]
    back = spark.read.json(f"{d}/communities")
    assert sorted((r.topic, r.title) for r in back.collect()) == [("t1", "r/a"), ("t1", "r/b"), ("t2", "r/c")]
    p1 = stage_then_publish(df, "communities")
    p2 = stage_then_publish(df, "communities")
    assert p1 != p2 and spark.read.parquet(p1).count() == 3


def test_read_curated_layout(spark):
    from forumflow.operators.threads import flatten_curated_comments
    from forumflow.sources.curated import read_communities_map, read_curated_array
    d = tempfile.mkdtemp(prefix="ff-curated-")
    comm = {"tech": [{"id": "a1", "title": "r/a1", "subscribers": 5, "rules": [{"short_name": "s", "description": "d"}],
                      "moderators": [{"id": "m1", "name": "mod", "trophies": []}]},
                     {"id": "a2", "title": "r/a2"}],
            "art": [{"id": "b1", "title": "r/b1", "topic": "art"}]}
    with open(os.path.join(d, "subreddits.json"), "w") as f:
        json.dump(comm, f)
    c = {r.id: r for r in read_communities_map(spark, os.path.join(d, "subreddits.json")).collect()}
    assert set(c) == {"a1", "a2", "b1"} and c["a2"].topic == "tech" and c["a2"].ord == 1
    assert c["a1"].rules[0].short_name == "s" and c["a1"].moderators[0].name == "mod"
    reply = {"author": "z", "author_fullname": "z9", "body": "r", "replies": []}
    posts = [{"id": "p1", "title": "t", "comments": [{"author": "a", "author_fullname": "a1", "body": "x",
                                                     "replies": [reply, {**reply, "body": "r2", "replies": [reply]}]}],
              "media_content": {"_type": "gif"}},
             {"id": "p2", "comments": []}]
    with open(os.path.join(d, "posts.json"), "w") as f:
        json.dump(posts, f)
    p = read_curated_array(spark, os.path.join(d, "posts.json"), "posts")
    assert p.count() == 2
    flat = flatten_curated_comments(p, "id", "comments", levels_per_pass=2).collect()
    assert sorted((r.post_id, tuple(r.path), r.depth, r.body) for r in flat) == [
        ("p1", (0,), 1, "x"), ("p1", (0, 0), 2, "r"), ("p1", (0, 1), 2, "r2"), ("p1", (0, 1, 0), 3, "r")]


def test_merge_original_layout(spark):
    from forumflow.plans.build import merge_original_datasets
    root = tempfile.mkdtemp(prefix="ff-orig-")
    for name, posts, comms in (
        ("d1", [{"id": "p1", "title": "Reddit news", "author": "a",
                 "comments": [{"author": "x", "body": "see r/pics", "author_flair_text": "reddit fan",
                               "replies": [{"author": "y", "body": "SubReddit", "replies": []}]}]}],
         {"zeta": [{"id": "c1", "title": "r/tech", "rules": [{"short_name": "reddit", "description": "no reddit"}]}],
          "tech": [{"id": "c1", "title": "later in the same file"}]}),
        ("d2", [{"id": "p1", "title": "dup"}, {"id": "", "title": "blank"}, {"id": "p2", "title": "two"}],
         {"tech": [{"id": "c1", "title": "dup"}], "art": [{"id": "c2", "title": "r/art"}]}),
    ):
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/posts.json", "w") as f:
            json.dump(posts, f)
        with open(f"{root}/{name}/Subreddits.json", "w") as f:
            json.dump(comms, f)
        with open(f"{root}/{name}/topics.json", "w") as f:
            json.dump({"C": ["tech", "art"]}, f)
    m = merge_original_datasets(spark, root, None)
    assert sorted((r.id, r.title) for r in m["posts"].collect()) == [("p1", "voxpopuli news"), ("p2", "two")]
    com = {r.id: r for r in m["communities"].collect()}
    assert (com["c1"].title, com["c1"].rules[0].short_name, com["c1"].rules[0].description) == \
        ("v/tech", "reddit", "no voxpopuli")
    assert sorted(r.body for r in m["comments"].collect()) == ["see v/pics", "voxsphere"]
    assert sorted(r.topic for r in m["topics"].collect()) == ["art", "tech"]


def test_read_datasets_json_lines_first_wins(spark):
    from forumflow.operators.dedup import keep_first
    from forumflow.sources.datasets import read_datasets
    root = tempfile.mkdtemp(prefix="ff-jsonds-")
    for name, rows in (("a", [("1", "first"), ("1", "second"), ("2", "x")]), ("b", [("1", "third")])):
        os.makedirs(f"{root}/{name}/posts")
        with open(f"{root}/{name}/posts/part-0.json", "w") as f:
            for i, t in rows:
                f.write(json.dumps({"id": i, "title": t}) + "\n")
    rows = read_datasets(spark, root, "posts", fmt="json")
    got = {r.id: r.title for r in keep_first(rows, ["id"], ["src_file", "src_row"]).collect()}
    assert got == {"1": "first", "2": "x"}


def test_merge_published_below_its_root(spark):
    root = tempfile.mkdtemp(prefix="ff-publish-")
    for s, body in (("set1", "old"), ("set2", "new")):
        write_table(spark.createDataFrame([("9", f"title {s}")], "id string, title string"), f"{root}/{s}/posts")
        write_table(spark.createDataFrame([("9", body), (f"only-{s}", body)], "post_id string, body string"),
                    f"{root}/{s}/comments")
    out = f"{root}/a-merged"
    for _ in range(2):                      # the second merge reads what the first one published
        merge_datasets(spark, root, out)
        assert [r.title for r in spark.read.parquet(f"{out}/posts").collect()] == ["title set1"]
        got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/comments").collect())
        assert got == [("9", "old"), ("only-set1", "old"), ("only-set2", "new")]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_by_byte_ranges(spark, tmp_path, indent):
    """Many small byte ranges give the same elements in the same order as the whole file."""
    from forumflow.sources.json_arrays import array_records
    rng = random.Random(indent or 1)
    bits = ["}", "{", "[", "]", '"', "\\", "\\\\", ",", ":", "é", "\n", "x" * 40, "null", "\U0001F600", '\\"}']

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.3:
            return {"".join(rng.choices(bits, k=2)): value(depth - 1) for _ in range(rng.randrange(3))}
        if depth and kind < 0.5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return "".join(rng.choices(bits, k=rng.randrange(6))) if kind < 0.9 else rng.randrange(100)
    want = {}
    for n, size in enumerate((0, 1, 150)):
        rows = [{"id": i, "v": value(4), **({"w": value(3)} if i % 3 else {})} for i in range(size)] + [{}] * (size > 1)
        want[n] = rows
        (tmp_path / f"{n}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {}
        for r in array_records(spark, f"{tmp_path}/*.json").orderBy("file", "ord").collect():
            got.setdefault(int(r.file[-6]), []).append((r.ord, json.loads(r.record)))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == {n: list(enumerate(rows)) for n, rows in want.items() if rows}


def test_equal_maps_in_another_order_are_one_row(spark):
    from forumflow.operators.dedup import distinct_rows
    rows = spark.sql("""
        SELECT 1 AS k, map('a', map('x', 1, 'y', 2), 'b', NULL) AS m, array(named_struct('n', map(1, 'p', 2, 'q'))) AS s
        UNION ALL SELECT 1, map('b', NULL, 'a', map('y', 2, 'x', 1)), array(named_struct('n', map(2, 'q', 1, 'p')))
        UNION ALL SELECT 1, map('b', NULL, 'a', map('y', 2, 'x', 3)), array(named_struct('n', map(2, 'q', 1, 'p')))
        UNION ALL SELECT 1, NULL, NULL UNION ALL SELECT 1, NULL, NULL""")
    out = distinct_rows(rows)
    assert out.count() == 3 and out.columns == rows.columns
