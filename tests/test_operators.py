"""Operators against brute-force restatements on small random input, and
golden cases for the order-sensitive ones."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from forumflow.operators.assign import assign_capped, candidates_from_positions
from forumflow.operators.dedup import keep_first, keep_first_by_size, keep_last, positional_index, split_by_position
from forumflow.operators.joins import dealt
from forumflow.operators.members import join_members, users_table
from forumflow.operators.posts import request_plan
from forumflow.operators.topk import sort_order, top_k_per_group


def sequential_assign(rows, cap):
    """The reference loop: groups in sorted order take their first `cap`
    items not taken before; items past the cap stay free."""
    by_group = {}
    for g, item, pos in rows:
        by_group.setdefault(g, [])
        if item not in [i for i, _ in by_group[g]]:
            by_group[g].append((item, pos))
    seen, out = set(), set()
    for g in sorted(by_group):
        taken = 0
        for item, _ in sorted(by_group[g], key=lambda x: x[1]):
            if taken >= cap:
                break
            if item in seen:
                continue
            seen.add(item)
            out.add((g, item))
            taken += 1
    return out


@settings(max_examples=12, deadline=None)
@given(st.integers(min_value=0, max_value=10**6), st.integers(min_value=1, max_value=4))
def test_assign_capped_equals_sequential(spark, seed, cap):
    rnd = random.Random(seed)
    rows = [(f"g{rnd.randint(0, 4)}", rnd.randint(0, 12), i) for i in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(rows, "g string, item int, pos long")
    cands = candidates_from_positions(df, "g", "item", "pos")
    got = {(r.g, r.item) for r in assign_capped(cands, "g", "group_ord", "item", "pos", cap,
                                                 checkpoint_every=2).collect()}
    assert got == sequential_assign(rows, cap)


def test_assign_capped_each_item_once_and_cap(spark):
    rnd = random.Random(7)
    rows = [(f"g{rnd.randint(0, 9)}", rnd.randint(0, 40), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, item int, pos long")
    out = assign_capped(candidates_from_positions(df, "g", "item", "pos"), "g", "group_ord", "item", "pos", 3)
    rs = out.collect()
    assert len({r.item for r in rs}) == len(rs)
    per = {}
    for r in rs:
        per[r.g] = per.get(r.g, 0) + 1
    assert max(per.values()) <= 3


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 2, "w")], "k string, o int, v string")
    assert {(r.k, r.v) for r in keep_first(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.k, r.v) for r in keep_last(df, ["k"], ["o"]).collect()} == {("a", "x"), ("b", "z")}


def test_split_by_position_is_not_ntile(spark):
    df = spark.createDataFrame([(k,) for k in [40, 10, 30, 20]], "k int")
    parts = {r.k: r.part for r in split_by_position(df, "k").collect()}
    assert parts == {10: 1, 20: 1, 30: 1, 40: 2}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-10**9, max_value=10**9), min_size=1, max_size=300, unique=True))
def test_positional_index_exact(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.pos for r in positional_index(df, "k", partitions=5).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_request_plan_claims_before_validity(spark):
    od = spark.createDataFrame([("Cats", 0, 1), ("dogs", 5, 2), ("", 3, 3), ("Birds", 2, 4)],
                               "title string, posts_count int, ord long")
    tc = spark.createDataFrame([("cats", 1), ("Fish", 2), ("BIRDS", 3), ("fish", 4)], "title string, ord long")
    got = sorted((r.title, r.post_limit, r.source) for r in request_plan(od, tc).collect())
    # 'Cats' (count 0) is claimed first and blocks the topic 'cats'
    assert got == [("Birds", 2, "on_demand"), ("Fish", 10, "topic"), ("dogs", 5, "on_demand")]


def test_top_k_per_group(spark):
    posts = spark.createDataFrame([("c1", "p1", 5), ("c1", "p2", 9), ("c1", "p3", 9), ("c2", "p4", 1), ("c3", "p5", 1)],
                                  "g string, id string, ups long")
    reqs = spark.createDataFrame([("c1", 2), ("c2", 3)], "g string, k int")
    got = sorted((r.g, r.id, r.rn) for r in top_k_per_group(posts, reqs, "g", "k", sort_order("top")).collect())
    assert got == [("c1", "p2", 1), ("c1", "p3", 2), ("c2", "p4", 1)]


def test_join_members_moderators_first_and_by_name(spark):
    comm = spark.createDataFrame([("1",), ("2",)], "community_id string")
    mods = spark.createDataFrame([("1", "u9", "ann", 0)], "community_id string, user_id string, name string, ord long")
    seen = spark.createDataFrame([("1", "u1", "ann", 5), ("1", "u2", "bob", 6), ("1", "u3", "bob", 7),
                                  ("3", "u4", "cid", 1)], "community_id string, user_id string, name string, ord long")
    got = sorted(tuple(r) for r in join_members(comm, mods, seen).collect())
    assert got == [("1", "u2", "bob", False), ("1", "u9", "ann", True)]


def test_users_table_priorities(spark):
    mods = spark.createDataFrame([(1, "a"), (1, "c")], "user_id long, community string")
    mems = spark.createDataFrame([(1, "b"), (2, "z"), (2, "y")], "user_id long, community string")
    got = sorted((r.user_id, r.source, r.community) for r in users_table(mods, mems, "community").collect())
    assert got == [(1, "moderator", "c"), (2, "member", "y")]


def test_seeded_sample_broadcast_equals_shuffle_path(spark):
    from forumflow.operators.dedup import positional_index
    from forumflow.operators.enrich import seeded_int, seeded_sample
    keys = spark.createDataFrame([(i,) for i in range(200)], "key long")
    cat = positional_index(spark.createDataFrame([(c,) for c in "abcde"], "t string"), "t", "idx")
    k = seeded_int(F.col("key"), "k", 0, 3)
    a = {r.key: [x.t for x in r.picks] for r in seeded_sample(keys, "key", cat, "idx", k, "s").collect()}
    b = {r.key: [x.t for x in r.picks]
         for r in seeded_sample(keys, "key", cat, "idx", k, "s", broadcast_max_bytes=0).collect()}
    assert a == b and len(a) == 200
    assert all(len(set(v)) == len(v) <= 3 for v in a.values())


def _prune_spec(edges):
    """DFS from roots; a failing node hides its whole subtree."""
    kids = {}
    for post, node, parent, ok in edges:
        kids.setdefault((post, parent), []).append((node, ok))
    out = {}

    def walk(post, node, depth):
        out[(post, node)] = depth
        for child, ok in kids.get((post, node), []):
            if ok:
                walk(post, child, depth + 1)

    for post, node, parent, ok in edges:
        if parent is None and ok:
            walk(post, node, 1)
    return out


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=0, max_value=10**6))
def test_prune_threads_equals_dfs(spark, seed):
    from forumflow.operators.threads import prune_threads
    rnd = random.Random(seed)
    edges = []
    for post in range(rnd.randint(1, 4)):
        n = rnd.randint(1, 25)
        for node in range(n):
            parent = None if node == 0 or rnd.random() < 0.15 else rnd.randrange(node)
            edges.append((post, node, parent, rnd.random() > 0.2))
    df = spark.createDataFrame(edges, "post int, node int, parent int, ok boolean")
    got = {(r.post, r.node): r.depth for r in prune_threads(df, "post", "node", "parent", F.col("ok")).collect()}
    assert got == _prune_spec(edges)


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=1, max_value=400))
def test_split_parts_disjoint_and_cover(spark, n):
    df = spark.createDataFrame([(k * 7 % 1009,) for k in range(n)], "k long")
    rows = split_by_position(df, "k").collect()
    p1 = {r.k for r in rows if r.part == 1}
    p2 = {r.k for r in rows if r.part == 2}
    assert not (p1 & p2) and len(p1) + len(p2) == n and len(p1) == n // 2 + 1
    assert not p2 or max(p1) < min(p2)


def test_thread_levels_rejects_cycles(spark):
    import pytest
    from forumflow.operators.threads import thread_levels
    edges = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 1, 1)], "post int, node int, parent int")
    with pytest.raises(ValueError):
        thread_levels(edges, "post", "node", "parent", max_depth=6)


def test_top_k_newest_first(spark):
    posts = spark.createDataFrame([("c", "a", 1, 10.0), ("c", "b", 1, 30.0), ("c", "d", 1, 30.0), ("c", "e", 1, 20.0)],
                                  "g string, id string, ups long, created_utc double")
    reqs = spark.createDataFrame([("c", 3)], "g string, k int")
    got = [(r.id, r.rn) for r in top_k_per_group(posts, reqs, "g", "k", sort_order("new")).orderBy("rn").collect()]
    assert got == [("b", 1), ("d", 2), ("e", 3)]


def test_join_members_known_names(spark):
    comm = spark.createDataFrame([("c1",), ("c2",)], "community_id string")
    mods = spark.createDataFrame([("c1", "u1", "boss", 0), ("zz", "u9", "ghost", 0)],
                                 "community_id string, user_id string, name string, ord bigint")
    seen = spark.createDataFrame([("c2", "u1", "boss_old", 1), ("c2", "u2", "first", 1), ("c2", "u2", "second", 2),
                                  ("c1", "u1", "boss_old", 1)],
                                 "community_id string, user_id string, name string, ord bigint")
    got = sorted(tuple(r) for r in join_members(comm, mods, seen).collect())
    # a known user keeps the known name, so the two names are one member
    assert got == [("c1", "u1", "boss", True), ("c2", "u1", "boss", False), ("c2", "u2", "first", False)]


def test_broadcast_is_decided_by_bytes(spark):
    from forumflow.operators.joins import measure
    df = spark.createDataFrame([("x" * 1000, [1, 2]), (None, None)], "t string, a array<int>")
    rows, size = measure(df)
    assert rows == 2 and 1000 < size < 1200


def test_pruning_of_deep_threads_takes_log_rounds(spark, monkeypatch):
    """Chains of 1,500 and 700 nodes, one cut in the middle, with side branches: depths as by a walk, few joins."""
    from forumflow.operators import threads
    rows = [("a", i, i - 1 if i else None, True) for i in range(1500)] + [("b", i, i - 1 if i else None, i != 400) for i in range(700)]
    rows += [("a", 5000 + i, i, i % 2 == 0) for i in range(0, 1500, 7)] + [("c", 1, 2, True), ("c", 2, 1, True), ("c", 3, 9, True), ("c", 4, None, True)]
    up = {(p, n): (u, ok) for p, n, u, ok in rows}
    want = {}
    for p, n, _, _ in rows:
        depth, at, seen = 0, n, set()
        while at is not None and (p, at) in up and up[p, at][1] and at not in seen:
            seen.add(at)
            depth, at = depth + 1, up[p, at][0]
        if at is None:
            want[p, n] = depth
    rounds = []
    cut = threads.cut_lineage
    monkeypatch.setattr(threads, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    edges = spark.createDataFrame(rows, "post string, node long, parent long, ok boolean").repartition(4)
    got = {(r.post, r.node): r.depth for r in threads.prune_threads(edges, "post", "node", "parent", F.col("ok")).collect()}
    assert got == want and max(got.values()) == 1500
    assert len(rounds) < 15


def test_nested_threads_of_random_trees(spark):
    import json
    import random
    from forumflow.operators.threads import nest_threads
    rng = random.Random(3)
    rows, tree = [], {}
    for p in range(20):
        for n in range(rng.randrange(1, 40)):
            rows.append((p, n, None if n == 0 or rng.random() < 0.2 else rng.randrange(n), rng.randrange(5), f'b"{n}\\'))
    for p, n, u, o, b in sorted(rows, key=lambda r: (r[3], r[1])):
        tree.setdefault((p, u), []).append((n, b))

    def listing(p, u):
        out = []
        for n, b in tree.get((p, u), []):
            kids = listing(p, n)
            out.append({"kind": "t1", "data": {"body": b, "n": n, "replies": {"kind": "Listing", "data": {"children": kids}} if kids else ""}})
        return out
    nodes = spark.createDataFrame(rows, "post int, node int, parent int, o int, body string")
    got = nest_threads(nodes, "post", "node", "parent", "o", "depth", F.lit("t1"), [F.col("body"), F.col("node").alias("n")])
    assert {r.post: json.loads(r.roots_json) for r in got.collect()} == {p: listing(p, None) for p in range(20)}


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10**6), st.integers(min_value=1, max_value=3), st.integers(min_value=1, max_value=3))
def test_assign_capped_in_blocks_equals_sequential(spark, seed, cap, block):
    rnd = random.Random(seed)
    rows = [(f"g{rnd.randint(0, 8)}", rnd.randint(0, 9), i) for i in range(rnd.randint(1, 80))]
    df = spark.createDataFrame(rows, "g string, item int, pos long")
    out = assign_capped(candidates_from_positions(df, "g", "item", "pos"), "g", "group_ord", "item", "pos", cap,
                        checkpoint_every=1, block=block)
    assert sorted((r.g, r.item) for r in out.collect()) == sorted(sequential_assign(rows, cap))


def test_assign_capped_many_groups_one_list_in_few_rounds(spark, monkeypatch):
    from forumflow.operators import assign
    cuts = []
    monkeypatch.setattr(assign, "cut_lineage", lambda df: cuts.append(1) or df.checkpoint(eager=True))
    groups, cap = 1001, 3
    df = (spark.range(groups).withColumnRenamed("id", "group_ord")
          .select(F.format_string("g%04d", "group_ord").alias("g"), "group_ord",
                  F.explode(F.sequence(F.lit(0), F.lit(59))).alias("item")).withColumn("pos", F.col("item")))
    out = assign_capped(df, "g", "group_ord", "item", "pos", cap).collect()
    assert sorted((r.g, r.item) for r in out) == [(f"g{i // cap:04d}", i) for i in range(60)]
    assert len(cuts) <= 1 + 2 * 6


def test_assign_capped_drops_candidates_without_item(spark):
    df = spark.createDataFrame([("a", 0, None, 0), ("a", 0, "x", 1), ("b", 1, "x", 0)], "g string, o int, i string, p int")
    assert [tuple(r) for r in assign_capped(df, "g", "o", "i", "p", 2).collect()] == [("a", 0, "x", 1)]
    assert assign_capped(df.limit(0), "g", "o", "i", "p", 2).collect() == []


def test_rank_in_groups_equals_row_number(spark):
    from pyspark.sql import Window
    from forumflow.operators.dedup import rank_in_groups
    # one group holds a third of all rows, one group is NULL, equal order values fall back to the id
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 100).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = rank_in_groups(df, "g", order, "rn").select("id", "rn")
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint").alias("rn"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert rank_in_groups(df.limit(0), "g", order, "rn").collect() == []


def test_top_k_beyond_the_partial_limit(spark):
    posts = spark.range(8000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("cold")).alias("c"),
                                     (F.col("id") * 31 % 1000).alias("ups"), F.col("id"))
    reqs = spark.createDataFrame([("hot", 5000), ("cold", 2), ("none", 3)], "c string, k int")
    out = top_k_per_group(posts, reqs, "c", "k", sort_order("top"))
    rows = sorted(posts.collect(), key=lambda r: (-r.ups, r.id))
    want = {(r.c, i + 1, r.id) for c, k in (("hot", 5000), ("cold", 2))
            for i, r in enumerate([x for x in rows if x.c == c][:k])}
    assert {(r.c, r.rn, r.id) for r in out.collect()} == want


def test_child_pages_hold_whole_lists_in_order(spark):
    from forumflow.operators.child_pages import child_pages
    kids = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") == 1, F.lit(None))
                                    .otherwise(F.col("id") % 20 + 2).alias("parent"), (-F.col("id")).alias("o"), "id")
    pages = child_pages(kids, "parent", ["o"], ["id"], page_rows=10).orderBy("parent", "page").collect()
    got = {}
    for r in pages:
        assert r.page == len(got.get(r.parent, [])) / 10 and 1 <= len(r["items"]) <= 10
        got.setdefault(r.parent, []).extend(x.id for x in r["items"])
    want = {}
    for r in sorted(kids.where("parent IS NOT NULL").collect(), key=lambda r: r.o):
        want.setdefault(r.parent, []).append(r.id)
    assert got == want


# -- partitions by size -------------------------------------------------------

def sizes(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().collect()


def test_partitions_grow_with_the_rows(spark):
    df = spark.range(4000).select("id", F.lit("x" * 68).alias("text"))       # 100 bytes a row
    assert dealt(df, "id").rdd.getNumPartitions() == df.rdd.getNumPartitions()
    for rows, parts in ((1000, 10), (4000, 40)):
        got = dealt(df.where(F.col("id") < rows), "id", part_bytes=10_000)
        assert got.rdd.getNumPartitions() == parts
        assert sum(r["count"] for r in sizes(got)) == rows and max(r["count"] for r in sizes(got)) < 200


def test_first_by_size_is_the_first(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["", None, *map(str, range(900))]), rng.choice("ab"), n, n % 7) for n in range(3000)]
    df = spark.createDataFrame(rows, "id string, src_file string, src_row long, v int")
    args = ["id"], ["src_file", "src_row"]
    got = keep_first_by_size(df, *args, part_bytes=8_000)
    assert got.columns == df.columns
    assert got.rdd.getNumPartitions() >= 20
    assert sorted(map(str, got.collect())) == sorted(map(str, keep_first(df, *args).collect()))
