"""Conversation trie, quality classifier and vector codes against brute force, on small tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL

from forumflow.llm import ball_kmeans, common, prefix_trie, quality, queries

CONV_SCHEMA = ("conv_id bigint, turn bigint, role string, text string, id string, ids string, words string, digest string, part string, "
               "rank string, h int, source string, key string, shard string, kind string, depth string, found string, _salt string")
VEC_SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, tag string, vec string, part string, _salt string"
DOC_SCHEMA = "doc_id bigint, text string, lang string, x string, y int, score string, quality int, at int, held_out string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 11 -----------------------------------------------------------------------

def turn_key(turn, role, text):
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, role, digest)


def brute_trie(rows):
    """Rows (conv_id, turn, role, text) -> the node rows, by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: turn_key(*x))] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += worth
            leaves[k[:d]] += k not in kids
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()), key=repr)


def conv_frame(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * 6, 3, *["z"] * 7) for r in rows], CONV_SCHEMA)


ODD_TURNS = [
    (0, 0, "user", "hello there"), (0, 1, "bot", "hi"), (0, 2, "user", "a\x0bb\x1cc d e\x85f"), (0, 2, "user", "tie"), (0, None, None, None),
    (1, 5, "user", None), (1, 6, None, "x"), (1, 6, None, "x"), (1, 6, None, "x"), (2, None, "user", "hello there"), (3, 0, "", ""),
    (4, 0, "user", "w " * 50_000), (5, 0, "u", "ser:x"), (6, 0, "us", "er:x"), (None, 0, "user", "lost"), (40, 0, "a", "b"), (41, 0, "a", "b"),
    (55, 3, "user", ""), (-3, 0, "user", "minus"), (200, 0, "é", "\U0001F600 é"), (10 ** 15, 1, "user", "far"),
    *((7, i, "r", str(i % 3)) for i in range(300)), *((8, i, "r", str(i % 3)) for i in range(290)),
]


@pytest.mark.parametrize("shard_turns,group", [(1 << 18, 256), (60, 256), (40, 2)])
def test_trie_of_odd_rows(spark, shard_turns, group):
    seqs = prefix_trie.rebuilt(prefix_trie.sequences(conv_frame(spark, ODD_TURNS)))
    got = rows_of(prefix_trie.prefix_trie(seqs, shard_turns=shard_turns, least_turns=shard_turns, group=group))
    assert got == brute_trie(ODD_TURNS)


def test_trie_of_many_copies_over_shards_and_levels(spark):
    """Copies of one conversation, and prefixes of it, reach over many shards and three levels of merging."""
    rng, rows = random.Random(5), []
    for c in range(400):
        kind = rng.random()
        texts = ["a", "b", "c", "d"] if kind < 0.5 else ["a", "b"] if kind < 0.6 else [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        rows += [(c, i, "user", t) for i, t in enumerate(texts)]
    seqs = prefix_trie.rebuilt(prefix_trie.sequences(conv_frame(spark, rows)))
    got = rows_of(prefix_trie.prefix_trie(seqs, shard_turns=50, least_turns=50, group=3))
    assert got == brute_trie(rows)


def test_trie_join_beyond_the_broadcast_limit(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), "id")
    side = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    got = rows_of(common.salted_left_join(rows, side, "k", limit=0, salts=4).select("id", "v"))
    assert got == sorted(((i, "ab"[i % 3] if i % 3 < 2 else None) for i in range(40)), key=repr)


def test_trie_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF_ORACLE}/conversations.parquet").collect()]
    assert rows_of(queries.QUERIES["op11_conversation_trie"](spark, SF_ORACLE)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(conv_frame(spark, [])).collect() == []
    assert prefix_trie.conversation_trie(conv_frame(spark, [(None, 1, "a", "b")])).collect() == []


def test_tree_is_balanced_by_medians():
    tree = prefix_trie.Tree()
    for i in prefix_trie.median_order(1023):
        tree.insert([i], [1])
    height, todo = 0, [(tree.equal[0], 1)]
    while todo:
        v, h = todo.pop()
        if v:
            height = max(height, h)
            todo += [(tree.low[v], h + 1), (tree.high[v], h + 1)]
    assert height == 10


# -- 12 -----------------------------------------------------------------------

def test_statistics_of_odd_texts():
    for t in ["", " \n\t", "x", "é" * 3, "a\x00b", "word " * 50_000, "| | |", "�"]:
        x = quality.statistics(t.encode())
        assert len(x) == len(quality.STATS) and np.isfinite(x).all()
    x = dict(zip(quality.STATS, quality.statistics("Ab cd\ncd cd!".encode())))
    assert x["chars"] == np.log1p(12) and x["words"] == np.log1p(4) and x["lines"] == np.log1p(2)
    assert np.isclose(np.sin(x["upper"]) ** 2, 1 / 8) and np.isclose(np.sin(x["same_next"]) ** 2, 1 / 4)
    assert np.isclose(np.sin(x["distinct"]) ** 2, 3 / 4) and np.isclose(np.sin(x["odd_ends"]) ** 2, 1 / 4)


def plain_scores(train_x, train_y, x):
    """The discriminant from its definition: whole arrays, explicit inverses and determinants."""
    mean, scale = train_x.mean(0), train_x.std(0)
    scale[scale < 1e-6] = 1
    z, q = (train_x - mean) / scale, (x - mean) / scale
    covs = {k: np.cov(z[train_y == k].T, bias=True) for k in (0, 1)}
    pooled = sum((train_y == k).mean() * covs[k] for k in (0, 1))
    log = {}
    for k in (0, 1):
        n = (train_y == k).sum()
        s = quality.shrunk((n * covs[k] + quality.PRIOR * pooled) / (n + quality.PRIOR), n + quality.PRIOR)
        d = q - z[train_y == k].mean(0)
        log[k] = np.log(n / len(train_y)) - (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)) / 2
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -quality.BOUND, quality.BOUND)))


def test_quality_query_against_plain_arrays(spark):
    docs, labels = (pd.read_parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    x = np.array([quality.statistics(t.encode()) for t in docs.text])
    y = dict(zip(labels.doc_id, labels.quality))
    held = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2).to_numpy()
    known = docs.doc_id.isin(y).to_numpy()
    ty = docs.doc_id.map(y).to_numpy()
    want = plain_scores(x[known & ~held], ty[known & ~held].astype(int), x)
    got = queries.QUERIES["op12_quality"](spark, SF_ORACLE).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert (got.held_out.to_numpy() == held).all()
    assert np.abs(got.score.to_numpy() - want).max() < 1e-6
    assert (got.predicted.to_numpy() == (got.score.to_numpy() >= 0.7)).all()
    test = known & held
    good, bad = want[test & (ty == 1)], want[test & (ty == 0)]
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (good >= 0.7).mean() > 0.95 and (bad >= 0.7).mean() < 0.1


def quality_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "s", 0, 1, "h") for i, t in rows], DOC_SCHEMA)


def test_quality_of_odd_rows(spark):
    texts = [(i, f"some words {'and' * (i % 5)} that read well {i}.") for i in range(60)] + [(100 + i, "BUY!! NOW!! " * (3 + i % 4)) for i in range(60)]
    odd = [(500, None), (501, ""), (None, "no id"), (None, None), (502, "z" * 400_000), (0, "a second text under the id 0"), (1, texts[1][1])]
    labels = spark.createDataFrame([(i, 1, "l") for i in range(60)] + [(100 + i, 0, "l") for i in range(60)]
                                   + [(None, 0, "l"), (900, 0, "l"), (3, 5, "l"), (4, None, "l"), (5, 0, "l")], "doc_id bigint, quality int, text string")
    got = quality.quality(quality_docs(spark, texts + odd), labels).toPandas()
    assert len(got) == len(texts) + len(odd) and got.score.between(0, 1).all()
    assert got[got.doc_id.between(100, 159)].predicted.sum() == 0
    assert got[got.doc_id.between(6, 59)].predicted.mean() > 0.9
    assert len(set(got[got.doc_id.isin([500, 501])].score)) == 1        # null as empty
    assert dict(quality.usable(labels).collect()).get(5, 0) == 0        # one label says low


def test_quality_without_labels(spark):
    docs = quality_docs(spark, [(1, "a"), (None, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in quality.quality(docs, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert {r.score for r in quality.quality(docs, one).collect()} == {1.0}
    assert quality.quality(quality_docs(spark, []), one).collect() == []


# -- 13 -----------------------------------------------------------------------

def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Rows (vec_id, vector, label) -> result rows by full search in plain integers."""
    kept = [(i, [int(np.floor(1024.0 * float(np.float32(e)))) for e in v], label) for i, v, label in rows
            if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    x = np.array([v + [0] * (width * parts - len(v)) for _, v, _ in kept], dtype=np.int64).reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    books = x[first].swapaxes(0, 1).copy()

    def nearest():
        d = ((x.swapaxes(0, 1)[:, :, None, :] - books[:, None]) ** 2).sum(3)
        return d.argmin(2), d.min(2).sum(0)
    for _ in range(rounds):
        codes, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[codes[p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    codes, error = nearest()
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in codes[:, n]), int(error[n]), by_label[label], digest)
                   for n, (i, _, label) in enumerate(kept)), key=repr)


def vec_frame(spark, rows):
    return spark.createDataFrame([(i, v, label, *["z"] * 6) for i, v, label in rows], VEC_SCHEMA)


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=10).tolist(), i % 3) for i in range(400)]
    rows += [(i, rng.integers(-2, 3, 8).astype(float).tolist(), None) for i in range(400, 700)]        # ties
    rows += [(7, rows[7][1], 0), (7, [0.5] * 10, None), (None, [1.0] * 10, 1), (None, [], 2), (900, None, 1), (901, [1.0, None], 1),
             (902, [float("nan")] * 10, 1), (903, [float("inf")], 1), (904, [3.0], 1)]
    assert rows_of(ball_kmeans.vector_codes(vec_frame(spark, rows), block=97)) == brute_codes(rows)


def test_codes_of_few_and_no_rows(spark):
    rows = [(3, [1.0, -1.0, 0.5], 1), (2, [1.0, -1.0, 0.5], None)]
    assert rows_of(ball_kmeans.vector_codes(vec_frame(spark, rows))) == brute_codes(rows)
    assert rows_of(ball_kmeans.vector_codes(vec_frame(spark, [(1, [], 1)]))) == brute_codes([(1, [], 1)])
    assert ball_kmeans.vector_codes(vec_frame(spark, [])).collect() == []
    assert ball_kmeans.vector_codes(vec_frame(spark, [(1, None, 1)])).collect() == []


def test_codes_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * 10 ** (i % 6)).astype(np.float32).tolist(), 0) for i in range(300)]
    assert rows_of(ball_kmeans.vector_codes(vec_frame(spark, rows))) == brute_codes(rows)
    huge = vec_frame(spark, [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0)])
    assert [r.error for r in ball_kmeans.vector_codes(huge).collect()] == [0, 0]


def test_codes_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet").collect()]
    assert rows_of(queries.QUERIES["op13_vector_codes"](spark, SF_ORACLE)) == brute_codes(rows)


def test_ball_search_is_exact_and_skips_work():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (3000, 4)) + rng.integers(0, 12, (3000, 1)) * 40
    entries = x[rng.choice(3000, 64, replace=False)].astype(np.int64)
    entries[10] = entries[5]                                        # equal entries: the lower number wins
    before = rng.integers(0, 64, 3000)
    near = ball_kmeans.full_search(x, entries, True)
    balls = ball_kmeans.Balls(entries, True)
    for start in (before, near):
        found, work = balls.search(x, start)
        assert (found == near).all()
    assert work < x.shape[0] * len(entries) / 3
    assert (ball_kmeans.Balls(entries, False).search(x, near)[0] == near).all()
