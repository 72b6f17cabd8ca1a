"""Odd rows that once failed a job or were decided wrongly: white space without end, null and repeated ids, private names."""

import hashlib
import random
import tracemalloc
import tempfile

import numpy as np
import pytest

import corpus_pipeline
from forumflow.llm import bpe, decontam, ngram_join, secret_scan, token_counts, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
ITEM = " ".join(WORDS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- white space --------------------------------------------------------------

@pytest.mark.parametrize("white", [" ", "\n", "\t", "　", " \n"])
def test_cut_white_space_gives_the_same_ids(white):
    enc, run = bpe.encoding(bpe.RANKS), white * (6000 // len(white))
    for text in [run, f"a{run}b", f"{run}b", f"b{run}", f"b {run} é", f"{run}'s{run}12", f"x{run}\x1cy", f"a{run[:4095]}b"]:
        assert bpe.encode_text(enc, text, 1 << 16) == enc.encode_ordinary(text)


def test_two_million_white_space_characters(spark):
    texts = [" " * 2_000_000, "\n" * 2_000_000 + "x", "a" + " \n" * 1_000_000 + " b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.encode_decode(docs).collect()}
    assert got == {i: t.encode() for i, t in enumerate(texts)}
    edits = docs.selectExpr("doc_id", "text", f"cast(null as {token_counts.EDITS}) edits")
    counted = token_counts.apply_edits(token_counts.build_trees(edits), keep_version=False)
    enc = bpe.encoding(token_counts.RANKS)
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {i: len(bpe.encode_text(enc, t, 1 << 16)) for i, t in enumerate(texts)}
    out = corpus_pipeline.tokenize(spark, docs, "").collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


# -- ids ----------------------------------------------------------------------

def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, f"x {ITEM} y"), (2, "clean words only")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, ITEM), (7, ITEM), (7, ITEM), (None, f"{ITEM} nu"), (3, None)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.contaminated_spans(docs, items).collect()}
    assert got == {1: (12, [7, None]), 2: (0, [])}


ROWS = [(None, ITEM, "a"), (None, "some clean text", "b"), (None, ITEM, "c"), (4, ITEM, "d"), (4, "another clean text", "e"),
        (5, None, "f"), (5, "", "g"), (6, f"Well: {ITEM}!", "h")]


def test_contaminated_rows_go_by_their_own_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, _bad string")
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert sorted(r["_bad"] for r in decontam.decontaminate(docs, items).collect()) == ["b", "e", "f", "g"]


def test_toxic_rows_go_by_their_own_text(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choices(WORDS, k=12)), "x") for i in range(300)]
    toxic = [(1000 + i, "vile " + " ".join(rng.choices(WORDS, k=12)), "x") for i in range(300)]
    docs = spark.createDataFrame(clean + toxic + [(None, "vile alpha", "gone"), (None, "alpha beta", "stays"), (0, "vile beta", "gone"),
                                                  (2000, None, "stays")], "doc_id bigint, text string, digest string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _, _ in clean + toxic], "doc_id bigint, toxic int")
    kept = toxicity.keep_clean(docs, labels).collect()
    assert sum(r.digest == "stays" for r in kept) == 2 and not any(r.digest == "gone" for r in kept)
    assert {r.doc_id for r in kept if r.digest == "x"} == set(range(300))


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " more"
    rows = [(None, text, 1), (9, text, 2), (3, near, 3), (3, near, 4), (3, "something else entirely here now", 5), (None, "lone words", 6),
            (None, "lone words", 7), (None, None, 8), (8, None, 9), (8, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row int")
    kept = sorted(r["_row"] for r in ngram_join.keep_one(docs).collect())
    assert len(kept) == 6 and set(kept) >= {5, 8, 9, 10}
    assert len({3, 4} & set(kept)) == 1 and len({6, 7} & set(kept)) == 1
    assert ngram_join.keep_one(docs).columns == docs.columns


# -- labels that repeat -------------------------------------------------------

def test_repeated_toxic_text_is_learnt(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS, k=8))) for i in range(3000)] + [(i, "one and the same bad text") for i in range(3000, 6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i >= 3000)) for i, _ in rows] + [(i, 0) for i in range(10_000, 60_000)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert min(r.score for r in got if r.doc_id >= 3000) > 0.7
    assert max(r.score for r in got if r.doc_id < 3000) < 0.3


def odd_sample(seed=3, n=60):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(12, rng.integers(0, 6), replace=False)).astype(np.int32) for _ in range(n)]
    return rows, (rng.random(n) < 0.4).astype(float), rng.integers(1, 5, n)


def test_weights_are_copies():
    rows, y, weight = odd_sample()
    rows, y, weight = rows * 4, np.tile(y, 4), np.tile(weight, 4)
    once = toxicity.fit(rows, y, weight)
    many = toxicity.fit([r for r, n in zip(rows, weight) for _ in range(n)], np.repeat(y, weight))
    assert np.abs(once.scores(rows) - many.scores(rows)).max() < 1e-6


def test_pair_screening_is_bounded_in_memory():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(2500, 60, replace=False)).astype(np.int32) for _ in range(5000)]
    y = (rng.random(len(rows)) < 0.2).astype(float)
    every, sizes = np.concatenate(rows), [len(r) for r in rows]
    seen, toxic = np.bincount(every, minlength=2500), np.bincount(every, np.repeat(y, sizes), 2500)
    tracemalloc.start()
    found = toxicity.paired(rows, y, seen, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert found.tolist() == toxicity.paired(rows, y, seen, toxic, 2048).tolist()


def test_gradient_against_finite_differences():
    rows, y, weight = odd_sample()
    rng = np.random.default_rng(0)
    w0, w, v = 0.3, rng.normal(size=12), rng.normal(size=(12, toxicity.RANK))
    sizes = np.array([len(r) for r in rows])
    at = (np.concatenate(rows), np.r_[0, np.cumsum(sizes)[:-1]], sizes, np.repeat(np.arange(len(rows)), sizes), y, weight.astype(float))
    _, d0, dw, dv = toxicity.loss_gradient(w0, w, v, *at)
    step = 1e-6

    def slope(a, b):
        return (toxicity.loss_gradient(*a, *at)[0] - toxicity.loss_gradient(*b, *at)[0]) / (2 * step)
    assert abs(slope((w0 + step, w, v), (w0 - step, w, v)) - d0) < 1e-6
    for i in range(12):
        e = np.eye(12)[i] * step
        assert abs(slope((w0, w + e, v), (w0, w - e, v)) - dw[i]) < 1e-6
        for f in range(toxicity.RANK):
            u = np.zeros_like(v)
            u[i, f] = step
            assert abs(slope((w0, w, v + u), (w0, w, v - u)) - dv[i, f]) < 1e-6


def test_scores_against_all_pairs():
    """The machine's score from its definition: a sum over single terms and over all pairs."""
    rows, y, weight = odd_sample(5, 200)
    m = toxicity.fit(rows, y, weight)
    for r, s in zip(rows, m.scores(rows)):
        margin = m.w0 + sum(m.w[i] for i in r) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(r) for b in r[:k])
        assert abs(1 / (1 + np.exp(-margin)) - s) < 1e-5


# -- the ledger ---------------------------------------------------------------

def test_a_new_path_with_a_known_blob_shows_its_secrets(spark):
    folder = tempfile.mkdtemp() + "/ledger"
    old = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "nothing")], "path string, text string")
    _, scanned, found = secret_scan.scan_versions(old)
    secret_scan.record(folder, scanned, found)
    new = spark.createDataFrame([("c", "token=abcdefgh1"), ("d", "token=abcdefgh1"), ("e", "AKIA" + "Z" * 16), ("f", "nothing")],
                                "path string, text string")
    ledger = secret_scan.recorded(spark, folder)
    paths, scanned, found = secret_scan.scan_versions(new, **ledger)
    blob = hashlib.sha256(("AKIA" + "Z" * 16).encode()).hexdigest()
    assert {r.blob for r in scanned.collect()} == {blob}
    shown = rows_of(paths.join(found, "blob").select("path", "rule", "start", "end"))
    assert shown == [("c", "assign", 0, 15), ("d", "assign", 0, 15), ("e", "access", 0, 20)]
    docs = new.withColumnRenamed("path", "doc_id")
    assert rows_of(secret_scan.doc_findings(docs, **ledger)) == rows_of(secret_scan.doc_findings(docs))
    assert rows_of(secret_scan.redact(docs, **ledger)) == rows_of(secret_scan.redact(docs))
    secret_scan.record(folder, scanned, found)
    assert secret_scan.scan_versions(new, **secret_scan.recorded(spark, folder))[1].count() == 0
    # a rule's new version is scanned again, and its old findings don't come back
    rules = tuple(secret_scan.Rule("assign", r"token=[a-z]+", version=9) if r.name == "assign" else r for r in secret_scan.RULES)
    paths, scanned, found = secret_scan.scan_versions(new, rules=rules, **secret_scan.recorded(spark, folder))
    assert {(r.rule, r.version) for r in scanned.collect()} == {("assign", 9)}
    assert rows_of(found.select("rule", "version", "end")) == [("access", 1, 20), ("assign", 9, 14)]


def test_redact_keeps_columns_with_private_names(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1 x", "s", "k", "b", "B"), (2, None, "s2", "k2", "b2", "B2")],
                                 "doc_id bigint, text string, _spans string, _key string, _blob string, _BLOB_ string")
    assert rows_of(secret_scan.redact(docs)) == [(1, "[SECRET] x", "s", "k", "b", "B"), (2, None, "s2", "k2", "b2", "B2")]
