"""Versioned datasets, the topic-map file and the keyed view of a landing stream."""

import json

import pytest
from pyspark.sql import functions as F

from forumflow.plans.build import merge_datasets, stage_landed
from forumflow.sinks.versions import publish_version, read_version, versions
from forumflow.sinks.writers import write_table, write_topic_map
from forumflow.sources.landed import read_topic_lines


def _df(spark, v):
    return spark.createDataFrame([(v,)], "v string")


def test_a_publish_that_fails_half_way_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "set")
    with pytest.raises(ValueError):
        read_version(spark, root)
    assert publish_version({"a": _df(spark, "a1"), "b": _df(spark, "b1")}, root) == 1
    broken = _df(spark, "b2").select(F.when(F.col("v") == "b2", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        publish_version({"a": _df(spark, "a2"), "b": broken}, root)
    assert {n: df.first().v for n, df in read_version(spark, root).items()} == {"a": "a1", "b": "b1"}
    assert publish_version({"a": _df(spark, "a3")}, root, "json") == 3      # the number of the failed one is not used again
    assert versions(spark, root) == [1, 3]
    assert {n: df.first().v for n, df in read_version(spark, root).items()} == {"a": "a3"}
    assert read_version(spark, root, 1)["b"].first().v == "b1"
    with pytest.raises(ValueError):
        read_version(spark, root, 2)


def test_a_version_without_a_finished_manifest_does_not_count(spark, tmp_path):
    root = tmp_path / "set"
    publish_version({"a": _df(spark, "a1")}, str(root))
    publish_version({"a": _df(spark, "a2")}, str(root))
    (root / "_manifest" / "version-00000002" / "_SUCCESS").unlink()          # as a driver lost while writing it leaves it
    assert read_version(spark, str(root))["a"].first().v == "a1"


def test_versioned_merge_below_its_root(spark, tmp_path):
    root, out = str(tmp_path), str(tmp_path / "a-merged")
    for s, body in (("set1", "old"), ("set2", "new")):
        write_table(spark.createDataFrame([("9", f"title {s}")], "id string, title string"), f"{root}/{s}/posts")
        write_table(spark.createDataFrame([("9", body), (f"only-{s}", body)], "post_id string, body string"), f"{root}/{s}/comments")
    for n in (1, 2, 3):                     # each merge reads the last version beside the plain datasets
        m = merge_datasets(spark, root, out, versioned=True)
        assert versions(spark, out)[-1] == n
        assert [r.title for r in m["posts"].collect()] == ["title set1"]
        assert sorted(tuple(r) for r in m["comments"].collect()) == [("9", "old"), ("only-set1", "old"), ("only-set2", "new")]


def test_topic_map_file_keeps_headings_and_empty_lists(spark, tmp_path):
    rows = spark.createDataFrame([("A & \"B\"", ["x", "y"]), ("none", None), (None, ["z"])], "section string, items array<string>")
    write_topic_map(rows, str(tmp_path / "map"))
    back = sorted((r.category, r.ord, r.topic) for r in read_topic_lines(spark, str(tmp_path / "map")).collect())
    assert back == [("A & \"B\"", 0, "x"), ("A & \"B\"", 1, "y")]
    assert any('"none":[]' in r.value for r in spark.read.text(str(tmp_path / "map")).collect())


def _line(endpoint, key, payload):
    return json.dumps({"endpoint": endpoint, "key": key, "payload": payload,
                       "result_state": {"status_code": 200 if payload else 503, "success": bool(payload), "error": None}})


def test_stream_gives_what_one_batch_read_gives(spark, tmp_path):
    from forumflow.streaming.landing import current_landing, start_landing
    land, out = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()
    rules = lambda d: json.dumps({"rules": [{"short_name": d, "description": d}]})
    files = {"b.jsonl": [_line("rules", "k1", rules("b1")), _line("rules", "k1", rules("b2")), _line("rules", "k2", None), "no envelope",
                         _line("2024", "k9", "[1]")],
             # lands later, but comes first by path; and a payload that does not parse replaces nothing
             "a.jsonl": [_line("rules", "k1", rules("a1")), _line("moderators", "m", "<html>")],
             "c.jsonl": [_line("rules", "k3", rules("c1")), _line("rules", "k1", "<html>"), _line("rules", None, rules("n1")),
                         _line("rules", None, rules("n2"))]}
    for name, lines in files.items():       # three batches, each by a stream started anew
        (land / name).write_text("\n".join(lines) + "\n")
        q = start_landing(spark, str(land), out, name=f"t_keyed_{tmp_path.name}", trigger_available_now=True)
        q.awaitTermination(120)
    ok, bad = current_landing(spark, out)
    want_ok, want_bad = stage_landed(spark, str(land))
    rows = lambda df, cols: sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    cols = ["endpoint", "key", "payload", "result_state"]
    assert rows(ok, cols) == rows(want_ok.withColumn("endpoint", F.col("endpoint").cast("string")), cols)
    got = {(r.endpoint, r.key): r.payload for r in ok.collect()}
    assert got[("rules", "k1")] == rules("b2") and got[("rules", None)] == rules("n2") and ("2024", "k9") in got
    cols = ["endpoint", "key", "status_code", "error"]
    assert rows(bad, cols) == rows(want_bad, cols) and len(rows(bad, cols)) == 4


def test_landing_reads_payloads_once_and_shuffles_keys_only(spark, tmp_path):
    import re
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.jsonl").write_text("\n".join(_line("rules", f"k{i % 5}", '{"rules": []}') for i in range(20)) + "\n")
    from forumflow.sources.landed import last_per_key
    df = spark.read.json(str(land)).withColumn("place", F.monotonically_increasing_id())
    plan = last_per_key(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin|hashpartitioning", plan)       # the keys were grouped before; they are broadcast
    assert last_per_key(df).count() == 5


def test_user_row_without_enrichment_has_all_columns(spark):
    from forumflow.operators.enrich import user_row
    df = spark.createDataFrame([("u1", "n")], "id string, name string")
    plain, rich = (df.select(*user_row("id", "name", enrich=e)).first() for e in (False, True))
    assert list(plain.asDict()) == list(rich.asDict())
    assert plain.avatar_img is None and plain.public_description is None and plain.banner_img == ""
    assert rich.avatar_img.startswith("https://") and rich.public_description
