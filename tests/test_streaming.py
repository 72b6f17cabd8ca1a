import json
import os
import tempfile

from forumflow.streaming.landing import landing_health, start_landing


def _write(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def _env(ep, key, ok):
    return {"endpoint": ep, "key": key, "payload": '{"a": 1}' if ok else None,
            "result_state": {"status_code": 200 if ok else 503, "success": ok, "error": None if ok else "x"}}


def test_landing_stream_resumes(spark):
    land = tempfile.mkdtemp(prefix="ff-land-")
    out = tempfile.mkdtemp(prefix="ff-out-")
    _write(land, "a.jsonl", [_env("rules", "k1", True), _env("rules", "k2", False)])
    q = start_landing(spark, land, out, name="t_landing", trigger_available_now=True)
    q.awaitTermination(120)
    _write(land, "b.jsonl", [_env("moderators", "k3", True)])
    q = start_landing(spark, land, out, name="t_landing", trigger_available_now=True)
    q.awaitTermination(120)
    ok = spark.read.parquet(f"{out}/envelopes")
    assert sorted(r.key for r in ok.collect()) == ["k1", "k3"]      # each file processed once
    assert [r.key for r in spark.read.parquet(f"{out}/rejects").collect()] == ["k2"]
    h = landing_health(spark, land, name="t_health", trigger_available_now=True)
    h.awaitTermination(120)
    got = sorted((r.endpoint, r.ok, r.n) for r in spark.table("t_health").collect())
    assert got == [("moderators", True, 1), ("rules", False, 1), ("rules", True, 1)]


def test_batch_replay_is_idempotent(spark):
    from forumflow.streaming.landing import write_landing_batch
    out = tempfile.mkdtemp(prefix="ff-idem-")
    batch = spark.createDataFrame([("rules", "k1", "{}", (200, True, None)), ("rules", "k2", None, (500, False, "x"))],
                                  "endpoint string, key string, payload string, "
                                  "result_state struct<status_code:int,success:boolean,error:string>")
    write_landing_batch(batch, 6, out)
    for _ in range(2):  # batch 7 is replayed after a failure
        write_landing_batch(batch, 7, out)
    assert spark.read.parquet(f"{out}/envelopes").count() == 2     # one row per batch id
    assert spark.read.parquet(f"{out}/rejects").count() == 2
