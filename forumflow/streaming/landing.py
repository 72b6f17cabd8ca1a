"""Incremental landing of response envelopes with Structured Streaming.

The original tool is one batch pass; at scale, clients land envelope JSON
lines continuously. ``start_landing`` reads them as a file stream, splits
good payloads from rejects (F6) and writes both to Parquet tables, with the
stream's progress in a checkpoint folder below the shared directory, so a
restarted or relocated driver resumes exactly where it stopped. Each
micro-batch is plain DataFrame work (no state), so executors can be lost at
any time: the batch is re-run from its recorded offsets. Writes are
idempotent per batch - each batch owns its ``batch_id`` partition and a
replay overwrites it (dynamic partition overwrite) instead of appending a
second copy.

``current_landing`` is the keyed view of what has landed: the last good response
per (endpoint, key) over all batches.

``landing_health`` keeps a running (endpoint, ok) count as a stateful
streaming aggregate for monitoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from forumflow.session import shared_dir
from forumflow.sources.landed import ENVELOPE, envelope_ok, envelope_state, last_per_key, rejects


def read_landing_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Envelopes with their file and its block; a line that is no envelope keeps its text in ``_corrupt_record``."""
    schema = StructType(ENVELOPE.fields + [StructField("_corrupt_record", StringType())])
    stream = (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record")
              .option("maxFilesPerTrigger", max_files_per_trigger).json(path))
    return stream.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def write_landing_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """One micro-batch: envelopes with a payload to ``out/envelopes`` (by batch
    and endpoint, with the state of the payload), failures to ``out/rejects``; a replayed batch id overwrites
    its own partitions only. The batch is read once for both."""
    for name, kind in (("file", "string"), ("block", "bigint")):
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(None).cast(kind))
    place = F.struct("file", "block", F.monotonically_increasing_id().alias("row"))
    placed = batch.withColumn("place", place).withColumn("state", envelope_state(batch)).drop("file", "block").persist()
    landed = placed.where("state <> 'none'").select(*ENVELOPE.fieldNames(), "place", "state")
    for df, sub, parts in ((landed, "envelopes", ["batch_id", "endpoint"]),
                           (rejects(placed.where("state = 'none'")), "rejects", ["batch_id"])):
        (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{out}/{sub}"))
    placed.unpersist()


def current_landing(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(envelopes, rejects) over all batches landed so far: payloads that do not
    parse go to the rejects, and of several good
    responses for one (endpoint, key) the last one, in the order of file path
    and position, whatever the batch that brought it. The same rows as one batch
    read of the files gives (``plans.build.stage_landed``)."""
    place = StructType([StructField("file", StringType()), StructField("block", LongType()), StructField("row", LongType())])
    # the endpoint is a folder name: text, never a number or a date
    schema = StructType([*ENVELOPE.fields, StructField("place", place), StructField("state", StringType())])
    env = spark.read.schema(schema).parquet(f"{out}/envelopes").select(*ENVELOPE.fieldNames(), "place", "state")
    good = last_per_key(env.where("state = 'ok'")).drop("place", "state")
    failed = "endpoint string, key string, status_code int, error string"
    return good, spark.read.schema(failed).parquet(f"{out}/rejects").select(
        "endpoint", "key", "status_code", "error").unionByName(rejects(env))


def start_landing(spark: SparkSession, landing: str, out: str, name: str = "landing",
                  trigger_available_now: bool = False) -> StreamingQuery:
    """Land good envelopes in ``out/envelopes`` and failures in ``out/rejects``."""
    ckpt = f"{shared_dir(spark).rstrip('/')}/streams/{name}"
    w = (read_landing_stream(spark, landing).writeStream
         .foreachBatch(lambda batch, batch_id: write_landing_batch(batch, batch_id, out))
         .option("checkpointLocation", ckpt).queryName(name))
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def landing_health(spark: SparkSession, landing: str, name: str = "landing_health",
                   trigger_available_now: bool = False) -> StreamingQuery:
    """Running (endpoint, ok, n) counts into an in-memory table ``name``."""
    ckpt = f"{shared_dir(spark).rstrip('/')}/streams/{name}"
    stream = read_landing_stream(spark, landing)
    counts = stream.groupBy("endpoint", envelope_ok(stream).alias("ok")).agg(F.count(F.lit(1)).alias("n"))
    w = (counts.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="30 seconds")
    return w.start()
