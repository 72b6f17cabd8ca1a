"""Session construction and shared-folder helpers.

Iterative operators (capped assignment, thread level loops, positional
index) cut lineage with reliable ``checkpoint()``; the folder comes from the
cluster's ``spark.checkpoint.dir``. A folder of our own is only created when
that setting is missing *and* the master is local (tests, laptops).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "forumflow", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    pin_utc(spark)
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Date text (C1/C2) is defined in UTC; make it independent of the host."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged datasets.

    Order: a directory already set on the SparkContext, then the
    ``spark.checkpoint.dir`` setting; only a local master may fall back to a
    fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; iterative operators need it")
    local = tempfile.mkdtemp(prefix="forumflow-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder (never overwritten)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/staged/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

