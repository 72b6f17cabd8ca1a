"""Datasets published whole (K6, K7): version folders and a manifest written last.

``root/version-<n>/<collection>`` holds a version's collections and
``root/_manifest/version-<n>`` one JSON row per collection. The manifest is
written only after every collection and counts only with Spark's ``_SUCCESS``
mark, so a publish that a lost driver left half way is never seen: readers stay
with the version before, and the next publish takes a new number. Versions are
never changed once written; one publisher at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "_manifest"


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match (none where nothing does), by the cluster's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath().toString()) for f in found or []]


def _number(folder: str) -> int:
    return int(folder.rsplit("version-", 1)[1])


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    done = glob_paths(spark, f"{root.rstrip('/')}/{MANIFEST}/version-*/_SUCCESS")
    return sorted(_number(p.removesuffix("/_SUCCESS")) for p in done)


def publish_version(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> int:
    """Write all ``tables`` as the next version of ``root``; returns its number. Tables may be computed from any earlier
    version, since none is overwritten."""
    if not tables:
        raise ValueError("a version needs at least one collection")
    root = root.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    begun = glob_paths(spark, f"{root}/version-*") + glob_paths(spark, f"{root}/{MANIFEST}/version-*")
    n = max((_number(p) for p in begun), default=0) + 1
    rows = []
    for name, df in tables.items():
        w = df.write.mode("errorifexists").format(fmt)
        (w.option("ignoreNullFields", "false") if fmt == "json" else w).save(f"{root}/version-{n:08d}/{name}")
        rows.append((name, fmt, df.schema.json()))
    (spark.createDataFrame(rows, "name string, format string, schema string").coalesce(1)
     .write.mode("errorifexists").json(f"{root}/{MANIFEST}/version-{n:08d}"))
    return n


def read_version(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The collections of a complete version, by default the last one."""
    root = root.rstrip("/")
    done = versions(spark, root)
    if not done or (version is not None and version not in done):
        raise ValueError(f"{root} has no complete version{'' if version is None else f' {version}'}")
    n = done[-1] if version is None else version
    rows = spark.read.schema("name string, format string, schema string").json(f"{root}/{MANIFEST}/version-{n:08d}").collect()
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).format(r["format"])
            .load(f"{root}/version-{n:08d}/{r['name']}") for r in rows}


def current_folders(spark: SparkSession, pattern: str) -> list[str]:
    """The last complete version's folder of every versioned dataset whose path matches ``pattern``."""
    last: dict[str, int] = {}
    for p in glob_paths(spark, f"{pattern.rstrip('/')}/{MANIFEST}/version-*/_SUCCESS"):
        root, number = p.removesuffix("/_SUCCESS").split(f"/{MANIFEST}/")
        last[root] = max(last.get(root, 0), _number(number))
    return [f"{root}/version-{n:08d}" for root, n in sorted(last.items())]
