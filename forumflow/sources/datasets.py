"""Multi-dataset scan.

``root/<dataset>/<kind…>/part-*`` - every entry two levels below ``root``
whose name contains the kind, case-insensitively, is read in one scan (a
Hadoop glob with per-letter character classes; no driver listing loop). The
first-wins order is the file path, then the row position inside the file
(``_metadata.row_index``), both carried as columns. A dataset published in
versions (``sinks.versions``) gives its last complete one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumflow.sinks.versions import current_folders, glob_paths


def _ci_glob(word: str) -> str:
    out = []
    for ch in word:
        if ch.isalpha():
            out.append(f"[{ch.lower()}{ch.upper()}]")
        elif ch in "[]{}*?\\":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def read_datasets(spark: SparkSession, root: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """Rows of every dataset of ``kind`` below ``root`` with ``from_set``
    (the dataset directory), ``src_file`` and ``src_row`` (first-wins order).

    Parquet gives the row position in the file (``_metadata.row_index``).
    For other formats the position is (start of the file split, row id):
    a split's rows are read in order by one task, so the pair orders rows
    within a file without a global numbering."""
    name = f"*{_ci_glob(kind)}*"
    path = [f"{root.rstrip('/')}/*/{name}"]
    versioned = [f"{folder}/{name}" for folder in current_folders(spark, f"{root.rstrip('/')}/*")]
    versioned = [p for p in versioned if glob_paths(spark, p)]
    if versioned:
        path = [p for p in path if glob_paths(spark, p)] + versioned
    # datasets may differ in columns: the union of all of them, absent ones NULL
    reader = spark.read.format(fmt)
    df = (reader.option("mergeSchema", "true") if fmt == "parquet" else reader).load(path)
    meta = F.col("_metadata")
    cols = [F.col(c) for c in df.columns]
    if fmt == "parquet":
        pos = meta.getField("row_index")
    else:
        pos = F.struct(meta.getField("file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("row"))
    return df.select(*cols,
                     F.regexp_extract(meta.getField("file_path"), r"/([^/]+)(?:/version-\d+)?/[^/]+/[^/]+$", 1).alias("from_set"),
                     meta.getField("file_path").alias("src_file"),
                     pos.alias("src_row"))
