"""Helpers shared by the text operators."""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import forumflow
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumflow.session import staging_path

#: Bytes of a word after lower-casing: digits, a-z and everything beyond ASCII.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else
               b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
               for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def word_bytes(text: bytes) -> bytes:
    """The text with A-Z lower-cased and every non-word byte blanked; offsets stay."""
    return text.translate(_TABLE)


def id_crc32(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this library: adds it to the application once, as a zip file."""
    sc, home = spark.sparkContext, Path(forumflow.__file__).parent
    if sc.applicationId in _shipped or not home.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="forumflow-")) / "forumflow.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without nulls in text; any other column is left behind."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: cuts the lineage."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def small_side(df: DataFrame, row_bytes: int = 32, limit: int = 24 << 20) -> DataFrame:
    """A written table as a join side: broadcast if its rows take ``limit`` bytes at most, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def salted_left_join(rows: DataFrame, side: DataFrame, key: str, row_bytes: int = 32, limit: int = 24 << 20, salts: int = 64) -> DataFrame:
    """Left join with a written table of one row per ``key``: broadcast within the limit, else with the side's
    rows repeated per salt, so that a hot key of ``rows`` is dealt to many tasks."""
    if side.count() * row_bytes <= limit:
        return rows.join(F.broadcast(side), key, "left")
    side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return rows.join(side, [key, "_salt"], "left").drop("_salt")


def drop_staged(df: DataFrame) -> None:
    """Delete a table that ``staged`` returned and that is not read any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores until no frame has such a column in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text; a null text counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def drop_texts(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows whose text's digest is not in the written one-column table ``bad``; ids play no part."""
    name = free_name("_bad", docs)
    return docs.join(small_side(bad.toDF(name), row_bytes=96), text_digest() == F.col(name), "left_anti")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, which bounds what a task holds as Python objects."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        part = np.cumsum(size) // limit
        starts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), batch.num_rows] if len(size) else []
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def blocks_for(total_bytes: int | None, limit: int) -> int:
    return max(1, math.ceil((total_bytes or 0) / limit))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
