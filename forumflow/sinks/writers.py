"""Sinks (K1-K8).

* ``write_by_topic`` - communities grouped by topic as a partitioned
  dataset (one directory per topic, sorted within partitions).
* ``write_table`` - arrays of entities (posts, users, awards, trophies) as
  Parquet or JSON lines; JSON keeps NULL fields like the original output.
* ``write_topic_map`` - an extracted topic map, one heading per line.
* ``write_collections`` - one dataset directory per collection.
* ``stage_then_publish`` - K6: never read and overwrite one path in one
  plan; write to a new staged path and, given a target, publish it there.
* ``publish_collections`` - the same for all collections of a dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forumflow.session import staging_path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partitions: int | None = None) -> None:
    w = (df.repartition(partitions) if partitions else df).write.mode("overwrite")
    if fmt == "json":
        w = w.option("ignoreNullFields", "false")
    w.format(fmt).save(path)


def write_by_topic(df: DataFrame, path: str, topic_col: str = "topic", order_col: str = "title",
                   fmt: str = "parquet") -> None:
    """K1 / O2 / K8: one directory per topic; rows sorted inside files.

    Range partitioning on (topic, order) keeps each task's rows contiguous
    and sorted, while a hot topic is split over several tasks instead of
    landing in one (hash partitioning on the topic alone would)."""
    w = (df.repartitionByRange(topic_col, order_col).sortWithinPartitions(topic_col, order_col)
         .write.mode("overwrite").partitionBy(topic_col))
    if fmt == "json":
        w = w.option("ignoreNullFields", "false")
    w.format(fmt).save(path)


def write_topic_map(sections: DataFrame, path: str, section: str = "section", items: str = "items") -> None:
    """K8: an extracted topic map, one object ``{heading: [topic, ...]}`` per line, so it is written and read in parts
    (``sources.landed.read_topic_lines``). Rows without a heading are left out; no items are an empty list."""
    kept = sections.where(F.col(section).isNotNull())
    line = F.to_json(F.create_map(F.col(section), F.coalesce(F.col(items), F.array().cast("array<string>"))))
    kept.select(line.alias("value")).write.mode("overwrite").text(path)


def write_collections(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """K7 re-aimed: each collection is its own dataset directory (overwrite)."""
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", fmt)


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once below the shared folder and read back, with its own schema."""
    path = staging_path(df.sparkSession, name)
    w = df.write.partitionBy(partition_by) if partition_by else df.write
    w.parquet(path)
    fields = [f for f in df.schema.fields if f.name != partition_by] + [f for f in df.schema.fields if f.name == partition_by]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path).select(*[f"`{c}`" for c in df.columns])


def stage_then_publish(df: DataFrame, name: str, fmt: str = "parquet", target: str | None = None) -> str:
    """K6: write to a fresh path under the shared folder; with ``target`` the
    staged rows then replace what is there. Returns where the rows are."""
    path = staging_path(df.sparkSession, name)
    write_table(df, path, fmt)
    if target is None:
        return path
    write_table(df.sparkSession.read.schema(df.schema).format(fmt).load(path), target, fmt)
    return target


def publish_collections(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """K6 for a dataset: every collection is staged before the first is
    published, so collections may be computed from what ``root`` holds."""
    done = {name: staged(df, name) for name, df in tables.items()}
    write_collections(done, root, fmt)
    return done
