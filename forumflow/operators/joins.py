"""Join helpers: broadcast only behind a size check, partitions by measured
size, pre-aggregated child attachment (J3)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# bytes of values; a dimension side above this is joined with a shuffle instead
BROADCAST_MAX_BYTES = 64 << 20
# bytes of values in a partition of ``dealt``; sorts and hash tables over it take a few times as much
PART_BYTES = 32 << 20
# bytes that a row and each of its fields take beside the text
ROW_BYTES, FIELD_BYTES = 16, 8


def row_bytes(df: DataFrame) -> Column:
    """Estimated size of a row: its fields, and the length of text and nested values."""
    size = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        size = size + F.lit(FIELD_BYTES)
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, estimated bytes) of ``df`` by one aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df).cast("bigint")).alias("size")).first()
    return r["n"], r["size"] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its rows take at most ``max_bytes``.

    The check scans the side once (it is a dimension, i.e. small or
    pre-aggregated); above the bound the plain frame is returned and
    Catalyst/AQE choose a shuffle join.
    """
    return F.broadcast(df) if measure(df)[1] <= max_bytes else df


def parts_for(size: int, part_bytes: int = PART_BYTES) -> int:
    return max(1, math.ceil(size / part_bytes))


def dealt(df: DataFrame, *keys: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` hashed by ``keys`` into partitions of about ``part_bytes`` of values, whatever its size; as it is if that
    is one.

    Adaptive execution merges the partitions of its own shuffles by their compressed bytes, so a task's sorts and hash
    tables grow with the input up to many times that; a number given here stays."""
    n = parts_for(measure(df)[1], part_bytes)
    return df.repartition(n, *[F.col(k) for k in keys]) if n > 1 else df


def attach_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
                    order: Sequence[str], fields: Sequence[str], out_col: str) -> DataFrame:
    """Per-parent array of child structs in ``order``, ``[]`` when none.

    The child table is aggregated to one row per key *before* the join
    (collect_list is per key; its size is the number of children of one
    parent, e.g. rules or flairs of one community). The join is a left join
    on the key as given.
    """
    packed = (child.groupBy(F.col(child_key).alias("__k"))
              .agg(F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order],
                                                        *[F.col(f) for f in fields]))).alias("__arr")))
    elem = lambda x: F.struct(*[x.getField(f).alias(f) for f in fields])
    empty = F.array().cast(packed.schema["__arr"].dataType)
    joined = parent.join(packed, F.col(parent_key) == F.col("__k"), "left")
    return (joined.withColumn(out_col, F.transform(F.coalesce(F.col("__arr"), empty), elem))
            .drop("__k", "__arr"))
