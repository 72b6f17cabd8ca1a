"""Keep-first / keep-last per key (W1, W2, G6), whole-row distinct (G5) and
exact positional operators (K5, G8, W6).

Keep-first is ``row_number() = 1`` over (key, order). Catalyst turns the
filter into a ``WindowGroupLimit``: a *partial* limit runs before the
shuffle, so a hot key (even a third of all rows) sends at most one row per
map partition across the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from forumflow.operators.joins import PART_BYTES, broadcast_if_small, measure, parts_for
from forumflow.session import cut_lineage

_RN = "__rn"


def _cols(xs) -> list[Column]:
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _order(xs, descending: bool) -> list[Column]:
    """Names sort ascending (or descending); Column items are used as given,
    so callers may pass ``F.col(x).desc()`` for mixed directions."""
    if isinstance(xs, (str, Column)):
        xs = [xs]
    out = []
    for x in xs:
        if isinstance(x, str):
            out.append(F.col(x).desc() if descending else F.col(x).asc())
        else:
            out.append(x)
    return out


def keep_first(df: DataFrame, keys, order, descending: bool = False) -> DataFrame:
    """One row per key: the first by ``order`` (W1). ``descending`` gives W2."""
    order_cols = _order(order, descending)
    w = Window.partitionBy(*_cols(keys)).orderBy(*order_cols)
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)


def keep_first_by_size(df: DataFrame, keys: Sequence[str], order: Sequence[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """``keep_first`` whose tasks sort about ``part_bytes`` of values each, whatever the input's files and size.

    Rows are dealt evenly and the first of each key in a deal is kept, so a hot key leaves a row per deal; these rows
    are then dealt by key. Small inputs go the plain way."""
    n = parts_for(measure(df)[1], part_bytes)
    if n == 1:
        return keep_first(df, keys, order)
    deals = df.withColumn("__deal", F.pmod(F.monotonically_increasing_id(), F.lit(16 * n))).repartition(n, "__deal")
    once = keep_first(deals, ["__deal", *keys], order).drop("__deal")
    return keep_first(once.repartition(n, *keys), keys, order)


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """A later row overwrites an earlier one with the same key."""
    return keep_first(df, keys, order, descending=True)


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Whole-row distinct. Columns that hold maps, at any depth, are compared
    in a canonical form, where the order of a map's entries does not count, and
    one representative is kept."""
    if cols is not None:
        df = df.select(*cols)
    map_cols = [f for f in df.schema.fields if _has_map(f.dataType)]
    if not map_cols:
        return df.distinct()
    keyed, names = df, []
    for n, f in enumerate(map_cols):
        names.append(f"__canonical_{n}")
        keyed = keyed.withColumn(names[-1], _canonical(F.col(f"`{f.name}`"), f.dataType))
    held = {f.name for f in map_cols}
    return keyed.dropDuplicates([c for c in df.columns if c not in held] + names).drop(*names)


def _has_map(t: DataType) -> bool:
    if isinstance(t, MapType):
        return True
    if isinstance(t, ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, StructType) and any(_has_map(f.dataType) for f in t.fields)


def _canonical(c: Column, t: DataType) -> Column:
    """``c`` with every map as its entries sorted by key; NULL stays NULL."""
    if not _has_map(t):
        return c
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _canonical(x, t.elementType))
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[_canonical(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
    entry = lambda e: F.struct(_canonical(e["key"], t.keyType).alias("key"), _canonical(e["value"], t.valueType).alias("value"))
    return F.sort_array(F.transform(F.map_entries(c), entry))


def positional_index(df: DataFrame, order, index_col: str = "pos", partitions: int | None = None) -> DataFrame:
    """Exact 0-based position of every row in ``order`` without a global
    single-partition window.

    Range-partition on the order, sort within partitions, read the
    per-partition row number from ``monotonically_increasing_id`` (partition
    id in the upper 31 bits, row number in the lower 33), then add each
    partition's offset. The offsets table has one row per partition (a proven
    bound), so it is broadcast. The ordered frame is checkpointed once so the
    count and the final read see the same partitioning. ``order`` should be
    unique (add a tiebreaker) for the result to be deterministic.
    """
    oc = _cols(order)
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n_parts, *oc).sortWithinPartitions(*oc)
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    ranged = (ranged.withColumn("__pid", F.shiftright(F.col("__mid"), 33))
              .withColumn("__local", F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn(
        "__off",
        F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)),
    ).select("__pid", "__off")
    return (ranged.join(F.broadcast(offsets), "__pid")
            .withColumn(index_col, (F.col("__off") + F.col("__local")).cast("bigint"))
            .drop("__mid", "__pid", "__local", "__off"))


def split_by_position(df: DataFrame, order, part_col: str = "part") -> DataFrame:
    """K5: part 1 = rows at 0-based position <= n // 2 (n // 2 + 1 rows),
    part 2 = the rest. Not ``ntile(2)``: n = 4 gives 3 / 1 here."""
    indexed = positional_index(df, order, "__pos")
    n = indexed.count()
    half = n // 2
    return indexed.withColumn(part_col, F.when(F.col("__pos") <= half, 1).otherwise(2)).drop("__pos")


def partial_limit_max(df: DataFrame) -> int:
    """The largest literal k for which Spark limits a window before its shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def rank_in_groups(df: DataFrame, groups, order, rank_col: str = "rn") -> DataFrame:
    """1-based position of every row within its group, as ``row_number`` gives,
    without any task holding a whole group.

    Rows are range-partitioned on (groups, order), so a hot group is cut into
    many partitions, and sorted there; a group's rows follow one another in a
    partition. One row per (partition, group) keeps the first row number and
    the count; there are at most partitions + groups of them, so their running
    sum is a small window, and they are joined back by size. ``order`` should
    be unique within a group; NULL groups are groups of their own."""
    gs, oc = ([groups] if isinstance(groups, str) else list(groups)), _cols(order)
    ranged = cut_lineage(df.repartitionByRange(*[F.col(g) for g in gs], *oc).sortWithinPartitions(*gs, *oc)
                         .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__pid", F.shiftright(F.col("__mid"), 33))
    starts = ranged.groupBy("__pid", *gs).agg(F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*gs).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("__pid").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(gs)],
                           (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    on = F.col("__pid") == F.col("__p")
    for i, g in enumerate(gs):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return (ranged.join(broadcast_if_small(starts), on)
            .withColumn(rank_col, F.col("__mid") + F.col("__shift"))
            .drop("__mid", "__pid", "__p", "__shift", *[f"__g{i}" for i in range(len(gs))]))
