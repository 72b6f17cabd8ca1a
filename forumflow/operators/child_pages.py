"""Ordered child lists of any length as bounded records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumflow.operators.dedup import rank_in_groups


def child_pages(child: DataFrame, child_key: str, order: Sequence[str], fields: Sequence[str], page_rows: int = 1000,
                out_col: str = "items") -> DataFrame:
    """J3 in pages: (key, page, items), each page an ordered array of at most
    ``page_rows`` child structs; pages count from 0 and only a key's last one
    is short. A parent with any number of children is many bounded records:
    children are numbered by ``rank_in_groups`` and grouped by (key, page).
    Children without a key give no page."""
    if page_rows < 1:
        raise ValueError(f"page_rows must be positive, got {page_rows}")
    cols = list(dict.fromkeys([child_key, *order, *fields]))
    ranked = rank_in_groups(child.where(F.col(child_key).isNotNull()).select(*cols), child_key, list(order), "__rn")
    page = F.floor((F.col("__rn") - 1) / page_rows).cast("bigint")
    item = F.struct(F.col("__rn"), F.struct(*[F.col(f) for f in fields]).alias("v"))
    return (ranked.groupBy(child_key, page.alias("page")).agg(F.array_sort(F.collect_list(item)).alias("__items"))
            .withColumn(out_col, F.transform("__items", lambda x: x.getField("v"))).drop("__items"))
