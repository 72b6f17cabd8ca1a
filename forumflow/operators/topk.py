"""Top-k posts per requested community, k from the
request row.

A per-row ``k`` cannot feed Catalyst's ``WindowGroupLimit`` (it needs a
literal), so the operator runs in two steps over one shuffle: first a
literal cap ``k_max`` (the largest requested k, one scalar aggregate) gives
a *partial* limit before the shuffle - a hot community ships at most
``k_max`` rows per map partition - then the per-row ``rn <= k`` filter.

Spark plans that limit only up to a threshold (1,000 by default). Beyond it
rows get their rank from ``rank_in_groups``, which cuts a hot community into
many sorted ranges, so no task sorts it whole. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumflow.operators.dedup import partial_limit_max, rank_in_groups
from forumflow.operators.joins import broadcast_if_small

# Sort names understood for landed listings.
SORTS = ("landed", "new", "top")


def sort_order(sort: str, position: str = "pos", created: str = "created_utc", ups: str = "ups",
               tie: str = "id") -> list[Column]:
    """O6 re-aimed: landed order, newest first, or most up-votes first; id breaks ties."""
    if sort == "landed":
        return [F.col(position).asc(), F.col(tie).asc()]
    if sort == "new":
        return [F.col(created).desc(), F.col(tie).asc()]
    if sort == "top":
        return [F.col(ups).desc(), F.col(tie).asc()]
    raise ValueError(f"unknown sort {sort!r}; expected one of {SORTS}")


def top_k_per_group(posts: DataFrame, requests: DataFrame, group: str, limit_col: str,
                    order: list[Column], rn_col: str = "rn") -> DataFrame:
    """Join posts to the request rows (J5) and keep the first ``limit`` per group."""
    k_max = requests.agg(F.max(limit_col)).first()[0] or 0
    reqs = broadcast_if_small(requests.select(group, limit_col))
    asked = posts.join(reqs, group)
    if k_max > partial_limit_max(posts):
        ranked = rank_in_groups(asked, group, order, rn_col)
    else:
        ranked = (asked.withColumn(rn_col, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
                  .where(F.col(rn_col) <= F.lit(int(k_max))))
    return ranked.where(F.col(rn_col) <= F.col(limit_col)).drop(limit_col)
