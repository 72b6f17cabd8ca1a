"""Membership: member references (P12, F8), distinct member sets (G2, U3),
the members join (J1, J2, J7, U4, W1) and the users table (G7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumflow.functions.text import is_nonblank, strip_all
from forumflow.operators.dedup import keep_first


def member_refs(df: DataFrame, community_id: str, user_id: str, name: str,
                keep: list[str] | None = None) -> DataFrame:
    """P12 + F8: (community_id, user_id, name, *keep) with ``t2_`` stripped;
    rows without a usable name and id are dropped."""
    uid = strip_all(F.coalesce(F.col(user_id), F.lit("")), "t2_")
    nm = F.coalesce(F.col(name), F.lit(""))
    return (df.select(F.col(community_id).alias("community_id"), uid.alias("user_id"), nm.alias("name"),
                      *(keep or []))
            .where(is_nonblank("user_id") & is_nonblank("name")))


def member_set(*refs: DataFrame) -> DataFrame:
    """G2 + U3: the distinct union of member references (set semantics).
    Distinct is a hash aggregate with map-side combine."""
    out = refs[0]
    for r in refs[1:]:
        out = out.unionByName(r)
    return out.distinct()


def join_members(communities: DataFrame, moderators: DataFrame, observed: DataFrame,
                 community_key: str = "community_id") -> DataFrame:
    """J1 + J2 + J7 + U4 + W1.

    Per community: moderators first, then observed users; one entry per
    *name*, the first one wins (moderator over member, then list order).
    An observed user goes by the name of the known user of that id (J2): the
    last moderator entry, else the first observation, by community and order.
    Moderators and observed users of unknown communities are dropped (J1).
    Inputs: moderators/observed (community_id, user_id, name, ord).
    Output: (community_id, user_id, name, is_moderator).
    """
    known = communities.select(F.col(community_key).alias("community_id")).distinct()
    mods = moderators.select("community_id", "user_id", "name", "ord").withColumn("__prio", F.lit(0))
    mods = mods.join(known, "community_id", "left_semi")
    seen = (observed.select("community_id", "user_id", "name", "ord")
            .join(known, "community_id", "left_semi"))
    place = F.struct("community_id", "ord", "name")
    names = (mods.groupBy("user_id").agg(F.max(place).alias("__m")).join(
        seen.groupBy("user_id").agg(F.min(place).alias("__s")), "user_id", "full")
        .select("user_id", F.coalesce("__m.name", "__s.name").alias("__name")))
    seen = (seen.join(names, "user_id").withColumn("name", F.col("__name")).drop("__name")
            .select("community_id", "user_id", "name", "ord").withColumn("__prio", F.lit(1)))
    both = mods.unionByName(seen)
    first = keep_first(both, ["community_id", "name"], ["__prio", "ord", "user_id"])
    return first.select("community_id", "user_id", "name", (F.col("__prio") == 0).alias("is_moderator"))


def users_table(moderators: DataFrame, members: DataFrame, order: str) -> DataFrame:
    """One row per user id over moderators and members.

    A moderator row always wins over a member row; among moderators the
    *last* one in ``order`` wins (a later row overwrites, W2); among members
    the first one wins (it is created once, then reused, J2).
    """
    mods = moderators.withColumn("__prio", F.lit(0))
    mems = members.withColumn("__prio", F.lit(1))
    both = mods.unionByName(mems)
    last_mod = F.when(F.col("__prio") == 0, F.col(order)).desc_nulls_last()
    first_mem = F.when(F.col("__prio") == 1, F.col(order)).asc_nulls_last()
    out = keep_first(both, ["user_id"], [F.col("__prio").asc(), last_mod, first_mem])
    return (out.withColumn("source", F.when(F.col("__prio") == 0, F.lit("moderator")).otherwise(F.lit("member")))
            .drop("__prio"))

