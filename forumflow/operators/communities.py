"""Communities: row projection (P1-P4, C1, C4, C5), eligibility (F1, F2),
child rows (P5 rules, P6 flairs, P7 moderators) and grouping by topic (G1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumflow.functions.text import human_count, human_date, strip_all
from forumflow.functions.urls import clean_url

# Fixed value: default banner background color when the field is missing.
DEFAULT_BANNER_COLOR = "#000000"


def community_columns(src: Column, title: Column | None = None, topic: Column | None = None) -> list[Column]:
    """One projection for the about payload (``data``) and the search
    child (``sr_detail``, title from the child). Returns the output columns."""
    g = src.getField
    ttl = title if title is not None else F.coalesce(g("display_name_prefixed"), F.lit(""))
    banners = F.transform(F.array(g("banner_img"), g("banner_background_image")), clean_url)
    banner = F.coalesce(F.get(F.filter(banners, lambda u: u != ""), F.lit(0)), F.lit(""))
    created = F.coalesce(g("created_utc"), F.lit(0.0))
    subs = F.coalesce(g("subscribers"), F.lit(0)).cast("bigint")
    cols = [
        strip_all(F.coalesce(g("name"), F.lit("")), "t5_").alias("id"),
        ttl.alias("title"),
        F.coalesce(g("public_description"), F.lit("")).alias("public_description"),
        clean_url(g("community_icon")).alias("community_icon"),
        banner.alias("banner_background_image"),
        g("key_color").alias("key_color"),
        g("primary_color").alias("primary_color"),
        F.coalesce(g("banner_background_color"), F.lit(DEFAULT_BANNER_COLOR)).alias("banner_background_color"),
        created.cast("bigint").alias("created_utc"),
        F.when(created != 0, human_date(created.cast("bigint"))).otherwise(F.lit("")).alias("created_human"),
        subs.alias("subscribers"),
        human_count(subs).alias("subscribers_human"),
        F.coalesce(g("over18"), F.lit(False)).alias("over18"),
        F.coalesce(g("spoilers_enabled"), F.lit(False)).alias("spoilers_enabled"),
    ]
    if topic is not None:
        cols.append(topic.alias("topic"))
    return cols


def eligible(community_type: Column, title: Column) -> Column:
    """F1 + F2: not private and not a user page ('u/' anywhere in the title)."""
    return ((F.coalesce(community_type, F.lit("")) != "private")
            & (F.instr(F.coalesce(title, F.lit("")), "u/") == 0))


def flair_rows(flairs: Column) -> Column:
    """Rich-text parts mapped by tag (text -> {text}, emoji -> {text, url}),
    other tags dropped; rich_text and full_text are NULL when empty."""
    def part(r):
        e = F.coalesce(r.getField("e"), F.lit(""))
        return F.when(e == "text", F.struct(F.coalesce(r.getField("t"), F.lit("")).alias("text"),
                                            F.lit(None).cast("string").alias("url")))\
            .when(e == "emoji", F.struct(F.coalesce(r.getField("a"), F.lit("")).alias("text"),
                                         F.coalesce(r.getField("u"), F.lit("")).alias("url")))

    def one(f):
        parts = F.filter(F.transform(F.coalesce(f.getField("richtext"), F.array()), part), lambda x: x.isNotNull())
        return F.struct(
            F.when(F.size(parts) > 0, parts).alias("rich_text"),
            F.when(F.coalesce(f.getField("text"), F.lit("")) != "", f.getField("text")).alias("full_text"),
            F.coalesce(f.getField("background_color"), F.lit("")).alias("background_color"),
        )
    return F.transform(flairs, one)


def group_by_key(df: DataFrame, key: str, order: str, fields: list[str], out_col: str) -> DataFrame:
    """G1: one row per key with the items in ``order``.

    The list length is bounded by the per-topic cap of the capped assignment,
    so the group is bounded; a partial aggregate runs before the shuffle.
    """
    return (df.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *[F.col(f) for f in fields])))
                 .alias("__items"))
            .select(key, F.transform("__items", lambda x: F.struct(*[x.getField(f).alias(f) for f in fields]))
                    .alias(out_col)))
