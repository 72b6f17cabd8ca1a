"""Posts: row projection (P8, F7), text fallback (P9, P10, C7) and the
request plan (F4, F5, J6, U5, C11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumflow.functions.text import human_date, lt_gt_decode, strip_all
from forumflow.operators.dedup import keep_first

DELETED = "[deleted]"
# Fixed value: posts fetched per topic community (sample configuration).
DEFAULT_POSTS_PER_COMMUNITY = 10


def not_deleted(author: Column) -> Column:
    """missing author passes, '[deleted]' does not."""
    return F.coalesce(author, F.lit("")) != DELETED


def text_fallback(selftext: Column, selftext_html: Column, crossposts: Column) -> list[Column]:
    """P9 + P10: own text, else the first crosspost parent's, else ''.
    Own html gets only &lt; / &gt; decoded; the crosspost html stays raw."""
    first = F.get(crossposts, 0)
    own_txt = F.coalesce(selftext, F.lit(""))
    own_html = F.coalesce(selftext_html, F.lit(""))
    txt = F.when(own_txt != "", own_txt).otherwise(F.coalesce(first.getField("selftext"), F.lit("")))
    html = F.when(own_html != "", lt_gt_decode(own_html)).otherwise(
        F.coalesce(first.getField("selftext_html"), F.lit("")))
    return [txt.alias("text"), html.alias("text_html")]


def post_columns(d: Column) -> list[Column]:
    """The scalar post columns from a listing child's ``data``."""
    g = d.getField
    created = F.coalesce(g("created_utc"), F.lit(0.0))
    return [
        F.coalesce(g("id"), F.lit("")).alias("id"),
        F.coalesce(g("subreddit_name_prefixed"), F.lit("")).alias("community"),
        strip_all(F.coalesce(g("subreddit_id"), F.lit("")), "t5_").alias("community_id"),
        F.coalesce(g("title"), F.lit("")).alias("title"),
        F.coalesce(g("author"), F.lit("")).alias("author"),
        strip_all(F.coalesce(g("author_fullname"), F.lit("")), "t2_").alias("author_id"),
        g("author_flair_text").alias("author_flair_text"),
        g("link_flair_text").alias("link_flair_text"),
        F.coalesce(g("ups"), F.lit(0)).cast("bigint").alias("ups"),
        F.coalesce(g("num_comments"), F.lit(0)).cast("bigint").alias("num_comments"),
        created.cast("bigint").alias("created_utc"),
        F.when(created != 0, human_date(created.cast("bigint"))).otherwise(F.lit("")).alias("created_human"),
        *text_fallback(g("selftext"), g("selftext_html"), g("crosspost_parent_list")),
        F.coalesce(g("over_18"), F.lit(False)).alias("over_18"),
        F.coalesce(g("spoiler"), F.lit(False)).alias("spoiler"),
    ]


def request_plan(on_demand: DataFrame, topic_communities: DataFrame,
                 default_limit: int = DEFAULT_POSTS_PER_COMMUNITY) -> DataFrame:
    """F4 + F5 + J6 + U5 + C11.

    on_demand: (title, posts_count, ord); topic_communities: (title, ord).
    Requests are seen in order - on-demand first, then topic communities -
    and a title is claimed case-insensitively by its *first* occurrence,
    before the validity test: an invalid on-demand row (blank title or zero
    posts_count) still blocks a later row of the same title.
    Output: (title, post_limit, source).
    """
    od = on_demand.select(F.coalesce(F.col("title"), F.lit("")).alias("title"),
                          F.coalesce(F.col("posts_count"), F.lit(0)).cast("bigint").alias("post_limit"),
                          F.col("ord").cast("bigint").alias("ord"), F.lit(0).alias("__src"))
    tc = topic_communities.select(F.coalesce(F.col("title"), F.lit("")).alias("title"),
                                  F.lit(default_limit).cast("bigint").alias("post_limit"),
                                  F.col("ord").cast("bigint").alias("ord"), F.lit(1).alias("__src"))
    claimed = keep_first(od.unionByName(tc), [F.lower(F.col("title"))], ["__src", "ord", "title"])
    valid = (F.col("__src") == 1) | ((F.col("title") != "") & (F.col("post_limit") != 0))
    return (claimed.where(valid)
            .select("title", "post_limit",
                    F.when(F.col("__src") == 0, F.lit("on_demand")).otherwise(F.lit("topic")).alias("source")))
