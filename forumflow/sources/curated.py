"""Read finished datasets in the original tool's JSON layout, so
existing outputs can be merged, split or analysed with the same operators.

* ``subreddits.json`` (communities) - one JSON object per file mapping topic
  -> list of communities; ``read_communities_map`` explodes it to one row
  per community with its topic.
* ``posts.json``, ``users.json``, ``awards.json``, ``trophies.json`` - one
  top-level JSON array per file; ``read_curated_array`` makes it rows.
* ``topics.json`` - the topic map; see ``sources.landed.read_topics``.

Arrays are read by byte ranges (``sources.json_arrays``), so a large file
spreads over tasks; the maps are one record per file. Nested comments stay JSON text
(``comments``) and are flattened by ``flatten_curated_comments``; the media
union stays JSON text (``media_content``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, MapType, StringType,
                               StructField, StructType)

from forumflow.sources.json_arrays import array_records

TROPHY = StructType([StructField("title", StringType()), StructField("description", StringType()),
                     StructField("image_link", StringType())])
AWARD = StructType([StructField("title", StringType()), StructField("image_link", StringType())])
USER = StructType([StructField(n, StringType()) for n in (
    "id", "name", "cake_day_human", "age", "avatar_img", "banner_img", "public_description", "keycolor",
    "primarycolor", "iconcolor")] + [
    StructField("cake_day_utc", LongType()), StructField("over18", BooleanType()),
    StructField("suspended", BooleanType()), StructField("trophies", ArrayType(TROPHY))])
RULE = StructType([StructField("short_name", StringType()), StructField("description", StringType())])
FLAIR = StructType([
    StructField("rich_text", ArrayType(StructType([StructField("text", StringType()),
                                                   StructField("url", StringType())]))),
    StructField("full_text", StringType()), StructField("background_color", StringType())])
COMMUNITY = StructType([StructField(n, StringType()) for n in (
    "id", "title", "public_description", "community_icon", "banner_background_image", "topic", "key_color",
    "primary_color", "banner_background_color", "created_human", "subscribers_human")] + [
    StructField("created_utc", DoubleType()), StructField("subscribers", LongType()),
    StructField("over18", BooleanType()), StructField("spoilers_enabled", BooleanType()),
    StructField("rules", ArrayType(RULE)), StructField("flairs", ArrayType(FLAIR)),
    StructField("user_flairs", ArrayType(FLAIR)), StructField("members", ArrayType(USER)),
    StructField("moderators", ArrayType(USER))])
POST = StructType([StructField(n, StringType()) for n in (
    "id", "subreddit", "subreddit_id", "title", "author", "author_fullname", "author_flair_text",
    "link_flair_text", "created_human", "text", "text_html")] + [
    StructField("ups", LongType()), StructField("num_comments", LongType()),
    StructField("created_utc", DoubleType()), StructField("over_18", BooleanType()),
    StructField("spoiler", BooleanType()), StructField("awards", ArrayType(AWARD)),
    # recursive / union shapes stay JSON text
    StructField("comments", StringType()), StructField("media_content", StringType())])

ARRAY_SCHEMAS = {"posts": POST, "users": USER, "awards": AWARD, "trophies": TROPHY}


def read_communities_map(spark: SparkSession, path: str) -> DataFrame:
    """``{topic: [community, ...]}`` files -> one row per community, with
    ``topic`` taken from the map key, ``topic_pos`` the key's position in
    the file (map order is kept) and ``ord`` the position in its list."""
    m = F.from_json(F.col("value"), MapType(StringType(), ArrayType(COMMUNITY)))
    return (spark.read.text(path, wholetext=True)
            .select(F.posexplode(m).alias("topic_pos", "__topic", "__list"))
            .select("topic_pos", "__topic", F.posexplode("__list").alias("ord", "__c"))
            .select("__c.*", F.col("__topic").alias("__map_topic"), F.col("topic_pos").cast("bigint").alias("topic_pos"),
                    F.col("ord").cast("bigint").alias("ord"))
            .withColumn("topic", F.coalesce(F.col("topic"), F.col("__map_topic"))).drop("__map_topic"))


def read_curated_array(spark: SparkSession, path: str, kind: str, place: bool = False) -> DataFrame:
    """A top-level JSON array of ``kind`` (posts, users, awards, trophies); with ``place`` also ``__file`` and
    ``__pos``, the path and the position in it."""
    rows = array_records(spark, path).select(F.from_json("record", ARRAY_SCHEMAS[kind]).alias("__r"),
                                             F.col("file").alias("__file"), F.col("ord").alias("__pos"))
    return rows.select("__r.*", "__file", "__pos") if place else rows.select("__r.*")
