"""Proof queries: each one runs the library operators over
the driver tables (through the adapter views) and returns a DataFrame whose
columns match the DuckDB oracle in ``oracle.py`` by name.

Every query reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from forumflow.functions.entities import decode_entities
from forumflow.functions.rewrite import rewrite_text
from forumflow.functions.text import age_years, epoch_seconds, human_count, human_date, shifted_date, strip_all
from forumflow.functions.urls import MEDIA_REDIRECT_MARKER, clean_url
from forumflow.operators.assign import assign_capped, candidates_from_positions
from forumflow.operators.child_pages import child_pages
from forumflow.operators.communities import community_columns, eligible, flair_rows, group_by_key
from forumflow.operators.dedup import distinct_rows, keep_first, keep_last, positional_index, split_by_position
from forumflow.operators.enrich import seeded_color, seeded_color_pair, seeded_int, seeded_pick, seeded_sample, \
    user_row
from forumflow.operators.joins import attach_children, dealt
from forumflow.operators.media import DIRECT_IMAGE_HOST, POST_DETAIL, classify_media, media_assets, source_flags
from forumflow.operators.members import join_members, member_refs, member_set, users_table
from forumflow.operators.posts import not_deleted, post_columns, request_plan, text_fallback
from forumflow.operators.threads import flatten_threads, nest_threads, prune_threads, recount_comments, \
    thread_levels
from forumflow.operators.topk import sort_order, top_k_per_group
from forumflow.plans.adapters import adapter, table
from forumflow.session import pin_utc, staging_path
from forumflow.sinks.writers import write_by_topic, write_table, write_topic_map
from forumflow.sources.curated import read_curated_array
from forumflow.sources.datasets import read_datasets
from forumflow.sources.html import extract_pairs, extract_sections, extract_table_rows
from forumflow.sources.landed import (explode_community_search, explode_moderators, explode_post_listing, explode_rules,
                                      explode_topic_map, parse_community_about, parse_flairs, parse_once, read_landed,
                                      read_requests, read_topic_lines, split_article, status_counts)

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the proof queries (shared with the oracle SQL).
CAP = 25
AS_OF = 1_800_000_000
TEXT_MAP = [("the", "x"), ("he", "y"), ("and", "&amp;"), ("r/", "v/")]
NAME_MAP = [("ring", "band"), ("an", "AN"), ("o", "0")]
PICK_LIST = ["alpha", "beta", "gamma", "delta"]


def _t(spark, d, name):
    return table(spark, d, name)


def _bigint(c):
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


# --------------------------------------------------------------------------
# topics, grouping, requests
# --------------------------------------------------------------------------

def q_topics_explode(spark: SparkSession, d: str) -> DataFrame:
    nat, reg = _t(spark, d, "nation"), _t(spark, d, "region")
    packed = (nat.join(reg, nat.n_regionkey == reg.r_regionkey)
              .groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("topics"))
              .select(F.to_json(F.create_map(F.col("r_name"), F.col("topics"))).alias("json")))
    return explode_topic_map(packed, "json").select("category", "ord", "topic")


def q_group_by_topic(spark: SparkSession, d: str) -> DataFrame:
    nat, reg = _t(spark, d, "nation"), _t(spark, d, "region")
    rows = nat.join(reg, nat.n_regionkey == reg.r_regionkey).select(
        F.col("r_name").alias("topic"), "n_nationkey", "n_name")
    g = group_by_key(rows, "topic", "n_nationkey", ["n_name"], "items")
    return g.select("topic", _bigint(F.size("items")).alias("n"),
                    F.array_join(F.transform("items", lambda x: x.getField("n_name")), "|").alias("titles"))


_SEGMENT_BY_MOD5 = ("AUTOMOBILE", "building", "Furniture", "MACHINERY", "household")


def q_request_plan(spark: SparkSession, d: str) -> DataFrame:
    sup, cus, nat = _t(spark, d, "supplier"), _t(spark, d, "customer"), _t(spark, d, "nation")
    seg = F.element_at(F.array(*[F.lit(s) for s in _SEGMENT_BY_MOD5]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    od = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
          .select(F.when(F.col("s_suppkey") % 11 == 0, F.lit(""))
                  .otherwise(F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.upper("n_name"))
                                      .otherwise(F.lower("n_name")), F.lit(" "), seg)).alias("title"),
                  (F.col("s_suppkey") % 4).alias("posts_count"), F.col("s_suppkey").alias("ord")))
    tc = (cus.join(nat, cus.c_nationkey == nat.n_nationkey)
          .select(F.when(F.col("c_custkey") % 3 == 0, F.lower(F.concat("n_name", F.lit(" "), "c_mktsegment")))
                  .otherwise(F.concat("n_name", F.lit(" "), "c_mktsegment")).alias("title"),
                  F.col("c_custkey").alias("ord")))
    return request_plan(od, tc)


# --------------------------------------------------------------------------
# communities
# --------------------------------------------------------------------------

def _about_payload(v: DataFrame) -> DataFrame:
    created = F.when(F.col("subscribers") % 3 == 0, F.lit(0.0)).otherwise(
        (F.lit(1_200_000_000) + F.col("subscribers") % 100_000_000).cast("double"))
    data = F.struct(
        F.col("raw_id").alias("name"), F.col("title").alias("display_name_prefixed"),
        F.col("community_type").alias("subreddit_type"),
        F.concat(F.lit("About "), F.col("topic")).alias("public_description"),
        F.col("banner_img"), F.col("banner_background_image"), F.col("banner_background_color"),
        created.alias("created_utc"), F.col("subscribers"),
        (F.col("subscribers") % 2 == 1).alias("over18"))
    return v.select("topic", F.to_json(F.struct(data.alias("data"))).alias("payload"))


def q_community_row(spark: SparkSession, d: str) -> DataFrame:
    pin_utc(spark)
    v = adapter(spark, d, "v_communities")
    parsed = parse_community_about(_about_payload(v))
    return parsed.select(*community_columns(F.col("__about"), topic=F.col("topic")))


def q_community_filter(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_communities")
    return v.where(eligible(F.col("community_type"), F.col("title"))).select("title")


def q_capped_assign(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events")
    cands = candidates_from_positions(ev, "event_type", "user_id", "event_id")
    out = assign_capped(cands, "event_type", "group_ord", "user_id", "pos", CAP)
    return out.select(F.col("event_type").alias("topic"), "user_id")


def q_child_attach(spark: SparkSession, d: str) -> DataFrame:
    nat, sup = _t(spark, d, "nation"), _t(spark, d, "supplier")
    # nation 0's suppliers are left out, so that one parent has none
    out = attach_children(nat, sup.where("s_nationkey <> 0"), "n_nationkey", "s_nationkey", ["s_suppkey"], ["s_name"], "suppliers")
    return out.select(F.col("n_name").alias("nation"), _bigint(F.size("suppliers")).alias("n"),
                      F.array_join(F.transform("suppliers", lambda x: x.getField("s_name")), "|").alias("names"))


def q_richtext_union(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint").cast("string")
    et = F.col("event_type")
    part1 = (F.when(et == "click", F.struct(F.lit("text").alias("e"), k.alias("t"), F.lit(None).cast("string").alias("a"),
                                           F.lit(None).cast("string").alias("u")))
             .when(et == "view", F.struct(F.lit("emoji").alias("e"), F.lit(None).cast("string").alias("t"),
                                          F.concat(F.lit(":k"), k, F.lit(":")).alias("a"),
                                          F.concat(F.lit("https://x.test/e/"), k).alias("u")))
             .when(et == "signup", F.struct(F.lit("emoji").alias("e"), F.lit(None).cast("string").alias("t"),
                                            F.lit(":s:").alias("a"), F.lit(None).cast("string").alias("u")))
             .otherwise(F.struct(F.lit("sticker").alias("e"), F.lit("x").alias("t"),
                                 F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("u"))))
    part2 = F.struct(F.lit("text").alias("e"), et.alias("t"), F.lit(None).cast("string").alias("a"),
                     F.lit(None).cast("string").alias("u"))
    flair = F.struct(F.lit("#ffffff").alias("background_color"),
                     F.when(F.col("value") >= 10, et).otherwise(F.lit("")).alias("text"),
                     F.when(et != "error", F.array(part1, part2)).alias("richtext"))
    landed = ev.select("event_id", F.to_json(F.array(flair)).alias("payload"))
    flairs = parse_flairs(landed).select("event_id", F.posexplode(flair_rows(F.col("__flairs"))).alias("fo", "f"))
    return flairs.select("event_id", F.posexplode("f.rich_text").alias("part_ord", "p"), F.col("f.full_text")) \
        .select("event_id", _bigint("part_ord").alias("part_ord"), F.col("p.text").alias("text"),
                F.col("p.url").alias("url"), F.col("full_text"))


def q_community_search(spark: SparkSession, d: str) -> DataFrame:
    """Search responses, one per nation with its suppliers in key order; every fifth child has no detail."""
    sup, nat = _t(spark, d, "supplier"), _t(spark, d, "nation")
    detail = F.when(F.col("s_suppkey") % 5 != 0, F.struct(
        F.concat(F.lit("t5_"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("public").alias("subreddit_type"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("about "), "s_name")).alias("public_description"),
        F.col("s_suppkey").cast("bigint").alias("subscribers")))
    child = F.struct("s_suppkey", F.struct(F.concat(F.lit("r/"), "s_name").alias("subreddit_name_prefixed"), detail.alias("sr_detail")).alias("data"))
    packed = (sup.join(nat, sup.s_nationkey == nat.n_nationkey).groupBy("n_name")
              .agg(F.array_sort(F.collect_list(child)).alias("children")))
    landed = packed.select(F.col("n_name").alias("key"), F.to_json(F.struct(F.struct(
        F.transform("children", lambda c: F.struct(c.getField("data").alias("data"))).alias("children")).alias("data"))).alias("payload"))
    found = explode_community_search(landed).where(F.col("__detail").isNotNull())
    return found.select(_bigint("pos").alias("pos"), *community_columns(F.col("__detail"), title=F.col("__title"), topic=F.col("key"))).select(
        "topic", "pos", "id", "title", "public_description", "subscribers")


def q_rule_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rules responses, one per brand with its parts in key order, descriptions rewritten."""
    rule = F.struct("p_partkey", F.struct(F.col("p_name").alias("short_name"), F.concat("p_type", F.lit(" the "), "p_name").alias("description")).alias("r"))
    packed = _t(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    landed = packed.select("p_brand", F.to_json(F.struct(F.transform("rules", lambda x: x.getField("r")).alias("rules"))).alias("payload"))
    rows = explode_rules(landed).select("p_brand", _bigint("ord").alias("ord"), "short_name", "description")
    return rewrite_text(rows, ["description"], TEXT_MAP)


def q_request_files(spark: SparkSession, d: str) -> DataFrame:
    """On-demand request lists, one JSON file per nation, read back as rows."""
    sup = _t(spark, d, "supplier")
    req = F.struct(F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 3 != 0, F.lit("t")).alias("topic"),
                   (F.col("s_suppkey") % 7).cast("int").alias("posts_count"))
    path = staging_path(spark, "requests")
    (sup.groupBy("s_nationkey").agg(F.to_json(F.collect_list(req)).alias("value"))
     .repartition(F.col("s_nationkey")).write.partitionBy("s_nationkey").option("maxRecordsPerFile", 1).text(path))
    return read_requests(spark, f"{path}/*").select("title", "topic", "posts_count")


def q_topic_folders(spark: SparkSession, d: str) -> DataFrame:
    """Communities written by topic and read back; ``in_order`` is whether each file holds its titles ascending (K1, O2)."""
    sup, nat = _t(spark, d, "supplier"), _t(spark, d, "nation")
    path = staging_path(spark, "by-topic")
    write_by_topic(sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(F.col("n_name").alias("topic"), F.col("s_name").alias("title")), path)
    rows = spark.read.parquet(path).select("topic", "title", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))
    before = F.lag("title").over(Window.partitionBy("file").orderBy("i"))
    return rows.select(F.col("topic").cast("string").alias("topic"), "title", F.coalesce(before <= F.col("title"), F.lit(True)).alias("in_order"))


def q_moderator_last_wins(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events")
    child = F.struct(F.concat(F.lit("t2_"), F.col("user_id").cast("string")).alias("id"),
                     F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"))
    landed = ev.select("event_id", "event_type",
                       F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data"))).alias("payload"))
    mods = explode_moderators(landed).withColumn("user_id", strip_all("mod_id", "t2_").cast("bigint"))
    return keep_last(mods, ["user_id"], ["event_id", "ord"]).select("user_id", "event_type")


def q_envelope_split(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events")
    failed = F.col("event_type") == "error"
    env = ev.select(
        F.concat(F.lit("ep"), (F.col("user_id") % 4).cast("string")).alias("endpoint"),
        F.col("event_id").cast("string").alias("key"),
        F.when(~failed, F.col("props")).alias("payload"),
        F.struct(F.when(failed, F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
                 (~failed).alias("success"),
                 F.when(failed, F.lit("server error")).alias("error")).alias("result_state"))
    path = staging_path(spark, "envelopes")
    write_table(env, path, fmt="json")
    return status_counts(read_landed(spark, path))


# --------------------------------------------------------------------------
# posts
# --------------------------------------------------------------------------

def _listing_payload(v: DataFrame) -> DataFrame:
    created = epoch_seconds("created_ts").cast("double")
    post = F.struct(
        F.col("id"), F.concat(F.lit("Post "), F.col("id")).alias("title"), F.col("author"),
        F.col("author_fullname"), F.concat(F.lit("r/c"), F.col("community_key").cast("string"))
        .alias("subreddit_name_prefixed"), F.col("subreddit_id"), F.col("ups"),
        (F.col("ups") % 50).alias("num_comments"), created.alias("created_utc"),
        (F.col("ups") % 2 == 0).alias("over_18"))
    return v.select(F.to_json(F.struct(F.struct(F.array(F.struct(post.alias("data"))).alias("children"))
                                       .alias("data"))).alias("payload"))


def q_post_row(spark: SparkSession, d: str) -> DataFrame:
    pin_utc(spark)
    v = adapter(spark, d, "v_posts")
    rows = explode_post_listing(_listing_payload(v))
    return rows.where(not_deleted(F.col("__post.author"))).select(*post_columns(F.col("__post")))


def q_text_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    prev = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("prev_text"))
    j = docs.join(prev, "doc_id", "left")
    own = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text"))
    own_html = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("&lt;div&gt;"), F.col("text"), F.lit("&lt;/div&gt;")))
    cross = F.when(F.col("prev_text").isNotNull() & (F.col("doc_id") % 3 != 0),
                   F.array(F.struct(F.col("prev_text").alias("selftext"),
                                    F.concat(F.lit("&lt;p&gt;"), F.col("prev_text")).alias("selftext_html"))))\
        .otherwise(F.array().cast("array<struct<selftext:string,selftext_html:string>>"))
    out = j.select("doc_id", *text_fallback(own, own_html, cross))
    return out.select("doc_id", _bigint(F.length("text")).alias("n_chars"), F.md5("text").alias("text_md5"),
                      F.md5("text_html").alias("html_md5"))


def q_top_posts(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_posts")
    nat = _t(spark, d, "nation")
    reqs = nat.select(F.col("n_nationkey").alias("community_key"),
                      F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey") + 1).otherwise(F.lit(5))
                      .alias("k"))
    top = top_k_per_group(v, reqs, "community_key", "k", sort_order("top"))
    return top.where(not_deleted(F.col("author"))).select(
        F.col("community_key").alias("community"), F.col("id").alias("post_id"), _bigint("rn").alias("rn"))


def q_top_deep(spark: SparkSession, d: str) -> DataFrame:
    """The first 5,000 rows of each group, more than Spark limits before a shuffle."""
    li = _t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    reqs = li.select("l_returnflag").distinct().withColumn("k", F.lit(5000))
    order = [F.col("l_extendedprice").desc(), *[F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]]
    return top_k_per_group(li, reqs, "l_returnflag", "k", order).select(
        "l_returnflag", "rn", "l_extendedprice", "l_orderkey", "l_partkey")


def q_child_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each status in pages of 500, in key order."""
    pages = child_pages(_t(spark, d, "orders"), "o_orderstatus", ["o_orderkey"], ["o_orderkey"], page_rows=500)
    keys = F.transform("items", lambda x: x.getField("o_orderkey").cast("string"))
    return pages.select("o_orderstatus", "page", _bigint(F.size("items")).alias("n"), F.md5(F.array_join(keys, ",")).alias("keys_md5"))


def q_topic_map_file(spark: SparkSession, d: str) -> DataFrame:
    """The topic map written from extracted sections, read back as topics."""
    part = _t(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<i>before</i><nav title="'), F.lit("Caf&eacute; "), key, F.lit('"><li>'), "p_name", F.lit("</li><li>"), "p_type", F.lit("</li>"))
    sections = extract_sections(part.select("p_partkey", html.alias("html")), "p_partkey", "html", r'<nav title="([^"]*)"',
                                r"<li>([^<]*)</li>", item_group=1)
    path = staging_path(spark, "topic-map")
    write_topic_map(sections, path)
    return read_topic_lines(spark, path).select("category", "ord", "topic")


# --------------------------------------------------------------------------
# threads
# --------------------------------------------------------------------------

def _keep_thread_node():
    return (F.col("kind") == "t1") & (F.coalesce(F.col("author"), F.lit("")) != "[deleted]")


def q_thread_prune(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_threads")
    kept = prune_threads(v, "conv_id", "turn", "parent_turn", _keep_thread_node())
    return kept.select("conv_id", "turn", _bigint("depth").alias("depth"))


def _nested_articles(v: DataFrame, prune: bool) -> DataFrame:
    keep = _keep_thread_node() if prune else None
    lv = thread_levels(v, "conv_id", "turn", "parent_turn", keep)
    return nest_threads(lv, "conv_id", "turn", "parent_turn", "turn", "depth", F.col("kind"),
                        [F.col("author"), F.col("body"), F.col("turn").alias("ups")])


def q_thread_flatten(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_threads")
    nested = _nested_articles(v, prune=False)
    article = nested.select(
        F.col("conv_id"),
        F.concat(F.lit('[{"kind":"Listing","data":{"children":[{"kind":"t3","data":{"id":"'),
                 F.col("conv_id").cast("string"),
                 F.lit('"}}]}},{"kind":"Listing","data":{"children":'), F.col("roots_json"),
                 F.lit("}}]")).alias("payload"))
    art = split_article(article)
    flat = flatten_threads(art, "conv_id", "__roots")
    return flat.select(F.col("post_id").alias("conv_id"), F.col("ups").alias("turn"), _bigint("depth").alias("depth"),
                       F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), "author", F.md5("body").alias("body_md5"))


def q_thread_nest(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_threads")
    flat = flatten_threads(_nested_articles(v, prune=True), "conv_id", "roots_json")
    return flat.select(F.col("post_id").alias("conv_id"), F.col("ups").alias("turn"), _bigint("depth").alias("depth"),
                       F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def q_comment_recount(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_threads")
    posts = (v.groupBy("conv_id").agg(F.count(F.lit(1)).alias("api_n"))
             .withColumn("article_found", F.col("conv_id") % 10 != 5))
    with_article = v.join(posts.where("article_found").select("conv_id"), "conv_id", "left_semi")
    kept = prune_threads(with_article, "conv_id", "turn", "parent_turn", _keep_thread_node())
    comments = kept.select(F.col("conv_id").alias("post_id"))
    out = recount_comments(posts, comments, "conv_id", "api_n", "article_found", "kept_n")
    return out.select("conv_id", _bigint("api_n").alias("api_n"), _bigint("kept_n").alias("kept_n"))


# --------------------------------------------------------------------------
# media
# --------------------------------------------------------------------------

def _res_struct(h, w, u):
    return F.struct(h.alias("height"), w.alias("width"), u.alias("url"))


def q_media_type(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_media")
    b, i = F.col("branch"), F.col("doc_id")
    sid = i.cast("string")
    res = F.array(_res_struct(F.lit(108), F.lit(216), F.concat(F.lit("https://p.test/"), sid, F.lit("?a=1&amp;b=2"))),
                  _res_struct(F.lit(64), F.lit(128), F.lit("")))
    empty_res = F.array().cast("array<struct<height:int,width:int,url:string>>")
    img0 = F.struct(
        F.when((b == 5) & (i % 2 == 0), empty_res).when(b.isin(1, 4, 5), res).alias("resolutions"),
        _res_struct(F.lit(1080), F.lit(2160), F.concat(F.lit("https://p.test/src/"), sid)).alias("source"),
        F.struct(F.struct(F.when(b == 3, res).alias("resolutions")).alias("gif")).alias("variants"))
    preview = F.when(b.isin(1, 3, 4, 5) & ~((b == 1) & (i % 2 == 1)), F.struct(F.array(img0).alias("images")))
    meta_item = lambda e: F.struct(F.lit(e).alias("e"), F.array(F.struct(
        F.lit(10).alias("x"), F.lit(20).alias("y"), F.concat(F.lit("https://m.test/"), sid).alias("u"))).alias("p"),
        F.lit(320).alias("x"), F.lit(240).alias("y"))
    second = F.when(i % 3 == 0, meta_item("Image")).otherwise(meta_item("RedditVideo"))
    meta = F.when(b.isin(2, 6), F.create_map(F.lit("a"), meta_item("Image"), F.lit("b"), second))
    video = F.when(b == 4, F.create_map(F.lit("reddit_video"), F.to_json(F.struct(
        F.concat(F.lit("https://v.test/"), sid, F.lit("/hls")).alias("hls_url"), F.lit(720).alias("height")))))
    override = F.when(~((b == 1) & (i % 4 == 3)), F.rtrim(F.col("url"), F.lit("/")))
    detail = F.struct(sid.alias("id"), F.col("permalink"), F.col("url"), override.alias("url_overridden_by_dest"),
                      F.col("is_gallery"), video.alias("secure_media"), preview.alias("preview"),
                      meta.alias("media_metadata"))
    landed = v.select("doc_id", F.to_json(detail).alias("payload"))
    parsed = parse_once(landed, "payload", POST_DETAIL, "__detail")
    out = classify_media(parsed, "__detail", "doc_id")
    return out.select("doc_id", F.coalesce(F.col("media_type"), F.lit("none")).alias("media_type"))


def _asset_payloads(spark: SparkSession, d: str) -> DataFrame:
    a = adapter(spark, d, "v_assets")
    item = F.struct("ord", F.struct(F.col("height"), F.col("width"), F.col("url")).alias("r"))
    per_post = a.groupBy("post_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    res = F.transform(F.filter("items", lambda x: x.getField("ord") > 0), lambda x: x.getField("r"))
    src = F.get(F.filter("items", lambda x: x.getField("ord") == 0), 0).getField("r")
    kind = F.col("post_id") % 4
    pid = F.col("post_id").cast("string")
    empty_res = F.array().cast("array<struct<height:int,width:int,url:string>>")
    img0 = F.struct(F.when(kind == 2, empty_res).otherwise(res).alias("resolutions"), src.alias("source"),
                    F.struct(F.struct(F.when(kind == 2, res).alias("resolutions")).alias("gif")).alias("variants"))
    p_items = F.transform(res, lambda r: F.struct(r.getField("width").alias("x"), r.getField("height").alias("y"),
                                                  r.getField("url").alias("u")))
    s_item = F.struct(src.getField("width").alias("x"), src.getField("height").alias("y"),
                      src.getField("url").alias("u"))
    meta = F.when(kind == 3, F.create_map(F.concat(F.lit("g"), pid),
                                          F.struct(F.lit("Image").alias("e"), p_items.alias("p"), s_item.alias("s"))))
    url = F.when(kind == 1, F.concat(F.lit("https://out.test/"), pid)).otherwise(
        F.concat(F.lit(DIRECT_IMAGE_HOST + "/"), pid))
    detail = F.struct(pid.alias("id"), F.concat(F.lit("/r/x/"), pid, F.lit("/")).alias("permalink"),
                      url.alias("url"), F.when(kind == 1, url).alias("url_overridden_by_dest"),
                      (kind == 3).alias("is_gallery"),
                      F.when(kind != 3, F.struct(F.array(img0).alias("images"))).alias("preview"),
                      meta.alias("media_metadata"))
    return per_post.select("post_id", F.to_json(detail).alias("payload"))


def q_media_sort(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_once(_asset_payloads(spark, d), "payload", POST_DETAIL, "__detail")
    classified = source_flags(classify_media(parsed, "__detail", "post_id"), "__detail")
    assets = media_assets(classified.drop("media_type"), "post_id")
    return assets.select("post_id", "media_type", _bigint("item_ord").alias("item_ord"),
                         _bigint("res_ord").alias("res_ord"), "height", "width", "url", "is_source", "asset_id")


_TAG_TO_E = {"A": "Image", "N": "AnimatedImage", "R": "RedditVideo"}


def q_media_multi(spark: SparkSession, d: str) -> DataFrame:
    a = adapter(spark, d, "v_assets")
    e = F.when(F.col("tag") == "A", F.lit(_TAG_TO_E["A"])).when(F.col("tag") == "N", F.lit(_TAG_TO_E["N"]))\
        .otherwise(F.lit(_TAG_TO_E["R"]))
    val = F.struct(e.alias("e"),
                   F.array(F.struct(F.col("width").alias("x"), F.col("height").alias("y"), F.col("url").alias("u")))
                   .alias("p"),
                   F.struct(F.col("width").alias("x"), F.col("height").alias("y"), F.col("url").alias("u"),
                            F.col("url").alias("gif")).alias("s"),
                   F.col("width").alias("x"), F.col("height").alias("y"),
                   F.col("url").alias("hlsUrl"), F.col("url").alias("dashUrl"))
    per_post = a.groupBy("post_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("m"), F.col("ord").cast("string")), val))).alias("mm"))
    pid = F.col("post_id").cast("string")
    detail = F.struct(pid.alias("id"), F.concat(F.lit("/r/x/"), pid).alias("permalink"),
                      F.concat(F.lit(DIRECT_IMAGE_HOST + "/"), pid).alias("url"), F.lit(False).alias("is_gallery"),
                      F.col("mm").alias("media_metadata"))
    parsed = parse_once(per_post.select("post_id", F.to_json(detail).alias("payload")), "payload", POST_DETAIL,
                        "__detail")
    out = classify_media(parsed, "__detail", "post_id")
    tags = F.array_distinct(F.transform(F.map_values("__detail.media_metadata"), lambda v: v.getField("e")))
    return out.where(F.col("media_type") == "multi").select(
        "post_id", _bigint(F.size(tags)).alias("n_tags"), _bigint(F.size("media.multi")).alias("n_items"))


def q_gallery_ids(spark: SparkSession, d: str) -> DataFrame:
    """Gallery resolutions with their ids, sizes and urls, as nested in the media column."""
    parsed = parse_once(_asset_payloads(spark, d), "payload", POST_DETAIL, "__detail")
    out = classify_media(parsed, "__detail", "post_id").where("media_type = 'gallery'")
    images = out.select("post_id", F.posexplode("media.gallery.images").alias("item_ord", "image"))
    return images.select("post_id", _bigint("item_ord").alias("item_ord"), F.posexplode("image").alias("res_ord", "r")).select(
        "post_id", "item_ord", _bigint("res_ord").alias("res_ord"), "r.id", "r.height", "r.width", "r.url")


# --------------------------------------------------------------------------
# members and users
# --------------------------------------------------------------------------

def q_member_set(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_posts").where(not_deleted(F.col("author")))
    cus = _t(spark, d, "customer")
    authors = member_refs(v, "community_key", "author_fullname", "author")
    commenters = member_refs(cus.withColumn("uid", F.concat(F.lit("t2_"), F.col("c_custkey").cast("string"))),
                             "c_nationkey", "uid", "c_name")
    return member_set(authors, commenters).select(F.col("community_id").alias("community"), "user_id", "name")


def q_members_join(spark: SparkSession, d: str) -> DataFrame:
    comm = adapter(spark, d, "v_communities").where(F.col("community_type") != "private") \
        .select(strip_all("raw_id", "t5_").alias("community_id"))
    cus = _t(spark, d, "customer")
    mods = cus.select(F.col("c_nationkey").cast("string").alias("community_id"),
                      F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("name"),
                      F.col("c_custkey").alias("ord"))
    posts = adapter(spark, d, "v_posts").where(not_deleted(F.col("author")))
    observed = member_refs(posts.withColumn("cid", strip_all("subreddit_id", "t5_"))
                           .withColumn("ord", F.col("id").cast("bigint"))
                           # one user seen under two names
                           .withColumn("author", F.when(F.col("ord") % 5 == 0, F.concat("author", F.lit("_old")))
                                       .otherwise(F.col("author"))),
                           "cid", "author_fullname", "author", keep=["ord"])
    out = join_members(comm, mods, observed)
    return out.select(F.col("community_id").alias("community"), "user_id", "name", "is_moderator")


def q_users_table(spark: SparkSession, d: str) -> DataFrame:
    pin_utc(spark)
    m = adapter(spark, d, "v_members")
    mods = m.where("is_moderator").select("user_id", "community")
    mems = m.select("user_id", "community")
    u = users_table(mods, mems, "community")
    u = u.withColumn("uname", F.concat(F.lit("user"), F.col("user_id").cast("string")))
    cols = user_row("user_id", "uname", enrich=True, as_of=AS_OF)
    # the profile columns have a query of their own (user_columns)
    return u.select("source", "community", *cols).withColumnRenamed("id", "user_id").drop("avatar_img", "banner_img", "public_description")


def q_user_columns(spark: SparkSession, d: str) -> DataFrame:
    """Avatar, banner, description and trophies of enriched users."""
    cus, reg = _t(spark, d, "customer"), _t(spark, d, "region")
    users = cus.select(F.col("c_custkey").alias("uid"), "c_name").select(
        *user_row("uid", "c_name", enrich=True, as_of=AS_OF, avatar_base="https://a.test/", descriptions=PICK_LIST))
    catalog = positional_index(reg.select(F.col("r_name").alias("title")), "title", "item_index")
    out = seeded_sample(users, "id", catalog, "item_index", seeded_int(F.col("id"), "trophies-k", 0, 3), "trophies", out_col="trophies")
    return out.select("id", "name", "avatar_img", "banner_img", "public_description",
                      F.array_join(F.transform("trophies", lambda t: t.getField("title")), "|").alias("trophies"))


# --------------------------------------------------------------------------
# dedup, distinct, merge, split
# --------------------------------------------------------------------------

def q_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_key"))
    return keep_first(docs, ["text_key"], ["doc_id"]).select("doc_id")


def q_catalog_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose nested maps are equal but for the order of their entries are one row."""
    a = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")
    b = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand")
    m = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit(1), a, F.lit(2), b)).otherwise(F.create_map(F.lit(2), a, F.lit(1), b))
    # dealt while they are narrow: a row of maps takes ten times as much
    part = dealt(_t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey", part_bytes=4 << 20)
    rows = part.select("p_size", F.array(F.struct(m.alias("m"))).alias("maps"))
    first = F.col("maps")[0]["m"][1]
    return distinct_rows(rows).select(first["brand"].alias("p_brand"), first["type"].alias("p_type"), "p_size")


def q_curated_array(spark: SparkSession, d: str) -> DataFrame:
    """One JSON array per file, read by byte ranges: every element with its place."""
    root = staging_path(spark, "curated")
    text = F.concat(F.lit('}"{[\\'), "c_name", F.lit("é]"))
    rows = F.sort_array(F.collect_list(F.struct("c_custkey", text.alias("title"), F.col("c_custkey").cast("string").alias("image_link"))))
    files = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(rows).alias("value"))
    files.write.partitionBy("c_nationkey").text(root)
    found = read_curated_array(spark, f"{root}/*/*.txt", "awards", place=True)
    return found.select(F.col("image_link").cast("bigint").alias("c_custkey"), "title", F.col("__pos").alias("ord"))


def q_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    root = staging_path(spark, "datasets")
    a = docs.where(F.col("doc_id") % 3 != 0).select("doc_id", F.col("doc_id").cast("string").alias("id"))
    b = docs.where(F.col("doc_id") % 3 != 1).select(
        "doc_id", F.when(F.col("doc_id") % 50 == 7, F.lit("")).otherwise(F.col("doc_id").cast("string")).alias("id"))
    write_table(a, f"{root}/ds_a/Documents.parquet")
    write_table(b, f"{root}/ds_b/documents.parquet")
    write_table(_t(spark, d, "labels").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("id")),
                f"{root}/ds_a/labels.parquet")
    rows = read_datasets(spark, root, "documents").where(F.col("id") != "")
    first = keep_first(rows, ["id"], ["src_file", "src_row"])
    return first.select("doc_id", "from_set")


def q_merge_children(spark: SparkSession, d: str) -> DataFrame:
    """Two datasets that share a third of their posts, with different comments on them."""
    from forumflow.plans.build import merge_datasets
    root = staging_path(spark, "merge")
    lines = dealt(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    orders = _t(spark, d, "orders").select("o_orderkey")
    for name, left_out in (("a", 0), ("b", 1)):
        posts = orders.where(F.col("o_orderkey") % 3 != left_out)
        write_table(posts.select(F.col("o_orderkey").cast("string").alias("id"), F.lit(name).alias("title")),
                    f"{root}/ds_{name}/posts.parquet")
        write_table(posts.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
                    .select(F.col("o_orderkey").cast("string").alias("post_id"),
                            F.concat(F.lit(name), F.col("l_linenumber").cast("string")).alias("body")),
                    f"{root}/ds_{name}/comments.parquet")
    return merge_datasets(spark, root, None)["comments"].select("post_id", "body")


def q_landing_stage(spark: SparkSession, d: str) -> DataFrame:
    """Responses landed twice, payloads that don't parse, and lines that are no envelope."""
    from forumflow.plans.build import stage_landed
    root = staging_path(spark, "landing")
    key = F.col("s_suppkey").cast("string")
    name = lambda v: F.to_json(F.struct(F.struct(F.concat(F.lit(v), key).alias("name")).alias("data")))
    sup = _t(spark, d, "supplier").select("s_suppkey")
    for v, rows in (("a", sup), ("b", sup.where("s_suppkey % 3 = 0"))):
        payload = F.when((F.lit(v) == "a") & (F.col("s_suppkey") % 7 == 1), F.concat(F.lit("<html>"), key)).otherwise(name(v))
        line = F.to_json(F.struct(F.lit("community_about").alias("endpoint"), key.alias("key"), payload.alias("payload")))
        broken = (F.lit(v) == "a") & (F.col("s_suppkey") % 11 == 2)
        rows.select(F.when(broken, F.concat(F.lit("broken "), key)).otherwise(line).alias("value")).write.text(f"{root}/{v}")
    ok, rejects = stage_landed(spark, f"{root}/*")
    return ok.select("key", F.lit("ok").alias("kind"), F.get_json_object("payload", "$.data.name").alias("text")).union(
        rejects.select("key", F.lit("reject"), "error"))


def q_split_position(spark: SparkSession, d: str) -> DataFrame:
    cus = _t(spark, d, "customer").select("c_custkey")
    parts = split_by_position(cus, "c_custkey")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("min_key"),
                                     F.max("c_custkey").alias("max_key"))


# --------------------------------------------------------------------------
# html
# --------------------------------------------------------------------------

def q_html_rows(spark: SparkSession, d: str) -> DataFrame:
    return extract_pairs(_t(spark, d, "pages"), "page_id", "html")


def q_html_table(spark: SparkSession, d: str) -> DataFrame:
    """Award rows (title as is) and trophy rows (title and description by line) of packed pages: upper-case tags, single
    quotes and none, end tags left out, tables inside tables."""
    # dealt while they are narrow: a file is one task, whose pages take many times its bytes
    part = dealt(_t(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    key = F.col("p_partkey").cast("string")
    inner = F.when(F.col("p_partkey") % 5 == 0, F.lit("<table><tr><td><img src=//i.test/in.png>y<p>inner &#8217;</table>")).otherwise(F.lit(""))
    award = F.concat(F.lit("<TABLE><TR><TD>no image</TD></TR><TR CLASS=r><TD><IMG ALT='a>b' SRC='//i.test/"), key, F.lit(".png'></TD><TD><P>"),
                     "p_name", F.lit(" <B>caf&eacute;</B></P><p>x</p>"), inner, F.lit("</TD></TR></TABLE>"))
    trophy = F.concat(F.lit('<table><tr><td>no image<tr class="r"><td><img alt="" src="//i.test/'), key, F.lit('.png"><td>\n'), "p_name",
                      F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n"), "p_type")).otherwise(F.lit("")),
                      F.lit(" &#8217;&hellip;\n</table><!-- <tr><img src=no> -->"))
    pages = part.select("p_partkey", award.alias("award"), trophy.alias("trophy"))
    cols = ["p_partkey", "kind", "ord", "title", "description", "image_link"]
    awards = extract_table_rows(pages, "p_partkey", "award").withColumn("kind", F.lit("award"))
    trophies = extract_table_rows(pages, "p_partkey", "trophy", scheme="https:", two_line=True).withColumn("kind", F.lit("trophy"))
    return awards.select(cols).union(trophies.select(cols))


SECTION_HEAD = r"<(nav|article|footer)[\s>]"
SECTION_ITEM = r"<(li|p)[\s>]"


def q_html_sections(spark: SparkSession, d: str) -> DataFrame:
    s = extract_sections(_t(spark, d, "pages"), "page_id", "html", SECTION_HEAD, SECTION_ITEM)
    return s.select("page_id", "section", _bigint(F.size("items")).alias("n_items"))


# --------------------------------------------------------------------------
# text
# --------------------------------------------------------------------------

def q_text_rewrite(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    out = rewrite_text(docs.select("doc_id", "text"), ["text"], TEXT_MAP)
    return out.select("doc_id", F.md5("text").alias("md5"), _bigint(F.length("text")).alias("n_chars"))


def q_nested_rewrite(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    grouped = (part.groupBy("p_brand", F.floor(F.col("p_partkey") / 100).cast("bigint").alias("bucket"))
               .agg(F.array_sort(F.collect_list(F.struct(
                   "p_partkey", F.concat("p_name", F.lit(" &lt;&eacute;&#8217;&hellip;")).alias("p_name"), "p_type"))).alias("items")))
    out = rewrite_text(grouped, ["items[].p_name"], NAME_MAP)
    return out.select("p_brand", "bucket",
                      F.array_join(F.transform("items", lambda x: x.getField("p_name")), "|").alias("names"))


def q_entity_decode(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages")
    return pages.select("page_id", F.md5(decode_entities(F.col("html"))).alias("md5"))


def _url_encode_chain(c):
    out = c
    for src, dst in URL_ENCODE_STEPS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


# The adapter's percent-encoding steps, in order ('%' first).
URL_ENCODE_STEPS = [("%", "%25"), (":", "%3A"), ("/", "%2F"), ("?", "%3F"), ("=", "%3D"), ("&", "%26"),
                    ("#", "%23")]


def q_url_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages")
    m = F.col("page_id") % 3
    enc = (F.when(m == 0, F.concat(F.lit(MEDIA_REDIRECT_MARKER + "?url="), _url_encode_chain(F.col("url")),
                                   F.lit("&s=abc")))
           .when(m == 1, F.concat(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("%20x&eacute;&hellip;&#8217;&notit;&copy")))
           .otherwise(F.col("url")))
    return pages.select("page_id", clean_url(enc).alias("url"))


def q_id_strip(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_posts")
    raw = F.when(F.col("author_fullname").endswith("7"), F.concat("author_fullname", F.lit("t2_x")))\
        .otherwise(F.col("author_fullname"))
    return v.select("id", strip_all(raw, "t2_").alias("author_id"),
                    strip_all("subreddit_id", "t5_").alias("community_id"))


def q_human_date(spark: SparkSession, d: str) -> DataFrame:
    pin_utc(spark)
    o = _t(spark, d, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(F.col("o_orderkey") % 100 == 0, F.lit(0)).otherwise(epoch_seconds("o_orderdate")).alias("e"))
    e = _t(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
                                       epoch_seconds("ts").alias("e"))
    u = o.unionByName(e)
    return u.select("id", human_date("e").alias("d1"), shifted_date("e").alias("d2"))


def q_age_years(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), age_years(epoch_seconds("o_orderdate"), AS_OF).alias("age"))


def q_human_count(spark: SparkSession, d: str) -> DataFrame:
    v = adapter(spark, d, "v_communities").select(F.concat(F.lit("c"), F.col("raw_id")).alias("id"),
                                                  F.col("subscribers").alias("x"))
    mult = (F.when(F.col("o_orderkey") % 4 == 0, F.lit(1)).when(F.col("o_orderkey") % 4 == 1, F.lit(1000))
            .when(F.col("o_orderkey") % 4 == 2, F.lit(1000000)).otherwise(F.lit(7)))
    o = _t(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
                                      (F.floor("o_totalprice").cast("bigint") * mult).alias("x"))
    # digits that a cut quotient would round wrongly, up to 1e15
    p = _t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
                                    (F.col("p_partkey") * F.lit(10 ** 9) + F.lit(14_999_999)).alias("x"))
    return v.unionByName(o).unionByName(p).select("id", human_count("x").alias("text"))


# --------------------------------------------------------------------------
# seeded enrichment
# --------------------------------------------------------------------------

def q_seeded_pick(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    c1, c2 = seeded_color_pair(k, "key", "primary")
    return c.select(k.alias("key"), seeded_int(k, "n", 1, 100).alias("n"), c1.alias("color"), c2.alias("color2"),
                    seeded_color(k, "icon").alias("icon"),
                    seeded_pick(k, "pick", F.array(*[F.lit(x) for x in PICK_LIST])).alias("pick"))


def q_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    cat = positional_index(_t(spark, d, "region").select("r_name"), "r_name", "item_index")
    out = seeded_sample(c, "key", cat, "item_index", seeded_int(F.col("key"), "k", 0, 3), "start")
    return out.select("key", F.array_join(F.transform("picks", lambda x: x.getField("r_name")), "|").alias("picks"))


QUERIES: dict[str, Query] = {
    "topics_explode": q_topics_explode,
    "group_by_topic": q_group_by_topic,
    "request_plan": q_request_plan,
    "community_row": q_community_row,
    "community_filter": q_community_filter,
    "capped_assign": q_capped_assign,
    "child_attach": q_child_attach,
    "child_pages": q_child_pages,
    "richtext_union": q_richtext_union,
    "community_search": q_community_search,
    "rule_rows": q_rule_rows,
    "request_files": q_request_files,
    "topic_folders": q_topic_folders,
    "moderator_last_wins": q_moderator_last_wins,
    "envelope_split": q_envelope_split,
    "post_row": q_post_row,
    "text_fallback": q_text_fallback,
    "top_posts": q_top_posts,
    "top_deep": q_top_deep,
    "topic_map_file": q_topic_map_file,
    "thread_prune": q_thread_prune,
    "thread_flatten": q_thread_flatten,
    "thread_nest": q_thread_nest,
    "comment_recount": q_comment_recount,
    "media_type": q_media_type,
    "media_sort": q_media_sort,
    "media_multi": q_media_multi,
    "gallery_ids": q_gallery_ids,
    "member_set": q_member_set,
    "members_join": q_members_join,
    "users_table": q_users_table,
    "user_columns": q_user_columns,
    "dedup_first": q_dedup_first,
    "catalog_distinct": q_catalog_distinct,
    "curated_array": q_curated_array,
    "union_dedup": q_union_dedup,
    "merge_children": q_merge_children,
    "landing_stage": q_landing_stage,
    "split_position": q_split_position,
    "html_rows": q_html_rows,
    "html_sections": q_html_sections,
    "html_table": q_html_table,
    "text_rewrite": q_text_rewrite,
    "nested_rewrite": q_nested_rewrite,
    "entity_decode": q_entity_decode,
    "url_clean": q_url_clean,
    "id_strip": q_id_strip,
    "human_date": q_human_date,
    "age_years": q_age_years,
    "human_count": q_human_count,
    "seeded_pick": q_seeded_pick,
    "seeded_sample": q_seeded_sample,
}
