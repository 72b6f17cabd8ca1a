"""End-to-end builds over landed responses (the three entry points of the
original tool, re-expressed as Spark jobs).

* ``build_communities`` - topic map + on-demand requests + community
  search/about envelopes -> communities (capped per topic), rules, flairs,
  moderators.
* ``build_posts`` - request plan + post listings + articles -> posts,
  comments, media, media assets, members, users.
* ``build_forum`` - both, plus award / trophy catalogs, written as one
  dataset directory per collection.
* ``merge_datasets`` - many finished datasets -> one, de-duplicated and
  rewritten (ordered case-insensitive text map).
* ``split_users`` - positional halves of the users table.

Landing layout: envelope JSON lines (``endpoint, key, payload,
result_state``) anywhere below ``landing``; ``topics`` is a JSON topic map
file, ``requests`` the on-demand JSON array.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from forumflow.functions.rewrite import MERGE_REWRITE_MAP, rewrite_text
from forumflow.functions.text import is_nonblank, strip_all
from forumflow.operators.assign import assign_capped
from forumflow.operators.communities import community_columns, eligible, flair_rows
from forumflow.operators.dedup import distinct_rows, keep_first, keep_first_by_size, positional_index, split_by_position
from forumflow.operators.enrich import seeded_int, seeded_sample, user_row
from forumflow.operators.media import classify_media, media_assets, source_flags
from forumflow.operators.members import join_members, member_refs, users_table
from forumflow.operators.posts import DEFAULT_POSTS_PER_COMMUNITY, not_deleted, post_columns, request_plan
from forumflow.operators.threads import flatten_threads, recount_comments
from forumflow.operators.joins import broadcast_if_small, dealt
from forumflow.operators.topk import sort_order, top_k_per_group
from forumflow.sinks.versions import publish_version, read_version
from forumflow.sinks.writers import publish_collections, staged, write_collections, write_table
from forumflow.sources.datasets import read_datasets
from forumflow.sources.html import extract_table_rows
from forumflow.sources.landed import (explode_community_search, explode_moderators, explode_post_listing,
                                      envelope_state, explode_rules, last_per_key, parse_community_about, parse_flairs,
                                      payload_text, read_landed, read_requests, read_topics, rejects, split_article,
                                      split_envelopes)

# The collections of a finished dataset and how each is
# de-duplicated when datasets are merged (by id, first wins; or whole row).
KINDS_BY_ID = ("communities", "posts", "users")
KINDS_WHOLE_ROW = ("topics", "awards", "trophies", "community_rules", "community_flairs", "community_members",
                   "comments", "media_assets")
# The collections whose rows belong to an entity: (column of its id, collection of the entity).
CHILDREN = {"community_rules": ("community_id", "communities"), "community_flairs": ("community_id", "communities"),
            "community_members": ("community_id", "communities"), "comments": ("post_id", "posts"),
            "media_assets": ("post_id", "posts")}
# The text paths the merge pass rewrites, per collection.
MERGE_PATHS = {
    "awards": ["title"],
    "trophies": ["title", "description"],
    "communities": ["title", "public_description"],
    "community_rules": ["description"],
    "community_members": ["name"],
    "posts": ["community", "title", "author", "text", "text_html", "awards[].title"],
    "comments": ["author", "body", "body_html"],
    "users": ["name", "public_description", "trophies[].title", "trophies[].description"],
}


@dataclass
class BuildOptions:
    """The run parameters (validated; no credentials)."""
    communities_per_topic: int = 6
    posts_per_community: int = DEFAULT_POSTS_PER_COMMUNITY
    sort: str = "landed"
    enrich_users: bool = False
    as_of: int = field(default_factory=lambda: int(time.time()))  # ages are as of this time; fix it for equal reruns
    output_format: str = "parquet"
    versioned: bool = False  # publish as a new version of the dataset (sinks.versions)

    def __post_init__(self):
        for name in ("communities_per_topic", "posts_per_community"):
            v = int(getattr(self, name))
            if v <= 0:
                raise ValueError(f"{name} must be a positive integer, got {v}")
            setattr(self, name, v)


def stage_landed(spark: SparkSession, landing: str) -> tuple[DataFrame, DataFrame]:
    """(envelopes, rejects), the landing read and written once.

    Of several responses with a payload for one (endpoint, key) the last one
    stays, in the order of file path and position. Rejects hold responses
    without a payload, lines that are no envelope (their text as the error),
    and payloads that are no JSON of the endpoint's form."""
    raw = read_landed(spark, landing)
    meta = F.col("_metadata")
    place = F.struct(meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    placed = staged(raw.select("*", place.alias("place"), envelope_state(raw).alias("state")), "landed", partition_by="endpoint")
    good = last_per_key(placed.where("state = 'ok'").select("endpoint", "key", "payload", "result_state", "place")).drop("place")
    return staged(good, "envelopes", partition_by="endpoint"), rejects(placed)


def _ok(env: DataFrame, endpoint: str) -> DataFrame:
    ok, _ = split_envelopes(env.where(F.col("endpoint") == endpoint))
    return ok


def build_communities(spark: SparkSession, env: DataFrame, topics: DataFrame, requests: DataFrame,
                      opts: BuildOptions) -> dict[str, DataFrame]:
    """Entry 1. On-demand communities first (exempt from the cap), then each
    topic in code-point order takes its first N eligible, not-yet-taken
    search results (W3)."""
    # on-demand: about payload per requested title (F4: title and topic)
    req = requests.where(is_nonblank("title") & is_nonblank("topic")).select("title", "topic", "ord")
    about = parse_community_about(_ok(env, "community_about")).join(
        req.withColumnRenamed("title", "key"), "key")
    od = (about.where(eligible(F.col("__about.subreddit_type"), F.col("__about.display_name_prefixed")))
          .select(*community_columns(F.col("__about"), topic=F.col("topic")), F.col("ord").alias("__o")))
    od = keep_first(od, ["title"], ["__o"]).drop("__o")
    # topic search: (topic, group_ord, title, pos) candidates
    topic_rank = positional_index(topics.select("topic").distinct(), "topic", "group_ord")
    found = explode_community_search(_ok(env, "community_search")).withColumnRenamed("key", "topic")
    found = found.where(F.col("__detail").isNotNull() &
                        eligible(F.col("__detail.subreddit_type"), F.col("__title")))
    firsts = keep_first(found, ["topic", "__title"], ["pos"])
    cands = (firsts.join(od.select(F.col("title").alias("__title")), "__title", "left_anti")
             .join(broadcast_if_small(topic_rank), "topic"))
    taken = assign_capped(cands.select("topic", "group_ord", F.col("__title").alias("item"), "pos"),
                          "topic", "group_ord", "item", "pos", opts.communities_per_topic)
    searched = (firsts.join(taken.select("topic", F.col("item").alias("__title")), ["topic", "__title"])
                .select(*community_columns(F.col("__detail"), title=F.col("__title"), topic=F.col("topic"))))
    communities = od.unionByName(searched)
    order = [c for c in ("category", "ord") if c in topics.columns]
    cats = keep_first(topics, ["topic"], order).select("topic", "category")
    communities = communities.join(cats, "topic", "left")
    keyed = communities.select("id", strip_all("title", "r/").alias("key"))
    rules = (explode_rules(_ok(env, "rules")).join(keyed, "key")
             .select(F.col("id").alias("community_id"), F.col("ord").cast("int").alias("ord"),
                     "short_name", "description"))
    flairs = []
    for kind, endpoint in (("link", "link_flairs"), ("user", "user_flairs")):
        f = parse_flairs(_ok(env, endpoint)).join(keyed, "key")
        flairs.append(f.select(F.col("id").alias("community_id"), F.lit(kind).alias("kind"),
                               F.posexplode(flair_rows(F.col("__flairs"))).alias("ord", "f"))
                      .select("community_id", "kind", "ord", "f.*"))
    mods = (explode_moderators(_ok(env, "moderators")).join(keyed, "key")
            .select(F.col("id").alias("community_id"), strip_all("mod_id", "t2_").alias("user_id"),
                    F.col("mod_name").alias("name"), F.col("ord").cast("bigint").alias("ord")))
    return {"communities": communities, "community_rules": rules,
            "community_flairs": flairs[0].unionByName(flairs[1]), "moderators": mods}


def build_posts(spark: SparkSession, env: DataFrame, communities: DataFrame, requests: DataFrame,
                moderators: DataFrame, opts: BuildOptions) -> dict[str, DataFrame]:
    """Entry 2: request plan -> listings (top-k) -> articles (media, comments,
    recount) -> members and users."""
    topic_comms = communities.select("title", F.lit(0).cast("bigint").alias("ord"))
    plan = request_plan(requests.select("title", "posts_count", "ord"), topic_comms, opts.posts_per_community)
    listing = explode_post_listing(_ok(env, "post_listing")).withColumnRenamed("key", "title")
    ranked_in = listing.select("title", "pos", F.col("__post"), F.col("__post.id").alias("id"),
                               F.col("__post.ups").alias("ups"), F.col("__post.created_utc").alias("created_utc"))
    top = top_k_per_group(ranked_in, plan.select("title", "post_limit"), "title", "post_limit",
                          sort_order(opts.sort))
    posts = staged(top.where(not_deleted(F.col("__post.author"))).select(*post_columns(F.col("__post"))), "posts")
    art = split_article(_ok(env, "article")).withColumnRenamed("key", "id")
    art = staged(art.join(posts.select("id"), "id", "left_semi").select("id", "article_found", "__detail", "__roots"), "articles")
    comments = staged(flatten_threads(art, "id", "__roots"), "comments")
    classified = staged(source_flags(classify_media(art, "__detail", "id"), "__detail").drop("__roots", "__detail"), "media")
    assets = media_assets(classified.drop("media_type"), "id")
    found = classified.select("id", F.lit(True).alias("article_found"), "media")
    posts = (posts.join(found, "id", "left")
             .withColumn("article_found", F.coalesce("article_found", F.lit(False))))
    posts = recount_comments(posts, comments, "id", "num_comments", "article_found")
    # members: post authors (article read) and commenters, per community id
    authors = member_refs(posts.where("article_found").withColumn("ord", F.lit(0).cast("bigint")),
                          "community_id", "author_id", "author", keep=["ord"])
    commenters = member_refs(comments.join(posts.select(F.col("id").alias("post_id"), "community_id"), "post_id")
                             .withColumn("ord", F.lit(1).cast("bigint")),
                             "community_id", "author_id", "author", keep=["ord"])
    observed = authors.unionByName(commenters).distinct().join(
        communities.select(F.col("id").alias("community_id")).distinct(), "community_id", "left_semi")
    members = join_members(communities.select(F.col("id").alias("community_id")), moderators, observed)
    users = users_table(moderators.select("user_id", "name", F.col("community_id").alias("__c")),
                        observed.select("user_id", "name", F.col("community_id").alias("__c")), "__c")
    users = users.select(*user_row("user_id", "name", enrich=opts.enrich_users, as_of=opts.as_of))
    return {"posts": posts.drop("article_found"), "comments": comments, "media_assets": assets,
            "community_members": members, "users": users}


def attach_sample(df: DataFrame, key: str, catalog: DataFrame, out_col: str, order: str, salt: str,
                  max_k: int = 3) -> DataFrame:
    """X4 + J8: 0..max_k distinct catalog entries per row, seeded by the key
    (awards on posts, trophies on users). The catalog gets a dense index by
    ``order`` without a single-partition window."""
    indexed = positional_index(catalog, [order] + [c for c in catalog.columns if c != order], "__idx")
    k = seeded_int(F.col(key), f"{salt}-k", 0, max_k)
    return seeded_sample(df, key, indexed, "__idx", k, salt, out_col=out_col, max_k=max_k)


def build_catalogs(env: DataFrame) -> dict[str, DataFrame]:
    """Award and trophy catalogs from landed HTML pages."""
    pages = {e: _ok(env, e).withColumn("html", payload_text()) for e in ("awards_page", "trophies_page")}
    awards = extract_table_rows(pages["awards_page"], "key", "html")
    trophies = extract_table_rows(pages["trophies_page"], "key", "html", scheme="https:", two_line=True)
    return {"awards": distinct_rows(awards, ["title", "image_link"]),
            "trophies": distinct_rows(trophies, ["title", "description", "image_link"])}


def build_forum(spark: SparkSession, landing: str, topics_path: str, requests_path: str, out: str | None,
                opts: BuildOptions | None = None) -> dict[str, DataFrame]:
    opts = opts or BuildOptions()
    # the landing is read once: one row per (endpoint, key), partitioned by endpoint
    env, failed = stage_landed(spark, landing)
    topics = read_topics(spark, topics_path)
    requests = read_requests(spark, requests_path)
    c = build_communities(spark, env, topics, requests, opts)
    # used many times further on, so written once
    c["communities"], c["moderators"] = staged(c["communities"], "communities"), staged(c["moderators"], "moderators")
    p = build_posts(spark, env, c["communities"], requests, c["moderators"], opts)
    cat = build_catalogs(env)
    p["posts"] = attach_sample(p["posts"], "id", cat["awards"], "awards", "title", salt="awards")
    if opts.enrich_users:
        p["users"] = attach_sample(p["users"], "id", cat["trophies"], "trophies", "title", salt="trophies")
    else:
        item = StructType(cat["trophies"].schema.fields)
        p["users"] = p["users"].withColumn("trophies", F.array().cast(ArrayType(item)))
    tables = {**{k: v for k, v in c.items() if k != "moderators"}, **p, **cat, "topics": topics}
    tables["rejects"] = failed
    if out:
        if opts.versioned:
            publish_version(tables, out, opts.output_format)
        else:
            write_collections(tables, out, opts.output_format)
    return tables


def merge_datasets(spark: SparkSession, root: str, out: str | None, mapping=MERGE_REWRITE_MAP,
                   fmt: str = "parquet", versioned: bool = False) -> dict[str, DataFrame]:
    """Entry 3: union every dataset of a kind below ``root``; entities with an
    id keep the first row per non-blank id (file, then row order), and their
    children come from the dataset of that row; catalogs keep distinct rows;
    then the ordered text rewrite. ``out`` may be below ``root``: everything
    is staged before it is published. With ``versioned`` the result is a new
    version of the dataset ``out``, seen whole or not at all."""
    merged = {}
    winners: dict[str, DataFrame] = {}
    for kind in KINDS_BY_ID + KINDS_WHOLE_ROW:
        try:
            rows = read_datasets(spark, root, kind, fmt)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # no dataset holds this kind
        if kind in KINDS_BY_ID:
            rows = keep_first_by_size(rows.where(is_nonblank("id")), ["id"], ["src_file", "src_row"])
            winners[kind] = rows.select(F.col("id").alias("__id"), F.col("from_set").alias("__set"))
            rows = rows.drop("from_set", "src_file", "src_row")
        else:
            key, parent = CHILDREN.get(kind, (None, None))
            if parent in winners and key in rows.columns:
                # rows of an entity that another dataset gave are not part of it
                whole = rows.drop("src_file", "src_row")
                rows, first = dealt(whole, key), winners[parent]
                if rows is not whole:   # else it may be broadcast by its files' compressed size, whole to every task
                    first = first.hint("merge")
                rows = (rows.join(first, F.col(key) == F.col("__id"), "left")
                        .where(F.col("__set").isNull() | (F.col("__set") == F.col("from_set"))).drop("__id", "__set"))
            rows = distinct_rows(rows.drop("from_set", "src_file", "src_row"))
        paths = [p for p in MERGE_PATHS.get(kind, []) if p.split(".")[0].removesuffix("[]") in rows.columns]
        merged[kind] = rewrite_text(rows, paths, mapping) if paths else rows
    if out and versioned:
        return read_version(spark, out, publish_version(merged, out, fmt))
    return publish_collections(merged, out, fmt) if out else merged


# File names of a finished dataset in the original layout.
ORIGINAL_FILES = {"topics": "topics.json", "awards": "awards.json", "trophies": "trophies.json",
                  "communities": "subreddits.json", "posts": "posts.json", "users": "users.json"}
# The text paths the merge pass rewrites in the original layout.
ORIGINAL_PATHS = {
    "awards": ["title"],
    "trophies": ["title", "description"],
    "communities": ["title", "public_description", "rules[].description",
                    "members[].public_description", "members[].name", "members[].trophies[].title",
                    "members[].trophies[].description", "moderators[].public_description", "moderators[].name",
                    "moderators[].trophies[].title", "moderators[].trophies[].description"],
    "posts": ["subreddit", "title", "author", "text", "text_html", "awards[].title"],
    "comments": ["author", "body", "body_html"],
    "users": ["name", "public_description", "trophies[].title", "trophies[].description"],
}


def merge_original_datasets(spark: SparkSession, root: str, out: str | None, mapping=MERGE_REWRITE_MAP,
                            fmt: str = "parquet") -> dict[str, DataFrame]:
    """Entry 3 on finished datasets in the original JSON layout: every file
    two levels below ``root`` whose name contains a kind's file name.
    Communities, posts and users keep the first row per non-blank id (file
    path, then position in the file); the others keep distinct rows. The
    nested comments become a flat ``comments`` table (rewritten there: author,
    body, body_html), so no rewrite ever runs over raw JSON text."""
    from forumflow.operators.threads import flatten_curated_comments
    from forumflow.sources.curated import read_communities_map, read_curated_array
    from forumflow.sources.datasets import _ci_glob
    from forumflow.sources.landed import read_topics

    def glob(kind: str) -> str:
        return f"{root.rstrip('/')}/*/*{_ci_glob(ORIGINAL_FILES[kind])}*"

    merged: dict[str, DataFrame] = {}
    for kind in ORIGINAL_FILES:
        try:
            if kind == "communities":
                rows = read_communities_map(spark, glob(kind))
                # file order: topics in map order, then list position
                rows = (rows.withColumn("__file", F.col("_metadata.file_path"))
                        .withColumn("__pos", F.struct("topic_pos", "ord")).drop("topic_pos"))
            elif kind == "topics":
                rows = read_topics(spark, glob(kind)).select("topic")
            else:
                rows = read_curated_array(spark, glob(kind), kind, place=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # no dataset holds this kind
        if kind in ("communities", "posts", "users"):
            rows = keep_first(rows.where(is_nonblank("id")), ["id"], ["__file", "__pos"])
            rows = rows.drop("__file", "__pos")
        else:
            rows = distinct_rows(rows.drop("__file", "__pos") if "__file" in rows.columns else rows)
        if kind == "posts":
            comments = flatten_curated_comments(rows, "id", "comments")
            merged["comments"] = rewrite_text(comments, ORIGINAL_PATHS["comments"], mapping)
            rows = rows.drop("comments")
        merged[kind] = rewrite_text(rows, ORIGINAL_PATHS.get(kind, []), mapping)
    return publish_collections(merged, out, fmt) if out else merged


def split_users(users: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """K5: users part 1 = positions 0..n//2, part 2 = the rest."""
    parts = split_by_position(users, order)
    return parts.where("part = 1").drop("part"), parts.where("part = 2").drop("part")


def write_split(users: DataFrame, out: str, fmt: str = "parquet") -> None:
    p1, p2 = split_users(users)
    write_table(p1, f"{out}/users_p1", fmt)
    write_table(p2, f"{out}/users_p2", fmt)


__all__ = ["BuildOptions", "attach_sample", "build_communities", "build_posts", "build_catalogs", "build_forum",
           "merge_datasets", "merge_original_datasets", "split_users", "write_split"]
