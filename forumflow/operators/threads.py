"""Recursive comment threads without recursive types.

Two representations:

* **edge table** ``(post, node, parent, ...)`` - parent NULL for a root.
  ``thread_paths`` finds depths and paths by pointer doubling, about
  log2(depth) joins of bare pointers, optionally pruning whole subtrees (T3:
  a failing node is no pointer's aim, so all its replies go with it).
* **nested JSON** as the API lands it: each node is
  ``{"kind", "data": {..., "replies": "" | {"data": {"children": [...]}}}}``.
  ``flatten_threads`` parses several levels per pass with one typed
  ``from_json`` and one generator, filters before expanding, and records the
  path of child positions. Each pass is narrow (no shuffle).

Every round (edges) or pass (JSON) is checkpointed to the shared folder, so
lineage stays short and a lost executor only recomputes the current step.
``ORDER BY path`` on the int array is depth-first pre-order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField,
                               StructType)

from forumflow.operators.joins import broadcast_if_small
from forumflow.session import cut_lineage

COMMENT_DATA = StructType([
    StructField("author", StringType()),
    StructField("author_fullname", StringType()),
    StructField("author_flair_text", StringType()),
    StructField("body", StringType()),
    StructField("body_html", StringType()),
    StructField("ups", LongType()),
    StructField("score", LongType()),
    StructField("created_utc", DoubleType()),
    StructField("replies", StringType()),
])
COMMENT_NODE = StructType([StructField("kind", StringType()), StructField("data", COMMENT_DATA)])
COMMENT_LIST = ArrayType(COMMENT_NODE)
DELETED = "[deleted]"


# --------------------------------------------------------------------------
# edge tables
# --------------------------------------------------------------------------

def thread_paths(edges: DataFrame, post: str, node: str, parent: str, order: str | None = None,
                 depth_col: str = "depth", path_col: str = "path", max_depth: int | None = None) -> DataFrame:
    """(post, node, parent, depth[, path]) of every node that hangs on a root, by pointer doubling.

    A node starts with a pointer to its parent. In a round each pending node
    joins its pointer's own pointer and jumps there, so distances double and a
    thread of depth d takes about log2(d) rounds, not d. A node whose pointer
    leads to no node (pruned or missing) goes, and with it all that points to
    it; one whose pointer is null has reached above a root. With ``order`` the
    jumps join their paths too: ``path`` holds (order, node) from the root down.

    Pointers travel without the nodes' other columns. The side joined to is
    broadcast if its estimated size is within the bound; above it AQE splits
    the partition of a parent that holds many nodes. Rows in a cycle reach no
    root: their distance outgrows the number of nodes and they go (with
    ``max_depth`` they are an error, as is any deeper node).
    """
    step = [] if order is None else [F.array(F.struct(F.col(order).alias("order"), F.col(node).alias("node"))).alias("__path")]
    state = cut_lineage(edges.select(
        F.col(post).alias("__post"), F.col(node).alias("__node"), F.col(parent).alias("__parent"),
        F.col(parent).alias("__up"), F.lit(1).cast("bigint").alias("__dist"), *step).distinct())
    total, reach = state.count(), 1
    while True:
        pending = state.where("__up is not null")
        if pending.isEmpty():
            break
        if reach > (total if max_depth is None else min(total, max_depth)):
            if max_depth is None:
                break
            raise ValueError(f"thread deeper than {max_depth} levels: a parent cycle in the edge table?")
        side = state.select(F.col("__post").alias("__p"), F.col("__node").alias("__n"), F.col("__up").alias("__u"),
                            F.col("__dist").alias("__d"), *[F.col("__path").alias("__head")] * bool(step))
        jumped = pending.join(broadcast_if_small(side), (F.col("__post") == F.col("__p")) & (F.col("__up") == F.col("__n")))
        path = [F.concat("__head", "__path").alias("__path")] * bool(step)
        jumped = jumped.select("__post", "__node", "__parent", F.col("__u").alias("__up"),
                               (F.col("__dist") + F.col("__d")).alias("__dist"), *path)
        state = cut_lineage(state.where("__up is null").unionByName(jumped))
        reach *= 2
    out = state.where("__up is null").select(
        F.col("__post").alias(post), F.col("__node").alias(node), F.col("__parent").alias(parent),
        F.col("__dist").cast("int").alias(depth_col), *[F.col("__path").alias(path_col)] * bool(step))
    if max_depth is not None and not out.where(F.col(depth_col) > max_depth).isEmpty():
        raise ValueError(f"thread deeper than {max_depth} levels: a parent cycle in the edge table?")
    return out


def thread_levels(edges: DataFrame, post: str, node: str, parent: str,
                  keep: Column | None = None, depth_col: str = "depth", max_depth: int | None = None) -> DataFrame:
    """Every node that hangs on a root, with its depth (roots = 1).

    ``keep`` (a boolean Column over ``edges``) prunes the subtree below any
    node where it is false (T3). Depths come from ``thread_paths``; the rows
    themselves are checkpointed once and joined once."""
    e = cut_lineage(edges if keep is None else edges.where(keep))
    depths = thread_paths(e, post, node, parent, None, depth_col, max_depth=max_depth)
    keys = depths.select(F.col(post).alias("__p"), F.col(node).alias("__n"), F.col(parent).alias("__u"), depth_col)
    return e.join(broadcast_if_small(keys), (F.col(post) == F.col("__p")) & (F.col(node) == F.col("__n"))
                  & F.col(parent).eqNullSafe(F.col("__u"))).select(*e.columns, depth_col)


def prune_threads(edges: DataFrame, post: str, node: str, parent: str, keep: Column,
                  depth_col: str = "depth") -> DataFrame:
    """Nodes that survive subtree pruning, with depth."""
    return thread_levels(edges, post, node, parent, keep, depth_col)


# --------------------------------------------------------------------------
# nested JSON
# --------------------------------------------------------------------------

_DATA_FIELDS = [f for f in COMMENT_DATA.fields if f.name != "replies"]


def _node_schema(levels: int) -> ArrayType:
    """ARRAY of comment nodes typed ``levels`` deep; the deepest ``replies``
    stays JSON text (the continuation for the next pass)."""
    node = StructType([StructField("kind", StringType()), StructField("data", COMMENT_DATA)])
    for _ in range(levels - 1):
        listing = StructType([StructField("data", StructType([StructField("children", ArrayType(node))]))])
        data = StructType(_DATA_FIELDS + [StructField("replies", listing)])
        node = StructType([StructField("kind", StringType()), StructField("data", data)])
    return ArrayType(node)


class _Names:
    def __init__(self):
        self.n = 0

    def __call__(self, base: str) -> str:
        self.n += 1
        return f"{base}{self.n}"


def _levels_sql(children: str, path: str, depth: str, k: int, levels: int, nm: _Names,
                curated: bool = False) -> str:
    """SQL text: every kept node of ``levels - k + 1`` levels below
    ``children`` as rows (path, depth, fields, replies-text-at-the-last-level).

    API shape (``curated=False``): ``{kind, data: {..., replies: {data:
    {children}}}}``; pruning (T2 + T3) filters a node before its replies are
    expanded. Curated shape: ``{..., replies: [...]}``, already pruned. The
    position recorded is the index in the unfiltered list."""
    c, i, w = nm("c"), nm("i"), nm("w")
    keep = ("true" if curated else
            f"coalesce({w}.c.kind, '') = 't1' AND coalesce({w}.c.data.author, '') <> '{DELETED}'")
    wrapped = (f"filter(transform(coalesce({children}, array()), ({c}, {i}) -> named_struct('c', {c}, 'i', {i})), "
               f"{w} -> {keep})")
    v = nm("v")
    d = f"{v}.c" if curated else f"{v}.c.data"
    author_id = f"{d}.author_fullname" if curated else f"replace(coalesce({d}.author_fullname, ''), 't2_', '')"
    my_path = f"concat({path}, array({v}.i))"
    row = (f"named_struct('path', {my_path}, 'depth', {depth} + {k}, "
           f"'author', coalesce({d}.author, ''), 'author_id', coalesce({author_id}, ''), "
           f"'author_flair_text', {d}.author_flair_text, 'body', coalesce({d}.body, ''), "
           f"'body_html', coalesce({d}.body_html, ''), 'ups', CAST(coalesce({d}.ups, 0) AS BIGINT), "
           f"'score', CAST(coalesce({d}.score, 0) AS BIGINT), "
           f"'created_utc', CAST(coalesce({d}.created_utc, 0) AS BIGINT), "
           f"'__replies', {f'{d}.replies' if k == levels else 'CAST(NULL AS STRING)'})")
    if k == levels:
        return f"transform({wrapped}, {v} -> {row})"
    kids = f"{d}.replies" if curated else f"{d}.replies.data.children"
    below = _levels_sql(kids, my_path, depth, k + 1, levels, nm, curated)
    return f"flatten(transform({wrapped}, {v} -> concat(array({row}), {below})))"


def _curated_schema(levels: int) -> ArrayType:
    """Curated comment nodes ``{author, ..., replies: [...]}`` typed
    ``levels`` deep; the deepest ``replies`` stays JSON text."""
    node = StructType(_DATA_FIELDS + [StructField("replies", StringType())])
    for _ in range(levels - 1):
        node = StructType(_DATA_FIELDS + [StructField("replies", ArrayType(node))])
    return ArrayType(node)


def _flatten(articles: DataFrame, post_col: str, roots_json_col: str, levels_per_pass: int,
             curated: bool) -> DataFrame:
    spark = articles.sparkSession
    if str(spark.conf.get("spark.sql.json.enablePartialResults")).lower() != "true":
        levels_per_pass = 1
    schema = _curated_schema(levels_per_pass) if curated else _node_schema(levels_per_pass)
    frontier = articles.select(F.col(post_col).alias("post_id"),
                               F.lit(None).cast("array<int>").alias("path"),
                               F.lit(0).alias("depth"), F.col(roots_json_col).alias("__text"))
    passes = []
    while True:
        parsed = frontier.select("post_id", "path", "depth", F.from_json("__text", schema).alias("__kids"))
        flat = _levels_sql("__kids", "coalesce(path, CAST(array() AS ARRAY<INT>))", "depth", 1,
                           levels_per_pass, _Names(), curated)
        rows = parsed.select("post_id", F.explode(F.expr(flat)).alias("__r")).select("post_id", "__r.*")
        rows = cut_lineage(rows.withColumn("depth", F.col("depth").cast("int")))
        passes.append(rows)
        nxt = F.col("__replies") if curated else F.get_json_object("__replies", "$.data.children")
        frontier = (rows.where(F.coalesce(F.col("__replies"), F.lit("")) != "")
                    .select("post_id", "path", "depth", nxt.alias("__text")))
        if frontier.isEmpty():
            break
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.drop("__replies")


def flatten_threads(articles: DataFrame, post_col: str, roots_json_col: str,
                    levels_per_pass: int = 4) -> DataFrame:
    """Nested comment JSON (API shape) -> flat comment rows.

    ``roots_json_col`` holds the JSON array of root comment nodes of one
    post. Each pass parses ``levels_per_pass`` levels with one typed
    ``from_json`` (a ``""`` leaf marker becomes a NULL field) and flattens
    them with one generator; only the deepest level keeps its replies as
    text for the next pass. Each byte of a payload is therefore scanned
    about depth / levels_per_pass times, and one checkpoint per pass bounds
    the lineage. Needs ``spark.sql.json.enablePartialResults`` (default on);
    without it the operator parses one level per pass.

    Output: post_id, path ARRAY<INT>, depth INT, author, author_id,
    author_flair_text, body, body_html, ups, score, created_utc.
    """
    return _flatten(articles, post_col, roots_json_col, levels_per_pass, curated=False)


def flatten_curated_comments(posts: DataFrame, post_col: str, comments_json_col: str,
                             levels_per_pass: int = 4) -> DataFrame:
    """S10 + T1: the nested ``comments`` of a finished posts dataset (each
    node ``{author, author_fullname, ..., replies: [...]}``, already pruned)
    -> the same flat comment rows as ``flatten_threads``."""
    return _flatten(posts, post_col, comments_json_col, levels_per_pass, curated=True)


def nest_threads(nodes: DataFrame, post: str, node: str, parent: str, order: str, depth: str,
                 kind: Column, data_cols: list[Column]) -> DataFrame:
    """Rebuild nesting. Returns (post, roots_json): the JSON array of root
    nodes, siblings in ``order`` (ties by node).

    Sorted by path, a post's nodes are in pre-order, and each node's part of
    the text follows from its depth and its neighbours' depths alone: a comma
    unless it is a first child, its fields, then either the start of its
    replies or the ends of all that it closes. So one sort per post does, and
    no level is joined. Only for the JSON sink, where one post's tree is one
    record by definition of the format.
    """
    data = F.struct(*data_cols, F.lit("").alias("replies"))
    text = F.to_json(F.struct(kind.alias("kind"), data.alias("data")))       # ends in '"replies":""}}'
    rows = nodes.select(F.col(post).alias("__p"), F.col(node).alias("__n"),
                        F.substr(text, F.lit(1), F.length(text) - 4).alias("__open"))
    paths = thread_paths(nodes, post, node, parent, order, "__depth", "__path").select(
        F.col(post).alias("__pp"), F.col(node).alias("__pn"), "__depth", "__path")
    rows = rows.join(paths, (F.col("__p") == F.col("__pp")) & (F.col("__n") == F.col("__pn")))
    by_path = Window.partitionBy("__p").orderBy("__path")
    before, behind = F.lag("__depth").over(by_path), F.coalesce(F.lead("__depth").over(by_path), F.lit(1))
    comma = F.when(before >= F.col("__depth"), F.lit(",")).otherwise(F.lit(""))
    begun = F.lit('{"kind":"Listing","data":{"children":[')
    ended = F.concat(F.lit('""}}'), F.repeat(F.lit("]}}}}"), F.col("__depth") - behind))
    part = F.concat(comma, "__open", F.when(behind > F.col("__depth"), begun).otherwise(ended))
    parts = rows.withColumn("__part", part).groupBy("__p").agg(
        F.sort_array(F.collect_list(F.struct("__path", "__part"))).alias("__parts"))
    return parts.select(F.col("__p").alias(post), F.concat(
        F.lit("["), F.array_join(F.transform("__parts", lambda x: x["__part"]), ""), F.lit("]")).alias("roots_json"))


def recount_comments(posts: DataFrame, comments: DataFrame, post_key: str, api_count: str,
                     article_found: str, out_col: str = "num_comments") -> DataFrame:
    """T5 + J4 + G3: kept comments per post replace the API count, but only
    for posts whose article was read; others keep the API number."""
    kept = comments.groupBy(F.col("post_id").alias(post_key)).agg(F.count(F.lit(1)).alias("__kept"))
    return (posts.join(kept, post_key, "left")
            .withColumn(out_col, F.when(F.col(article_found), F.coalesce(F.col("__kept"), F.lit(0)))
                        .otherwise(F.col(api_count)).cast("bigint"))
            .drop("__kept"))
