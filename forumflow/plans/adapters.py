"""Adapter views over the driver tables (FIXTURES §2).

Each adapter is one SQL text with ``{table}`` placeholders. Spark runs it
with the parquet DataFrames bound to the placeholders
(``spark.sql(text, nation=df, ...)``); the DuckDB oracle formats the same
text with the plain view names. One definition, two engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ADAPTERS: dict[str, str] = {
    "v_communities": """
SELECT concat('t5_', CAST(n.n_nationkey AS STRING)) AS raw_id,
  concat(CASE WHEN n.n_nationkey % 10 = 7 THEN 'u/' ELSE 'r/' END, n.n_name) AS title,
  CASE WHEN n.n_nationkey % 10 = 3 THEN 'private' ELSE 'public' END AS community_type,
  r.r_name AS topic,
  CASE WHEN n.n_nationkey % 5 = 0 THEN CAST(n.n_nationkey AS BIGINT) * 37
       ELSE CAST(n.n_nationkey AS BIGINT) * n.n_nationkey * n.n_nationkey * 123457 END AS subscribers,
  CASE WHEN n.n_nationkey % 4 = 0 THEN ''
       ELSE concat('https://x.test/b', CAST(n.n_nationkey AS STRING), '?w=1&amp;s=a%20b') END AS banner_img,
  concat('https://x.test/bg', CAST(n.n_nationkey AS STRING)) AS banner_background_image,
  CASE WHEN n.n_nationkey % 6 = 0 THEN CAST(NULL AS STRING) ELSE '#336699' END AS banner_background_color
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "v_posts": """
SELECT CAST(o.o_orderkey AS STRING) AS id, concat('t5_', CAST(c.c_nationkey AS STRING)) AS subreddit_id,
  c.c_nationkey AS community_key,
  CASE WHEN o.o_custkey % 10 = 0 THEN '[deleted]' ELSE c.c_name END AS author,
  concat('t2_', CAST(o.o_custkey AS STRING)) AS author_fullname,
  CAST(floor(o.o_totalprice) AS BIGINT) AS ups, o.o_orderdate AS created_ts
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "v_threads": """
SELECT conv_id, turn,
  CASE WHEN turn = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor((turn - 1) / 2.0) AS BIGINT) END AS parent_turn,
  CASE WHEN conv_id % 9 = 0 AND turn = 3 THEN 'more' ELSE 't1' END AS kind,
  CASE WHEN length(text) % 7 = 0 THEN '[deleted]'
       ELSE concat(role, CAST(conv_id % 13 AS STRING)) END AS author,
  text AS body
FROM {conversations}""",
    "v_members": """
SELECT DISTINCT event_type AS community, user_id,
  CASE WHEN user_id % 25 = 0 THEN true ELSE false END AS is_moderator
FROM {events}""",
    "v_media": """
SELECT doc_id, doc_id % 7 AS branch,
  CASE WHEN doc_id % 7 = 1 THEN concat('https://out.test/', CAST(doc_id AS STRING), '/')
       ELSE concat('https://i.redd.it/', CAST(doc_id AS STRING)) END AS url,
  concat('/r/', source, '/', CAST(doc_id AS STRING), '/') AS permalink,
  doc_id % 7 = 6 AS is_gallery
FROM {documents}""",
    "v_assets": """
SELECT l_orderkey AS post_id, CAST(l_quantity AS INT) AS height, CAST(l_quantity AS INT) * 2 AS width,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('u', CAST(l_partkey AS STRING)) END AS url,
  l_returnflag AS tag,
  row_number() OVER (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord
FROM {lineitem}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _placeholders(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ADAPTERS[name]
    dfs = {t: table(spark, sf_dir, t) for t in _placeholders(sql)}
    return spark.sql(sql, **dfs)


def duck_cte(*names: str) -> str:
    """``WITH v_x AS (...), ...`` prefix for the DuckDB oracle."""
    parts = []
    for n in names:
        sql = ADAPTERS[n]
        parts.append(f"{n} AS ({sql.format(**{t: t for t in _placeholders(sql)})})")
    return "WITH " + ",\n".join(parts)
