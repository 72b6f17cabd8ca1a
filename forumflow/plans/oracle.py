"""DuckDB oracle SQL for every proof query (same column names as Spark).

Written independently of the Spark operators: plain SQL over the driver
tables and the shared adapter views, so a wrong operator shows up as a
value-hash mismatch.
"""

from __future__ import annotations

from forumflow.functions.urls import MEDIA_REDIRECT_MARKER
from forumflow.plans.adapters import duck_cte
from forumflow.plans.proofs import AS_OF, CAP, NAME_MAP, PICK_LIST, TEXT_MAP, URL_ENCODE_STEPS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _human_count(x: str) -> str:
    """numerize-style text with exact integer arithmetic (half-even)."""
    def scaled(div: int, suffix: str) -> str:
        d = div // 100  # hundredths
        h = (f"(({x}) // {d} + CASE WHEN ({x}) % {d} * 2 > {d} "
             f"OR (({x}) % {d} * 2 = {d} AND (({x}) // {d}) % 2 = 1) THEN 1 ELSE 0 END)")
        return (f"CAST({h} // 100 AS VARCHAR) || CASE WHEN {h} % 100 = 0 THEN '' "
                f"WHEN {h} % 10 = 0 THEN '.' || CAST(({h} % 100) // 10 AS VARCHAR) "
                f"ELSE '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') END || '{suffix}'")
    return (f"CASE WHEN coalesce({x}, 0) = 0 THEN '' "
            f"WHEN {x} >= 1000000000000 THEN {scaled(10**12, 'T')} "
            f"WHEN {x} >= 1000000000 THEN {scaled(10**9, 'B')} "
            f"WHEN {x} >= 1000000 THEN {scaled(10**6, 'M')} "
            f"WHEN {x} >= 1000 THEN {scaled(1000, 'K')} "
            f"ELSE CAST({x} AS VARCHAR) END")


def _seed(key: str, salt: str, offset: int = 1) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || {_q(salt)}), {offset}, 8)) AS BIGINT)"


def _d1(e: str) -> str:
    return f"CASE WHEN coalesce({e}, 0) = 0 THEN '' ELSE strftime(epoch_ms(CAST({e} AS BIGINT) * 1000), '%-d %B %Y') END"


def _d2(e: str) -> str:
    return f"strftime(epoch_ms((CAST({e} AS BIGINT) - 28800) * 1000), '%d %B %Y')"


def _epoch(ts: str) -> str:
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


def _rewrite(col: str, mapping) -> str:
    out = col
    for src, dst in mapping:
        pat = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in src)
        out = f"regexp_replace({out}, {_q(pat)}, {_q(dst)}, 'gi')"
    return out


PRUNE_CTE = """
r AS (
  SELECT conv_id, turn, 1 AS depth FROM v_threads
  WHERE parent_turn IS NULL AND kind = 't1' AND author <> '[deleted]'
  UNION ALL
  SELECT t.conv_id, t.turn, r.depth + 1 FROM r JOIN v_threads t
    ON t.conv_id = r.conv_id AND t.parent_turn = r.turn AND t.kind = 't1' AND t.author <> '[deleted]')"""

_KEPT = "(SELECT * FROM v_threads WHERE kind = 't1' AND author <> '[deleted]')"


def _path_cte(siblings: str) -> str:
    """Kept nodes with the path of their places among the siblings that are there."""
    return f"""
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, parent_turn ORDER BY turn) - 1 AS VARCHAR) AS place FROM {siblings}),
k AS (SELECT * FROM p WHERE kind = 't1' AND author <> '[deleted]'),
r AS (
  SELECT conv_id, turn, 1 AS depth, place AS path, author, body FROM k WHERE parent_turn IS NULL
  UNION ALL
  SELECT k.conv_id, k.turn, r.depth + 1, r.path || '/' || k.place, k.author, k.body FROM r JOIN k
    ON k.conv_id = r.conv_id AND k.parent_turn = r.turn)"""


_ENC = "url"
for _s, _d in URL_ENCODE_STEPS:
    _ENC = f"replace({_ENC}, {_q(_s)}, {_q(_d)})"

ORACLE: dict[str, str] = {
    "topics_explode": """
SELECT r_name AS category, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS BIGINT) AS ord,
       n_name AS topic
FROM nation JOIN region ON n_regionkey = r_regionkey""",

    "group_by_topic": """
SELECT r_name AS topic, count(*) AS n, string_agg(n_name, '|' ORDER BY n_nationkey) AS titles
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",

    "request_plan": """
WITH od AS (
  SELECT CASE WHEN s_suppkey % 11 = 0 THEN ''
              ELSE (CASE WHEN s_suppkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END) || ' ' ||
                   (CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'building' WHEN 2 THEN 'Furniture'
                                       WHEN 3 THEN 'MACHINERY' ELSE 'household' END) END AS title,
         CAST(s_suppkey % 4 AS BIGINT) AS post_limit, 0 AS src, s_suppkey AS ord
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tc AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(n_name || ' ' || c_mktsegment) ELSE n_name || ' ' || c_mktsegment END
           AS title, CAST(10 AS BIGINT) AS post_limit, 1 AS src, c_custkey AS ord
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
u AS (SELECT * FROM od UNION ALL SELECT * FROM tc),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY src, ord) AS rn FROM u)
SELECT title, post_limit, CASE WHEN src = 0 THEN 'on_demand' ELSE 'topic' END AS source
FROM f WHERE rn = 1 AND (src = 1 OR (title <> '' AND post_limit <> 0))""",

    "community_row": duck_cte("v_communities") + """,
c AS (SELECT *, CASE WHEN subscribers % 3 = 0 THEN 0 ELSE 1200000000 + subscribers % 100000000 END AS created
      FROM v_communities)
SELECT replace(raw_id, 't5_', '') AS id, title, 'About ' || topic AS public_description, '' AS community_icon,
  CASE WHEN banner_img <> '' THEN url_decode(replace(banner_img, '&amp;', '&'))
       ELSE url_decode(replace(banner_background_image, '&amp;', '&')) END AS banner_background_image,
  CAST(NULL AS VARCHAR) AS key_color, CAST(NULL AS VARCHAR) AS primary_color,
  coalesce(banner_background_color, '#000000') AS banner_background_color,
  CAST(created AS BIGINT) AS created_utc, """ + _d1("created") + """ AS created_human,
  subscribers, """ + _human_count("subscribers") + """ AS subscribers_human,
  subscribers % 2 = 1 AS over18, false AS spoilers_enabled, topic
FROM c""",

    "community_filter": duck_cte("v_communities") + """
SELECT title FROM v_communities WHERE community_type <> 'private' AND instr(title, 'u/') = 0""",

    "capped_assign": f"""
WITH RECURSIVE topics AS (SELECT event_type t, row_number() OVER (ORDER BY event_type) tn
                          FROM (SELECT DISTINCT event_type FROM events)),
cand AS (SELECT event_type t, user_id,
                row_number() OVER (PARTITION BY event_type ORDER BY min(event_id), user_id) pos
         FROM events GROUP BY 1,2),
w AS (SELECT 0::BIGINT tn, []::BIGINT[] taken, []::BIGINT[] last
  UNION ALL
  SELECT w.tn+1, list_concat(w.taken,x.l), x.l
  FROM w JOIN (SELECT 1) ON w.tn < (SELECT count(*) FROM topics),
  LATERAL (SELECT coalesce(list(user_id),[]) l FROM
     (SELECT c.user_id FROM cand c JOIN topics tp ON c.t=tp.t
      WHERE tp.tn=w.tn+1 AND NOT list_contains(w.taken,c.user_id) ORDER BY c.pos LIMIT {CAP})) x)
SELECT t.t AS topic, unnest(w.last) AS user_id FROM w JOIN topics t ON t.tn=w.tn""",

    "child_attach": """
SELECT n_name AS nation, count(s.s_suppkey) AS n, coalesce(string_agg(s.s_name, '|' ORDER BY s.s_suppkey), '') AS names
FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey <> 0) s ON s.s_nationkey = n_nationkey
GROUP BY n_name""",

    "richtext_union": """
WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
parts AS (
  SELECT event_id, 1 AS so, CAST(k AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS url FROM e WHERE event_type = 'click'
  UNION ALL SELECT event_id, 1, ':k' || CAST(k AS VARCHAR) || ':', 'https://x.test/e/' || CAST(k AS VARCHAR)
            FROM e WHERE event_type = 'view'
  UNION ALL SELECT event_id, 1, ':s:', '' FROM e WHERE event_type = 'signup'
  UNION ALL SELECT event_id, 2, event_type, CAST(NULL AS VARCHAR) FROM e WHERE event_type <> 'error')
SELECT p.event_id, CAST(row_number() OVER (PARTITION BY p.event_id ORDER BY p.so) - 1 AS BIGINT) AS part_ord,
       p.text, p.url, CASE WHEN e.value >= 10 AND e.event_type <> '' THEN e.event_type END AS full_text
FROM parts p JOIN e ON p.event_id = e.event_id""",

    "moderator_last_wins": """
SELECT user_id, event_type FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
WHERE rn = 1""",

    "envelope_split": """
SELECT 'ep' || CAST(user_id % 4 AS VARCHAR) AS endpoint, event_type <> 'error' AS ok, count(*) AS n
FROM events GROUP BY 1, 2""",

    "post_row": duck_cte("v_posts") + ", p AS (SELECT *, " + _epoch("created_ts") + """ AS e FROM v_posts)
SELECT id, 'r/c' || CAST(community_key AS VARCHAR) AS community, replace(subreddit_id, 't5_', '') AS community_id,
  'Post ' || id AS title, author, replace(author_fullname, 't2_', '') AS author_id,
  CAST(NULL AS VARCHAR) AS author_flair_text, CAST(NULL AS VARCHAR) AS link_flair_text,
  ups, ups % 50 AS num_comments, e AS created_utc, """ + _d1("e") + """ AS created_human,
  '' AS text, '' AS text_html, ups % 2 = 0 AS over_18, false AS spoiler
FROM p WHERE author <> '[deleted]'""",

    "text_fallback": """
WITH j AS (
  SELECT d.doc_id,
    CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.text END AS own,
    CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE '&lt;div&gt;' || d.text || '&lt;/div&gt;' END AS own_html,
    CASE WHEN p.doc_id IS NOT NULL AND d.doc_id % 3 <> 0 THEN p.text END AS x_text,
    CASE WHEN p.doc_id IS NOT NULL AND d.doc_id % 3 <> 0 THEN '&lt;p&gt;' || p.text END AS x_html
  FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1),
t AS (
  SELECT doc_id,
    CASE WHEN coalesce(own, '') <> '' THEN own ELSE coalesce(x_text, '') END AS text,
    CASE WHEN coalesce(own_html, '') <> '' THEN replace(replace(own_html, '&lt;', '<'), '&gt;', '>')
         ELSE coalesce(x_html, '') END AS text_html
  FROM j)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5, md5(text_html) AS html_md5 FROM t""",

    "top_posts": duck_cte("v_posts") + """,
rq AS (SELECT n_nationkey AS community_key,
              CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey + 1 ELSE 5 END AS k FROM nation),
rk AS (SELECT p.community_key, p.id, p.author, rq.k,
              row_number() OVER (PARTITION BY p.community_key ORDER BY p.ups DESC, p.id) AS rn
       FROM v_posts p JOIN rq ON p.community_key = rq.community_key)
SELECT community_key AS community, id AS post_id, rn FROM rk WHERE rn <= k AND author <> '[deleted]'""",

    "thread_prune": duck_cte("v_threads").replace("WITH ", "WITH RECURSIVE ", 1) + "," + PRUNE_CTE + """
SELECT conv_id, turn, CAST(depth AS BIGINT) AS depth FROM r""",

    "thread_flatten": duck_cte("v_threads").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _path_cte("v_threads") + """
SELECT conv_id, turn, CAST(depth AS BIGINT) AS depth, path, author, md5(body) AS body_md5 FROM r""",

    "thread_nest": duck_cte("v_threads").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _path_cte(_KEPT) + """
SELECT conv_id, turn, CAST(depth AS BIGINT) AS depth, path FROM r""",

    "comment_recount": duck_cte("v_threads").replace("WITH ", "WITH RECURSIVE ", 1) + "," + PRUNE_CTE + """,
k AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
p AS (SELECT conv_id, count(*) AS api_n FROM v_threads GROUP BY conv_id)
SELECT p.conv_id, p.api_n, CASE WHEN p.conv_id % 10 <> 5 THEN coalesce(k.n, 0) ELSE p.api_n END AS kept_n
FROM p LEFT JOIN k ON p.conv_id = k.conv_id""",

    "media_type": duck_cte("v_media") + """
SELECT doc_id, CASE
  WHEN branch = 1 AND doc_id % 4 <> 3 THEN 'link'
  WHEN branch = 2 AND doc_id % 3 <> 0 THEN 'multi'
  WHEN branch = 2 THEN 'gallery'
  WHEN branch = 3 THEN 'gif'
  WHEN branch = 4 THEN 'video'
  WHEN branch = 5 AND doc_id % 2 = 1 THEN 'image'
  WHEN branch = 6 THEN 'gallery'
  ELSE 'none' END AS media_type
FROM v_media""",

    "media_sort": duck_cte("v_assets") + """,
t AS (SELECT post_id, CASE post_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'link' WHEN 2 THEN 'gif' ELSE 'gallery' END
             AS media_type, count(*) FILTER (WHERE ord > 0) AS n_all FROM v_assets GROUP BY post_id),
kept AS (SELECT post_id, height, width, url,
                row_number() OVER (PARTITION BY post_id ORDER BY height, ord) - 1 AS res_ord
         FROM v_assets WHERE ord > 0 AND url <> ''),
nk AS (SELECT post_id, count(*) AS k FROM kept GROUP BY post_id),
rows AS (
  SELECT kept.post_id, kept.res_ord, kept.height, kept.width, kept.url, false AS is_source FROM kept
  UNION ALL
  SELECT a.post_id, coalesce(nk.k, 0), a.height, a.width, a.url, true
  FROM v_assets a JOIN t ON a.post_id = t.post_id LEFT JOIN nk ON a.post_id = nk.post_id
  WHERE a.ord = 0 AND a.url <> '' AND t.media_type <> 'gif')
SELECT rows.post_id, t.media_type, CAST(0 AS BIGINT) AS item_ord, CAST(rows.res_ord AS BIGINT) AS res_ord,
       rows.height, rows.width, rows.url, rows.is_source,
       md5(CAST(rows.post_id AS VARCHAR) || '|0|' || CAST(rows.res_ord AS VARCHAR)) AS asset_id
FROM rows JOIN t ON rows.post_id = t.post_id
WHERE t.n_all > 0 OR t.media_type = 'link'""",

    "media_multi": duck_cte("v_assets") + """
SELECT post_id, count(DISTINCT tag) AS n_tags, count(*) AS n_items FROM v_assets GROUP BY post_id
HAVING count(DISTINCT tag) >= 2""",

    "member_set": duck_cte("v_posts") + """
SELECT community_key AS community, replace(author_fullname, 't2_', '') AS user_id, author AS name
FROM v_posts WHERE author <> '[deleted]' AND author <> '' AND replace(author_fullname, 't2_', '') <> ''
UNION
SELECT c_nationkey, CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE c_name <> ''""",

    "members_join": duck_cte("v_communities", "v_posts") + """,
c AS (SELECT replace(raw_id, 't5_', '') AS community_id FROM v_communities WHERE community_type <> 'private'),
m AS (SELECT CAST(c_nationkey AS VARCHAR) AS community_id, CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name,
             0 AS prio, c_custkey AS ord FROM customer),
o AS (SELECT replace(subreddit_id, 't5_', '') AS community_id, replace(author_fullname, 't2_', '') AS user_id,
             CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN author || '_old' ELSE author END AS name, 1 AS prio,
             CAST(id AS BIGINT) AS ord
      FROM v_posts WHERE author <> '[deleted]' AND author <> ''),
u AS (SELECT u.* FROM (SELECT * FROM m UNION ALL SELECT * FROM o) u JOIN c ON u.community_id = c.community_id),
last_mod AS (SELECT user_id, name FROM (SELECT *, row_number() OVER (
               PARTITION BY user_id ORDER BY community_id DESC, ord DESC, name DESC) AS rn FROM u WHERE prio = 0) WHERE rn = 1),
first_seen AS (SELECT user_id, name FROM (SELECT *, row_number() OVER (
               PARTITION BY user_id ORDER BY community_id, ord, name) AS rn FROM u WHERE prio = 1) WHERE rn = 1),
k AS (SELECT u.community_id, u.user_id, u.prio, u.ord,
             CASE WHEN u.prio = 0 THEN u.name ELSE coalesce(l.name, f.name) END AS name
      FROM u LEFT JOIN last_mod l ON l.user_id = u.user_id LEFT JOIN first_seen f ON f.user_id = u.user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY community_id, name ORDER BY prio, ord, user_id) AS rn FROM k)
SELECT community_id AS community, user_id, name, prio = 0 AS is_moderator FROM r WHERE rn = 1""",

    "users_table": duck_cte("v_members") + """,
u AS (SELECT user_id, community, 0 AS prio FROM v_members WHERE is_moderator
      UNION ALL SELECT user_id, community, 1 AS prio FROM v_members),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prio,
        CASE WHEN prio = 0 THEN community END DESC NULLS LAST,
        CASE WHEN prio = 1 THEN community END ASC NULLS LAST) AS rn FROM u),
b AS (SELECT user_id, community, prio,
        1136073600 + """ + _seed("user_id", "cake") + """ % (1704067199 - 1136073600 + 1) AS cake,
        '#' || substr(md5(CAST(user_id AS VARCHAR) || 'key'), 1, 6) AS keycolor,
        md5(CAST(user_id AS VARCHAR) || 'primary') AS h2,
        '#' || substr(md5(CAST(user_id AS VARCHAR) || 'icon'), 1, 6) AS iconcolor
      FROM w WHERE rn = 1)
SELECT CASE WHEN prio = 0 THEN 'moderator' ELSE 'member' END AS source, community, user_id,
  'user' || CAST(user_id AS VARCHAR) AS name, cake AS cake_day_utc, """ + _d2("cake") + """ AS cake_day_human,
  CAST((""" + str(AS_OF) + """ - cake) // 31536000 AS VARCHAR) || 'yr(s)' AS age, keycolor,
  CASE WHEN '#' || substr(h2, 1, 6) = keycolor THEN '#' || substr(h2, 7, 6) ELSE '#' || substr(h2, 1, 6) END
    AS primarycolor,
  iconcolor, false AS over18, false AS suspended, true AS is_synthetic
FROM b""",

    "dedup_first": """
SELECT min(doc_id) AS doc_id FROM documents GROUP BY text""",

    "catalog_distinct": """
SELECT DISTINCT p_brand, p_type, p_size FROM part""",

    "curated_array": """
SELECT c_custkey, '}"{[\\' || c_name || 'é]' AS title,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord FROM customer""",

    "union_dedup": """
WITH u AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, 'ds_a' AS from_set FROM documents WHERE doc_id % 3 <> 0
  UNION ALL
  SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN '' ELSE CAST(doc_id AS VARCHAR) END, 'ds_b'
  FROM documents WHERE doc_id % 3 <> 1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY from_set, doc_id) AS rn FROM u WHERE id <> '')
SELECT doc_id, from_set FROM r WHERE rn = 1""",

    "merge_children": """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS post_id,
  CASE WHEN l_orderkey % 3 = 0 THEN 'b' ELSE 'a' END || CAST(l_linenumber AS VARCHAR) AS body
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",

    "landing_stage": """
WITH a AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS key, s_suppkey % 3 = 0 AS again, s_suppkey % 11 = 2 AS broken,
                  s_suppkey % 7 = 1 AS page FROM supplier)
SELECT key, 'ok' AS kind, CASE WHEN again THEN 'b' ELSE 'a' END || key AS text FROM a WHERE again OR NOT (broken OR page)
UNION ALL SELECT NULL, 'reject', 'broken ' || key FROM a WHERE broken
UNION ALL SELECT key, 'reject', 'payload does not parse: <html>' || key FROM a WHERE page AND NOT broken""",

    "split_position": """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer)
SELECT CASE WHEN pos <= n // 2 THEN 1 ELSE 2 END AS part, count(*) AS n, min(c_custkey) AS min_key,
       max(c_custkey) AS max_key
FROM r GROUP BY 1""",

    "html_rows": """
WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h,
                  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
SELECT page_id, unnest(range(len(h))) AS ord, unnest(h) AS href, unnest(t) AS text FROM m""",

    "html_sections": """
WITH s AS (SELECT page_id, string_split(regexp_replace(html, '<(nav|article|footer)([\\s>])', chr(1) || '<\\1\\2', 'g'),
                                      chr(1)) AS parts FROM pages),
c AS (SELECT page_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS chunk FROM s),
k AS (SELECT page_id, pos, regexp_extract(chunk, '^<(nav|article|footer)[\\s>]', 1) AS section,
             len(regexp_extract_all(chunk, '<(li|p)[\\s>]')) AS n_items FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY page_id, section ORDER BY pos DESC) AS rn FROM k WHERE section <> '')
SELECT page_id, section, CAST(n_items AS BIGINT) AS n_items FROM w WHERE rn = 1""",

    "html_table": """
SELECT p_partkey, 'award' AS kind, CAST(1 AS BIGINT) AS ord, p_name || ' café' AS title, CAST(NULL AS VARCHAR) AS description,
       '//i.test/' || CAST(p_partkey AS VARCHAR) || '.png' AS image_link FROM part
UNION ALL
SELECT p_partkey, 'award', 2, 'inner ’', NULL, '//i.test/in.png' FROM part, range(2) WHERE p_partkey % 5 = 0
UNION ALL
SELECT p_partkey, 'trophy', 1, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ’…' END,
       CASE WHEN p_partkey % 2 = 0 THEN p_type || ' ’…' ELSE p_name || ' ’…' END,
       'https://i.test/' || CAST(p_partkey AS VARCHAR) || '.png' FROM part""",

    "text_rewrite": """
WITH t AS (SELECT doc_id, replace(""" + _rewrite("coalesce(text, '')", TEXT_MAP) + """, '&amp;', '&') AS t
           FROM documents)
SELECT doc_id, md5(t) AS md5, CAST(length(t) AS BIGINT) AS n_chars FROM t""",

    "nested_rewrite": """
SELECT p_brand, p_partkey // 100 AS bucket,
  string_agg(""" + _rewrite("p_name", NAME_MAP) + """ || ' <é’…', '|' ORDER BY p_partkey) AS names
FROM part GROUP BY 1, 2""",

    "entity_decode": """
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')) AS md5 FROM pages""",

    "url_clean": """
WITH e AS (SELECT page_id, url FROM pages)
SELECT page_id, CASE page_id % 3
  WHEN 0 THEN url_decode(regexp_extract('""" + MEDIA_REDIRECT_MARKER + """?url=' || """ + _ENC + """ || '&s=abc',
                                        '=([^&]+)', 1))
  WHEN 1 THEN url_decode(replace(replace(url, '&', '&amp;') || '%20x', '&amp;', '&')) || 'é…’¬it;©'
  ELSE url_decode(url) END AS url
FROM e""",

    "id_strip": duck_cte("v_posts") + """
SELECT id, replace(CASE WHEN author_fullname LIKE '%7' THEN author_fullname || 't2_x' ELSE author_fullname END,
                   't2_', '') AS author_id,
       replace(subreddit_id, 't5_', '') AS community_id FROM v_posts""",

    "human_date": """
WITH u AS (
  SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE """ + _epoch("o_orderdate") + """ END AS e FROM orders
  UNION ALL
  SELECT 'e' || CAST(event_id AS VARCHAR), """ + _epoch("ts") + """ FROM events)
SELECT id, """ + _d1("e") + " AS d1, " + _d2("e") + """ AS d2 FROM u""",

    "age_years": """
SELECT o_orderkey AS id, CAST((""" + str(AS_OF) + " - " + _epoch("o_orderdate") + """) // 31536000 AS VARCHAR) || 'yr(s)'
  AS age FROM orders""",

    "human_count": duck_cte("v_communities") + """,
u AS (SELECT 'c' || raw_id AS id, subscribers AS x FROM v_communities
      UNION ALL
      SELECT 'o' || CAST(o_orderkey AS VARCHAR), CAST(floor(o_totalprice) AS BIGINT) *
             CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 7 END FROM orders
      UNION ALL
      SELECT 'p' || CAST(p_partkey AS VARCHAR), CAST(p_partkey AS BIGINT) * 1000000000 + 14999999 FROM part)
SELECT id, """ + _human_count("x") + """ AS text FROM u""",

    "seeded_pick": """
WITH c AS (SELECT c_custkey AS key, md5(CAST(c_custkey AS VARCHAR) || 'primary') AS h2,
                  '#' || substr(md5(CAST(c_custkey AS VARCHAR) || 'key'), 1, 6) AS color FROM customer)
SELECT key, 1 + """ + _seed("key", "n") + """ % 100 AS n, color,
  CASE WHEN '#' || substr(h2, 1, 6) = color THEN '#' || substr(h2, 7, 6) ELSE '#' || substr(h2, 1, 6) END AS color2,
  '#' || substr(md5(CAST(key AS VARCHAR) || 'icon'), 1, 6) AS icon,
  [""" + ", ".join(_q(x) for x in PICK_LIST) + "][1 + " + _seed("key", "pick") + f""" % {len(PICK_LIST)}] AS pick
FROM c""",

    "seeded_sample": """
WITH cat AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS idx FROM region),
n AS (SELECT count(*) AS n FROM region),
s AS (SELECT c_custkey AS key, least(""" + _seed("c_custkey", "k") + """ % 4, n.n) AS k,
             """ + _seed("c_custkey", "start") + """ AS st, n.n AS n FROM customer, n),
slots AS (SELECT s.key, t.j, (s.st + t.j) % s.n AS idx FROM s JOIN (SELECT range AS j FROM range(0, 3)) t ON t.j < s.k)
SELECT s.key, coalesce(string_agg(cat.r_name, '|' ORDER BY slots.j), '') AS picks
FROM s LEFT JOIN slots ON s.key = slots.key LEFT JOIN cat ON cat.idx = slots.idx GROUP BY s.key""",

    "top_deep": """
SELECT l_returnflag, rn, l_extendedprice, l_orderkey, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag
         ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn <= 5000""",

    "child_pages": """
WITH r AS (SELECT o_orderstatus, o_orderkey,
                  (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 500 AS page FROM orders)
SELECT o_orderstatus, CAST(page AS BIGINT) AS page, count(*) AS n,
       md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS keys_md5
FROM r WHERE o_orderstatus IS NOT NULL GROUP BY ALL""",

    "topic_map_file": """
WITH t AS (SELECT 'Café ' || p_partkey AS category, [p_name, p_type] AS topics FROM part)
SELECT category, CAST(unnest([0, 1]) AS BIGINT) AS ord, unnest(topics) AS topic FROM t""",

    "gallery_ids": duck_cte("v_assets") + """,
g AS (SELECT * FROM v_assets WHERE post_id % 4 = 3),
kept AS (SELECT post_id, height, width, url, row_number() OVER (PARTITION BY post_id ORDER BY height, ord) - 1 AS res_ord
         FROM g WHERE ord > 0 AND url <> ''),
n AS (SELECT post_id, count(*) AS n FROM kept GROUP BY post_id),
a AS (SELECT * FROM kept UNION ALL
      SELECT g.post_id, g.height, g.width, g.url, coalesce(n.n, 0) FROM g LEFT JOIN n ON g.post_id = n.post_id
      WHERE g.ord = 0 AND g.url <> '' AND EXISTS (SELECT 1 FROM g h WHERE h.post_id = g.post_id AND h.ord > 0))
SELECT post_id, CAST(0 AS BIGINT) AS item_ord, CAST(res_ord AS BIGINT) AS res_ord,
       md5(concat_ws('|', CAST(post_id AS VARCHAR), '0', CAST(res_ord AS VARCHAR))) AS id, height, width, url FROM a""",

    "user_columns": """
WITH u AS (SELECT c_custkey AS id, c_name AS name, """ + _seed("c_custkey", "description") + """ % 4 + 1 AS p,
             """ + _seed("c_custkey", "trophies-k") + """ % 4 AS k, """ + _seed("c_custkey", "trophies") + """ AS st FROM customer),
n AS (SELECT count(*) AS n FROM region),
cat AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS idx FROM region),
s AS (SELECT u.id, t.j, (u.st + t.j) % n.n AS idx FROM u JOIN (SELECT range AS j FROM range(0, 3)) t ON t.j < u.k JOIN n ON true),
picks AS (SELECT s.id, string_agg(cat.r_name, '|' ORDER BY s.j) AS trophies FROM s JOIN cat ON cat.idx = s.idx GROUP BY s.id)
SELECT u.id, u.name, 'https://a.test/' || md5(CAST(u.id AS VARCHAR) || 'avatar') || '.png' AS avatar_img, '' AS banner_img,
  (['alpha', 'beta', 'gamma', 'delta'])[p] AS public_description, coalesce(picks.trophies, '') AS trophies
FROM u LEFT JOIN picks ON picks.id = u.id""",

    "community_search": """
WITH r AS (SELECT n_name, s.*, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS pos
           FROM supplier s JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name AS topic, pos, CAST(s_suppkey AS VARCHAR) AS id, 'r/' || s_name AS title,
  CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_name ELSE '' END AS public_description, CAST(s_suppkey AS BIGINT) AS subscribers
FROM r WHERE s_suppkey % 5 <> 0""",

    "request_files": """
SELECT s_name AS title, CASE WHEN s_suppkey % 3 <> 0 THEN 't' END AS topic, CAST(s_suppkey % 7 AS INTEGER) AS posts_count
FROM supplier""",

    "topic_folders": """
SELECT n_name AS topic, s_name AS title, true AS in_order FROM supplier JOIN nation ON s_nationkey = n_nationkey""",

    "rule_rows": """
SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord, p_name AS short_name,
  replace(""" + _rewrite("p_type || ' the ' || p_name", TEXT_MAP) + """, '&amp;', '&') AS description
FROM part""",
}
