"""DuckDB SQL of the queries that SQL can express, over whole tables and by brute force.

The others have none: models and tokenizers aren't SQL, nor is the crc32 of whole texts.
"""

from __future__ import annotations

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
nodes AS (SELECT array_to_string(w, ' ') AS node, any_value(w) AS w, min(doc_id) AS rep, count(*) AS copies
          FROM d WHERE len(w) > 0 GROUP BY 1),
grams AS (SELECT DISTINCT rep, array_to_string(w[i:i+4], ' ') AS g
          FROM (SELECT rep, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM nodes)),
sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n
           FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.rep = c.a JOIN sizes y ON y.rep = c.b
          WHERE 5 * c.n >= 4 * (x.n + y.n - c.n)),
reach AS (SELECT rep AS a, rep AS b FROM nodes
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT l.a AS rep, sum(n.copies) AS docs, count(*) AS texts
           FROM links l JOIN nodes n ON n.rep = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id,
       CAST(coalesce(k.docs, 0) + coalesce(n.copies, 1) - 1 AS BIGINT) AS n_links,
       CAST(coalesce(k.texts, 0) AS BIGINT) AS n_texts
FROM d LEFT JOIN nodes n ON n.node = array_to_string(d.w, ' ') AND len(d.w) > 0
LEFT JOIN classes c ON c.rep = n.rep LEFT JOIN counts k ON k.rep = n.rep
"""

TOPK_SEARCH = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
WHERE rank <= 20
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i+9], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT row_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g
          FROM (SELECT row_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN lengths ON len(w) >= k)),
hits AS (SELECT row_id, i, k, item_id FROM grams JOIN windows USING (k, g)),
words AS (SELECT row_id, count(DISTINCT p) AS n_hit
          FROM (SELECT row_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT row_id, i, k FROM hits)) GROUP BY row_id),
found AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN found USING (row_id)
"""


# The rules' patterns. The first is matched on the text with A-Z lower-cased.
_RULES = (
    ("assign", "low", r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)""", 2, 6),
    ("access", "t", r"AKIA[A-Z0-9]{16,}", 0, 1),
    ("hex", "t", r"[0-9a-f]{24,}", 0, 1),
    ("pem", "t", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("jwt", "t", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1),
    ("hub", "t", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)


def _matches(k: int, name: str, column: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT row_id, {k} AS k, '{name}' AS rule, len(h) AS n, ends - len(h) AS s, ends AS e FROM (
    SELECT row_id, h, v, sum(len(h) + len(g)) OVER (PARTITION BY row_id ORDER BY i) AS ends FROM (
      SELECT row_id, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h, unnest(vs) AS v, unnest(gs[1:len(hs)]) AS g FROM (
        SELECT row_id, regexp_extract_all({column}, '{pattern}') AS hs, regexp_extract_all({column}, '{pattern}', {group}) AS vs,
               string_split_regex({column}, '{pattern}') AS gs
        FROM d WHERE regexp_matches({column}, '{pattern}'))))
  WHERE len(v) >= {least}"""


SECRET_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
found AS ({" UNION ALL ".join(_matches(k, *r) for k, r in enumerate(_RULES))}),
spans AS (SELECT *, rule || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS span FROM found),
digest AS (SELECT row_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                  string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
           FROM spans GROUP BY row_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN digest USING (row_id)
"""

def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a short ASCII text, bit by bit."""
    step = "CASE WHEN bits & 1 = 1 THEN xor(bits >> 1, 3988292384) ELSE bits >> 1 END"
    byte = f"list_reduce(range(8), lambda bits, unused: {step}, xor(crc, code))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda place: ascii(substr({text}, place, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda crc, code: {byte}, 4294967295::BIGINT), 4294967295)"


CONVERSATION_TRIE = f"""
WITH turns AS (
  SELECT conv_id::BIGINT c, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, sha256(length(r)::VARCHAR || ':' || r || x) t, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) w,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, sha256(length(r)::VARCHAR || ':' || r || x)) p FROM turns),
convs AS (SELECT c, {_crc32('CAST(c AS VARCHAR)')} % 4 h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT c, p, t, w FROM own JOIN convs USING (c) WHERE p > h
  UNION ALL SELECT convs.c, p, t, w FROM convs JOIN own ON own.c = convs.c - (convs.c % 20 + 20) % 20 AND p <= h),
prefixes AS (
  SELECT c, list(t) OVER up k, w, lead(p) OVER (PARTITION BY c ORDER BY p) IS NULL ends FROM rebuilt
  WINDOW up AS (PARTITION BY c ORDER BY p)
  UNION ALL SELECT c, [], 0, c NOT IN (SELECT c FROM rebuilt) FROM convs),
nodes AS (
  SELECT k, min(c) conv_id, len(k) depth, count(*) n_convs, (count(*) - 1) * max(w) saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) ends_sha256 FROM prefixes GROUP BY k),
kids AS (SELECT k[:-2] k, count(*) n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (SELECT nodes.k[1:d] k, saved, kids.n IS NULL leaf FROM nodes LEFT JOIN kids USING (k), unnest(range(0, depth + 1)) u(d)),
totals AS (SELECT k, sum(saved)::BIGINT saved_tokens, (count(*) FILTER (WHERE leaf))::BIGINT n_leaves FROM above GROUP BY k)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes JOIN totals USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes up ON nodes.depth > 0 AND up.k = nodes.k[:-2]
"""


def _vector_codes(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Full search in every round over single components."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT row, part, min(d * {entries} + entry) best FROM (
    SELECT x.row, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT d
    FROM comp x JOIN book{n} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL) GROUP BY row, part)""")
        if n < rounds:
            steps.append(f"""book{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) v FROM book{n} b LEFT JOIN (
    SELECT x.part, best % {entries} entry, x.pos, (sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*))::BIGINT // count(*) v
    FROM comp x JOIN near{n} USING (row, part) GROUP BY ALL) m USING (part, entry, pos))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
size AS (SELECT greatest(1, ceil(max(len(embedding)) / {parts}.0)::BIGINT) width FROM kept),
comp AS MATERIALIZED (
  SELECT row, i // width part, i % width pos, coalesce(floor(1024 * embedding[i + 1]::DOUBLE), 0)::BIGINT v
  FROM kept, size, unnest(range(0, width * {parts})) u(i)),
book0 AS MATERIALIZED (SELECT part, row entry, pos, v FROM comp WHERE row < {entries}),
{(',' + chr(10)).join(steps)},
coded AS (
  SELECT row, string_agg(lpad(lower(hex(best % {entries})), 2, '0'), '' ORDER BY part) code, sum(best // {entries})::BIGINT error
  FROM near{rounds} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (row)
"""


ORACLE: dict[str, str] = {
    "op1_ngram_join": NGRAM_JOIN,
    "op2_topk_search": TOPK_SEARCH,
    "op4_decontamination": DECONTAMINATION,
    "op7_secret_scan": SECRET_SCAN,
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op13_vector_codes": _vector_codes(),
}
