"""DuckDB SQL of the operators that SQL can express."""

LINE_DEDUP = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS first_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.first_doc AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

WARC = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body, chr(13) || chr(10) AS nl FROM pages
), s AS (
  SELECT *, md5('response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || url) AS h,
    'sha1:' || sha1(body) AS payload_digest, CAST(strlen(body) AS VARCHAR) AS n,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<!--.*?-->', ' ', 'gs'),
      '<script\b[^>]*>.*?</script\s*>', ' ', 'gsi'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gsi'),
      '<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'gsi'), '<head\b[^>]*>.*?</head\s*>', ' ', 'gsi') AS t0
  FROM r
), u AS (
  SELECT *, '<urn:uuid:' || concat_ws('-', substr(h,1,8), substr(h,9,4), substr(h,13,4), substr(h,17,4), substr(h,21,12)) || '>' AS refers_to,
    regexp_replace(regexp_replace(t0, '<(br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS t1
  FROM s
), v AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(t1, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t2 FROM u
), w AS (
  SELECT *, trim(regexp_replace(regexp_replace(t2, '[ \t\r\x0b\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM v
), k AS (
  SELECT page_id, refers_to, url AS target_uri, payload_digest, 'conversion' AS record_type, text AS block FROM w
  UNION ALL
  SELECT page_id, refers_to, url, payload_digest, 'metadata', 'sourceStatus: HTTP/1.1 200 OK' || nl
    || 'sourceHeader: Content-Type: text/html; charset=utf-8' || nl || 'sourceHeader: Content-Length: ' || n || nl
    || 'sourceMediaType: text/html; charset=utf-8' || nl || 'sourceLength: ' || n || nl || 'sourceDigest: ' || payload_digest || nl FROM w
), m AS (SELECT *, md5(record_type || chr(10) || refers_to) AS g FROM k), n AS (
  SELECT page_id, record_type, refers_to, target_uri, payload_digest, block, 'sha1:' || sha1(block) AS block_digest,
    '<urn:uuid:' || concat_ws('-', substr(g,1,8), substr(g,9,4), substr(g,13,4), substr(g,17,4), substr(g,21,12)) || '>' AS record_id,
    CAST(strlen(block) AS BIGINT) AS content_length, chr(13) || chr(10) AS nl
  FROM m
)
SELECT page_id, record_type, refers_to, target_uri, payload_digest, block, block_digest, record_id, content_length,
  'WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || refers_to || nl
  || 'WARC-Target-URI: ' || target_uri || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || 'WARC-Source-Payload-Digest: ' || payload_digest || nl
  || 'WARC-Block-Digest: ' || block_digest || nl || 'Content-Type: ' || CASE record_type WHEN 'metadata' THEN 'application/warc-fields' ELSE 'text/plain' END
  || nl || 'Content-Length: ' || CAST(content_length AS VARCHAR) || nl || nl || block || nl || nl AS record
FROM n
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEAR_VECTORS = """
WITH RECURSIVE k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, low) AS component_id, coalesce(e.vec_id = least(e.vec_id, low), true) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

# trees are numbered: 1, 2, ... the groups by lang, 0 the tree of their roots; crc32 is worked out bit by bit (its fixed polynomial: 3988292384)
MERKLE = """
WITH RECURSIVE h AS (
  SELECT doc_id, text, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS fields,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), d AS (
  SELECT doc_id, tree, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(fields || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(fields || coalesce(strlen(text) || ':' || text, '-')) END AS shown
  FROM h
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), sub(tree, level, pos, node, n) AS (
  SELECT tree, 0, pos, leaf, n FROM p
  UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM sub WHERE n > 1 GROUP BY tree, level, pos // 8
), s AS (SELECT tree, node AS subroot, level AS height FROM sub WHERE n = 1), top(level, pos, node, n) AS (
  SELECT 0, tree - 1, subroot, count(*) OVER () FROM s
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8
), nodes AS (SELECT tree, level, pos, node FROM sub WHERE n > 1 UNION ALL SELECT 0, level, pos, node FROM top WHERE n > 1),
own AS (
  SELECT tree, pos, tree AS in_tree, level, pos // CAST(8 ** level AS BIGINT) AS slot, level AS step FROM p JOIN (SELECT DISTINCT tree, level FROM sub WHERE n > 1) USING (tree)
  UNION ALL SELECT tree, pos, 0, level, (tree - 1) // CAST(8 ** level AS BIGINT), height + level FROM p JOIN s USING (tree), (SELECT DISTINCT level FROM top WHERE n > 1)
), steps AS (
  SELECT own.tree, own.pos, step, coalesce(string_agg(node, '' ORDER BY x.pos) FILTER (WHERE x.pos < slot), '') AS lefts,
    coalesce(string_agg(node, '' ORDER BY x.pos) FILTER (WHERE x.pos > slot), '') AS rights
  FROM own JOIN nodes x ON x.tree = in_tree AND x.level = own.level AND x.pos // 8 = slot // 8 GROUP BY ALL
), fold(tree, pos, step, node) AS (
  SELECT tree, pos, 0, shown FROM p
  UNION ALL SELECT f.tree, f.pos, f.step + 1, sha256(lefts || node || rights) FROM fold f JOIN steps t ON t.tree = f.tree AND t.pos = f.pos AND t.step = f.step
), up AS (SELECT tree, pos, arg_max(node, step) AS folded_root FROM fold GROUP BY tree, pos),
proof AS (SELECT tree, pos, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY tree, pos)
SELECT doc_id, leaf, subroot, t.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.node AS verified
FROM p JOIN s USING (tree) JOIN up USING (tree, pos) LEFT JOIN proof USING (tree, pos), (SELECT node FROM top WHERE n = 1) t
"""

ORACLES = {
    "op1_line_dedup": LINE_DEDUP,
    "op3_warc": WARC,
    "op6_top_k": TOP_K,
    "op11_near_vectors": NEAR_VECTORS,
    "op13_merkle_manifest": MERKLE,
}
