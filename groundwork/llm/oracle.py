"""DuckDB SQL for the registered text queries that SQL can express."""

from __future__ import annotations

from .sharding import BITS, SHARD_BYTES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

OP4 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord
  FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((ord - 1) % 3 + 1)::BIGINT] AS weight, 2 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT ratio AS f_ratio, level AS f_level FROM l WHERE ratio >= level ORDER BY ratio, ord LIMIT 1),
t AS (
  SELECT l.source, ord, source_size, budget,
         CASE WHEN f_ratio IS NULL OR ratio < f_ratio THEN cap::DOUBLE ELSE f_level * weight END AS target
  FROM l LEFT JOIN f ON true),
q AS (
  SELECT doc_id, size, ord, source_size, target, budget,
         (sum(size) OVER (PARTITION BY ord ORDER BY key, size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (
  SELECT doc_id, size, ord, budget, cum + rep * source_size AS cum,
         (cum + rep * source_size)::DOUBLE / target AS finish
  FROM q, (VALUES (0), (1)) v(rep) WHERE size > 0),
o AS (
  SELECT doc_id, size, budget, sum(size) OVER (ORDER BY finish, ord, cum ROWS UNBOUNDED PRECEDING) AS run FROM i),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM o WHERE run <= budget GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h,
         octet_length(encode(coalesce(text, '')))::BIGINT AS bytes FROM documents),
p AS (SELECT doc_id, bytes, depth, h >> ({BITS} - depth)::INT AS prefix FROM d, range(0, {BITS} + 1) r(depth)),
s AS (SELECT depth, prefix, count(*) AS shard_rows, sum(bytes)::BIGINT AS shard_bytes FROM p GROUP BY ALL),
m AS (
  SELECT doc_id, p.depth, p.prefix, shard_rows, shard_bytes,
         row_number() OVER (PARTITION BY doc_id ORDER BY p.depth) AS place
  FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix
  WHERE shard_bytes <= {SHARD_BYTES} OR p.depth = {BITS})
SELECT doc_id, CASE WHEN depth = 0 THEN 'all' ELSE right(lpad(bin(prefix), {BITS}, '0'), depth::INT) END AS shard,
       depth::INT AS shard_depth, shard_rows, shard_bytes, shard_bytes <= {SHARD_BYTES} AS shard_fits
FROM m WHERE place = 1
"""

OP10 = """
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
z AS (
  SELECT conv_id, max(turn) AS last_turn FROM t WHERE role = 'assistant' GROUP BY conv_id),
l AS (
  SELECT t.conv_id, last_turn, max(text) AS last_text FROM t JOIN z ON t.conv_id = z.conv_id AND turn = last_turn
  WHERE role = 'assistant' GROUP BY ALL),
n AS (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS next_id FROM (SELECT DISTINCT conv_id FROM t)),
w AS (
  SELECT l.*, coalesce(o.last_text, '') AS other
  FROM l JOIN n ON n.conv_id = l.conv_id LEFT JOIN l o ON o.conv_id = n.next_id),
b AS (
  SELECT t.conv_id, turn, role, text, 'c' AS side FROM t
  UNION ALL
  SELECT t.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last_turn AND text = last_text THEN other ELSE text END, 'r'
  FROM t LEFT JOIN w ON w.conv_id = t.conv_id),
c AS (
  SELECT conv_id, turn, role, text, count(*) FILTER (side = 'c') AS nc, count(*) FILTER (side = 'r') AS nr
  FROM b GROUP BY ALL),
f AS (SELECT conv_id, min(turn) AS split FROM c WHERE nc <> nr GROUP BY conv_id),
p AS (
  SELECT c.conv_id, 'prompt' AS part, turn, role, text, nc AS copies FROM c LEFT JOIN f ON c.conv_id = f.conv_id
  WHERE split IS NULL OR turn < split
  UNION ALL
  SELECT c.conv_id, 'chosen', turn, role, text, nc FROM c JOIN f ON c.conv_id = f.conv_id WHERE turn >= split AND nc > 0
  UNION ALL
  SELECT c.conv_id, 'rejected', turn, role, text, nr FROM c JOIN f ON c.conv_id = f.conv_id WHERE turn >= split AND nr > 0)
SELECT conv_id, part, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS trained, copies
FROM p
"""

_VALUE = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_FIELDS = [_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
_COPY = _VALUE.format("(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")

OP13 = f"""
WITH RECURSIVE
bits AS (
  SELECT i AS byte, 0 AS k, i AS c FROM range(256) r(i)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT byte, c FROM bits WHERE k = 8),
crc AS (
  SELECT DISTINCT doc_id, 1 AS pos, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, pos + 1, xor(crc.c >> 8, t.c)
  FROM crc JOIN crc_table t ON t.byte = xor(crc.c, ascii(substr(doc_id::VARCHAR, pos, 1))) & 255
  WHERE pos <= length(doc_id::VARCHAR)),
even AS (SELECT doc_id, xor(c, 4294967295) % 2 = 0 AS even FROM crc WHERE pos = length(doc_id::VARCHAR) + 1),
d AS (
  SELECT row_number() OVER () AS rid, documents.*, coalesce(even, false) AS even
  FROM documents LEFT JOIN even ON documents.doc_id = even.doc_id),
l AS (
  SELECT rid, doc_id, source, sha256({" || ".join([*_FIELDS, _VALUE.format("text")])}) AS leaf,
         sha256({" || ".join([*_FIELDS, _COPY])}) AS copy FROM d),
o AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n FROM l),
nodes AS (
  SELECT tree, 0 AS lvl, place AS idx, n, leaf AS hash FROM o
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, n, idx // 3),
subroots AS (SELECT tree, hash FROM nodes WHERE n = 1),
above AS (
  SELECT 0 AS lvl, tree AS idx, count(*) OVER () AS n, hash FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx))
  FROM above WHERE n > 1 GROUP BY lvl, n, idx // 3),
everything AS (
  SELECT tree, lvl, idx, n, hash FROM nodes UNION ALL SELECT -1, lvl, idx, n, hash FROM above),
sides AS (
  SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft,
         coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM everything a JOIN everything b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
  WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.idx),
way AS (
  SELECT rid, s.lvl, lft, rgt FROM o JOIN sides s ON s.tree = o.tree AND s.idx = o.place // pow(3, s.lvl)::BIGINT
  UNION ALL
  SELECT rid, 1000 + s.lvl, lft, rgt FROM o JOIN sides s ON s.tree = -1 AND s.idx = o.tree // pow(3, s.lvl)::BIGINT),
steps AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS k FROM way),
fold AS (
  SELECT rid, 0::BIGINT AS k, copy AS h FROM o
  UNION ALL
  SELECT fold.rid, fold.k + 1, sha256(lft || h || rgt) FROM fold JOIN steps ON steps.rid = fold.rid AND steps.k = fold.k + 1),
proofs AS (SELECT rid, max(k) AS k, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof FROM steps GROUP BY rid)
SELECT doc_id, leaf, subroots.hash AS subroot, top.hash AS root, coalesce(proof, sha256('')) AS proof_sha256,
       h AS folded_root, h = top.hash AS verified
FROM o JOIN subroots ON subroots.tree = o.tree JOIN (SELECT hash FROM above WHERE n = 1) top ON true
LEFT JOIN proofs ON proofs.rid = o.rid
JOIN fold ON fold.rid = o.rid AND fold.k = coalesce(proofs.k, 0)
"""

ORACLE: dict[str, str] = {
    "op3_exact_dedup": OP3,
    "op4_source_mixing": OP4,
    "op5_extendible_sharding": OP5,
    "op10_preference_format": OP10,
    "op13_merkle_manifest": OP13,
}
