"""DuckDB statements for the registered queries that SQL can express."""

ORACLE: dict[str, str] = {}

#: Checksums of ASCII strings, which DuckDB has no function for: crc32 by its byte table.
CRC_TABLE = """
  SELECT list(list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
  FROM (SELECT unnest(range(256)) AS b)"""


def crc(text: str) -> str:
    """SQL for the checksum of `text`; `tab` is the column of CRC_TABLE."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length({text}) + 1), lambda q: ord(({text})[q])::BIGINT)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])))"""


ORACLE["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.owner <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLE["op5_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM sized)),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)),
occ AS (SELECT d.doc_id, d.p, d.k, w.item_id FROM dwin d JOIN win w ON d.k = w.k AND d.g = w.g),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op10_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w) - least(3, len(w)) + 2),
    lambda p: array_to_string(w[p : p + least(3, len(w)) - 1], ' ') || ' #' || least(3, len(w)))) AS s
  FROM words WHERE len(w) > 0),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)
  UNION ALL SELECT b, a FROM common WHERE 100 * c >= 90 * (na + nb - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a)
SELECT d.doc_id, coalesce(any_value(len(s.s)), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN sets s USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
"""

ORACLE["op3_preference_pairs"] = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair, conv_id % 2 = 0 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
alike AS (
  SELECT pair, turn, count(*) = 2 AND count(DISTINCT (role, text)) = 1 AS same FROM t GROUP BY pair, turn),
ends AS (SELECT pair, min(turn) FILTER (NOT same) AS first FROM alike GROUP BY pair),
placed AS (
  SELECT t.*, e.first IS NULL OR t.turn < e.first AS before,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS part
  FROM t JOIN ends e USING (pair)),
spans AS (
  SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY pair, side, before ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS s FROM placed),
joined AS (
  SELECT pair, side, before, string_agg(part, '' ORDER BY turn) AS body, count(*) AS n,
    coalesce(string_agg(s || '-' || (s + length(text)), ',' ORDER BY turn) FILTER (role = 'assistant'), '') AS mask
  FROM spans GROUP BY pair, side, before),
pairs AS (SELECT pair, bool_or(side) AS yes, bool_or(NOT side) AS no FROM t GROUP BY pair)
SELECT p.pair AS pair_id, coalesce(a.n, 0) AS prompt_turns, sha256(coalesce(a.body, '')) AS prompt_sha256,
  CASE WHEN yes THEN sha256(coalesce(g.body, '')) END AS chosen_sha256,
  CASE WHEN yes THEN coalesce(g.mask, '') END AS chosen_mask,
  CASE WHEN no THEN sha256(coalesce(b.body, '')) END AS rejected_sha256,
  CASE WHEN no THEN coalesce(b.mask, '') END AS rejected_mask
FROM pairs p LEFT JOIN joined a ON a.pair = p.pair AND a.before AND a.side
LEFT JOIN joined g ON g.pair = p.pair AND NOT g.before AND g.side
LEFT JOIN joined b ON b.pair = p.pair AND NOT b.before AND NOT b.side
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op12_merkle_manifest"] = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_HEAD} || {_field("text")}) AS leaf,
    CASE WHEN {crc("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_HEAD} || {_field(_LOWER)}) END AS changed
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS lvl, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 8, n),
subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM tops WHERE n > 1 GROUP BY lvl, i // 8, n),
heights AS (SELECT tree, max(lvl) AS height FROM nodes GROUP BY tree),
ways AS (
  SELECT p.tree, p.doc_id, p.i AS leaf_i, s.lvl,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i // (8 ** s.lvl)::BIGINT), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i // (8 ** s.lvl)::BIGINT), '') AS r
  FROM (SELECT tree, doc_id, i::BIGINT AS i FROM placed) p JOIN nodes s
    ON s.tree = p.tree AND s.n > 1 AND s.i // 8 = (p.i // (8 ** (s.lvl + 1))::BIGINT)
  GROUP BY ALL),
up AS (
  SELECT p.tree, s.lvl,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i // (8 ** s.lvl)::BIGINT), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i // (8 ** s.lvl)::BIGINT), '') AS r
  FROM subroots p JOIN tops s ON s.n > 1 AND s.i // 8 = (p.i // (8 ** (s.lvl + 1))::BIGINT)
  GROUP BY ALL),
steps AS (
  SELECT tree, leaf_i, lvl AS k, l, r FROM ways
  UNION ALL
  SELECT p.tree, p.i, h.height + u.lvl, u.l, u.r FROM placed p JOIN up u USING (tree) JOIN heights h USING (tree)),
proofs AS (
  SELECT tree, leaf_i, string_agg(l || r, '' ORDER BY k) AS proof, list(l ORDER BY k) AS ls, list(r ORDER BY k) AS rs
  FROM steps GROUP BY tree, leaf_i),
fold AS (
  SELECT p.tree, p.i, 0 AS k, coalesce(p.changed, p.leaf) AS h, coalesce(q.ls, []) AS ls, coalesce(q.rs, []) AS rs
  FROM placed p LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_i = p.i
  UNION ALL
  SELECT tree, i, k + 1, sha256(ls[k + 1] || h || rs[k + 1]), ls, rs FROM fold WHERE k < len(ls))
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
  f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots s USING (tree) JOIN tops t ON t.n = 1
LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_i = p.i
JOIN fold f ON f.tree = p.tree AND f.i = p.i AND f.k = len(f.ls)
"""


ORACLE["op13_conversation_repair"] = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT t.*, {crc("k")} % 20 AS kind FROM t, crc),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
    rtrim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS body, left(role, 1) AS ini FROM dam),
jud AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY k) || ini AS pair FROM num),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM jud GROUP BY conv_id),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) m(st, ini, nxt)),
fit AS (SELECT * FROM (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)) f(st, role, nxt)),
dp AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS st, '000000' AS best, []::VARCHAR[] AS lines FROM stats
  UNION ALL
  SELECT conv_id, k + 1, nxt, min(best) AS best, arg_min(lines, best) AS lines
  FROM (
    SELECT e.conv_id, e.k, y.nxt, printf('%06d', left(e.best, 6)::INT + y.cost) || e.best[7:] || y.letter AS best,
      CASE WHEN y.line IS NULL THEN e.lines ELSE list_append(e.lines, y.line) END AS lines
    FROM (
      SELECT conv_id, k, st, best, lines FROM dp
      UNION ALL
      SELECT conv_id, k, f.nxt, printf('%06d', left(best, 6)::INT + 2) || best[7:] || 'I', list_append(lines, f.role || ':')
      FROM dp JOIN fit f USING (st)) e
    JOIN (
      SELECT j.conv_id, j.k, s.st, s.st AS nxt, 3 AS cost, 'D' AS letter, NULL AS line
      FROM jud j, (SELECT unnest(range(4)) AS st) s
      UNION ALL
      SELECT j.conv_id, j.k, m.st, m.nxt, (fault = 'truncated')::INT, 'K', j.role || ':' || j.text
      FROM jud j JOIN moves m ON m.ini = j.ini WHERE fault NOT IN ('blank', 'duplicate')
      UNION ALL
      SELECT j.conv_id, j.k, s.st, s.st, (fault = 'truncated')::INT, 'K', j.role || ':' || j.text
      FROM jud j, (SELECT unnest(range(4)) AS st) s WHERE j.ini = '' AND fault NOT IN ('blank', 'duplicate')
      UNION ALL
      SELECT j.conv_id, j.k, f.st, f.nxt, 2 + (fault = 'truncated')::INT, 'R', f.role || ':' || j.text
      FROM jud j, fit f WHERE fault NOT IN ('blank', 'duplicate')) y
    ON y.conv_id IS NOT DISTINCT FROM e.conv_id AND y.k = e.k + 1 AND y.st = e.st) z
  GROUP BY conv_id, k, nxt),
done AS (
  SELECT d.conv_id, d.st, d.best, d.lines FROM dp d JOIN stats s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND d.k = s.n),
ends AS (
  SELECT conv_id, min(best) AS best, arg_min(lines, best) AS lines
  FROM (
    SELECT conv_id, best, lines FROM done WHERE st IN (0, 3)
    UNION ALL
    SELECT conv_id, printf('%06d', left(best, 6)::INT + 2) || best[7:] || 'I', list_append(lines, 'assistant:')
    FROM done WHERE st = 2) GROUP BY conv_id)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
  coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
  coalesce(left(e.best, 6)::BIGINT, 0) AS cost, coalesce(e.best[7:], '') AS audit,
  sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
