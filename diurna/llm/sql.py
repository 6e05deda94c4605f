"""SQL statements of the queries that SQL can express, for DuckDB over whole tables."""

from diurna.llm.quality_rules import STOP_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP4 = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM (SELECT *, least(10, len(ws)) AS k FROM item WHERE len(ws) > 0))),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
place AS (
  SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM doc, (SELECT DISTINCT k FROM win) AS lengths WHERE len(ws) >= k)),
hit AS (SELECT rid, i, k, item_id FROM place JOIN win USING (k, win)),
words AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP8 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, [x for x in string_split_regex({_LOWER}, '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM (SELECT *, least(4, len(ws)) AS k FROM doc WHERE len(ws) > 0))),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)
"""

OP9 = """
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
place AS (SELECT rid, i, hash(substr(h, 2 * i - 1, 800)) AS w
          FROM (SELECT rid, h, unnest(range(1, CAST(len(h) // 2 - 398 AS BIGINT))) AS i FROM doc WHERE len(h) >= 800)),
again AS (SELECT w FROM place GROUP BY w HAVING count(*) > 1),
start AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM place SEMI JOIN again USING (w)),
island AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY rid ORDER BY i) AS g FROM start),
span AS (SELECT rid, g, min(i) AS a, max(i) + 399 AS b FROM island GROUP BY rid, g),
gap AS (SELECT rid, g, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY g), 0) AS last, a, b FROM span),
kept AS (
  SELECT rid, string_agg(substr(h, 2 * last + 1, 2 * (a - 1 - last)), '' ORDER BY g)
              || substr(any_value(h), 2 * max(b) + 1) AS k,
         sum(b - a + 1) AS n, count(*) AS spans
  FROM gap JOIN doc USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM doc LEFT JOIN kept USING (rid)
"""

OP10 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS ws,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM doc),
three AS (SELECT rid, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM word WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM three WHERE w3 IS NOT NULL),
inside AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY rid),
measure AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len([x for x in ws if lower(x) IN ({_STOPS})]) AS n_stops, len([x for x in ws if x LIKE '%!']) AS n_bangs
  FROM doc LEFT JOIN inside USING (rid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measure)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND 10 * n_symbols <= n_words
       AND 50 * n_stops >= n_words AND 2 * n_dup_lines <= n_lines AND 10 * n_bangs <= 3 * n_words AS kept
FROM base
"""

_UNIQUE = "(SELECT doc_id, coalesce(text, '') AS text, count(*) AS copies FROM documents GROUP BY doc_id, text)"

OP11 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, copies, string_split(text, chr(10)) AS ls
  FROM (SELECT doc_id, text, sum(copies) AS copies FROM {_UNIQUE} GROUP BY doc_id, text)),
line AS (
  SELECT rid, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, i, ls[i] AS line FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM doc))),
common AS (SELECT key FROM line WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
left_over AS (
  SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text
  FROM line WHERE key NOT IN (SELECT key FROM common) GROUP BY rid)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(left_over.n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(left_over.text, '')) AS kept_sha256
FROM (SELECT *, unnest(range(copies::BIGINT)) FROM doc) LEFT JOIN left_over USING (rid)
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
_CRC_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


def _crc_step() -> str:
    """One byte of the CRC-32: eight shifts."""
    out = "c"
    for _ in range(8):
        out = f"list_transform([{out}], lambda c: {_CRC_BIT})[1]"
    return out


OP12 = rf"""
WITH RECURSIVE crc AS (
  SELECT doc_id, s, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, k + 1, {_crc_step()} FROM (
    SELECT doc_id, s, k, xor(c, ascii(s[k + 1])::BIGINT) AS c FROM crc WHERE k < length(s))),
tampered AS (SELECT doc_id, xor(c, 4294967295) % 3 = 0 AS hit FROM crc WHERE k = length(s)),
made AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_LEAF.format(_FIELD.format("text"))} AS leaf,
         CASE WHEN hit THEN {_LEAF.format(_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))}
              ELSE {_LEAF.format(_FIELD.format("text"))} END AS changed
  FROM documents LEFT JOIN tampered USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM made),
node AS (
  SELECT tree, 0 AS lvl, idx, leaf AS h, n FROM ranked
  UNION ALL
  SELECT tree, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8)
  FROM node WHERE n > 1 GROUP BY tree, lvl, idx // 8),
subroot AS (SELECT tree, h AS subroot, lvl AS height FROM node WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, tree AS idx, subroot AS h, (SELECT count(*) FROM subroot) AS n FROM subroot
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8)
  FROM upper WHERE n > 1 GROUP BY lvl, idx // 8),
root AS (SELECT h AS root FROM upper WHERE n = 1),
beside AS (
  SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM node AS a JOIN node AS b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8
  WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.idx),
over AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM upper AS a JOIN upper AS b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
step AS (
  SELECT rid, beside.lvl, beside.before, beside.after
  FROM ranked JOIN beside ON ranked.tree = beside.tree AND beside.idx = ranked.idx // (8 ** beside.lvl)::BIGINT
  UNION ALL
  SELECT rid, height + over.lvl, over.before, over.after
  FROM ranked JOIN subroot USING (tree) JOIN over ON over.idx = ranked.tree // (8 ** over.lvl)::BIGINT),
fold AS (
  SELECT rid, 0 AS lvl, changed AS h FROM ranked
  UNION ALL
  SELECT fold.rid, fold.lvl + 1, sha256(step.before || fold.h || step.after) FROM fold JOIN step ON fold.rid = step.rid AND fold.lvl = step.lvl),
proof AS (SELECT rid, string_agg(before || after, '' ORDER BY lvl) AS siblings FROM step GROUP BY rid),
ends AS (SELECT rid, arg_max(h, lvl) AS folded_root FROM fold GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked JOIN subroot USING (tree) JOIN ends USING (rid) LEFT JOIN proof USING (rid), root
"""

OP13 = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^
]*
|[^
]+') AS ls,
         ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM doc),
part AS (
  SELECT doc_id, text, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b, ls,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
three AS (
  SELECT doc_id, text, n, form, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s
  FROM part)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM three
"""
