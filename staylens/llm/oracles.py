"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from staylens.llm.secret_scan import RULES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _folded(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}')"


OP3 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
parts AS (
  SELECT *, unnest([text, role]) AS value, unnest(['text', 'role']) AS part FROM rows),
sized AS (
  SELECT conv_id, turn, role, text, part,
    length(value) + length(value) - length(replace(value, '\', ''))
    + list_sum(list_transform(['<s>', '</s>', '[INST]', '[/INST]', '[ROLE]', '[/ROLE]'],
        lambda c: (length(value) - length(replace(value, c, ''))) // length(c))) AS size
  FROM parts),
turns AS (
  SELECT conv_id, turn, role, text, sum(CASE
    WHEN part = 'text' THEN size + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 4 END
    WHEN role IN ('user', 'assistant') THEN 0 ELSE size + 14 END) AS size
  FROM sized GROUP BY ALL)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(3 + sum(size) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewritten_turns
FROM turns GROUP BY conv_id
"""

OP7 = f"""
WITH items AS (SELECT item_id, words, len(words) AS n FROM (SELECT item_id, {_folded('text')} AS words FROM benchmark)),
slid AS (SELECT *, least(n, 13) AS k, unnest(range(1, n - least(n, 13) + 2)) AS p FROM items WHERE n > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(words[p:p + k - 1], ' ') AS w,
    array_to_string(words[p:p + least(k, 3) - 1], ' ') AS head FROM slid),
docs AS (SELECT doc_id, {_folded('text')} AS words FROM documents),
places AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM docs WHERE len(words) > 0),
heads AS (
  SELECT doc_id, p, w AS w1, w || ' ' || lead(w) OVER s AS w2, w || ' ' || lead(w) OVER s || ' ' || lead(w, 2) OVER s AS w3
  FROM places WINDOW s AS (PARTITION BY doc_id ORDER BY p)),
maybe AS (
  SELECT doc_id, p, item_id, k, w FROM heads h JOIN windows x
    ON x.head = CASE least(k, 3) WHEN 1 THEN h.w1 WHEN 2 THEN h.w2 ELSE h.w3 END),
found AS (
  SELECT doc_id, p, item_id, k FROM maybe JOIN docs USING (doc_id)
  WHERE array_to_string(words[p:p + k - 1], ' ') = w),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _op6() -> str:
    parts = []
    for i, r in enumerate(RULES):
        pattern = "[0-9a-f]+" if r.kind == "hex" else r.pattern
        if r.any_case:  # the words before the value, letter by letter: RE2's (?i) folds more than ASCII
            word, rest = pattern.split(")", 1)
            pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) + ")" + rest
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {i} AS kind, '{r.kind}' AS name, {r.least} AS least,
    regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS g,
    string_split_regex(t, '{p}') AS s FROM docs""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
placed AS (
  SELECT doc_id, kind, name, least, m, g, i,
    list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0)),
spans AS (
  SELECT doc_id, kind, CAST(start AS BIGINT) AS start,
    name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m[i]) AS BIGINT) AS span
  FROM placed WHERE length(g[i]) >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(span, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)
"""


OP6 = _op6()


def _tree(name: str, leaves: str) -> str:
    """CTEs for a 16-ary tree: ``<name>_nodes`` (g, level, pos, m, digest), all levels."""
    return f"""
{name}_up AS (
  SELECT 0 AS level, g, pos, m, digest FROM {leaves}
  UNION ALL
  SELECT level + 1, g, pos // 16, (any_value(m) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name}_up WHERE m > 1 GROUP BY level, g, pos // 16),
{name}_nodes AS (
  SELECT *, coalesce(string_agg(digest, '') OVER (run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(digest, '') OVER (run ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name}_up WINDOW run AS (PARTITION BY level, g, pos // 16)),
{name}_top AS (SELECT g, digest FROM {name}_up WHERE m = 1)"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP11 = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, {_leaf('text')} AS digest,
    {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS lowered, {_CRC} AS crc
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m
  FROM raw),
{_tree('low', 'leaves')},
subroots AS (SELECT '' AS g, g AS of, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m, digest FROM low_top),
{_tree('high', 'subroots')},
nodes AS (
  SELECT false AS upper, n.g, n.level, n.pos, n.m = 1 AS top, n.lft, n.rgt, s.pos AS next
  FROM low_nodes n JOIN subroots s ON s.of = n.g
  UNION ALL SELECT true, g, level, pos, m = 1, lft, rgt, 0 FROM high_nodes),
walk AS (
  SELECT doc_id, g AS source_key, g, false AS upper, false AS done, 0 AS level, pos, digest AS leaf, '' AS proof,
    CASE WHEN crc % 5 = 0 THEN lowered ELSE digest END AS folded FROM leaves
  UNION ALL
  SELECT w.doc_id, w.source_key, CASE WHEN n.top THEN '' ELSE w.g END, w.upper OR n.top, w.upper AND n.top,
    CASE WHEN n.top THEN 0 ELSE w.level + 1 END, CASE WHEN n.top THEN n.next ELSE w.pos // 16 END, w.leaf,
    CASE WHEN n.top THEN w.proof ELSE w.proof || n.lft || n.rgt END,
    CASE WHEN n.top THEN w.folded ELSE sha256(n.lft || w.folded || n.rgt) END
  FROM walk w JOIN nodes n ON n.upper = w.upper AND n.g = w.g AND n.level = w.level AND n.pos = w.pos
  WHERE NOT w.done)
SELECT w.doc_id, w.leaf, t.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256,
  w.folded AS folded_root, w.folded = r.digest AS verified
FROM walk w JOIN low_top t ON t.g = w.source_key CROSS JOIN high_top r WHERE w.done
"""

OP12 = rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
phrases AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS p, k FROM places, (VALUES (1), (2), (3)) AS sizes(k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, p, k, string_split(p, ' ') AS w, count(*) AS a FROM phrases GROUP BY lang, p, k HAVING count(*) >= 10),
longest AS MATERIALIZED (
  SELECT lang, p, max(a) AS longest
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM f WHERE k = 3) GROUP BY lang, p),
kept AS MATERIALIZED (
  SELECT c.* FROM f c LEFT JOIN longest b ON b.lang = c.lang AND b.p = c.p
  WHERE c.k > 1 AND (b.longest IS NULL OR 100 * b.longest < 50 * c.a)),
halves AS MATERIALIZED (
  SELECT lang, p, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
cuts AS (
  SELECT c.lang, c.p, c.a, cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM halves c JOIN f x ON x.lang = c.lang AND x.p = c.x JOIN f y ON y.lang = c.lang AND y.p = c.y),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
ranked AS (
  SELECT lang, p AS phrase, a, l, r, CAST(score AS BIGINT) AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13 = rf"""
WITH RECURSIVE lists AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, row, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM lists),
keyed AS MATERIALIZED (SELECT doc_id, row, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM sets),
nodes AS MATERIALIZED (SELECT k, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS id FROM keyed WHERE n > 0 GROUP BY k),
tokens AS MATERIALIZED (SELECT id, n, unnest(s) AS t FROM nodes),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS r FROM ways UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r),
roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, CASE WHEN d.n = 0 THEN d.doc_id ELSE coalesce(roots.root, nodes.id) END AS component_id
FROM keyed d LEFT JOIN nodes ON nodes.k = d.k AND d.n > 0 LEFT JOIN roots ON roots.id = nodes.id
"""
