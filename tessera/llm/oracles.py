"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: ASCII lower case only, as the contracts ask.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOW.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id <= coalesce(m, s.doc_id) AS kept
FROM sets s LEFT JOIN low USING (doc_id)
"""

OP6 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, {_LOW.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_CONTROL = ["<s>", "</s>", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\"]
_ESCAPED = "length(text) + " + " + ".join(f"(length(text) - length(replace(text, '{x}', ''))) // {len(x)}" for x in _CONTROL)

OP7 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, sum(13 + length(role) + {_ESCAPED})::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM told
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)::INT AS rank, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20
"""

# Kind, its place in the order, the text it is looked for in, the pattern, and what a match needs besides.
_RULES = [
    ("assign", "low", r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)"""),
    ("access", "text", "AKIA[A-Z0-9]+"),
    ("hex", "text", "[0-9a-f]+"),
    ("private_key", "text", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("jwt", "text", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("credential_url", "text", r"://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9.-]+"),
    ("service_token", "text", "(?:ghp_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20})"),
]


def _found(number: int, kind: str, where: str, rule: str) -> str:
    group = 2 if kind == "assign" else 0
    least = {"assign": 6, "access": 20, "hex": 24}.get(kind, 0)
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0)::BIGINT AS s, length(m[i]) AS n
  FROM (SELECT doc_id, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all({where}, '{rule}') AS m, string_split_regex({where}, '{rule}') AS p, regexp_extract_all({where}, '{rule}', {group}) AS g FROM d)) WHERE length(g[i]) >= {least}"""


OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_LOW.format("coalesce(text, '')")} AS low FROM documents),
found AS ({" UNION ALL ".join(_found(k, *rule) for k, rule in enumerate(_RULES))}),
told AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""

OP11 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOW.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id
FROM sets s LEFT JOIN low USING (doc_id)
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_filter(string_split_regex({_LOW.format("coalesce(text, '')")}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), grp AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
tally AS (SELECT lang, source, term, sum(c)::HUGEINT AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(t.c, 0)::HUGEINT AS c FROM grp g JOIN kept k USING (lang) LEFT JOIN tally t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
p AS (SELECT c.lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER (PARTITION BY c.lang, source) + 2 * v)::HUGEINT AS p FROM cells c JOIN v ON c.lang = v.lang),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM cells GROUP BY ALL),
q AS (SELECT w.lang, term, 1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER (PARTITION BY w.lang) + 2 * v)::HUGEINT AS q FROM whole w JOIN v ON w.lang = v.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, source, 'term', p.term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM told QUALIFY part = 'pair' OR rank <= 10
"""

OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id AS other_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0
), pos AS (SELECT * FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, c) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.other_id, n.c)::INT AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN met n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5
"""

ORACLES = {"op3_blob_ledger": OP3, "op4_odd_sketch_dedup": OP4, "op6_line_dedup": OP6, "op7_reply_trees": OP7, "op8_pivot_topk": OP8, "op11_combination_join": OP11, "op12_source_stripes": OP12, "op13_lemp_negatives": OP13}
