"""The queries that SQL can express, as DuckDB SQL over the same tables.

Byte windows (op4) take SQL minutes on the smallest whole table; that query is
compared with brute force in the tests instead, as are those that SQL cannot
express.
"""

from __future__ import annotations

from newsflow.llm.chat import ChatTemplate
from newsflow.llm.licenses import NOTICES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat() -> str:
    template = ChatTemplate()
    marks = " + ".join(
        f"(length(x) - length(replace(x, {_quoted(m)}, ''))) // {len(m)}" for m in template.controls())
    escaped = f"(length(x) + length(x) - length(replace(x, '\\', '')) + {marks})"
    marked = " ".join(f"WHEN '{r}' THEN {len(t.open) + len(t.close)}" for r, t in template.turns.items())
    other = len(template.other.open) + len(template.other.close) + len(template.other_text)
    allowed = " OR ".join(
        f"(state = '{s}' AND role IN ({', '.join(map(_quoted, roles))}))" for s, roles in template.follows.items())
    size = "(SELECT " + escaped + " FROM (SELECT {} AS x))"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start') AS state,
    lead(1) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last,
    {size.format('text')} + CASE role {marked} ELSE {other} + {size.format('role')} END AS size
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars,
  bool_and({allowed}) AND bool_or(is_last AND role = 'assistant') AS valid
FROM turns GROUP BY conv_id
"""


def _licenses() -> str:
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in NOTICES.items())
    words = f"list_filter(string_split_regex({_LOWER}, '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))"
    return f"""
WITH notices AS (SELECT license, {grams} AS g FROM (
  SELECT license, {words} AS w FROM (VALUES {values}) AS n(license, text))),
wanted AS (SELECT license, len(g) AS n_shingles, unnest(g) AS s FROM notices),
own AS (SELECT doc_id, unnest({grams}) AS s FROM (SELECT doc_id, {words} AS w FROM documents))
SELECT doc_id, license, any_value(n_shingles) AS n_shingles, count(*) AS n_found,
  count(*) / any_value(n_shingles)::DOUBLE AS containment
FROM own JOIN wanted USING (s) GROUP BY doc_id, license
HAVING count(*) >= 0.8 * any_value(n_shingles)
"""


_JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM words),
grams AS (SELECT doc_id, len(g) AS n, md5_number(s) AS s FROM (SELECT doc_id, g, unnest(g) AS s FROM sets)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT doc_id, any_value(len(g)) AS n_shingles, min(other) AS component_id
FROM reached JOIN sets USING (doc_id) GROUP BY doc_id
"""

_QUALITY = f"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, sum(n)::BIGINT AS n FROM (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM often) GROUP BY doc_id),
stats AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')))) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source),
moments AS (
  SELECT sum(f) / sum(n) AS m, sum(n * power(f / n, 2)) / sum(n) - power(sum(f) / sum(n), 2)
    - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * (count(*) - 1) / sum(n) AS between_hosts FROM hosts),
rates AS (
  SELECT source, CASE WHEN between_hosts > 1e-12
    THEN (f + greatest(m * (1 - m) / between_hosts - 1, 0) * m) / (n + greatest(m * (1 - m) / between_hosts - 1, 0))
    ELSE m END AS rate FROM hosts, moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate < 0.5 AS kept, round(rate, 6) AS host_rate
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""

_FIM = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
units AS (SELECT doc_id, t, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS u,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM drawn),
cuts AS (SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a,
    greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
      WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a+1:b], ''), '') AS m,
    coalesce(array_to_string(u[b+1:n], ''), '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

_AUDIT = f"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {{
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)}} AS f
  FROM words LEFT JOIN marked USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
judged AS (SELECT part, o, step, n, good, toxic, substr(o, step, 1) AS own, f[substr(o, step, 1)] AS fails,
    len(list_filter(range(1, step), lambda i: f[substr(o, i, 1)])) > 0 AS gone,
    len(list_filter(map_values(f), lambda x: x)) AS n_fails
  FROM cells, steps),
found AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY part, o, step, own)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM found
"""

ORACLE: dict[str, str] = {
    "op1_chat_format": _chat(),
    "op3_license_scan": _licenses(),
    "op5_jaccard_join": _JACCARD,
    "op9_quality_rules": _QUALITY,
    "op11_fim": _FIM,
    "op12_filter_audit": _AUDIT,
}
