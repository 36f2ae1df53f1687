"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tillroll.llm.secret_scan import BASE, RULES

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS g
  FROM words),
grams AS (SELECT doc_id, unnest(g) AS k FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM grams a JOIN grams b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(l.b, doc_id)) AS component_id,
  coalesce(d.n, 0)::BIGINT AS n_links
FROM sets LEFT JOIN least l ON l.a = doc_id LEFT JOIN degree d ON d.a = doc_id
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
written AS (
  SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>')
      OR regexp_matches(text, '<\\+\|im_')
    THEN length(text) + len(regexp_extract_all(text, '<\\*\|im_')) ELSE length(text) END AS shown
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<|im_start|><|im_end|>') + 2 + length(role) + shown)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


def _secret_scan() -> str:
    kinds = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(
            f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS place, {rule.least} AS least, unnest(range(1, len(whole) + 1)) AS i, gaps, whole, part
            FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS whole,
              regexp_extract_all(text, '{pattern}', {rule.group}) AS part FROM documents WHERE regexp_matches(text, '{pattern}'))
            """
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
    WITH found AS ({" UNION ALL ".join(kinds)}),
    spans AS (
      SELECT doc_id, kind, place, (list_sum([length(x) for x in gaps[1:i]])
        + coalesce(list_sum([length(x) for x in whole[1:i - 1]]), 0))::BIGINT AS start, length(whole[i]) AS n FROM found WHERE length(part[i]) >= least),
    texts AS (
      SELECT doc_id, {counts},
        string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base,
        string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, place) AS spans
      FROM spans GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id
    """


LLM_SQL: dict[str, str] = {
    "op1_ngram_join": NGRAM_JOIN,
    "op3_exact_dedup": EXACT_DEDUP,
    "op4_chat_format": CHAT_FORMAT,
    "op6_secret_scan": _secret_scan(),
}
