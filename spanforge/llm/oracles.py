"""SQL that gives the same rows, where DuckDB can express the operator over whole tables."""

from __future__ import annotations

from .consistent_form import statement

#: the text of each line once, and the length of each document
TEXTS = """
  l AS (SELECT DISTINCT doc, line_no, coalesce(array_to_string(list_transform(spans, lambda s: coalesce(s.text, '')), ' '), '') AS text FROM text_lines),
  s AS (SELECT doc, sum(length(text) + 1)::BIGINT AS n, sum(1 + length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines FROM l GROUP BY doc)"""


def oracle_sql() -> dict[str, str]:
    return {
        # every text through the statement, whatever its characters
        "p3_normalized": f"SELECT DISTINCT s.doc, s.page_num, s.span_seq, s.text, coalesce(n.normalized, s.text) AS normalized, coalesce(n.changed, false) AS changed FROM text_spans s LEFT JOIN ({statement('text_spans')}) n ON s.text = n.text",
        "p5_found": f"WITH {TEXTS} SELECT profile, doc FROM s JOIN chunk_limits ON n > max_chars",
        "p5_coverage": f"WITH {TEXTS} SELECT profile, doc, n AS chars, newlines, true AS whole, true AS within, true AS repeated FROM s JOIN chunk_limits ON n > max_chars",
        "p6_documents": "SELECT profile, doc_id, coalesce(length(text), 0) > 0 AS placed, true AS whole, true AS fits FROM documents, pack_bins",
        # a text belongs to the source of its least doc_id
        "p7_verified": """WITH t AS (SELECT lower(trim(source)) AS source FROM mix_targets),
          r AS (SELECT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS source, doc_id, text FROM documents WHERE length(text) > 0),
          d AS (SELECT arg_min(source, doc_id) AS source FROM r WHERE source IN (SELECT source FROM t) GROUP BY text)
          SELECT source, source IN (SELECT source FROM d) AS present, true AS repeats_kept, true AS near, true AS once FROM t""",
    }
