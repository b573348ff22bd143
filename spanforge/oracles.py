"""SQL that gives the same rows as the queries, for an engine that reads the tables as views."""

from __future__ import annotations

import unicodedata

from .functions.core_metrics import CORE_FONTS, core_font, zapf_codes

LINES = """
given AS (SELECT DISTINCT doc, line_no, coalesce(array_to_string(list_transform(spans, lambda s: coalesce(s.text, '')), ' '), '') AS text, len(spans) AS n FROM text_lines)"""
GLYPHS = LINES + """,
chars AS (SELECT doc, line_no, unnest(range(length(text))) AS i, text FROM given),
glyphs AS (SELECT doc, (line_no // 54 + 1)::INT AS page, (line_no % 54)::BIGINT * 1000000 + i AS seq,
  CASE WHEN substr(text, i + 1, 1) = ' ' AND i % 5 = 0 THEN chr(9) ELSE substr(text, i + 1, 1) END AS raw,
  (72 + i * 6 + (i // 9) * 1.5 + (i // 31) * 6 + (i // 53) * 18)::DOUBLE AS x, (72 + (line_no % 54) * 12 - CASE WHEN i % 23 = 7 THEN 4 ELSE 0 END)::DOUBLE AS y,
  CASE WHEN (i + line_no) % 17 = 5 THEN 0.0 ELSE 0.5 END::DOUBLE AS width, 10.0::DOUBLE AS tfs, CASE WHEN (i // 20) % 3 = 1 THEN 'Courier-Bold' ELSE 'Courier' END AS font_name FROM chars)"""
FLAGS = GLYPHS + """,
g1 AS (SELECT *, CASE WHEN raw = chr(9) THEN ' ' ELSE raw END AS text, x + width * tfs AS e FROM glyphs),
g2 AS (SELECT *, lag(e) OVER w AS le, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(font_name) OVER w AS lf, row_number() OVER w AS k FROM g1 WINDOW w AS (PARTITION BY doc, page ORDER BY seq)),
g3 AS (SELECT *, CASE WHEN le = lx AND abs(y - ly) < tfs * 0.5 THEN x ELSE le END AS pe FROM g2),
g4 AS (SELECT *, (x - pe) / tfs AS ratio FROM g3),
g5 AS (SELECT *, k > 1 AND lf <> font_name AS font_break, k > 1 AND abs(y - ly) > 1.5 * tfs AS line_break, k > 1 AND x < pe AND abs(y - ly) > 0.5 * tfs AS back_break, k > 1 AND abs(ratio) > 1.2 AS gap_break FROM g4),
flags AS (SELECT *, k = 1 OR font_break OR line_break OR back_break OR gap_break AS breaks FROM g5)"""
SEGMENTS = FLAGS + """,
s1 AS (SELECT *, sum(breaks::INT) OVER w AS segment, CASE WHEN e = x AND abs(lead(y) OVER w - y) < lead(tfs) OVER w * 0.5 THEN lead(x) OVER w ELSE e END AS edge FROM flags WINDOW w AS (PARTITION BY doc, page ORDER BY seq)),
s2 AS (SELECT *, row_number() OVER w AS nth, lag(regexp_matches(text, '[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]$')) OVER w AS white FROM s1 WINDOW w AS (PARTITION BY doc, page, segment ORDER BY seq)),
segments AS (SELECT *, nth > 1 AND ratio > 0.15 AND NOT white AS space FROM s2)"""
SPANS = SEGMENTS + """,
sp AS (SELECT doc, page AS page_num, segment, string_agg(CASE WHEN space THEN ' ' ELSE '' END || text, '' ORDER BY seq) AS text, arg_min(x, seq) AS x0, arg_max(edge, seq) AS x1, arg_min(y, seq) AS y0, arg_min(font_name, seq) AS font_name FROM segments GROUP BY ALL),
spans AS (SELECT doc, page_num, row_number() OVER (PARTITION BY doc, page_num ORDER BY segment) - 1 AS span_seq, text, y0 + 10 AS t, greatest(x0, x1) AS r, y0 AS b, least(x0, x1) AS l, font_name, 10.0::DOUBLE AS font_size FROM sp)"""


def numbered(name: str = "spans") -> str:
    return f""",
n1 AS (SELECT *, abs(b - lag(b) OVER w) AS gap, row_number() OVER w AS nth_on_page FROM {name} WINDOW w AS (PARTITION BY doc, page_num ORDER BY t NULLS FIRST, span_seq)),
n2 AS (SELECT *, CASE WHEN nth_on_page = 1 THEN CASE WHEN min(page_num) OVER (PARTITION BY doc) = page_num THEN 0 ELSE 2 END WHEN gap > 24 THEN 2 WHEN gap > 5 THEN 1 ELSE 0 END AS step FROM n1),
placed AS (SELECT *, sum(step) OVER (PARTITION BY doc ORDER BY page_num, t NULLS FIRST, span_seq ROWS UNBOUNDED PRECEDING)::INT AS line_no FROM n2)"""


ALL_LINES = SPANS + numbered() + """,
all_lines AS (SELECT d.doc, n.line_no::INT AS line_no FROM (SELECT doc, max(line_no) AS m FROM placed GROUP BY doc) d, unnest(range(m + 1)) AS n(line_no))"""
PLAIN = ALL_LINES + """,
plain_lines AS (SELECT a.doc, a.line_no, coalesce(string_agg(p.text, ' ' ORDER BY p.l, p.t NULLS FIRST, p.span_seq), '') AS text FROM all_lines a LEFT JOIN placed p ON a.doc = p.doc AND a.line_no = p.line_no GROUP BY ALL)"""
CURRENT = """
current AS (SELECT doc, page_num, span_seq, arg_max(struct_pack(text := text, bbox := bbox, font_name := font_name, font_size := font_size), loaded_at) AS v, max(loaded_at) AS loaded_at FROM text_spans GROUP BY ALL),
cs AS (SELECT doc, page_num, span_seq, v.text AS text, v.bbox.t AS t, v.bbox.r AS r, v.bbox.b AS b, v.bbox.l AS l, v.font_name AS font_name, loaded_at FROM current)"""
FILES = """
files AS (SELECT DISTINCT doc, content FROM pdf_files), texts AS (SELECT doc, decode(content) AS body FROM files WHERE content IS NOT NULL AND octet_length(content) > 0),
shown AS (SELECT doc, replace(replace(replace(regexp_extract(body, '\\((.*)\\) Tj', 1), '\\(', '('), '\\)', ')'), '\\\\', '\\') AS text FROM texts WHERE contains(body, 'BaseFont/Courier>>'))"""
ROUND = LINES + """,
rt AS (SELECT doc || '#' || (line_no // 1080) AS doc, ((line_no % 1080) // 54 + 1)::INT AS page_num, (line_no % 54)::BIGINT AS span_seq, replace(text, chr(9), ' ') AS text,
  (82 + 12 * (line_no % 54))::DOUBLE AS t, (72 + 6 * length(text))::DOUBLE AS r, (72 + 12 * (line_no % 54))::DOUBLE AS b, 72.0::DOUBLE AS l, 'Courier' AS font_name FROM given WHERE text <> '')"""
ROUND_LINES = ROUND + numbered("rt") + """,
rt_lines AS (SELECT d.doc, n.line_no::INT AS line_no FROM (SELECT doc, max(line_no) AS m FROM placed GROUP BY doc) d, unnest(range(m + 1)) AS n(line_no))"""


#: right edges of each document folded span by span into clusters, and the clusters that are columns
COLUMNS = """
lines AS (SELECT DISTINCT doc, line_no, spans FROM text_lines), given AS (SELECT doc, line_no, unnest(range(len(spans))) AS i, spans FROM lines),
gs AS (SELECT doc, line_no, i, coalesce(spans[i + 1].text, '') AS text, spans[i + 1].bbox.l::FLOAT AS l, spans[i + 1].bbox.r::FLOAT AS r FROM given),
edges AS (SELECT doc, l, r, row_number() OVER (PARTITION BY doc ORDER BY line_no, i) AS k FROM gs WHERE l IS NOT NULL AND r IS NOT NULL),
fold(doc, k, sums, counts, l0, l1, r0, r1) AS (
  SELECT doc, 1, [r], [1::FLOAT], [l], [l], [r], [r] FROM edges WHERE k = 1
  UNION ALL
  SELECT doc, k, CASE WHEN j = 0 THEN list_append(sums, r) ELSE list_transform(sums, lambda x, i: CASE WHEN i = j THEN (x + r)::FLOAT ELSE x END) END,
    CASE WHEN j = 0 THEN list_append(counts, 1::FLOAT) ELSE list_transform(counts, lambda x, i: CASE WHEN i = j THEN (x + 1)::FLOAT ELSE x END) END,
    CASE WHEN j = 0 THEN list_append(l0, l) ELSE list_transform(l0, lambda x, i: CASE WHEN i = j THEN least(x, l) ELSE x END) END, CASE WHEN j = 0 THEN list_append(l1, l) ELSE list_transform(l1, lambda x, i: CASE WHEN i = j THEN greatest(x, l) ELSE x END) END,
    CASE WHEN j = 0 THEN list_append(r0, r) ELSE list_transform(r0, lambda x, i: CASE WHEN i = j THEN least(x, r) ELSE x END) END, CASE WHEN j = 0 THEN list_append(r1, r) ELSE list_transform(r1, lambda x, i: CASE WHEN i = j THEN greatest(x, r) ELSE x END) END
  FROM (SELECT *, CASE WHEN list_min(far) < 8 THEN list_position(far, list_min(far)) ELSE 0 END AS j FROM
    (SELECT f.* EXCLUDE (k), e.k, e.l, e.r, list_transform(sums, lambda x, i: abs(e.r - (x / counts[i])::FLOAT)::FLOAT) AS far FROM fold f JOIN edges e ON e.doc = f.doc AND e.k = f.k + 1))),
ended AS (SELECT f.* FROM fold f JOIN (SELECT doc, max(k) AS k FROM edges GROUP BY doc) m ON f.doc = m.doc AND f.k = m.k),
clusters AS (SELECT doc, unnest(range(1, len(sums) + 1)) AS j, sums, counts, l0, l1, r0, r1 FROM ended),
tall AS (SELECT doc, j, (sums[j] / counts[j])::FLOAT AS mean, counts[j] AS n, (l1[j] - l0[j])::FLOAT AS wide, (r1[j] - r0[j])::FLOAT AS off FROM clusters),
cols AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY j) - 1)::INT AS n, mean FROM tall WHERE n >= 3 AND wide >= CASE WHEN mean >= 450 THEN 5 ELSE 50 END AND off < 3.7::FLOAT AND mean >= 200)"""
LEFT = "greatest(0, floor(l / 4 + 0.5))"
#: a span within 16 points of a column's edge ends at the first such column
ALIGNED = f"coalesce((SELECT CASE WHEN count(*) > 0 THEN greatest(0, greatest(0, floor(arg_min(c.mean, c.n) / 4::FLOAT + 0.5)) - length(o.text)) END FROM cols c WHERE c.doc = o.doc AND abs(o.r - c.mean)::FLOAT < 16), {LEFT})"


def _encodings() -> list[tuple[str, int, int]]:
    """The named encodings from the code pages they follow; where they differ is spelled out."""
    out = []
    for code in range(32, 256):
        win = bytes([code]).decode("cp1252", "ignore")
        win = {127: "•", 160: " ", 173: "-", 129: "•", 141: "•", 143: "•", 144: "•", 157: "•"}.get(code, win)
        out.append(("WinAnsiEncoding", code, ord(win)))
        if code != 127:
            mac = {219: "¤", 202: " ", 189: "Ω", 198: "∆", 181: "µ", 240: "\uf8ff"}.get(code) or bytes([code]).decode("mac_roman")
            out.append(("MacRomanEncoding", code, 0x2126 if code == 189 else ord(mac)))
    return out


def _glyphs() -> list[tuple[str, str, int, int]]:
    """font, name, code point and width of the standard fonts; the characters of letters with accents from their Unicode names."""
    marks = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "caron": "CARON", "cedilla": "CEDILLA", "breve": "BREVE", "macron": "MACRON", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE"}
    from .functions.glyph_names import glyph_names

    out = []
    for font in CORE_FONTS:
        for code, width, name in core_font(font):
            mark = marks.get(name[1:])
            if font == "ZapfDingbats":
                cp = zapf_codes().get(code, 0)
            elif mark:
                cp = ord(unicodedata.lookup(f"LATIN {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name[0].upper()} WITH {mark}"))
            elif len(name) == 1:
                cp = ord(name)
            else:
                cp = glyph_names()[name]
            out.append((font, name, cp, width))
    return out


def pretty(lines: str, span: str, args: str = "", start: str = "greatest(0, floor(l / 4 + 0.5))") -> str:
    """Padding by the closed form of the cursor: a running maximum of start less what came before."""
    if start != "greatest(0, floor(l / 4 + 0.5))":
        return f"WITH RECURSIVE {lines}, placed_by AS (SELECT o.*, {start} AS begins FROM {span} o)," + pretty("", "placed_by", args, "greatest(0, floor(l / 4 + 0.5))").replace("\nWITH ,", "").replace("greatest(0, floor(l / 4 + 0.5)) AS s", "begins AS s")
    return f"""
WITH {lines},
q1 AS (SELECT *, length(text) AS n, greatest(0, floor(l / 4 + 0.5)) AS s, coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER w AS k FROM {span} WINDOW w AS (PARTITION BY doc, line_no ORDER BY {args})),
q2 AS (SELECT *, before + max(s - before) OVER (PARTITION BY doc, line_no ORDER BY k ROWS UNBOUNDED PRECEDING) AS pos FROM q1),
q3 AS (SELECT *, pos - coalesce(lag(pos + n) OVER (PARTITION BY doc, line_no ORDER BY k), 0) AS pad FROM q2)"""


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, tail: f"WITH {ctes} {tail}"
    glyphs = _glyphs()
    values = ", ".join(f"({width}, chr({cp}), {cp})" for font, _, cp, width in glyphs if font == "Helvetica")
    names = ", ".join(f"('{font}', '{name}', {cp}, {width})" for font, name, cp, width in glyphs)
    codes = ", ".join(f"('{e}', {c}, {cp})" for e, c, cp in _encodings())
    shown = "line_no, coalesce(string_agg(repeat(' ', pad::BIGINT) || text, '' ORDER BY k), '') AS text"
    given_spans = """lines AS (SELECT DISTINCT doc, line_no, spans FROM text_lines), given AS (SELECT doc, line_no, unnest(range(len(spans))) AS i, spans FROM lines),
      gs AS (SELECT doc, line_no, i, coalesce(spans[i + 1].text, '') AS text, spans[i + 1].bbox.l AS l FROM given)"""
    curly = "replace(replace(text, chr(39), chr(8217)), '`', chr(8216))"  # what the standard encoding makes of them
    out = {
        "glyphs_layout": w(GLYPHS, "SELECT doc, page, seq, raw AS text, x, y, width, tfs, font_name FROM glyphs"),
        "tab_normalize": w(FLAGS, "SELECT text, count(*) AS glyphs FROM flags WHERE raw = chr(9) GROUP BY text"),
        "span_breaks": w(FLAGS, "SELECT doc, page, seq, font_break, line_break, back_break, gap_break FROM flags WHERE breaks"),
        "zero_width_repair": w(FLAGS, "SELECT doc, page, seq, pe AS prev_end FROM flags WHERE pe = x"),
        "space_insertion": w(SEGMENTS, "SELECT doc, page, seq, round(ratio, 3) AS ratio FROM segments WHERE space"),
        "spans": w(SPANS, "SELECT doc, page_num, span_seq, text, t, r, b, l, font_name, font_size FROM spans"),
        "lines": w(ALL_LINES, "SELECT a.doc, a.line_no, count(p.text)::INT AS n_spans FROM all_lines a LEFT JOIN placed p ON a.doc = p.doc AND a.line_no = p.line_no GROUP BY ALL"),
        "blank_lines": w(ALL_LINES, "SELECT doc, line_no FROM all_lines ANTI JOIN placed USING (doc, line_no)"),
        "page_separators": w(ALL_LINES, "SELECT doc, (SELECT count(DISTINCT page_num) - 1 FROM placed p WHERE p.doc = a.doc) AS separators, count(*) - (SELECT count(DISTINCT line_no) FROM placed p WHERE p.doc = a.doc) AS blank FROM all_lines a GROUP BY doc"),
        "nested_lines": w(SPANS + numbered(), "SELECT doc, line_no, (row_number() OVER (PARTITION BY doc, line_no ORDER BY l, t NULLS FIRST, span_seq) - 1)::INT AS pos, text, page_num, l FROM placed"),
        "plain_text": w(PLAIN, "SELECT doc, string_agg(text || chr(10), '' ORDER BY line_no) AS plain FROM plain_lines GROUP BY doc"),
        "pretty_text_left": pretty(ALL_LINES, "placed", "l, t NULLS FIRST, span_seq") + f", made AS (SELECT doc, {shown} FROM q3 GROUP BY doc, line_no) SELECT a.doc, a.line_no, coalesce(m.text, '') AS text FROM all_lines a LEFT JOIN made m ON a.doc = m.doc AND a.line_no = m.line_no",
        "debug_dump": w(ALL_LINES, """, f AS (SELECT *, row_number() OVER (PARTITION BY doc, line_no ORDER BY l, t NULLS FIRST, span_seq) - 1 AS k FROM placed),
          shown AS (SELECT doc, line_no, string_agg(chr(10) || '  Span ' || k || ': "' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || '    BBox: (t: ' || printf('%.1f', t) || ', r: ' || printf('%.1f', r) || ', b: ' || printf('%.1f', b) || ', l: ' || printf('%.1f', l) || ')' || chr(10) || '    Font size: ' || printf('%.1f', font_size), '' ORDER BY k) AS s FROM f GROUP BY ALL)
          SELECT a.doc, a.line_no, 'Line ' || a.line_no || ':' || coalesce(s, ' (empty)') AS text FROM all_lines a LEFT JOIN shown ON a.doc = shown.doc AND a.line_no = shown.line_no""").replace(" , f AS", ", f AS"),
        "given_plain_lines": w(LINES, "SELECT doc, line_no, text FROM given"),
        "first_lines": w(LINES, "SELECT doc, line_no, text FROM given WHERE line_no < 5"),
        "given_pretty_left": pretty(given_spans, "gs", "i") + f", made AS (SELECT doc, {shown} FROM q3 GROUP BY doc, line_no) SELECT a.doc, a.line_no, coalesce(m.text, '') AS text FROM lines a LEFT JOIN made m ON a.doc = m.doc AND a.line_no = m.line_no",
        "given_lines": w(CURRENT + numbered("cs"), "SELECT doc, page_num, span_seq, line_no, step = 2 AS blank_before FROM placed"),
        "current_spans": w(CURRENT, "SELECT doc, page_num, span_seq, text, font_name, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at FROM cs"),
        "bbox_corners": w(CURRENT, "SELECT doc, page_num, span_seq, " + ", ".join(f"round({v}::DOUBLE, 3) AS {p}_{a}" for p, x, y in (("top_left", "l", "t"), ("top_right", "r", "t"), ("bottom_left", "l", "b"), ("bottom_right", "r", "b")) for a, v in (("x", x), ("y", y))) + " FROM cs"),
        "grid_columns": w(CURRENT, "SELECT doc, page_num, span_seq, greatest(0, floor(l / 4 + 0.5))::INT AS start_col, greatest(0, floor(r / 4 + 0.5))::INT AS end_col, greatest(greatest(0, floor(r / 4 + 0.5)) - greatest(0, floor(l / 4 + 0.5)), length(text), 0)::INT AS grid_width FROM cs WHERE text IS NOT NULL"),
        "font_filter": w(CURRENT, "SELECT doc, page_num, span_seq, font_name FROM cs WHERE contains(lower(font_name), 'serif')"),
        "font_counts": w(CURRENT, "SELECT font_name, count(*) AS spans FROM cs GROUP BY font_name"),
        "region_filter": w(CURRENT, "SELECT doc, page_num, span_seq, text FROM cs WHERE t < 100 AND l > 60"),
        "band_rows": w(CURRENT, "SELECT doc, page_num, (round_even(t::DOUBLE / 10, 0) * 10)::INT AS band, count(*)::INT AS cells, string_agg(coalesce(text, ''), ' | ' ORDER BY l, span_seq) AS row FROM cs WHERE t IS NOT NULL GROUP BY ALL"),
        "right_aligned_columns": f"WITH RECURSIVE {COLUMNS} SELECT doc, n, round(mean::DOUBLE, 3) AS position FROM cols",
        "pretty_text_full": pretty(COLUMNS, "gs", "i", ALIGNED) + f", made AS (SELECT doc, {shown} FROM q3 GROUP BY doc, line_no) SELECT a.doc, string_agg(coalesce(m.text, '') || chr(10), '' ORDER BY a.line_no) AS pretty FROM lines a LEFT JOIN made m ON a.doc = m.doc AND a.line_no = m.line_no GROUP BY a.doc",
        "glyph_name_lookup": f"SELECT font, name, code_point, width::DOUBLE AS width FROM (VALUES {names}) AS t(font, name, code_point, width)",
        "width_rows": "WITH f AS (SELECT DISTINCT doc, font_id, unnest(map_entries(widths)) AS w FROM fonts WHERE widths IS NOT NULL) SELECT doc, font_id, w.key AS code, round(w.value::DOUBLE, 3) AS width FROM f",
        "unicode_rows": "WITH f AS (SELECT DISTINCT doc, font_id, unnest(map_entries(to_unicode)) AS w FROM fonts WHERE to_unicode IS NOT NULL) SELECT doc, font_id, w.key AS code, w.value AS text FROM f",
        "encoding_lookup": f"WITH e(encoding, code, cp) AS (VALUES {codes}), f AS (SELECT DISTINCT doc, font_id, encoding, unnest(map_keys(widths)) AS code FROM fonts WHERE widths IS NOT NULL) SELECT doc, font_id, f.code, chr(cp) AS text FROM f JOIN e ON e.encoding = f.encoding AND e.code = f.code",
        "nearest_width_match": f"""WITH o(width, char, ord) AS (VALUES {values}), v AS (SELECT DISTINCT round(w.value::DOUBLE, 3) AS width FROM (SELECT unnest(map_entries(widths)) AS w FROM fonts)),
          j AS (SELECT v.width, o.char, o.width AS matched_width, row_number() OVER (PARTITION BY v.width ORDER BY abs(o.width - floor(v.width)), (o.width < floor(v.width)), NOT regexp_matches(o.char, '^[ 0-9!-/:-@\\[-`{{-~]$'), o.ord) AS k
                FROM v JOIN o ON abs(o.width - floor(v.width)) <= greatest(1, floor(v.width * 2.0 / 100.0))) SELECT width, char, matched_width FROM j WHERE k = 1""",
        "cid_gid_unicode": "WITH f AS (SELECT DISTINCT doc || '/' || font_id AS font, widths, to_unicode FROM fonts), a AS (SELECT font, unnest(map_keys(widths)) AS cid FROM f), b AS (SELECT font, unnest(map_entries(to_unicode)) AS e FROM f) SELECT a.font, cid, cid - 32 AS gid, chr(ascii(e.value)) AS text FROM a JOIN b ON a.font = b.font AND e.key = cid WHERE cid <> 32",
        "pdf_plain": w(FILES, f"SELECT doc, {curly} || chr(10) AS plain FROM shown WHERE text <> ''"),
        "pdf_spans": w(FILES, f"SELECT doc, 1 AS page_num, 0::BIGINT AS span_seq, {curly} AS text, 102.0::DOUBLE AS t, (72 + 6 * length(text))::DOUBLE AS r, 92.0::DOUBLE AS b, 72.0::DOUBLE AS l, 'Courier' AS font_name, 10.0::DOUBLE AS font_size FROM shown WHERE text <> ''"),
        "pdf_glyphs": w(FILES, f", c AS (SELECT doc, unnest(range(length(text))) AS i, text AS raw, {curly} AS shown FROM shown) SELECT doc, 1 AS page, i AS seq, ascii(substr(raw, i + 1, 1)) AS code, substr(c.shown, i + 1, 1) AS text, (72 + 6 * i)::DOUBLE AS x, 92.0::DOUBLE AS y FROM c"),
        "pdf_pretty": w(FILES, f"SELECT doc, repeat(' ', 18) || {curly} || chr(10) AS pretty FROM shown WHERE text <> ''"),
        "pdf_output": w(FILES, f", failed AS (SELECT doc, CASE WHEN content IS NULL OR octet_length(content) = 0 THEN 'IoError' ELSE 'FormatError' END AS error FROM files WHERE doc NOT IN (SELECT doc FROM shown)) SELECT doc, 1 AS lines, {curly} || chr(10) AS plain, repeat(' ', 18) || {curly} || chr(10) AS pretty, NULL::VARCHAR AS error FROM shown WHERE text <> '' UNION ALL SELECT doc, NULL, NULL, NULL, error FROM failed"),
        "pdf_pages": w(FILES, "SELECT doc, 1 AS page, m * 0.0::DOUBLE AS llx, m * 0.0::DOUBLE AS lly, m * 612.0::DOUBLE AS urx, m * 792.0::DOUBLE AS ury, contains(body, '/Font<</F1 5 0 R')::INT AS fonts FROM (SELECT *, CASE WHEN contains(body, '/MediaBox[0 0 612 792]') THEN 1 END AS m FROM texts) WHERE contains(body, '/Type/Page/Parent')"),
        "pdf_content": w(FILES, ", ops(op_no, operator) AS (VALUES (0, 'BT'), (1, 'Tf'), (2, 'Td'), (3, 'Tj'), (4, 'ET')) SELECT doc, 1 AS page, op_no, operator, CASE operator WHEN 'Tf' THEN 'F1 10' WHEN 'Td' THEN '72 700' WHEN 'Tj' THEN '(' || text || ')' ELSE '' END AS operands FROM (SELECT doc, regexp_extract(body, '\\((.*)\\) Tj', 1) AS text FROM texts WHERE contains(body, ') Tj ET')), ops UNION ALL SELECT doc, 1, 5, regexp_extract(body, 'ET\n([a-z]+)$', 1), '' FROM texts WHERE regexp_matches(body, 'ET\n[a-z]+$')"),
        "error_rows": w(FILES, "SELECT CASE WHEN content IS NULL OR octet_length(content) = 0 THEN 'IoError' ELSE 'FormatError' END AS kind, count(*) AS files FROM files WHERE doc NOT IN (SELECT doc FROM shown) GROUP BY ALL"),
        "pdf_fonts": w(FILES, "SELECT doc, 'F1' AS font_id, 'Type1' AS subtype, 'Courier' AS base_font, NULL::VARCHAR AS encoding, NULL::VARCHAR AS error FROM texts WHERE contains(body, 'BaseFont/Courier>>')"),
        "pdf_roundtrip_spans": w(ROUND, "SELECT doc, page_num, text, t, r, b, l, font_name FROM rt"),
        "pdf_roundtrip_plain": w(ROUND_LINES, "SELECT a.doc, string_agg(coalesce(p.text, '') || chr(10), '' ORDER BY a.line_no) AS plain FROM rt_lines a LEFT JOIN placed p ON a.doc = p.doc AND a.line_no = p.line_no GROUP BY a.doc"),
        "pages_count": w(FILES, "SELECT doc, 1::BIGINT AS pages FROM texts WHERE contains(body, '/Type/Page/Parent')"),
    }
    # other means of the format, the same spans
    out |= dict.fromkeys(("pdf_text_moves", "pdf_text_arrays", "pdf_graphics_state", "pdf_form_xobject", "pdf_filters", "pdf_cid_widths", "pdf_encrypted_rc4", "pdf_encrypted_aes"), out["pdf_roundtrip_spans"])
    return out
