"""Problem 5: cutting documents that are too long into pieces at natural boundaries.

A document's lines are read as a tree: pages, sections under their headings, paragraphs and
lists, lines, sentences, words. A node within the limit stays whole and is merged with its
neighbouring siblings up to the limit; only a node beyond it is opened, and its parts are merged
among themselves. Each piece after the first repeats about ``overlap_chars`` characters of the text
before it, counted in its size. Documents are worked on in blocks of about 4,096 lines that start at
a page change or blank line, so the size of a document bounds no task; a block brings the lines
before it that its first piece repeats.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import blocks, in_blocks, line_texts, longest, measures

HEADING = re.compile(r"^\s*(?:\d{1,3}(?:\.\d{1,3}){0,4}[.)]?\s+\S|[IVXLC]{1,6}\.\s+\S|#{1,6}\s|\\(?:part|chapter|(?:sub)*section)\b)")
ITEM = re.compile(r"^\s*(?:[•‣▪–—*-]\s|\(?\w{1,3}\)\s|\[\d+\]|\\item\b)")
SENTENCE = re.compile(r"[.!?…。！？।॥؟][\"'”’»)\]」』]*\s*")
WORD = re.compile(r"\s+|(?<=[^\x00-\x7f])(?=[぀-鿿])")
#: profiles are read by the driver; more than this are refused
MOST_PROFILES = 1000

Node = tuple[int, int, list]


def _parts(text: str, start: int, end: int, cut: re.Pattern) -> list[Node]:
    out, at = [], start
    for m in cut.finditer(text, start, end):
        if at < m.end() < end:
            out.append((at, m.end(), []))
            at = m.end()
    out.append((at, end, []))
    return out


def _is_heading(line: str) -> bool:
    s = line.strip()
    return 0 < len(s) <= 90 and not ITEM.match(s) and (bool(HEADING.match(s)) and s[-1] not in ".!?;:," or s[-1] not in ".!?:;,।。！？” »")


def _span(children: list[Node]) -> Node:
    return (children[0][0], children[-1][1], children)


def tree(lines: list[tuple[str, int | None, bool]]) -> tuple[str, Node]:
    """The text of the lines (text, page, blank), each closed by a newline, and its tree."""
    text = "".join(t + "\n" for t, _, _ in lines)
    pages: list[list[list[Node]]] = [[[]]]  # page > paragraph > line
    heads: list[list[bool]] = [[False]]
    at, page = 0, None
    for t, p, blank in lines:
        end = at + len(t) + 1
        if p is not None and page is not None and p != page:
            pages.append([[]])
            heads.append([False])
        page = p if p is not None else page
        if blank or not t.strip():
            pages[-1][-1].append((at, end, []))
            pages[-1].append([])
            heads[-1].append(False)
        else:
            alone = not pages[-1][-1]
            heads[-1][-1] = alone and _is_heading(t)
            pages[-1][-1].append((at, end, []))
        at = end
    nodes: list[Node] = []
    for pars, head in zip(pages, heads):
        sections: list[list[Node]] = [[]]
        for par, h in zip(pars, head):
            if not par:
                continue
            if h and sections[-1]:
                sections.append([])
            sections[-1].append(_span(par))
        nodes.append(_span([_span(s) for s in sections if s]))
    return text, _span(nodes) if nodes else (0, 0, [])


def _children(text: str, node: Node, limit: int) -> list[Node]:
    """The parts of a node beyond the limit: those of the tree, of a line its sentences, else its words, else equal parts."""
    start, end, children = node
    if children:
        return children
    for cut in (SENTENCE, WORD):
        parts = _parts(text, start, end, cut)
        if len(parts) > 1:
            return parts
    return [(i, min(i + limit, end), []) for i in range(start, end, limit)]


def pack(text: str, node: Node, limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges of at most ``limit`` characters that cover the node."""
    if node[1] - node[0] <= limit:
        return [node[:2]] if node[1] > node[0] else []
    out: list[tuple[int, int]] = []
    whole = False  # the last range is made of whole siblings
    for child in _children(text, node, limit):
        a, b, _ = child
        if b - a > limit:
            out += pack(text, child, limit)
            whole = False
        elif whole and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            whole = True
    return out


def tail(text: str, overlap: int) -> str:
    """About ``overlap`` last characters of a piece, from a line, else a word, that starts there."""
    if overlap <= 0:
        return ""
    if len(text) <= overlap:
        return text
    part = text[-overlap:]
    for mark in ("\n", " "):
        i = part.find(mark, 0, max(1, overlap // 4))
        if i >= 0 and part[i + 1 :].strip():
            return part[i + 1 :]
    return part


SCHEMA = "profile string, doc string, start_char bigint, end_char bigint, first_line int, last_line int, first_page int, last_page int, overlap int, text string"


def pieces(text_lines: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every document longer than ``max_chars``, for each profile of ``limits``.

    One row a piece: profile, doc, start_char, end_char (of what the piece adds, in the document's text; they
    order the pieces), first_line, last_line, first_page, last_page, overlap (characters repeated from the text
    before) and text, never longer than max_chars. The text of a document is its lines, each followed by a
    newline; of rows with the same line_no the longest counts. Profiles with a null or
    not positive max_chars are ignored; a null overlap counts as none, one of more than half of
    max_chars as half. Empty documents are never too long. Lengths are added up from narrow rows; the texts
    of documents that are too long are shuffled once.
    """
    rows = limits.select("profile", "max_chars", "overlap_chars").where("max_chars > 0").distinct().limit(MOST_PROFILES + 1).collect()
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    profiles = [(r[0], int(r[1]), max(0, min(int(r[2] or 0), int(r[1]) // 2))) for r in rows]
    least = min((m for _, m, _ in profiles), default=1 << 62)
    context = 2 * max((o for _, _, o in profiles), default=0)
    lines = line_texts(text_lines)
    table = blocks(measures(lines), at_pages=True, context=context).where(F.col("total") > least)

    def run(key, table):
        col = {n: table[n].to_pylist() for n in ("line_no", "text", "page", "blank")}
        total, first, base = (table[n][0].as_py() for n in ("total", "first", "start_char"))
        got = longest(col["line_no"], col["text"], col["page"], col["blank"])
        before = "".join(t + "\n" for no, t, _, _ in got if no < first)
        got = [r for r in got if r[0] >= first]
        text, root = tree([(t, p, b) for _, t, p, b in got])
        starts, at = [], 0
        for _, t, _, _ in got:
            starts.append(at)
            at += len(t) + 1
        out = []
        for profile, most, overlap in profiles:
            if total <= most:
                continue
            i = 0
            for a, b in pack(text, root, most - overlap):
                while i + 1 < len(starts) and starts[i + 1] <= a:
                    i += 1
                j = i
                while j + 1 < len(starts) and starts[j + 1] < b:
                    j += 1
                paged = [p for _, _, p, _ in got[i : j + 1] if p is not None]
                past = text[max(0, a - 2 * overlap) : a] if a >= 2 * overlap else before[len(before) - min(len(before), 2 * overlap - a) :] + text[:a]
                head = tail(past, overlap)
                out.append((profile, key[0].as_py(), base + a, base + b, got[i][0], got[j][0], paged[0] if paged else None, paged[-1] if paged else None, len(head), head + text[a:b]))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        cols = list(zip(*out)) if out else [[]] * len(kinds)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

    return in_blocks(lines, table).groupBy("doc", "block").applyInArrow(run, SCHEMA)
