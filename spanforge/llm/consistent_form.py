"""Problem 3: text that looks alike but is written with different characters.

The whole rule is one SQL statement that DuckDB runs inside each Arrow partition: compatibility
forms are translated, invisible characters and odd blanks replaced, accents composed with
nfc_normalize, and words that mix scripts brought back to the script they belong to. Joiners
stay where Indic and Arabic spelling needs them, full-width punctuation beside Chinese and
Japanese, and the Indic letters Unicode itself never composes (U+0958 to U+095F and others) count
as ordinary. Only texts that hold a character or mixture of scripts the statement can act on
leave the JVM; the class of these characters is derived from the same tables.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookalikes as L


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(s: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in s)


def _ranges(s: str) -> str:
    """A character class from a string in which a-b stands for a range."""
    out, i = "", 0
    while i < len(s):
        if i + 2 < len(s) and s[i + 1] == "-":
            out += f"\\x{{{ord(s[i]):X}}}-\\x{{{ord(s[i + 2]):X}}}"
            i += 3
        else:
            out += f"\\x{{{ord(s[i]):X}}}"
            i += 1
    return out


def _never_composed() -> list[str]:
    """Indic letters that normal form C takes apart."""
    return [chr(c) for c in range(0x0900, 0x0E00) if unicodedata.normalize("NFC", chr(c)) != chr(c)]


@lru_cache(1)
def _acted_on() -> str:
    """All characters that a step before the mixing of scripts acts on."""
    one, _, many = L.compatibility()
    listed = set(one) | set(many) | set(L.fullwidth_marks()[0]) | set(L.MARKS + L.ARABIC + L.OTHER + L.JOINERS) | {"\u0e4d"}
    inner = re.compile(f"[{L.INVISIBLE}{L.BLANKS}]")
    composing = "\u09c7\u0b47\u0b92\u0bc6\u0bc7\u0c46\u0cbf\u0cc6\u0cca\u0d46\u0d47\u0dd9\u0ddc\u1025"  # with marks of class 0
    hit = lambda c: (
        c in listed or inner.match(c) or unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c
        or 0x1160 <= ord(c) < 0x1200 or unicodedata.category(c)[0] == "M" and any(unicodedata.normalize("NFC", b + c) != b + c for b in composing)
    )
    return "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]) if hit(c))


def may_change(text: Column) -> Column:
    """False only of texts the statement leaves as they are."""
    foreign = "[\\p{IsCyrillic}\\p{IsGreek}\\p{IsArmenian}\\p{IsCherokee}\\p{IsLisu}]"
    kana = "[\\u30A1-\\u30FA\\u30FC]"
    return text.rlike("[^\\x00-\\x7f]") & ((F.translate(text, _acted_on(), "") != text) | text.rlike(foreign) & text.rlike("\\p{IsLatin}") | text.rlike(f"{kana}[{L.HAN_IN_KATAKANA}]{kana}|\u0e40\u0e40"))


def statement(table: str = "spans") -> str:
    """SQL over a table with a column text: each distinct text with its consistent form."""
    one, to, many = L.compatibility()
    wide, narrow = L.fullwidth_marks()
    # a long translation is costly for each row, so its blocks are looked for first
    blocks = "".join(f"\\x{{{b.start:X}}}-\\x{{{b.stop - 1:X}}}" for b in L._ranges())
    joined = "t1"
    for ch, plain in many.items():
        joined = f"replace({joined}, {_q(ch)}, {_q(plain)})" if ord(ch) < 0x3000 or 0xFB00 <= ord(ch) < 0xFB50 else joined
    rest = {c: p for c, p in many.items() if not (ord(c) < 0x3000 or 0xFB00 <= ord(c) < 0xFB50)}
    rest_keys, rest_values = _class("".join(rest)), "MAP {" + ", ".join(f"{_q(c)}: {_q(p)}" for c, p in rest.items()) + "}"
    foreign, foreign_as = L.CYRILLIC + L.GREEK + L.OTHER, L.CYRILLIC_AS + L.GREEK_AS + L.OTHER_AS
    strong = _class(L.OTHER)
    kana = "\\x{30A1}-\\x{30FA}\\x{30FC}"
    kana_step = "x"
    for han, sign in zip(L.HAN_IN_KATAKANA, L.KATAKANA_FOR):
        kana_step = f"regexp_replace({kana_step}, '([{kana}]){han}([{kana}])', '\\1{sign}\\2', 'g')"
    letters = "\\p{L}\\p{M}"
    ordinary = "text"
    for ch in _never_composed():
        ordinary = f"replace({ordinary}, {_q(ch)}, {_q(unicodedata.normalize('NFC', ch))})"
    return f"""
WITH d AS (SELECT DISTINCT text FROM {table} WHERE regexp_matches(text, '[^\\x00-\\x7f]')),
c1 AS (SELECT text, CASE WHEN regexp_matches(text, '[{blocks}]') THEN translate(text, {_q(one)}, {_q(to)}) ELSE text END AS t1 FROM d),
c2 AS (SELECT text, CASE WHEN regexp_matches(t1, '[{_class("".join(c for c in many if c not in rest))}]') THEN {joined} ELSE t1 END AS t2 FROM c1),
c3 AS (SELECT text, CASE WHEN regexp_matches(t2, '[{rest_keys}]')
         THEN array_to_string(list_transform(string_split(t2, ''), lambda c: coalesce({rest_values}[c], c)), '') ELSE t2 END AS t3 FROM c2),
c4 AS (SELECT text, regexp_replace(regexp_replace(t3, '([\\p{{Devanagari}}\\p{{Bengali}}\\p{{Tamil}}\\p{{Telugu}}\\p{{Arabic}}\\p{{Khmer}}])\\x{{200C}}', '\\1\ufdd0', 'g'),
         '([\\p{{Devanagari}}\\p{{Bengali}}\\p{{Tamil}}\\p{{Telugu}}\\p{{Arabic}}\\p{{Khmer}}])\\x{{200D}}', '\\1\ufdd1', 'g') AS t4 FROM c3),
c5 AS (SELECT text, translate(regexp_replace(regexp_replace(t4, '[{_ranges(L.INVISIBLE)}{_class(L.JOINERS)}]', '', 'g'), '[{_ranges(L.BLANKS)}]', ' ', 'g'),
         '\ufdd0\ufdd1', {_q(L.JOINERS)}) AS t5 FROM c4),
c6 AS (SELECT text, replace(replace(nfc_normalize(translate(t5, {_q(L.MARKS)}, {_q(L.MARKS_AS)})), chr(3661) || chr(3634), chr(3635)), chr(3648) || chr(3648), chr(3649)) AS t6 FROM c5),
c7 AS (SELECT text, CASE WHEN regexp_matches(t6, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]') THEN t6 ELSE translate(t6, {_q(wide)}, {_q(narrow)}) END AS t7 FROM c6),
w0 AS (SELECT text, t7, CASE WHEN regexp_matches(t7, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}\\p{{Cherokee}}\\p{{Lisu}}{strong}{_class(L.ARABIC)}]') THEN regexp_extract_all(t7, '[{letters}]+|[^{letters}]+') ELSE NULL END AS words FROM c7),
w1 AS (SELECT text, t7, list_transform(words, lambda w:
    CASE
      WHEN regexp_matches(w, '\\p{{Arabic}}') THEN translate(w, {_q(L.ARABIC)}, {_q(L.ARABIC_AS)})
      WHEN NOT regexp_matches(w, '\\p{{Latin}}') AND NOT regexp_matches(w, '[{strong}]') THEN
        CASE WHEN regexp_full_match(w, '[{_class(L.CYRILLIC.lower())}]{{2,}}') AND regexp_matches(t7, '\\p{{Latin}}') AND NOT regexp_matches(translate(t7, {_q(L.CYRILLIC)}, ''), '\\p{{Cyrillic}}')
             THEN translate(w, {_q(foreign)}, {_q(foreign_as)}) ELSE w END
      WHEN NOT regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}\\p{{Cherokee}}\\p{{Lisu}}{strong}]') THEN w
      WHEN regexp_full_match(w, '\\p{{Armenian}}+|\\p{{Cherokee}}+|\\p{{Lisu}}+')
        THEN CASE WHEN regexp_matches(t7, '\\p{{Latin}}') AND NOT regexp_matches(translate(t7, {_q(L.OTHER)}, ''), '[\\p{{Armenian}}\\p{{Cherokee}}\\p{{Lisu}}]')
                  THEN translate(w, {_q(foreign)}, {_q(foreign_as)}) ELSE w END
      WHEN regexp_matches(w, '\\p{{Cyrillic}}')
           AND NOT regexp_matches(translate(w, {_q(L.LATIN_IN_CYRILLIC)}, {_q(L.CYRILLIC_FOR)}), '\\p{{Latin}}')
           AND (regexp_matches(translate(w, {_q(foreign)}, {_q(foreign_as)}), '\\p{{Cyrillic}}') OR length(regexp_replace(w, '[^\\p{{Cyrillic}}]', '', 'g')) > length(regexp_replace(w, '[^\\p{{Latin}}]', '', 'g')))
        THEN translate(w, {_q(L.LATIN_IN_CYRILLIC)}, {_q(L.CYRILLIC_FOR)})
      WHEN regexp_matches(w, '\\p{{Greek}}')
           AND NOT regexp_matches(translate(w, {_q(L.LATIN_IN_GREEK)}, {_q(L.GREEK_FOR)}), '\\p{{Latin}}')
           AND (regexp_matches(translate(w, {_q(foreign)}, {_q(foreign_as)}), '\\p{{Greek}}') OR length(regexp_replace(w, '[^\\p{{Greek}}]', '', 'g')) > length(regexp_replace(w, '[^\\p{{Latin}}]', '', 'g')))
        THEN translate(w, {_q(L.LATIN_IN_GREEK)}, {_q(L.GREEK_FOR)})
      WHEN NOT regexp_matches(translate(w, {_q(foreign)}, {_q(foreign_as)}), '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}]')
           AND (length(regexp_replace(w, '[^\\p{{Latin}}]', '', 'g')) >= 2 OR NOT regexp_matches(w, '[αρυικχγν]'))
        THEN translate(w, {_q(foreign)}, {_q(foreign_as)})
      ELSE w END) AS words FROM w0),
k AS (SELECT text, CASE WHEN words IS NULL THEN t7 ELSE array_to_string(words, '') END AS x FROM w1),
f AS (SELECT text, nfc_normalize(CASE WHEN regexp_matches(x, '[{kana}][{L.HAN_IN_KATAKANA}][{kana}]') THEN {kana_step} ELSE x END) AS normalized FROM k)
SELECT text, normalized, normalized <> {ordinary} AS changed FROM f
"""


SCHEMA = "doc string, page_num int, span_seq bigint, text string, normalized string, changed boolean"


def _in_duckdb(spans: DataFrame) -> DataFrame:
    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        sql = statement()
        for batch in batches:
            con.register("spans", pa.Table.from_batches([batch]))
            got = con.sql(
                f"SELECT s.doc, s.page_num, s.span_seq, s.text, coalesce(n.normalized, s.text) AS normalized, coalesce(n.changed, false) AS changed FROM spans s LEFT JOIN ({sql}) n ON s.text = n.text"
            ).to_arrow_table()
            yield from got.cast(pa.schema([("doc", pa.string()), ("page_num", pa.int32()), ("span_seq", pa.int64()), ("text", pa.string()), ("normalized", pa.string()), ("changed", pa.bool_())])).to_batches()

    return spans.mapInArrow(run, SCHEMA)


def _columns(spans: DataFrame) -> DataFrame:
    return spans.select(F.col("doc").cast("string"), F.col("page_num").cast("int"), F.col("span_seq").cast("bigint"), F.col("text").cast("string"))


def changed_spans(spans: DataFrame) -> DataFrame:
    """The rows of ``consistent_form`` whose text changes."""
    return _in_duckdb(_columns(spans).where(may_change(F.col("text")))).where("changed")


def consistent_form(spans: DataFrame) -> DataFrame:
    """Every row of ``spans`` (doc, page_num, span_seq, text) with its text in one consistent form.

    A null text stays null, an empty one empty, both unchanged; other columns are ignored. No
    shuffle: DuckDB works on each Arrow batch.
    """
    rows = _columns(spans)
    open_to = F.coalesce(may_change(F.col("text")), F.lit(False))
    return _in_duckdb(rows.where(open_to)).union(rows.where(~open_to).select("*", F.col("text").alias("normalized"), F.lit(False).alias("changed")))
