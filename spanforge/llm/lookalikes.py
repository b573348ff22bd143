"""Characters that look like others: the tables problems 1 and 3 share."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "аеорсухіѕјһԁԛԝАЕКМНОРСТУХІЅЈВԚ"
CYRILLIC_AS = "aeopcyxisjhdqwAEKMHOPCTYXISJBQ"
GREEK = "οναρυικχγόάίύΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ"
GREEK_AS = "ovapuikxyóáíúABEZHIKMNOPTYXcj"
OTHER = "ɑɡօհսոցɩꓐꓓꓔᎪᎬᎷᏟᏢᎢᎻ"
OTHER_AS = "agohunqiBDTAEMCPTH"
# Latin letters used for Cyrillic and Greek ones.
LATIN_IN_CYRILLIC = "aeopcyxisjhëïAEKMHOPCTYXISJB"
CYRILLIC_FOR = "аеорсухіѕјһёїАЕКМНОРСТУХІЅЈВ"
LATIN_IN_GREEK = "ovapuikxyóáíúABEZHIKMNOPTYX"
GREEK_FOR = "οναρυικχγόάίύΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
# Signs, hyphens and marks.
MARKS = "‐‑⁃˗ʼʻ։׃꞉∶․∗∣ǃ٭∕❘ˮ＇"
MARKS_AS = "----’‘::::.*|!*/|”'"
#: Persian and Urdu forms of Arabic letters
ARABIC = "کیہەۀ"
ARABIC_AS = "كيههه"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‎‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
JOINERS = "‌‍"
BLANKS = "   -   　"
#: Han signs that look like kana, and the kana; only between katakana are they taken for them
HAN_IN_KATAKANA = "一二力口工卜夕八へ"
KATAKANA_FOR = "ーニカロエトタハヘ"


def _ranges() -> list[range]:
    """Blocks of compatibility characters that stand for ordinary letters and digits."""
    return [
        range(0x0132, 0x0134), range(0x013F, 0x0141), range(0x0149, 0x014A), range(0x017F, 0x0180), range(0x01C4, 0x01CD), range(0x01F1, 0x01F4),
        range(0x2102, 0x2103), range(0x210A, 0x2116), range(0x2119, 0x211E), range(0x2124, 0x2140), range(0x2145, 0x214A), range(0x2160, 0x2180),
        range(0x2460, 0x24EB), range(0x2E80, 0x2FE0), range(0x3200, 0x3400), range(0xFB00, 0xFB50), range(0xFB50, 0xFDFC), range(0xFE70, 0xFEFD),
        range(0xFF10, 0xFF1A), range(0xFF21, 0xFF3B), range(0xFF41, 0xFF5B), range(0xFF61, 0xFFDD), range(0x1D400, 0x1D800), range(0x1F100, 0x1F16A),
    ]


@lru_cache(1)
def compatibility() -> tuple[str, str, dict[str, str]]:
    """Single characters with the single ones they stand for, and those that stand for several.

    Derived from Unicode's compatibility decompositions over the blocks above, so no list is kept.
    """
    one, to, many = [], [], {}
    for block in _ranges():
        for cp in block:
            ch = chr(cp)
            plain = unicodedata.normalize("NFKC", ch)
            if plain == ch or unicodedata.category(ch) == "Cn":
                continue
            if len(plain) == 1:
                one.append(ch)
                to.append(plain)
            elif any(c.isalnum() for c in plain):
                many[ch] = plain
    return "".join(one), "".join(to), many


@lru_cache(1)
def fullwidth_marks() -> tuple[str, str]:
    """Full-width punctuation, which is ordinary only beside Chinese, Japanese or Korean."""
    wide = [chr(c) for c in range(0xFF01, 0xFF5F) if not chr(c).isalnum()]
    return "".join(wide), "".join(chr(ord(c) - 0xFEE0) for c in wide)


_TO_LATIN = str.maketrans(CYRILLIC + GREEK + OTHER, CYRILLIC_AS + GREEK_AS + OTHER_AS)
_DROP = {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x200E: None, 0x2060: None, 0xFEFF: None, 0xA0: " ", 0x2010: "-", 0x2011: "-"}
_TO_LATIN_ANY, _DROP_ANY = (re.compile(f"[{''.join(map(chr, table))}]") for table in (_TO_LATIN, _DROP))


def plain_forms(token: str) -> list[str]:
    """The token without look-alikes, so that those are not taken for wrong decoding."""
    kept = token.translate(_DROP) if _DROP_ANY.search(token) else token
    bare = unicodedata.normalize("NFKC", kept)
    out = {bare, kept}
    if _TO_LATIN_ANY.search(bare) and any("a" <= c.lower() <= "z" for c in bare):
        out.add(bare.translate(_TO_LATIN))
    out.discard(token)
    return sorted(out)
