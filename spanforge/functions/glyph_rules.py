"""Families of glyph names that follow from the names Unicode gives the characters, or from their order."""

from __future__ import annotations

import re
import unicodedata

DIGITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _bare(words: str) -> str:
    return re.sub(r" WITH | AND |[ -]", "", words).lower()


def _named(first: int, last: int):
    for cp in range(first, last + 1):
        name = unicodedata.name(chr(cp), "")
        if name:
            yield cp, name


def enclosed() -> dict[str, int]:
    """Circled, bracketed and dotted letters and numbers, Roman numerals, full-width forms, digits of other scripts."""
    out: dict[str, int] = {}
    for i, c in enumerate(LETTERS):
        out |= {c.upper() + "circle": 0x24B6 + i, c + "circle": 0x24D0 + i, c + "paren": 0x249C + i, c.upper() + "monospace": 0xFF21 + i, c + "monospace": 0xFF41 + i}
    for i, d in enumerate(DIGITS[1:]):
        out |= {d + "circle": 0x2460 + i, d + "paren": 0x2474 + i, d + "period": 0x2488 + i}
        if i < 12:
            out |= {d.capitalize() + "roman": 0x2160 + i, d + "roman": 0x2170 + i}
        if i < 10:
            out[d + "ideographicparen"] = 0x3220 + i
        if i < 9:
            out |= {d + "hangzhou": 0x3021 + i, d + "circleinversesansserif": 0x278A + i}
    for i, d in enumerate(DIGITS[:10]):
        for script, zero in (("arabic", 0x660), ("hackarabic", 0x660), ("persian", 0x6F0), ("deva", 0x966), ("bengali", 0x9E6), ("gurmukhi", 0xA66), ("gujarati", 0xAE6), ("thai", 0xE50), ("monospace", 0xFF10)):
            out[d + script] = zero + i
    return out | {"twentyhangzhou": 0x5344}


def arabic() -> dict[str, int]:
    """Letters by their names, and their shapes by name and place in the word; some ligatures."""
    out: dict[str, int] = {}
    for cp, name in [*_named(0x621, 0x6D5), *_named(0xFB50, 0xFDF2), *_named(0xFE80, 0xFEFC)]:
        m = re.fullmatch(r"ARABIC (LETTER|LIGATURE) (.+?)(?: (ISOLATED|FINAL|INITIAL|MEDIAL) FORM)?", name)
        if m and (m[3] != "ISOLATED" or m[1] == "LIGATURE"):
            place = (m[3] or "").lower() if not m[2].startswith("SHADDA") else ""
            out.setdefault(_bare(m[2]) + place + "arabic", cp)
        m = re.fullmatch(r"ARABIC (FATHATAN|DAMMATAN|KASRATAN|FATHA|DAMMA|KASRA|SHADDA|SUKUN|COMMA|SEMICOLON|TATWEEL|PERCENT SIGN|QUESTION MARK)", name)
        if m:
            out[_bare(re.sub(" SIGN| MARK", "", m[1])) + "arabic"] = cp
    # Names beside the rule.
    return out | {
        "commaarabic": 0x60C, "semicolonarabic": 0x61B, "questionarabic": 0x61F, "percentarabic": 0x66A, "decimalseparatorarabic": 0x66B, "decimalseparatorpersian": 0x66B, "thousandsseparatorarabic": 0x66C, "thousandsseparatorpersian": 0x66C,
        "asteriskarabic": 0x66D, "asteriskaltonearabic": 0x66D, "dammalowarabic": 0x64F, "fathalowarabic": 0x64E, "dammatanaltonearabic": 0x64C, "kashidaautoarabic": 0x640, "kashidaautonosidebearingarabic": 0x640,
        "haaltonearabic": 0x6C1, "hehaltonearabic": 0x6C1, "hehfinalaltonearabic": 0xFBA7, "hehinitialaltonearabic": 0xFBA8, "hehmedialaltonearabic": 0xFBA9, "hehfinalalttwoarabic": 0xFEEA, "alefmaksurainitialarabic": 0xFEF3,
        "alefmaksuramedialarabic": 0xFEF4, "noonhehinitialarabic": 0xFEE7, "lammeemjeeminitialarabic": 0xFEDF, "lammeemkhahinitialarabic": 0xFEDF, "tchehmeeminitialarabic": 0xFB7C, "rehyehaleflamarabic": 0x631, "spacehackarabic": 0x20,
        "parenleftaltonearabic": 0xFD3E, "parenrightaltonearabic": 0xFD3F, "lamlamhehisolatedarabic": 0xFDF2, "sallallahoualayhewasallamarabic": 0xFDFA, "shaddafathatanarabic": 0x651, "hamzadammaarabic": 0x621, "hamzadammatanarabic": 0x621,
        "hamzafathaarabic": 0x621, "hamzafathatanarabic": 0x621, "hamzalowarabic": 0x621, "hamzalowkasraarabic": 0x621, "hamzalowkasratanarabic": 0x621, "hamzasukunarabic": 0x621, "yehthreedotsbelowarabic": 0x6D1,
    }


#: numbered variants of the Hebrew points, as some fonts have them
POINT_VARIANTS = {"sheva": "115 15 22 2e", "hatafsegol": "17 24 30", "hatafpatah": "16 23 2f", "hatafqamats": "1b 28 34", "hiriq": "14 21 2d", "tsere": "12 1e 2b", "segol": "13 1f 2c", "patah": "11 1d 2a", "qamats": "10 1a 1c 27 29 33 de", "holam": "19 26 32", "qubuts": "18 25 31"}


def hebrew() -> dict[str, int]:
    """Letters, with points where one character holds both, points, accents."""
    out: dict[str, int] = {}
    for cp, name in [*_named(0x5D0, 0x5EA), *_named(0xFB1D, 0xFB4F)]:
        m = re.fullmatch(r"HEBREW LETTER (.+)", name)
        if m and "WIDE" not in name and "ALTERNATIVE" not in name and not name.endswith("JUDEO-SPANISH"):
            word = _bare(m[1].replace("MAPIQ", "DAGESH"))
            out |= {word: cp, word + "hebrew": cp}
    for cp, name in _named(0x591, 0x5C4):
        m = re.fullmatch(r"HEBREW (?:ACCENT|POINT|PUNCTUATION|MARK) (.+)", name)
        if m:
            word = _bare(m[1].replace(" OR MAPIQ", ""))
            word = {"segol": "segolta", "geresh": "gereshaccent", "gershayim": "gershayimaccent"}.get(word, word) if name.startswith("HEBREW ACCENT") else word
            out[word + "hebrew"] = cp
            if name.startswith("HEBREW POINT"):
                out[word] = cp
    for word, numbers in POINT_VARIANTS.items():
        out |= {word + n: out[word] for n in numbers.split()} | {word + w + "hebrew": out[word] for w in ("narrow", "quarter", "wide")}
    for letter in ("dalet", "qof", "resh"):
        for point in ("hatafpatah", "hatafsegol", "hiriq", "holam", "patah", "qamats", "qubuts", "segol", "sheva", "tsere"):
            out |= {letter + point: out[letter], letter + point + "hebrew": out[letter]}
    for word in ("etnahta", "darga", "mahapakh", "merkha", "merkhakefula", "munah", "tevir", "tipeha", "yerahbenyomo"):
        out[word + "lefthebrew"] = out[word + "hebrew"]
    # Names beside the rule.
    return out | {
        "geresh": 0x5F3, "gereshhebrew": 0x5F3, "gershayimhebrew": 0x5F4, "siluqhebrew": 0x5BD, "siluqlefthebrew": 0x5BD, "reviamugrashhebrew": 0x597, "etnahtafoukhhebrew": 0x591, "etnahtafoukhlefthebrew": 0x591, "vavvavhebrew": 0x5F0, "vavyodhebrew": 0x5F1,
        "yodyodhebrew": 0x5F2, "doubleyodpatah": 0xFB1F, "doubleyodpatahhebrew": 0xFB1F, "yodyodpatahhebrew": 0xFB1F, "pefinaldageshhebrew": 0xFB43, "tavdages": 0xFB4A, "vavdagesh65": 0xFB35, "ayinaltonehebrew": 0xFB20, "aleflamedhebrew": 0xFB4F,
        "finalkafqamats": 0x5DA, "finalkafqamatshebrew": 0x5DA, "finalkafsheva": 0x5DA, "finalkafshevahebrew": 0x5DA, "lamedholam": 0x5DC, "lamedholamhebrew": 0x5DC, "lamedholamdagesh": 0x5DC, "lamedholamdageshhebrew": 0x5DC, "newsheqelsign": 0x20AA,
        "sheqel": 0x20AA, "sheqelhebrew": 0x20AA, "shindageshshindot": 0xFB2C, "shindageshshindothebrew": 0xFB2C, "shindageshsindot": 0xFB2D, "shindageshsindothebrew": 0xFB2D, "qamatsqatanhebrew": 0x5B8, "qamatsqatannarrowhebrew": 0x5B8,
        "qamatsqatanquarterhebrew": 0x5B8, "qamatsqatanwidehebrew": 0x5B8, "beth": 0x2136, "daleth": 0x2138, "aleph": 0x2135,
    }


def cyrillic() -> dict[str, int]:
    """Letters by their names: what qualifies the letter comes after it."""
    own = {"BYELORUSSIAN-UKRAINIAN I": "i", "UKRAINIAN IE": "e", "I": "ii", "E": "ereversed", "YERU": "yeri", "YU": "iu", "YA": "ia", "SHORT I": "iishort"}
    marks = {"DIAERESIS": "dieresis", "DOUBLE ACUTE": "hungarumlaut", "DOUBLE GRAVE ACCENT": "dblgrave"}
    before = ("ABKHASIAN", "KHAKASSIAN", "BASHKIR", "STRAIGHT", "BARRED", "ROUND", "IOTIFIED", "LITTLE", "BIG", "SHORT")
    out: dict[str, int] = {}
    for cp, name in _named(0x400, 0x4F9):
        m = re.fullmatch(r"CYRILLIC (CAPITAL|SMALL) (?:LETTER|LIGATURE) (.+?)(?: WITH (.+))?", name)
        if not m:
            continue
        words = m[2].split(" ")
        told = [w.lower() for w in words if w in before][::-1]
        base = own.get(m[2]) if m[3] is None else None
        if base is None:
            base = _bare(" ".join(w for w in words if w not in before))
        else:
            told = []
        tail = marks.get(m[3], _bare(m[3] or ""))
        word = base + (tail + "".join(told) if "abkhasian" in told else "".join(told) + tail)
        out[(("IU" if base == "iu" else "IA" if base == "ia" else word.capitalize()) if m[1] == "CAPITAL" else word) + "cyrillic"] = cp
    return out | {"palochkacyrillic": 0x4C0, "thousandcyrillic": 0x482, "titlocyrilliccmb": 0x483, "palatalizationcyrilliccmb": 0x484, "dasiapneumatacyrilliccmb": 0x485, "psilipneumatacyrilliccmb": 0x486}


def indic() -> dict[str, int]:
    """Letters, vowel signs and marks of four scripts of India."""
    out: dict[str, int] = {}
    scripts = {"DEVANAGARI": "deva", "BENGALI": "bengali", "GUJARATI": "gujarati", "GURMUKHI": "gurmukhi"}
    for cp, name in _named(0x900, 0xAFF):
        script, _, rest = name.partition(" ")
        m = re.fullmatch(r"(LETTER|VOWEL SIGN|SIGN) (VOCALIC |CANDRA |SHORT )?([A-Z]+)", rest)
        if script not in scripts or not m:
            continue
        kind = {"LETTER": "", "SIGN": "", "VOWEL SIGN": "matra" if script == "GURMUKHI" else "vowelsign"}[m[1]]
        word = {"VIRAMA": "halant"}.get(m[3], m[3]) if script == "GURMUKHI" else m[3]
        out[word.lower() + (m[2] or "").strip().lower() + kind + scripts[script]] = cp
    # Names beside the rule.
    return out | {
        "omdeva": 0x950, "omgujarati": 0xAD0, "udattadeva": 0x951, "anudattadeva": 0x952, "gravedeva": 0x953, "acutedeva": 0x954, "danda": 0x964, "dbldanda": 0x965, "abbreviationsigndeva": 0x970, "aulengthmarkbengali": 0x9D7,
        "ralowerdiagonalbengali": 0x9F1, "ramiddlediagonalbengali": 0x9F0, "rupeemarkbengali": 0x9F2, "rupeesignbengali": 0x9F3, "onenumeratorbengali": 0x9F4, "twonumeratorbengali": 0x9F5, "threenumeratorbengali": 0x9F6, "fournumeratorbengali": 0x9F7,
        "denominatorminusonenumeratorbengali": 0x9F8, "sixteencurrencydenominatorbengali": 0x9F9, "issharbengali": 0x9FA, "addakgurmukhi": 0xA71, "tippigurmukhi": 0xA70, "bindigurmukhi": 0xA02, "irigurmukhi": 0xA72, "uragurmukhi": 0xA73, "ekonkargurmukhi": 0xA74,
    }


def east_asian() -> dict[str, int]:
    """Kana, half-width kana, bopomofo, Korean letters, Thai, Armenian and Coptic."""
    out: dict[str, int] = {}
    for first, last, pattern, tail in (
        (0x3041, 0x3094, r"HIRAGANA LETTER (SMALL )?([A-Z]+)", "hiragana"), (0x30A1, 0x30FA, r"KATAKANA LETTER (SMALL )?([A-Z]+)", "katakana"),
        (0xFF66, 0xFF9D, r"HALFWIDTH KATAKANA LETTER (SMALL )?([A-Z]+)", "katakanahalfwidth"), (0x3105, 0x3129, r"BOPOMOFO LETTER (SMALL )?([A-Z]+)", "bopomofo"),
    ):
        for cp, name in _named(first, last):
            m = re.fullmatch(pattern, name)
            if m:
                out[m[2].lower() + ("small" if m[1] else "") + tail] = cp
    for first, last, pattern, tail in (
        (0x3131, 0x318E, r"HANGUL (?:LETTER )?(.+)", "korean"), (0x3200, 0x321C, r"PARENTHESIZED HANGUL (.+)", "parenkorean"), (0x3260, 0x327B, r"CIRCLED HANGUL (.+)", "circlekorean"), (0xE01, 0xE5B, r"THAI CHARACTER (.+)", "thai"),
    ):
        for cp, name in _named(first, last):
            m = re.fullmatch(pattern, name)
            if m:
                out[_bare(m[1]) + tail] = cp
    for cp, name in [*_named(0x531, 0x587), *_named(0x3E2, 0x3EF)]:
        m = re.fullmatch(r"(ARMENIAN|COPTIC) (CAPITAL|SMALL) (?:LETTER|LIGATURE) (.+)", name)
        if m:
            word = _bare(m[3])
            out[(word.capitalize() if m[2] == "CAPITAL" else word) + m[1].lower()] = cp
    # Names beside the rule.
    return out | {
        "abbreviationmarkarmenian": 0x55F, "apostrophearmenian": 0x55A, "commaarmenian": 0x55D, "emphasismarkarmenian": 0x55B, "exclamarmenian": 0x55C, "periodarmenian": 0x589, "questionarmenian": 0x55E, "ringhalfleftarmenian": 0x559, "bahtthai": 0xE3F,
        "hangulfiller": 0x3164, "iterationhiragana": 0x309D, "voicediterationhiragana": 0x309E, "iterationkatakana": 0x30FD, "voicediterationkatakana": 0x30FE, "voicedmarkkana": 0x309B, "semivoicedmarkkana": 0x309C, "prolongedkana": 0x30FC, "dotkatakana": 0x30FB,
        "katahiraprolongmarkhalfwidth": 0xFF70, "voicedmarkkanahalfwidth": 0xFF9E, "semivoicedmarkkanahalfwidth": 0xFF9F, "middledotkatakanahalfwidth": 0xFF65, "periodhalfwidth": 0xFF61, "cornerbracketlefthalfwidth": 0xFF62, "cornerbracketrighthalfwidth": 0xFF63,
        "ideographicspace": 0x3000, "ideographiccomma": 0x3001, "ideographicperiod": 0x3002, "dittomark": 0x3003, "jis": 0x3004, "ideographiciterationmark": 0x3005, "ideographicclose": 0x3006, "ideographiczero": 0x3007, "postalmark": 0x3012, "getamark": 0x3013,
        "anglebracketleft": 0x3008, "anglebracketright": 0x3009, "dblanglebracketleft": 0x300A, "dblanglebracketright": 0x300B, "cornerbracketleft": 0x300C, "cornerbracketright": 0x300D, "whitecornerbracketleft": 0x300E, "whitecornerbracketright": 0x300F,
        "blacklenticularbracketleft": 0x3010, "blacklenticularbracketright": 0x3011, "tortoiseshellbracketleft": 0x3014, "tortoiseshellbracketright": 0x3015, "wavedash": 0x301C, "quotedblprimereversed": 0x301D, "quotedblprime": 0x301E,
    }


def latin() -> dict[str, int]:
    """Letters with hooks, strokes and bars, turned and small ones, by their names."""
    out: dict[str, int] = {}
    for cp, name in _named(0x180, 0x2A0):
        m = re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER (TURNED |REVERSED |OPEN )?([A-Z]+)(?: WITH (HOOK|STROKE|TOPBAR|RETROFLEX HOOK|TAIL|CURL|BAR|BELT))?", name)
        if m and (m[2] or m[4]) and len(m[3]) < 6:
            word = m[3].lower() + (m[2] or "").strip().lower() + _bare(m[4] or "")
            out[word.capitalize() if m[1] == "CAPITAL" else word] = cp
    return out


#: what a mark is called where it is combining
COMBINING = {
    "GRAVE ACCENT": "grave", "ACUTE ACCENT": "acute", "CIRCUMFLEX ACCENT": "circumflex", "TILDE": "tilde", "MACRON": "macron", "OVERLINE": "overline", "BREVE": "breve", "DOT ABOVE": "dotaccent", "DIAERESIS": "dieresis", "HOOK ABOVE": "hook", "RING ABOVE": "ring",
    "DOUBLE ACUTE ACCENT": "hungarumlaut", "CARON": "caron", "VERTICAL LINE ABOVE": "verticallineabove", "DOUBLE VERTICAL LINE ABOVE": "dblverticallineabove", "DOUBLE GRAVE ACCENT": "dblgrave", "CANDRABINDU": "candrabindu", "INVERTED BREVE": "breveinverted",
    "TURNED COMMA ABOVE": "commaturnedabove", "COMMA ABOVE": "commaabove", "REVERSED COMMA ABOVE": "commareversedabove", "COMMA ABOVE RIGHT": "commaaboveright", "GRAVE ACCENT BELOW": "gravebelow", "ACUTE ACCENT BELOW": "acutebelow", "LEFT TACK BELOW": "lefttackbelow",
    "RIGHT TACK BELOW": "righttackbelow", "LEFT ANGLE ABOVE": "leftangleabove", "HORN": "horn", "LEFT HALF RING BELOW": "ringhalfleftbelow", "UP TACK BELOW": "uptackbelow", "DOWN TACK BELOW": "downtackbelow", "PLUS SIGN BELOW": "plusbelow", "MINUS SIGN BELOW": "minusbelow",
    "PALATALIZED HOOK BELOW": "hookpalatalizedbelow", "RETROFLEX HOOK BELOW": "hookretroflexbelow", "DOT BELOW": "dotbelow", "DIAERESIS BELOW": "dieresisbelow", "RING BELOW": "ringbelow", "CEDILLA": "cedilla", "OGONEK": "ogonek", "VERTICAL LINE BELOW": "verticallinebelow",
    "BRIDGE BELOW": "bridgebelow", "INVERTED DOUBLE ARCH BELOW": "dblarchinvertedbelow", "CARON BELOW": "caronbelow", "CIRCUMFLEX ACCENT BELOW": "circumflexbelow", "BREVE BELOW": "brevebelow", "INVERTED BREVE BELOW": "breveinvertedbelow", "TILDE BELOW": "tildebelow",
    "MACRON BELOW": "macronbelow", "LOW LINE": "lowline", "DOUBLE LOW LINE": "dbllowline", "TILDE OVERLAY": "tildeoverlay", "SHORT STROKE OVERLAY": "strokeshortoverlay", "LONG STROKE OVERLAY": "strokelongoverlay", "SHORT SOLIDUS OVERLAY": "solidusshortoverlay",
    "LONG SOLIDUS OVERLAY": "soliduslongoverlay", "RIGHT HALF RING BELOW": "ringhalfrightbelow", "INVERTED BRIDGE BELOW": "bridgeinvertedbelow", "SQUARE BELOW": "squarebelow", "SEAGULL BELOW": "seagullbelow", "X ABOVE": "xabove", "VERTICAL TILDE": "tildevertical",
    "DOUBLE OVERLINE": "dbloverline", "GRAVE TONE MARK": "gravetone", "ACUTE TONE MARK": "acutetone", "GREEK PERISPOMENI": "perispomenigreek", "GREEK KORONIS": "koronis", "GREEK DIALYTIKA TONOS": "dialytikatonos", "GREEK YPOGEGRAMMENI": "ypogegrammenigreek",
    "DOUBLE TILDE": "tildedouble", "DOUBLE INVERTED BREVE": "breveinverteddouble",
}


def combining() -> dict[str, int]:
    out = {COMBINING[name[10:]] + "cmb": cp for cp, name in _named(0x300, 0x361) if name[10:] in COMBINING}
    return out | {"gravecomb": 0x300, "acutecomb": 0x301, "tildecomb": 0x303, "hookabovecomb": 0x309, "dotbelowcomb": 0x323}


def delimiters() -> dict[str, int]:
    """Large forms of brackets and signs in mathematical fonts stand for the plain ones."""
    bases = {
        "parenleft": 0x28, "parenright": 0x29, "bracketleft": 0x5B, "bracketright": 0x5D, "braceleft": 0x7B, "braceright": 0x7D, "angbracketleft": 0x2329, "angbracketright": 0x232A, "angleleft": 0x2329, "angleright": 0x232A,
        "ceilingleft": 0x2308, "ceilingright": 0x2309, "floorleft": 0x230A, "floorright": 0x230B, "backslash": 0x5C, "slash": 0x2215, "radical": 0x221A,
    }
    out = {b + size: cp for b, cp in bases.items() for size in ("big", "Big", "bigg", "Bigg")}
    for b, cp in {"circledot": 0x2299, "circlemultiply": 0x2297, "circleplus": 0x2295, "coproduct": 0x2210, "integral": 0x222B, "intersection": 0x22C2, "union": 0x22C3, "logicaland": 0x22C0, "logicalor": 0x22C1, "product": 0x220F, "summation": 0x2211, "unionmulti": 0x228E, "unionsq": 0x2294, "contintegral": 0x222E}.items():
        out |= {b + "display": cp, b + "text": cp}
    return out | {"ceilingleft": 0x2308, "ceilingright": 0x2309, "floorleft": 0x230A, "floorright": 0x230B, "angbracketleft": 0x27E8, "angbracketright": 0x27E9, "coproducttext": 0x2210, "parenleftmath": 0x28, "parenrightmath": 0x29, "bracketleftmath": 0x5B, "bracketrightmath": 0x5D, "plusmath": 0x2B, "equalmath": 0x3D}


# Controls in the order of their codes, box drawing names by code, unit squares in the order of their codes.
CONTROLS = "NULL STX SOT ETX EOT ENQ ACK BEL BS HT LF VT FF CR SO SI DLE DC1 DC2 DC3 DC4 NAK SYN ETB CAN EM SUB ESC FS GS RS US".split()
BOXES = {
    1: 0x250C, 2: 0x2514, 3: 0x2510, 4: 0x2518, 5: 0x253C, 6: 0x252C, 7: 0x2534, 8: 0x251C, 9: 0x2524, 10: 0x2500, 11: 0x2502, 19: 0x2561, 20: 0x2562, 21: 0x2556, 22: 0x2555, 23: 0x2563, 24: 0x2551, 25: 0x2557, 26: 0x255D, 27: 0x255C, 28: 0x255B,
    36: 0x255E, 37: 0x255F, 38: 0x255A, 39: 0x2554, 40: 0x2569, 41: 0x2566, 42: 0x2560, 43: 0x2550, 44: 0x256C, 45: 0x2567, 46: 0x2568, 47: 0x2564, 48: 0x2565, 49: 0x2559, 50: 0x2558, 51: 0x2552, 52: 0x2553, 53: 0x256B, 54: 0x256A,
}
SQUARES = (
    "paamps na mua ma ka KB MB GB cal kcal pf nf muf mug - - Hz khz mhz ghz thz mul ml dl kl fm nm mum - - - mmsquared cmsquared - kmsquared mmcubed cmcubed mcubed kmcubed moverss moverssquared pa kpa mpa gpa rad radoverss radoverssquared "
    "ps ns mus ms pv nv muv mv kv mvmega pw nw muw mw kw mwmega kohm mohm am bq - cd coverkg co db gy ha HP - KK - kt lm - - lx mb - mol - pm - - sr sv wb"
).split()


def squares() -> dict[str, int]:
    out = {n + "square": 0x3380 + i for i, n in enumerate(SQUARES) if n != "-"}
    out |= {"square" + n: cp for n, cp in {"mg": 0x338E, "kg": 0x338F, "mm": 0x339C, "cm": 0x339D, "km": 0x339E, "msquared": 0x33A1, "cc": 0x33C4, "kmcapital": 0x33CE, "ln": 0x33D1, "log": 0x33D2, "mil": 0x33D5}.items()}
    out |= {"control" + n: i for i, n in enumerate(CONTROLS) if n not in ("NULL",)} | {"controlDEL": 0x7F}
    return out | {f"SF{n:02d}0000": cp for n, cp in BOXES.items()}


# Signs no rule names.
SIGNS = {
    "arrowdashdown": 0x21E3, "arrowdashleft": 0x21E0, "arrowdashright": 0x21E2, "arrowdashup": 0x21E1, "arrowdblbothv": 0x21D5, "arrowdbltp": 0x21D1, "arrowdownleft": 0x2199, "arrowdownright": 0x2198, "arrowdownwhite": 0x21E9, "arrowhookleft": 0x21AA, "arrowhookright": 0x21A9,
    "arrowleftdbl": 0x21D0, "arrowleftdblstroke": 0x21CD, "arrowleftoverright": 0x21C6, "arrowleftwhite": 0x21E6, "arrownortheast": 0x2197, "arrownorthwest": 0x2196, "arrowsoutheast": 0x2198, "arrowsouthwest": 0x2199, "arrowrightdblstroke": 0x21CF, "arrowrightheavy": 0x279E,
    "arrowrightoverleft": 0x21C4, "arrowrightwhite": 0x21E8, "arrowtableft": 0x21E4, "arrowtabright": 0x21E5, "arrowtailleft": 0x21A2, "arrowtailright": 0x21A3, "arrowtripleleft": 0x21DA, "arrowtripleright": 0x21DB, "arrowupdnbse": 0x21A8, "arrowupleft": 0x2196, "arrowupright": 0x2197,
    "arrowupwhite": 0x21E7, "dblarrowheadleft": 0x219E, "dblarrowheadright": 0x21A0, "dblarrowleft": 0x21D4, "dblarrowright": 0x21D2, "mapsto": 0x21A6, "harpoonleftup": 0x21BC, "harpoonleftdown": 0x21BD, "harpoonrightup": 0x21C0, "harpoonrightdown": 0x21C1, "harpoonleftright": 0x21CC,
    "harpoonrightleft": 0x21CB, "notarrowleft": 0x219A, "notarrowright": 0x219B, "notarrowboth": 0x21AE, "shiftleft": 0x21B0, "shiftright": 0x21B1, "squiggleleftright": 0x21AD, "squiggleright": 0x21DD,
    "blackcircle": 0x25CF, "blackdiamond": 0x25C6, "blackdownpointingtriangle": 0x25BC, "blackleftpointingpointer": 0x25C4, "blackleftpointingtriangle": 0x25C0, "blackrectangle": 0x25AC, "blackrightpointingpointer": 0x25BA, "blackrightpointingtriangle": 0x25B6, "blacksmallsquare": 0x25AA,
    "blacksquare": 0x25A0, "blackstar": 0x2605, "blackuppointingtriangle": 0x25B2, "block": 0x2588, "bullseye": 0x25CE, "circle": 0x25CB, "check": 0x2713, "checkmark": 0x2713, "dkshade": 0x2593, "dnblock": 0x2584, "dottedcircle": 0x25CC, "filledbox": 0x25A0, "filledrect": 0x25AC, "fisheye": 0x25C9,
    "H18533": 0x25CF, "H18543": 0x25AA, "H18551": 0x25AB, "H22073": 0x25A1, "house": 0x2302, "invbullet": 0x25D8, "invcircle": 0x25D9, "invsmileface": 0x263B, "smileface": 0x263A, "largecircle": 0x25EF, "lfblock": 0x258C, "rtblock": 0x2590, "upblock": 0x2580, "ltshade": 0x2591, "shade": 0x2592,
    "openbullet": 0x25E6, "square": 0x25A1, "squaresolid": 0x25A0, "triagdn": 0x25BC, "triaglf": 0x25C4, "triagrt": 0x25BA, "triagup": 0x25B2, "triangle": 0x25B3, "triangleinv": 0x25BD, "triangleleft": 0x25B9, "triangleright": 0x25C3, "trianglesolid": 0x25B2, "whitecircle": 0x25CB, "whitediamond": 0x25C7,
    "whitesquare": 0x25A1, "whitestar": 0x2606, "maltesecross": 0x2720, "female": 0x2640, "male": 0x2642, "sun": 0x263C, "musicalnote": 0x266A, "musicalnotedbl": 0x266B, "flat": 0x266D, "natural": 0x266E, "sharp": 0x266F, "telephone": 0x2121, "telephoneblack": 0x260E, "numero": 0x2116, "estimated": 0x212E,
    "approxorequal": 0x224A, "approximatelyequal": 0x2245, "approaches": 0x2250, "asteriskcentered": 0x2217, "because": 0x2235, "bulletoperator": 0x2219, "circledivide": 0x2298, "circledot": 0x2299, "circleminus": 0x2296, "circleot": 0x2299, "circlecopyrt": 0x20DD, "complement": 0x2201, "contourintegral": 0x222E,
    "dblintegral": 0x222C, "dblverticalbar": 0x2016, "bardbl": 0x2225, "diamondmath": 0x22C4, "divides": 0x2223, "divisionslash": 0x2215, "dotplus": 0x2214, "equivasymptotic": 0x224D, "follows": 0x227B, "followsequal": 0x227D, "forall": 0x2200, "frown": 0x2322, "smile": 0x2323, "geometricallyequal": 0x2251,
    "greatermuch": 0x226B, "greaterorequalslant": 0x2A7E, "greaterorless": 0x2277, "greaterorsimilar": 0x2273, "increment": 0x2206, "integralbottom": 0x2321, "integraltop": 0x2320, "intersectionsq": 0x2293, "unionsq": 0x2294, "unionmulti": 0x228E, "latticetop": 0x22A4, "lessmuch": 0x226A, "lessorequalslant": 0x2A7D,
    "lessorgreater": 0x2276, "lessorsimilar": 0x2272, "lscript": 0x2113, "measuredangle": 0x2221, "minusplus": 0x2213, "nabla": 0x2207, "negationslash": 0x338, "notexistential": 0x2204, "notgreater": 0x226F, "notless": 0x226E, "notparallel": 0x2226, "owner": 0x220B, "parallel": 0x2225, "perpcorrespond": 0x2A5E,
    "planckover2pi": 0x210F, "planckover2pi1": 0x210F, "precedes": 0x227A, "precedesequal": 0x227C, "prime": 0x2032, "primereverse": 0x2035, "proportion": 0x2237, "ratio": 0x2236, "reversedtilde": 0x223D, "rightangle": 0x221F, "satisfies": 0x22A8, "similarequal": 0x2243, "star": 0x22C6, "subset": 0x2282, "superset": 0x2283,
    "subsetorequal": 0x2286, "supersetorequal": 0x2287, "subsetsqequal": 0x2291, "supersetsqequal": 0x2292, "thereexists": 0x2203, "turnstileleft": 0x22A2, "turnstileright": 0x22A3, "visiblespace": 0x2423, "wreathproduct": 0x2240, "angstrom": 0x212B, "centigrade": 0x2103, "referencemark": 0x203B, "overline": 0x203E,
}


def families() -> dict[str, int]:
    out: dict[str, int] = dict(SIGNS)
    for make in (latin, combining, enclosed, arabic, hebrew, cyrillic, indic, east_asian, delimiters, squares):
        out |= make()
    return out
