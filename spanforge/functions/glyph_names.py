"""Glyph names and the characters they stand for.

Most names follow from rules: a base letter and its accents, Greek and Cyrillic numbering, small
capitals and old-style figures in the private area, and the families of ``glyph_rules``.
Only what no rule gives is listed. A published glyph list can be loaded on top of it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .glyph_rules import families

# Names of the printable ASCII characters from space on.
ASCII_NAMES = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at "
    "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z bracketleft backslash bracketright asciicircum underscore grave "
    "a b c d e f g h i j k l m n o p q r s t u v w x y z braceleft bar braceright asciitilde"
).split()
# Names no rule gives.
OTHER_NAMES = {
    "exclamdown": 0xA1, "cent": 0xA2, "sterling": 0xA3, "currency": 0xA4, "yen": 0xA5, "brokenbar": 0xA6, "section": 0xA7, "dieresis": 0xA8, "copyright": 0xA9, "ordfeminine": 0xAA,
    "guillemotleft": 0xAB, "logicalnot": 0xAC, "registered": 0xAE, "macron": 0xAF, "degree": 0xB0, "plusminus": 0xB1, "twosuperior": 0xB2, "threesuperior": 0xB3, "acute": 0xB4, "mu": 0xB5,
    "paragraph": 0xB6, "periodcentered": 0xB7, "cedilla": 0xB8, "onesuperior": 0xB9, "ordmasculine": 0xBA, "guillemotright": 0xBB, "onequarter": 0xBC, "onehalf": 0xBD, "threequarters": 0xBE, "questiondown": 0xBF,
    "AE": 0xC6, "ae": 0xE6, "Eth": 0xD0, "eth": 0xF0, "multiply": 0xD7, "divide": 0xF7, "Oslash": 0xD8, "oslash": 0xF8, "Thorn": 0xDE, "thorn": 0xFE, "germandbls": 0xDF,
    "Dcroat": 0x110, "dcroat": 0x111, "Hbar": 0x126, "hbar": 0x127, "dotlessi": 0x131, "IJ": 0x132, "ij": 0x133, "kgreenlandic": 0x138, "Ldot": 0x13F, "ldot": 0x140, "Lslash": 0x141, "lslash": 0x142,
    "napostrophe": 0x149, "Eng": 0x14A, "eng": 0x14B, "OE": 0x152, "oe": 0x153, "Tbar": 0x166, "tbar": 0x167, "longs": 0x17F, "florin": 0x192, "circumflex": 0x2C6, "caron": 0x2C7, "breve": 0x2D8,
    "dotaccent": 0x2D9, "ring": 0x2DA, "ogonek": 0x2DB, "tilde": 0x2DC, "hungarumlaut": 0x2DD, "endash": 0x2013, "emdash": 0x2014, "figuredash": 0x2012, "afii00208": 0x2015, "underscoredbl": 0x2017,
    "quoteleft": 0x2018, "quoteright": 0x2019, "quotesinglbase": 0x201A, "quotereversed": 0x201B, "quotedblleft": 0x201C, "quotedblright": 0x201D, "quotedblbase": 0x201E, "dagger": 0x2020, "daggerdbl": 0x2021,
    "bullet": 0x2022, "onedotenleader": 0x2024, "twodotenleader": 0x2025, "ellipsis": 0x2026, "perthousand": 0x2030, "minute": 0x2032, "second": 0x2033, "guilsinglleft": 0x2039, "guilsinglright": 0x203A, "exclamdbl": 0x203C,
    "fraction": 0x2044, "colonmonetary": 0x20A1, "franc": 0x20A3, "lira": 0x20A4, "peseta": 0x20A7, "Euro": 0x20AC, "trademark": 0x2122, "Ifraktur": 0x2111, "Rfraktur": 0x211C, "weierstrass": 0x2118, "aleph": 0x2135,
    "onethird": 0x2153, "twothirds": 0x2154, "oneeighth": 0x215B, "threeeighths": 0x215C, "fiveeighths": 0x215D, "seveneighths": 0x215E, "arrowleft": 0x2190, "arrowup": 0x2191, "arrowright": 0x2192, "arrowdown": 0x2193,
    "arrowboth": 0x2194, "arrowupdn": 0x2195, "carriagereturn": 0x21B5, "arrowdblleft": 0x21D0, "arrowdblup": 0x21D1, "arrowdblright": 0x21D2, "arrowdbldown": 0x21D3, "arrowdblboth": 0x21D4, "universal": 0x2200,
    "partialdiff": 0x2202, "existential": 0x2203, "emptyset": 0x2205, "Delta": 0x2206, "gradient": 0x2207, "element": 0x2208, "notelement": 0x2209, "suchthat": 0x220B, "product": 0x220F, "summation": 0x2211, "minus": 0x2212,
    "asteriskmath": 0x2217, "radical": 0x221A, "proportional": 0x221D, "infinity": 0x221E, "angle": 0x2220, "logicaland": 0x2227, "logicalor": 0x2228, "intersection": 0x2229, "union": 0x222A, "integral": 0x222B,
    "therefore": 0x2234, "similar": 0x223C, "congruent": 0x2245, "approxequal": 0x2248, "notequal": 0x2260, "equivalence": 0x2261, "lessequal": 0x2264, "greaterequal": 0x2265, "propersubset": 0x2282,
    "propersuperset": 0x2283, "notsubset": 0x2284, "reflexsubset": 0x2286, "reflexsuperset": 0x2287, "circleplus": 0x2295, "circlemultiply": 0x2297, "perpendicular": 0x22A5, "dotmath": 0x22C5, "angleleft": 0x2329,
    "angleright": 0x232A, "lozenge": 0x25CA, "Omega": 0x2126, "nbspace": 0xA0, "sfthyphen": 0xAD, "softhyphen": 0xAD,
}
# Private-use characters of expert fonts.
EXPERT_NAMES = {
    "ff": 0xFB00, "fi": 0xFB01, "fl": 0xFB02, "ffi": 0xFB03, "ffl": 0xFB04, "dotlessj": 0xF6BE, "commaaccent": 0xF6C3, "onefitted": 0xF6DC, "rupiah": 0xF6DD, "threequartersemdash": 0xF6DE, "centinferior": 0xF6DF,
    "centsuperior": 0xF6E0, "commainferior": 0xF6E1, "commasuperior": 0xF6E2, "dollarinferior": 0xF6E3, "dollarsuperior": 0xF6E4, "hypheninferior": 0xF6E5, "hyphensuperior": 0xF6E6, "periodinferior": 0xF6E7,
    "periodsuperior": 0xF6E8, "asuperior": 0xF6E9, "bsuperior": 0xF6EA, "dsuperior": 0xF6EB, "esuperior": 0xF6EC, "isuperior": 0xF6ED, "lsuperior": 0xF6EE, "msuperior": 0xF6EF, "osuperior": 0xF6F0, "rsuperior": 0xF6F1,
    "ssuperior": 0xF6F2, "tsuperior": 0xF6F3, "Brevesmall": 0xF6F4, "Caronsmall": 0xF6F5, "Circumflexsmall": 0xF6F6, "Dotaccentsmall": 0xF6F7, "Hungarumlautsmall": 0xF6F8, "Lslashsmall": 0xF6F9, "OEsmall": 0xF6FA,
    "Ogoneksmall": 0xF6FB, "Ringsmall": 0xF6FC, "Scaronsmall": 0xF6FD, "Tildesmall": 0xF6FE, "Zcaronsmall": 0xF6FF, "Gravesmall": 0xF760, "Dieresissmall": 0xF7A8, "Macronsmall": 0xF7AF, "Acutesmall": 0xF7B4,
    "Cedillasmall": 0xF7B8, "exclamsmall": 0xF721, "dollaroldstyle": 0xF724, "ampersandsmall": 0xF726, "questionsmall": 0xF73F, "exclamdownsmall": 0xF7A1, "centoldstyle": 0xF7A2, "questiondownsmall": 0xF7BF,
    "AEsmall": 0xF7E6, "Ethsmall": 0xF7F0, "Oslashsmall": 0xF7F8, "Thornsmall": 0xF7FE, "parenleftsuperior": 0x207D, "parenrightsuperior": 0x207E, "nsuperior": 0x207F, "parenleftinferior": 0x208D, "parenrightinferior": 0x208E,
    "registerserif": 0xF6DA, "copyrightserif": 0xF6D9, "trademarkserif": 0xF6DB, "registersans": 0xF8E8, "copyrightsans": 0xF8E9, "trademarksans": 0xF8EA, "radicalex": 0xF8E5, "arrowvertex": 0xF8E6, "arrowhorizex": 0xF8E7,
    "parenlefttp": 0xF8EB, "parenleftex": 0xF8EC, "parenleftbt": 0xF8ED, "bracketlefttp": 0xF8EE, "bracketleftex": 0xF8EF, "bracketleftbt": 0xF8F0, "bracelefttp": 0xF8F1, "braceleftmid": 0xF8F2, "braceleftbt": 0xF8F3,
    "braceex": 0xF8F4, "integraltp": 0x2320, "integralex": 0xF8F5, "integralbt": 0x2321, "parenrighttp": 0xF8F6, "parenrightex": 0xF8F7, "parenrightbt": 0xF8F8, "bracketrighttp": 0xF8F9, "bracketrightex": 0xF8FA,
    "bracketrightbt": 0xF8FB, "bracerighttp": 0xF8FC, "bracerightmid": 0xF8FD, "bracerightbt": 0xF8FE, "apple": 0xF8FF, "spade": 0x2660, "club": 0x2663, "heart": 0x2665, "diamond": 0x2666,
}
ACCENTS = {
    "grave": 0x300, "acute": 0x301, "circumflex": 0x302, "tilde": 0x303, "macron": 0x304, "breve": 0x306, "dotaccent": 0x307, "dieresis": 0x308, "hookabove": 0x309, "ring": 0x30A, "hungarumlaut": 0x30B, "caron": 0x30C,
    "dblgrave": 0x30F, "invertedbreve": 0x311, "horn": 0x31B, "dotbelow": 0x323, "dieresisbelow": 0x324, "ringbelow": 0x325, "commaaccent": 0x326, "cedilla": 0x327, "ogonek": 0x328, "circumflexbelow": 0x32D, "tildebelow": 0x330, "linebelow": 0x331,
}
DIGITS = "zero one two three four five six seven eight nine".split()
def _composed() -> dict[str, int]:
    out: dict[str, int] = {}
    bases = {**{c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}, "AE": "Æ", "ae": "æ", "Oslash": "Ø", "oslash": "ø"}
    for name, letter in bases.items():
        for a, mark in ACCENTS.items():
            one = unicodedata.normalize("NFC", letter + chr(mark))
            if a == "commaaccent" and letter in "GgKkLlNnRrTt":  # the comma forms are encoded with a cedilla
                one = unicodedata.normalize("NFC", letter + "̧")
            if len(one) == 1:
                out[name + a] = ord(one)
                for b, second in ACCENTS.items():
                    two = unicodedata.normalize("NFC", one + chr(second))
                    if len(two) == 1:
                        out[name + a + b] = ord(two)
    return out


def _numbered() -> dict[str, int]:
    out: dict[str, int] = {}
    for first, start, yo in ((10017, 0x410, 0x401), (10065, 0x430, 0x451)):
        for i in range(33):  # the letter yo is numbered after the sixth
            out[f"afii{first + i}"] = yo if i == 6 else start + i - (i > 6)
    for i, cp in enumerate((0x402, 0x403, 0x404, 0x405, 0x406, 0x407, 0x408, 0x409, 0x40A, 0x40B, 0x40C, 0x40E)):
        out[f"afii{10051 + i}"] = cp
        out[f"afii{10099 + i}"] = cp + 0x50
    out |= {"afii10050": 0x490, "afii10098": 0x491, "afii10145": 0x40F, "afii10193": 0x45F, "afii61352": 0x2116, "afii61289": 0x2113}
    out |= {f"afii{57664 + i}": 0x5D0 + i for i in range(27)}
    out |= {f"afii{57392 + i}": 0x660 + i for i in range(10)}
    out |= {f"afii{57409 + i}": 0x621 + i for i in range(26)} | {f"afii{57440 + i}": 0x640 + i for i in range(19) if i != 7} | {"afii57470": 0x647}
    # Numbers out of order.
    out |= {
        "afii08941": 0x20A4, "afii10146": 0x462, "afii10147": 0x472, "afii10148": 0x474, "afii10194": 0x463, "afii10195": 0x473, "afii10196": 0x475, "afii10846": 0x4D9, "afii299": 0x200E, "afii300": 0x200F, "afii301": 0x200D, "afii57381": 0x66A, "afii57388": 0x60C,
        "afii57403": 0x61B, "afii57407": 0x61F, "afii57505": 0x6A4, "afii57506": 0x67E, "afii57507": 0x686, "afii57508": 0x698, "afii57509": 0x6AF, "afii57511": 0x679, "afii57512": 0x688, "afii57513": 0x691, "afii57514": 0x6BA, "afii57519": 0x6D2, "afii57534": 0x6D5,
        "afii57636": 0x20AA, "afii57645": 0x5BE, "afii57658": 0x5C3, "afii57694": 0xFB2A, "afii57695": 0xFB2B, "afii57700": 0xFB4B, "afii57705": 0xFB1F, "afii57716": 0x5F0, "afii57717": 0x5F1, "afii57718": 0x5F2, "afii57723": 0xFB35, "afii57793": 0x5B4, "afii57794": 0x5B5,
        "afii57795": 0x5B6, "afii57796": 0x5BB, "afii57797": 0x5B8, "afii57798": 0x5B7, "afii57799": 0x5B0, "afii57800": 0x5B2, "afii57801": 0x5B1, "afii57802": 0x5B3, "afii57803": 0x5C2, "afii57804": 0x5C1, "afii57806": 0x5B9, "afii57807": 0x5BC, "afii57839": 0x5BD,
        "afii57841": 0x5BF, "afii57842": 0x5C0, "afii57929": 0x2BC, "afii61248": 0x2105, "afii61573": 0x202C, "afii61574": 0x202D, "afii61575": 0x202E, "afii61664": 0x200C, "afii63167": 0x66D, "afii64937": 0x2BD,
    }
    return out


def _greek() -> dict[str, int]:
    out: dict[str, int] = {}
    for cp in range(0x370, 0x400):
        m = re.fullmatch(r"GREEK (SMALL|CAPITAL) LETTER ([A-Z]+)(?: WITH (TONOS|DIALYTIKA|DIALYTIKA AND TONOS))?", unicodedata.name(chr(cp), ""))
        if m:
            letter = {"LAMDA": "LAMBDA", "FINAL": "SIGMA1"}.get(m[2], m[2])
            tail = {"TONOS": "tonos", "DIALYTIKA": "dieresis", "DIALYTIKA AND TONOS": "dieresistonos", None: ""}[m[3]]
            out[(letter.capitalize() if m[1] == "CAPITAL" else letter.lower()) + tail] = cp
    return out


@lru_cache(1)
def glyph_names() -> dict[str, int]:
    """All names known by rule or list, with their code points."""
    out = families() | _greek() | _numbered() | _composed()
    out |= {n: 0x20 + i for i, n in enumerate(ASCII_NAMES)}
    for i, d in enumerate(DIGITS):
        out[d + "oldstyle"] = 0xF730 + i
        out[d + "inferior"] = 0x2080 + i
        out[d + "superior"] = (0x2070, 0xB9, 0xB2, 0xB3)[i] if i < 4 else 0x2070 + i
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[c + "small"] = 0xF700 + ord(c.lower())
        for a in ("grave", "acute", "circumflex", "tilde", "dieresis", "ring", "cedilla"):
            small = out.get(c.lower() + a)
            if small is not None and small < 0x100:
                out[c + a + "small"] = 0xF700 + small
    out |= {"sigma1": 0x3C2, "theta1": 0x3D1, "Upsilon1": 0x3D2, "phi1": 0x3D5, "omega1": 0x3D6, "dotlessi": 0x131, "tonos": 0x384, "dieresistonos": 0x385}
    out |= {n + "monospace": 0xFF01 + i for i, n in enumerate(ASCII_NAMES[1:])}
    out |= {"Cdot": 0x10A, "cdot": 0x10B, "Edot": 0x116, "edot": 0x117, "Gdot": 0x120, "gdot": 0x121, "Idot": 0x130, "Zdot": 0x17B, "zdot": 0x17C, "Dslash": 0x110, "Dbar": 0x110, "dbar": 0x111, "dmacron": 0x111}
    out |= {"Odblacute": 0x150, "odblacute": 0x151, "Udblacute": 0x170, "udblacute": 0x171, "Ostrokeacute": 0x1FE, "ostrokeacute": 0x1FF, "Schwa": 0x18F, "schwa": 0x259, "Deltagreek": 0x394, "Omegagreek": 0x3A9, "mugreek": 0x3BC, "mu1": 0xB5, "middot": 0xB7}
    out |= {"f_f": 0xFB00, "f_i": 0xFB01, "f_l": 0xFB02, "f_f_i": 0xFB03, "f_f_l": 0xFB04, "st": 0xFB06, "longst": 0xFB05, "ct": 0x63, "euro": 0x20AC, "Ohm": 0x2126, "overscore": 0xAF, "enspace": 0x2002, "hyphentwo": 0x2010, "zerowidthspace": 0x200B}
    return out | OTHER_NAMES | EXPERT_NAMES


@lru_cache(1)
def standard_order() -> tuple[str, ...]:
    """The 258 names of the standard order of TrueType fonts: ASCII, then the upper half of Mac Roman, then those listed."""
    by: dict[int, str] = {}
    for names in (OTHER_NAMES, EXPERT_NAMES, _greek(), _composed()):
        for n, cp in names.items():
            by.setdefault(cp, n)
    upper = [by.get(ord(bytes([c]).decode("mac_roman")), "") for c in range(128, 256)]
    for c, name in {0xB5: "mu", 0xBD: "Omega", 0xC6: "Delta", 0xCA: "nonbreakingspace", 0xDB: "currency", 0xF0: "apple"}.items():
        upper[c - 128] = name
    # The names after Mac Roman.
    rest = "Lslash lslash Scaron scaron Zcaron zcaron brokenbar Eth eth Yacute yacute Thorn thorn minus multiply onesuperior twosuperior threesuperior onehalf onequarter threequarters franc Gbreve gbreve Idotaccent Scedilla scedilla Cacute cacute Ccaron ccaron dcroat"
    return (".notdef", ".null", "nonmarkingreturn", *ASCII_NAMES, *upper, *rest.split())


def load_glyph_list(path: str) -> dict[str, int]:
    """A published glyph list (lines of name;hex), added to the names known by rule. Names of several characters are left out."""
    out = dict(glyph_names())
    with open(path, encoding="ascii", errors="replace") as f:
        for line in f:
            name, _, code = line.strip().partition(";")
            if code and not name.startswith("#") and " " not in code and len(code) == 4:
                out[name] = int(code, 16)
    return out


@lru_cache(1)
def zapf_codes() -> dict[int, int]:
    """Codes of the dingbats font and their characters: the dingbats block in order, with gaps.

    Codes 0x21 to 0x7E follow the block from U+2701, 0xA1 to 0xFE from U+2761, but for those listed.
    """
    out = {c: 0x2701 + c - 0x21 for c in range(0x21, 0x7F)} | {c: 0x2761 + c - 0xA1 for c in range(0xA1, 0xFF) if c != 0xF0}
    out |= {0x80 + i: 0x2768 + i for i in range(14)}
    out |= {0xAC + i: 0x2460 + i for i in range(10)}
    # Dingbats encoded elsewhere.
    return out | {
        0x20: 0x20, 0x25: 0x260E, 0x2A: 0x261B, 0x2B: 0x261E, 0x48: 0x2605, 0x6C: 0x25CF, 0x6E: 0x25A0, 0x73: 0x25B2, 0x74: 0x25BC, 0x75: 0x25C6, 0x77: 0x25D7,
        0xA8: 0x2663, 0xA9: 0x2666, 0xAA: 0x2665, 0xAB: 0x2660, 0xD5: 0x2192, 0xD6: 0x2194, 0xD7: 0x2195,
    }
