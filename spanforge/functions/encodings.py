"""Single-byte encodings of PDF text: code to character, 0 where there is none."""

from __future__ import annotations

from functools import lru_cache

from .glyph_names import ASCII_NAMES, glyph_names

# The codes of PDFDocEncoding that differ from Latin-1.
PDFDOC_LOW = {0x18 + i: cp for i, cp in enumerate((0x2D8, 0x2C7, 0x2C6, 0x2D9, 0x2DD, 0x2DB, 0x2DA, 0x2DC))}
PDFDOC_HIGH = {
    0x80 + i: cp
    for i, cp in enumerate((
        0x2022, 0x2020, 0x2021, 0x2026, 0x2014, 0x2013, 0x192, 0x2044, 0x2039, 0x203A, 0x2212, 0x2030, 0x201E, 0x201C, 0x201D, 0x2018, 0x2019,
        0x201A, 0x2122, 0xFB01, 0xFB02, 0x141, 0x152, 0x160, 0x178, 0x17D, 0x131, 0x142, 0x153, 0x161, 0x17E, 0, 0x20AC,
    ))
}
# MacExpertEncoding from code 32 on; a dash stands for a code without glyph.
MAC_EXPERT = (
    "space exclamsmall Hungarumlautsmall centoldstyle dollaroldstyle dollarsuperior ampersandsmall Acutesmall parenleftsuperior parenrightsuperior twodotenleader onedotenleader comma hyphen period fraction "
    "zerooldstyle oneoldstyle twooldstyle threeoldstyle fouroldstyle fiveoldstyle sixoldstyle sevenoldstyle eightoldstyle nineoldstyle colon semicolon - threequartersemdash - questionsmall "
    "- - - - Ethsmall - - onequarter onehalf threequarters oneeighth threeeighths fiveeighths seveneighths onethird twothirds - - - - - - ff fi fl ffi ffl parenleftinferior - parenrightinferior Circumflexsmall hypheninferior "
    "Gravesmall Asmall Bsmall Csmall Dsmall Esmall Fsmall Gsmall Hsmall Ismall Jsmall Ksmall Lsmall Msmall Nsmall Osmall Psmall Qsmall Rsmall Ssmall Tsmall Usmall Vsmall Wsmall Xsmall Ysmall Zsmall colonmonetary onefitted rupiah Tildesmall - "
    "- asuperior centsuperior - - - - Aacutesmall Agravesmall Acircumflexsmall Adieresissmall Atildesmall Aringsmall Ccedillasmall Eacutesmall Egravesmall Ecircumflexsmall Edieresissmall Iacutesmall Igravesmall Icircumflexsmall Idieresissmall "
    "Ntildesmall Oacutesmall Ogravesmall Ocircumflexsmall Odieresissmall Otildesmall Uacutesmall Ugravesmall Ucircumflexsmall Udieresissmall - eightsuperior fourinferior threeinferior sixinferior eightinferior seveninferior Scaronsmall - centinferior "
    "twoinferior - Dieresissmall - Caronsmall osuperior fiveinferior - commainferior periodinferior Yacutesmall - dollarinferior - - Thornsmall - nineinferior zeroinferior Zcaronsmall AEsmall Oslashsmall questiondownsmall oneinferior Lslashsmall "
    "- - - - - - Cedillasmall - - - - - OEsmall figuredash hyphensuperior - - - - exclamdownsmall - Ydieresissmall - onesuperior twosuperior threesuperior foursuperior fivesuperior sixsuperior sevensuperior ninesuperior zerosuperior - "
    "esuperior rsuperior tsuperior - - isuperior ssuperior dsuperior - - - - - lsuperior Ogoneksmall Brevesmall Macronsmall bsuperior nsuperior msuperior commasuperior periodsuperior Dotaccentsmall Ringsmall"
).split()
NAMED = ("MacRomanEncoding", "MacExpertEncoding", "WinAnsiEncoding")


@lru_cache(1)
def pdfdoc() -> tuple[int, ...]:
    out = [0] * 256
    for c in (9, 10, 13, *range(32, 127), *range(161, 256)):
        out[c] = c
    out[0xAD] = 0
    for c, cp in (PDFDOC_LOW | PDFDOC_HIGH).items():
        out[c] = cp
    return tuple(out)


@lru_cache(1)
def winansi() -> tuple[int, ...]:
    """Windows code page 1252; codes it leaves undefined are bullets, 160 a space, 173 a hyphen."""
    out = [0] * 256
    for c in range(32, 256):
        try:
            out[c] = ord(bytes([c]).decode("cp1252"))
        except UnicodeDecodeError:
            out[c] = 0x2022
    out[127], out[160], out[173] = 0x2022, 0x20, 0x2D
    return tuple(out)


@lru_cache(1)
def macroman() -> tuple[int, ...]:
    """The Macintosh code page with the currency sign of old and a plain space at 202."""
    out = [0] * 256
    names = glyph_names()
    for c in (*range(32, 127), *range(128, 256)):
        out[c] = ord(bytes([c]).decode("mac_roman"))
    out[219], out[202] = 0xA4, 0x20
    for c, name in ((189, "Omega"), (198, "Delta"), (181, "mu"), (240, "apple")):
        out[c] = names[name]
    return tuple(out)


@lru_cache(1)
def macexpert() -> tuple[int, ...]:
    out, names = [0] * 256, glyph_names()
    for i, n in enumerate(MAC_EXPERT):
        if n != "-":
            out[32 + i] = names[n]
    return tuple(out)


def named_encoding(name: str) -> tuple[int, ...]:
    """One of the three encodings a font may name; any other is an error."""
    table = {"MacRomanEncoding": macroman, "MacExpertEncoding": macexpert, "WinAnsiEncoding": winansi}.get(name)
    if table is None:
        raise ValueError(f"unsupported encoding {name}")
    return table()


def to_text(table: tuple[int, ...] | list[int], data: bytes) -> str:
    """Bytes through an encoding table; codes without a character are dropped."""
    return "".join(chr(table[b]) for b in data if table[b])


def pdf_text(data: bytes) -> str:
    """A PDF text string: UTF-16 with a byte order mark, else PDFDocEncoding."""
    if len(data) > 2 and data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    return to_text(pdfdoc(), data)


def encoding_rows() -> list[tuple[str, int, int]]:
    """(encoding, code, code point) of all encodings, for use as a dimension table."""
    tables = {"PDFDocEncoding": pdfdoc(), **{n: named_encoding(n) for n in NAMED}}
    return [(n, c, cp) for n, t in tables.items() for c, cp in enumerate(t) if cp]


__all__ = ["ASCII_NAMES", "encoding_rows", "macexpert", "macroman", "named_encoding", "pdf_text", "pdfdoc", "to_text", "winansi"]
