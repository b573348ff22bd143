"""Fonts of a PDF: codes of a string, widths, names and the text of each code."""

from __future__ import annotations

import os
import re
import string
from dataclasses import dataclass, field
from typing import Any

from ..functions.core_metrics import core_font, glyph_code_point
from ..functions.encodings import named_encoding, pdf_text, pdfdoc, winansi
from ..functions.glyph_names import glyph_names
from . import cmap, truetype
from .pdf_objects import Document, Name, PdfError, Stream


IDENTITY_SPACE, IDENTITY_CIDS = [(2, 0, 0xFFFF)], [(0, 0xFFFF, 0)]


@dataclass
class Options:
    """``quote_ops``: show the text of ' and " (lost by default). ``font_folders``: where to look for
    fonts whose widths stand in for missing text; none by default, so that results don't depend on
    the machine. ``need_text``: decode the text of glyphs."""

    quote_ops: bool = False
    font_folders: tuple[str, ...] = ()


@dataclass
class PdfFont:
    """A resolved font. ``codes`` splits a string; ``width`` and ``text`` take a code."""

    name: str
    subtype: str
    widths: dict[int, float]
    default_width: float | None
    table: tuple[int, ...] | list[int] | None = None
    to_unicode: dict[int, str] | None = None
    fallbacks: list[dict[int, str]] = field(default_factory=list)
    spaces: list[tuple[int, int, int]] = field(default_factory=list)
    cids: list[tuple[int, int, int]] = field(default_factory=list)
    composite: bool = False
    encoding: str | None = None
    first_char: int | None = None
    file: bytes | None = None
    descendant: dict | None = None
    known: dict[int, tuple[float, str]] = field(default_factory=dict)

    def codes(self, s: bytes) -> list[tuple[int, int]]:
        """(code, number of bytes) of each character; a code no range holds ends the string."""
        if not self.composite:
            return [(b, 1) for b in s]
        if self.spaces == IDENTITY_SPACE and self.cids == IDENTITY_CIDS:
            return [(s[i] << 8 | s[i + 1], 2) for i in range(0, len(s) - 1, 2)]
        out, i = [], 0
        while i < len(s):
            c, n = s[i], 1
            i += 1
            while not any(w == n and lo <= c <= hi for w, lo, hi in self.spaces):
                if i >= len(s):
                    return out
                c = c << 8 | s[i]  # the byte after a width that failed is taken, also past the last width
                i += 1
                n += 1
                if n > 4:
                    return out
            for lo, hi, first in self.cids:
                if lo <= c <= hi:
                    out.append((c + first, n))  # the start of the range isn't subtracted
                    break
            else:
                return out
        return out

    def width(self, code: int) -> float:
        w = self.widths.get(code, self.default_width)
        if w is None:
            raise PdfError(f"missing width of code {code} in font {self.name}", "FormatError")
        return w

    def text(self, code: int) -> str:
        if self.composite:
            s = (self.to_unicode or {}).get(code)
            if s and "\0" not in s:
                return s
            for f in self.fallbacks:
                if code in f:
                    return f[code]
            return ""
        if self.to_unicode is not None:
            s = self.to_unicode.get(code)
            if s is not None:
                return s
            if self.table is None:
                raise PdfError(f"neither ToUnicode nor an encoding has code {code} of font {self.name}", "FormatError")
        table = self.table if self.table is not None else pdfdoc()
        cp = table[code & 255]
        return chr(cp) if cp else ""


def _name_text(n: Any) -> str:
    return pdf_text(n.encode("latin-1")) if isinstance(n, Name) else ""


def _required(doc: Document, d: dict, key: str) -> str:
    n = doc.key(d, key)
    if not isinstance(n, Name):
        raise PdfError(f"font without {key}", "FormatError")
    return _name_text(n)


def to_unicode_map(doc: Document, font: dict) -> dict[int, str] | None:
    o = doc.key(font, "ToUnicode")
    if isinstance(o, Stream):
        return cmap.parse(doc.contents(o)).text
    if isinstance(o, Name) and o not in ("Identity-H",):
        raise PdfError(f"unsupported ToUnicode {o}", "FormatError")
    return None


def _numbers(doc: Document, d: dict, key: str) -> list[float] | None:
    o = doc.key(d, key)
    if not isinstance(o, list):
        return None
    if any(type(x) not in (int, float) for x in o):
        raise PdfError(f"{key} holds something that isn't a number", "FormatError")
    return [float(x) for x in o]


def _differences(doc: Document, enc: dict, by_number: bool) -> tuple[list[int], list[tuple[int, str, int | None]]]:
    """The base table, and (code, glyph name, character or none) of each difference."""
    base = doc.key(enc, "BaseEncoding")
    table = list(named_encoding(base)) if isinstance(base, Name) else list(pdfdoc())
    found: list[tuple[int, str, int | None]] = []
    names, code = glyph_names(), 0
    for o in doc.key(enc, "Differences") or []:
        o = doc.get(o)
        if type(o) is int:
            code = o
        elif isinstance(o, Name):
            n = _name_text(o)
            cp = names.get(n)
            if cp is None and by_number and re.fullmatch(r"C\d+", n) and int(n[1:]) <= 0x10FFFF and not 0xD800 <= int(n[1:]) <= 0xDFFF:
                cp = int(n[1:]) & 0xFFFF
            if not 0 <= code < 256:
                raise PdfError("difference outside the encoding", "FormatError")
            found.append((code, n, cp))
            if cp is not None:
                table[code] = cp
            code += 1
        else:
            raise PdfError("wrong type in Differences", "FormatError")
    return table, found


TYPE1_DUP = re.compile(rb"dup\s+(\d+#)?([0-9A-Za-z]+)\s*/([^\s/]+)\s+put")


def type1_encoding(data: bytes) -> dict[int, str]:
    """Codes and glyph names a Type 1 font file encodes; nothing for the standard encoding."""
    head = data.split(b"eexec")[0]
    at = head.find(b"/Encoding")
    if at < 0 or re.match(rb"/Encoding\s+StandardEncoding", head[at : at + 40]):
        return {}
    out = {}
    for base, digits, name in TYPE1_DUP.findall(head[at:]):
        try:
            out[int(digits, int(base[:-1]) if base else 10)] = name.decode("latin-1")
        except ValueError:
            continue
    return out


def simple_font(doc: Document, font: dict) -> PdfFont:
    name, subtype = _required(doc, font, "BaseFont"), _required(doc, font, "Subtype")
    descriptor = doc.key(font, "FontDescriptor")
    uni = to_unicode_map(doc, font)
    enc = doc.key(font, "Encoding")
    table: list[int] | tuple[int, ...] | None = None
    if isinstance(enc, Name):
        table = named_encoding(enc)
    elif isinstance(enc, dict):
        table, found = _differences(doc, enc, True)
        if uni is not None:
            for code, _, cp in found:
                if cp is not None:
                    uni.setdefault(code, chr(cp))
                elif "FontAwesome" in name:
                    if code in uni:
                        raise PdfError(f"code {code} of {name} is in ToUnicode already", "FormatError")
                    uni[code] = ""
    elif enc is None:
        file = doc.key(descriptor, "FontFile") if subtype == "Type1" else None
        if isinstance(file, Stream):
            table = list(pdfdoc())
            for code, glyph in type1_encoding(doc.contents(file)).items():
                cp = glyph_names().get(glyph)
                if cp is not None and 0 <= code < 256:
                    table[code] = cp
        elif subtype == "TrueType":
            table = winansi()
    else:
        raise PdfError("unsupported Encoding", "FormatError")
    first, last, ws = doc.key(font, "FirstChar"), doc.key(font, "LastChar"), _numbers(doc, font, "Widths")
    widths: dict[int, float] = {}
    if type(first) is int and type(last) is int and ws is not None:
        if first + len(ws) - 1 != last:
            raise PdfError("Widths don't run from FirstChar to LastChar", "FormatError")
        widths = {first + i: w for i, w in enumerate(ws)}
    else:
        core = core_font(name)
        if core is not None and table is not None:
            if name == "ZapfDingbats":
                raise PdfError("ZapfDingbats with an Encoding", "FormatError")
            by_char = {glyph_code_point(name, c, g): w for c, w, g in core}
            widths = {c: float(by_char[cp]) for c, cp in enumerate(table) if cp in by_char and (cp or 0 in by_char)}
        elif core is not None:
            own = [0] * 256
            for code, w, g in core:
                widths[code] = float(w)
                if code >= 0:
                    own[code] = glyph_code_point(name, code, g)
            table = own
    missing = doc.number(font, "MissingWidth")  # looked up in the font, not in its descriptor
    file = next((f for k in ("FontFile", "FontFile2", "FontFile3") if isinstance(f := doc.key(descriptor, k), Stream)), None)
    return PdfFont(name, subtype, widths, float(missing or 0.0), table, uni, encoding=str(enc) if isinstance(enc, Name) else None, first_char=first if type(first) is int else None, file=doc.contents(file) if file else None)


def type3_font(doc: Document, font: dict) -> PdfFont:
    name = next((_name_text(n) for k in ("Name", "BaseFont") if isinstance(n := doc.key(font, k), Name)), "Unknown-Type3")
    uni = to_unicode_map(doc, font)
    enc = doc.key(font, "Encoding")
    if isinstance(enc, Name):
        table: list[int] | tuple[int, ...] = named_encoding(enc)
    elif isinstance(enc, dict):
        table, _ = _differences(doc, enc, False)
    else:
        raise PdfError("Type 3 font without Encoding", "FormatError")
    first, last, ws = doc.key(font, "FirstChar"), doc.key(font, "LastChar"), _numbers(doc, font, "Widths")
    if type(first) is not int or type(last) is not int or ws is None or first + len(ws) - 1 != last:
        raise PdfError("Widths don't run from FirstChar to LastChar", "FormatError")
    return PdfFont(name, "Type3", {first + i: w for i, w in enumerate(ws)}, None, table, uni, encoding=str(enc) if isinstance(enc, Name) else None, first_char=first)


def embedded_text(doc: Document, descendant: dict) -> tuple[dict[int, str], bytes | None]:
    """CID to text through CIDToGIDMap and the embedded font's own character map."""
    descriptor = doc.key(descendant, "FontDescriptor")
    gids: dict[int, int] | None = None
    m = doc.key(descendant, "CIDToGIDMap")
    if isinstance(m, Stream):
        data = doc.contents(m)
        gids = {i: g for i in range(len(data) // 2) if (g := data[2 * i] << 8 | data[2 * i + 1])}
    file = doc.key(descriptor, "FontFile2")
    if not isinstance(file, Stream):
        file = doc.key(descriptor, "FontFile3")
    if not isinstance(file, Stream):
        return {}, None
    data = doc.contents(file)
    try:
        subtables = truetype.Font(data).subtables()
    except Exception:
        return {}, data
    for platform, encoding, chars in subtables:
        if not truetype.is_unicode(platform, encoding):
            continue
        by_glyph = {g: chr(c) for c, g in sorted(chars.items()) if not 0xD800 <= c <= 0xDFFF}
        out = {cid: by_glyph[g] for cid, g in gids.items() if g in by_glyph} if gids is not None else by_glyph
        if out:
            return out, data
    return {}, data


def font_paths(base_font: str, folders: tuple[str, ...]) -> list[str]:
    """Where a font of this family and style may lie in the folders given."""
    family, _, style = base_font.partition("-")
    style = style.split("-")[0] or "Regular"
    tails = (f"{family}.ttc", f"{family}.ttf", f"{family}-{style}.ttf", f"{family}/{family}-{style}.ttf", f"{family.lower()}/{family}-{style}.ttf")
    return [os.path.join(f, t) for f in folders for t in tails]


PREFERRED = set(" -" + string.digits + string.punctuation)


def width_matches(widths: dict[int, float], by_width: dict[int, list[str]]) -> dict[int, str]:
    """For each CID, a character of the nearest width within 2 % (1 at least), the wider one first."""
    out: dict[int, str] = {}
    for cid, w in widths.items():
        base, most = int(w), max(1, int(w * 2.0 / 100.0))
        for off in range(most + 1):
            chars = by_width.get(base + off) or by_width.get(base - off)
            if chars:
                out[cid] = next((c for c in chars if c in PREFERRED), chars[0])
                break
    return out


def chars_by_width(data: bytes) -> dict[int, list[str]]:
    font = truetype.Font(data)
    adv, out = font.advances(), {}
    for _, _, chars in font.subtables():
        for cp, g in sorted(chars.items()):
            if g < len(adv) and not 0xD800 <= cp <= 0xDFFF:
                out.setdefault(int(adv[g] / font.units * 1000.0), []).append(chr(cp))
    return out


def composite_font(doc: Document, font: dict, options: Options) -> PdfFont:
    name = _required(doc, font, "BaseFont")
    kids = doc.key(font, "DescendantFonts")
    descendant = doc.get(kids[0]) if isinstance(kids, list) and kids else None
    if not isinstance(descendant, dict):
        raise PdfError("Type 0 font without descendant", "FormatError")
    enc = doc.key(font, "Encoding")
    if enc in ("Identity-H", "Identity-V"):
        spaces, cids = IDENTITY_SPACE, IDENTITY_CIDS
    elif isinstance(enc, Stream):
        m = cmap.parse(doc.contents(enc))
        spaces, cids = m.spaces, m.cids
    else:
        raise PdfError(f"unsupported encoding {enc}", "FormatError")
    if not isinstance(doc.key(descendant, "FontDescriptor"), dict):
        raise PdfError("CID font without descriptor", "FormatError")
    dw = doc.key(descendant, "DW")
    widths: dict[int, float] = {}
    w = doc.key(descendant, "W") or []
    i = 0
    while i + 1 < len(w):
        run = doc.get(w[i + 1])
        if isinstance(run, list):
            first = doc.get(w[i])
            for j, x in enumerate(run):
                x = doc.get(x)
                if type(first) is not int or type(x) not in (int, float):
                    raise PdfError("bad W array", "FormatError")
                widths[first + j] = float(x)
            i += 2
        else:
            i += 3  # the range form gives no widths: the default holds for its CIDs
    embedded, file = embedded_text(doc, descendant)
    fallbacks = [embedded]
    for path in font_paths(name, options.font_folders):
        if os.path.exists(path):
            with open(path, "rb") as f:
                fallbacks.append(width_matches(widths, chars_by_width(f.read())))
            break
    return PdfFont(
        name, "Type0", widths, float(dw) if type(dw) in (int, float) else 1000.0, None, to_unicode_map(doc, font), fallbacks, spaces, cids, True, str(enc) if isinstance(enc, Name) else "stream", None, file, descendant
    )


def make_font(doc: Document, font: Any, options: Options) -> PdfFont:
    if not isinstance(font, dict):
        raise PdfError("font isn't a dictionary", "FormatError")
    subtype = _required(doc, font, "Subtype")
    if subtype == "Type0":
        return composite_font(doc, font, options)
    return type3_font(doc, font) if subtype == "Type3" else simple_font(doc, font)
