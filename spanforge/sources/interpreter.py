"""Content streams to glyphs.

State changes are interpreted operator by operator; the glyphs of one string share everything but
their place, so their places are computed at once, in single precision and in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from .fonts import Options, PdfFont, make_font
from .pdf_objects import END, Document, Keyword, Lexer, PdfError, Ref, Stream

f32 = np.float32
#: nested form XObjects beyond this are an error
MOST_DEPTH = 32
Matrix = tuple  # six numbers of single precision
IDENTITY: Matrix = tuple(f32(x) for x in (1, 0, 0, 1, 0, 0))
#: the end of inline image data
IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")


def times(m: Matrix, n: Matrix) -> Matrix:
    """First ``m``, then ``n``."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


@dataclass
class Glyphs:
    """Columns of the glyphs of a document, a list of arrays for each."""

    page: list = field(default_factory=list)
    code: list = field(default_factory=list)
    code_len: list = field(default_factory=list)
    text: list = field(default_factory=list)
    x: list = field(default_factory=list)
    y: list = field(default_factory=list)
    width: list = field(default_factory=list)
    tfs: list = field(default_factory=list)
    font: list = field(default_factory=list)
    size: list = field(default_factory=list)
    skipped: list = field(default_factory=list)


class State:
    __slots__ = ("ctm", "tm", "font", "size", "tc", "tw", "tz", "tl", "rise")

    def __init__(self):
        self.ctm = self.tm = IDENTITY
        self.font: PdfFont | None = None
        self.size = f32("nan")
        self.tc = self.tw = self.tl = self.rise = f32(0)
        self.tz = f32(1)

    def copy(self) -> "State":
        s = State.__new__(State)
        for k in self.__slots__:
            setattr(s, k, getattr(self, k))
        return s


def operations(data: bytes):
    """(operator, operands) in order. Image data between ID and EI is passed over."""
    lex, args = Lexer(data), []
    while True:
        t = lex.token()
        if t is END:
            return
        if not isinstance(t, Keyword) or t in ("[", "<<"):
            args.append(lex.value(t, False))
            continue
        if t in ("true", "false", "null"):
            args.append({"true": True, "false": False, "null": None}[t])
            continue
        if t in ("]", ">>", ")", ">", "{", "}"):
            raise PdfError(f"unexpected {t} in a content stream")
        if t == "ID":
            m = IMAGE_END.search(data, lex.at)
            lex.at = m.end() if m else len(data)
            args = []
            continue
        yield t, args
        args = []


class Interpreter:
    """Reads the pages of one document; fonts are resolved once for each object."""

    def __init__(self, doc: Document, options: Options | None = None):
        self.doc, self.options, self.out = doc, options or Options(), Glyphs()
        self.fonts: dict[Any, PdfFont] = {}

    def page(self, number: int, page: dict) -> None:
        doc = self.doc
        box = doc.inherited(page, "MediaBox")
        if not isinstance(box, list) or len(box) < 4:
            raise PdfError(f"page {number} without MediaBox", "FormatError")
        box = [doc.get(v) for v in box]
        if any(type(v) not in (int, float) for v in box[:4]):
            raise PdfError(f"page {number} with a bad MediaBox", "FormatError")
        resources = doc.inherited(page, "Resources")
        self.height = f32(box[3]) - f32(box[1])
        self.number = number
        self.stream(doc.page_content(page), resources if isinstance(resources, dict) else {}, 0)

    def _font(self, resources: dict, name: str) -> PdfFont:
        fonts = self.doc.key(resources, "Font")
        if not isinstance(fonts, dict) or name not in fonts:
            raise PdfError(f"no font resource {name}", "FormatError")
        o = fonts[name]
        key = o if isinstance(o, Ref) else id(o)
        if key not in self.fonts:
            self.fonts[key] = make_font(self.doc, self.doc.get(o), self.options)
        return self.fonts[key]

    def stream(self, data: bytes, resources: dict, depth: int) -> None:
        if depth > MOST_DEPTH:
            raise PdfError("form XObjects nested too deep", "FormatError")
        try:
            ops = list(operations(data))
        except (PdfError, ValueError) as e:
            self.out.skipped.append((self.number, str(e)))
            return
        s, stack, tlm = State(), [], IDENTITY
        try:
            for op, a in ops:
                if op == "Tj":
                    if not isinstance(a[0], bytes):
                        raise PdfError("Tj without a string", "FormatError")
                    self.show(s, a[0])
                elif op == "TJ":
                    if isinstance(a[0], list):
                        for e in a[0]:
                            if isinstance(e, bytes):
                                self.show(s, e)
                            elif type(e) in (int, float):
                                s.tm = times((f32(1), f32(0), f32(0), f32(1), s.tz * (-f32(e) / f32(1000)) * s.size, f32(0)), s.tm)
                elif op in ("Td", "TD", "T*"):
                    if op == "TD":
                        s.tl = -f32(a[1])
                    tx, ty = (f32(0), -s.tl) if op == "T*" else (f32(a[0]), f32(a[1]))
                    tlm = times((f32(1), f32(0), f32(0), f32(1), tx, ty), tlm)
                    s.tm = tlm
                elif op == "Tm":
                    tlm = s.tm = tuple(f32(v) for v in a[:6]) if len(a) == 6 else self._bad(op)
                elif op == "Tf":
                    s.font, s.size = self._font(resources, a[0]), f32(a[1])
                elif op in ("BT", "ET"):
                    tlm = s.tm = IDENTITY
                elif op == "cm":
                    s.ctm = times(tuple(f32(v) for v in a), s.ctm) if len(a) == 6 else self._bad(op)
                elif op == "q":
                    stack.append(s.copy())
                elif op == "Q":
                    if stack:
                        s = stack.pop()
                elif op == "Tc":
                    s.tc = f32(a[0])
                elif op == "Tw":
                    s.tw = f32(a[0])
                elif op == "Tz":
                    s.tz = f32(a[0]) / f32(100)
                elif op == "TL":
                    s.tl = f32(a[0])
                elif op == "Ts":
                    s.rise = f32(a[0])
                elif op == "gs":
                    self._graphics_state(resources, a[0])
                elif op == "Do":
                    self._form(resources, a[0], depth)
                elif op in ("'", '"') and self.options.quote_ops:
                    if op == '"':
                        s.tw, s.tc, a = f32(a[0]), f32(a[1]), a[2:]
                    tlm = s.tm = times((f32(1), f32(0), f32(0), f32(1), f32(0), -s.tl), tlm)
                    self.show(s, a[0])
        except (IndexError, TypeError) as e:
            raise PdfError(f"bad operands of {op}: {e}", "FormatError") from e

    def _bad(self, op: str):
        raise PdfError(f"wrong number of operands of {op}", "FormatError")

    def _graphics_state(self, resources: dict, name: str) -> None:
        """Soft masks and line widths never touch text; only their form is checked."""
        state = self.doc.key(self.doc.key(resources, "ExtGState"), name)
        if not isinstance(state, dict):
            raise PdfError(f"no graphics state {name}", "FormatError")
        if state.get("Type", "ExtGState") != "ExtGState":
            raise PdfError("graphics state of another type", "FormatError")
        mask = self.doc.key(state, "SMask")
        if mask is not None and mask != "None" and not isinstance(mask, (dict, Stream)):
            raise PdfError("unexpected soft mask", "FormatError")

    def _form(self, resources: dict, name: str, depth: int) -> None:
        """A form runs with a fresh state and its own resources, else the caller's; images are left out."""
        x = self.doc.key(self.doc.key(resources, "XObject"), name)
        if not isinstance(x, Stream):
            raise PdfError(f"no XObject {name}", "FormatError")
        if x.dict.get("Subtype") == "Image":
            return
        own = self.doc.key(x.dict, "Resources")
        self.stream(self.doc.contents(x), own if isinstance(own, dict) else resources, depth + 1)

    def show(self, s: State, data: bytes) -> None:
        font = s.font
        if font is None:
            raise PdfError("text shown without a font", "FormatError")
        codes = font.codes(data)
        if not codes:
            return
        n = len(codes)
        known = font.known
        for c, _ in codes:
            if c not in known:
                known[c] = (font.width(c), font.text(c))
        w0 = np.array([known[c][0] for c, _ in codes], f32) / f32(1000)
        spacing = np.full(n, s.tc, f32)
        spaces = np.array([c == 32 and k == 1 for c, k in codes])
        spacing[spaces] += s.tw
        tx = s.tz * (w0 * s.size + spacing)
        a, b, c, d, e, f = s.tm
        es = np.add.accumulate(np.concatenate(([e], tx * a)).astype(f32), dtype=f32)
        fs = np.add.accumulate(np.concatenate(([f], tx * b)).astype(f32), dtype=f32)
        p, q, r, t, u, v = s.ctm
        m11, m12, m21, m22 = a * p + b * r, a * q + b * t, c * p + d * r, c * q + d * t
        m31, m32 = es[:n] * p + fs[:n] * r + u, es[:n] * q + fs[:n] * t + v
        x, y = s.rise * m21 + m31, s.rise * m22 + m32
        vx = s.size * (s.tz * m11) + s.size * m21
        vy = s.size * (s.tz * m12) + s.size * m22
        product = vx * vy
        tfs = np.sqrt(product) if product >= 0 else f32("nan")
        s.tm = (a, b, c, d, es[n], fs[n])
        o = self.out
        o.page.append(np.full(n, self.number, np.int32))
        o.code.append(np.array([k for k, _ in codes], np.int32))
        o.code_len.append(np.array([k for _, k in codes], np.int32))
        o.text += [known[k][1] for k, _ in codes]
        o.x.append(x.astype(f32))
        o.y.append((self.height - y).astype(f32))
        o.width.append(w0)
        o.tfs.append(np.full(n, tfs, f32))
        o.font += [font.name] * n
        o.size.append(np.full(n, s.size, f32))
