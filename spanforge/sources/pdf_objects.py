"""PDF files as objects: tokens, cross references, object streams, decryption, page tree."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from . import filters
from .crypt import Decryptor


class PdfError(ValueError):
    """A file that can't be read as PDF; ``kind`` is FormatError, IoError or PdfError."""

    def __init__(self, message: str, kind: str = "PdfError"):
        super().__init__(message)
        self.kind = kind


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Keyword(str):
    __slots__ = ()


class Stream:
    __slots__ = ("dict", "raw", "ready")

    def __init__(self, d: dict, raw: bytes):
        self.dict, self.raw, self.ready = d, raw, False


SPACE = b"\x00\t\n\x0c\r "
TOKEN = re.compile(
    rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*"
    rb"(?:(?P<num>[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$))|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<open><<)|(?P<close>>>)|<(?P<hex>[0-9A-Fa-f\x00\t\n\x0c\r ]*)>|(?P<str>\()|(?P<arr>[\[\]{}])|(?P<kw>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<bad>[)<>]))"
)
STRING_PART = re.compile(rb"[()\\\r]")
ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f", 0x28: b"(", 0x29: b")", 0x5C: b"\\"}
NAME_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
END = object()


def read_string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses whose opening one stands before ``at``."""
    out, depth = [], 1
    while True:
        m = STRING_PART.search(data, at)
        if not m:
            raise PdfError("string without end")
        out.append(data[at : m.start()])
        at, c = m.end(), m.group()
        if c == b"(":
            depth += 1
            out.append(c)
        elif c == b")":
            depth -= 1
            if not depth:
                return b"".join(out), at
            out.append(c)
        elif c == b"\r":
            out.append(b"\n")
            at += data[at : at + 1] == b"\n"
        else:
            e = data[at : at + 1]
            if e in b"01234567" and e:
                digits = re.match(rb"[0-7]{1,3}", data[at : at + 3]).group()
                out.append(bytes([int(digits, 8) & 255]))
                at += len(digits)
            elif e == b"\r":
                at += 2 if data[at + 1 : at + 2] == b"\n" else 1
            elif e == b"\n":
                at += 1
            elif e:
                out.append(ESCAPES.get(e[0], e))
                at += 1


class Lexer:
    """Objects from bytes, in order."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> Any:
        m = TOKEN.match(self.data, self.at)
        if not m:
            return END
        self.at = m.end()
        kind = m.lastgroup
        if kind == "num":
            s = m["num"]
            return float(s) if b"." in s else int(s)
        if kind == "name":
            n = m["name"]
            if b"#" in n:
                n = NAME_HEX.sub(lambda h: bytes([int(h[1], 16)]), n)
            return Name(n.decode("latin-1"))
        if kind == "str":
            s, self.at = read_string(self.data, self.at)
            return s
        if kind == "hex":
            h = re.sub(rb"[^0-9A-Fa-f]", b"", m["hex"])
            return bytes.fromhex((h + b"0" * (len(h) % 2)).decode("ascii"))
        if kind == "kw":
            return Keyword(m["kw"].decode("latin-1"))
        return Keyword((m["open"] or m["close"] or m["arr"] or m["bad"]).decode("latin-1"))

    def value(self, first: Any = None, refs: bool = True) -> Any:
        """The next object; ``first`` is its first token if that was read already."""
        t = self.token() if first is None else first
        if not isinstance(t, Keyword):
            if refs and type(t) is int and t >= 0:
                mark = self.at
                g = self.token()
                if type(g) is int and g >= 0 and self.token() == "R":
                    return Ref(t, g)
                self.at = mark
            return t
        if t == "[":
            out = []
            while True:
                t = self.token()
                if t is END or isinstance(t, Keyword) and t in ("]", ">>", "endobj"):
                    return out
                out.append(self.value(t, refs))
        if t == "<<":
            d: dict = {}
            while True:
                k = self.token()
                if k is END or isinstance(k, Keyword) and k in (">>", "endobj"):
                    return d
                if isinstance(k, Name):
                    v = self.token()
                    if isinstance(v, Keyword) and v == ">>":
                        d[k] = None
                        return d
                    d[k] = self.value(v, refs)
        return {"true": True, "false": False, "null": None}.get(t, t)


class Document:
    """A PDF file. ``password`` opens encrypted files; without it the empty one is tried."""

    def __init__(self, data: bytes, password: str | None = None):
        if not data:
            raise PdfError("empty file", "IoError")
        start = data.find(b"%PDF-", 0, 4096)
        if start < 0:
            raise PdfError("no PDF header")
        self.data = data[start:] if start else data
        self.offsets: dict[int, tuple[int, int, int]] = {}
        self.trailer: dict = {}
        self.cache: dict[int, Any] = {}
        self.packed: dict[int, dict[int, Any]] = {}
        self.crypt: Decryptor | None = None
        try:
            self._read_xref()
            # in an encrypted file the catalog may lie in an object stream no one can read yet
            if "Encrypt" not in self.trailer and not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("no catalog")
        except (PdfError, ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError):
            self.cache.clear()
            self._rebuild()
        if "Encrypt" in self.trailer:
            enc = self.get(self.trailer["Encrypt"])
            enc = {k: self.get(v) for k, v in enc.items()}
            if isinstance(enc.get("CF"), dict):
                enc["CF"] = {k: {a: self.get(b) for a, b in self.get(v).items()} for k, v in enc["CF"].items()}
            ids = self.get(self.trailer.get("ID")) or [b""]
            self.crypt = Decryptor(enc, self.get(ids[0]) or b"", password or "")
            ref = self.trailer["Encrypt"]
            self.cache = {ref.num: enc} if isinstance(ref, Ref) else {}
            self.packed.clear()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise PdfError("no catalog")

    # cross references

    def _read_xref(self) -> None:
        m = re.search(rb"startxref\s+(\d+)", self.data[-2048:])
        if not m:
            raise PdfError("no startxref")
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            lex = Lexer(self.data, at)
            t = lex.token()
            if t == "xref":
                d = self._table(lex)
            else:
                d = self._xref_stream(at)
            for k, v in d.items():
                self.trailer.setdefault(k, v)
            todo += [d[k] for k in ("XRefStm", "Prev") if isinstance(d.get(k), int)]
        if "Root" not in self.trailer:
            raise PdfError("no trailer")

    def _table(self, lex: Lexer) -> dict:
        while True:
            t = lex.token()
            if t == "trailer":
                d = lex.value()
                if not isinstance(d, dict):
                    raise PdfError("bad trailer")
                return d
            count = lex.token()
            if type(t) is not int or type(count) is not int:
                raise PdfError("bad xref table")
            for i in range(count):
                off, gen, kind = lex.token(), lex.token(), lex.token()
                if kind == "n" and off:
                    self.offsets.setdefault(t + i, (1, off, gen))
                elif kind == "f":
                    self.offsets.setdefault(t + i, (0, 0, 0))

    def _xref_stream(self, at: int) -> dict:
        _, s = self._object_at(at)
        if not isinstance(s, Stream):
            raise PdfError("bad xref stream")
        d, data = s.dict, self.contents(s, raw_ok=False)
        w = d["W"]
        index = d.get("Index") or [0, d["Size"]]
        at = 0
        for first, count in zip(index[::2], index[1::2]):
            for num in range(first, first + count):
                f = []
                for k in w:
                    f.append(int.from_bytes(data[at : at + k], "big"))
                    at += k
                self.offsets.setdefault(num, (f[0] if w[0] else 1, f[1], f[2] if w[2] else 0))
        return d

    def _rebuild(self) -> None:
        """Find objects by their headers where the cross references can't be used."""
        self.offsets, self.trailer = {}, {}
        for m in re.finditer(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b", self.data):
            self.offsets[int(m[1])] = (1, m.start(1), int(m[2]))
        for m in re.finditer(rb"trailer\s*<<", self.data):
            try:
                d = Lexer(self.data, m.start() + 7).value()
            except (PdfError, ValueError):
                continue
            if isinstance(d, dict):
                self.trailer |= d
        for num in list(self.offsets):
            try:
                o = self.get(Ref(num, 0))
            except (PdfError, ValueError, RecursionError):
                continue
            d = o.dict if isinstance(o, Stream) else o
            if not isinstance(d, dict):
                continue
            if d.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(num, 0))
            elif isinstance(o, Stream) and d.get("Type") == "XRef":
                for k in ("Root", "Encrypt", "ID", "Info"):
                    if k in d:
                        self.trailer.setdefault(k, d[k])
            elif isinstance(o, Stream) and d.get("Type") == "ObjStm" and "Encrypt" not in self.trailer:
                for inner in self._unpack(num):
                    self.offsets.setdefault(inner, (2, num, 0))
                    if isinstance(self.packed[num].get(inner), dict) and self.packed[num][inner].get("Type") == "Catalog":
                        self.trailer.setdefault("Root", Ref(inner, 0))
        if "Root" not in self.trailer:
            raise PdfError("no objects found")

    # objects

    def _object_at(self, at: int) -> tuple[int, Any]:
        lex = Lexer(self.data, at)
        num, gen, word = lex.token(), lex.token(), lex.token()
        if word != "obj" or type(num) is not int:
            raise PdfError(f"no object at {at}")
        o = lex.value()
        if isinstance(o, dict):
            mark = lex.at
            if lex.token() == "stream":
                start = lex.at
                start += 2 if self.data[start : start + 2] == b"\r\n" else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
                n = o.get("Length")
                n = self.get(n) if isinstance(n, Ref) else n
                end = start + n if type(n) is int and n >= 0 else -1
                if end < 0 or end > len(self.data) or not re.match(rb"\s*endstream", self.data[end : end + 16]):
                    end = self.data.find(b"endstream", start)
                    end = len(self.data) if end < 0 else end
                    while end > start and self.data[end - 1 : end] in (b"\n", b"\r") and end - start > 0:
                        end -= 1
                        if self.data[end - 1 : end] != b"\r":
                            break
                return num, self._open(Stream(o, self.data[start:end]), num, gen)
            lex.at = mark
        return num, self._open(o, num, gen)

    def _open(self, o: Any, num: int, gen: int) -> Any:
        """Decrypt the strings and stream of an object that was read from the file itself."""
        c = self.crypt
        if c is None:
            return o
        if isinstance(o, bytes):
            return c.decrypt(o, num, gen, False)
        if isinstance(o, list):
            return [self._open(x, num, gen) for x in o]
        if isinstance(o, dict):
            return {k: self._open(v, num, gen) for k, v in o.items()}
        if isinstance(o, Stream):
            if o.dict.get("Type") == "XRef":
                return o
            names = self.get(o.dict.get("Filter"))
            crypt_filter = names == "Crypt" or isinstance(names, list) and "Crypt" in names
            plain = crypt_filter or o.dict.get("Type") == "Metadata" and not c.meta
            return Stream(self._open(o.dict, num, gen), o.raw if plain else c.decrypt(o.raw, num, gen, True))
        return o

    def _unpack(self, num: int) -> dict[int, Any]:
        if num not in self.packed:
            s = self.get(Ref(num, 0))
            if not isinstance(s, Stream):
                raise PdfError("bad object stream")
            data = self.contents(s, raw_ok=False)
            lex, n, first = Lexer(data), int(self.get(s.dict["N"])), int(self.get(s.dict["First"]))
            heads = [(lex.token(), lex.token()) for _ in range(n)]
            self.packed[num] = {a: Lexer(data, first + off).value() for a, off in heads if type(a) is int and type(off) is int}
        return self.packed[num]

    def get(self, o: Any) -> Any:
        """The object itself, references followed; what a dangling reference means is null."""
        for _ in range(64):
            if not isinstance(o, Ref):
                return o
            if o.num in self.cache:
                o = self.cache[o.num]
                continue
            kind, a, _ = self.offsets.get(o.num, (0, 0, 0))
            if kind == 1:
                num, v = self._object_at(a)
                if num != o.num:
                    raise PdfError(f"object {o.num} isn't where the cross references say")
            elif kind == 2:
                v = self._unpack(a).get(o.num)
            else:
                v = None
            self.cache[o.num] = v
            o = v
        raise PdfError("references run in a circle")

    def key(self, d: Any, name: str) -> Any:
        return self.get(d.get(name)) if isinstance(d, dict) else None

    def number(self, d: Any, name: str) -> float | None:
        v = self.key(d, name)
        return v if type(v) in (int, float) else None

    def contents(self, s: Stream, raw_ok: bool = True) -> bytes:
        """A stream through its filters; if one fails, the bytes as they stand."""
        names, parms = self.key(s.dict, "Filter"), self.key(s.dict, "DecodeParms")
        names = [self.get(n) for n in names] if isinstance(names, list) else [names] if names else []
        parms = [self.get(p) for p in parms] if isinstance(parms, list) else [parms]
        data = s.raw
        try:
            for i, n in enumerate(names):
                if n == "Crypt":
                    continue
                p = parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
                data = filters.decode(n, data, {k: self.get(v) for k, v in p.items()})
        except Exception:
            if raw_ok:
                return s.raw
            raise
        return data

    # pages

    def pages(self) -> list[dict]:
        """Page dictionaries in order. A node met twice ends its branch."""
        out: list[dict] = []
        seen: set[int] = set()
        root = self.key(self.get(self.trailer.get("Root")), "Pages")
        todo: list[tuple[Any, dict | None]] = [(root, None)]
        while todo:
            o, parent = todo.pop()
            if isinstance(o, Ref):
                if o.num in seen:
                    continue
                seen.add(o.num)
            d = self.get(o)
            if not isinstance(d, dict):
                continue
            if parent is not None and "Parent" not in d:
                d = {**d, "Parent": parent}
            kids = self.key(d, "Kids")
            if isinstance(kids, list) and d.get("Type") != "Page":
                todo += [(k, d) for k in reversed(kids)]
            else:
                out.append(d)
        return out

    def inherited(self, d: dict, name: str) -> Any:
        """A page attribute, looked up through all parents; a parent met again ends the search."""
        seen: set[int] = set()
        while id(d) not in seen:
            seen.add(id(d))
            v = self.key(d, name)
            if v is not None:
                return v
            d = self.key(d, "Parent")
            if not isinstance(d, dict):
                return None
        return None

    def page_content(self, page: dict) -> bytes:
        c = self.key(page, "Contents")
        parts = [self.get(x) for x in c] if isinstance(c, list) else [c]
        return b"\n".join(self.contents(s) for s in parts if isinstance(s, Stream))
