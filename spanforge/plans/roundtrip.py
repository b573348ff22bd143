"""Text written as PDF files and read back: a check of the whole path on any text.

Each part of a document (20 pages of 54 lines) becomes one file, so no file grows with its document.
Text that fits code page 1252 goes into a simple font, half of the files with Differences for a base; other text into a
composite font with a ToUnicode map. Content is compressed; files alternate between a plain
cross-reference table and objects packed into an object stream. A feature writes the same pages by
other means of the format, so that reading them gives the same spans (see ``FEATURES``).
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, PAGES = 54, 20
#: relative moves; arrays of strings; graphics state, matrix and rise; forms; filters and predictors; widths of CIDs; encryption
FEATURES = ("", "moves", "arrays", "states", "forms", "filters", "widths", "rc4", "aes")
FILE_ID = b"spanforge roundtrip"[:16]
# Fixed value: the padding string of the standard security handler.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def _rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(data), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


class _Lock:
    """Encrypts streams for the empty user password, with RC4 or AES of 128 bits."""

    def __init__(self, aes: bool):
        self.aes, rights = aes, -44
        h = hashlib.md5(b"owner" + PAD[:27]).digest()
        for _ in range(50):
            h = hashlib.md5(h).digest()
        o = PAD
        for i in range(20):
            o = _rc4(bytes(b ^ i for b in h), o)
        key = hashlib.md5(PAD + o + (rights & 0xFFFFFFFF).to_bytes(4, "little") + FILE_ID).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        u = hashlib.md5(PAD + FILE_ID).digest()
        for i in range(20):
            u = _rc4(bytes(b ^ i for b in key), u)
        self.key = key
        kind = b"/V 4/R 4/CF<</StdCF<</CFM/AESV2/Length 16/AuthEvent/DocOpen>>>>/StmF/StdCF/StrF/StdCF" if aes else b"/V 2/R 3"
        self.dictionary = b"<</Filter/Standard%s/Length 128/O<%s>/U<%s>/P %d>>" % (kind, o.hex().encode(), (u + bytes(16)).hex().encode(), rights)
        self.trailer = b"/Encrypt 4 0 R/ID[<%s><%s>]" % (FILE_ID.hex().encode(), FILE_ID.hex().encode())

    def __call__(self, number: int, data: bytes) -> bytes:
        key = hashlib.md5(self.key + number.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if self.aes else b"")).digest()
        if not self.aes:
            return _rc4(key, data)
        from ..sources.crypt import Aes

        iv, fill = hashlib.md5(data).digest(), 16 - len(data) % 16
        return iv + Aes(key).cbc_encrypt(iv, data + bytes([fill]) * fill)


def _lzw(data: bytes) -> bytes:
    """Literal codes of nine bits; the table is cleared before they grow."""
    codes = [c for i in range(0, len(data), 250) for c in (256, *data[i : i + 250])] + [257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def _predicted(data: bytes, columns: int = 32) -> bytes:
    """Rows of PNG prediction, each with another of its five filters."""
    out, prior = bytearray(), bytes(columns)
    for k, i in enumerate(range(0, len(data), columns)):
        row, kind = data[i : i + columns].ljust(columns), k % 5
        out.append(kind)
        for j, x in enumerate(row):
            a, b, c = row[j - 1] if j else 0, prior[j], prior[j - 1] if j else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        prior = row
    return bytes(out)


def _filtered(data: bytes, kind: int) -> tuple[bytes, bytes]:
    """Content under one of five filters or chains, and the entries that name them."""
    if kind == 0:
        return _lzw(data), b"/Filter/LZWDecode"
    if kind == 1:
        return data.hex().encode() + b">", b"/Filter/ASCIIHexDecode"
    if kind == 2:
        return base64.a85encode(zlib.compress(data)) + b"~>", b"/Filter[/ASCII85Decode/FlateDecode]"
    if kind == 3:
        return zlib.compress(_predicted(data)), b"/Filter/FlateDecode/DecodeParms<</Predictor 15/Columns 32>>"
    return data, b""


def _stream(data: bytes, extra: bytes = b"") -> bytes:
    z = zlib.compress(data)
    return b"<<%s/Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (extra, len(z), z)


def _to_unicode(code: dict[str, int]) -> bytes:
    out = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n"
    items = sorted(code.items())
    for i in range(0, len(items), 100):
        part = items[i : i + 100]
        out += b"%d beginbfchar\n" % len(part) + b"".join(b"<%04X> <%s>\n" % (n, c.encode("utf-16-be").hex().encode()) for c, n in part) + b"endbfchar\n"
    return out


def _rows_content(rows: list[tuple[int, str]], show, feature: str) -> bytes:
    """The rows of a page (number, text), each at 72 points from the left and 12 apart."""
    y = lambda r: 720 - 12 * r
    if feature == "moves":
        out, at = b"BT /F1 10 Tf 12 TL 72 732 Td\n", -1
        for r, t in rows:
            step = r - at
            out += (b"T*" if step == 1 else b"0 %d Td" % (-12 * step) if step % 2 else b"0 %d TD 12 TL" % (-12 * step)) + b" %s Tj\n" % show(t)
            at = r
        return out + b"ET"
    if feature == "arrays":
        return b"BT /F1 10 Tf\n" + b"".join(b"1 0 0 1 72 %d Tm [%s 50 -50 %s 0] TJ\n" % (y(r), show(t[: len(t) // 2]), show(t[len(t) // 2 :])) for r, t in rows) + b"ET"
    if feature == "states":
        return b"".join(b"q 1 0 0 1 72 %d cm /Span BMC BT /F1 10 Tf 0 Tc 0 Tw 100 Tz 3 Ts 1 w %s Tj ET EMC Q\n" % (y(r) - 3, show(t)) for r, t in rows)
    return b"BT /F1 10 Tf\n" + b"".join(b"1 0 0 1 72 %d Tm %s Tj\n" % (y(r), show(t)) for r, t in rows) + b"ET"


def write_pdf(lines: list[tuple[int, str]], variant: int, feature: str = "") -> bytes:
    """A file of (line number in the part, text), written with one of FEATURES. Characters beyond the basic plane are in pairs."""
    lines = [(n, "".join(c for c in t if not 0xD800 <= ord(c) < 0xE000)) for n, t in lines]
    try:
        for _, t in lines:
            t.encode("cp1252")
        simple = all(ord(c) >= 32 and c not in "\x7f\xa0\xad" for _, t in lines for c in t)
    except UnicodeEncodeError:
        simple = False
    chars = sorted({c for _, t in lines for c in t})
    code = {c: ord(c) for c in chars if ord(c) < 0x10000}
    free = (n for n in range(0xE000, 0xF900) if chr(n) not in code)  # codes of characters that need a pair
    code |= {c: next(free) for c in chars if ord(c) >= 0x10000}
    show = (lambda t: b"<" + t.encode("cp1252").hex().encode() + b">") if simple else (lambda t: b"<" + b"".join(b"%04X" % code[c] for c in t) + b">")
    count = 1 + max((n for n, _ in lines), default=0) // ROWS
    pages = [[(n % ROWS, t) for n, t in lines if n // ROWS == p and t] for p in range(count)]
    streams: dict[int, tuple[bytes, bytes]] = {}
    if simple:
        widths = b"/FirstChar 0/LastChar 255/Widths[%s]" % (b"600 " * 256)
        enc = b"/Encoding/WinAnsiEncoding" if variant % 2 else b"/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/A/B 97/a]>>"
        font = b"<</Type/Font/Subtype/Type1/BaseFont/Courier%s%s>>" % (enc, widths)
    else:
        streams[7] = zlib.compress(_to_unicode(code)), b"/Filter/FlateDecode"
        wide = b"/DW 100/W[%s]/CIDToGIDMap/Identity" % b"".join(b"%d[600]" % n for n in sorted(code.values())) if feature == "widths" else b"/DW 600"
        way = b"V" if feature == "widths" and variant % 2 else b"H"
        font = b"<</Type/Font/Subtype/Type0/BaseFont/Courier/Encoding/Identity-%s/ToUnicode 7 0 R/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/BaseFont/Courier/FontDescriptor<<>>%s>>]>>" % (way, wide)
    lock = _Lock(feature == "aes") if feature in ("rc4", "aes") else None
    small = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: font}
    step = 3 if feature == "forms" else 2
    kids = b" ".join(b"%d 0 R" % (10 + step * p) for p in range(len(pages)))
    forms = b"/XObject<<%s>>" % b"".join(b"/X%d %d 0 R" % (p, 12 + step * p) for p in range(len(pages))) if feature == "forms" else b""
    small[2] = b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>%s>>>>" % (kids, len(pages), forms)
    for p, rows in enumerate(pages):
        small[10 + step * p] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + step * p)
        text, extra = _rows_content(rows, show, feature), b""
        if feature == "forms":
            streams[12 + step * p] = zlib.compress(text), b"/Type/XObject/Subtype/Form/BBox[0 0 612 792]/Filter/FlateDecode" + (b"/Resources<</Font<</F1 3 0 R>>>>" if p % 2 else b"")
            text = b"q /X%d Do Q" % p
        streams[11 + step * p] = _filtered(text, (variant + p) % 5) if feature == "filters" else (zlib.compress(text), b"/Filter/FlateDecode" + extra)
    packed = variant % 4 >= 2
    if packed:
        head, body = b"", b""
        for n, o in small.items():
            head += b"%d %d " % (n, len(body))
            body += o + b" "
        streams[5] = zlib.compress(head + body), b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(small), len(head))
    bodies: dict[int, bytes] = {} if packed else dict(small)
    if lock is not None:
        bodies[4] = lock.dictionary
    for n, (data, extra) in streams.items():
        data = data if lock is None else lock(n, data)
        bodies[n] = b"<<%s/Length %d>>stream\n%s\nendstream" % (extra, len(data), data)
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n in sorted(bodies):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, bodies[n])
    start = len(out)
    size = max([*bodies, *small, 6]) + 1
    trailer = b"/Size %d/Root 1 0 R%s" % (size, lock.trailer if lock is not None else b"")
    if packed:
        at[6] = start
        order = {n: i for i, n in enumerate(small)}
        rows = b"".join(b"\x02" + (5).to_bytes(4, "big") + order[n].to_bytes(2, "big") if n in order else (b"\x01" + at[n].to_bytes(4, "big") + b"\0\0" if n in at else bytes(7)) for n in range(size))
        out += b"6 0 obj\n%s\nendobj\n" % _stream(rows, b"/Type/XRef%s/W[1 4 2]" % trailer)
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n" for n in range(1, size))
        out += b"trailer<<%s>>\n" % trailer
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def files(lines: DataFrame, feature: str = "") -> DataFrame:
    """doc (with the part's number), content: one file for each 1,080 lines of (doc, line_no, text)."""
    part = F.floor(F.col("line_no") / (ROWS * PAGES)).cast("int")
    parts = lines.withColumn("part", part).withColumn("n", (F.col("line_no") % (ROWS * PAGES)).cast("int"))

    def run(key, table):
        rows = sorted(zip(table["n"].to_pylist(), table["text"].to_pylist()))
        doc, no = key[0].as_py(), key[1].as_py()
        return pa.table({"doc": pa.array([f"{doc}#{no}"], pa.string()), "content": pa.array([write_pdf(rows, sum(doc.encode()) + no, feature)], pa.binary())})

    return parts.select("doc", "part", "n", "text").groupBy("doc", "part").applyInArrow(run, "doc string, content binary")
