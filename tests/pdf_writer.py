"""Writes small PDF files for tests; shares nothing with the parser."""

import hashlib
import zlib

PAD = bytes([0x28, 0xBF, 0x4E, 0x5E, 0x4E, 0x75, 0x8A, 0x41, 0x64, 0x00, 0x4E, 0x56, 0xFF, 0xFA, 0x01, 0x08, 0x2E, 0x2E, 0x00, 0xB6, 0xD0, 0x68, 0x3E, 0x80, 0x2F, 0x0C, 0xA9, 0xFE, 0x64, 0x53, 0x69, 0x7A])
COURIER = b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"


def escape(s: bytes) -> bytes:
    return s.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def stream(data: bytes, extra: bytes = b"", flate: bool = False) -> bytes:
    if flate:
        data, extra = zlib.compress(data), extra + b"/Filter/FlateDecode"
    return b"<<%s/Length %d>>stream\n%s\nendstream" % (extra, len(data), data)


def assemble(objects: dict[int, bytes], trailer: bytes = b"") -> bytes:
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n"
    return bytes(out + b"trailer<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, start))


def pages(contents: list[bytes], fonts: dict[str, bytes] | None = None, extra: dict[int, bytes] | None = None, resources: bytes = b"", page: bytes = b"", parent: bytes = b"/MediaBox[0 0 612 792]", flate: bool = False) -> dict[int, bytes]:
    """Objects of a file: 1 catalog, 2 pages, fonts from 10, pages from 100, contents from 200."""
    fonts = {"F1": COURIER} if fonts is None else fonts
    names = b"".join(b"/%s %d 0 R" % (n.encode(), 10 + i) for i, n in enumerate(fonts))
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>"}
    kids = b" ".join(b"%d 0 R" % (100 + i) for i in range(len(contents)))
    objects[2] = b"<</Type/Pages/Kids[%s]/Count %d/Resources<</Font<<%s>>%s>>%s>>" % (kids, len(contents), names, resources, parent)
    for i, f in enumerate(fonts.values()):
        objects[10 + i] = f
    for i, c in enumerate(contents):
        objects[100 + i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R%s>>" % (200 + i, page)
        objects[200 + i] = stream(c, flate=flate)
    return objects | (extra or {})


def lines_content(lines: list[str], x: int = 72, top: int = 720, pitch: int = 12) -> bytes:
    out = b"BT /F1 10 Tf %d TL %d %d Td\n" % (pitch, x, top)
    return out + b"".join(b"(%s) Tj T*\n" % escape(t.encode("cp1252")) for t in lines) + b"ET"


def rc4(key: bytes, data: bytes) -> bytes:
    s, j, out = list(range(256)), 0, bytearray()
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) % 256
        s[i], s[j] = s[j], s[i]
    i = j = 0
    for b in data:
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) % 256])
    return bytes(out)


def encrypted(content: bytes, password: bytes, aes=None) -> bytes:
    """RC4 with 128 bits, or AES with 128 bits if ``aes(key, data)`` gives IV and ciphertext."""
    fid, p = b"0123456789abcdef", -44
    padded = (password + PAD)[:32]
    h = hashlib.md5((b"owner" + PAD)[:32]).digest()
    for _ in range(50):
        h = hashlib.md5(h).digest()
    o = padded
    for i in range(20):
        o = rc4(bytes(b ^ i for b in h), o)
    key = hashlib.md5(padded + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + fid).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    u = hashlib.md5(PAD + fid).digest()
    for i in range(20):
        u = rc4(bytes(b ^ i for b in key), u)
    u += bytes(16)
    ok = lambda n: hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if aes else b"")).digest()
    objects = pages([content])
    objects[200] = stream(aes(ok(200), content) if aes else rc4(ok(200), content))
    if aes:
        kind = b"/V 4/R 4/Length 128/CF<</StdCF<</CFM/AESV2/Length 16/AuthEvent/DocOpen>>>>/StmF/StdCF/StrF/StdCF"
    else:
        kind = b"/V 2/R 3/Length 128"
    objects[300] = b"<</Filter/Standard%s/O<%s>/U<%s>/P %d>>" % (kind, o.hex().encode(), u.hex().encode(), p)
    return assemble(objects, b"/Encrypt 300 0 R/ID[<%s><%s>]" % (fid.hex().encode(), fid.hex().encode()))


def object_stream_file(content: bytes) -> bytes:
    """Objects in an object stream, found through a cross-reference stream with a PNG predictor."""
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 612 792]>>", 3: b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 4 0 R>>>>/Contents 6 0 R>>", 4: COURIER}
    head, body = b"", b""
    for n, o in inner.items():
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    out = bytearray(b"%PDF-1.5\n")
    at = {}
    for n, o in ((5, stream(head + body, b"/Type/ObjStm/N %d/First %d" % (len(inner), len(head)), True)), (6, stream(content, flate=True))):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    at[7] = len(out)
    rows = [(0, 0, 0)] + [(2, 5, i) for i in range(4)] + [(1, at[5], 0), (1, at[6], 0), (1, at[7], 0)]
    raw, prior = b"", bytes(4)
    for a, b, c in rows:
        row = bytes([a]) + b.to_bytes(2, "big") + bytes([c])
        raw += b"\x02" + bytes((x - y) % 256 for x, y in zip(row, prior))
        prior = row
    xref = stream(zlib.compress(raw), b"/Type/XRef/Size 8/Root 1 0 R/W[1 2 1]/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>")
    return bytes(out + b"7 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (xref, at[7]))
