"""Stream filters of PDF: Flate, LZW, ASCII85, ASCIIHex, RunLength, and their predictors."""

from __future__ import annotations

import re
import zlib


def flate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        return d.decompress(data) + d.flush()
    except zlib.error:
        out, d = b"", zlib.decompressobj()
        for i in range(0, len(data), 256):  # what can be read of a damaged stream
            try:
                out += d.decompress(data[i : i + 256])
            except zlib.error:
                break
        if out:
            return out
        return zlib.decompressobj(-15).decompress(data[2:])


def lzw(data: bytes, early: int = 1) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    width, bits, held, prev = 9, 0, 0, None
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        while bits >= width:
            code = (held >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 256:
                del table[258:]
                width, prev = 9, None
                continue
            if code == 257:
                return b"".join(out)
            if prev is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else prev + prev[:1]
                table.append(prev + entry[:1])
            out.append(entry)
            prev = entry
            size = len(table) + early
            width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"\s", b"", data)
    data = data[2:] if data.startswith(b"<~") else data
    end = data.find(b"~")
    data = data if end < 0 else data[:end]
    out = bytearray()
    group: list[int] = []
    for c in data:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
            continue
        if not 0x21 <= c <= 0x75:
            continue
        group.append(c - 0x21)
        if len(group) == 5:
            n = 0
            for g in group:
                n = n * 85 + g
            out += (n & 0xFFFFFFFF).to_bytes(4, "big")
            group = []
    if len(group) > 1:
        k = len(group)
        n = 0
        for g in group + [84] * (5 - k):
            n = n * 85 + g
        out += (n & 0xFFFFFFFF).to_bytes(4, "big")[: k - 1]
    return bytes(out)


def asciihex(data: bytes) -> bytes:
    data = re.sub(rb"[^0-9A-Fa-f>]", b"", data).split(b">")[0]
    return bytes.fromhex((data + b"0" * (len(data) % 2)).decode("ascii"))


def runlength(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undo a TIFF or PNG predictor."""
    kind = int(parms.get("Predictor", 1))
    if kind < 2:
        return data
    colors, depth, columns = int(parms.get("Colors", 1)), int(parms.get("BitsPerComponent", 8)), int(parms.get("Columns", 1))
    step, width = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2:
        if depth != 8:
            return data
        out = bytearray(data)
        for row in range(0, len(out), width):
            for i in range(row + step, min(row + width, len(out))):
                out[i] = (out[i] + out[i - step]) & 255
        return bytes(out)
    out = bytearray()
    prior = bytearray(width)
    for at in range(0, len(data), width + 1):
        tag, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        row += bytes(width - len(row))
        for i in range(width):
            left = row[i - step] if i >= step else 0
            up = prior[i]
            if tag == 1:
                row[i] = (row[i] + left) & 255
            elif tag == 2:
                row[i] = (row[i] + up) & 255
            elif tag == 3:
                row[i] = (row[i] + (left + up) // 2) & 255
            elif tag == 4:
                corner = prior[i - step] if i >= step else 0
                p = left + up - corner
                a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                row[i] = (row[i] + (left if a <= b and a <= c else up if b <= c else corner)) & 255
        out += row
        prior = row
    return bytes(out)


def decode(name: str, data: bytes, parms: dict) -> bytes:
    """One filter by its full or short name; image filters are an error here."""
    if name in ("FlateDecode", "Fl"):
        return unpredict(flate(data), parms)
    if name in ("LZWDecode", "LZW"):
        return unpredict(lzw(data, int(parms.get("EarlyChange", 1))), parms)
    if name in ("ASCII85Decode", "A85"):
        return ascii85(data)
    if name in ("ASCIIHexDecode", "AHx"):
        return asciihex(data)
    if name in ("RunLengthDecode", "RL"):
        return runlength(data)
    raise ValueError(f"unsupported filter {name}")
