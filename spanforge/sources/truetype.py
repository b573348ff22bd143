"""The few tables of TrueType and OpenType fonts that text extraction needs: cmap, hmtx, post."""

from __future__ import annotations

import struct

from ..functions.glyph_names import standard_order


class Font:
    """A font file; only the first face of a collection is read."""

    def __init__(self, data: bytes):
        at = 0
        if data[:4] == b"ttcf":
            at = struct.unpack(">I", data[12:16])[0]
        if data[at : at + 4] not in (b"\0\1\0\0", b"OTTO", b"true"):
            raise ValueError("no TrueType or OpenType font")
        n = struct.unpack(">H", data[at + 4 : at + 6])[0]
        self.data = data
        self.tables = {}
        for i in range(n):
            tag, _, off, size = struct.unpack(">4sIII", data[at + 12 + 16 * i : at + 28 + 16 * i])
            self.tables[tag.decode("latin-1")] = (off, size)
        off, _ = self.tables.get("head", (0, 0))
        self.units = struct.unpack(">H", data[off + 18 : off + 20])[0] if off else 1000
        off, _ = self.tables.get("maxp", (0, 0))
        self.glyphs = struct.unpack(">H", data[off + 4 : off + 6])[0] if off else 0

    def subtables(self) -> list[tuple[int, int, dict[int, int]]]:
        """(platform, encoding, code point to glyph) of each cmap subtable that can be read."""
        if "cmap" not in self.tables:
            return []
        off, _ = self.tables["cmap"]
        d, out = self.data, []
        n = struct.unpack(">H", d[off + 2 : off + 4])[0]
        for i in range(n):
            platform, enc, sub = struct.unpack(">HHI", d[off + 4 + 8 * i : off + 12 + 8 * i])
            try:
                out.append((platform, enc, self._mapping(off + sub)))
            except (struct.error, IndexError):
                continue
        return out

    def _mapping(self, at: int) -> dict[int, int]:
        d, out = self.data, {}
        fmt = struct.unpack(">H", d[at : at + 2])[0]
        if fmt == 0:
            return {c: g for c, g in enumerate(d[at + 6 : at + 262]) if g}
        if fmt == 4:
            n = struct.unpack(">H", d[at + 6 : at + 8])[0] // 2
            p = at + 14
            ends = struct.unpack(f">{n}H", d[p : p + 2 * n])
            p += 2 * n + 2
            starts = struct.unpack(f">{n}H", d[p : p + 2 * n])
            deltas = struct.unpack(f">{n}H", d[p + 2 * n : p + 4 * n])
            r = p + 4 * n
            offs = struct.unpack(f">{n}H", d[r : r + 2 * n])
            for i in range(n):
                for c in range(starts[i], ends[i] + 1):
                    if c == 0xFFFF:
                        continue
                    if offs[i]:
                        q = r + 2 * i + offs[i] + 2 * (c - starts[i])
                        g = struct.unpack(">H", d[q : q + 2])[0]
                        g = (g + deltas[i]) & 0xFFFF if g else 0
                    else:
                        g = (c + deltas[i]) & 0xFFFF
                    if g:
                        out[c] = g
        elif fmt == 6:
            first, n = struct.unpack(">HH", d[at + 6 : at + 10])
            for i, g in enumerate(struct.unpack(f">{n}H", d[at + 10 : at + 10 + 2 * n])):
                if g:
                    out[first + i] = g
        elif fmt in (12, 13):
            n = struct.unpack(">I", d[at + 12 : at + 16])[0]
            for i in range(min(n, (len(d) - at - 16) // 12)):
                a, b, g = struct.unpack(">III", d[at + 16 + 12 * i : at + 28 + 12 * i])
                for c in range(a, min(b, a + 0x10FFFF) + 1):
                    out[c] = g + c - a if fmt == 12 else g
        return out

    def advances(self) -> list[int]:
        """Advance widths by glyph, in font units."""
        if "hhea" not in self.tables or "hmtx" not in self.tables:
            return []
        off, _ = self.tables["hhea"]
        n = struct.unpack(">H", self.data[off + 34 : off + 36])[0]
        off, _ = self.tables["hmtx"]
        w = [struct.unpack(">H", self.data[off + 4 * i : off + 4 * i + 2])[0] for i in range(n)]
        return w + w[-1:] * max(0, self.glyphs - n)

    def names(self) -> dict[int, str]:
        """Glyph names of a post table: of format 1 the standard order, of format 2 by index into it or the table's own."""
        off, size = self.tables.get("post", (0, 0))
        d = self.data
        kind = struct.unpack(">I", d[off : off + 4])[0] if off else 0
        if kind == 0x10000:
            return dict(enumerate(standard_order()[: self.glyphs]))
        if kind != 0x20000:
            return {}
        n = struct.unpack(">H", d[off + 32 : off + 34])[0]
        index = struct.unpack(f">{n}H", d[off + 34 : off + 34 + 2 * n])
        strings, p = [], off + 34 + 2 * n
        while p < off + size:
            k = d[p]
            strings.append(d[p + 1 : p + 1 + k].decode("latin-1"))
            p += 1 + k
        all_names = (*standard_order(), *strings)
        return {g: all_names[i] for g, i in enumerate(index) if i < len(all_names)}


def is_unicode(platform: int, encoding: int) -> bool:
    return platform == 0 or platform == 3 and encoding in (1, 10)
