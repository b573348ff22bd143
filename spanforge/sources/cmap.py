"""Character maps of composite fonts and ToUnicode streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from .pdf_objects import END, Keyword, Lexer

#: a range that claims more codes than this is cut, so that a bad file can't fill the memory
MOST_CODES = 1 << 17


@dataclass
class CMap:
    """Code spaces (bytes, low, high), ranges to CIDs (low, high, first), and codes to text."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)
    cids: list[tuple[int, int, int]] = field(default_factory=list)
    text: dict[int, str] = field(default_factory=dict)


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def unit_text(b: bytes) -> str | None:
    """The text of a destination. A lone surrogate of one unit is none; other odd units are replaced."""
    if len(b) == 1:
        return chr(b[0])
    if len(b) == 2 and 0xD8 <= b[0] <= 0xDF:
        return None
    return b[: len(b) // 2 * 2].decode("utf-16-be", "replace")


def parse(data: bytes) -> CMap:
    out, lex, stack = CMap(), Lexer(data), []
    while True:
        t = lex.token()
        if t is END:
            return out
        if not isinstance(t, Keyword):
            stack.append(t)
            continue
        if t in ("[", "<<"):
            stack.append(lex.value(t, False))
            continue
        if t == "endcodespacerange":
            for lo, hi in zip(stack[::2], stack[1::2]):
                if isinstance(lo, bytes) and isinstance(hi, bytes):
                    out.spaces.append((len(hi), _number(lo), _number(hi)))
        elif t == "endcidrange":
            for lo, hi, cid in zip(stack[::3], stack[1::3], stack[2::3]):
                if isinstance(lo, bytes) and isinstance(hi, bytes) and isinstance(cid, int):
                    out.cids.append((_number(lo), _number(hi), cid))
        elif t == "endcidchar":
            for code, cid in zip(stack[::2], stack[1::2]):
                if isinstance(code, bytes) and isinstance(cid, int):
                    out.cids.append((_number(code), _number(code), cid))
        elif t == "endbfchar":
            for code, dst in zip(stack[::2], stack[1::2]):
                if isinstance(code, bytes) and isinstance(dst, bytes):
                    s = unit_text(dst)
                    if s is not None:
                        out.text[_number(code)] = s
        elif t == "endbfrange":
            for lo, hi, dst in zip(stack[::3], stack[1::3], stack[2::3]):
                if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                    continue
                a, b = _number(lo), _number(hi)
                if b - a > MOST_CODES:
                    raise ValueError(f"character map with a range of {b - a + 1} codes")
                if isinstance(dst, list):
                    for code, d in zip(range(a, b + 1), dst):
                        s = unit_text(d) if isinstance(d, bytes) else None
                        if s is not None:
                            out.text[code] = s
                elif isinstance(dst, bytes) and dst:
                    n, base = len(dst), _number(dst)
                    for code in range(a, b + 1):
                        try:
                            s = unit_text((base + code - a).to_bytes(n, "big"))
                        except OverflowError:
                            break
                        if s is not None:
                            out.text[code] = s
        stack = []
