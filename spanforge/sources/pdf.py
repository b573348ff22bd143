"""PDF bytes to DataFrames: glyphs, pages, fonts, character maps, embedded fonts, content and errors.

Parsing is a state machine over one opaque file, so it runs in Python over Arrow batches of files;
everything after the glyphs is DataFrame work. A file that can't be read never stops the others:
in PERMISSIVE mode its error is a row, in FAILFAST mode it is raised.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import cmap, truetype
from .crypt import WrongPassword
from .fonts import Options, make_font
from .interpreter import Interpreter, operations
from .pdf_objects import Document, PdfError, Ref, Stream

log = logging.getLogger("spanforge")
#: glyph rows in one Arrow batch
BATCH_GLYPHS = 65_536

GLYPHS = "doc string, page int, seq bigint, code int, code_len int, text string, x float, y float, width float, tfs float, font_name string, font_size float, error struct<kind:string,message:string>"
ERROR_TYPE = pa.struct([("kind", pa.string()), ("message", pa.string())])


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None, password: str | None = None) -> DataFrame:
    """Files as doc (the path), content and password; filters on path and length reach the scan."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("doc"), "content", F.lit(password).cast("string").alias("password"), "length", "modificationTime")


def _input(files: DataFrame, password: str | None) -> DataFrame:
    own = F.col("password").cast("string") if "password" in files.columns else F.lit(None).cast("string")
    return files.select(F.col("doc").cast("string").alias("doc"), F.col("content").cast("binary").alias("content"), F.coalesce(own, F.lit(password).cast("string")).alias("password"))


def kind_of(e: Exception) -> str:
    if isinstance(e, PdfError):
        return e.kind
    return "PdfError" if isinstance(e, WrongPassword) else "FormatError"


def _each(batches: Iterator[pa.RecordBatch], work: Callable, mode: str) -> Iterator[tuple[str, Any, Exception | None]]:
    for batch in batches:
        for doc, content, password in zip(*(batch.column(i) for i in range(3))):
            doc = doc.as_py()
            try:
                data = content.as_py()
                if data is None:
                    raise PdfError("no content", "IoError")
                yield doc, work(Document(data, password.as_py())), None
            except Exception as e:
                if mode == "FAILFAST":
                    raise
                log.debug("%s: %s", doc, e)
                yield doc, None, e


def _glyphs_of(options: Options, pages: tuple[int, ...] | None) -> Callable[[Document], Any]:
    def work(d: Document):
        it = Interpreter(d, options)
        for number, page in enumerate(d.pages(), 1):
            if pages is None or number in pages:
                it.page(number, page)
        return it.out

    return work


def glyphs(files: DataFrame, password: str | None = None, options: Options | None = None, pages: list[int] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """One row for each glyph shown, in order, or one with ``error`` for a file that can't be read.

    ``files`` needs doc and content, and may have a password for each row; ``pages`` restricts the
    pages interpreted. ``tfs`` is null where the transformed size is not a number. Pages whose content
    can't be decoded are left out. Null and empty content is an IoError.
    """
    spark = ship(files.sparkSession)
    work = _glyphs_of(options or Options(), tuple(pages) if pages is not None else None)

    def run(batches):
        for doc, g, e in _each(batches, work, mode):
            if e is not None:
                row = {"doc": [doc], "error": [{"kind": kind_of(e), "message": str(e)[:500]}]}
                yield _batch(row, 1)
                continue
            n = len(g.text)
            cat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
            page, code, code_len = cat(g.page, np.int32), cat(g.code, np.int32), cat(g.code_len, np.int32)
            x, y, width, tfs, size = (cat(p, np.float32) for p in (g.x, g.y, g.width, g.tfs, g.size))
            for a in range(0, n, BATCH_GLYPHS):
                s = slice(a, min(n, a + BATCH_GLYPHS))
                yield _batch({
                    "doc": [doc] * (s.stop - a), "page": page[s], "seq": np.arange(a, s.stop, dtype=np.int64), "code": code[s], "code_len": code_len[s], "text": g.text[s], "x": x[s], "y": y[s],
                    "width": width[s], "tfs": pa.array(tfs[s], pa.float32(), mask=np.isnan(tfs[s])), "font_name": g.font[s], "font_size": size[s],
                }, s.stop - a)

    kinds = {"doc": pa.string(), "page": pa.int32(), "seq": pa.int64(), "code": pa.int32(), "code_len": pa.int32(), "text": pa.string(), "x": pa.float32(), "y": pa.float32(), "width": pa.float32(), "tfs": pa.float32(), "font_name": pa.string(), "font_size": pa.float32(), "error": ERROR_TYPE}

    def _batch(cols: dict, n: int) -> pa.RecordBatch:
        return pa.record_batch([c if isinstance(c := cols.get(k), pa.Array) else pa.array(c, t) if c is not None else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

    del spark
    return _input(files, password).mapInArrow(run, GLYPHS)


def errors(glyph_rows: DataFrame) -> DataFrame:
    """Files that couldn't be read: doc, kind, message."""
    return glyph_rows.where(F.col("error").isNotNull()).select("doc", F.col("error.kind").alias("kind"), F.col("error.message").alias("message"))


def _rows(files: DataFrame, schema: str, work: Callable[[Document], list[tuple]], password: str | None, mode: str) -> DataFrame:
    """Rows ``work`` gives for each file, behind its doc; files that can't be read give none."""
    ship(files.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for doc, got, _ in _each(batches, work, mode):
            if got:
                cols = list(zip(*((doc, *r) for r in got)))
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, target)], schema=target)

    return _input(files, password).mapInArrow(run, schema)


def pages(files: DataFrame, password: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Pages in order, from 1, with their inherited media box and number of fonts."""

    def work(d: Document):
        out = []
        for i, p in enumerate(d.pages(), 1):
            box = [d.get(v) for v in d.inherited(p, "MediaBox") or []]
            box = [float(v) if type(v) in (int, float) else None for v in box[:4]]
            fonts = d.key(d.inherited(p, "Resources"), "Font")
            out.append((i, *(box + [None] * (4 - len(box))), len(fonts) if isinstance(fonts, dict) else 0))
        return out

    return _rows(files, "doc string, page int, llx float, lly float, urx float, ury float, fonts int", work, password, mode)


def _page_fonts(d: Document) -> dict[str, dict]:
    """Font dictionaries of all pages by resource name; the first of a name counts."""
    out: dict[str, dict] = {}
    for p in d.pages():
        fonts = d.key(d.inherited(p, "Resources"), "Font")
        for name, o in (fonts or {}).items() if isinstance(fonts, dict) else ():
            o = d.get(o)
            if isinstance(o, dict):
                out.setdefault(str(name), o)
    return out


FONTS = (
    "doc string, font_id string, subtype string, base_font string, encoding string, first_char int, widths map<int,float>, to_unicode map<int,string>, default_width float, "
    "cid_registry string, cid_ordering string, cid_to_gid string, embedded string, error string"
)


def fonts(files: DataFrame, password: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Fonts of each file with encoding, widths, ToUnicode and, for composite ones, CID system and map."""

    def work(d: Document):
        out = []
        for name, o in sorted(_page_fonts(d).items()):
            try:
                f = make_font(d, o, Options())
            except Exception as e:
                out.append((name, str(o.get("Subtype") or "") or None, str(o.get("BaseFont") or "") or None, None, None, None, None, None, None, None, None, None, str(e)))
                continue
            info, gid, embedded = {}, None, None
            kid = f.descendant or o
            if f.descendant:
                info = d.key(f.descendant, "CIDSystemInfo") or {}
                m = d.key(f.descendant, "CIDToGIDMap")
                gid = "stream" if isinstance(m, Stream) else str(m) if m is not None else None
            for k in ("FontFile", "FontFile2", "FontFile3"):
                if d.key(d.key(kid, "FontDescriptor"), k) is not None:
                    embedded = k
            text = lambda v: v.decode("latin-1") if isinstance(v, bytes) else None
            out.append((
                name, f.subtype, f.name, f.encoding, f.first_char, list(f.widths.items()), None if f.to_unicode is None else list(f.to_unicode.items()), f.default_width, text(info.get("Registry")), text(info.get("Ordering")), gid, embedded, None,
            ))
        return out

    return _rows(files, FONTS, work, password, mode)


def cmaps(font_rows: DataFrame) -> DataFrame:
    """ToUnicode entries of font rows: doc, font_id, code, text."""
    return font_rows.where(F.col("to_unicode").isNotNull()).select("doc", "font_id", F.explode("to_unicode").alias("code", "text"))


def embedded_fonts(files: DataFrame, password: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Embedded font files: doc, font_id, base_font, size, data."""

    def work(d: Document):
        out = []
        for name, o in sorted(_page_fonts(d).items()):
            kids = d.key(o, "DescendantFonts")
            kid = d.get(kids[0]) if isinstance(kids, list) and kids else o
            for k in ("FontFile", "FontFile2", "FontFile3"):
                s = d.key(d.key(kid, "FontDescriptor"), k)
                if isinstance(s, Stream):
                    data = d.contents(s)
                    out.append((name, str(o.get("BaseFont") or ""), k, len(data), data))
        return out

    return _rows(files, "doc string, font_id string, base_font string, kind string, size int, data binary", work, password, mode)


def font_glyphs(font_files: DataFrame) -> DataFrame:
    """Glyphs of TrueType files (doc, font_id, data): glyph, name, code point, advance of 1000; one row with an error for a file that can't be read."""
    ship(font_files.sparkSession)

    def run(batches):
        for batch in batches:
            for doc, fid, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    f = truetype.Font(data)
                    adv, names = f.advances(), f.names()
                    by = {g: c for _, _, m in f.subtables() for c, g in m.items()}
                except Exception as e:
                    one = {"doc": pa.array([doc], pa.string()), "font_id": pa.array([fid], pa.string()), "glyph": pa.nulls(1, pa.int32()), "name": pa.nulls(1, pa.string()), "code_point": pa.nulls(1, pa.int32()), "advance": pa.nulls(1, pa.float32())}
                    yield pa.record_batch(one | {"error": pa.array([f"{type(e).__name__}: {e}"], pa.string())})
                    continue
                gs = sorted(set(by) | set(names) | set(range(min(len(adv), f.glyphs))))
                n = len(gs)
                yield pa.record_batch({
                    "doc": pa.array([doc] * n, pa.string()), "font_id": pa.array([fid] * n, pa.string()), "glyph": pa.array(gs, pa.int32()), "name": pa.array([names.get(g) for g in gs], pa.string()),
                    "code_point": pa.array([by.get(g) for g in gs], pa.int32()), "advance": pa.array([adv[g] * 1000.0 / f.units if g < len(adv) else None for g in gs], pa.float32()), "error": pa.nulls(n, pa.string()),
                })

    return font_files.select("doc", "font_id", "data").mapInArrow(run, "doc string, font_id string, glyph int, name string, code_point int, advance float, error string")


def page_content(files: DataFrame, page: int | None = None, password: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Decoded content of pages by operation: doc, page, op_no, operator, operands."""

    def work(d: Document):
        out = []
        for i, p in enumerate(d.pages(), 1):
            if page is not None and i != page:
                continue
            try:
                for k, (op, args) in enumerate(operations(d.page_content(p))):
                    out.append((i, k, str(op), " ".join(_show(a) for a in args)))
            except PdfError:
                continue
        return out

    return _rows(files, "doc string, page int, op_no int, operator string, operands string", work, password, mode)


def _show(a: Any) -> str:
    if isinstance(a, bytes):
        return "(" + a.decode("latin-1") + ")"
    if isinstance(a, list):
        return "[" + " ".join(_show(x) for x in a) + "]"
    if isinstance(a, dict):
        return "<<" + " ".join(f"/{k} {_show(v)}" for k, v in a.items()) + ">>"
    return f"{a:g}" if isinstance(a, float) else str(a)


__all__ = ["Options", "Ref", "cmap", "cmaps", "embedded_fonts", "errors", "font_glyphs", "fonts", "glyphs", "page_content", "pages", "read_files"]
