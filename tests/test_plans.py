import io
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pdf_writer import assemble, encrypted, lines_content, pages
from pyspark.sql import functions as F

from spanforge import ExtractionError, PdfExtractor, from_bytes, from_path, from_reader, register_views
from spanforge.operators import lines as L
from spanforge.operators import lookups, patterns, render
from spanforge.operators import spans as S
from spanforge.plans.text import extract
from spanforge.sources import pdf
from spanforge.streaming.ingest import ingest, stream_files, text_sink

G = "doc string, page int, seq bigint, text string, x float, y float, width float, tfs float, font_name string, font_size float"
f32 = np.float32
WHITE = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def model(rows):
    """Spans one glyph after another: what the windows must give."""
    out, buf = [], None
    for page in sorted({r[1] for r in rows}):
        last = None
        buf = None

        def flush():
            if buf and buf["text"]:
                x0, x1 = buf["x"], buf["end"]
                out.append((page, buf["text"], None if np.isnan(buf["tfs"]) else float(f32(buf["y"] + buf["tfs"])), float(max(x0, x1)) if not np.isnan(x1) else float(x0), float(buf["y"]), float(min(x0, x1)) if not np.isnan(x1) else float(x0), buf["font"]))

        for _, _, _, ch, x, y, w, t, font, size in sorted((r for r in rows if r[1] == page), key=lambda r: r[2]):
            x, y, w, t = f32(x), f32(y), f32(w), f32("nan") if t is None else f32(t)
            ch = " " if ch == "\t" else ch
            new = buf is None or buf["text"] == ""
            if not new:
                if buf["end"] == last[0] and abs(y - last[1]) < t * f32(0.5):
                    buf["end"] = x
                gap = x - buf["end"]
                with np.errstate(all="ignore"):
                    ratio = gap / t
                dy = abs(y - last[1])
                if font != buf["font"] or size != buf["size"] or dy > t * f32(1.5) or (x < buf["end"] and dy > t * f32(0.5)) or abs(ratio) > f32(1.2):
                    flush()
                    new = True
                else:
                    if ratio > f32(0.15) and buf["text"][-1] not in WHITE:
                        buf["text"] += " "
                    buf["text"] += ch
            if new:
                buf = {"text": ch, "x": x, "y": y, "tfs": t, "font": font, "size": size}
            buf["end"] = x + w * t
            last = (x, y)
        flush()
    return out


glyph = st.tuples(st.sampled_from(["a", "b", " ", "", "fi", "\t", " "]), st.sampled_from([0.0, 1.25, 1.5, 1.75, 2.0, 5.0, 12.0, 12.5, -3.0, -30.0]), st.sampled_from([0.0, 0.0, 0.0, 4.0, 5.0, 5.5, 15.0, 16.0]), st.sampled_from([0.0, 0.5, 0.5, 0.5]), st.sampled_from([10.0, 10.0, 10.0, None, 8.0]), st.sampled_from(["F", "F", "F", "G"]))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(glyph, min_size=1, max_size=25), min_size=10, max_size=25))
def test_windows_equal_the_model(spark, docs):
    rows = []
    for d, gs in enumerate(docs):
        x = 72.0
        for i, (ch, gap, dy, w, t, font) in enumerate(gs):
            x += gap
            rows.append((f"d{d}", 1 + i // 15, i, ch, x, 100.0 + dy, w, t, font, 10.0))
            x += w * (t or 10.0)
    got = S.spans(spark.createDataFrame(rows, G)).collect()
    for d in range(len(docs)):
        want = model([r for r in rows if r[0] == f"d{d}"])
        have = [(r.page_num, r.text, r.bbox.t, r.bbox.r, r.bbox.b, r.bbox.l, r.font_name) for r in sorted((r for r in got if r.doc == f"d{d}"), key=lambda r: (r.page_num, r.span_seq))]
        assert have == want


def span_rows(spark, rows):
    """(doc, page, seq, text, t, r, b, l)"""
    df = spark.createDataFrame(rows, "doc string, page_num int, span_seq bigint, text string, t float, r float, b float, l float")
    return df.select("doc", "page_num", "span_seq", "text", F.struct("t", "r", "b", "l").alias("bbox"), F.lit("F").alias("font_name"), F.lit(10.0).cast("float").alias("font_size"))


def test_lines_gaps_and_pages(spark):
    rows = [("a", 1, 0, "one", 20, 30, 10, 10), ("a", 1, 1, "same", 25, 60, 15, 40), ("a", 1, 2, "24", 49, 30, 39, 10), ("a", 1, 3, "far", 73.25, 30, 63.25, 10), ("a", 3, 0, "next", 20, 30, 10, 10), ("b", 1, 0, "left", 20, 90, 10, 50), ("b", 1, 1, "right", 20, 40, 10, 10)]
    got = {(r.doc, r.line_no): [s.text for s in r.spans] for r in L.lines(span_rows(spark, [tuple([*r[:4], *map(float, r[4:])]) for r in rows])).collect()}
    assert got == {("a", 0): ["one", "same"], ("a", 1): ["24"], ("a", 2): [], ("a", 3): ["far"], ("a", 4): [], ("a", 5): ["next"], ("b", 0): ["right", "left"]}
    empty = span_rows(spark, [("x", 1, 0, "y", 1.0, 1.0, 1.0, 1.0)]).limit(0)
    assert L.lines(empty).count() == 0


def test_right_columns_and_pretty(spark):
    rows = [("a", 1, i, "9" * n, 20.0 + 12 * i, 300.0, 10.0 + 12 * i, 300.0 - 30 * n) for i, n in enumerate((1, 2, 4))] + [("a", 1, 9, "name", 20.0, 60.0, 10.0, 20.0)]
    ln = L.lines(span_rows(spark, rows))
    assert [r.positions for r in render.right_columns(ln).collect()] == [[300.0]]
    text = {r.line_no: r.text for r in render.pretty(ln).collect()}
    assert text[0] == " " * 5 + "name" + " " * 65 + "9" and text[2] == " " * 71 + "9999"
    near = [("b", 1, i, "x", 20.0 + 12 * i, r, 10.0 + 12 * i, r - 60 * i - 5) for i, r in enumerate((199.0, 199.0, 199.0))]
    assert render.right_columns(L.lines(span_rows(spark, near))).first().positions == []


def test_overlap_gets_one_blank_and_debug(spark):
    ln = L.lines(span_rows(spark, [("a", 1, 0, "long text", 20.0, 60.0, 10.0, 8.0), ("a", 1, 1, 'x"y', 20.0, 30.25, 10.0, 12.0)]))
    assert render.pretty_lines(ln).first().text == '  long text x"y'
    assert render.debug_lines(ln).first().text.endswith('  Span 1: "x\\"y"\n    BBox: (t: 20.0, r: 30.2, b: 10.0, l: 12.0)\n    Font size: 10.0')
    v = spark.createDataFrame([(0.25,), (0.35,), (-0.04,), (1.05,)], "x float").select(render.one_decimal(F.col("x")).alias("s")).collect()
    assert [r.s for r in v] == ["%.1f" % float(f32(x)) for x in (0.25, 0.35, -0.04, 1.05)]


def test_patterns(spark):
    s = span_rows(spark, [("a", 1, i, t, float(top), 10.0, 0.0, float(left)) for i, (t, top, left) in enumerate([("p", 5, 2), ("q", 15, 1), ("r", 25, 3), ("s", 24, 1), ("t", 50, 450)])])
    assert {(r.band, r.row) for r in patterns.bands(s).collect()} == {(0, "p"), (20, "q | s | r"), (50, "t")}
    assert [r.text for r in patterns.region(s).collect()] == ["t"]
    assert patterns.by_font(s, "f").count() == 5 and patterns.font_counts(s).first().spans == 5
    twice = s.withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")).union(s.limit(1).withColumn("text", F.lit("new")).withColumn("loaded_at", F.lit("2024-02-01").cast("timestamp")))
    got = patterns.current_spans(twice)
    assert got.count() == 5 and got.where("span_seq = 0").first().text == "new"


def test_nearest_width_and_lookups(spark):
    wanted = spark.createDataFrame([("a", 505.0), ("b", 300.0)], "key string, width double")
    offered = spark.createDataFrame([(510, "w", 0), (500, "v", 1), (500, "7", 2)], "width int, char string, ord int")
    assert [(r.key, r.char) for r in lookups.nearest_width(wanted, offered).collect()] == [("a", "w")]
    codes = spark.createDataFrame([(1, "WinAnsiEncoding", 128), (2, "WinAnsiEncoding", 1)], "k int, encoding string, code int")
    assert [(r.k, r.text) for r in lookups.decode_codes(codes, spark).collect()] == [(1, "€")]
    assert lookups.names(spark).count() > 1500 and lookups.core_metrics(spark).select("font").distinct().count() == 14


def files(spark, rows):
    return spark.createDataFrame([(d, bytearray(c) if c is not None else None, p) for d, c, p in rows], "doc string, content binary, password string")


def test_extract_many_with_errors(spark):
    c = lines_content(["Hello  world", "", "Zweite Zeile"])
    f = files(spark, [("good", assemble(pages([c])), None), ("locked", encrypted(c, b"pw"), "pw"), ("wrong", encrypted(c, b"pw"), "x"), ("null", None, None), ("empty", b"", None), ("junk", b"not a pdf", None), ("blank", assemble(pages([b""])), None)])
    e = extract(f.withColumn("page", F.lit(1)))  # a column of a clashing name does no harm
    got = {r.doc: (r.plain, r.error.kind if r.error else None) for r in e.output.collect()}
    assert got == {"good": ("Hello  world\nZweite Zeile\n", None), "locked": ("Hello  world\nZweite Zeile\n", None), "wrong": (None, "PdfError"), "null": (None, "IoError"), "empty": (None, "IoError"), "junk": (None, "PdfError")}
    with pytest.raises(Exception, match="header|content|password|empty"):
        extract(f, mode="FAILFAST").glyphs.count()
    assert extract(f.limit(0)).plain.count() == 0
    assert extract(f.where("doc = 'good'"), pages=[2]).glyphs.count() == 0


def test_views_pages_fonts_and_content(spark):
    data = assemble(pages([lines_content(["a"]), lines_content(["b"])]))
    f = files(spark, [("x", data, None)])
    register_views(f)
    assert spark.sql("SELECT count(*) AS n FROM pdf_spans").first().n == 2
    assert [(r.page, r.urx, r.fonts) for r in pdf.pages(f).orderBy("page").collect()] == [(1, 612.0, 1), (2, 612.0, 1)]
    r = pdf.fonts(f).first()
    assert (r.font_id, r.subtype, r.base_font, r.encoding, r.error) == ("F1", "Type1", "Courier", "WinAnsiEncoding", None)
    assert pdf.page_content(f, 2).where("operator = 'Tj'").first().operands == "(b)"
    assert pdf.embedded_fonts(f).count() == 0 and pdf.cmaps(pdf.fonts(f)).count() == 0


def test_one_document_calls(spark, tmp_path):
    data = assemble(pages([lines_content(["Hello", "World"])]))
    p = tmp_path / "a.pdf"
    p.write_bytes(data)
    out = from_path(str(p))
    assert str(out) == "Hello\nWorld\n" == out.to_string() and f"{out:#}" == out.to_string_pretty() == " " * 18 + "Hello\n" + " " * 18 + "World\n"
    s = out.lines[0][0]
    assert (s.text, s.page, s.font_name, str(s.bbox)) == ("Hello", 1, "Courier", "(82.0, 102.0, 72.0, 72.0)")
    assert str(from_reader(io.BytesIO(data))) == str(from_bytes(data)) and "Span 0" in out.to_string_debug()
    with pytest.raises(ExtractionError):
        from_bytes(encrypted(lines_content(["x"]), b"pw"), password="no")
    assert str(PdfExtractor.builder().password("pw").build().from_bytes(encrypted(lines_content(["x"]), b"pw"))) == "x\n"
    with pytest.raises(ExtractionError, match="IoError"):
        from_path(str(tmp_path / "missing.pdf"))


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.pdf").write_bytes(assemble(pages([lines_content([f"file {i}"])])))
    (src / "bad.pdf").write_bytes(b"no")
    ingest(stream_files(spark, str(src), "*.pdf", 2), str(tmp_path / "cp"), text_sink(str(tmp_path / "out"))).awaitTermination(120)
    got = {(r.doc, r.plain) for r in spark.read.parquet(str(tmp_path / "out/plain")).collect()}
    batch = extract(pdf.read_files(spark, str(src), "*.pdf"))
    assert got == {(r.doc, r.plain) for r in batch.plain.collect()} and len(got) == 3
    assert spark.read.parquet(str(tmp_path / "out/errors")).count() == 1


def test_command_line(tmp_path):
    p = tmp_path / "a.pdf"
    p.write_bytes(assemble(pages([lines_content(["Hi"])])))
    import os

    run = lambda *a: subprocess.run([sys.executable, "-m", "spanforge", *a], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert run(str(p)).stdout.endswith("Hi\n")
    bad = run(str(tmp_path / "none.pdf"))
    assert bad.returncode == 1 and "Error extracting" in bad.stderr


def grid_model(doc):
    """A document's lines of (text, l, r) laid out one span after another, clusters by full recomputation."""
    clusters = []
    for line in doc:
        for _, left, right in line:
            if left is None or right is None:
                continue
            best = None
            for c in clusters:
                total = f32(0)
                for _, r in c:
                    total += r
                d = abs(f32(right) - total / f32(len(c)))
                if d < 8.0 and (best is None or d < best[0]):
                    best = (d, c)
            (best[1] if best else clusters.append([]) or clusters[-1]).append((f32(left), f32(right)))
    places = []
    for c in clusters:
        mean = sum((r for _, r in c), f32(0)) / f32(len(c))
        wide, tall = max(a for a, _ in c) - min(a for a, _ in c), max(b for _, b in c) - min(b for _, b in c)
        if len(c) >= 3 and wide >= (5 if mean >= 450 else 50) and tall < f32(3.7) and mean >= 200:
            places.append(mean)
    col = lambda x: max(0, int(np.floor(float(x) / 4 + 0.5)))
    out = []
    for line in doc:
        row, cur = "", 0
        for text, left, right in line:
            at = next((p for p in places if abs(f32(right) - p) < 16), None)
            start = col(left) if at is None else max(0, col(at) - len(text))
            pad = start - cur if start > cur else int(cur > 0)
            row, cur = row + " " * pad + text, cur + pad + len(text)
        out.append(row)
    return out


def test_pretty_equals_the_model(spark):
    import random

    rng = random.Random(3)
    docs = {}
    for d in range(12):
        edges = [rng.choice((150.0, 230.0, 300.0, 452.0, 500.0)) for _ in range(3)]
        docs[f"d{d}"] = [[("w" * rng.randrange(1, 9), e - rng.choice((20.0, 40.0, 90.0, 6.25)), e + rng.choice((0.0, 0.0, 1.5, 3.5, 9.0))) for e in edges[: rng.randrange(0, 4)]] for _ in range(rng.randrange(1, 25))]
    rows = [(d, i, [(t, (0.0, r, 0.0, left), "F", 10.0, 1) for t, left, r in line]) for d, ls in docs.items() for i, line in enumerate(ls)]
    df = spark.createDataFrame(rows, "doc string, line_no int, spans array<struct<text string, bbox struct<t float, r float, b float, l float>, font_name string, font_size float, page_num int>>")
    got: dict = {}
    for r in render.pretty(df).collect():
        got.setdefault(r.doc, {})[r.line_no] = r.text
    for d, ls in docs.items():
        assert [got[d][i] for i in range(len(ls))] == grid_model(ls)


@pytest.mark.parametrize("most", [50_000, -1])
def test_repeated_files_count_once(spark, most, monkeypatch):
    from spanforge.plans import text

    monkeypatch.setattr(text, "MOST_REPEATED", most)
    rows = [("a", bytearray(b"1"), "x"), ("b", bytearray(b"2"), None), ("a", bytearray(b"1"), "x"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc string, content binary, n string")
    got = text.distinct_files(df).collect()
    assert sorted(str(r.doc) for r in got) == ["None", "a", "b"] and text.distinct_files(df.limit(0)).count() == 0
