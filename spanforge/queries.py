"""Queries of the extraction operators, by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lines as L
from .operators import lookups, patterns, render
from .operators import spans as S
from .plans import layout, roundtrip, text
from .ship import ship
from .sources import pdf

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def d3(c: Column) -> Column:
    return F.round(c.cast("double"), 3)


def _box(b: str = "bbox") -> list[Column]:
    return [d3(F.col(f"{b}.{k}")).alias(k) for k in "trbl"]


def _layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.glyphs(layout.line_texts(_t(spark, d, "text_lines")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(S.spans(_layout(spark, d)))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return text.distinct_files(_t(spark, d, "pdf_files"))


def _given_spans(spark: SparkSession, d: str) -> DataFrame:
    return patterns.current_spans(_t(spark, d, "text_spans"))


def glyphs_layout(spark: SparkSession, d: str) -> DataFrame:
    g = _layout(spark, d)
    return g.select("doc", "page", "seq", "text", d3(F.col("x")).alias("x"), d3(F.col("y")).alias("y"), d3(F.col("width")).alias("width"), d3(F.col("tfs")).alias("tfs"), "font_name")


def tab_normalize(spark: SparkSession, d: str) -> DataFrame:
    tabs = _layout(spark, d).where(F.col("text") == "\t").select("doc", "page", "seq")
    return S.glyph_flags(_layout(spark, d)).join(tabs, ["doc", "page", "seq"]).groupBy("text").agg(F.count("*").alias("glyphs"))


def span_breaks(spark: SparkSession, d: str) -> DataFrame:
    return S.glyph_flags(_layout(spark, d)).where("breaks").select("doc", "page", "seq", "font_break", "line_break", "back_break", "gap_break")


def zero_width_repair(spark: SparkSession, d: str) -> DataFrame:
    g = S.glyph_flags(_layout(spark, d)).where("prev_end is not null and prev_end = x")
    return g.select("doc", "page", "seq", d3(F.col("prev_end")).alias("prev_end"))


def space_insertion(spark: SparkSession, d: str) -> DataFrame:
    return S.glyph_segments(_layout(spark, d)).where("space").select("doc", "page", "seq", d3(F.col("ratio")).alias("ratio"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return S.spans(_layout(spark, d)).select("doc", "page_num", "span_seq", "text", *_box(), "font_name", d3(F.col("font_size")).alias("font_size"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc", "line_no", F.size("spans").alias("n_spans"))


def blank_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(F.size("spans") == 0).select("doc", "line_no")


def page_separators(spark: SparkSession, d: str) -> DataFrame:
    """Blank lines by document, and how many of them stand between pages."""
    ln = _lines(spark, d)
    pages = ln.select("doc", F.explode("spans.page_num").alias("p")).groupBy("doc").agg((F.countDistinct("p") - 1).alias("separators"))
    blank = ln.groupBy("doc").agg(F.sum((F.size("spans") == 0).cast("bigint")).alias("blank"))
    return pages.join(blank, "doc")


def nested_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc", "line_no", F.posexplode("spans").alias("pos", "s")).select("doc", "line_no", "pos", F.col("s.text").alias("text"), F.col("s.page_num").alias("page_num"), d3(F.col("s.bbox.l")).alias("l"))


def plain_text(spark: SparkSession, d: str) -> DataFrame:
    return render.documents(render.plain_lines(_lines(spark, d)), "plain")


def pretty_text_left(spark: SparkSession, d: str) -> DataFrame:
    return render.pretty_lines(_lines(spark, d))


def right_aligned_columns(spark: SparkSession, d: str) -> DataFrame:
    """The right-aligned columns of each document, by the number of the column."""
    found = render.right_columns(_t(spark, d, "text_lines").dropDuplicates(["doc", "line_no"]))
    return found.select("doc", F.posexplode("positions").alias("n", "position")).select("doc", "n", d3(F.col("position")).alias("position"))


def pretty_text_full(spark: SparkSession, d: str) -> DataFrame:
    return render.documents(render.pretty(_t(spark, d, "text_lines").dropDuplicates(["doc", "line_no"])), "pretty")


def debug_dump(spark: SparkSession, d: str) -> DataFrame:
    return render.debug_lines(_lines(spark, d))


def given_plain_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.plain_lines(_t(spark, d, "text_lines").dropDuplicates(["doc", "line_no"]))


def given_pretty_left(spark: SparkSession, d: str) -> DataFrame:
    return render.pretty_lines(_t(spark, d, "text_lines").dropDuplicates(["doc", "line_no"]))


def given_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines assembled again from the spans given."""
    return L.numbered_spans(_given_spans(spark, d)).select("doc", "page_num", "span_seq", "line_no", "blank_before")


def current_spans(spark: SparkSession, d: str) -> DataFrame:
    return _given_spans(spark, d).select("doc", "page_num", "span_seq", "text", "font_name", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"))


def bbox_corners(spark: SparkSession, d: str) -> DataFrame:
    c = patterns.corners(_given_spans(spark, d))
    return c.select("doc", "page_num", "span_seq", *[d3(F.col(f"{p}.{a}")).alias(f"{p}_{a}") for p in ("top_left", "top_right", "bottom_left", "bottom_right") for a in "xy"])


def grid_columns(spark: SparkSession, d: str) -> DataFrame:
    return render.grid(_given_spans(spark, d).where("text is not null")).select("doc", "page_num", "span_seq", "start_col", "end_col", "grid_width")


def font_filter(spark: SparkSession, d: str) -> DataFrame:
    return patterns.by_font(_given_spans(spark, d), "Serif").select("doc", "page_num", "span_seq", "font_name")


def font_counts(spark: SparkSession, d: str) -> DataFrame:
    return patterns.font_counts(_given_spans(spark, d)).orderBy("font_name")


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    return patterns.first_lines(given_plain_lines(spark, d))


def region_filter(spark: SparkSession, d: str) -> DataFrame:
    return patterns.region(_given_spans(spark, d), 100.0, 60.0).select("doc", "page_num", "span_seq", "text")


def band_rows(spark: SparkSession, d: str) -> DataFrame:
    return patterns.bands(_given_spans(spark, d))


def encoding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the fonts' widths in the encoding each font names, with their characters."""
    f = _t(spark, d, "fonts").dropDuplicates(["doc", "font_id"])
    codes = f.where("widths is not null and encoding is not null").select("doc", "font_id", "encoding", F.explode(F.map_keys("widths")).alias("code"))
    return lookups.decode_codes(codes, spark).select("doc", "font_id", "code", "text")


def glyph_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs of all standard fonts with their characters, by joining names; dingbats by their codes."""
    m = lookups.core_metrics(ship(spark)).withColumnRenamed("glyph", "name")
    named = m.where("font <> 'ZapfDingbats'").drop("code_point").join(lookups.names(spark), "name")
    return named.unionByName(m.where("font = 'ZapfDingbats'")).select("font", "name", "code_point", d3(F.col("width")).alias("width"))


def width_rows(spark: SparkSession, d: str) -> DataFrame:
    w = lookups.width_rows(_t(spark, d, "fonts").dropDuplicates(["doc", "font_id"]))
    return w.select("doc", "font_id", "code", d3(F.col("width")).alias("width"))


def unicode_rows(spark: SparkSession, d: str) -> DataFrame:
    f = _t(spark, d, "fonts").dropDuplicates(["doc", "font_id"])
    return pdf.cmaps(f)


def nearest_width_match(spark: SparkSession, d: str) -> DataFrame:
    """For every width of the fonts given, the character of nearest width among all glyphs of a standard font."""
    wanted = width_rows(spark, d).select("width").distinct().select(F.col("width").alias("key"), "width")
    m = lookups.core_metrics(spark).where("font = 'Helvetica'").select(F.col("width").cast("int").alias("width"), lookups.char_of(F.col("code_point")).alias("char"), F.col("code_point").alias("ord"))
    return lookups.nearest_width(wanted, m).select("width", "char", "matched_width")


def cid_gid_unicode(spark: SparkSession, d: str) -> DataFrame:
    """CID to glyph to character, with the fonts' codes as CIDs shifted by one glyph."""
    f = _t(spark, d, "fonts").dropDuplicates(["doc", "font_id"]).withColumn("font", F.concat_ws("/", "doc", "font_id"))
    gids = f.where("widths is not null").select("font", F.explode(F.map_keys("widths")).alias("cid")).withColumn("gid", F.col("cid") - 32)
    chars = f.where("to_unicode is not null").select("font", F.explode("to_unicode").alias("code", "ch")).select("font", (F.col("code") - 32).alias("gid"), F.ascii("ch").alias("code_point"))
    return lookups.cid_text(gids, chars).select("font", "cid", "gid", "text")


def pdf_plain(spark: SparkSession, d: str) -> DataFrame:
    return text.extract(_files(spark, d)).plain


def pdf_spans(spark: SparkSession, d: str) -> DataFrame:
    s = text.extract(_files(spark, d)).spans
    return s.select("doc", "page_num", "span_seq", "text", *_box(), "font_name", d3(F.col("font_size")).alias("font_size"))


def pdf_glyphs(spark: SparkSession, d: str) -> DataFrame:
    g = text.extract(_files(spark, d)).glyphs.where("page is not null")
    return g.select("doc", "page", "seq", "code", "text", d3(F.col("x")).alias("x"), d3(F.col("y")).alias("y"))


def pdf_pretty(spark: SparkSession, d: str) -> DataFrame:
    return text.extract(_files(spark, d)).pretty


def pdf_output(spark: SparkSession, d: str) -> DataFrame:
    o = text.extract(_files(spark, d)).output
    return o.select("doc", F.size("lines").alias("lines"), "plain", "pretty", F.col("error.kind").alias("error"))


def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    p = pdf.pages(_files(spark, d))
    return p.select("doc", "page", *[d3(F.col(c)).alias(c) for c in ("llx", "lly", "urx", "ury")], "fonts")


def pages_count(spark: SparkSession, d: str) -> DataFrame:
    return pdf.pages(_files(spark, d)).groupBy("doc").agg(F.count("*").alias("pages"))


def pdf_fonts(spark: SparkSession, d: str) -> DataFrame:
    return pdf.fonts(_files(spark, d)).select("doc", "font_id", "subtype", "base_font", "encoding", "error")


def pdf_content(spark: SparkSession, d: str) -> DataFrame:
    """All operations of all pages."""
    return pdf.page_content(_files(spark, d))


def _roundtrip(spark: SparkSession, d: str, feature: str) -> DataFrame:
    s = text.extract(roundtrip.files(layout.line_texts(_t(spark, d, "text_lines")), feature)).spans
    return s.select("doc", "page_num", "text", *_box(), "font_name")


def pdf_roundtrip_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the given lines after they were written as PDF files and read back."""
    return _roundtrip(spark, d, "")


def pdf_text_moves(spark: SparkSession, d: str) -> DataFrame:
    """The same with lines placed by Td, TD, TL and T*."""
    return _roundtrip(spark, d, "moves")


def pdf_text_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The same with each line shown by TJ in parts."""
    return _roundtrip(spark, d, "arrays")


def pdf_graphics_state(spark: SparkSession, d: str) -> DataFrame:
    """The same with lines placed by cm between q and Q, with a rise, spacings, a scale and marked content."""
    return _roundtrip(spark, d, "states")


def pdf_form_xobject(spark: SparkSession, d: str) -> DataFrame:
    """The same with the lines of each page in a form, half of them with resources of their own."""
    return _roundtrip(spark, d, "forms")


def pdf_filters(spark: SparkSession, d: str) -> DataFrame:
    """The same with content under LZW, hexadecimal, base 85 over Flate, Flate with PNG predictors, and none."""
    return _roundtrip(spark, d, "filters")


def pdf_cid_widths(spark: SparkSession, d: str) -> DataFrame:
    """The same with composite fonts that give widths by W arrays, horizontal and vertical."""
    return _roundtrip(spark, d, "widths")


def pdf_encrypted_rc4(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, "rc4")


def pdf_encrypted_aes(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, "aes")


def pdf_roundtrip_plain(spark: SparkSession, d: str) -> DataFrame:
    return text.extract(roundtrip.files(layout.line_texts(_t(spark, d, "text_lines")))).plain


def error_rows(spark: SparkSession, d: str) -> DataFrame:
    return text.extract(_files(spark, d)).errors.groupBy("kind").agg(F.count("*").alias("files"))


NOT_QUERIES = {"queries", "d3", "ship"}


def queries() -> dict[str, Query]:
    here = globals()
    own = [n for n, f in here.items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in NOT_QUERIES]
    return {n: here[n] for n in own}
