"""Glyphs to spans: sessions of glyphs, found with windows over (doc, page).

A glyph opens a new span if font or size changes, the baseline moves by more than 1.5 of the
size, the pen goes back by more than half a size of baseline, or the gap exceeds 1.2 sizes. A gap of
more than 0.15 sizes puts a blank unless one stands there. All comparisons look back one glyph, so
one shuffle on (doc, page) serves every step. Sizes that are not a number are null, and a null
comparison breaks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = "\\p{IsWhite_Space}$"


def _f(v: float) -> Column:
    return F.lit(v).cast("float")


def glyph_flags(glyphs: DataFrame) -> DataFrame:
    """Glyphs with ``end``, the repaired end of the one before, ``ratio`` of the gap, and ``breaks``."""
    w = Window.partitionBy("doc", "page").orderBy("seq")
    g = glyphs.where(F.col("page").isNotNull())
    g = g.withColumn("text", F.when(F.col("text") == "\t", " ").otherwise(F.col("text"))).withColumn("end", F.col("x") + F.col("width") * F.col("tfs"))
    lag = {c: F.lag(c).over(w) for c in ("end", "x", "y", "font_name", "font_size")}
    dy = F.abs(F.col("y") - lag["y"])
    g = g.withColumn("_dy", dy).withColumn("_first", F.row_number().over(w) == 1)
    g = g.withColumn("prev_end", F.when((lag["end"] == lag["x"]) & (dy < F.col("tfs") * _f(0.5)), F.col("x")).otherwise(lag["end"]))
    g = g.withColumn("_other", ~(lag["font_name"].eqNullSafe(F.col("font_name"))) | (lag["font_size"] != F.col("font_size")))
    gap = F.col("x") - F.col("prev_end")
    zero = F.when(gap > 0, _f(float("inf"))).when(gap < 0, _f(float("-inf")))
    g = g.withColumn("ratio", F.when(F.col("tfs") == 0, zero).otherwise((gap / F.nullif(F.col("tfs"), _f(0.0))).cast("float")))
    moved = F.col("_dy") > F.col("tfs") * _f(1.5)
    back = (F.col("x") < F.col("prev_end")) & (F.col("_dy") > F.col("tfs") * _f(0.5))
    far = F.abs("ratio") > _f(1.2)
    ev = lambda c: F.coalesce(c, F.lit(False))
    g = g.withColumn("font_break", ev(F.col("_other")) & ~F.col("_first")).withColumn("line_break", ev(moved) & ~F.col("_first"))
    g = g.withColumn("back_break", ev(back) & ~F.col("_first")).withColumn("gap_break", ev(far) & ~F.col("_first"))
    return g.withColumn("breaks", F.col("_first") | F.col("font_break") | F.col("line_break") | F.col("back_break") | F.col("gap_break"))


def glyph_segments(glyphs: DataFrame) -> DataFrame:
    """Flagged glyphs with their segment, the piece of text each adds, and the edge it would leave.

    Every window has the same partition and order, so the glyphs are sorted once: counts within a
    segment are running counts less their value where the segment began, and whether the text ends
    in white space follows from the last glyph with text and the last blank put before an empty one.
    """
    w = Window.partitionBy("doc", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    o = Window.partitionBy("doc", "page").orderBy("seq")
    full = F.col("text") != ""
    wide = F.coalesce(F.col("ratio") > _f(0.15), F.lit(False))
    near = F.abs(F.lead("y").over(o) - F.col("y")) < F.lead("tfs").over(o) * _f(0.5)
    g = glyph_flags(glyphs).withColumn("_full", full.cast("int"))
    g = (
        g.withColumn("segment", F.sum(F.col("breaks").cast("int")).over(w)).withColumn("_n", F.sum("_full").over(w))
        .withColumn("_text_at", F.last(F.when(full, F.col("seq")), True).over(w)).withColumn("_ends_white", F.last(F.when(full, F.col("text").rlike(WHITE)), True).over(w))
        .withColumn("_blank_at", F.last(F.when(~full & wide, F.col("seq")), True).over(w))
        .withColumn("edge", F.when((F.col("end") == F.col("x")) & F.coalesce(near, F.lit(False)), F.lead("x").over(o)).otherwise(F.col("end")))
    )
    g = g.withColumn("_white", F.col("_ends_white") | F.coalesce(F.col("_blank_at") > F.col("_text_at"), F.lit(False)))
    g = g.withColumn("_ne", F.col("_n") - F.last(F.when(F.col("breaks"), F.col("_n") - F.col("_full")), True).over(w)).withColumn("_was_white", F.lag("_white").over(o))
    first = (F.col("_ne") == 1) & full
    g = g.where(F.col("_ne") > 0)  # what is empty at the start of a span leaves no trace
    return g.withColumn("space", wide & ~first & ~F.coalesce("_was_white", F.lit(True))).withColumn("piece", F.concat(F.when(F.col("space"), " ").otherwise(""), F.col("text")))


def spans(glyphs: DataFrame) -> DataFrame:
    """doc, page_num, span_seq, text, bbox (t, r, b, l), font_name, font_size.

    ``glyphs`` needs doc, page, seq (unique in a page), text, x, y, width, tfs, font_name and
    font_size; rows without a page (errors) are left out, extra columns ignored, repeated rows of a
    glyph count as glyphs of their own. Pages without text give no spans.
    """
    g = glyph_segments(glyphs.select("doc", "page", "seq", "text", "x", "y", "width", "tfs", "font_name", "font_size"))
    first = F.min_by(F.struct("x", "y", "tfs", "font_name", "font_size"), "seq")
    s = g.groupBy("doc", "page", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"]), "").alias("text"), first.alias("_a"), F.max_by("edge", "seq").alias("_end")
    )
    box = F.struct(
        (F.col("_a.y") + F.col("_a.tfs")).alias("t"), F.greatest("_a.x", "_end").alias("r"), F.col("_a.y").alias("b"), F.least("_a.x", "_end").alias("l")
    )
    seq = F.row_number().over(Window.partitionBy("doc", "page").orderBy("segment")) - 1
    return s.select("doc", F.col("page").alias("page_num"), seq.cast("bigint").alias("span_seq"), "text", box.alias("bbox"), F.col("_a.font_name").alias("font_name"), F.col("_a.font_size").alias("font_size"))
