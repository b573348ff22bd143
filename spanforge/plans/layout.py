"""Text laid out as glyphs without a PDF: a fixed grid with known irregularities.

Lines of text become glyphs of a fixed-pitch font, 6 points wide and 12 apart, 54 lines a page.
Every so often a font changes, a gap opens, a glyph has no width, a letter is raised or a blank is a
tab, all by plain arithmetic on line and column, so the expected spans follow from the text alone.
All coordinates are exact in single precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, MARGIN, CELL, PITCH, SIZE = 54, 72.0, 6.0, 12.0, 10.0


def line_texts(text_lines: DataFrame) -> DataFrame:
    """doc, line_no, text of the given lines; repeated rows count once."""
    text = F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return text_lines.select("doc", "line_no", F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["doc", "line_no"])


def glyphs(lines: DataFrame) -> DataFrame:
    """Glyph rows of lines (doc, line_no, text); no shuffle. Empty lines give no glyphs."""
    g = lines.select("doc", "line_no", F.posexplode(F.expr("filter(split(text, ''), c -> c <> '')")).alias("i", "ch"))
    i, n = F.col("i"), F.col("line_no")
    f = lambda c: c.cast("float")
    shift = F.floor(i / 9) * 1.5 + F.floor(i / 31) * 6.0 + F.floor(i / 53) * 18.0
    return g.select(
        "doc", (F.floor(n / ROWS) + 1).cast("int").alias("page"), ((n % ROWS).cast("bigint") * 1_000_000 + i).alias("seq"), F.ascii("ch").alias("code"), F.lit(1).alias("code_len"),
        F.when((F.col("ch") == " ") & (i % 5 == 0), "\t").otherwise(F.col("ch")).alias("text"), f(MARGIN + i * CELL + shift).alias("x"),
        f(MARGIN + (n % ROWS) * PITCH - F.when(i % 23 == 7, 4.0).otherwise(0.0)).alias("y"), f(F.when((i + n) % 17 == 5, 0.0).otherwise(0.5)).alias("width"), f(F.lit(SIZE)).alias("tfs"),
        F.when(F.floor(i / 20) % 3 == 1, "Courier-Bold").otherwise("Courier").alias("font_name"), f(F.lit(SIZE)).alias("font_size"),
    )
