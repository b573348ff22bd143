"""The queries users ask of spans and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_font(spans: DataFrame, part: str) -> DataFrame:
    """Spans whose font name holds ``part``, whatever the case; null names hold nothing."""
    return spans.where(F.lower("font_name").contains(part.lower()))


def font_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("font_name").agg(F.count("*").alias("spans"))


def first_lines(lines: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` lines of each document; line numbers start at 0."""
    return lines.where(F.col("line_no") < n)


def region(spans: DataFrame, top_below: float = 100.0, left_above: float = 400.0) -> DataFrame:
    return spans.where((F.col("bbox.t") < top_below) & (F.col("bbox.l") > left_above))


def bands(spans: DataFrame, height: int = 10) -> DataFrame:
    """Table rows: spans of one band of ``height`` points (halves to even), cells from left to right.

    Spans without a top are in no band. doc, page_num, band, cells, row.
    """
    band = (F.bround(F.col("bbox.t").cast("double") / height) * height).cast("int")
    cells = F.transform(F.array_sort(F.collect_list(F.struct(F.col("bbox.l").alias("l"), "span_seq", "text"))), lambda c: F.coalesce(c["text"], F.lit("")))
    s = spans.where(F.col("bbox.t").isNotNull()).select("doc", "page_num", band.alias("band"), "bbox", "span_seq", "text")
    return s.groupBy("doc", "page_num", "band").agg(F.count("*").cast("int").alias("cells"), F.array_join(cells, " | ").alias("row"))


def corners(spans: DataFrame) -> DataFrame:
    """Corner points of each box."""
    p = lambda x, y: F.struct(F.col(f"bbox.{x}").alias("x"), F.col(f"bbox.{y}").alias("y"))
    return spans.select("doc", "page_num", "span_seq", p("l", "t").alias("top_left"), p("r", "t").alias("top_right"), p("l", "b").alias("bottom_left"), p("r", "b").alias("bottom_right"))


def current_spans(rows: DataFrame) -> DataFrame:
    """One row for each (doc, page_num, span_seq): of repeated keys the one loaded last."""
    cols = [c for c in rows.columns if c not in ("doc", "page_num", "span_seq")]
    last = F.max_by(F.struct(*cols), F.coalesce("loaded_at", F.lit("1900-01-01").cast("timestamp"))) if "loaded_at" in cols else F.first(F.struct(*cols))
    return rows.groupBy("doc", "page_num", "span_seq").agg(last.alias("_r")).select("doc", "page_num", "span_seq", "_r.*")
