"""Spans to lines, page by page, so that one giant document is spread over its pages.

Within a page spans are ordered by their top (not-a-number first), and a new line starts where the
baseline moves by more than 5 points from the span before; a move of more than 24 leaves one blank
line. A page change leaves one blank line too. Within a line spans go from left to right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE_GAP, BLANK_GAP = 5.0, 24.0


def numbered_spans(spans: DataFrame) -> DataFrame:
    """Spans with line_no, and ``blank_before`` where a blank line stands before theirs.

    Lines are counted in each page; pages are joined by a running sum over one row a page.
    """
    w = Window.partitionBy("doc", "page_num").orderBy(F.col("bbox.t").asc_nulls_first(), "span_seq")
    gap = F.abs(F.col("bbox.b") - F.lag("bbox.b").over(w))
    lit = lambda v: F.lit(v).cast("float")
    step = F.when(gap > lit(BLANK_GAP), 2).when(gap > lit(LINE_GAP), 1).otherwise(0)
    s = spans.withColumn("_step", step).withColumn("_in_page", F.sum("_step").over(w))
    pages = s.groupBy("doc", "page_num").agg((F.max("_in_page") + 1).alias("_n"))
    past = Window.partitionBy("doc").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select("doc", "page_num", F.coalesce(F.sum(F.col("_n") + 1).over(past), F.lit(0)).alias("_start"))
    s = s.join(starts, ["doc", "page_num"])
    line = (F.col("_start") + F.col("_in_page")).cast("int")
    opens = (F.col("_in_page") == 0) & (F.row_number().over(Window.partitionBy("doc", "page_num").orderBy(F.col("bbox.t").asc_nulls_first(), "span_seq")) == 1) & (F.col("_start") > 0)
    return s.withColumn("line_no", line).withColumn("blank_before", opens | (F.col("_step") == 2)).drop("_step", "_in_page", "_start")


def span_struct():
    return F.struct("text", "bbox", "font_name", "font_size", "page_num")


def lines(spans: DataFrame) -> DataFrame:
    """doc, line_no from 0, spans from left to right; blank lines have an empty array.

    Documents without spans have no lines. ``spans`` needs the columns ``operators.spans.spans`` gives.
    """
    n = numbered_spans(spans)
    key = F.struct(F.col("bbox.l").alias("l"), F.col("bbox.t").isNotNull().alias("k"), F.col("bbox.t").alias("t"), "span_seq", span_struct().alias("span"))
    full = n.groupBy("doc", "line_no").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["span"]).alias("spans"), F.max("blank_before").alias("_blank"))
    kind = full.schema["spans"].dataType
    both = F.when(F.col("_blank"), F.array(F.struct(F.col("line_no").alias("n"), F.col("spans").alias("s")), F.struct((F.col("line_no") - 1).alias("n"), F.array().cast(kind).alias("s")))).otherwise(
        F.array(F.struct(F.col("line_no").alias("n"), F.col("spans").alias("s")))
    )
    return full.select("doc", F.explode(both).alias("x")).select("doc", F.col("x.n").alias("line_no"), F.col("x.s").alias("spans"))
