"""Lines to text: plain, laid out on a character grid, and debug output."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: points of a grid column; distance at which a span counts as aligned with a column
CELL, ALIGNED = 4.0, 16.0
#: parts over which a document's lines are spread where they meet its columns
SALTS = 16
#: clusters of right edges: distance to the centre, least spans, spreads and places
NEAR, LEAST, LEFT_SPREAD, FAR_LEFT_SPREAD, FAR, RIGHT_SPREAD, FIRST = 8.0, 3, 50.0, 5.0, 450.0, 3.7, 200.0


def to_col(x: Column) -> Column:
    """Grid column of an x: rounded half away from zero, never below 0."""
    return F.greatest(F.lit(0), F.floor(x / F.lit(CELL).cast("float") + 0.5)).cast("int")


def grid(spans: DataFrame) -> DataFrame:
    """Spans with start_col, end_col and grid_width (at least the number of characters)."""
    s = spans.withColumn("start_col", to_col(F.col("bbox.l"))).withColumn("end_col", to_col(F.col("bbox.r")))
    return s.withColumn("grid_width", F.greatest(F.col("end_col") - F.col("start_col"), F.length("text"), F.lit(0)))


def plain_lines(lines: DataFrame) -> DataFrame:
    """doc, line_no, text: span texts joined by one blank."""
    return lines.select("doc", "line_no", F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), " ").alias("text"))


def documents(rows: DataFrame, name: str = "plain") -> DataFrame:
    """The text of each document from rows (doc, line_no, text); every line ends in a newline."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda p: F.concat(p["text"], F.lit("\n")))
    return rows.groupBy("doc").agg(F.array_join(parts, "").alias(name))


class _Clusters:
    """Right edges of one document, in line order; sums are kept in the order they came."""

    def __init__(self):
        n = 64
        self.sum = np.zeros(n, np.float32)
        self.count = np.zeros(n, np.float32)
        self.low = np.full((2, n), np.float32(np.inf), np.float32)
        self.high = np.full((2, n), np.float32(-np.inf), np.float32)
        self.used = 0

    def add(self, left: np.float32, right: np.float32) -> None:
        k = self.used
        j = -1
        if k:
            far = np.abs(right - self.sum[:k] / self.count[:k])
            i = int(np.argmin(np.where(np.isnan(far), np.float32(np.inf), far)))
            if far[i] < NEAR:
                j = i
        if j < 0:
            if k == len(self.sum):
                self.sum, self.count = np.concatenate([self.sum, np.zeros(k, np.float32)]), np.concatenate([self.count, np.zeros(k, np.float32)])
                self.low, self.high = np.concatenate([self.low, np.full((2, k), np.inf, np.float32)], 1), np.concatenate([self.high, np.full((2, k), -np.inf, np.float32)], 1)
            j, self.used = k, k + 1
        self.sum[j] += right
        self.count[j] += 1
        self.low[:, j] = np.minimum(self.low[:, j], (left, right))
        self.high[:, j] = np.maximum(self.high[:, j], (left, right))

    def columns(self) -> list[tuple[int, float]]:
        out = []
        for j in range(self.used):
            mean = self.sum[j] / self.count[j]
            left, right = self.high[:, j] - self.low[:, j]
            if self.count[j] >= LEAST and left >= (FAR_LEFT_SPREAD if mean >= FAR else LEFT_SPREAD) and right < np.float32(RIGHT_SPREAD) and mean >= FIRST:
                out.append((j, float(mean)))
        return out


def right_columns(lines: DataFrame) -> DataFrame:
    """doc and ``positions`` of its right-aligned columns, in the order their first span came.

    Clustering depends on the order of spans, so each document is folded in line order; rows stream
    past and only the clusters are held, whatever the size of the document.
    """
    edges = lines.select("doc", "line_no", F.posexplode("spans").alias("i", "s")).select("doc", "line_no", "i", F.col("s.bbox.l").alias("l"), F.col("s.bbox.r").alias("r"))

    def run(batches):
        doc, held = None, None
        for batch in batches:
            docs, ls, rs = batch.column(0).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
            out = []
            for d, a, b in zip(docs, ls.astype(np.float32), rs.astype(np.float32)):
                if d != doc or held is None:
                    if held is not None:
                        out.append((doc, [p for _, p in held.columns()]))
                    doc, held = d, _Clusters()
                if not (np.isnan(a) or np.isnan(b)):
                    held.add(a, b)
            yield _columns(out)
        if held is not None:
            yield _columns([(doc, [p for _, p in held.columns()])])

    def _columns(rows):
        return pa.record_batch({"doc": pa.array([r[0] for r in rows], pa.string()), "positions": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})

    return edges.repartition("doc").sortWithinPartitions("doc", "line_no", "i").mapInArrow(run, "doc string, positions array<float>")


def pretty_lines(lines: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """doc, line_no, text on the grid. ``positions`` are the document's right-aligned columns
    (doc, positions); without them every span is placed by its left edge."""
    rows = lines.select("doc", "line_no", "spans")
    if positions is not None:
        # the few rows of positions are repeated, so that the lines of a large document meet them in many tasks
        spread = positions.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        rows = rows.withColumn("_salt", (F.col("line_no") % SALTS).cast("int")).join(spread, ["doc", "_salt"], "left")
        held = F.coalesce("positions", F.array().cast("array<float>"))
    else:
        held = F.array().cast("array<float>")
    rows = rows.withColumn("_p", held)

    def step(acc: Column, s: Column) -> Column:
        text = F.coalesce(s["text"], F.lit(""))
        size = F.length(text)
        column = F.get(F.filter(F.col("_p"), lambda p: F.abs(s["bbox"]["r"] - p) < F.lit(ALIGNED).cast("float")), F.lit(0))
        start = F.when(column.isNotNull(), F.greatest(F.lit(0), to_col(column) - size)).otherwise(to_col(s["bbox"]["l"]))
        pad = F.when(start > acc["col"], start - acc["col"]).when(acc["col"] > 0, F.lit(1)).otherwise(F.lit(0))
        return F.struct((acc["col"] + pad + size).cast("int").alias("col"), F.concat(acc["out"], F.repeat(F.lit(" "), pad.cast("int")), text).alias("out"))

    zero = F.struct(F.lit(0).cast("int").alias("col"), F.lit("").alias("out"))
    return rows.select("doc", "line_no", F.aggregate("spans", zero, step, lambda a: a["out"]).alias("text"))


def pretty(lines: DataFrame) -> DataFrame:
    return pretty_lines(lines, right_columns(lines))


def one_decimal(x: Column) -> Column:
    """A float with one decimal, rounded by its exact value, halves to even; -0.0 keeps its sign."""
    r = F.bround(x, 1)
    text = F.format_string("%.1f", r)
    sign = (x < 0) & (r == 0)
    return F.when(x.isNull(), F.lit("NaN")).when(sign, F.lit("-0.0")).otherwise(text)


def box_text(b: Column) -> Column:
    return F.concat(F.lit("(t: "), one_decimal(b["t"]), F.lit(", r: "), one_decimal(b["r"]), F.lit(", b: "), one_decimal(b["b"]), F.lit(", l: "), one_decimal(b["l"]), F.lit(")"))


def quoted(t: Column) -> Column:
    t = F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for ch, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        t = F.replace(t, F.lit(ch), F.lit(esc))
    return F.concat(F.lit('"'), t, F.lit('"'))


def debug_lines(lines: DataFrame) -> DataFrame:
    """doc, line_no, text: the line's number and each span's text, box and size."""

    def show(s: Column, i: Column) -> Column:
        return F.concat(F.lit("\n  Span "), i.cast("string"), F.lit(": "), quoted(F.coalesce(s["text"], F.lit(""))), F.lit("\n    BBox: "), box_text(s["bbox"]), F.lit("\n    Font size: "), one_decimal(s["font_size"]))

    head = F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(":"))
    text = F.when(F.size("spans") == 0, F.concat(head, F.lit(" (empty)"))).otherwise(F.concat(head, F.array_join(F.transform("spans", show), "")))
    return lines.select("doc", "line_no", text.alias("text"))
