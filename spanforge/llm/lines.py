"""Lines with their text, and documents cut into blocks of bounded size.

A block starts at the first usable break at or after each multiple of ``BLOCK`` lines, so a
document of any size is spread over many tasks and never gathered in one. Where the breaks lie is
found from narrow rows without text (number of characters, page, blankness), in windows of one
bucket of lines and over one row a bucket; the texts are then shuffled once, straight to their blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import checkpointed

BLOCK = 4096
#: rows of the table of blocks that are broadcast, at most; a larger one meets the lines in a shuffle
MOST_BROADCAST = 50_000


def line_texts(text_lines: DataFrame) -> DataFrame:
    """Every row's text (span texts joined by one blank), page and blankness; repeated rows stay.

    Null or empty spans make a blank line, a null span text an empty one.
    """
    spans = F.coalesce(F.col("spans"), F.array().cast(text_lines.schema["spans"].dataType))
    text = F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    page = F.filter(F.transform(spans, lambda s: s["page_num"]), lambda p: p.isNotNull())
    return text_lines.select(F.col("doc").cast("string").alias("doc"), F.col("line_no").cast("int").alias("line_no"), text.alias("text"), F.get(page, F.lit(0)).alias("page"), (F.size(spans) == 0).alias("blank"))


def measures(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """One narrow row for each (doc, line_no): bucket, n (characters and a newline), page, blank. Rows without doc or line_no are left out.

    Of different rows under one number the longest counts, as in ``longest``. A bucket of lines lies in one partition.
    """
    rows = lines.where("doc IS NOT NULL AND line_no IS NOT NULL").select("doc", F.floor(F.col("line_no") / size).alias("bucket"), "line_no", (F.length("text") + 1).alias("n"), "page", "blank")
    return rows.repartition("doc", "bucket").groupBy("doc", "bucket", "line_no").agg(F.max("n").alias("n"), F.max("page").alias("page"), F.min("blank").alias("blank"))


def longest(numbers: list[int], texts: list[str], pages: list[int | None], blanks: list[bool]) -> list[tuple[int, str, int | None, bool]]:
    """Rows by line number, each once: the longest text, of those the greatest."""
    best: dict[int, tuple] = {}
    for no, text, page, blank in zip(numbers, texts, pages, blanks):
        key = (len(text), text, not blank, -1 if page is None else page)
        if no not in best or key > best[no][0]:
            best[no] = key, (no, text, page, blank)
    return [best[no][1] for no in sorted(best)]


def blocks(rows: DataFrame, at_pages: bool, context: int = 0, size: int = BLOCK) -> DataFrame:
    """One row a block of the documents in ``rows`` (see ``measures``).

    doc, block, first and until (its lines; until is null of the last), lead (the line from which at least
    ``context`` characters stand before it), start_char and total (characters of the whole document), last_bucket.
    ``at_pages`` takes the blank line of a page change for the best break and any blank line for the next
    best; otherwise only blank lines within a page are breaks, as they alone surely end a sentence. The
    blank line itself starts the block. Where a bucket has no break, its lines go on with the block before.
    """
    w = Window.partitionBy("doc", "bucket").orderBy("line_no")
    whole = Window.partitionBy("doc", "bucket")
    before, after = F.lag("page").over(w), F.lead("page").over(w)
    b = rows.select("*", (F.col("blank") & (before != after)).alias("turn"), (F.col("blank") & (before == after)).alias("gap"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("past"))
    first = lambda flag, col: F.min(F.when(F.col(flag), F.col(col))).over(whole)
    cut = lambda col: F.coalesce(first("turn", col), first("gap", col)) if at_pages else first("gap", col)
    b = b.select("*", cut("line_no").alias("cut"), cut("past").alias("cut_past"), F.sum("n").over(whole).alias("held"))
    enough = lambda upto: F.max(F.when(F.col(upto) - F.col("past") >= context, F.col("line_no")))
    one = b.groupBy("doc", "bucket").agg(
        F.max("cut").alias("cut"), F.max("cut_past").alias("cut_past"), F.max("held").alias("held"), F.min("line_no").alias("least"), enough("held").alias("tail"),
        F.max(F.when((F.col("line_no") < F.col("cut")) & (F.col("cut_past") - F.col("past") >= context), F.col("line_no"))).alias("near"),
    )
    d = Window.partitionBy("doc").orderBy("bucket")
    every = Window.partitionBy("doc")
    one = one.select(
        "*", F.coalesce(F.sum("held").over(d.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("chars"), F.sum("held").over(every).alias("total"), F.max("bucket").over(every).alias("last_bucket"),
        F.lag("tail").over(d).alias("tail_before"), (F.row_number().over(d) == 1).alias("start"),
    )
    at = F.when(F.col("start"), F.col("least")).otherwise(F.col("cut"))
    lead = F.when(F.col("start") | (F.lit(context) <= 0), at).otherwise(F.coalesce("near", "tail_before", F.greatest(F.lit(0), F.col("cut") - context)))
    made = one.select("doc", F.col("bucket").alias("block"), at.alias("first"), lead.alias("lead"), (F.col("chars") + F.when(F.col("start"), F.lit(0)).otherwise(F.col("cut_past"))).alias("start_char"), "total", "last_bucket").where("first IS NOT NULL")
    return made.withColumn("until", F.lead("first").over(Window.partitionBy("doc").orderBy("block")))


def in_blocks(lines: DataFrame, table: DataFrame, size: int = BLOCK) -> DataFrame:
    """The lines of each block of ``table`` and those that lead to it: doc, block, first, start_char, total, line_no, text, page, blank.

    The table of blocks is broadcast if it is small, which is asked first; else both sides are shuffled by bucket.
    """
    end = F.coalesce(F.floor((F.col("until") - 1) / size), F.col("last_bucket"))
    keys = checkpointed(table.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lead") / size), end))).drop("last_bucket"))
    keys = F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys.hint("merge")
    met = lines.withColumn("bucket", F.floor(F.col("line_no") / size)).join(keys, ["doc", "bucket"])
    return met.where("line_no >= lead AND (until IS NULL OR line_no < until)").select("doc", "block", "first", "start_char", "total", "line_no", "text", "page", "blank")


#: parts over which the lines of one document are spread where they meet something by document
SALTS = 16


def of_documents(text_lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The lines of the documents in ``docs``. The keys are broadcast if they are few, which is asked first; else they are
    repeated and the lines spread over them, so a document with a large share of all lines doesn't meet its key in one task."""
    keys = docs.select(F.col("doc").cast("string").alias("doc")).where("doc IS NOT NULL").distinct()
    if keys.count() <= MOST_BROADCAST:
        return text_lines.join(F.broadcast(keys), "doc", "left_semi")
    keys = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return text_lines.withColumn("_salt", (F.floor(F.col("line_no") / BLOCK) % SALTS).cast("int")).join(keys, ["doc", "_salt"], "left_semi").drop("_salt")
