"""Whole plans: from files to spans, lines and text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import checkpointed
from ..operators import lines as L
from ..operators import render
from ..operators import spans as S
from ..sources import pdf
from ..sources.fonts import Options


@dataclass
class Extraction:
    """All stages of one extraction; each is lazy and parses the files when it is computed.

    What needs the lines more than once (``pretty``, ``output``) writes the spans to the checkpoint folder first.
    """

    glyphs: DataFrame
    spans: DataFrame
    lines: DataFrame
    errors: DataFrame

    def settled(self) -> "Extraction":
        """The same with the spans written once, so that what follows doesn't parse the files again."""
        s = checkpointed(self.spans)
        return Extraction(self.glyphs, s, L.lines(s), self.errors)

    @property
    def plain(self) -> DataFrame:
        return render.documents(render.plain_lines(self.lines), "plain")

    @property
    def pretty(self) -> DataFrame:
        return render.documents(render.pretty(self.settled().lines), "pretty")

    @property
    def output(self) -> DataFrame:
        """doc, lines, plain, pretty and error, one row for each document that has text or an error."""
        held = self.settled()
        nested = held.lines.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "spans"))), lambda x: x["spans"]).alias("lines"))
        text = nested.join(held.plain, "doc").join(render.documents(render.pretty(held.lines), "pretty"), "doc")
        failed = self.errors.select("doc", F.struct("kind", "message").alias("error"))
        return text.join(failed, "doc", "full")


#: names of repeated files that are broadcast, at most
MOST_REPEATED = 50_000


def distinct_files(files: DataFrame) -> DataFrame:
    """``files`` with each doc once. Only names are shuffled, and the contents of the repeated files.

    The names of repeated files are broadcast if they are few, which is asked first. Of different contents any one counts.
    """
    repeated = checkpointed(files.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("_repeated")))
    names = F.broadcast(repeated) if repeated.count() <= MOST_REPEATED else repeated
    same = F.col("doc").eqNullSafe(F.col("_repeated"))
    return files.join(names, same, "left_anti").unionByName(files.join(names, same, "left_semi").dropDuplicates(["doc"]))


def extract(files: DataFrame, password: str | None = None, options: Options | None = None, pages: list[int] | None = None, mode: str = "PERMISSIVE") -> Extraction:
    g = pdf.glyphs(files, password, options, pages, mode)
    s = S.spans(g)
    return Extraction(g, s, L.lines(s), pdf.errors(g))


def register_views(files: DataFrame, prefix: str = "pdf_", **kw) -> Extraction:
    """Temporary views for SQL: glyphs, spans, lines, errors, pages and fonts of the files."""
    e = extract(files, **kw)
    for name, df in (("glyphs", e.glyphs), ("spans", e.spans), ("lines", e.lines), ("errors", e.errors), ("pages", pdf.pages(files, kw.get("password"))), ("fonts", pdf.fonts(files, kw.get("password")))):
        df.createOrReplaceTempView(prefix + name)
    return e
