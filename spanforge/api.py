"""One document at a time: the calls of a plain library, on top of the DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass
from typing import IO

from pyspark.sql import SparkSession

from .operators import render
from .plans.text import extract
from .sources.fonts import Options


class ExtractionError(RuntimeError):
    """What went wrong: ``kind`` is FormatError, IoError or PdfError."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class BoundingBox:
    top: float
    right: float
    bottom: float
    left: float

    def __str__(self) -> str:
        return f"({self.top:.1f}, {self.right:.1f}, {self.bottom:.1f}, {self.left:.1f})"


@dataclass(frozen=True)
class TextSpan:
    text: str
    bbox: BoundingBox
    font_size: float
    page: int
    font_name: str

    def __str__(self) -> str:
        return self.text


class TextOutput:
    """Lines of spans of one document, and its text."""

    def __init__(self, lines: list[list[TextSpan]], plain: str, pretty: str, debug: str):
        self.lines, self._plain, self._pretty, self._debug = lines, plain, pretty, debug

    def to_string(self) -> str:
        return self._plain

    def to_string_pretty(self) -> str:
        return self._pretty

    def to_string_debug(self) -> str:
        return self._debug

    def __str__(self) -> str:
        return self._plain

    def __format__(self, spec: str) -> str:
        return self._pretty if spec == "#" else format(self._plain, spec)

    def __repr__(self) -> str:
        return f"TextOutput(lines={len(self.lines)})"


class PdfExtractor:
    """Built with ``PdfExtractor.builder().password(p).build()`` or by keywords."""

    def __init__(self, password: str | None = None, options: Options | None = None, spark: SparkSession | None = None):
        self.password, self.options = password, options
        self._spark = spark

    class Builder:
        def __init__(self):
            self._kw: dict = {}

        def password(self, password: str) -> "PdfExtractor.Builder":
            self._kw["password"] = password
            return self

        def options(self, options: Options) -> "PdfExtractor.Builder":
            self._kw["options"] = options
            return self

        def spark(self, spark: SparkSession) -> "PdfExtractor.Builder":
            self._kw["spark"] = spark
            return self

        def build(self) -> "PdfExtractor":
            return PdfExtractor(**self._kw)

    @staticmethod
    def builder() -> "PdfExtractor.Builder":
        return PdfExtractor.Builder()

    def from_path(self, path: str) -> TextOutput:
        try:
            with open(path, "rb") as f:
                return self.from_bytes(f.read(), str(path))
        except OSError as e:
            raise ExtractionError("IoError", str(e)) from e

    def from_reader(self, reader: IO[bytes]) -> TextOutput:
        return self.from_bytes(reader.read())

    def from_bytes(self, data: bytes, name: str = "bytes") -> TextOutput:
        spark = self._spark or SparkSession.builder.getOrCreate()
        files = spark.createDataFrame([(name, bytearray(data), self.password)], "doc string, content binary, password string")
        e = extract(files, None, self.options)
        lines = e.lines
        rows = lines.orderBy("line_no").collect()  # one document
        if not rows:  # a file that fails has no lines
            failed = e.errors.take(1)
            if failed:
                raise ExtractionError(failed[0]["kind"], failed[0]["message"])
        lines = spark.createDataFrame(rows, lines.schema)  # parsed once, rendered from the result
        text = lambda df: "".join(r["text"] + "\n" for r in df.orderBy("line_no").collect())
        made = [[TextSpan(s["text"], BoundingBox(s["bbox"]["t"], s["bbox"]["r"], s["bbox"]["b"], s["bbox"]["l"]), s["font_size"], s["page_num"], s["font_name"]) for s in r["spans"]] for r in rows]
        plain = "".join(" ".join(s.text for s in line) + "\n" for line in made)
        return TextOutput(made, plain, text(render.pretty(lines)), text(render.debug_lines(lines)))


def from_path(path: str, *, password: str | None = None) -> TextOutput:
    return PdfExtractor(password).from_path(path)


def from_bytes(data: bytes, *, password: str | None = None) -> TextOutput:
    return PdfExtractor(password).from_bytes(data)


def from_reader(reader: IO[bytes], *, password: str | None = None) -> TextOutput:
    return PdfExtractor(password).from_reader(reader)
