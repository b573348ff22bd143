"""Positioned text from PDF files at scale, on PySpark DataFrames."""

from .api import BoundingBox, ExtractionError, PdfExtractor, TextOutput, TextSpan, from_bytes, from_path, from_reader
from .plans.text import Extraction, extract, register_views
from .sources.fonts import Options
from .sources.pdf import read_files

__all__ = ["BoundingBox", "Extraction", "ExtractionError", "Options", "PdfExtractor", "TextOutput", "TextSpan", "extract", "from_bytes", "from_path", "from_reader", "read_files", "register_views"]
