"""python -m spanforge FILE [--password P] [--format plain|pretty|debug]; exit code 1 on error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .api import ExtractionError, PdfExtractor


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanforge", description="Extract text from a PDF file")
    p.add_argument("file")
    p.add_argument("-p", "--password")
    p.add_argument("-f", "--format", choices=("plain", "pretty", "debug"), default="plain")
    a = p.parse_args(argv)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        out = PdfExtractor(a.password, spark=spark).from_path(a.file)
    except ExtractionError as e:
        print(f"Error extracting text from {a.file!r}: {e}", file=sys.stderr)
        return 1
    sys.stdout.write({"plain": out.to_string, "pretty": out.to_string_pretty, "debug": out.to_string_debug}[a.format]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
