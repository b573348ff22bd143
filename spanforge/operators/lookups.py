"""Lookups behind font decoding as joins: encodings, glyph names, glyph maps and nearest widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core_metrics import CORE_FONTS, core_font, glyph_code_point
from ..functions.encodings import encoding_rows
from ..functions.glyph_names import glyph_names


def char_of(cp):
    """The character of a code point below 65,536, over its two bytes in UTF-16."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")


def encodings(spark: SparkSession) -> DataFrame:
    """Dimension of the named encodings: encoding, code, code_point (at most 1,024 rows)."""
    return spark.createDataFrame(encoding_rows(), "encoding string, code int, code_point int")


def names(spark: SparkSession) -> DataFrame:
    """Dimension of glyph names: name, code_point (a few thousand rows, fixed)."""
    return spark.createDataFrame(sorted(glyph_names().items()), "name string, code_point int")


def core_metrics(spark: SparkSession) -> DataFrame:
    """Dimension of the standard fonts: font, code (null if not encoded), width, glyph, code_point."""
    rows = [(f, c if c >= 0 else None, float(w), g, glyph_code_point(f, c, g)) for f in CORE_FONTS for c, w, g in core_font(f)]
    return spark.createDataFrame(rows, "font string, code int, width float, glyph string, code_point int")


def decode_codes(codes: DataFrame, spark: SparkSession) -> DataFrame:
    """Codes (key, pos, encoding, code) with their text; codes without a character are dropped.

    The dimension is fixed and small, so it is broadcast.
    """
    return codes.join(F.broadcast(encodings(spark)), ["encoding", "code"]).withColumn("text", char_of(F.col("code_point")))


def nearest_width(wanted: DataFrame, offered: DataFrame, percent: float = 2.0) -> DataFrame:
    """For each (key, width) the character of nearest width within ``percent`` (1 at least).

    A range join without a cross join: each width is spread over the whole numbers of its tolerance
    and met by equality. Order: least distance, wider before narrower, then blank, hyphen, digits and
    ASCII punctuation, then the order of ``offered`` (width, char, ord).
    """
    base = F.floor("width").cast("int")
    most = F.greatest(F.floor(F.col("width") * percent / 100.0).cast("int"), F.lit(1))
    spread = wanted.select("key", "width", base.alias("_b"), F.explode(F.sequence(base - most, base + most)).alias("_w"))
    met = spread.join(offered.select(F.col("width").cast("int").alias("_w"), "char", "ord"), "_w")
    off = F.abs(F.col("_w") - F.col("_b"))
    liked = F.col("char").rlike("^[ 0-9!-/:-@\\[-`{-~]$")
    w = Window.partitionBy("key").orderBy(off, (F.col("_w") < F.col("_b")).cast("int"), (~liked).cast("int"), "ord")
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("key", "width", "char", F.col("_w").alias("matched_width"))


def cid_text(cid_to_gid: DataFrame, gid_to_char: DataFrame) -> DataFrame:
    """CID to character over the glyph: cid_to_gid (font, cid, gid) and gid_to_char (font, gid, code_point)."""
    return cid_to_gid.where("gid <> 0").join(gid_to_char, ["font", "gid"]).select("font", "cid", "gid", "code_point", char_of(F.col("code_point")).alias("text"))


def width_rows(fonts: DataFrame) -> DataFrame:
    """Widths of font rows (doc, font_id, widths): one row a code; null maps give none."""
    return fonts.where("widths is not null").select("doc", "font_id", F.explode("widths").alias("code", "width"))
