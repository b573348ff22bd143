"""Queries of the text operators, by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import chunking, consistent_form, encoding_repair, keyword_spam, mixing, packing, quality, sentences


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repair_spans(_t(spark, sf_dir, "text_spans")).select("doc", "page_num", "span_seq", "field")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repair_spans(_t(spark, sf_dir, "text_spans"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_quality(spark, sf_dir).where("kind <> 'prose'").select("doc", "kind")


def p2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(_t(spark, sf_dir, "text_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _t(spark, sf_dir, "text_spans")
    keys = ["doc", "page_num", "span_seq"]
    changed = consistent_form.changed_spans(spans).select(*keys, "text")
    # a span is left out if one of its tokens is damaged; only tokens of changed spans are asked for
    seen = encoding_repair.with_verdicts(changed, "text", encoding_repair.damaged_tokens(spans), "left")
    return seen.groupBy(*keys).agg(F.max("hit").alias("garbled")).where("not garbled").select(*keys)


def p3_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _t(spark, sf_dir, "text_spans")
    return consistent_form.consistent_form(spans).dropDuplicates(["doc", "page_num", "span_seq"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_ends(_t(spark, sf_dir, "text_lines"), _t(spark, sf_dir, "sent_docs"))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document, by the number of sentence ends."""
    found = sentences.sentence_ends(_t(spark, sf_dir, "text_lines"))
    return found.groupBy("doc").agg(F.count("*").alias("sentences"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).select("profile", "doc").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pieces(_t(spark, sf_dir, "text_lines"), _t(spark, sf_dir, "chunk_limits"))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each profile and document the characters its pieces add, and whether they follow one another without a gap,
    keep the limit and hold what they claim."""
    made = p5_pieces(spark, sf_dir).join(_t(spark, sf_dir, "chunk_limits").select("profile", "max_chars", "overlap_chars"), "profile")
    # a range [a, b) without gap or overlap: as many characters as its length, and the sums of starts and ends differ by just the last end
    n = F.col("end_char") - F.col("start_char")
    sums = made.groupBy("profile", "doc").agg(
        F.sum(n).alias("chars"), F.max("end_char").alias("last"), F.sum(F.col("end_char") - F.col("start_char")).alias("_s"), F.countDistinct("start_char").alias("starts"), F.count("*").alias("pieces"),
        F.max(F.length("text")).alias("longest"), F.max("max_chars").alias("most"), F.min((F.length("text") - F.col("overlap") == n).cast("int")).alias("held"),
        F.min(((F.col("overlap") <= F.col("overlap_chars")) & ((F.col("start_char") == 0) | (2 * F.col("overlap") >= F.least("overlap_chars", "start_char")))).cast("int")).alias("repeated"),
        F.sum(F.length(F.regexp_replace(F.expr("substring(text, overlap + 1)"), "[^\n]", ""))).alias("newlines"),
    )
    whole = (F.col("chars") == F.col("last")) & (F.col("starts") == F.col("pieces")) & (F.col("held") == 1)
    return sums.select("profile", "doc", "chars", "newlines", whole.alias("whole"), (F.col("longest") <= F.col("most")).alias("within"), (F.col("repeated") == 1).alias("repeated"))


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each profile and text whether it is in containers, whole and in order, and whether these keep their capacity."""
    made = p6_assigned(spark, sf_dir)
    room = made.groupBy("profile", "container").agg(F.sum("n_tokens").alias("held"))
    full = room.where("container is not null").join(_t(spark, sf_dir, "pack_bins"), "profile").groupBy("profile").agg(F.max((F.col("held") > F.col("capacity_tokens")).cast("int")).alias("over"))
    each = made.groupBy("profile", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("last"), F.count("container").alias("placed"), F.countDistinct("piece_no").alias("parts"), F.count("*").alias("rows"))
    return each.join(full, "profile", "left").select("profile", "doc_id", (F.col("placed") > 0).alias("placed"), ((F.col("n") == F.col("last")) & (F.col("parts") == F.col("rows"))).alias("whole"), (F.coalesce("over", F.lit(0)) == 0).alias("fits"))


def p6_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "pack_bins"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_assigned(spark, sf_dir), _t(spark, sf_dir, "pack_bins"))


def p6_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of at most four parts and three quarters of the greatest attention cost, which bind beside the tokens."""
    return packing.containers(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "pack_bins"), max_docs=4, attention=0.75)


def p6_bounded_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_bounded(spark, sf_dir), _t(spark, sf_dir, "pack_bins"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))[1]


def p7_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source named whether it has texts, keeps its repeats, and misses its budget by less than one text."""
    taken, shares = mixing.mixture(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))
    rows = taken.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"))
    missed = F.col("budget_tokens") - F.col("taken_tokens")
    return shares.join(rows, "source", "left").select(
        "source", (F.col("available_tokens") > 0).alias("present"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"),
        ((missed >= 0) & (missed <= F.col("largest_text"))).alias("near"), (F.coalesce("rows", F.lit(0)) == F.coalesce("ids", F.lit(0))).alias("once"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_spam.keyword_spam(_t(spark, sf_dir, "documents"), figures=False).where("stuffed").select("doc_id").distinct()


def p8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_spam.keyword_spam(_t(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    here = globals()
    return {name: here[name] for name in sorted(here) if name[0] == "p" and name[1].isdigit()}
