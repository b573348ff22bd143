"""Problem 7: mixing sources to target shares of all tokens.

Every distinct text gets a uniform hash. Tokens are summed by source and hash bucket; from these
histograms the threshold of each source's budget is read, and only the bucket in which it falls
is summed again at a finer grain. A text is taken once more if its hash lies below the threshold,
so nothing is sorted and the mixtures of growing budgets are nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import checkpointed
from .tokens import with_tokens

#: bits of the hash that each level of the histograms resolves; with three levels, 36 bits
LEVEL_BITS, LEVELS = 12, 3
MOST_SOURCES = 1000


@dataclass(frozen=True)
class Plan:
    """What is taken of a source: every text ``whole`` times, and once more below ``threshold``."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    budget: int
    whole: int
    threshold: int


def texts_by_source(documents: DataFrame, sources: list[str], vocabulary: str | None = None) -> DataFrame:
    """Distinct texts of the named sources: source, doc_id (the least), u (a hash), n_tokens.

    Sources are compared trimmed and in lower case. Copies of a text count as one, also across
    sources, where the source of the least doc_id has it. Null and empty texts are left out.
    """
    source = F.lower(F.trim(F.regexp_replace(F.col("source"), r"\s+", " ")))
    rows = documents.select("doc_id", source.alias("source"), F.col("text")).where(F.col("source").isin(sources) & (F.length("text") > 0)).withColumn("key", F.md5(F.col("text").cast("binary")))
    sized = with_tokens(rows, F.col("text"), ["doc_id", "source", "key"], vocabulary)
    one = sized.groupBy("key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("m"))
    return one.select(F.col("m.source").alias("source"), F.col("m.doc_id").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("key", F.lit(29)), 1).alias("u"), F.col("m.n_tokens").alias("n_tokens"))


def _boundaries(rows: DataFrame, level: int, left: dict[str, int], prefix: dict[str, int]) -> dict[str, tuple[int, int]]:
    """The bucket of each source in which ``left`` tokens are used up, and the tokens in the buckets before it.

    Below the first level only the texts of the boundary buckets (``prefix``) are summed. The histogram of a source has
    2**LEVEL_BITS buckets at most; one row a source reaches the driver.
    """
    if not left:
        return {}
    spark, shift = rows.sparkSession, 63 - LEVEL_BITS * (level + 1)
    wanted = spark.createDataFrame([(s, n, prefix.get(s, 0)) for s, n in left.items()], "source string, left bigint, prefix bigint")
    inside = rows.join(F.broadcast(wanted), "source").where(F.shiftright("u", shift + LEVEL_BITS) == F.col("prefix"))
    sums = inside.groupBy("source", "left", F.shiftright("u", shift).alias("b")).agg(F.sum("n_tokens").alias("n"))
    run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
    got = run.where("upto > left").groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("before"))).alias("m")).collect()
    return {r["source"]: (r["m"]["b"], r["m"]["before"]) for r in got}


def plan(rows: DataFrame, targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> list[Plan]:
    """Budgets and thresholds. Without ``total_tokens``, the largest total at which every source
    that has texts keeps its share within its repeats; sources without texts get nothing."""
    have = {r["source"]: int(r["n"]) for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    present = [(s, w, r) for s, w, r in targets if have.get(s, 0) > 0 and w > 0 and r > 0]
    total = total_tokens if total_tokens is not None else min((int(r * have[s] / w) for s, w, r in present), default=0)
    budget = {s: min(int(w * total), r * have[s]) for s, w, r in present}
    whole = {s: budget[s] // have[s] for s in budget}
    left = {s: n for s in budget if (n := budget[s] - whole[s] * have[s]) > 0}
    below, prefix = dict.fromkeys(budget, 0), {}
    for level in range(LEVELS):
        found = _boundaries(rows, level, left, prefix)
        prefix = {s: b for s, (b, _) in found.items()}
        left = {s: left[s] - n for s, (_, n) in found.items()}
        for s, b in prefix.items():
            below[s] = b << (63 - LEVEL_BITS * (level + 1))
        left = {s: n for s, n in left.items() if n > 0}
    return [Plan(s, w, r, have.get(s, 0), budget.get(s, 0), whole.get(s, 0), below.get(s, 0)) for s, w, r in targets]


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The texts taken (doc_id, source, n_tokens, repeats) and the shares reached by source.

    ``targets`` has source, target_share and max_repeats; rows with a null are ignored. Texts of
    other or null sources are not taken. A source without texts reaches a share of 0.
    """
    rows = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").dropna().dropDuplicates(["source"]).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted = sorted((r[0], float(r[1]), int(r[2])) for r in rows)
    texts = checkpointed(texts_by_source(documents, [s for s, _, _ in wanted], vocabulary))
    plans = plan(texts, wanted, total_tokens)
    spark = documents.sparkSession
    taking = spark.createDataFrame([(p.source, p.whole, p.threshold) for p in plans], "source string, whole int, threshold bigint")  # at most MOST_SOURCES rows
    repeats = (F.col("whole") + (F.col("u") < F.col("threshold")).cast("int")).alias("repeats")
    taken = texts.join(F.broadcast(taking), "source").select("doc_id", "source", "n_tokens", repeats).where("repeats > 0")
    fixed = spark.createDataFrame([(p.source, p.target_share, p.max_repeats, p.available, p.budget) for p in plans], "source string, target_share double, max_repeats int, available_tokens bigint, budget_tokens bigint")
    sums = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    all_tokens = taken.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("all"))
    largest = texts.groupBy("source").agg(F.max("n_tokens").alias("largest"))  # what a share can miss its budget by, at most
    joined = fixed.join(sums, "source", "left").join(largest, "source", "left").withColumn("taken_tokens", F.coalesce("t", F.lit(0)))
    # one row of totals; joined on a constant key
    total = all_tokens.select(F.lit(1).alias("one"), F.coalesce("all", F.lit(0)).alias("all"))
    shares = joined.withColumn("one", F.lit(1)).join(total, "one").select(
        "source", "target_share", "max_repeats", "available_tokens", "budget_tokens", "taken_tokens", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("largest", F.lit(0)).alias("largest_text"),
        F.when(F.col("all") > 0, F.col("taken_tokens") / F.col("all")).otherwise(F.lit(0.0)).alias("actual_share"),
    )
    return taken, shares
