"""Problem 6: filling containers of fixed capacity with texts.

Vector best-fit: a container has a residual of tokens, of documents and of attention cost (the
sum of squared lengths). Items come largest first; each goes to the open container that can take
it under every constraint and is left with the smallest weighted residual norm, else to a new
one. A text is divided only if it exceeds the capacity: its full parts fill containers of their
own, the rest is packed with the others. Items are packed in groups of bounded size chosen by
hash, so a task's work is bounded and the groups are independent; the space lost to grouping is
at most about one container a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import with_tokens

#: items of one packing group, on average
GROUP_ITEMS = 8192
MOST_PROFILES = 1000
#: documents a container holds at most, its attention cost as a share of capacity squared, and the weights of the three residuals
MAX_DOCS, ATTENTION, WEIGHTS = 4096, 1.0, (1.0, 0.02, 0.10)


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int = MAX_DOCS, attention: float = ATTENTION, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The container of each item; items of equal size keep their order.

    ``sizes`` must be at most ``capacity``. An item whose own cost is above the attention capacity gets a
    container of its own, to which nothing is added; every other container keeps all three capacities.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    room = 1024
    res = np.zeros((3, room))
    number = np.zeros(room, np.int64)
    top = made = 0
    cost_cap = attention * float(capacity) ** 2
    wt, wd, wa = weights[0], weights[1], weights[2]
    least = int(sizes.min()) if len(sizes) else 0
    for count, i in enumerate(order):
        s = float(sizes[i])
        d0, d1, d2 = s / capacity, 1.0 / max_docs, s * s / cost_cap
        if count % 512 == 511 and top:  # containers no item fits any more are closed
            keep = np.flatnonzero((res[0, :top] * capacity >= least - 1e-6) & (res[1, :top] >= d1 - 1e-12))
            res[:, : len(keep)] = res[:, keep]
            number[: len(keep)] = number[keep]
            top = len(keep)
        k = -1
        if top:
            r0, r1, r2 = res[0, :top] - d0, res[1, :top] - d1, res[2, :top] - d2
            norm = wt * r0 * r0 + wd * r1 * r1 + wa * r2 * r2
            norm[(r0 < -1e-9) | (r1 < -1e-9) | (r2 < -1e-9)] = np.inf
            k = int(np.argmin(norm))
            if norm[k] == np.inf:
                k = -1
        if k < 0:
            if top == room:
                res = np.concatenate([res, np.zeros((3, room))], axis=1)
                number = np.concatenate([number, np.zeros(room, np.int64)])
                room *= 2
            k, top = top, top + 1
            res[:, k] = 1.0 if d2 <= 1.0 + 1e-9 else (d0, d1, d2)
            number[k] = made
            made += 1
        res[0, k] -= d0
        res[1, k] -= d1
        res[2, k] -= d2
        out[i] = number[k]
    return out


SCHEMA = "profile string, container string, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"


def containers(documents: DataFrame, bins: DataFrame, vocabulary: str | None = None, group_items: int = GROUP_ITEMS, max_docs: int = MAX_DOCS, attention: float = ATTENTION) -> DataFrame:
    """The container of every text or part of one, for each profile of ``bins`` (profile, capacity_tokens).

    Rows: profile, container (null where there is no text to place), doc_id, piece_no (0 unless
    divided), token_start and n_tokens. Texts beyond the capacity come as full parts and a rest.
    Null and empty texts get one row without a container. Repeated doc_ids are packed as
    separate rows. Profiles with a null or not positive capacity are ignored.
    """
    rows = bins.select("profile", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(MOST_PROFILES + 1).collect()
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    capacity = {r[0]: int(r[1]) for r in rows}
    groups = max(1, -(-documents.count() // group_items))  # from the files' footers
    # rows without a doc_id have nothing of their own to be spread by but their place
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    placed = documents.select("doc_id", "text", F.pmod(F.xxhash64(spread, F.lit(17)), F.lit(groups)).alias("grp"))
    sized = with_tokens(placed, F.col("text"), ["doc_id", "grp"], vocabulary)
    profiles = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("cap")) for p, c in sorted(capacity.items())]) if capacity else F.array().cast("array<struct<profile:string,cap:bigint>>")
    # one row a text and profile: what is left after its full parts, with their number
    each = sized.select("doc_id", "grp", "n_tokens", F.inline(profiles))
    each = each.withColumn("full", F.when(F.col("n_tokens") > F.col("cap"), F.floor(F.col("n_tokens") / F.col("cap"))).otherwise(F.lit(0)).cast("bigint"))
    each = each.withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("cap"))

    def run(key, table):
        profile, grp = key[0].as_py(), key[1].as_py()
        cap = capacity[profile]
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        doc = table["doc_id"].combine_chunks()
        full, rest, n = (table[c].to_numpy() for c in ("full", "rest", "n_tokens"))
        some = np.flatnonzero(rest > 0)
        place = best_fit(rest[some], cap, max_docs, attention)
        names = [f"{profile}-{grp}-{b}" for b in place.tolist()]
        none = np.flatnonzero(n == 0)
        big = np.repeat(np.arange(len(n)), full)
        part = np.arange(len(big)) - np.repeat(np.cumsum(full) - full, full)
        at = np.concatenate([some, big, none])
        labels = names + [f"{profile}-{grp}-f{i}" for i in range(len(big))] + [None] * len(none)
        piece = np.concatenate([full[some], part, np.zeros(len(none), np.int64)])
        size = np.concatenate([rest[some], np.full(len(big), cap, np.int64), np.zeros(len(none), np.int64)])
        return pa.table({
            "profile": pa.array([profile] * len(at), pa.string()), "container": pa.array(labels, pa.string()), "doc_id": doc.take(pa.array(at)).cast(pa.int64()),
            "piece_no": pa.array(piece.astype(np.int32)), "token_start": pa.array(piece.astype(np.int64) * cap), "n_tokens": pa.array(size.astype(np.int64)),
        })

    return each.select("profile", "grp", "doc_id", "n_tokens", "full", "rest").groupBy("profile", "grp").applyInArrow(run, SCHEMA)


def fill(assigned: DataFrame, bins: DataFrame) -> DataFrame:
    """For each profile: containers, tokens, fewest containers that could hold them, and the shares of the capacities used.

    filled (of all tokens there is room for), documents (most parts in one container) and attention (most squared
    sizes in one container of several parts, as a share of capacity squared).
    """
    size = F.col("n_tokens").cast("double")
    each = assigned.where("container is not null").groupBy("profile", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"), F.sum(size * size).alias("c"))
    n = each.groupBy("profile").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("d").alias("documents"), F.max(F.when(F.col("d") > 1, F.col("c"))).alias("cost"))
    out = bins.select("profile", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct().join(n, "profile")
    fewest = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return out.select(
        "profile", "capacity_tokens", "containers", "tokens", fewest.alias("fewest"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"),
        "documents", (F.col("cost") / (F.col("capacity_tokens").cast("double") * F.col("capacity_tokens"))).alias("attention"),
    )
