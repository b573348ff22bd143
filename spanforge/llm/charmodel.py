"""Smoothed character trigram model with hashed, fixed-size count tables.

The tables never grow with the corpus (65,536 single characters, 2**19 pairs, 2**21
triples, 2**20 whole words beyond ASCII, about 15 MB), so sending them to the driver and to the executors is bounded
by construction. Counting reads every row of the corpus: each task adds up its own
tables and emits only the cells it touched; Spark sums the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNI, BI, TRI, WORD = 1 << 16, 1 << 19, 1 << 21, 1 << 20
EDGE = "\x02"
#: tasks that count, at most: each emits its own cells, so their number bounds the shuffle on any corpus
MOST_TABLES = 4096
LOST = 0xFFFD
#: log probability that stands for a character that was lost, whatever it was
LOST_LOGP = -6.0
#: probability of a character never seen, the same for every corpus size
FLAT = 1e-6


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _hash2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint32(0x9E3779B1) + b) & np.uint32(BI - 1)


def _hash3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _mix(_mix(a * np.uint32(0x9E3779B1) + b) * np.uint32(0x9E3779B1) + c) & np.uint32(TRI - 1)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings between edge marks, the code before, and the one before that."""
    big = EDGE + EDGE.join(strings) + EDGE
    c = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    digit = (c >= 48) & (c <= 57)
    c[digit] = 48
    b = np.empty_like(c)
    b[0], b[1:] = 2, c[:-1]
    a = np.empty_like(c)
    a[:2], a[2:] = 2, c[:-2]
    a[b == 2] = 2
    return c, b, a


class CharModel:
    """P(c | a b), interpolated from triples to pairs to single characters to a flat floor."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray, tri: np.ndarray, word: np.ndarray):
        self.uni, self.bi, self.tri, self.word = uni, bi, tri, word
        self.total = float(uni.sum())

    def __add__(self, other: "CharModel") -> "CharModel":
        return CharModel(self.uni + other.uni, self.bi + other.bi, self.tri + other.tri, self.word + other.word)

    def logp(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each character, and where each string starts in it.

        Every string counts its characters and the edge after it.
        """
        c, b, a = _codes(strings)
        n1 = self.uni[c & (UNI - 1)].astype(np.float64)
        nb = self.uni[b & (UNI - 1)].astype(np.float64)
        p1 = n1 / max(self.total, 1.0) + FLAT
        # a pair is no more frequent than its characters, a triple than its pairs: what shares a cell by chance shows
        before = np.minimum(self.bi[_hash2(a, b)], np.minimum(self.uni[a & (UNI - 1)], nb))
        pair = np.minimum(self.bi[_hash2(b, c)], np.minimum(nb, n1))
        triple = np.minimum(self.tri[_hash3(a, b, c)], np.minimum(before, pair))
        p2 = pair / (nb + 2.0)  # nothing is given back to contexts never seen,
        p3 = triple / (before + 1.0)  # or odd characters would excuse what follows
        p = 0.90 * p3 + 0.08 * p2 + 0.02 * p1
        out = np.log(np.minimum(p, 1.0))
        out[c == LOST] = LOST_LOGP
        after = (b == LOST) | (a == LOST)
        out[after] = np.maximum(out[after], -5.0)
        edges = np.flatnonzero(c == 2)
        return out[1:], edges[:-1]

    def worst_run(self, strings: list[str]) -> np.ndarray:
        """The least mean log probability of RUN characters in a row, by string; of all of them in a shorter one."""
        if not strings:
            return np.zeros(0)
        lp, starts = self.logp(strings)
        n = np.diff(np.append(starts, len(lp)))  # the mark after each string included
        c = np.append(0.0, np.cumsum(lp))
        runs = np.full(len(lp), np.inf)
        runs[: max(0, len(lp) - RUN + 1)] = (c[RUN:] - c[:-RUN]) / RUN
        runs[np.arange(len(lp)) + RUN > np.repeat(starts + n - 1, n)] = np.inf
        least = np.minimum.reduceat(runs, starts)
        return np.where(np.isinf(least), (c[starts + n - 1] - c[starts]) / np.maximum(1, n - 1), least)

    def seen(self, word: str) -> float:
        """How often the whole word was counted."""
        return float(self.word[xxhash.xxh32_intdigest(word) & (WORD - 1)])

    def score(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum, least and number of the characters' log probabilities, by string."""
        if not strings:
            return np.zeros(0), np.zeros(0), np.zeros(0)
        lp, starts = self.logp(strings)
        total = np.add.reduceat(lp, starts)
        least = np.minimum.reduceat(lp, starts)
        n = np.diff(np.append(starts, len(lp)))
        return total, least, n


#: characters a task gathers before it adds them to its tables
GATHER = 1 << 20


#: characters of the runs ``CharModel.worst_run`` looks at
RUN = 4


def count_chars(df: DataFrame, pieces) -> CharModel:
    """Count the strings ``pieces(batch)`` gives for each Arrow batch of ``df``, over all rows.

    ``pieces`` returns strings with the number of times each counts, and words beyond ASCII with
    theirs. The result has at most UNI + BI + TRI + WORD cells, however large ``df`` is.
    """

    def tables(batches):
        made = [np.zeros(n, np.float64) for n in (UNI, BI, TRI, WORD)]
        strings: list[str] = []
        times: list[float] = []
        gathered = 0

        def add() -> None:
            c, b, a = _codes(strings)
            # the mark after a string counts with it, the first one not at all
            w = np.append(0.0, np.repeat(np.array(times, np.float64), np.fromiter(map(len, strings), np.int64, len(strings)) + 1))
            for table, cells in zip(made, (c & np.uint32(UNI - 1), _hash2(b, c), _hash3(a, b, c))):
                table += np.bincount(cells, w, len(table))
            strings.clear()
            times.clear()

        for batch in batches:
            new, counts, words, found = pieces(batch)
            np.add.at(made[3], np.fromiter((xxhash.xxh32_intdigest(w) & (WORD - 1) for w in words), np.int64, len(words)), found)
            strings += new
            times += counts
            gathered += sum(map(len, new))
            if gathered > GATHER:
                add()
                gathered = 0
        if strings:
            add()
        for kind, table in enumerate(made):
            at = np.flatnonzero(table)
            yield pa.record_batch({"kind": pa.array(np.full(len(at), kind, np.int32)), "cell": pa.array(at.astype(np.int32)), "n": pa.array(np.rint(table[at]).astype(np.int64))})

    cells = df.coalesce(MOST_TABLES).mapInArrow(tables, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    got = cells.toArrow()
    kind, cell, n = (got[k].to_numpy() for k in ("kind", "cell", "n"))
    out = []
    for k, size in enumerate((UNI, BI, TRI, WORD)):
        t = np.zeros(size, np.float32)
        t[cell[kind == k]] = n[kind == k]
        out.append(t)
    return CharModel(*out)
