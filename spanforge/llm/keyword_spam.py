"""Problem 8: pages of repeated keywords, links or product tags instead of sentences.

The content of a page (markup, formulas and bibliography entries aside) is read as a row of
terms. Windows slide over it; in each the gaps at which terms recur and the autocorrelation of
the row over a range of lags say how regularly it repeats, next to the share of links, of
different terms, and of function words in different surroundings. Windows that repeat
unnaturally without the function words of sentences, and lists of nouns or links, are stuffed;
a page is found if stuffed windows hold most of its content.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common_words import SPACED

WINDOW, STEP, LAGS = 40, 20, 24
#: standard deviation of the gaps of a term that recurs steadily, as a share of their mean; random gaps have about 1
SPREAD = 0.5
#: share of the content that must be stuffed; a stub has fewer terms than this and also fewer characters of content (a link is one term, however long)
SHARE, LEAST_TERMS, LEAST_CHARS = 0.5, 30, 150

BIBITEM = re.compile(r"\\bibitem(?:\[[^\]\n]*\])?\{[^}\n]*\}(?:(?!\\bibitem|\\end\{|\n\s*\n).)*", re.S)
MATH = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)\*?\}.*?\\end\{\1\*?\}|\$\$.*?\$\$|(?<!\\)\$[^$\n]*\$|\\\[.*?\\\]", re.S)
DEFINED = re.compile(r"\\(?:(?:re|provide)?(?:new|provide)command\*?|newenvironment|DeclareMathOperator|def)\*?\s*\{?\\?\w+\}?(?:\[\d\])?(?:\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}){1,2}")
SETUP = re.compile(r"\\(?:documentclass|usepackage|input|include|includegraphics|bibliographystyle|bibliography|cite\w*|ref|eqref|label|begin|end|color|hspace|vspace|setlength)\*?(?:\[[^\]]*\]|\{[^{}]*\})*")
URL = re.compile(r"(?:https?|ftp)://[^\s{}\\|<>\"]+|www\.[^\s{}\\|<>\"]+")
COMMAND = re.compile(r"\\(?:[A-Za-z]+\*?|\W)")
TERM = re.compile(r"\x01(\d+)\x01|\d[\d.,]*|[^\W\d_]+(?:[’'][^\W\d_]+)*|[.!?;,&#/|•\n]")


def terms(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms of a page, their lengths, and how many separators stand before each.

    Links become ``<url>`` with their own length, numbers ``<n>``.
    """
    t = BIBITEM.sub("\n", text)
    t = MATH.sub(" ", t)
    urls: list[int] = []

    def keep(m: re.Match) -> str:
        urls.append(len(m.group()))
        return f" \x01{len(urls) - 1}\x01 "

    t = URL.sub(keep, t)
    t = SETUP.sub(" ", DEFINED.sub(" ", t))
    t = t.replace("\\#", " # ").replace("\\\\", "\n").replace("\\_", "_")
    t = COMMAND.sub(" ", t)
    words: list[str] = []
    sizes: list[int] = []
    marks: list[int] = []
    pending = 0
    for m in TERM.finditer(t):
        g = m.group()
        if m.group(1) is not None:
            words.append("<url>")
            sizes.append(urls[int(m.group(1))])
        elif g[0].isdigit():
            words.append("<n>")
            sizes.append(len(g))
        elif g[0].isalpha():
            words.append(g.lower())
            sizes.append(len(g))
        else:
            pending |= 2 if g in ".!?" else 1
            continue
        marks.append(pending)
        pending = 0
    return words, np.array(sizes, np.int32), np.array(marks, np.int8)


class Windows:
    """Figures of each window of a page's terms. Those that cost most are computed when asked for."""

    def __init__(self, words: list[str], sizes: np.ndarray, marks: np.ndarray):
        n = self.n = len(words)
        index: dict[str, int] = {}
        listed = [index.setdefault(w, len(index)) for w in words]
        self.ids = np.array(listed, np.int32)
        kind = np.fromiter((3 if w == "<n>" else 2 if w == "<url>" else 1 if w in SPACED else 0 for w in index), np.int8, len(index))[self.ids]
        self.sizes = sizes
        self.start = np.arange(0, max(1, n - WINDOW // 2), STEP)
        self.stop = np.minimum(self.start + WINDOW, n)
        self.width = self.stop - self.start
        # function words count only in surroundings not met shortly before
        at = np.flatnonzero(kind == 1).tolist()
        fresh = np.zeros(n, np.int8)
        seen: dict[tuple[int, int, int], int] = {}
        listed.append(-1)  # also what stands before the first
        for i in at:
            key = (listed[i - 1], listed[i], listed[i + 1])
            j = seen.get(key)
            if j is None or i - j > 4 * WINDOW:
                fresh[i] = 1
            seen[key] = i
        self.kind, self.marks = kind, marks
        self.func = self.inside(fresh) / self.width

    def inside(self, x: np.ndarray) -> np.ndarray:
        c = np.zeros(self.n + 1, np.int64)
        np.cumsum(x, out=c[1:])
        return c[self.stop] - c[self.start]

    def auto(self) -> np.ndarray:
        """Greatest autocorrelation over the lags; function words and numbers match nothing."""
        ids, n = self.ids, self.n
        content = (self.kind == 0) | (self.kind == 2)
        still = np.zeros(n, bool)
        still[1:] = (ids[1:] == ids[:-1]) & (self.kind[1:] == 2)  # links in a row repeat at every lag
        best = np.zeros(len(self.start))
        for lag in range(1, min(LAGS, n - 1) + 1):
            same = np.zeros(n, bool)
            same[lag:] = (ids[lag:] == ids[:-lag]) & content[lag:]
            if lag > 1:
                same &= ~still
            np.maximum(best, self.inside(same) / np.maximum(1, self.width - 0.5 * lag), out=best)
        return best

    def gaps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions at which a value of ``x`` recurs, and how far before it last occurred."""
        order = np.argsort(x, kind="stable")
        again = x[order][1:] == x[order][:-1]
        return order[1:][again], np.diff(order)[again]

    def steady(self) -> np.ndarray:
        """Where a term, alone or with the one before, recurs all over the page at gaps that spread little against their mean."""
        out = np.zeros(self.n, bool)
        pairs = self.ids.astype(np.int64) * self.n
        pairs[1:] += self.ids[:-1]
        for x in (self.ids, pairs):
            at, gap = self.gaps(x)
            _, which = np.unique(x, return_inverse=True)
            times = np.bincount(which[at], minlength=self.n)
            mean = np.bincount(which[at], gap, self.n) / np.maximum(1, times)
            spread = np.bincount(which[at], gap.astype(float) ** 2, self.n) / np.maximum(1, times) - mean**2
            out |= ((times >= 2) & (spread <= (SPREAD * mean) ** 2))[which]
        return out

    def recur(self) -> tuple[np.ndarray, np.ndarray]:
        """Share of the content terms that occurred less than a window before; with those that recur steadily, however far apart."""
        at, gap = self.gaps(self.ids)
        near = np.zeros(self.n, bool)
        near[at] = gap <= WINDOW
        content = (self.kind == 0) | (self.kind == 2)
        most = np.maximum(1, self.inside(content))
        return self.inside(near & content) / most, self.inside((near | self.steady()) & content) / most

    def share(self, bad: np.ndarray) -> float:
        """Share of the content's characters under windows of which at least half are ``bad``."""
        votes = np.zeros(self.n + 1, np.int32)
        cover = np.zeros(self.n + 1, np.int32)
        np.add.at(cover, self.start, 1)
        np.add.at(cover, self.stop, -1)
        np.add.at(votes, self.start[bad], 1)
        np.add.at(votes, self.stop[bad], -1)
        v = np.cumsum(votes[:-1])
        hit = (v > 0) & (2 * v >= np.cumsum(cover[:-1]))
        return float(self.sizes[hit].sum() / max(1, self.sizes.sum()))


def stuffed_windows(w: Windows, auto: np.ndarray) -> np.ndarray:
    """Windows without the function words of sentences that repeat too regularly or list links."""
    recur, far = w.recur()
    url, num = w.inside(w.kind == 2) / w.width, w.inside(w.kind == 3) / w.width
    linked = w.inside(w.sizes * (w.kind == 2)) / np.maximum(1, w.inside(w.sizes))
    strong = (auto >= 0.40) | (recur >= 0.80)
    spoken = w.inside(w.kind == 1) / w.width
    bare = (w.func <= np.where(strong, 0.10, 0.05)) & (spoken <= 0.34)
    tabular = (num >= 0.30) & (url < 0.08)
    links = (url >= 0.10) | (linked >= 0.5) & (url > 0)
    listed, ends = w.inside((w.marks & 1) > 0) / w.width, w.inside((w.marks & 2) > 0) / w.width
    # where full stops part it into sentences, a window must be strong or repeat at a fixed lag
    regular = strong | ((recur >= 0.55) | (far >= 0.80)) & (ends < 0.08) | (auto >= 0.28) & (recur >= 0.40)
    nouns = (w.func <= 0.03) & (spoken <= 0.10) & (listed >= 0.25) & (ends <= 0.05) & (num < 0.15)
    return (bare & ~tabular & (regular | links)) | nouns


def judge(text: str, figures: bool = True) -> tuple[bool, float, float, float, int]:
    """Verdict, stuffed share of the content, greatest autocorrelation, share of links, terms.

    Without ``figures`` only the verdict and the terms hold: where even all windows short of
    function words hold less than the share asked for, the page can't be found, and the rest isn't computed.
    """
    words, sizes, marks = terms(text)
    n = len(words)
    stub = n < LEAST_TERMS and sizes.sum() < LEAST_CHARS
    if not n or stub and not figures:
        return False, 0.0, 0.0, 0.0, n
    w = Windows(words, sizes, marks)
    links = float((w.kind == 2).mean())
    if not figures and w.share(w.func <= 0.10) < SHARE:
        return False, 0.0, 0.0, links, n
    auto = w.auto()
    share = w.share(stuffed_windows(w, auto))
    return not stub and share >= SHARE, share, float(auto.max()), links, n


SCHEMA = "doc_id bigint, stuffed boolean, share double, autocorrelation double, links double, terms int"


def keyword_spam(documents: DataFrame, figures: bool = True) -> DataFrame:
    """Verdict and figures for every row of ``documents`` (doc_id, text); other columns are ignored.

    Without ``figures`` the verdicts are the same and come sooner, and only doc_id, stuffed and terms are given.

    Null and empty texts, and stubs of fewer than 30 terms with fewer than 150 characters of
    content, are no cases. Texts are read whole.
    No shuffle.
    """

    def run(batches):
        for batch in batches:
            got = [judge(t or "", figures) for t in batch.column(1).to_pylist()]
            cols = list(zip(*got)) if got else [[]] * 5
            kinds = (pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["doc_id", "stuffed", "share", "autocorrelation", "links", "terms"])

    out = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return out if figures else out.select("doc_id", "stuffed", "terms")
