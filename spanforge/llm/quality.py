"""Problem 2: per-document text statistics, and whether a document is prose, a list, a table or junk.

Statistics are summed by line and document, in pre-aggregated form, after misread characters are
repaired and look-alikes brought to one form (damage says nothing about the kind of a text).
Gradient-boosted trees learn the kind from documents that rules label without doubt, a bounded
sample of them, and judge every document; their probabilities are calibrated on a hand-checked
holdout (``quality_holdout``).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import checkpointed
from . import encoding_repair
from .boosting import Boosted
from .charmodel import EDGE
from .common_words import SPACED, UNSPACED
from .lines import BLOCK, line_texts
from .lookalikes import _DROP

#: documents the trees are fitted on, taken by hash order
TRAIN_DOCS = 4000
#: of so many surely labelled documents one is not fitted on but calibrates, with the hand-checked ones
KEPT_APART = 5
KINDS = ["prose", "list", "table", "junk"]

MARKER = re.compile(r"^\s*(?:[•‣▪◦·–—*-]\s+\S|\(?[0-9]{1,4}[.)]\s+\S|\(?[A-Za-zА-я]{1,2}\)\s+\S|\[[0-9]{1,4}\]\s*\S)")
LEADER = re.compile(r"(?:\.{4,}|(?:\. ){4,}|…{2,})\s*[0-9ivxlc]{1,5}\s*$")
INDEXED = re.compile(r"^\D{2,60},\s*\d{1,4}(?:[–—‐‑-]\d{1,4})?(?:,\s*\d{1,4}(?:[–—‐‑-]\d{1,4})?)*\s*$")
NUMBER = re.compile(r"^[+–—-]?[€$£]?\d[\d.,:/%–-]*(?:%|[a-zA-Zµ°]{1,3})?$")
VALUE = re.compile(r"^(?:[+–—-]|yes|no|n/a|na|nan|true|false|x|[A-Z]|[A-Z]{1,3}-?\d+|kg|mm|cm|km|m|s|h|%|kPa|Pa|°C|K)$")
FIELD = re.compile(r"^\s*[^:]{1,40}:\s*[+-]?\d[\d.,]*\s*\S{0,5}\s*$")
#: closing marks and what ends a sentence before them
CLOSING, ENDING = "\"'”’»)]」』", ".!?…。！？।॥؟;；"
TURNING = ".?!,;。"
TURNED = re.compile(r"^\s*[.?!,;。]\S")
HEX = re.compile(r"^[0-9a-f]{2,}$")
INNER = re.compile(r"[.!?…。！？।؟][\"'”’»)\]」』]*\s+[^\W\d_a-z]|[。！？]")
#: lines in which a marker stands for a list entry count whole up to this length, longer ones (numbered paragraphs) less and less
ENTRY = 150

SUMS = (
    "lines chars letters digits symbols odd words word_chars common ends marker leader numbers values turned hexes inner low_start logp scored "
    "c_marker c_table c_hex c_turned c_odd c_ends spaceless list_chars short long_lines title_lines logp5 scored5"
).split()


DROPPED = re.compile("[" + "".join(map(chr, _DROP)) + "]")
#: what else than blanks parts tokens
PARTING = re.compile("[\xa0\ue758-\uf8fe]")


def clean(text: str) -> str:
    return unicodedata.normalize("NFKC", text.translate(_DROP) if DROPPED.search(text) else text)


LETTER, DIGIT, SYMBOL, ODD, SPACELESS, BLANK = 1, 2, 4, 8, 16, 32


@lru_cache(1)
def _classes() -> np.ndarray:
    """The classes of every code point. Beyond the third plane all are private or unassigned but for one block."""
    out = np.full(0x110000, ODD | SYMBOL, np.uint8)
    for cp in (*range(0x34000), *range(0xE0000, 0xE0200)):
        out[cp] = 0
        c = unicodedata.category(chr(cp))
        if c[0] in "LM":
            out[cp] = LETTER
        elif c[0] == "N":
            out[cp] = DIGIT
        elif c in ("Co", "Cn", "Cc", "So") or cp == 0xFFFD:
            out[cp] = ODD | SYMBOL
        elif c[0] != "Z":
            out[cp] = SYMBOL
    for first, last in ((0x0E00, 0x0EFF), (0x3040, 0x30FF), (0x3400, 0x9FFF)):  # Thai and Lao, kana, Han
        out[first : last + 1] |= SPACELESS
    return out


def _class_counts(lines: list[str]) -> dict[int, np.ndarray]:
    """How many characters of each class every line has."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.append(0, np.cumsum(n))
    kind = _classes()[codes]
    out = {}
    for bit in (LETTER, DIGIT, SYMBOL, ODD, SPACELESS):
        c = np.append(0, np.cumsum((kind & bit) > 0))
        out[bit] = c[at[1:]] - c[at[:-1]]
    return out


#: figures of a word: length, common, number, value, hexadecimal, starts with a capital, log probability, scored characters, and these two if it has five or more
WORD = ("word_chars", "common", "numbers", "values", "hexes", "capitals", "logp", "scored", "logp5", "scored5")


def word_figures(words: list[str], model) -> np.ndarray:
    """A row of figures for each word (see ``WORD``)."""
    out = np.zeros((len(words), len(WORD)))
    low = [w.strip(".,;:!?\"'()[]“”„«»’").lower() for w in words]
    for i, w in enumerate(words):
        c = w[0]
        out[i, 0] = len(w)
        out[i, 1] = low[i] in SPACED
        if c.isdigit() or c in "+–—-€$£":
            out[i, 2] = bool(NUMBER.match(w))
        out[i, 3] = bool(VALUE.match(w))
        out[i, 4] = len(w) % 2 == 0 and bool(HEX.match(w))
        out[i, 5] = c.isupper()
    asked = [i for i, w in enumerate(low) if len(w) >= 3 and w[0].isalpha()]
    if asked:
        total, _, m = model.score([low[i].replace(EDGE, "\ufffd") for i in asked])  # whole: a line of Chinese or Thai is one word
        out[asked, 6], out[asked, 7] = total, m
        long = np.fromiter((len(low[i]) >= 5 for i in asked), bool, len(asked))
        out[asked, 8], out[asked, 9] = total * long, m * long
    return out


def line_sums(texts: list[str], model) -> np.ndarray:
    """A row of sums for each line (see ``SUMS``). Each different word of the lines is looked at once."""
    out = np.zeros((len(texts), len(SUMS)))
    at = {n: i for i, n in enumerate(SUMS)}
    stripped = [(i, s) for i, t in enumerate(texts) if (s := t.strip())]
    if not stripped:
        return out
    rows, lines = [i for i, _ in stripped], [s for _, s in stripped]
    count = _class_counts(lines)
    n = np.fromiter(map(len, lines), np.float64, len(lines))
    split = [s.split() for s in lines]
    words = list(chain.from_iterable(split))
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    k = np.fromiter(map(len, split), np.int64, len(lines))
    owner = np.repeat(np.arange(len(lines)), k)
    by_word = word_figures(list(index), model)[ids]
    w = {name: np.bincount(owner, by_word[:, j], len(lines)) for j, name in enumerate(WORD)}
    spaceless = count[SPACELESS]
    unspaced = {x for ws in UNSPACED.values() for x in ws}
    for j in np.flatnonzero(spaceless > n // 3):
        w["common"][j] += sum(lines[j].count(x) for x in unspaced)
    m = len(lines)
    marker, leader, indexed, field, ends, turned, low_start = (np.zeros(m, bool) for _ in range(7))
    inner = np.zeros(m)
    for j, s in enumerate(lines):
        first, last = s[0], s[-1]
        if last.isalnum():
            leader[j] = (".." in s or ". ." in s or "…" in s) and LEADER.search(s) is not None
            indexed[j] = last.isdigit() and INDEXED.match(s) is not None
        else:
            closed = s.rstrip(CLOSING)[-1:]
            ends[j] = closed != "" and closed in ENDING
        if first in TURNING:
            turned[j] = TURNED.match(s) is not None
        elif first.islower():
            low_start[j] = True
        if not (first.isupper() and s[1:2].islower()):
            marker[j] = MARKER.match(s) is not None
        field[j] = ":" in s and FIELD.match(s) is not None
        inner[j] = len(INNER.findall(s))
    marker |= indexed | leader
    cells = w["numbers"] + w["values"]
    table = ~indexed & (field | (k >= 2) & (cells >= 0.5 * k) | (k >= 4) & (cells >= 0.4 * k))
    entry = marker * np.minimum(1.0, ENTRY / n)
    vals = {
        "lines": 1, "chars": n, "letters": count[LETTER], "digits": count[DIGIT], "symbols": count[SYMBOL], "odd": count[ODD], "words": k, "word_chars": w["word_chars"], "common": w["common"], "ends": ends,
        "marker": entry, "leader": leader, "numbers": w["numbers"], "values": w["values"], "turned": turned, "hexes": w["hexes"], "inner": inner, "low_start": low_start, "logp": w["logp"], "scored": w["scored"],
        "c_marker": n * entry * ~table, "c_table": n * table, "c_hex": n * ((k >= 1) & (w["hexes"] >= 0.8 * k) & (count[DIGIT] > 0)), "c_turned": n * turned, "c_odd": count[ODD], "c_ends": n * ends, "spaceless": spaceless,
        "list_chars": n * np.maximum(entry, (n < 45) & ~ends), "short": n < 45, "long_lines": n > 120, "title_lines": (k <= 8) & (w["capitals"] >= 0.6 * k), "logp5": w["logp5"], "scored5": w["scored5"],
    }
    for name in SUMS:
        out[rows, at[name]] = vals[name]
    return out


FEATURES = (
    "mean_word_length symbol_ratio digit_ratio odd_ratio ends_share common_share marker_share table_chars list_share number_share value_share hex_chars turned_share inner_rate low_start_share logp letters_ratio words_per_line chars_per_line "
    "ends_chars spaceless_ratio short_share long_share title_share leader_share log_lines unknown long_logp"
).split()


def features(s: np.ndarray) -> np.ndarray:
    """Features of documents from their sums, one row each."""
    c = {n: s[:, i] for i, n in enumerate(SUMS)}
    d = lambda a, b: a / np.maximum(1.0, b)
    nospace = np.maximum(1.0, c["letters"] + c["digits"] + c["symbols"])
    units = np.maximum(c["words"], c["spaceless"] / 2.0)
    logp = np.where(c["scored"] > 0, c["logp"] / np.maximum(1.0, c["scored"]), -12.0)
    cols = [
        d(c["word_chars"], c["words"]), c["symbols"] / nospace, c["digits"] / nospace, c["odd"] / nospace, d(c["ends"], c["lines"]), d(c["common"], units), d(c["marker"], c["lines"]), d(c["c_table"], c["chars"]), d(c["c_marker"], c["chars"]),
        d(c["numbers"], c["words"]), d(c["values"], c["words"]), d(c["c_hex"], c["chars"]), d(c["turned"], c["lines"]), d(1000 * c["inner"], c["chars"]), d(c["low_start"], c["lines"]), logp, c["letters"] / nospace, d(c["words"], c["lines"]), d(c["chars"], c["lines"]),
        d(c["c_ends"], c["chars"]), d(c["spaceless"], c["chars"]), d(c["short"], c["lines"]), d(c["long_lines"], c["lines"]), d(c["title_lines"], c["lines"]), d(c["leader"], c["lines"]), np.log1p(c["lines"]), (c["scored"] == 0).astype(float),
        np.where(c["scored5"] > 0, c["logp5"] / np.maximum(1.0, c["scored5"]), logp),
    ]
    return np.stack(cols, axis=1)


def weak_labels(x: np.ndarray) -> np.ndarray:
    """The kind of documents whose kind is beyond doubt by simple rules, else -1."""
    f = {n: x[:, i] for i, n in enumerate(FEATURES)}
    out = np.full(len(x), -1)
    wordy = f["letters_ratio"] > 0.6
    spaceless = f["spaceless_ratio"] > 0.5
    structure = f["list_share"] + f["table_chars"]
    natural = wordy & (f["common_share"] > 0.10)
    usual = float(np.median(f["long_logp"][natural])) if natural.any() else -2.0  # how likely the corpus's words are
    prose = wordy & (structure < 0.3) & (f["turned_share"] < 0.1) & (f["odd_ratio"] < 0.05) & (f["inner_rate"] > 2.0) & (f["common_share"] > 0.10) & (f["long_logp"] > usual - 0.8)
    prose |= wordy & spaceless & (structure < 0.3) & (f["logp"] > -4.5) & ((f["ends_chars"] > 0.15) | (f["common_share"] > 0.02)) & (f["odd_ratio"] < 0.05)
    lists = (f["list_share"] > 0.75) & (f["table_chars"] < 0.2) & (f["odd_ratio"] < 0.05)
    table = (f["table_chars"] > 0.7) & (f["list_share"] < 0.2) & (f["hex_chars"] < 0.3) & (f["odd_ratio"] < 0.05) & ((f["letters_ratio"] > 0.2) | (f["digit_ratio"] > 0.5))
    junk = (f["odd_ratio"] > 0.3) | (f["hex_chars"] > 0.7) | (f["letters_ratio"] < 0.25) & (f["digit_ratio"] < 0.4) | (f["turned_share"] > 0.3)
    junk |= wordy & ~spaceless & (f["long_logp"] < usual - 1.1) & (structure < 0.3) & (f["unknown"] == 0)
    for k, m in enumerate((prose, lists, table, junk)):
        out[m] = k
    out[(prose.astype(int) + lists + table + junk) > 1] = -1
    return out


SUM_SCHEMA = "doc string, " + ", ".join(f"{n} double" for n in SUMS)


class Mender:
    """Restores damaged tokens in a worker: from the verdicts if they are few enough to be sent, else by the judge that
    gives the same ones."""

    def __init__(self, fixes: dict[str, str] | None, judge: encoding_repair.Repairer):
        self.fixes, self.judge = fixes, judge

    def mend(self, texts: list[str]) -> list[str]:
        """Each text beyond ASCII restored and in one plain form."""
        odd = [i for i, t in enumerate(texts) if not t.isascii()]
        parts = [encoding_repair.PARTS.split(t) if PARTING.search(t) else t.split(" ") for t in map(texts.__getitem__, odd)]
        fixes = self.fixes
        if fixes is None:
            asked = sorted({p for ps in parts for p in ps if not p.isascii()})
            fixes = {t: f[0] for t, f in zip(asked, self.judge.judge(asked)) if f}
        out, known = list(texts), fixes.keys()
        for i, ps in zip(odd, parts):
            out[i] = clean(texts[i] if known.isdisjoint(ps) else encoding_repair.restore(texts[i], fixes))
        return out


def document_sums(lines: DataFrame, judge: encoding_repair.Repairer, found: DataFrame) -> DataFrame:
    """Sums by document. Each Arrow batch is summed by document before it is shuffled."""
    few = (found.agg(F.sum(F.length("token") + F.length("fixed"))).first()[0] or 0) <= encoding_repair.BROADCAST_CHARS
    fixes = {r["token"]: r["fixed"] for r in found.where("not lost").select("token", "fixed").toArrow().to_pylist()} if few else None
    sent = lines.sparkSession.sparkContext.broadcast((fixes, judge.state()))

    def run(batches):
        fixed, state = sent.value
        own = encoding_repair.Repairer.of(state)
        mender = Mender(fixed, own)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            rows = line_sums(mender.mend([t or "" for t in batch.column(1).to_pylist()]), own.model)
            index: dict[str, int] = {}
            at = np.fromiter((index.setdefault(d, len(index)) for d in docs), np.int64, len(docs))
            sums = np.zeros((len(index), len(SUMS)))
            np.add.at(sums, at, rows)
            yield pa.record_batch([pa.array(list(index), pa.string()), *(pa.array(sums[:, i]) for i in range(len(SUMS)))], names=["doc", *SUMS])

    return lines.select("doc", "text").mapInArrow(run, SUM_SCHEMA).groupBy("doc").agg(*[F.sum(n).alias(n) for n in SUMS])


def fit(sums: DataFrame, model, train_docs: int = TRAIN_DOCS) -> Boosted:
    """Fit the trees on at most ``train_docs`` documents, by hash order; calibrate on the hand-checked holdout and a fifth of the
    surely labelled documents, neither of which is fitted on.

    For a kind no document is surely of, a few written examples stand in.
    """
    from .quality_holdout import EXAMPLES, HOLDOUT

    got = sums.orderBy(F.xxhash64("doc"), "doc").limit(train_docs).toArrow()
    table = np.stack([got[n].to_numpy() for n in SUMS], axis=1) if got.num_rows else np.zeros((0, len(SUMS)))
    held = np.stack([line_sums([clean(t) for t in lines], model).sum(0) for _, lines in HOLDOUT])
    truth = np.array([KINDS.index(k) for k, _ in HOLDOUT])
    x = features(table)
    y = weak_labels(x) if len(x) else np.zeros(0, int)
    sure = y >= 0
    x, y = x[sure], y[sure]
    apart = np.arange(len(x)) % KEPT_APART == KEPT_APART - 1
    xs, ys, x, y = x[apart], y[apart], x[~apart], y[~apart]
    missing = [k for k in range(len(KINDS)) if not (y == k).any()]
    if missing:
        extra = [(KINDS.index(k), line_sums([clean(t) for t in ls], model).sum(0)) for k, ls in EXAMPLES if KINDS.index(k) in missing]
        x, y = np.concatenate([x, features(np.stack([r for _, r in extra]))]), np.concatenate([y, [k for k, _ in extra]])
    return Boosted(KINDS).fit(x, y).calibrate(np.concatenate([features(held), xs]), np.concatenate([truth, ys]))


SCHEMA = "doc string, kind string, probability double, words bigint, mean_word_length double, symbol_ratio double, ends_share double, common_share double"


def document_quality(text_lines: DataFrame, keep_out: DataFrame | None = None) -> DataFrame:
    """Statistics and kind of every document of ``text_lines`` (doc, line_no, spans).

    words, mean_word_length, symbol_ratio (symbols of all characters but blanks), ends_share
    (lines that end in punctuation, of those with text), common_share (common words of all words),
    kind and its probability. Lines repeated exactly count once. A document without any text has all
    statistics 0 and is junk with probability 1: there is nothing a reader could read. Documents of
    ``keep_out`` (doc) are judged but never fitted on.
    """
    # a document, or a block of a long one, stays together, so that few partial sums leave a task
    lines = line_texts(text_lines).withColumn("bucket", F.floor(F.col("line_no") / BLOCK)).repartition("doc", "bucket").distinct()
    raw = text_lines.select(F.explode("spans").alias("s")).select(F.col("s.text").alias("text"))
    fitted = encoding_repair.fit_counts(encoding_repair.token_counts(raw))
    judge = fitted.judge
    sums = checkpointed(document_sums(lines, judge, fitted.found))  # one narrow row a document
    trees = fit(sums if keep_out is None else sums.join(keep_out.select("doc"), "doc", "left_anti"), judge.model)
    sent = text_lines.sparkSession.sparkContext.broadcast((trees.trees, trees.temperature, trees.rate))

    def run(batches):
        made = Boosted(KINDS, *sent.value)
        for batch in batches:
            s = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in SUMS], axis=1) if batch.num_rows else np.zeros((0, len(SUMS)))
            x = features(s)
            p = made.probabilities(x) if len(x) else np.zeros((0, len(KINDS)))
            empty = s[:, 0] == 0
            p[empty] = (0, 0, 0, 1)
            k = p.argmax(1) if len(p) else np.zeros(0, int)
            pick = lambda n: pa.array(np.where(empty, 0.0, x[:, FEATURES.index(n)]))
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index("doc")), pa.array([KINDS[i] for i in k], pa.string()), pa.array(p.max(1) if len(p) else np.zeros(0)), pa.array(s[:, SUMS.index("words")].astype(np.int64)), pick("mean_word_length"), pick("symbol_ratio"), pick("ends_share"), pick("common_share")],
                names=["doc", "kind", "probability", "words", "mean_word_length", "symbol_ratio", "ends_share", "common_share"],
            )

    return sums.mapInArrow(run, SCHEMA)
