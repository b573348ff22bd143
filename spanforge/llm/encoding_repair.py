"""Problem 1: text that was decoded with the wrong character encoding.

Texts are parted into tokens, and tokens counted over all rows, in the JVM; from there on each
different token is handled once. A character trigram model is trained on the clean tokens. Every
token with a character beyond ASCII that holds at least one surprising character is put through
the encode-decode chains (see ``readings``). The likeliest reading replaces the token if it beats
the text as it stands by a margin that is validated on all clean tokens: as they are,
and damaged on purpose in every way. The verdicts then meet the rows by their tokens.
Bytes that got lost on the way leave U+FFFD in the restored value; such readings pass the
same test, and a U+FFFD that stands in the text already marks it as damaged.
"""

from __future__ import annotations

import codecs
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import checkpointed
from .charmodel import CharModel, count_chars
from .lookalikes import plain_forms

# Names of codecs. Those in which bytes get misread, and those bytes can have been written in.
SHOWN_AS = ("latin_1", "cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "cp1254", "cp1256", "gbk", "cp932")
WRITTEN_IN = ("utf_8", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "iso8859_7", "gbk", "big5", "cp932", "euc_jp", "cp874", "cp1256")
MULTI = {"utf_8", "gbk", "big5", "cp932", "euc_jp"}
#: margins tried, and parts of a log probability that its distribution over all tokens is told by
MARGINS, PARTS_OF_LOGP = [3.0 + 0.5 * k for k in range(15)], 1000
#: pairs of a clean token and the same one damaged that the limits need; with fewer, those of ``Repairer`` hold
LEAST_PAIRS = 50
#: what the first model needs beyond its margin to keep a token out of the second training, so that no wrong verdict confirms itself
SURE = 7.0
#: a token that beats all its other readings by more than this under the first model isn't asked for under the second
FAR = 25.0
#: the gain of a token without other readings
NONE = -1e9
#: tokens a task judges, about; characters of tokens that are read in all ways at once; tokens that are damaged in all ways at once
TASK_TOKENS, AT_ONCE, TOGETHER = 20_000, 1 << 15, 8
#: characters of verdicts that are broadcast, at most; more of them meet the rows in a shuffle, spread over SALTS
BROADCAST_CHARS, SALTS = 4_000_000, 16
PREFIX = re.compile(r"^[A-Z]{6}\+")
#: blanks that part tokens; a no-break space after a character beyond ASCII may be a misread byte. Private-use characters
#: part them too, but for those that a codec of SHOWN_AS gives (cp932: U+E000-U+E757, U+F8F0-U+F8F3; mac_roman: U+F8FF)
PARTS = re.compile("( |(?<=[\\x00-\\x7f])\\xa0|[\ue758-\uf8ef\uf8f4-\uf8fe]+)")
#: Latin letters right beside Han or kana: not what a Latin word turns into
#: what else than blanks parts tokens, in the JVM's notation
JVM_PARTS = r"(?<=[\x00-\x7f])\xa0|[\ue758-\uf8ef\uf8f4-\uf8fe]+"
JVM_BEYOND = r"[^\x00-\x7f]"
CJK = re.compile(r"[\u3000-\u9fff]")
MIXED_CJK = re.compile(r"[A-Za-z][\u3000-\u9fff\uff61-\uff9f]|[\u3000-\u9fff\uff61-\uff9f][A-Za-z]")
#: tokens wholly of Han, kana and ASCII: those only GBK or Shift-JIS may have shown
EAST = re.compile(r"[\x00-\x7f\u2e80-\u9fff\uff00-\uffef]*[\u3040-\u9fff][\x00-\x7f\u2e80-\u9fff\uff00-\uffef]*")
#: letters of scripts two bytes may hit by chance: phonetic, Armenian to Syriac, beyond Arabic
UNLIKELY = re.compile(r"[\u0180-\u02af\u0500-\u05ff\u0700-\u08ff]")
#: a capital that is a first byte of UTF-8, after a small letter: its second byte may be lost
HALF = re.compile(r"[a-zà-ÿ][ÂÃÄÅĂÎÏÐÑÓÔГР]|^[ÃĂ][a-z]")
#: letters of two alphabets side by side, as no right reading has them
MIXED = re.compile(r"[A-Za-zÀ-ɏ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]|[Ͱ-Ͽ][Ѐ-ӿ]|[Ѐ-ӿ][Ͱ-Ͽ]")
BEYOND = re.compile(r"[^\x00-\x7f]")
#: a first byte of UTF-8 for Latin to Arabic letters or general punctuation, Indic, Thai, kana or Han
LEADS = re.compile(rb"[\xc3-\xc5\xce-\xd1\xd8\xd9][\x80-\xbf]?|[\xe0\xe2-\xe9][\x80-\xbf]|\xc2[\x80-\xbf]")
#: private-use characters are unreadable; tokens made mostly of them are not misread
PRIVATE = re.compile("[\ue000-\uf8ff]")


def unreadable(token: str) -> bool:
    """True if most characters of the token are private-use ones: it isn't judged."""
    return 2 * len(PRIVATE.findall(token)) > len(token)


def _pass_c1(err: UnicodeEncodeError):
    """Bytes the code page leaves undefined are often passed through as control characters."""
    part = err.object[err.start : err.end]
    if all("\x80" <= ch <= "\x9f" or ch == "\xa0" for ch in part):
        return bytes(map(ord, part)), err.end
    raise err


codecs.register_error("pass_c1", _pass_c1)


@lru_cache(1)
def _shown() -> dict[str, frozenset[str]]:
    """The characters beyond ASCII each encoding of SHOWN_AS shows, bytes passed through among them."""
    out = {}
    for name in SHOWN_AS:
        codes = [bytes((a,)) for a in range(128, 256)] + [bytes((a, b)) for a in range(128, 256) for b in range(0x40, 256) if name in MULTI]
        out[name] = frozenset(c.decode(name, "ignore") for c in codes) | {chr(c) for c in range(0x80, 0xA1)}
    return out


def _bytes_of(text: str) -> dict[str, bytes]:
    """What the bytes were under each encoding the text may have been shown in."""
    out, used = {}, set(BEYOND.findall(text))
    for name in SHOWN_AS:
        if not used <= _shown()[name]:
            continue
        try:
            raw = text.encode(name, "pass_c1")
        except (UnicodeError, TypeError):
            continue
        out[name] = raw
    return out


@lru_cache(1)
def _written() -> dict[str, str]:
    """What each byte stands for in each single-byte encoding of WRITTEN_IN; NUL where it stands for nothing."""
    return {name: "".join(bytes((b,)).decode(name, "ignore") or "\x00" for b in range(256)) for name in WRITTEN_IN if name not in MULTI}


@lru_cache(1 << 10)
def _decoded(raw: bytes, encodings: tuple[str, ...]) -> list[tuple[str, str, bool, bool]]:
    """What ``raw`` can be in each of ``encodings``: its name, the text, whether bytes are lost, and whether it mixes alphabets."""
    out, tables = [], _written()
    for right in encodings:
        lost = False
        try:
            got = raw.decode(right) if right in MULTI else codecs.charmap_decode(raw, "strict", tables[right])[0]
        except UnicodeError:
            if right != "utf_8" or not LEADS.search(raw):
                continue
            got, lost = raw.decode(right, "replace"), True
            if got.count("�") * 2 > len(got):
                continue
        if not got or "\x00" in got or right in MULTI and right != "utf_8" and MIXED_CJK.search(got) and len(CJK.findall(got)) < 4:
            continue
        out.append((right, got, lost, bool(MIXED.search(got))))
    return out


def readings(text: str) -> dict[str, str]:
    """Every other reading of ``text``, with the chain that gives it.

    A chain takes the bytes under an encoding of SHOWN_AS and reads them in another of WRITTEN_IN. What was
    read as UTF-8 and still has characters beyond ASCII may have been misread before, so it is read again
    as UTF-8 until nothing more comes of it; each step leaves fewer characters.
    """
    found: dict[str, str] = {}
    level = {text: ""}
    first = True
    while level:
        after: dict[str, str] = {}
        for t, chain in level.items():
            mixed = bool(MIXED.search(t))
            seen: set[bytes] = set()
            for wrong, raw in _bytes_of(t).items():
                if raw in seen:
                    continue
                seen.add(raw)
                for right, got, lost, mixes in _decoded(raw, WRITTEN_IN if first else ("utf_8",)):
                    if right == wrong or lost and wrong in MULTI and len(raw) < 6 or mixes and not mixed or got == t or got == text or got in found:
                        continue
                    name = found[got] = f"{chain}{wrong}>{right};"
                    if right == "utf_8" and len(got) < len(t) and BEYOND.search(got):
                        after[got] = name
        level, first = after, False
    return found


def looks_multibyte(token: str) -> bool:
    """True if the token's bytes under some misreading are whole UTF-8: never trained on."""
    for raw in _bytes_of(token).values():
        try:
            got = raw.decode("utf_8")
        except UnicodeError:
            continue
        if got != token and not UNLIKELY.search(got):
            return True
    return False


def trainable(token: str) -> bool:
    """True of a token without lost or private-use characters that is no whole UTF-8 misread and has no half of it."""
    return token.isascii() or not ("\ufffd" in token or PRIVATE.search(token) or looks_multibyte(token) or HALF.search(token))


def _tokens(text: Column) -> Column:
    """The tokens of a column, and empty strings between blanks in a row."""
    return F.split(F.when(text.rlike("[\\xa0\\ue758-\\uf8fe]"), F.regexp_replace(text, JVM_PARTS, " ")).otherwise(text), " ")


def token_counts(df: DataFrame) -> DataFrame:
    """Every token of ``text`` and, where there is such a column, ``font_name`` (without prefix), over all rows of ``df``.

    token, clean (how often in texts without U+FFFD), times (in all, counted only beyond ASCII), fonts (in
    how many rows' font names without U+FFFD). Tokens are counted before they are shuffled.
    """
    beyond = F.col("token").rlike(JVM_BEYOND)
    text = F.col("text").cast("string")
    texts = df.select(F.explode(_tokens(text)).alias("token"), (~text.contains("\ufffd")).alias("whole")).where("token <> ''")
    out = texts.groupBy("token").agg(F.count_if("whole").alias("clean"), F.count("*").alias("times")).select("token", "clean", F.when(beyond, F.col("times")).otherwise(0).alias("times"), F.lit(0).cast("bigint").alias("fonts"))
    if "font_name" in df.columns:
        names = df.groupBy(F.regexp_replace(F.col("font_name").cast("string"), PREFIX.pattern, "").alias("name")).agg(F.count("*").alias("n"))
        fonts = names.select(F.explode(_tokens(F.col("name"))).alias("token"), "n", (~F.col("name").contains("\ufffd")).alias("whole")).where("token <> ''")
        fonts = fonts.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("fonts"))
        fonts = fonts.select("token", F.lit(0).cast("bigint").alias("clean"), F.when(beyond, F.col("n")).otherwise(0).alias("times"), "fonts")
        out = out.union(fonts).groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("times").alias("times"), F.sum("fonts").alias("fonts"))
    return checkpointed(out)


def _count(rows: DataFrame) -> CharModel:
    """Counts of token, n (times its characters count) and times (as a word beyond ASCII)."""

    def pieces(batch):
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        kept = [(t, n) for t, n, _ in rows if n]
        words = [(t, n) for t, _, n in rows if n and not unreadable(t)]
        return [t for t, _ in kept], [n for _, n in kept], [t for t, _ in words], [n for _, n in words]

    return count_chars(rows, pieces)


def train(counts: DataFrame, odd: DataFrame) -> tuple[CharModel, CharModel]:
    """The first model, of all clean tokens of the texts, and its part of ASCII tokens, which later ones share.

    ``odd`` are the tokens beyond ASCII as ``prepared`` gives them, among others.
    """
    plain = _count(counts.where(~F.col("token").rlike(JVM_BEYOND) & (F.col("clean") > 0)).select("token", F.col("clean").alias("n"), F.lit(0).alias("times")))
    n = F.when(F.col("trained"), F.col("clean")).otherwise(0)
    return plain + _count(odd.where(F.col("token").rlike(JVM_BEYOND)).select("token", n.alias("n"), "times")), plain


def retrain(judged: DataFrame, plain: CharModel, most: float) -> CharModel:
    """The second model: without tokens that some reading beats by ``most``.

    Tokens of font names count only here, and with the logarithm of their number: a few names make
    up most of them, damaged ones among them, so they can't vouch for themselves.
    """
    n = F.col("clean") + F.ceil(F.log2(F.col("fonts") + 1.0))
    return plain + _count(judged.select("token", F.when(F.col("trained") & (F.col("gain") < most), n).otherwise(0).cast("bigint").alias("n"), F.when(F.col("token").rlike(JVM_BEYOND), F.col("times")).otherwise(0).alias("times")))


def _parts(strings: list[str]) -> list[list[str]]:
    """``strings`` in parts of about AT_ONCE characters."""
    part = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings))) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(strings)]
    return [strings[a:b] for a, b in zip(cuts, cuts[1:])]


class Repairer:
    """Judges tokens with a model, a gate, a margin and a floor for what a reading must reach."""

    def __init__(self, model: CharModel, gate: float = -5.0, margin: float = 5.0, floor: float = -5.5, east: float = 0.0):
        self.model, self.gate, self.margin, self.floor, self.east = model, gate, margin, floor, east

    def state(self) -> tuple:
        return self.model.uni, self.model.bi, self.model.tri, self.model.word, self.gate, self.margin, self.floor, self.east

    @classmethod
    def of(cls, state: tuple) -> "Repairer":
        return cls(CharModel(*state[:4]), *state[4:])

    def best(self, tokens: list[str], gated: bool = True) -> list[tuple[str, str, float, float] | None]:
        """The likeliest other reading of each token: value, chain, gain, mean log probability."""
        return [found for part in _parts(tokens) for found in self._best(part, gated)]

    def _best(self, tokens: list[str], gated: bool) -> list[tuple[str, str, float, float] | None]:
        total, least, n = self.model.score(tokens)
        out: list[tuple[str, str, float, float] | None] = [None] * len(tokens)
        owner, cands, chains = [], [], []
        at = [i for i, t in enumerate(tokens) if gated and EAST.fullmatch(t)]
        usual = {i for i, run in zip(at, self.model.worst_run([tokens[i] for i in at])) if run >= self.east}
        for i, token in enumerate(tokens):
            if i in usual or gated and least[i] >= self.gate or token.isascii() or unreadable(token):
                continue
            for got, chain in readings(token).items():
                owner.append(i)
                cands.append(got)
                chains.append(chain)
        asked = sorted(set(owner))
        forms = [(i, [p for p in f.split(" ") if p]) for i in asked for f in plain_forms(tokens[i])]
        sums = iter(self.model.score([p for _, f in forms for p in f])[0])
        for i, f in forms:
            total[i] = max(total[i], sum(next(sums) for _ in f)) if f else total[i]  # what looks alike is no wrong decoding
        if not cands:
            return out
        index: dict[str, int] = {}  # each different reading is scored once
        which = np.fromiter((index.setdefault(c, len(index)) for c in cands), np.int64, len(cands))
        score, _, m = self.model.score(list(index))
        known = lambda words: np.log(np.array([self.model.seen(w) for w in words]) + 1.0)
        at, each = np.unique(owner, return_index=True, return_counts=True)[1:]
        gain = score[which] - np.repeat(total[asked], each)
        gain += np.clip(known(index)[which] - np.repeat(known(tokens[i] for i in asked), each), -6.0, 6.0)  # words seen as such speak for themselves
        for k in (a + int(gain[a : a + n].argmax()) for a, n in zip(at, each)):
            out[owner[k]] = (cands[k], chains[k], float(gain[k]), float(score[which[k]] / m[which[k]]))
        return out

    def worth(self, found: tuple[str, str, float, float] | None) -> float:
        """The gain that counts against the margin. A reading in characters the corpus hardly
        knows counts half, and only if it joins bytes shown apart or is whole UTF-8."""
        if found is None:
            return NONE
        if found[3] >= self.floor:
            return found[2]
        wrong, right = found[1].rstrip(";").rpartition(";")[2].split(">")
        return found[2] / 2 if right == "utf_8" or right in MULTI and wrong not in MULTI else NONE

    def accepts(self, found: tuple[str, str, float, float] | None) -> bool:
        return self.worth(found) >= self.margin

    def hits(self, tokens: list[str]) -> list[list[float]]:
        """For each token and each of MARGINS the share of all ways in which it is damaged and found so under it."""
        out = []
        for k in range(0, len(tokens), TOGETHER):
            forms = [damaged_forms(t) for t in tokens[k : k + TOGETHER]]
            worth = iter([self.worth(found) for found in self.best([d for ds in forms for d in ds])])
            for ds in forms:
                got, share = np.array([next(worth) for _ in ds]), np.array(list(ds.values()))
                out.append([float(share[got >= m].sum()) for m in MARGINS])
        return out

    def judge(self, tokens: list[str]) -> list[tuple[str, str] | None]:
        """The restored value of each token and the chain that gives it, or None if nothing is wrong with it."""
        return [(found[0], found[1]) if self.accepts(found) else None for found in self.best(tokens)]

    def gains(self, tokens: list[str]) -> list[float]:
        """By how much some other reading, likely in itself or not, beats each token."""
        return [NONE if found is None else found[2] for found in self.best(tokens)]


def damage(token: str, rng: random.Random) -> str | None:
    """The token as a wrong decoder would show it; None if this chain leaves it as it is."""
    right, wrong = rng.choice(WRITTEN_IN), rng.choice(SHOWN_AS)
    if rng.random() < 0.5:
        right = "utf_8"
    try:
        got = token.encode(right).decode(wrong)
    except UnicodeError:
        return None
    return got if got != token and "\x00" not in got else None


def damaged_once(token: str) -> str | None:
    """``token`` damaged on purpose, always in the same one of ``damaged_forms``; None if that leaves it as it is or can't be judged."""
    got = damage(token, random.Random(xxhash.xxh32_intdigest(token)))
    return None if got is None or unreadable(got) else got


def damaged_forms(token: str) -> dict[str, float]:
    """``token`` damaged in every way, each form with its share of all ways, in half of which it is written as UTF-8 (see ``damage``)."""
    raws: dict[bytes, float] = {}
    for right in WRITTEN_IN:
        try:
            raw = token.encode(right)
        except UnicodeError:
            continue
        raws[raw] = raws.get(raw, 0.0) + (0.5 * (right == "utf_8") + 0.5 / len(WRITTEN_IN)) / len(SHOWN_AS)
    out: dict[str, float] = {}
    for raw, share in raws.items():
        for wrong in SHOWN_AS:
            try:
                got = raw.decode(wrong)
            except UnicodeError:
                continue
            if got != token and "\x00" not in got and not unreadable(got):
                out[got] = out.get(got, 0.0) + share
    return out


def east_forms(token: str) -> list[str]:
    """What ``token`` turns into, wholly of Han, kana and ASCII, if it is misread as GBK or Shift-JIS from any encoding."""
    raws, shown = set(), set()
    for right in WRITTEN_IN:
        try:
            raws.add(token.encode(right))
        except UnicodeError:
            continue
    for raw in raws:
        for wrong in ("gbk", "cp932"):
            try:
                got = raw.decode(wrong)
            except UnicodeError:
                continue
            if got != token and EAST.fullmatch(got):
                shown.add(got)
    return sorted(shown)


def _each(rows: DataFrame, make, new: str, judge: "Repairer | None" = None, spread: bool = False) -> DataFrame:
    """``rows`` (token first) with the columns ``new`` that ``make(judge, column)`` gives for each batch, where ``column`` gives the
    values of a column by its name. ``spread`` out so that a task has about TASK_TOKENS, else in the tasks they come in."""
    sc = rows.sparkSession.sparkContext
    sent = judge and sc.broadcast(judge.state())
    if spread:
        rows = rows.repartition(max(sc.defaultParallelism, -(-rows.count() // TASK_TOKENS)), "token")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), new])
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        own = sent and Repairer.of(sent.value)
        for batch in batches:
            made = make(own, lambda n, b=batch: b.column(b.schema.get_field_index(n)).to_pylist())
            yield pa.record_batch([*batch.columns, *made], names=names)

    return checkpointed(rows.mapInArrow(run, schema))


def prepared(counts: DataFrame) -> DataFrame:
    """Tokens beyond ASCII and those of font names, with all that no model is needed for.

    trained (see ``trainable``), held (the limits are validated on it: a trainable token beyond ASCII of texts without
    U+FFFD), and of held ones the share of ways that damage them, and their forms of Han and kana.
    """

    def make(_, column):
        tokens = column("token")
        good = [trainable(t) for t in tokens]
        held = [g and n > 0 and not t.isascii() for t, n, g in zip(tokens, column("clean"), good)]
        ways = [sum(damaged_forms(t).values()) if h else 0.0 for t, h in zip(tokens, held)]
        forms = [east_forms(t) if h else [] for t, h in zip(tokens, held)]
        return pa.array(good, pa.bool_()), pa.array(held, pa.bool_()), pa.array(ways, pa.float64()), pa.array(forms, pa.list_(pa.string()))

    return _each(counts.where(F.col("token").rlike(JVM_BEYOND) | (F.col("fonts") > 0)), make, "trained boolean, held boolean, ways double, forms array<string>", spread=True)


def measured(rows: DataFrame, model: CharModel) -> DataFrame:
    """``rows`` with the mean log probability of held tokens, the greatest of the least ones of them damaged in all ways, and the worst run of each form."""

    def make(own, column):
        tokens, held = column("token"), column("held")
        forms = [fs if h else [] for fs, h in zip(column("forms"), held)]
        total, _, n = own.model.score([t for t, h in zip(tokens, held) if h])
        mean = iter((total / n).tolist())
        damaged = [list(damaged_forms(t)) if h else [] for t, h in zip(tokens, held)]
        least = [max(float(own.model.score(part)[1].max()) for part in _parts(ds)) if ds else None for ds in damaged]
        runs = iter(own.model.worst_run([f for fs in forms for f in fs]).tolist())
        return pa.array([next(mean) if h else None for h in held], pa.float64()), pa.array(least, pa.float64()), pa.array([[next(runs) for _ in fs] for fs in forms], pa.list_(pa.float64()))

    return _each(rows, make, "mean double, least double, runs array<double>", Repairer(model))


def _part(logp: Column) -> Column:
    return F.floor(logp * PARTS_OF_LOGP)


def _weight() -> Column:
    """What a held token counts: a frequent one more, but none outweighs all others."""
    return F.log2(F.col("clean") + 1.0)


def _quantile(at: np.ndarray, weight: np.ndarray, q: float) -> int:
    """The least of the ascending ``at`` up to which there is a share of ``q`` of all weight."""
    sums = np.cumsum(weight)
    return int(at[min(len(at) - 1, np.searchsorted(sums, q * sums[-1]))])


def limits(rows: DataFrame, model: CharModel) -> tuple[Repairer, Column]:
    """The floor, gate and east gate, from all held tokens of ``rows`` (see ``measured``), and which of them the margin is validated on.

    The oddest tenth of them may be damaged already and is left out. The gate lies above what every damaged token reaches,
    at -1 or more. The east gate is what the worst run of a token of Han and kana lies below if it was shown in the wrong encoding:
    above all but the likeliest in a thousand of the different forms, which are readings that happen to be words; 0 (every token
    is judged) where too few can be misread so. Only distributions over parts of a log probability come to the driver.
    """
    judge, held = Repairer(model), rows.where("held")
    dist = held.groupBy(_part(F.col("mean")).alias("at")).agg(F.sum(_weight()).alias("w"), F.max("least").alias("least"), F.sum("ways").alias("pairs")).orderBy("at").toArrow()
    at, w, least, pairs = (dist[k].to_numpy() for k in ("at", "w", "least", "pairs"))
    if not len(at):
        return judge, F.lit(False)
    usual = _quantile(at, w, 0.1)
    kept = at >= usual
    if pairs[kept].sum() < LEAST_PAIRS:
        return judge, F.lit(False)
    judge.floor = _quantile(at[kept], w[kept], 0.01) / PARTS_OF_LOGP - 2.5
    judge.gate = float(max(-1.0, np.nanmax(least[kept]) + 0.25))
    forms = held.where(_part(F.col("mean")) >= usual).select(F.explode(F.arrays_zip("forms", "runs")).alias("f")).select(F.col("f.forms").alias("form"), _part(F.col("f.runs")).alias("at")).distinct()
    forms = forms.join(held.select(F.col("token").alias("form")), "form", "left_anti").groupBy("at").agg(F.count("*").alias("n")).orderBy("at").toArrow()
    at, n = forms["at"].to_numpy(), forms["n"].to_numpy()
    judge.east = min(0.0, (_quantile(at, n, 0.999) + 1) / PARTS_OF_LOGP + 0.5) if n.sum() >= 200 else 0.0
    return judge, F.coalesce(F.col("held") & (_part(F.col("mean")) >= usual), F.lit(False))


def judged_tokens(rows: DataFrame, judge: Repairer, spread: bool = False) -> DataFrame:
    """``rows`` with the likeliest other reading of those ``asked``, and for each of MARGINS the share of ways in which the ``kept`` ones are damaged and found so (hits)."""

    def make(own, column):
        tokens, asked = column("token"), column("asked")
        best = iter(own.best([t for t, a in zip(tokens, asked) if a]))
        found = [next(best) if a else None for a in asked]
        hits = iter(own.hits([t for t, k in zip(tokens, column("kept")) if k]))
        return (
            pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.string()), pa.array([f[2] if f else NONE for f in found], pa.float64()), pa.array([own.worth(f) for f in found], pa.float64()),
            pa.array([next(hits) if k else None for k in column("kept")], pa.list_(pa.float64())), pa.array([any(map(str.isalpha, t)) for t in tokens], pa.bool_()),
        )

    return _each(rows, make, "fixed string, chain string, gain double, worth double, hits array<double>, worded boolean", judge, spread)


def best_margin(judged: DataFrame, before: float) -> float:
    """The least margin within 0.004 of the best F1 on all kept tokens, as they are and damaged in all ways, half and half (the clean ones
    still hold some damaged ones, which weigh on the larger margins); ``before`` if there are none."""
    w = _weight()
    hit = [F.sum(w * F.col("hits")[k]) / F.sum(w * F.col("ways")) for k in range(len(MARGINS))]
    false = [F.sum(F.when(F.col("worth") >= m, w).otherwise(0.0)) / F.sum(w) for m in MARGINS]
    got = judged.where("kept").agg(*hit, *false).first()
    if got[0] is None:
        return before
    tried = [(2 * hit / (hit + 1 + false), m) for m, hit, false in zip(MARGINS, got, got[len(MARGINS) :])]
    top = max(tried)[0]
    return min(m for f1, m in tried if f1 >= top - 4e-3)


VERDICT = ["token", "fixed", "chain", "lost", "worded"]


def _accepted(judged: DataFrame, margin: float) -> DataFrame:
    """The verdicts on the damaged tokens of ``judged``."""
    fix, lost = F.col("worth") >= margin, F.col("token").contains("\ufffd")
    made = {"fixed": F.when(fix, F.col("fixed")).otherwise(F.col("token")), "chain": F.when(fix, F.col("chain")).otherwise("lost;"), "lost": ~fix}
    return judged.where(F.col("asked") & (fix | lost)).withColumns(made).select(*VERDICT)


@dataclass
class Fitted:
    """The judge, and its verdicts on the damaged ones of the tokens it was fitted on."""

    judge: Repairer
    found: DataFrame


def fit_counts(counts: DataFrame) -> Fitted:
    """Train on all tokens of ``counts`` twice, the second time without what the first model rejects.

    The limits are validated on all held tokens, where these lie. What the first model prefers
    to every other reading by more than FAR isn't asked for again.
    """
    tokens = prepared(counts)
    columns = tokens.columns
    model, plain = train(counts, tokens)
    seen = measured(tokens, model)
    first, kept = limits(seen, model)
    judged = judged_tokens(seen.select(*columns, kept.alias("kept"), F.lit(True).alias("asked")), first)
    first.margin = best_margin(judged, first.margin)
    most = first.margin + SURE
    model = retrain(judged, plain, most)
    asked = (F.col("gain") > -FAR) & (F.col("times") > 0) | F.col("token").contains("\ufffd")
    seen = measured(judged.withColumn("held", F.col("held") & (F.col("gain") < most)).select(*columns, asked.alias("asked")), model)
    second, kept = limits(seen, model)
    judged = judged_tokens(seen.select(*columns, kept.alias("kept"), "asked").where("kept or asked"), second)
    second.margin = best_margin(judged, second.margin)
    return Fitted(second, _accepted(judged, second.margin))


def fit(df: DataFrame) -> Repairer:
    """Fit on the texts and font names of all rows of ``df``."""
    return fit_counts(token_counts(df)).judge


def verdicts(tokens: DataFrame, judge: Repairer) -> DataFrame:
    """The damaged tokens of ``tokens``: token, fixed, chain, lost and worded.

    ``lost`` tokens hold U+FFFD and are else left as they are; ``worded`` ones hold a letter. Each different token is judged once.
    """
    rows = tokens.select("token", F.lit(False).alias("kept"), F.lit(True).alias("asked"))
    return _accepted(judged_tokens(rows, judge, spread=True), judge.margin)


def damaged_tokens(df: DataFrame, judge: Repairer | None = None) -> DataFrame:
    """The verdicts of all damaged tokens of ``df`` (text, perhaps font_name); fitted on ``df`` if there is no judge."""
    counts = token_counts(df)
    return fit_counts(counts).found if judge is None else verdicts(counts.where("times > 0").select("token"), judge)


def with_verdicts(rows: DataFrame, bare: str, found: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` once for each damaged token of the column ``bare``, with the token's verdict.

    The verdicts are broadcast if they are few (their size is asked first), else each is repeated for SALTS parts
    of the rows, so that a token in a third of all rows meets them in many tasks.
    """
    chars = found.agg(F.sum(F.length("token") + F.length("fixed") + F.length("chain"))).first()[0] or 0
    each = rows.withColumn("_t", F.explode_outer(_tokens(F.col(bare))))
    if how == "inner":
        each = each.where(F.col("_t").rlike(JVM_BEYOND))
    private = F.col(bare).rlike("[\ue000-\uf8ff]")  # a lost character among such ones says nothing by itself
    if chars <= BROADCAST_CHARS:
        joined = each.join(F.broadcast(found), F.col("_t") == found["token"], how)
    else:
        salted = found.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.withColumn("_m", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        joined = each.join(salted.hint("merge"), (F.col("_t") == salted["token"]) & (F.col("_m") == F.col("_s")), how).drop("_s", "_m")
    said = F.col("token").isNotNull() & ~(F.col("lost") & ~F.col("worded") & private)
    return joined.where(said) if how == "inner" else joined.withColumn("hit", F.coalesce(said, F.lit(False)))


FOUND = "doc string, page_num int, span_seq bigint, field string, value string, restored string, chains string, whole boolean"


def restore(text: str, fixes: dict[str, str]) -> str:
    return "".join(fixes.get(t, t) for t in PARTS.split(text))


def repair_spans(spans: DataFrame, judge: Repairer | None = None) -> DataFrame:
    """Spans whose text or font_name was misread, one row for each field, with the restored value.

    ``spans`` needs doc, page_num, span_seq, text and font_name; other columns are ignored.
    Nulls and empty values are no cases. Repeated rows give one result; of different values under one key
    the least found one. ``whole`` is false where bytes were lost, so that U+FFFD stands in the restored
    value. Only tokens, and of the rows the found ones, are shuffled.
    """
    keys = ["doc", "page_num", "span_seq"]
    cols = [F.col("doc").cast("string"), F.col("page_num").cast("int"), F.col("span_seq").cast("bigint"), F.col("text").cast("string"), F.col("font_name").cast("string")]
    spans = spans.select(*cols)
    found = damaged_tokens(spans, judge)
    field = lambda name, bare: F.struct(F.lit(name).alias("field"), F.col(name).alias("value"), bare.alias("bare"))
    fields = F.filter(F.array(field("text", F.col("text")), field("font_name", F.regexp_replace("font_name", PREFIX.pattern, ""))), lambda f: f["value"].rlike(JVM_BEYOND))
    each = spans.where(F.col("text").rlike(JVM_BEYOND) | F.col("font_name").rlike(JVM_BEYOND)).select(*keys, F.inline(fields))
    hits = with_verdicts(each, "bare", found)
    hits = hits.groupBy(*keys, "field", "value", "bare").agg(F.sort_array(F.collect_set(F.struct("token", "fixed", "chain"))).alias("fixes"))
    once = hits.groupBy(*keys, "field").agg(F.min(F.struct("value", "bare", "fixes")).alias("m")).select(*keys, "field", "m.*")

    def run(batches):
        for batch in batches:
            doc, page, seq, name, value, bare, fixes = (c.to_pylist() for c in batch.columns)
            restored = [v[: len(v) - len(b)] + restore(b, {f["token"]: f["fixed"] for f in fs}) for v, b, fs in zip(value, bare, fixes)]
            chains = [" ".join(dict.fromkeys(f["chain"] for f in fs)) for fs in fixes]
            made = (pa.array(restored, pa.string()), pa.array(chains, pa.string()), pa.array(["\ufffd" not in r for r in restored], pa.bool_()))
            yield pa.record_batch([*batch.columns[:5], *made], names=["doc", "page_num", "span_seq", "field", "value", "restored", "chains", "whole"])

    return once.mapInArrow(run, FOUND)
