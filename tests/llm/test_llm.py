import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import chunking, consistent_form, encoding_repair, keyword_spam, mixing, packing, quality, queries, sentences
from spanforge.llm.charmodel import BI, TRI, UNI, WORD, CharModel
from spanforge.llm import lines as block_lines
from spanforge.llm.lines import blocks, in_blocks, line_texts, measures
from spanforge.llm.lookalikes import compatibility
from spanforge.llm.quality_holdout import HOLDOUT
from spanforge.llm.tokens import encoder, with_tokens

SPAN = "doc string, page_num int, span_seq bigint, text string, font_name string, error string, value string"
LINE = "doc string, line_no int, spans array<struct<text string, bbox struct<t float, r float, b float, l float>, font_name string, font_size float, page_num int>>, text string"
FR = "La théorie précise le déphasage près du bord. Le débit répète l’énergie dissipée très tôt. Néanmoins, la côte réduit la durée, après une étape. Cette méthode améliore le réseau à l’arrêt."
RU = "Новый датчик меняет расход воды после опыта. Комиссия показывает старый метод на рисунке. Однако река ограничивает общий результат."
EN = "The shared kiln limits the sparse field. A weak signal follows the open channel, and the tower precedes the bridge."


def lines(spark, docs):
    """docs: name to lines (a string, a (string, page) pair, or None for a blank line)."""
    rows = []
    for d, ls in docs.items():
        for i, t in enumerate(ls):
            t, page = t if isinstance(t, tuple) else (t, 1)
            rows.append((d, i, [] if t is None else [(t, None, "F", 10.0, page)], "clash"))
    return spark.createDataFrame(rows, LINE)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        words = rng.choice((FR, RU, EN)).split(" ")
        a = rng.randrange(max(1, len(words) - 5))
        rows.append(("d%d" % (i % 50), 1, i, " ".join(words[a : a + 6]), rng.choice(["Helvetica", "Lumière-Légère", "Берег-Светлый", None]), "e", "v"))
    return spark.createDataFrame(rows, SPAN)


# problem 1


def test_damage_is_found_and_restored(spark, corpus):
    judge = encoding_repair.fit(corpus)
    cases = {
        0: "précise le déphasage".encode().decode("latin-1"), 1: "précise le déphasage".encode().decode("cp1252"), 2: "расход воды".encode().decode("cp1251"), 3: "après une étape".encode("cp1252").decode("mac_roman"),
        4: "réduit la durée".encode().decode("cp1252").encode().decode("cp1252"), 5: "расход воды".encode("koi8_r").decode("cp1251"),
    }
    clean = {100: "précise le déphasage", 101: "расход воды", 102: "", 103: None, 104: "x" * 200_000, 105: "le\xa0débit répète"}
    rows = [("t", 1, k, v, "LumiÃ¨re-LÃ©gÃ¨re" if k == 0 else None, None, None) for k, v in {**cases, **clean}.items()] + [("t", 1, 200, "r�p�te", None, None, None)]
    df = spark.createDataFrame(rows + rows[:2], SPAN)
    got = {(r.span_seq, r.field): r for r in encoding_repair.repair_spans(df, judge).collect()}
    assert {k for k, f in got if f == "text"} == {*cases, 200} and ("font_name" in {f for _, f in got})
    assert got[(0, "text")].restored == "précise le déphasage" and got[(2, "text")].restored == "расход воды" and got[(3, "text")].restored == "après une étape" and got[(4, "text")].restored == "réduit la durée"
    assert got[(0, "font_name")].restored == "Lumière-Légère" and got[(0, "text")].whole and not got[(200, "text")].whole


def test_damage_beside_and_in_private_use(spark, corpus):
    for c in map(chr, range(0xE000, 0xF900)):  # what parts tokens is what no codec gives
        given = any(c.encode(n, "ignore") for n in encoding_repair.SHOWN_AS)
        assert given != bool(encoding_repair.PARTS.fullmatch(c)), hex(ord(c))
    judge = encoding_repair.fit(corpus)
    er = "Новый датчик меняет расход".encode("cp1251").decode("mac_roman")
    word = "précise".encode().decode("latin_1")
    assert "\uf8ff" in er
    bad = {er: "Новый датчик меняет расход", "\uf0b7 La " + word: "\uf0b7 La précise", "\uf0b7" + word: "\uf0b7précise", "\uf0b7 th\ufffdorie": "\uf0b7 th\ufffdorie"}
    good = ["\uf0b7 La théorie précise", "\uf8ff", "\uf8ff Helvetica", "\uf047\uf024 \ufffd\uf03f", "\ue047\ue024\ue03f \ue02c\ue06e", "\uf0b7"]
    rows = [("x", 1, i, t, None, None, None) for i, t in enumerate([*bad, *good])]
    got = {r.value: r.restored for r in encoding_repair.repair_spans(spark.createDataFrame(rows, SPAN), judge).collect()}
    assert got == bad


def test_verdicts_meet_rows_in_a_shuffle_too(spark, corpus, monkeypatch):
    judge = encoding_repair.fit(corpus)
    bad = "précise le déphasage".encode().decode("latin-1")
    df = spark.createDataFrame([("t", 1, k, bad if k % 3 else "La théorie", None, None, None) for k in range(60)], SPAN)
    few = sorted(encoding_repair.repair_spans(df, judge).collect())
    monkeypatch.setattr(encoding_repair, "BROADCAST_CHARS", -1)
    assert sorted(encoding_repair.repair_spans(df, judge).collect()) == few and len(few) == 40
    rows = df.select("span_seq", "text")
    seen = encoding_repair.with_verdicts(rows, "text", encoding_repair.damaged_tokens(df, judge), "left").groupBy("span_seq").agg(F.max("hit").alias("hit")).collect()
    assert {r.span_seq for r in seen if r.hit} == {k for k in range(60) if k % 3} and len(seen) == 60


def test_different_values_under_one_key(spark, corpus):
    judge = encoding_repair.fit(corpus)
    a, b = ("précise le déphasage".encode().decode(c) for c in ("latin-1", "cp1252"))
    df = spark.createDataFrame([("t", None, 1, a, None, None, None), ("t", None, 1, b, None, None, None), (None, 1, None, a, None, None, None)], SPAN)
    got = encoding_repair.repair_spans(df, judge).collect()
    assert len(got) == 2 and {r.value for r in got} == {min(a, b), a}


def test_counts_of_tokens(spark):
    df = spark.createDataFrame([("t", 1, 0, "a é é\xa0b", "ABCDEF+Né Sans", None, None), ("t", 1, 1, "é x\ufffd", "Né", None, None), ("t", 1, 2, None, None, None, None)], SPAN)
    got = {r.token: (r.clean, r.times, r.fonts) for r in encoding_repair.token_counts(df).collect()}
    assert got == {"a": (1, 0, 0), "é": (1, 2, 0), "é\xa0b": (1, 1, 0), "x\ufffd": (0, 1, 0), "Né": (0, 2, 2), "Sans": (0, 0, 1)}


def test_repair_of_an_empty_table(spark, corpus):
    assert encoding_repair.repair_spans(corpus.limit(0)).count() == 0


def test_held_out_accuracy_of_repair(spark, corpus):
    judge, rng = encoding_repair.fit(corpus), random.Random(9)
    words = sorted({w for t in (FR, RU) for w in t.split(" ") if not w.isascii()})
    bad = [(w, d) for w in words for _ in range(4) if (d := encoding_repair.damage(w, rng)) and d != w]
    found = judge.best([d for _, d in bad])
    assert sum(judge.accepts(f) for f in found) / len(bad) > 0.85
    assert sum(judge.accepts(f) for f in judge.best(words)) == 0


def many_words():
    """Some 3,000 Russian words of 30 rows each, and some 4,000 less regular French ones of one row each."""
    rng = random.Random(5)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randrange(3, 7)))
    usual = sorted({word(["во", "да", "ре", "ка", "но", "вый", "по", "сле", "ра", "ме", "ня", "ет", "ли", "ни"]) for _ in range(3300)})
    rare = sorted({word([c + v for c in "bcdfglmnprstvz" for v in "aeiouéèô"]) + "é" for _ in range(4000)})
    return [(w, 30 if w in set(usual) else 1) for w in usual + rare]


def floor_of(words, model):
    """The floor by all of ``words``, each with the logarithm of its number, without the oddest tenth."""
    total, _, n = model.score([w for w, _ in words])
    mean, weight = total / n, np.log2(np.array([k for _, k in words]) + 1.0)
    at = np.argsort(mean)
    mean, weight = mean[at], weight[at]
    share = np.cumsum(weight) / weight.sum()
    kept = np.searchsorted(share, 0.1)
    share = np.cumsum(weight[kept:]) / weight[kept:].sum()
    return mean[kept:][np.searchsorted(share, 0.01)] - 2.5


def test_limits_come_from_all_tokens(spark):
    words = many_words()
    assert len(words) > 6000
    counts = spark.createDataFrame([(w, n, n, 0) for w, n in words], "token string, clean bigint, times bigint, fonts bigint")
    judge = encoding_repair.fit_counts(counts).judge
    assert judge.floor == pytest.approx(floor_of(words, judge.model), abs=0.003)
    damaged = [d for w, _ in words for d in [encoding_repair.damaged_once(w)] if d]
    found = judge.best(damaged)
    assert judge.gate >= -1 and len(damaged) > 1000 and sum(map(judge.accepts, found)) > 0.9 * len(damaged)


def test_limits_are_the_same_each_time_and_set_without_tokens(spark):
    counts = spark.createDataFrame([(w, n, n, 0) for w, n in many_words()[:300]], "token string, clean bigint, times bigint, fonts bigint")
    a, b = (encoding_repair.fit_counts(c).judge for c in (counts, counts.repartition(3)))
    assert (a.floor, a.gate, a.margin, a.east) == (b.floor, b.gate, b.margin, b.east)
    none = encoding_repair.fit_counts(counts.limit(0)).judge
    assert (none.floor, none.gate, none.margin, none.east) == (-5.5, -5.0, 5.0, 0.0)


# problem 3


def test_form_of_spans_is_asked_of_a_judge_fitted_on_all_tokens(spark, tmp_path, monkeypatch):
    words, fitted = many_words(), []
    spans = [("d", 1, i, t, None, None, None) for i, t in enumerate([w for w, n in words for _ in range(n)] + ["de\ufb01nition", "de\ufb01nition r\ufffdp\ufffdte"])]
    spark.createDataFrame(spans, SPAN).write.parquet(f"{tmp_path}/text_spans.parquet")
    fit = encoding_repair.fit_counts
    monkeypatch.setattr(encoding_repair, "fit_counts", lambda counts: fitted.append(fit(counts)) or fitted[-1])
    assert [r.span_seq for r in queries.p3_found(spark, str(tmp_path)).collect()] == [len(spans) - 2]
    assert fitted[0].judge.floor == pytest.approx(floor_of([*words, ("de\ufb01nition", 1)], fitted[0].judge.model), abs=0.003)


def every_damage(word):
    """``word`` under every pair of an encoding it may be written in and one it may be shown in, with the share of each."""
    for right in encoding_repair.WRITTEN_IN:
        for wrong in encoding_repair.SHOWN_AS:
            try:
                got = word.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if got != word and "\0" not in got and not encoding_repair.unreadable(got):
                yield got, ((right == "utf_8") / 2 + 1 / 2 / len(encoding_repair.WRITTEN_IN)) / len(encoding_repair.SHOWN_AS)


def test_form_of_spans_is_judged_under_limits_from_every_damage_of_every_token(spark, tmp_path, monkeypatch):
    words, measured, judged = [w for w, _ in many_words()[::20]], [], []
    spans = [("d", 1, i, t, None, None, None) for i, t in enumerate([*words, "de\ufb01nition"])]
    spark.createDataFrame(spans, SPAN).write.parquet(f"{tmp_path}/text_spans.parquet")
    measure, judge = encoding_repair.measured, encoding_repair.judged_tokens
    monkeypatch.setattr(encoding_repair, "measured", lambda rows, model: measured.append((model, measure(rows, model))) or measured[-1][1])
    monkeypatch.setattr(encoding_repair, "judged_tokens", lambda rows, j, **kw: judged.append((j, judge(rows, j, **kw))) or judged[-1][1])
    assert [r.span_seq for r in queries.p3_found(spark, str(tmp_path)).collect()] == [len(words)]
    assert len(measured) == len(judged) == 2
    for model, rows in measured:
        least = {r.token: r.least for r in rows.where("held").collect()}
        assert len(least) > 300 and least == pytest.approx({w: max(model.score([d for d, _ in every_damage(w)])[1]) for w in least})
    for j, rows in judged:
        kept = rows.where("kept").collect()
        assert len(kept) > 300
        for r in kept[::10]:
            damaged = list(every_damage(r.token))
            worth = [j.worth(f) for f in j.best([d for d, _ in damaged])]
            assert r.ways == pytest.approx(sum(s for _, s in damaged))
            assert r.hits == pytest.approx([sum(s for (_, s), w in zip(damaged, worth) if w >= m) for m in encoding_repair.MARGINS])


def test_worst_run_of_a_single_short_token():
    model = CharModel(*(np.zeros(n, np.float32) for n in (UNI, BI, TRI, WORD)))
    assert model.worst_run(["漢"]) == pytest.approx(model.worst_run(["漢", "漢字漢字漢字"])[:1])


@pytest.mark.parametrize("text,want", [
    ("Ｆｕｌｌ ｗｉｄｔｈ １２", "Full width 12"), ("ﬁnd the oﬃce", "find the office"), ("re\u0301seau", "réseau"), ("か\u3099", "が"), ("soft\u00adhy\u200bphen\ufeff", "softhyphen"), ("no\u00a0break\u2007blank", "no break blank"),
    ("Nеvа", "Neva"), ("Oпыт", "Опыт"), ("cοnditiοn", "condition"), ("τηv εκτίμηση", "την εκτίμηση"), ("sensօr ɑrchive", "sensor archive"), ("well‑known", "well-known"), ("５Å", "5Å"), ("Ⅳ ㎏", "IV kg"), ("ﻻ", "لا"), ("ｾﾝｻｰ", "センサー"), ("セン一サー", "センーサー"), ("\u0958 cafe\u0301", "\u0915\u093c café"), ("sensօr հօս", "sensor hou"),
])
def test_one_form(spark, text, want):
    df = spark.createDataFrame([("d", 1, 0, text, None, None, None)], SPAN)
    r = consistent_form.consistent_form(df).first()
    assert (r.normalized, r.changed) == (want, True)


@pytest.mark.parametrize("text", ["plain", "", None, "Река и мост", "10 Ω and β-phase", "μm", "CO₂ on 31 m² ½", "“quoted” – ‘x’ • y", "了先前的估计，港口！", "डॉ. ड़ क्‍ष", "\u0958\u095f", "հօս", "քաղաք հօս in", "v2.7版", "XRD по данным", "ของน้ำ", "a) Граница слоя", "■ □", "x" * 300_000])
def test_ordinary_text_stays(spark, text):
    df = spark.createDataFrame([("d", 1, 0, text, None, None, None)], SPAN)
    r = consistent_form.consistent_form(df.withColumn("normalized", F.lit("clash"))).first()
    assert not r.changed and r.text == text


def test_compatibility_table_has_no_overlap():
    one, to, many = compatibility()
    assert len(one) == len(to) == len(set(one)) and not set(one) & set(many)


def test_form_of_empty_table_and_repeats(spark):
    df = spark.createDataFrame([("d", 1, 0, "ﬁ", None, None, None)] * 3, SPAN)
    assert consistent_form.consistent_form(df).where("changed").count() == 3 and consistent_form.consistent_form(df.limit(0)).count() == 0


def test_only_texts_that_can_change_leave_the_jvm(spark):
    rng = random.Random(2)
    signs = "aé Ωж一ーセ力ณเ\u0e4d\u0e32\u0301\u200b\u200d\u0958\uff21\uff01。ﬁսо\u2011 ²’"
    df = spark.createDataFrame([("d", 1, i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 5))), None, None, None) for i in range(3000)], SPAN)
    all_of_it = consistent_form._in_duckdb(consistent_form._columns(df))
    assert sorted(all_of_it.where("changed").collect()) == sorted(consistent_form.changed_spans(df).collect())
    assert sorted(all_of_it.collect()) == sorted(consistent_form.consistent_form(df).collect())


# problem 2


def test_quality_of_checked_documents(spark, data):
    docs = {f"h{i}": ls for i, (_, ls) in enumerate(HOLDOUT)} | {"empty": [None, None], "blank": [""]}
    df = lines(spark, docs)
    more = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/text_lines.parquet").select("doc", "line_no", "spans", F.lit("clash").alias("text"))
    got = {r.doc: r for r in quality.document_quality(df.union(df.limit(20)).union(more)).collect()}
    assert set(docs) <= set(got)
    right = sum(got[f"h{i}"].kind == k for i, (k, _) in enumerate(HOLDOUT))
    assert right / len(HOLDOUT) >= 0.7  # snippets of a few lines, by trees fitted on a small corpus
    assert got["empty"].kind == "junk" and got["empty"].words == 0 and got["empty"].probability == 1.0
    assert got["h0"].words == len(" ".join(HOLDOUT[0][1]).split()) and 0 < got["h0"].common_share < 1
    assert quality.document_quality(df.limit(0)).count() == 0


def test_reliability_on_documents_checked_by_hand(spark, data):
    """Judged by trees fitted without them; the figures are those of the README."""
    import hashlib

    from quality_labels import DRAWN, JUNK, LIST, TABLE

    whole = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/text_lines.parquet")
    names = sorted((r.doc for r in whole.select("doc").distinct().collect()), key=lambda d: hashlib.md5(d.encode()).hexdigest())[:DRAWN]
    truth = dict.fromkeys(names, "prose") | {n + ".pdf": k for k, ns in (("list", LIST), ("table", TABLE), ("junk", JUNK)) for n in ns}
    assert len(truth) == DRAWN
    got = {r.doc: r for r in quality.document_quality(whole, spark.createDataFrame([(n,) for n in names], "doc string")).collect() if r.doc in truth}
    right = np.array([got[d].kind == k for d, k in truth.items()])
    p = np.array([got[d].probability for d in truth])
    print("accuracy", right.mean(), "mean probability", p.mean(), "Brier", float(np.mean((p - right) ** 2)))
    assert right.mean() > 0.98 and abs(p.mean() - right.mean()) < 0.06


def test_index_lines_are_entries():
    model = CharModel(*(np.ones(n, np.float32) for n in (UNI, BI, TRI, WORD)))
    at = {n: i for i, n in enumerate(quality.SUMS)}
    index, cells, long, short = quality.line_sums(["Canal, 18, 79, 101-128", "Harsk 18 79 101", "1. " + "word " * 100, "1. word"], model)
    assert index[at["marker"]] == 1 and index[at["c_table"]] == 0 and index[at["c_marker"]] == 22
    assert cells[at["c_table"]] == 15 and cells[at["marker"]] == 0 and 0 < long[at["marker"]] < 0.5 < short[at["marker"]]


def test_mending_by_verdicts_or_by_the_judge(spark, corpus):
    judge = encoding_repair.fit(corpus)
    bad = "La " + "précise".encode().decode("latin-1") + " ﬁn"
    fixes = {r.token: r.fixed for r in encoding_repair.damaged_tokens(spark.createDataFrame([(bad,)], "text string"), judge).collect()}
    assert quality.Mender(fixes, judge).mend([bad, "plain"]) == quality.Mender(None, judge).mend([bad, "plain"]) == ["La précise fin", "plain"]


def test_long_words_are_scored_whole():
    model = CharModel(*(np.ones(n, np.float32) for n in (UNI, BI, TRI, WORD)))
    model.uni[:] = 0
    model.uni[ord("a")] = 100
    at = {n: i for i, n in enumerate(quality.SUMS)}
    same, other, thai, odd = quality.line_sums(["a" * 300, "a" * 40 + "q" * 260, "ก" * 500 + " " + "ข" * 90, "a" * 50 + "\x02" + "a" * 9], model)
    assert same[at["scored"]] == other[at["scored"]] == same[at["scored5"]] == 301 and thai[at["scored"]] == thai[at["scored5"]] == 592
    assert other[at["logp"]] < same[at["logp"]] - 260 and odd[at["scored"]] == 61
    pieces = quality.line_sums(["a" * 40], model)[0]
    assert pieces[at["scored"]] == 41 and same[at["logp"]] < pieces[at["logp"]] < 0


# problem 4


def sentence_list(spark, ls, tagger=None):
    df = lines(spark, {"d": ls})
    rows = sorted((r.line_no, r.end_char) for r in sentences.sentence_ends(df, tagger=tagger).collect())
    text = [(t[0] if isinstance(t, tuple) else t) or "" for t in ls]
    out, at = [], (0, 0)
    for no, end in rows:
        part = text[at[0]][at[1] :] + "".join("\n" + text[k] for k in range(at[0] + 1, no)) + "\n" + text[no][:end] if no > at[0] else text[no][at[1] : end]
        out.append(part.strip())
        at = (no, end)
    return out


@pytest.fixture(scope="module")
def tagger(data):
    import duckdb

    rows = duckdb.sql(f"SELECT DISTINCT doc, line_no, spans FROM '{data.replace('sf0.001', 'sf0.01')}/text_lines.parquet' ORDER BY doc, line_no").fetchall()
    docs: dict[str, list] = {}
    for doc, no, sp in rows:
        docs.setdefault(doc, []).append((no, " ".join(s["text"] or "" for s in sp), sp[0]["page_num"] if sp else None, not sp))
    got = [sentences.places("\n".join(t for _, t in par)) for d in docs.values() for par in sentences._paragraphs(d)]
    rng = random.Random(1)
    thai = [sentences.stripped(t, rng, bare) for d in docs.values() for _, t, _, _ in d if any("฀" <= c <= "๿" for c in t) for bare in (False, True)]
    return sentences.Tagger().fit(sentences.seeds() * 8 + [g for g in got + thai if g])


def ends_of(text, tagger):
    rows = [(i, t, 1, not t) for i, t in enumerate(text.split("\n"))]
    out, at = [], 0
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t, _, _ in rows])])
    for no, end in sentences.ends(rows, tagger):
        out.append(text[at : starts[no] + end].strip())
        at = starts[no] + end
    return out


@pytest.mark.parametrize("text,n", [
    ("We saw Dr. Fesk at 4.5 km. It rained.", 2), ("“Does it matter here?” asked Orlen Vask. Yes.", 2), ("The report says: “It holds.” The work went on.", 2), ("as shown by B. A. Fesk et al. in 1999 and cf. Sec. 3.4. The end.", 2),
    ("« La forêt décrit le schéma ? » demande le comité. Le débit baisse.", 2), ("Die Größe steigt am 15. Mai z. B. bei Frost. Der Rand bleibt.", 2), ("«Река меняет расход?» – спросил мастер. Опыт кончен.", 2),
    ("报告写道：“旧方法限制了变化。”该测量在v8.6版中改变了数据。“传感器吗？”主任问道。", 3), ("「新しいモデルは制限する。」と係員は述べた。古い方法は補った。", 2), ("यह मापन डॉ. रमोला के अनुसार है। नया मॉडल है?", 2), ("يشرح اللجنة حسب د. مروان. يقلل القياس؟", 2),
    ("Title line\n\nA sentence over\ntwo lines. And one more", 3), ("1. Le réseau\n\nLe débit.", 2), ("Η μέθοδος αλλάζει; Το όριο π.χ. στη βροχή.", 2),
])
def test_boundaries(tagger, text, n):
    assert len(ends_of(text, tagger)) == n


def test_thai_blanks_and_stripped_breaks(tagger):
    assert len(ends_of("แม่น้ำลดความเร็วของน้ำ การวัดนี้ลดระดับเฉลี่ย", tagger)) == 2
    rows = [(0, "การวัดนี้เปลี่ยนระดับเฉ", 1, False), (1, "ลี่ยโดยทั่วไป", 1, False)]
    assert sentences.ends(rows, tagger) == [(1, 13)]


def test_unpunctuated_runs_are_tagged_by_character(tagger):
    seq = sentences.places("แม่น้ำลดความเร็วของน้ำการวัดนี้ลดระดับเฉลี่ย")
    assert len(seq) > 20 and sum("bare" in p.feats for p in seq) == len(seq) - 1
    assert ends_of("แม่น้ำลดความเร็วของน้ำการวัดนี้ลดระดับเฉลี่ย", tagger) == ["แม่น้ำลดความเร็วของน้ำ", "การวัดนี้ลดระดับเฉลี่ย"]
    assert not any("bare" in p.feats for p in sentences.places("報告。報告"))


def test_seeds_name_nothing_of_the_tables(data):
    import duckdb

    text = " ".join(r[0] for r in duckdb.sql(f"SELECT DISTINCT text FROM '{data.replace('sf0.001', 'sf0.01')}/text_spans.parquet' WHERE text IS NOT NULL").fetchall())
    for name in ("Hill", "Lund", "Ives", "Petit", "Тверь", "मेहता", "سامي"):
        assert name in sentences.SEEDS and f" {name}" not in text


def test_page_change_ends_nothing_and_blank_does(spark, tagger):
    got = sentence_list(spark, [("One sentence goes", 1), None, ("on here.", 2), None, ("Head", 2), None, ("Tail", 2)], tagger)
    assert got == ["One sentence goes\n\non here.", "Head", "Tail"]


def test_sentences_of_odd_documents(spark, tagger):
    df = lines(spark, {"a": [None, "", "  "], "b": ["x" * 100_000], "c": ["Same. Same. Same."]})
    got = sorted((r.doc, r.line_no, r.end_char) for r in sentences.sentence_ends(df.union(df), tagger=tagger).collect())
    assert got == [("b", 0, 100_000), ("c", 0, 5), ("c", 0, 11), ("c", 0, 17)]
    assert sentences.sentence_ends(df.limit(0)).count() == 0
    assert sentences.sentence_ends(df, df.select("doc").where("doc = 'c'"), tagger).count() == 3


@pytest.mark.parametrize("most", [1000, -1])
def test_blocks_never_cut_inside_a_paragraph(spark, most, monkeypatch):
    monkeypatch.setattr(block_lines, "MOST_BROADCAST", most)
    docs = {"d": [(None if i % 7 == 6 else f"l{i}", 1 + i // 50) for i in range(400)], "e": [f"m{i}" for i in range(90)], "f": [None]}
    df = line_texts(lines(spark, docs))
    table = blocks(measures(df.union(df.limit(30)), 32), at_pages=False, size=32)
    rows = sorted({(r.doc, r.line_no, r.block) for r in in_blocks(df, table, 32).collect()})
    assert len(rows) == 491 and len({(d, k) for d, _, k in rows}) > 10
    assert all(a[2] == c[2] or a[0] != c[0] or docs[a[0]][c[1]][0] is None for a, c in zip(rows, rows[1:]))
    total = {r.doc: r.total for r in table.collect()}
    assert total == {d: sum(len((t[0] if isinstance(t, tuple) else t) or "") + 1 for t in ls) for d, ls in docs.items()}


@pytest.mark.parametrize("context", [0, 5, 60, 4000])
def test_blocks_bring_what_leads_to_them(spark, context):
    rng = random.Random(context)
    docs = {f"d{k}": [rng.choice((None, "", "x" * rng.randrange(1, 30))) for _ in range(n)] for k, n in enumerate((1, 40, 300))}
    df = line_texts(lines(spark, docs))
    got: dict = {}
    for r in in_blocks(df, blocks(measures(df, 32), at_pages=True, context=context, size=32), 32).collect():
        got.setdefault((r.doc, r.block), []).append((r.line_no, r.text, r.first, r.start_char))
    for (d, _), rows in got.items():
        first, start = rows[0][2], rows[0][3]
        past = "".join((t or "") + "\n" for t in docs[d][:first])
        lead = "".join(t + "\n" for no, t, _, _ in sorted(rows) if no < first)
        assert len(past) == start and past.endswith(lead) and len(lead) >= min(context, len(past))
    assert sorted((d, no) for (d, _), rows in got.items() for no, _, first, _ in rows if no >= first) == sorted((d, i) for d, ls in docs.items() for i in range(len(ls)))


# problem 5


@pytest.mark.parametrize("seed", range(3))
def test_pieces_rebuild_the_text(spark, seed):
    rng = random.Random(seed)
    docs = {}
    for d in range(6):
        ls = []
        for i in range(rng.choice((5, 60, 2500))):
            ls.append(rng.choice([None, (("w" * rng.randrange(1, 9) + " ") * rng.randrange(1, 40), 1 + i // 40), ("1. Head", 1 + i // 40)]))
        docs[f"d{d}"] = ls
    docs["one"] = [("x" * 5000, 1)]
    docs["few"] = [("short", 1)]
    docs["none"] = [None]
    df = lines(spark, docs)
    limits = spark.createDataFrame([("a", 300, 40), ("b", 2000, 0), ("c", None, 5), ("d", 1000, None)], "profile string, max_chars int, overlap_chars int")
    got = chunking.pieces(df.union(df.limit(7)), limits).collect()
    text = {d: "".join(((t[0] if isinstance(t, tuple) else t) or "") + "\n" for t in ls) for d, ls in docs.items()}
    want = {(p, d) for p, m in (("a", 300), ("b", 2000), ("d", 1000)) for d, t in text.items() if len(t) > m}
    assert {(r.profile, r.doc) for r in got} == want
    for p, d in want:
        ps = sorted((r for r in got if (r.profile, r.doc) == (p, d)), key=lambda r: r.start_char)
        most, over = {"a": (300, 40), "b": (2000, 0), "d": (1000, 0)}[p]
        assert "".join(r.text[r.overlap :] for r in ps) == text[d] and max(len(r.text) for r in ps) <= most
        assert all(text[d][: b.start_char].endswith(b.text[: b.overlap]) and min(over, b.start_char) // 2 <= b.overlap <= over for b in ps)
        assert ps[0].start_char == 0 and all(a.end_char == b.start_char for a, b in zip(ps, ps[1:])) and ps[-1].end_char == len(text[d])
    assert chunking.pieces(df.limit(0), limits).count() == 0 and chunking.pieces(df, limits.limit(0)).count() == 0


def test_siblings_are_merged_and_only_large_nodes_opened():
    lines_of = [("x" * 9, 1, False)] * 3 + [("", 1, True)] + [("y" * 9, 1, False)] * 2 + [("", None, True)] + [("z" * 9, 2, False)] * 9
    text, root = chunking.tree(lines_of)
    assert [text[a:b].count("\n") for a, b in chunking.pack(text, root, 62)] == [7, 6, 3]  # page 1 whole, page 2 opened
    assert [text[a:b].count("\n") for a, b in chunking.pack(text, root, 40)] == [4, 3, 4, 4, 1]  # paragraphs stay whole
    assert chunking.pack(text, root, 1000) == [(0, len(text))]
    long = "one two three. four five six seven. " + "w" * 50
    text, root = chunking.tree([(long, 1, False)])
    assert [text[a:b] for a, b in chunking.pack(text, root, 25)] == ["one two three. ", "four five six seven. ", "w" * 25, "w" * 25, "\n"]


# problems 6 and 7

DOC = "doc_id bigint, text string, source string, n_tokens int"


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 101, 3000)
    place = packing.best_fit(sizes, 100)
    used = np.bincount(place, sizes)
    assert used.max() <= 100 and sizes.sum() / (100 * len(used)) > 0.97
    place = packing.best_fit(np.ones(100, np.int64), 100, max_docs=7)
    assert np.bincount(place).max() == 7
    place = packing.best_fit(sizes, 100, attention=0.5)
    costs = np.bincount(place, sizes.astype(float) ** 2)
    assert all(c <= 5000 or n == 1 for c, n in zip(costs, np.bincount(place)))
    place = packing.best_fit(np.array([90, 5, 5, 5]), 100, attention=0.5)  # too costly in itself: alone
    assert np.bincount(place)[place[0]] == 1 and len(set(place[1:])) == 1
    assert len(packing.best_fit(np.zeros(0, np.int64), 10)) == 0


def test_every_token_has_one_container(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(EN.split()) for _ in range(rng.choice((1, 5, 40, 300)))), None, 7) for i in range(300)] + [(900, None, None, 1), (901, "", None, 1), (902, "word " * 5000, None, 1), (5, "again", None, 1)] + [(None, "no number", None, 1)] * 40
    df = spark.createDataFrame(rows, DOC)
    bins = spark.createDataFrame([("s", 64), ("l", 512), ("x", None)], "profile string, capacity_tokens int")
    got = packing.containers(df, bins, group_items=64).collect()
    encode = encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    for p, cap in (("s", 64), ("l", 512)):
        mine = [r for r in got if r.profile == p]
        assert sum(r.n_tokens for r in mine) == sum(len(encode(t)) for _, t, _, _ in rows if t)
        per: dict = {}
        for r in mine:
            per[r.container] = per.get(r.container, 0) + r.n_tokens
        assert per.pop(None) == 0 and max(per.values()) <= cap
        split = {r.doc_id for r in mine if r.piece_no > 0}
        assert split == {i for i, t, _, _ in rows if t and len(encode(t)) > cap}
    assert {r.profile for r in got} == {"s", "l"} and packing.containers(df.limit(0), bins).count() == 0 and packing.containers(df, bins.limit(0)).count() == 0


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, file):
    df = spark.createDataFrame([(1, "two words <|endoftext|>", None, 1), (2, None, None, 1)], DOC)
    got = {r.doc_id: r.n_tokens for r in with_tokens(df, F.col("text"), ["doc_id"], "/opt/tokenizers/" + file).collect()}
    assert got[1] > 3 and got[2] == 0


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        s = rng.choices(["web", " Web", "book", "note", None, "other"], (60, 10, 20, 4, 3, 3))[0]
        rows.append((i, f"t{i} " + " ".join(rng.choice(EN.split()) for _ in range(rng.randrange(5, 60))), s, 1))
    rows += [(10_000 + i, rows[i][1], "book", 1) for i in range(50)] + [(20_000, None, "web", 1), (20_001, "", "book", 1)]
    df = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("web", 0.5, 1), ("book", 0.3, 2), ("note", 0.15, 3), ("absent", 0.05, 9), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mixture(df, targets)
    s = {r.source: r for r in shares.collect()}
    for name, w in (("web", 0.5), ("book", 0.3), ("note", 0.15)):
        assert abs(s[name].actual_share - w / 0.95) < 0.01 and s[name].most_repeats <= s[name].max_repeats
    assert s["absent"].actual_share == 0 and s["absent"].texts == 0 and "bad" not in s
    t = taken.collect()
    assert len({r.doc_id for r in t}) == len(t) and sum(r.n_tokens * r.repeats for r in t) == sum(r.taken_tokens for r in s.values())
    assert not {r.doc_id for r in t} & {10_000 + i for i in range(50) if (rows[i][2] or "").strip().lower() in ("web", "book", "note")}
    texts = mixing.texts_by_source(df, ["web", "book", "note"]).collect()
    for p in mixing.plan(mixing.texts_by_source(df, ["web", "book", "note"]), [("web", 0.5, 1), ("book", 0.3, 2)], 3000):  # the threshold, found by sorting
        mine, at = sorted((r.u, r.n_tokens) for r in texts if r.source == p.source), 0
        for u, n in mine:
            if at + n > p.budget - p.whole * p.available:
                break
            at += n
        assert p.threshold <= u and sum(n for v, n in mine if v < p.threshold) == at
    small, _ = mixing.mixture(df, targets, total_tokens=2000)
    large, _ = mixing.mixture(df, targets, total_tokens=6000)
    assert {r.doc_id for r in small.collect()} <= {r.doc_id for r in large.collect()}
    none, zero = mixing.mixture(df.limit(0), targets)
    assert none.count() == 0 and all(r.actual_share == 0 for r in zero.collect())


# problem 8

SPAM = [
    " ".join(random.Random(1).choice(["buy", "cheap", "steel kettle", "best", "order now", "review"]) for _ in range(300)),
    "\n".join(f"\\noindent\\url{{https://shop-{i}.example/kettle/{i * 37}}}\\\\" for i in range(60)),
    "\\begin{itemize}" + "".join(f"\\item \\href{{http://mart.test/p/{i}}}{{best pan {i % 7}}}\n" for i in range(80)) + "\\end{itemize}",
    " ".join("\\#" + random.Random(i).choice(["steel\\_kettle", "copper-pan", "shop", "discount", "price", "lamp"]) for i in range(200)),
    ". ".join(f"Promo couverture de laine {c} acheter couverture de laine pas cher" for c in "ABCDEFGHIJKLMNOPQRST") + ".",
]
GOOD = [
    EN, FR + " " + RU, "\\section{A}\n" + " ".join(f"The price of item {i} depends on the season and on who asks for it in town number {i * 3}." for i in range(30)),
    "\\documentclass{article}\\begin{document}Some words of a paper that ends soon after it began, with no more to say.\\begin{thebibliography}{9}" + "".join(f"\\bibitem{{k{i}}} A. Author, \\emph{{Some title of work {i}}} {i} (2001), 1--9. \\url{{https://x.example/{i}}}\n\n" for i in range(60)) + "\\end{thebibliography}",
    "\\end{document}\n", "", None,
]


def test_pages_of_keywords_and_links(spark):
    rows = [(i, t, None, 1) for i, t in enumerate(SPAM)] + [(100 + i, t, None, 1) for i, t in enumerate(GOOD)] + [(200, "intro words of a short frame around it. " + SPAM[0], None, 1), (201, " ".join(f"The word {i} of the text stands before that of the number {i + 1} in it." for i in range(30_000)), None, 1)]
    got = {r.doc_id: r for r in keyword_spam.keyword_spam(spark.createDataFrame(rows, DOC).withColumn("stuffed", F.lit(1))).collect()}
    assert {k for k, r in got.items() if r.stuffed} == {*range(len(SPAM)), 200} and len(got) == len(rows)
    assert keyword_spam.keyword_spam(spark.createDataFrame(rows, DOC).limit(0)).count() == 0


def test_short_pages_of_links():
    links = [f"\\noindent\\url{{https://shop-{i}.example/kettle/{i * 37}}}\\\\" for i in range(29)]
    for n in (29, 25, 12, 6):
        assert keyword_spam.judge("\n".join(links[:n]))[0], n
    assert keyword_spam.judge("\n".join(links[:25]) + "\n\\begin{thebibliography}{1}\n\\bibitem{a} A. Author, \\emph{Some title} 1 (2001), 1--9.\n\\end{thebibliography}")[0]
    for stub in (links[0], "\\input{main}\n" + links[1], "lamp, pan, kettle, stove, belt", " ".join(EN.split()[:20]), EN + " " + EN.replace("kiln", "lamp")[:60]):
        assert not keyword_spam.judge(stub)[0], stub


def test_figures_of_ordinary_pages(spark):
    page = " ".join(f"The price of item {i} depends on the season and on who asks for it." for i in range(30)) + "\n" + SPAM[0][:400]
    got = {r.doc_id: r for r in keyword_spam.keyword_spam(spark.createDataFrame([(1, page, None, 1), (2, "see https://a.example/b now", None, 1), (3, SPAM[0], None, 1)], DOC)).collect()}
    assert not got[1].stuffed and 0 < got[1].share < 0.5 and got[1].autocorrelation > 0
    assert not got[2].stuffed and got[2].links == 1 / 3
    for t in [page, *SPAM, *(t or "" for t in GOOD)]:
        assert keyword_spam.judge(t)[0] == keyword_spam.judge(t, figures=False)[0]


def test_long_blocks_of_keywords():
    rng = random.Random(3)
    for size in (45, 80, 150):
        block = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(size)]
        assert keyword_spam.judge(" ".join(block * 5))[0], size
        assert keyword_spam.judge(" ".join(w for _ in range(5) for w in rng.sample(block, size)))[0], size
        assert not keyword_spam.judge(" ".join(block))[0], size
    assert not keyword_spam.judge(" ".join(f"{EN} {FR} The tower in town {i} stands by the river." for i in range(9)))[0]


# all queries


def test_queries_run(spark, data):
    from spanforge.llm import oracles, queries

    assert set(oracles.oracle_sql()) <= set(queries.queries())
    cols = {"p1_found": ["doc", "page_num", "span_seq", "field"], "p2_found": ["doc", "kind"], "p3_found": ["doc", "page_num", "span_seq"], "p4_found": ["doc", "line_no", "end_char"], "p5_found": ["profile", "doc"], "p8_found": ["doc_id"]}
    for name, q in queries.queries().items():
        df = q(spark, data)
        n, m = df.count(), df.distinct().count()
        assert n == m, name
        assert df.columns == cols.get(name, df.columns), name
