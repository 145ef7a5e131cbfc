import random

import pytest

from lutrin.llm import answers as A
from lutrin.llm import truncation as T

BUBBLES = "bulle_id bigint, oeuvre string, ocr string, traduction string, canal string, langue_source string, langue_cible string, score string"


@pytest.fixture(scope="module")
def model(spark, data):
    rows = T.records(spark, data)
    return T.fit_cutter(rows, T.source_limits(rows.limit(0)))


def test_cut_values_are_told_from_whole_ones(spark, data, model):
    """Held-out accuracy on artificially cut values of a source without limits."""
    rng = random.Random(8)
    rows = spark.read.parquet(f"{data}/bulles.parquet").where("canal = 'pipeline' AND langue_source <> 'ja' AND langue_cible = 'fr'").select("ocr", "traduction").collect()
    good = wrong = 0
    for r in rows:
        t = r.traduction
        if not t or not r.ocr or t[-1] not in ".!?" or len(t) < 20 or T.end_class(T.furniture.content(r.ocr)) != "stop":
            continue
        cut = t[: rng.randrange(8, len(t) - 1)]
        if T.end_class(cut.rstrip()) == "stop":
            continue
        judged = T.judge(model, (None, None), "bulles.traduction", cut, r.ocr, None, "en>fr")[1], T.judge(model, (None, None), "bulles.traduction", t, r.ocr, None, "en>fr")[1]
        good += judged == (True, False)
        wrong += judged != (True, False)
    assert good > 40 and wrong <= 0.05 * good


def _judge(model, text, source, limit=(None, None)):
    return T.judge(model, limit, "bulles.traduction", text, source, None, "en>fr")[1]


def test_what_is_no_cut(model):
    for text, source in ((None, "A b."), ("", "A b."), ("   ", "A b."), ("Attends, je—", "Wait, I—"), ("Trois jours plus tard", "Three days later"), ("PLIC", "DRIP"), ("Où est la clef ?", "Where is the key?"), ("null", "Where is the key?"), (" Where is the key ", "Where is the key?"), ("« Où est la clef ? »", "Where is the key?")):
        assert not _judge(model, text, source), text
    assert _judge(model, "Où est la lettre inach", "Where is the unfinished letter?")
    assert _judge(model, "Où est la lettre inach�", "Where is the unfinished letter?")
    assert _judge(model, "Nous partons pendant l' ", "We leave during the eclipse, with or without Gwene.")


def test_every_record_is_scored_by_the_model(spark, data):
    rows = T.records(spark, data)
    scores = T.truncation_scores(rows).collect()
    texts = {(r.champ, r.cle): r.texte for r in rows.select("champ", "cle", "texte").collect()}
    blank = [r for r in scores if r.coupe == 0]
    assert all(not T.strip_debris(T.furniture.content(texts[r.champ, r.cle] or ""))[0] for r in blank)
    assert len(blank) < 0.1 * len(scores) and any(r.cas for r in scores)


def test_without_the_model_nothing_is_found(spark, data, monkeypatch):
    monkeypatch.setattr(T.Cutter, "score", lambda self, x: 0.0)
    model = T.Cutter(T.np.zeros(1 << T.BITS))
    assert not T.judge(model, (None, None), "bulles.traduction", "Où est la lettre inach", "Where is the unfinished letter?", None, "en>fr")[1]


def test_copies_by_compressed_size():
    rng = random.Random(4)
    words = "the old lantern near lighthouse where is silver seal weavers storm captain gave never forgive promise harbour dawn ships".split()
    prompts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 14))) + "." for _ in range(300)]
    pairs = [(p, "Réponse " + p[::-1]) for p in prompts]
    fitted = A.Copies().fit(pairs[:200])
    assert 0 <= fitted.sure < fitted.most
    for p in prompts[200:]:
        assert fitted.found(p, p.upper()) and fitted.found(p, "3. " + p) and fitted.found(p, p[:7] + p[8:])
        assert not fitted.found(p, " ".join(p.split()[:-1])) and not fitted.found(p, p[::-1])
    # the size decides: with bounds that let nothing pass, copies are lost
    assert not A.Copies(-1, -1).found(prompts[0], prompts[0])
    assert A.Copies(0, 0).found(prompts[0], prompts[0].upper())


def test_long_placeholders_and_spaced_copies():
    assert A.is_empty("." * 60 + " null " + "." * 60) and not A.is_empty("x" * 100)
    assert A.is_copy("Where is it, Ana?", "Where   is   it ,          Ana ?!?!?!?!?!?!")


def test_debris_is_taken_off():
    assert T.strip_debris("le vieux capita&eac") == ("le vieux capita", "&eac")
    assert T.strip_debris("fr\\u00e") == ("fr", "\\u00e")
    assert T.strip_debris("rivi��") == ("rivi", "��")
    assert T.strip_debris("mot <!--IM") == ("mot", "<!--IM")
    assert T.strip_debris("fin\n\n<!-- IMG: a.png|width=1in -->")[1] == ""


def test_limits_are_where_values_pile_up(spark):
    rng = random.Random(9)
    rows = [(k, "c", "x" * min(100, rng.randrange(5, 160))) for k in range(600)] + [(k, "libre", "y" * rng.randrange(5, 160)) for k in range(600)]
    df = spark.createDataFrame([("f", k, s, t) for k, s, t in rows], "champ string, cle bigint, source string, texte string")
    assert {(r.champ, r.source): (r.lim_c, r.lim_o) for r in T.source_limits(df).collect()} == {("f", "c"): (100, None), ("f", "libre"): (None, None)}


def test_truncation_on_empty_tables(spark, data):
    rows = T.records(spark, data).limit(0)
    assert T.truncation_scores(rows).count() == 0


def test_copies():
    p = "I will never forgive Ana, never."
    for a in (p, p.upper(), f"2. {p}", f"« {p} »", " " + p[:-1] + " ", p.replace(" ", "\n"), p.replace("forgive", "forgve")):
        assert A.is_copy(p, a), a
    for a in ("Je ne pardonnerai jamais à Ana.", "", None, "I will never", p + " Where is the key?"):
        assert not A.is_copy(p, a), a
    assert A.is_copy("終わりだ。行こう。", "終わりだ。行こう。") and A.is_copy("ペペリスを絶対に許さない。", "ペペリスを絶対に許ない。")


def test_empty_answers_and_refusals():
    for a in (None, "", " ", "…", "2. ", "3.", "()", "[vide]", "N/A", "null", "(sans texte)", "« »", "_", chr(0x200B)):
        assert A.is_empty(a), a
    assert not A.is_empty("OK") and not A.is_empty("2. Oui")
    for a in ("I'm sorry, but I can't assist with translating this text.", "Je regrette, je ne peux pas traduire ce passage.", "En tant que modèle de langue, cette réplique enfreint mes consignes.", "Lo siento, no puedo traducir este texto.", "申し訳ありませんが、この内容は翻訳できません。"):
        assert A.is_refusal(a), a
    for a in ("I cannot translate this inscription, Ana.", "Désolé, Ana, je ne peux pas ouvrir la boîte.", "Lo siento, Ana, no puedo abrir la caja.", "Tu refuses ? Impossible."):
        assert not A.is_refusal(a), a


def test_kinds_of_defect(spark, data):
    b = spark.read.parquet(f"{data}/bulles.parquet")
    rows = [
        (1, "o", "Where is the old lantern? I saw Ana near the lighthouse.", None, "pipeline", "en", "fr", ""),
        (2, "o", "Where is the old lantern? I saw Ana near the lighthouse.", "I am unable to provide a translation for this content.", "pipeline", "en", "fr", ""),
        (3, "o", "Where is the old lantern? I saw Ana near the lighthouse.", "where is the old lantern? I saw Ana near the lighthouse", "pipeline", "en", "fr", ""),
        (4, "o", "Where is the old lantern? I saw Ana near the lighthouse.", "Où est la vieille lanterne ? 灯台の近くでアナを見たんだ。", "pipeline", "en", "fr", ""),
        (5, "o", "Where is the old lantern? I saw Ana near the lighthouse.", "Où est la vieille lanterne ? J'ai vu An", "pipeline", "en", "fr", ""),
        (6, "o", "Where is the old lantern? I saw Ana near the lighthouse.", "Où est la vieille lanterne ? J'ai vu Ana près du phare.", "pipeline", "en", "fr", ""),
        (7, "o", "Ana!!", "Ana !!", "pipeline", "en", "fr", ""),
        (8, "o", None, None, None, None, None, None),
        (9, "o", "!?", "", "pipeline", "en", None, ""),
        (9, "o", "!?", "", "pipeline", "en", None, ""),
    ]
    extra = spark.createDataFrame(rows, BUBBLES)
    all_ = b.select("bulle_id", "oeuvre", "ocr", "traduction", "canal", "langue_source", "langue_cible").withColumn("bulle_id", b.bulle_id + 1000).unionByName(extra.drop("score"))
    got = {r.bulle_id: r.defaut for r in A.answer_defects(all_).where("bulle_id < 1000").collect()}
    assert got == {1: "vide", 2: "refus", 3: "copie", 4: "autre_langue", 5: "tronquee"}
    assert A.answer_defects(all_.limit(0)).count() == 0


def _bubbles(spark, pairs, path):
    rows = [(k, "o", o, t, "pipeline", "en", "fr", "") for k, (o, t) in enumerate(pairs)]
    spark.createDataFrame(rows, BUBBLES).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_bounds_of_copies_are_from_all_pairs(spark, tmp_path):
    """One answer among 9,000 that is none but costs next to nothing, and one dear copy, count wherever they stand."""
    plain = [(f"Where is lantern {k} of the harbour?", f"Où est passée la lanterne {k} du port ?") for k in range(9000)]
    near, dear = ("DRIP", "PLIC"), ("石板はどこだ？", "石板どこだ？")
    assert A._may_copy(*near) and not A._exactly(*near) and A._exactly(*dear)
    for at in (17, 4444, 8888):
        pairs = plain[:at] + [near, dear] + plain[at:]
        c = A.fit_copies(_bubbles(spark, pairs, tmp_path / str(at)))
        assert c.sure < A.extra(*near) and c.most >= A.extra(*dear)
        assert c.found(*dear) and not c.found(*near)


def test_word_languages_are_counted_in_all_texts(spark, tmp_path):
    rows = [(f"where is lantern {k}", f"la lanterne {k} est là") for k in range(9000)] + [("nine zephyrs", "neuf zéphyrs")] * 3
    some = A.fit_languages(_bubbles(spark, rows, tmp_path / "b"))
    assert some.weights["zephyrs"][0] > 1 and some.weights["zéphyrs"][1] > 1  # three of 9,003 texts
    rows += [("Ana lives", "Ana vit")] * 500 + [("ana lives", "ana vit")]
    assert "ana" not in A.fit_languages(_bubbles(spark, rows, tmp_path / "c")).weights
    counted = A.Counter(w.casefold() for p, _ in rows for w in A._WORDS.findall(p))
    lower = A.Counter(w for r in rows for x in r for w in A._WORDS.findall(x) if w[0].islower())
    whole = A.WordLanguages().fit({"en": counted, "fr": A.Counter(w.casefold() for _, t in rows for w in A._WORDS.findall(t))}, lower)
    assert A.fit_languages(spark.read.parquet(str(tmp_path / "c"))).weights == whole.weights
