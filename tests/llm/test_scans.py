import random

from lutrin.llm import furniture, scans

TEXTS = "champ string, cle bigint, texte string, titre string, propre boolean, mot string"
CLEAN = ["The old captain gave the silver seal to the weavers near the lighthouse after the storm that night", "Un vieux capitaine donna la boîte scellée derrière la boulangerie", "the night-flower and the half-burnt book in the throne room"] * 30


def _found(spark, texts, title=None, champ="extraits.text"):
    rows = [("bulles.traduction", -1 - k, t, None, True, "x") for k, t in enumerate(CLEAN)] + [(champ, k, t, title, False, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, TEXTS)
    return {(r.cle, r.ligne, r.bruit) for r in scans.noise_rows(df)[0].select("cle", "ligne", "bruit").distinct().collect()}, df


def test_kinds_of_noise(spark):
    page = "Chapter 4\n\n1240\n\nThe old capta-\nin gave th@t silver seal. The night-\nflower and light-\n\nLA TOUR DE SEL   53.\n\nhouse near tlie weavers.\n* * *\n- 112 -\nthe half-\nburnt book"
    got, _ = _found(spark, [page, None, "", "storm", "猫\nが"], "La Tour de Sel Chap.4.pdf")
    assert got == {(0, 4, "cesure"), (0, 5, "glyphe"), (0, 6, "cesure"), (0, 8, "entete"), (0, 10, "glyphe"), (0, 12, "folio")}


def test_repair_gives_paragraphs(spark):
    page = "The old capta-\nin gave th@t silver seal to the\nweavers.\n\n12\n\nLA TOUR DE SEL\nThat night the night-\nflower.\n\nThe storm."
    _, df = _found(spark, [page], "La Tour de Sel Chap.4.pdf")
    got = [r.texte for r in scans.repaired_texts(df).collect()]
    assert got == ["The old captain gave that silver seal to the weavers. That night the night-flower.\n\nThe storm."]


def test_a_confusion_put_back_is_found_by_the_hash():
    rng = random.Random(11)
    words = ["captain", "neighbourhood", "silver", "throne", "without", "describing", "mushroom", "weavers"]
    for _ in range(300):
        w = rng.choice(words)
        read, true = rng.choice(scans.CONFUSIONS)
        if true in w:
            bad = w.replace(true, read)
            assert scans.anagram(w) in scans.targets(bad) and scans.undone(bad, w), (w, bad)
    for bad, w in (("tclcscopc", "telescope"), ("ciiidad", "ciudad"), ("viiiage", "village")):
        assert scans.anagram(w) in scans.targets(bad) and scans.undone(bad, w), bad
    assert not scans.undone("captain", "silver") and not scans.undone("cat", "cats")


def test_every_number_of_misread_glyphs_is_hashed_and_long_runs_end():
    assert scans.anagram("mississippian") in scans.targets("mlsslsslpplan") and scans.undone("mlsslsslpplan", "mississippian")
    for n in range(1, 9):
        assert scans.anagram("e" * 8 + "x") in scans.targets("c" * n + "e" * (8 - n) + "x"), n
    assert scans.undone("c" * 1_500, "e" * 1_500) and not scans.undone("c" * 1_500, "e" * 1_499 + "x")


def test_long_words_and_long_titles(spark):
    word, title = "anticonstitutionnellementinterminablement", "La Très Longue Et Très Ancienne Chronique Des Gardiens Du Phare De La Falaise Aux Oiseaux Blancs De Sel"
    page = f"the storm\n{title.upper()}                    77\nthe captain said {word.replace('e', 'c')} again\n-          12          -\nthe weavers"
    rows = [("bulles.traduction", -1 - k, t, None, True, "x") for k, t in enumerate([*CLEAN, *[f"the {word}"] * 30])] + [("extraits.text", 0, page, title + " Chap.4.pdf", False, "x")]
    df = spark.createDataFrame(rows, TEXTS)
    assert {(r.ligne, r.bruit) for r in scans.noise_rows(df)[0].collect()} == {(1, "entete"), (2, "glyphe"), (3, "folio")}


def test_the_set_of_common_words_changes_no_row(spark, monkeypatch):
    page = "The old capta-\nin gave the-\nn that silver seal near tlie storm-\nbird and the\nold-\nish weavers"
    got, df = _found(spark, [page])
    monkeypatch.setattr(scans, "COMMON", 0)
    assert {(r.cle, r.ligne, r.bruit) for r in scans.noise_rows(df)[0].select("cle", "ligne", "bruit").distinct().collect()} == got


def test_folios_and_headers():
    for t in ("112", "- 3 -", "[186]", "· 82 ·", "— 195 —", "164.", "p. 53/98", "Page 12", "Página 6", "99頁", "xii", "iv"):
        assert furniture.is_folio(t), t
    for t in ("ans.", "1 2 3 mots", "* * *", "I", "mil", "Page", ""):
        assert not furniture.is_folio(t), t
    title = furniture.plain_caps("La Tour de Sel")
    for t in ("LA TOUR DE SEL", "La T0ur de Sel   [151]", "53.  LA TOUR DE SEL", "CHAPTER 21   · 2 ·", "CHAPIT9E 9", "CHAPITRE026", "第23章   — 26 —", "[142]  第16章"):
        assert furniture.is_header(t, title), t
    for t in ("La tour de sel brillait dans la nuit noire", "capitán dio", "chain 4 x", "# Chapitre 3", "The storm"):
        assert not furniture.is_header(t, title), t


def test_empty_and_long(spark):
    df = spark.createDataFrame([], TEXTS)
    assert scans.noise_rows(df)[0].count() == 0
    long = ("the silver seal near the lighthouse\n" * 5_000) + "th@t storm"
    got, _ = _found(spark, [long])
    assert got == {(0, 5_000, "glyphe")}
