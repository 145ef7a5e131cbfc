from lutrin.operators import entities as E

BUBBLES = "bulle_id bigint, oeuvre string, ocr string, traduction string"
ENTRIES = "entree_id bigint, oeuvre string, nom string, pluriel string, variantes array<string>, termes_source array<string>"


def test_lost_terms_by_containment_and_all_forms(spark):
    entries = [(1, "o", "Calune Orsa", "Calunes", ["C. Orsa", None], ["カルーネ・オルサ", "カルーネ"]), (2, "o", "Montagne", None, None, ["山", " ", None]), (3, "o", "Chevalier", None, [], ["黒い騎士", "騎士"]), (4, "p", "Ailleurs", None, None, ["山"]), (5, "o", "Roi", None, None, ["王"]), (6, None, "Perdue", None, None, ["山"])]
    bubbles = [
        (1, "o", "あのカルーネ・オルサが", "Le voici."), (2, "o", "カルーネンは", "Voici."), (3, "o", "カルーネ", "Les calunes !"), (4, "o", "カルーネ", "c. orsa"), (5, "o", "山へ王と", "Au mont."),
        (6, "o", "黒い騎士だ", "Un soldat"), (7, "o", "騎士だ", "Un CHEVALIER"), (8, "o", "山", " "), (9, None, "山", "x"), (10, "o", None, "x"), (11, "o", "カルーネ", "Calune"), (12, "o", "山", None),
    ]
    got = {tuple(r) for r in E.lost_terms(spark.createDataFrame(bubbles, BUBBLES), spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == {(1, 1, "カルーネ・オルサ", "Calune Orsa"), (2, 1, "カルーネ", "Calune Orsa"), (5, 2, "山", "Montagne"), (6, 3, "黒い騎士", "Chevalier"), (11, 1, "カルーネ", "Calune Orsa")}
