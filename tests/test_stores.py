import io
import json
import zipfile

from pyspark.sql import functions as F

from lutrin.operators import glossary as G
from lutrin.operators import layout as L
from lutrin.plans.stages import plan_of
from lutrin.sources import stores as S


def test_pages_are_read_migrated_and_laid_over(spark, tmp_path):
    place = tmp_path / "oe1" / "Vol.2"
    place.mkdir(parents=True)
    (place / "000012.json").write_text(json.dumps({"version": 1, "regions": [{"bbox": [1, 2, 30, 40]}, {"id": 7, "x0": 5, "y0": 6, "x1": 7, "y1": 8, "score": 0.5}], "ocr": ["a", "b"], "traduction": ["A", "B"], "manuelle": {"7": "main"}, "origines": ["pipeline", "editeur"]}))
    (place / "000013.json").write_text(json.dumps({"texte": "vide"}))
    (place / "000014.json").write_text("{broken")
    pages, bad = S.read_pages(spark, str(tmp_path))
    got = {(r.oeuvre, r.tome, r.planche): r for r in pages.collect()}
    assert set(got) == {("oe1", "Vol.2", 12), ("oe1", "Vol.2", 13)} and got["oe1", "Vol.2", 13].regions is None
    assert [r.chemin.rsplit("/", 1)[1] for r in bad.collect()] == ["000014.json"]
    rows = [tuple(r)[3:] for r in S.page_records(pages).orderBy("rang").collect()]
    assert rows == [(0, 0, 1, 2, 30, 40, None, "a", "A", "pipeline"), (1, 7, 5, 6, 7, 8, 0.5, "b", "main", "manuelle")]


def test_page_stores_keep_the_bubbles(spark, data, tmp_path):
    b = spark.read.parquet(f"{data}/bulles.parquet")
    S.write_pages(S.pages_from(b), str(tmp_path / "p"))
    back = S.page_records(S.read_written_pages(spark, str(tmp_path / "p")))
    want = b.where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL").select("oeuvre", "tome", "planche", "x0", "y1", "ocr", "traduction", F.col("origine"))
    assert want.count() == back.count()
    assert want.exceptAll(back.select(*want.columns)).count() == 0


def test_glossaries_round_trip(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("personnages:\n  - nom: Ana\n    genre: f\n    variantes: [An, 'A. B']\n    cibles: {en: {nom: Anna, pluriel: Annas}}\n  - nom: Bo\nlieux: []\n", encoding="utf-8")
    (tmp_path / "b.yaml").write_text("personnages: [unclosed", encoding="utf-8")
    rows = {(r.chemin.rsplit("/", 1)[1], r.rang): r for r in S.read_glossaries(spark, str(tmp_path), "en").collect()}
    assert rows["a.yaml", 0].nom == "Anna" and rows["a.yaml", 0].pluriel == "Annas" and rows["a.yaml", 1].nom == "Bo" and rows["b.yaml", None].nom is None
    entries = S.read_glossaries(spark, str(tmp_path / "a.yaml")).withColumn("oeuvre", F.lit("o")).withColumn("description", F.lit('d: "x"\n- é | {1}'))
    text = S.glossary_yaml(entries, "oeuvre").first().texte
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.yaml").write_text(text, encoding="utf-8")
    again = S.read_glossaries(spark, str(tmp_path / "c"))
    fields = ["categorie", "nom", "pluriel", "genre", "variantes", "termes_source", "interdits", "description", "forcer"]
    assert sorted(map(tuple, again.select(*fields).collect()), key=repr) == sorted(map(tuple, entries.select(*fields).collect()), key=repr)


def _docx(paragraphs, styles=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{paragraphs}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
    return out.getvalue()


def test_word_documents(spark, tmp_path):
    p = lambda t, props="", run="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    styled = _docx(p("Un", '<w:pStyle w:val="H2"/>') + p("mot") + p("point", "<w:numPr/>") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>", '<w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style>')
    bold = _docx(p("Titre", "", "<w:b/>") + p("texte") + p("* * *", "", "<w:b/>") + p("* * *", "", "<w:b/>"))
    for name, content in (("a.docx", styled), ("b.docx", bold), ("c.docx", b"no zip")):
        (tmp_path / name).write_bytes(content)
    rows = S.read_docx(spark, str(tmp_path))
    lines: dict = {}
    for r in S.promoted_headings(rows).orderBy("chemin", "rang").collect():
        lines.setdefault(r.chemin.rsplit("/", 1)[1], []).append(r.ligne)
    assert lines == {"a.docx": ["## Un", "mot", "- point", "| a | b |"], "b.docx": ["## Titre", "texte", "* * *", "* * *"]}
    assert rows.where("rang IS NULL").count() == 1


def test_repair_is_idempotent(spark, data):
    e = spark.read.parquet(f"{data}/personnages.parquet").select("entree_id", "nom", "variantes", "termes_source", "pluriel")
    once = G.repaired(e).drop("a_romaniser")
    assert once.exceptAll(G.repaired(once).select(*once.columns)).count() == 0


def test_edit_neighbours_against_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 10))) for _ in range(120)]
    words = sorted(set(words))
    df = spark.createDataFrame([("o", w) for w in words], "oeuvre string, nom string")
    got = {(r.nom, r.mot) for r in G.within_edits(df, df.withColumnRenamed("nom", "mot"), "oeuvre", "nom", "mot").collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b) for a, b in itertools.permutations(words, 2) if 1 <= distance(a, b) <= (1 if len(a) <= 7 else 2)}
    assert got == want


def test_edit_neighbours_are_not_broadcast(spark, tmp_path):
    words = [("o", f"mot{c}{k}") for c in "abcdefgh" for k in range(1000, 1040)]
    spark.createDataFrame(words, "oeuvre string, nom string").write.parquet(f"{tmp_path}/n")
    n = spark.read.parquet(f"{tmp_path}/n")  # a small file whose neighbourhoods are not
    near = G.within_edits(n, n.withColumnRenamed("nom", "mot"), "oeuvre", "nom", "mot")
    assert near.count() > 0
    near.collect()
    assert "SortMergeJoin" in plan_of(near) and "Broadcast" not in plan_of(near)


def test_greedy_matches_against_one_by_one(spark):
    rows = [("o", "v", 1, 1, 11, 0.9), ("o", "v", 1, 1, 12, 0.8), ("o", "v", 1, 2, 11, 0.85), ("o", "v", 1, 2, 12, 0.3), ("o", "v", 2, 3, 13, 0.5), ("o", "v", 2, 4, 13, 0.5)]
    df = spark.createDataFrame(rows, "oeuvre string, tome string, planche int, ancienne bigint, nouvelle bigint, iou double")
    assert {(r.ancienne, r.nouvelle) for r in L.matched(df).collect()} == {(1, 11), (2, 12), (3, 13)}
