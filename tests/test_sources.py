import json
import zipfile

import pytest

from lutrin.sources import readers as R
from lutrin.sources import writers as W


def test_html_text_keeps_headings_images_and_readings():
    p = R._Text()
    p.feed("<head><title>no</title></head><h2>Un</h2><p>Le <ruby>漢<rt>かん</rt></ruby>字</p><script>x</script><img src='a.png'>fin")
    assert p.text() == "## Un\n\nLe 漢字\n\n<!-- IMG: a.png -->\n\nfin"
    assert p.readings == [("漢", "かん")]
    assert R.html_to_text(None) is None and R.html_to_text("") == ""


def test_json_lines_report_the_malformed(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"n": 1, "r": "a"}\nbroken\n\n{"n": 2, "r": null}\n')
    good, bad = R.read_json_lines(spark, str(tmp_path), "n int, r string")
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (2, None)]
    assert [r.ligne for r in bad.collect()] == ["broken"]


def test_table_with_comments_and_mark(spark, tmp_path):
    (tmp_path / "g.csv").write_text(chr(0xFEFF) + 'categorie;nom\nlieux;"Tour; Nord"\n# lost\npersonnages; Ana \n', encoding="utf-8")
    assert sorted(map(tuple, R.read_table(spark, str(tmp_path / "g.csv"), ["categorie", "nom"]).collect())) == [("lieux", "Tour; Nord"), ("personnages", "Ana")]
    assert R.read_table(spark, str(tmp_path / "g.csv"), ["autre"]).count() == 0


def test_archives_in_natural_order(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.cbz", "w") as z:
        for n in ("p10.png", "p2.png", "note.txt"):
            z.writestr(n, b"x")
    (tmp_path / "b.cbz").write_bytes(b"not a zip")
    rows = R.read_archives(spark, str(tmp_path)).orderBy("archive", "rang").collect()
    assert [r.membre for r in rows] == ["p2.png", "p10.png", None]


def test_epub_in_reading_order(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/nav.xhtml", '<html><body><nav><a href="b.xhtml">Prologue</a></nav></body></html>')
        z.writestr("O/b.xhtml", "<html><body><p>Début.</p></body></html>")
        z.writestr("O/a.xhtml", "<html><body><h1>Un</h1><p>Suite.</p></body></html>")
    (tmp_path / "x.epub").write_bytes(b"broken")
    rows = R.read_epubs(spark, str(tmp_path)).orderBy("chemin", "rang").collect()
    assert [r.texte for r in rows] == ["# Prologue\n\nDébut.", "# Un\n\nSuite.", None]


def test_annotations_and_logs(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.png", "width": 9, "height": 9}], "annotations": [{"id": 7, "image_id": 1, "category_id": 0, "bbox": [1, 2, 3, 4]}]}))
    assert tuple(R.read_annotations(spark, str(tmp_path / "c.json")).first())[2:] == ("a.png", 0, 1.0, 2.0, 4.0, 6.0)
    (tmp_path / "p.log").write_text("[ocr] page 1/2 : 1.5s\n# run\n[ocr] page 2/2 : 2.5s\nch1 [relecture] bloc 1/9 : 3s\n")
    rows = {(r.run, r.phase): (r.n, r.secondes) for r in R.read_perf_log(spark, str(tmp_path / "p.log")).collect()}
    assert rows == {(0, "ocr"): (1, 1.5), (1, "ocr"): (1, 2.5), (1, "relecture"): (1, 3.0)}


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], None), ("b;c", [], 2)], "nom string, formes array<string>, n int")
    W.write_table(df, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), sep=";", header=True)
    assert sorted((r.nom, r.formes) for r in back.collect()) == [("a", "x, y"), ("b;c", None)] or sorted((r.nom, r.formes or "") for r in back.collect()) == [("a", "x, y"), ("b;c", "")]
    lines = [r.ligne for r in W.markdown_rows(df.select("nom", "n"), ["nom"]).collect()]
    assert lines == ["| nom | n |", "|---|---|", "| a | — |", "| b;c | 2 |"]
    W.write_corpus(df, str(tmp_path / "c"), ["nom"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    W.append_journal(df, str(tmp_path / "j"))
    W.append_journal(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_volumes_by_path(spark, tmp_path):
    p = tmp_path / "Oeuvre" / "Vol.1" / "FR"
    p.mkdir(parents=True)
    (p / "a.txt").write_text("x")
    rows = R.read_volumes(spark, str(tmp_path), ["fr"]).collect()
    assert [(r.oeuvre, r.tome, r.langue, r.fichier) for r in rows] == [("Oeuvre", "Vol.1", "fr", "a.txt")]
    assert R.read_volumes(spark, str(tmp_path), ["ja"]).count() == 0


@pytest.mark.parametrize("html", ["<p", "<p><b>x", "&lt;", "<br/><br/>"])
def test_broken_markup_does_not_fail(html):
    assert isinstance(R.html_to_text(html), str)
