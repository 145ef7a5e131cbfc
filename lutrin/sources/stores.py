"""Stores of single files: per-page JSON, the glossary as YAML or sectioned text, Word documents; read, migrated, written."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names: the parts a page's store may hold.
PAGE_SCHEMA = (
    "version int, regions array<struct<id:int,x0:int,y0:int,x1:int,y1:int,score:double,bbox:array<int>>>, ocr array<string>, traduction array<string>, "
    "manuelle map<string,string>, origines array<string>, structure struct<ordre:array<int>,groupes:array<int>>, mise_en_page struct<corps:int,police:string>, sfx array<string>, texte string"
)
GLOSSARY = "nom string, pluriel string, genre string, variantes array<string>, termes_source array<string>, interdits array<string>, description string, forcer boolean, cibles map<string,struct<nom:string,pluriel:string>>"


def page_of(path: Column) -> list[Column]:
    """``oeuvre, tome, planche`` out of a path ``work/volume/000012.json``."""
    at = F.split(path, "/")
    return [F.url_decode(F.element_at(at, -3)).alias("oeuvre"), F.url_decode(F.element_at(at, -2)).alias("tome"), F.regexp_extract(F.element_at(at, -1), r"(\d+)", 1).cast("int").alias("planche")]


def read_pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(pages, unreadable): every page's store with all parts, migrated to the newest form; a broken file is a row of the
    second table, never fatal.

    Version 1 kept boxes as ``bbox`` arrays; missing lists are null, so a page never looked at differs from an empty one.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.input_file_name().alias("chemin"), "value")
    rows = files.select("chemin", *page_of(F.col("chemin")), F.from_json("value", PAGE_SCHEMA + ", _brut string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_brut"}).alias("x"))
    good = rows.where("x IS NOT NULL AND x._brut IS NULL").select("oeuvre", "tome", "planche", "x.*").drop("_brut")
    boxes = F.transform("regions", lambda r, i: F.struct(F.coalesce(r["id"], i).alias("id"), *(F.coalesce(r[c], F.get(r["bbox"], k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), r["score"].alias("score")))
    return good.withColumn("regions", boxes).withColumn("version", F.lit(2)), rows.where("x IS NULL OR x._brut IS NOT NULL").select("chemin")


def page_records(pages: DataFrame) -> DataFrame:
    """``oeuvre, tome, planche, rang, id, x0, y0, x1, y1, score, ocr, traduction, origine``: the regions of pages as rows; a
    rendering made by hand lies over the other."""
    rows = pages.select("oeuvre", "tome", "planche", "ocr", "traduction", "manuelle", "origines", F.posexplode("regions").alias("rang", "r"))
    hand = F.try_element_at("manuelle", F.col("r.id").cast("string"))
    return rows.select("oeuvre", "tome", "planche", "rang", "r.*", F.get("ocr", F.col("rang")).alias("ocr"), F.coalesce(hand, F.get("traduction", F.col("rang"))).alias("traduction"), F.when(hand.isNotNull(), "manuelle").otherwise(F.get("origines", F.col("rang"))).alias("origine"))


def pages_from(bubbles: DataFrame) -> DataFrame:
    """Bubbles gathered to one store per page (a page's bubbles are few)."""
    ok = bubbles.where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL")
    each = F.sort_array(F.collect_list(F.struct("idx", "bulle_id", "x0", "y0", "x1", "y1", "score", "ocr", "traduction", "origine")))
    rows = ok.groupBy("oeuvre", "tome", "planche").agg(each.alias("b"))
    return rows.select("oeuvre", "tome", "planche", F.lit(2).alias("version"), F.transform("b", lambda x, i: F.struct(i.alias("id"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["score"].alias("score"))).alias("regions"), F.col("b.ocr").alias("ocr"), F.col("b.traduction").alias("traduction"), F.col("b.origine").alias("origines"))


def write_pages(pages: DataFrame, root: str) -> None:
    """One JSON line per page, in folders of work and volume; seen whole or not at all."""
    parts = [c for c in pages.columns if c not in ("oeuvre", "tome")]
    pages.select("oeuvre", "tome", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy("oeuvre", "tome").text(root)


def read_written_pages(spark: SparkSession, root: str) -> DataFrame:
    """What ``write_pages`` wrote."""
    rows = spark.read.text(root).select("oeuvre", "tome", F.from_json("value", "planche int, " + PAGE_SCHEMA).alias("x"))
    return rows.select(F.col("oeuvre").cast("string").alias("oeuvre"), F.col("tome").cast("string").alias("tome"), "x.*")


def read_glossaries(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """``chemin, categorie, rang`` and the fields of every entry of YAML glossaries, flat for one target language.

    Old files give ``nom`` and ``pluriel`` directly, newer ones under ``cibles``; an unreadable file is one row of nulls.
    """
    import yaml

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, text in zip(pdf["chemin"], pdf["value"]):
                try:
                    tree = yaml.safe_load(text) or {}
                    entries = [(c, i, e) for c, es in tree.items() if isinstance(es, list) for i, e in enumerate(es) if isinstance(e, dict)]
                except (yaml.YAMLError, AttributeError):
                    out.append((p, None, None, *[None] * 8))
                    continue
                for c, i, e in entries:
                    own = (e.get("cibles") or {}).get(target) or {}
                    words = [[str(v) for v in e.get(k) or []] for k in ("variantes", "termes_source", "interdits")]
                    out.append((p, str(c), i, str(own.get("nom") or e.get("nom") or ""), str(own.get("pluriel") or e.get("pluriel") or ""), str(e.get("genre") or "?"), *words, str(e.get("description") or ""), bool(e.get("forcer"))))
            yield pd.DataFrame(out, columns=["chemin", "categorie", "rang", "nom", "pluriel", "genre", "variantes", "termes_source", "interdits", "description", "forcer"]).astype({"rang": "Int32"})

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chemin"), "value")
    return files.mapInPandas(run, "chemin string, categorie string, rang int, nom string, pluriel string, genre string, variantes array<string>, termes_source array<string>, interdits array<string>, description string, forcer boolean")


def glossary_yaml(entries: DataFrame, by: str) -> DataFrame:
    """``by, texte``: the glossary of every group as YAML with all fields in one order (a group's entries are bounded).

    Strings are JSON strings, which YAML reads as they are.
    """
    fields = ["nom", "pluriel", "genre", "variantes", "termes_source", "interdits", "description", "forcer"]
    value = lambda c: F.coalesce(F.to_json(c) if c in ("variantes", "termes_source", "interdits") else F.col(c).cast("string") if c == "forcer" else F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    lines = F.concat(F.lit("  - "), F.concat_ws("\n    ", *(F.concat(F.lit(f"{c}: "), value(c)) for c in fields)))
    rows = entries.where(F.col(by).isNotNull()).select(by, F.coalesce("categorie", F.lit("termes")).alias("categorie"), F.struct("nom", lines.alias("l")).alias("x"))
    each = rows.groupBy(by, "categorie").agg(F.concat(F.col("categorie"), F.lit(":\n"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l"]), "\n")).alias("t"))
    return each.groupBy(by).agg(F.concat(F.array_join(F.sort_array(F.collect_list("t")), "\n"), F.lit("\n")).alias("texte"))


def parse_docx(content: bytes) -> list[tuple[int, str, str]]:
    """(place, kind, text) of the paragraphs of a Word document: headings by style as ``titre1`` to ``titre6``, list
    items as ``liste``, table rows as ``tableau`` (cells between bars), a bold short paragraph as ``gras``."""
    from xml.etree import ElementTree as E

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = E.fromstring(z.read("word/document.xml")).find(f"{w}body")
        named = {}
        if "word/styles.xml" in z.namelist():
            for st in E.fromstring(z.read("word/styles.xml")).iter(f"{w}style"):
                name = st.find(f"{w}name")
                named[st.get(f"{w}styleId")] = (name.get(f"{w}val") if name is not None else "").lower()
    text_of = lambda e: "".join({f"{w}t": x.text or "", f"{w}tab": "\t", f"{w}br": "\n"}.get(x.tag, "") for x in e.iter())
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{w}tbl":
            out += [("tableau", " | ".join(" ".join(text_of(c).split()) for c in r.iter(f"{w}tc"))) for r in e.iter(f"{w}tr")]
        elif e.tag == f"{w}p" and (text := text_of(e).strip()):
            style = e.find(f"{w}pPr/{w}pStyle")
            name = named.get(style.get(f"{w}val"), style.get(f"{w}val", "").lower()) if style is not None else ""
            level = next((int(c) for c in name if c.isdigit()), 1) if name.startswith(("heading", "titre", "title", "título")) else 0
            runs = [r for r in e.iter(f"{w}r") if text_of(r).strip()]
            bold = runs and all(r.find(f"{w}rPr/{w}b") is not None for r in runs)
            kind = f"titre{min(level, 6)}" if level else "liste" if e.find(f"{w}pPr/{w}numPr") is not None else "gras" if bold and len(text) <= 120 else "texte"
            out.append((kind, text))
    return [(i, k, t) for i, (k, t) in enumerate(out)]


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``chemin, rang, sorte, texte`` of every Word document; an unreadable one is one row of nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, *r) for r in parse_docx(content)]
                except Exception:  # a broken document is a finding, not a failure
                    rows.append((p, None, None, None))
            yield pd.DataFrame(rows, columns=["chemin", "rang", "sorte", "texte"]).astype({"rang": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "chemin string, rang int, sorte string, texte string")


def promoted_headings(paragraphs: DataFrame) -> DataFrame:
    """Word paragraphs as Markdown lines; where a document has no heading style, bold lines said once are its headings."""
    from pyspark.sql import Window

    styled = F.max(F.col("sorte").startswith("titre")).over(Window.partitionBy("chemin"))
    once = F.count("*").over(Window.partitionBy("chemin", "sorte", "texte")) == 1
    level = F.when(F.col("sorte").startswith("titre"), F.substring("sorte", 6, 1).cast("int")).when(~styled & once & (F.col("sorte") == "gras"), 2)
    sign = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).when(F.col("sorte") == "liste", "- ").when(F.col("sorte") == "tableau", "| ").otherwise("")
    return paragraphs.where("rang IS NOT NULL").select("chemin", "rang", F.concat(sign, "texte", F.when(F.col("sorte") == "tableau", " |").otherwise("")).alias("ligne"))
