"""Readers: text, line logs, JSON lines, separated tables, archives and e-books, annotation files.

Every reader is a DataFrame over files read where they lie; archive members are opened in the executors from
``binaryFile`` rows, so a folder of any number of archives is read in parallel.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.functions import text as T

_MUTED = frozenset(("head", "script", "style", "nav", "template", "noscript"))
_BLOCKS = frozenset(("p", "div", "br", "li", "tr", "blockquote", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"))


class _Text(HTMLParser):
    """Visible text of a page: headings as ``#`` lines, images as markers, readings (ruby) apart."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.readings: list[tuple[str, str]] = []
        self._muted = 0
        self._ruby: list[str] | None = None
        self._rt: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _MUTED:
            self._muted += 1
        elif self._muted:
            return
        elif tag == "img":
            self.parts.append(f"\n\n<!-- IMG: {dict(attrs).get('src') or ''} -->\n\n")
        elif tag == "ruby":
            self._ruby = []
        elif tag == "rt":
            self._rt = []
        elif tag in _BLOCKS:
            self.parts.append("\n" if tag == "br" else "\n\n")
            if tag[0] == "h" and tag[1:].isdigit():
                self.parts.append("#" * int(tag[1]) + " ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _MUTED:
            self._muted = max(0, self._muted - 1)
        elif tag == "ruby" and self._ruby is not None:
            self.parts.append("".join(self._ruby))
            if self._rt:
                self.readings.append(("".join(self._ruby), "".join(self._rt)))
            self._ruby = self._rt = None
        elif tag in _BLOCKS and not self._muted:
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self._muted:
            return
        if self._rt is not None:
            self._rt.append(data)
        elif self._ruby is not None:
            self._ruby.append(data)
        else:
            self.parts.append(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        joined = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(self.parts))
        return re.sub(r"\n{3,}", "\n\n", joined).strip()


def html_to_text(html: str | None) -> str | None:
    """Readable text of an HTML page; null stays null, broken markup gives what can be read."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return parser.text()


def html_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the visible text of an HTML column, batch by batch."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(html_to_text, na_action="ignore")

    return df.withColumn(name, read(F.col(column)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``chemin, texte``: whole text files of a folder, line ends as they are."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chemin"), F.col("value").alias("texte"))


def read_volumes(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """Files laid out as work/volume/language/file: partition columns from the path, pruned before reading."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.split("path", "/")
    out = rows.select(F.element_at(at, -4).alias("oeuvre"), F.element_at(at, -3).alias("tome"), F.lower(F.element_at(at, -2)).alias("langue"), F.element_at(at, -1).alias("fichier"), "length", "content")
    return out.where(F.col("langue").isin([x.lower() for x in languages])) if languages else out


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of an append-only journal; a malformed line is reported, never fatal."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema + ", _brut string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_brut"}).alias("x"))
    good = parsed.where("x IS NOT NULL AND x._brut IS NULL").select("x.*").drop("_brut")
    return good, parsed.where("x IS NULL OR x._brut IS NOT NULL").select(F.col("value").alias("ligne"))


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A glossary table with ``;`` or ``,`` between cells, ``#`` comments, a byte order mark and quoted cells.

    The delimiter is the one whose header holds the wanted columns; a file with neither gives no rows.
    """
    head = [r.value.lstrip(chr(0xFEFF)) for r in spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) <> ''").limit(1).collect()]
    for sep in (";", ",", "\t"):
        if head and set(columns) <= {c.strip().strip('"') for c in head[0].split(sep)}:
            rows = spark.read.csv(path, sep=sep, header=True, comment="#", multiLine=True, escape='"', encoding="UTF-8")
            rows = rows.toDF(*[c.lstrip(chr(0xFEFF)).strip() for c in rows.columns])
            return rows.select(*[F.trim(c).alias(c) for c in columns])
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))


def _members(batches: Iterator[pd.DataFrame], wanted: re.Pattern) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, i.filename, i.file_size, z.read(i)) for i in z.infolist() if wanted.search(i.filename)]
            except zipfile.BadZipFile:
                rows.append((path, None, None, None))
        yield pd.DataFrame(rows, columns=["archive", "membre", "taille", "contenu"])


def read_archives(spark: SparkSession, path: str, wanted: str = r"\.(?:png|jpe?g|webp|gif)$") -> DataFrame:
    """Members of zip archives (comic books); an unreadable archive is one row with null members."""
    pattern = re.compile(wanted, re.I)
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.mapInPandas(lambda it: _members(it, pattern), "archive string, membre string, taille bigint, contenu binary").withColumn("rang", T.natural_key("membre"))


def parse_epub(content: bytes) -> list[tuple[int, str, str, str]]:
    """(place, name, title, text) of the documents of an e-book, in its order of reading."""
    from xml.etree import ElementTree as E

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        opf = next(e.get("full-path") for e in E.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        base, tree = posixpath.dirname(opf), E.fromstring(z.read(opf))
        items = {e.get("id"): e for e in tree.iter() if local(e) == "item"}
        titles: dict[str, str] = {}
        for e in items.values():
            href = posixpath.normpath(posixpath.join(base, e.get("href", "")))
            if "nav" in (e.get("properties") or "").split() and href in names:
                for a in E.fromstring(z.read(href)).iter():
                    if local(a) == "a" and a.get("href"):
                        titles.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(href), a.get("href").split("#")[0])), " ".join("".join(a.itertext()).split()))
            elif (e.get("media-type") or "").endswith("ncx+xml") and href in names:
                for p in E.fromstring(z.read(href)).iter():
                    if local(p) == "navPoint":
                        label = next((x for x in p.iter() if local(x) == "text"), None)
                        at = next((x for x in p.iter() if local(x) == "content"), None)
                        if label is not None and at is not None:
                            titles.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(href), at.get("src", "").split("#")[0])), (label.text or "").strip())
        out = []
        for k, ref in enumerate(e for e in tree.iter() if local(e) == "itemref"):
            item = items.get(ref.get("idref"))
            href = posixpath.normpath(posixpath.join(base, item.get("href", ""))) if item is not None else ""
            if href in names and "html" in (item.get("media-type") or ""):
                text = html_to_text(z.read(href).decode("utf-8", "replace")) or ""
                title = titles.get(href, "")
                if title and not text.lstrip().startswith("#"):
                    text = f"# {title}\n\n{text}"
                out.append((k, href, title, text))
        return out


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """``chemin, rang, document, titre, texte`` of every e-book; an unreadable one is one row of nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, *r) for r in parse_epub(content)]
                except Exception:  # a broken book is a finding, not a failure
                    rows.append((p, None, None, None, None))
            yield pd.DataFrame(rows, columns=["chemin", "rang", "document", "titre", "texte"]).astype({"rang": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "chemin string, rang int, document string, titre string, texte string")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of an annotation file with ``images`` and ``annotations``: one row per annotation and its image."""
    schema = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select("i.*").withColumnRenamed("id", "image_id")
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    box = F.col("bbox")
    return boxes.join(images, "image_id").select("id", "image_id", "file_name", "category_id", box[0].alias("x0"), box[1].alias("y0"), (box[0] + box[2]).alias("x1"), (box[1] + box[3]).alias("y1"))


def read_perf_log(spark: SparkSession, path: str) -> DataFrame:
    """Runs of append-only logs: ``chemin, run, phase, n, secondes``; lines before the first header are run 0."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chemin"), F.posexplode(F.split("value", "\n")).alias("pos", "ligne"))
    from pyspark.sql import Window

    w = Window.partitionBy("chemin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum(F.when(F.col("ligne").startswith("#"), 1).otherwise(0)).over(w))
    hit = r"\[(\p{L}+)\] (?:page|bloc) \d+/\d+ ?: (\d+(?:\.\d+)?)s"
    rows = rows.select("chemin", "run", F.regexp_extract("ligne", hit, 1).alias("phase"), F.regexp_extract("ligne", hit, 2).alias("sec")).where("phase <> ''")
    return rows.groupBy("chemin", "run", "phase").agg(F.count("*").alias("n"), F.sum(F.col("sec").cast("double")).alias("secondes"))
