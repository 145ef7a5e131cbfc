"""Volumes planned from what is there: chapters out of file names, mode and pivot language, images and their places,
blocks still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.session import table

#: Words of a file name, in the languages met.
_FIRST, _LAST, _AFTER = "prologue|prólogo|prologo|序章|プロローグ", "epilogue|épilogue|epílogo|終章|エピローグ", "postface|後書|あとがき|跋"
_CHAPTER = r"(?:chap(?:ter|itre)?|cap[íi]tulo|第)\s*\.?\s*(\d+)"


def chapter_key(name: Column) -> Column:
    """``rang, numero, titre`` of a file name: prologue 0, chapter 1, end 3; null where nothing is recognised."""
    low = F.lower(name)
    number = F.regexp_extract(low, _CHAPTER, 1)
    made = lambda rank, n, title: F.struct(F.lit(rank).alias("rang"), n.cast("int").alias("numero"), title.alias("titre"))
    return F.when(low.rlike(_FIRST), made(0, F.lit(0), F.lit("Prologue"))).when(low.rlike(_AFTER), made(3, F.lit(1), F.lit("Postface"))).when(low.rlike(_LAST), made(3, F.lit(0), F.lit("Épilogue"))).when(number != "", made(1, number, F.concat(F.lit("Chapitre "), number.cast("int").cast("string"))))


def chapter_groups(files: DataFrame, by: list[str], name: str) -> DataFrame:
    """``by, groupe, rang, numero, fichiers``: consecutive files of one chapter, in natural order; nothing for a group
    of files with an unreadable name or a single chapter."""
    rows = files.withColumn("_k", chapter_key(F.col(name)))
    w = Window.partitionBy(*by).orderBy(T.natural_key(name), name)
    same = F.lag("_k").over(w)
    rows = rows.withColumn("_new", F.when(same.isNotNull() & (same["rang"] == F.col("_k.rang")) & (same["numero"] == F.col("_k.numero")), 0).otherwise(1))
    rows = rows.withColumn("groupe", F.sum("_new").over(w)).withColumn("_veto", F.max(F.col("_k").isNull()).over(Window.partitionBy(*by))).withColumn("_groups", F.sum("_new").over(Window.partitionBy(*by)))
    return rows.where("NOT _veto AND _groups >= 2").groupBy(*by, "groupe").agg(F.min("_k.rang").alias("rang"), F.min("_k.numero").alias("numero"), F.count("*").alias("fichiers"))


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "extraits").where("oeuvre IS NOT NULL AND fichier IS NOT NULL").select("oeuvre", "fichier").distinct()


def q_chapter_keys(s, d):
    rows = _files(s, d).withColumn("k", chapter_key(F.col("fichier")))
    return rows.select("oeuvre", "fichier", "k.rang", "k.numero", "k.titre")


def q_chapter_groups(s, d):
    return chapter_groups(_files(s, d), ["oeuvre"], "fichier")


def q_mode_and_pivot(s, d, priority: tuple = ("en", "es", "ja")):
    """Mode of every work and the language its parts are measured by: French improves, else the first of the priority."""
    e = table(s, d, "extraits").where("oeuvre IS NOT NULL AND langue IS NOT NULL").select("oeuvre", F.lower(F.substring(F.trim("langue"), 1, 2)).alias("l")).where("l <> ''")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("l")), F.lit(0).cast("bigint")), F.lit(99).cast("bigint"))
    out = e.groupBy("oeuvre").agg(F.max(F.col("l") == "fr").alias("fr"), F.min(F.struct(rank.alias("r"), "l")).alias("p"), F.countDistinct("l").alias("langues"))
    return out.select("oeuvre", F.when(F.col("fr"), "amelioration").otherwise("traduction").alias("mode"), F.when(F.col("fr"), "fr").otherwise(F.col("p.l")).alias("pivot"), "langues")


def q_image_places(s, d):
    """Images of an extract and the share of its text that stands before their marker; null for those never referred to."""
    e = table(s, d, "extraits").where("extrait_id IS NOT NULL")
    held = e.select("extrait_id", "oeuvre", F.explode("images").alias("image"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    at = F.instr("t", F.concat(F.lit("<!-- IMG: "), F.col("image")))
    return held.select("extrait_id", F.concat_ws("/", "oeuvre", "image").alias("cle"), F.when(at > 0, F.round((at - 1) / F.length("t"), 6)).alias("part"))


def q_pending_blocks(s, d, size: int = 10):
    """Blocks of ten pages of every volume that still hold a bubble without rendering; the others are done."""
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND trim(ocr) <> ''").select("oeuvre", "tome", F.floor(F.col("planche") / size).cast("int").alias("bloc"), F.coalesce(F.trim("traduction") != "", F.lit(False)).alias("fait"))
    done = b.groupBy("oeuvre", "tome", "bloc").agg(F.min("fait").alias("fini")).where("fini").select("oeuvre", "tome", "bloc")
    return b.join(done, ["oeuvre", "tome", "bloc"], "left_anti").groupBy("oeuvre", "tome", "bloc").agg(F.count("*").alias("bulles"), F.count_if(~F.col("fait")).alias("manquent"))


def q_extract_conflicts(s, d):
    """Conforming and deviating extracts per tool, and what blocks: no text, no work, an unreadable language."""
    e = table(s, d, "extraits").where("outil IS NOT NULL")
    why = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "sans texte").when(F.col("oeuvre").isNull(), "sans oeuvre").when(~F.coalesce(F.lower(F.substring(F.trim("langue"), 1, 2)).isin("en", "fr", "es", "ja"), F.lit(False)), "langue illisible")
    return e.groupBy("outil", why.alias("motif")).agg(F.count("*").alias("n")).where("motif IS NOT NULL")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_F = "f AS (SELECT DISTINCT oeuvre, fichier FROM extraits WHERE oeuvre IS NOT NULL AND fichier IS NOT NULL)"
_NAT = r"list_transform(regexp_extract_all(lower(fichier), '(\d+|\D+)', 1), lambda t: CASE WHEN regexp_matches(t, '^\d+$') THEN lpad(t, 12, '0') ELSE t END)"
_CK = f"c AS (SELECT oeuvre, fichier, CASE WHEN regexp_matches(lower(fichier), '{_FIRST}') THEN 0 WHEN regexp_matches(lower(fichier), '{_AFTER}|{_LAST}') THEN 3 WHEN regexp_extract(lower(fichier), '{_CHAPTER}', 1) <> '' THEN 1 END AS rang, CASE WHEN regexp_matches(lower(fichier), '{_FIRST}') THEN 0 WHEN regexp_matches(lower(fichier), '{_AFTER}') THEN 1 WHEN regexp_matches(lower(fichier), '{_LAST}') THEN 0 ELSE CAST(nullif(regexp_extract(lower(fichier), '{_CHAPTER}', 1), '') AS INT) END AS numero, CASE WHEN regexp_matches(lower(fichier), '{_FIRST}') THEN 'Prologue' WHEN regexp_matches(lower(fichier), '{_AFTER}') THEN 'Postface' WHEN regexp_matches(lower(fichier), '{_LAST}') THEN 'Épilogue' ELSE 'Chapitre ' || CAST(nullif(regexp_extract(lower(fichier), '{_CHAPTER}', 1), '') AS INT) END AS titre FROM f)"
SQL = {
    "chapter_keys": f"WITH {_F}, {_CK} SELECT * FROM c",
    "chapter_groups": f"WITH {_F}, {_CK}, n AS (SELECT *, CASE WHEN lag(rang) OVER w = rang AND lag(numero) OVER w = numero THEN 0 ELSE 1 END AS neu, {_NAT} AS nat FROM c WINDOW w AS (PARTITION BY oeuvre ORDER BY {_NAT}, fichier)), g AS (SELECT *, sum(neu) OVER (PARTITION BY oeuvre ORDER BY nat, fichier) AS groupe, bool_or(rang IS NULL) OVER (PARTITION BY oeuvre) AS veto, sum(neu) OVER (PARTITION BY oeuvre) AS tous FROM n) SELECT oeuvre, groupe, min(rang) AS rang, min(numero) AS numero, count(*) AS fichiers FROM g WHERE NOT veto AND tous >= 2 GROUP BY 1, 2",
    "mode_and_pivot": "WITH e AS (SELECT oeuvre, lower(substring(trim(langue, ' '), 1, 2)) AS l FROM extraits WHERE oeuvre IS NOT NULL AND langue IS NOT NULL), r AS (SELECT oeuvre, l, CASE l WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'ja' THEN 3 ELSE 99 END AS r FROM e WHERE l <> '') SELECT oeuvre, CASE WHEN bool_or(l = 'fr') THEN 'amelioration' ELSE 'traduction' END AS mode, CASE WHEN bool_or(l = 'fr') THEN 'fr' ELSE first(l ORDER BY r, l) END AS pivot, count(DISTINCT l) AS langues FROM r GROUP BY 1",
    "image_places": "WITH h AS (SELECT DISTINCT extrait_id, oeuvre, unnest(images) AS image, coalesce(text, '') AS t FROM extraits WHERE extrait_id IS NOT NULL) SELECT extrait_id, concat_ws('/', oeuvre, image) AS cle, CASE WHEN instr(t, '<!-- IMG: ' || image) > 0 THEN round((instr(t, '<!-- IMG: ' || image) - 1) / length(t), 6) END AS part FROM h",
    "pending_blocks": "WITH b AS (SELECT oeuvre, tome, planche // 10 AS bloc, coalesce(trim(traduction, ' ') <> '', false) AS fait FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND trim(ocr, ' ') <> '') SELECT oeuvre, tome, bloc, count(*) AS bulles, count(*) FILTER (NOT fait) AS manquent FROM b GROUP BY 1, 2, 3 HAVING count(*) FILTER (NOT fait) > 0",
    "extract_conflicts": "WITH w AS (SELECT outil, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'sans texte' WHEN oeuvre IS NULL THEN 'sans oeuvre' WHEN NOT coalesce(lower(substring(trim(langue, ' '), 1, 2)) IN ('en', 'fr', 'es', 'ja'), false) THEN 'langue illisible' END AS motif FROM extraits WHERE outil IS NOT NULL) SELECT outil, motif, count(*) AS n FROM w WHERE motif IS NOT NULL GROUP BY 1, 2",
}
