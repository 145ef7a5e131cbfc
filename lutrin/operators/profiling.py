"""Sizes, keys and wide profiles of texts, with a total row that stays null where nothing was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.session import table

WIDE, NARROW = T.WIDE, T.NARROW


def tokens_sql(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '{WIDE}')) + (length({x}) - len(regexp_extract_all({x}, '{WIDE}'))) // 4)"


def words_sql(x: str) -> str:
    letters = r"\p{L}+"
    return f"(len(regexp_extract_all(regexp_replace({x}, '{NARROW}', ' ', 'g'), '{letters}')) + len(regexp_extract_all({x}, '{NARROW}')) // 2)"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({x}), '{T._ACCENTED}', '{T._PLAIN}'), '[^a-z0-9 {T.CARRIES}]+', ' ', 'g'), ' +', ' ', 'g'))"


def token_estimate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.token_estimate("text").alias("jetons"), T.output_cap("text").alias("plafond"))


def word_count(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.word_count("text").alias("mots"))


def cjk_rate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(T.cjk_rate("text"), 6).alias("taux"))


def norm_key_groups(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "personnages").where("nom IS NOT NULL").select(T.norm_key("nom").alias("cle"), "nom")
    return rows.where("cle <> ''").groupBy("cle").agg(F.count("*").alias("n"), F.countDistinct("nom").alias("graphies"))


def natural_sort_rank(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "extraits").where("fichier IS NOT NULL AND oeuvre IS NOT NULL").select("oeuvre", "fichier").distinct()
    w = Window.partitionBy("oeuvre").orderBy(T.natural_key("fichier"), "fichier")
    return rows.select("oeuvre", "fichier", F.row_number().over(w).alias("rang"))


def sentence_stats(s: SparkSession, d: str) -> DataFrame:
    """Sentences per language of documents: pieces after a stop followed by a blank."""
    rows = table(s, d, "documents").where("text IS NOT NULL").select(F.lower(F.coalesce("lang", F.lit("?"))).alias("langue"), (F.regexp_count("text", F.lit(r"[.!?…]+\s")) + 1).alias("n"))
    return rows.groupBy("langue").agg(F.count("*").alias("documents"), F.sum("n").alias("phrases"), F.max("n").alias("plus"))


def bubble_quality_profile(s: SparkSession, d: str) -> DataFrame:
    """Wide profile of the bubbles by channel, with a total row; sums and rates from base rows only."""
    b = table(s, d, "bulles").select("canal", "ocr", "traduction", "score", "debordement", T.token_estimate("ocr").alias("ts"), T.token_estimate("traduction").alias("tt"))
    out = b.rollup("canal").agg(
        F.grouping("canal").cast("int").alias("total"), F.count("*").alias("bulles"), F.count("ocr").alias("lues"), F.sum(F.when(F.trim(F.coalesce("traduction", F.lit(""))) == "", 1).otherwise(0)).alias("vides"),
        F.sum("ts").alias("jetons_source"), F.sum("tt").alias("jetons_cible"), F.sum(F.when(F.col("debordement"), 1)).alias("debordements"), F.round(F.avg("score"), 6).alias("score_moyen"), F.max(F.length("traduction")).alias("plus_longue"),
        F.round(F.sum("tt") / F.sum(F.when(F.col("tt").isNotNull(), F.col("ts"))), 6).alias("rapport"),
    )
    return out


def work_inventory(s: SparkSession, d: str) -> DataFrame:
    """State of every work: pages and bubbles found against the announced volumes."""
    seen = table(s, d, "bulles").where("oeuvre IS NOT NULL").groupBy("oeuvre").agg(F.countDistinct("tome").alias("tomes"), F.countDistinct(F.struct("tome", "planche")).alias("planches"), F.count("*").alias("bulles"), F.sum(F.when(F.col("traduction").isNotNull(), 1).otherwise(0)).alias("rendues"))
    all_ = table(s, d, "oeuvres").select("oeuvre", "n_tomes").join(seen, "oeuvre", "left")
    state = F.when(F.col("bulles").isNull(), "absent").when(F.col("rendues") < F.col("bulles"), "partiel").otherwise("complet")
    return all_.select("oeuvre", "n_tomes", F.coalesce("tomes", F.lit(0)).alias("tomes"), F.coalesce("planches", F.lit(0)).alias("planches"), F.coalesce("bulles", F.lit(0)).alias("bulles"), state.alias("etat"))


def furniture_keys(s: SparkSession, d: str) -> DataFrame:
    """Repeat keys of scanned lines found in at least a tenth of a tool's files."""
    e = table(s, d, "extraits").where("text IS NOT NULL AND outil IS NOT NULL")
    rows = T.lines(e, "extrait_id", "text").join(e.select("extrait_id", "outil"), "extrait_id").select("outil", "extrait_id", T.repeat_key("ligne").alias("cle")).where("cle <> ''")
    per = rows.groupBy("outil", "cle").agg(F.countDistinct("extrait_id").alias("fichiers"))
    total = e.groupBy("outil").agg(F.count("*").alias("n"))
    return per.join(total, "outil").where(F.col("fichiers") * 10 >= F.col("n")).select("outil", "cle", "fichiers")


def origin_histogram(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bulles").groupBy("canal", "origine", "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (token_estimate, word_count, cjk_rate, norm_key_groups, natural_sort_rank, sentence_stats, bubble_quality_profile, work_inventory, furniture_keys, origin_histogram)}

SQL = {
    "token_estimate": f"SELECT doc_id, {tokens_sql('text')} AS jetons, greatest(768, least(6000, CAST(floor({tokens_sql('text')} * 2.0) AS INT) + 256)) AS plafond FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL",
    "word_count": f"SELECT doc_id, {words_sql('text')} AS mots FROM documents",
    "cjk_rate": f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '{WIDE}')) / length(text) END, 6) AS taux FROM documents WHERE text IS NOT NULL",
    "norm_key_groups": f"SELECT cle, count(*) AS n, count(DISTINCT nom) AS graphies FROM (SELECT {key_sql('nom')} AS cle, nom FROM personnages WHERE nom IS NOT NULL) WHERE cle <> '' GROUP BY cle",
    "natural_sort_rank": "SELECT oeuvre, fichier, row_number() OVER (PARTITION BY oeuvre ORDER BY list_transform(regexp_extract_all(lower(fichier), '(\\d+|\\D+)', 1), lambda t: CASE WHEN regexp_matches(t, '^\\d+$') THEN lpad(t, 12, '0') ELSE t END), fichier) AS rang FROM (SELECT DISTINCT oeuvre, fichier FROM extraits WHERE fichier IS NOT NULL AND oeuvre IS NOT NULL)",
    "sentence_stats": "SELECT lower(coalesce(lang, '?')) AS langue, count(*) AS documents, sum(len(regexp_extract_all(text, '[.!?…]+\\s')) + 1) AS phrases, max(len(regexp_extract_all(text, '[.!?…]+\\s')) + 1) AS plus FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "bubble_quality_profile": f"WITH b AS (SELECT canal, ocr, traduction, score, debordement, {tokens_sql('ocr')} AS ts, {tokens_sql('traduction')} AS tt FROM bulles) SELECT canal, grouping(canal) AS total, count(*) AS bulles, count(ocr) AS lues, sum(CASE WHEN trim(coalesce(traduction, ''), ' ') = '' THEN 1 ELSE 0 END) AS vides, sum(ts) AS jetons_source, sum(tt) AS jetons_cible, sum(CASE WHEN debordement THEN 1 END) AS debordements, round(avg(score), 6) AS score_moyen, max(length(traduction)) AS plus_longue, round(sum(tt) / sum(CASE WHEN tt IS NOT NULL THEN ts END), 6) AS rapport FROM b GROUP BY ROLLUP (canal)",
    "work_inventory": "SELECT o.oeuvre, n_tomes, coalesce(tomes, 0) AS tomes, coalesce(planches, 0) AS planches, coalesce(bulles, 0) AS bulles, CASE WHEN bulles IS NULL THEN 'absent' WHEN rendues < bulles THEN 'partiel' ELSE 'complet' END AS etat FROM oeuvres o LEFT JOIN (SELECT oeuvre, count(DISTINCT tome) AS tomes, count(DISTINCT {'t': tome, 'p': planche}) AS planches, count(*) AS bulles, count(traduction) AS rendues FROM bulles WHERE oeuvre IS NOT NULL GROUP BY oeuvre) b USING (oeuvre)",
    "furniture_keys": "WITH e AS (SELECT extrait_id, outil, unnest(string_split(text, chr(10))) AS ligne FROM extraits WHERE text IS NOT NULL AND outil IS NOT NULL), k AS (SELECT outil, extrait_id, regexp_replace(regexp_replace(lower(trim(ligne, ' ')), '[0-9]+', '#', 'g'), '[ \t]+', ' ', 'g') AS cle FROM e), n AS (SELECT outil, count(*) AS n FROM extraits WHERE text IS NOT NULL AND outil IS NOT NULL GROUP BY 1) SELECT outil, cle, fichiers FROM (SELECT outil, cle, count(DISTINCT extrait_id) AS fichiers FROM k WHERE cle <> '' GROUP BY 1, 2) JOIN n USING (outil) WHERE fichiers * 10 >= n",
    "origin_histogram": "SELECT canal, origine, kind, count(*) AS n FROM bulles GROUP BY ALL",
}
