"""Ordered registries of quality rules as one CASE (first reason) or one array (all reasons)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.operators.profiling import tokens_sql, words_sql
from lutrin.session import spread, table

#: Least ratio of answer to source tokens, by script of the source; sources under 8 tokens don't count.
SHORT_WIDE, SHORT_LATIN, SHORT_FLOOR, COPY_FLOOR = 0.22, 0.55, 8, 12
LOSS = 0.60


def measured(df: DataFrame, source: str, answer: str, language: str) -> DataFrame:
    """Add what the rules compare, each worked out once: sizes in tokens and words, keys, script."""
    return df.withColumns({
        "_ts": T.token_estimate(source), "_tt": T.token_estimate(answer), "_ws": T.word_count(source), "_wt": T.word_count(answer),
        "_ks": T.copy_key(source), "_kt": T.copy_key(answer), "_large": F.col(language).isin("jp", "ja", "zh", "ko"),
        "_vide": F.trim(F.coalesce(answer, F.lit(""))) == "", "_kana": F.col(answer).rlike(T.NARROW),
    })


def rules() -> list[tuple[str, Column]]:
    """(reason, predicate) from the coarsest to the finest; the order is their meaning.  On ``measured``."""
    c = F.col
    cap = F.greatest(F.lit(768), F.least(F.lit(6000), F.floor(c("_ts") * 2.0).cast("int") + 256))
    residual = F.when(c("_large"), c("_kana")).otherwise((c("_ks") == c("_kt")) & (F.length("_ks") >= COPY_FLOOR))
    return [
        ("vide", c("_vide")),
        ("emballement", c("_tt") >= cap * 0.95),
        ("source_residuelle", residual),
        ("trop_longue", c("_tt") > F.greatest(F.lit(24), c("_ts") * 3)),
        ("trop_courte", (c("_ts") >= SHORT_FLOOR) & (c("_tt") < F.when(c("_large"), SHORT_WIDE).otherwise(SHORT_LATIN) * c("_ts"))),
        ("perte_mots", c("_wt") < c("_ws") * LOSS),
    ]


def first_reason(registry: list[tuple[str, Column]]) -> Column:
    out = F
    for name, predicate in registry:
        out = out.when(F.coalesce(predicate, F.lit(False)), name)
    return out


def all_reasons(registry: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in registry]))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return measured(spread(table(s, d, "bulles").select("bulle_id", "canal", "ocr", "traduction", "langue_source")).where("ocr IS NOT NULL AND trim(ocr) <> ''"), "ocr", "traduction", "langue_source")


def first_failure_reason(s: SparkSession, d: str) -> DataFrame:
    # A generator instead of a filter on the result: the optimizer would copy the whole registry into the scan.
    return _pairs(s, d).select("bulle_id", F.explode(F.slice(all_reasons(rules()), 1, 1)).alias("motif"))


def all_failure_reasons(s: SparkSession, d: str) -> DataFrame:
    rows = _pairs(s, d).select("bulle_id", all_reasons(rules()).alias("m"))
    return rows.select("bulle_id", F.explode(F.when(F.size("m") > 0, F.array(F.array_join("m", "+"))).otherwise(F.array().cast("array<string>"))).alias("motifs"))


def reason_histogram(s: SparkSession, d: str) -> DataFrame:
    rows = _pairs(s, d).select("canal", F.explode(all_reasons(rules())).alias("motif"))
    return rows.groupBy("canal", "motif").agg(F.count("*").alias("n"))


def runaway_repetition(s: SparkSession, d: str) -> DataFrame:
    """Extracts in which a line of 40 characters or more stands at least three times."""
    rows = T.lines(table(s, d, "extraits"), "extrait_id", "text").select("extrait_id", F.trim("ligne").alias("l")).where("length(l) >= 40")
    return rows.groupBy("extrait_id", "l").agg(F.count("*").alias("n")).where("n >= 3").groupBy("extrait_id").agg(F.max("n").alias("plus"), F.count("*").alias("lignes"))


def repeated_line_collapse(s: SparkSession, d: str) -> DataFrame:
    """Sizes after keeping only the first of long lines seen three times or more."""
    w = Window.partitionBy("doc_id", "l")
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").withColumn("l", F.trim("ligne"))
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("pos")))
    kept = (F.length("l") < 60) | (F.col("n") < 3) | (F.col("r") == 1)
    return rows.groupBy("doc_id").agg(F.count("*").alias("avant"), F.sum(F.when(kept, 1).otherwise(0)).alias("apres"))


def dedup_bullets(s: SparkSession, d: str) -> DataFrame:
    """Bullet lines of a document, the first of identical ones only."""
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.trim("ligne").alias("l")).where("l LIKE '- %' OR l LIKE '* %'")
    w = Window.partitionBy("doc_id", "l").orderBy("pos")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "pos", F.col("l").alias("ligne"))


def contamination_exact_line(s: SparkSession, d: str) -> DataFrame:
    """Lines of other documents that are exactly a line (12 characters or more) of a style guide."""
    docs = table(s, d, "documents")
    guide = T.lines(docs.where("genre = 'guide'"), "doc_id", "text").select(F.trim("ligne").alias("l")).where("length(l) >= 12").distinct()
    rows = T.lines(docs.where("genre IS DISTINCT FROM 'guide'"), "doc_id", "text").select("doc_id", F.trim("ligne").alias("l"))
    return rows.join(guide, "l", "left_semi").groupBy("doc_id").agg(F.count("*").alias("lignes"))


def leak_zone(s: SparkSession, d: str) -> DataFrame:
    """Glossary-like lines and the section titles that an entry follows within three lines."""
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").withColumn("entree", F.when(F.col("ligne").rlike(r"^- .+\|"), 1).otherwise(0)).withColumn("titre", F.col("ligne").startswith("#"))
    near = F.max("entree").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, 3))
    rows = rows.withColumn("fuite", (F.col("entree") == 1) | (F.col("titre") & (F.coalesce(near, F.lit(0)) == 1)))
    return rows.where("fuite").groupBy("doc_id").agg(F.count("*").alias("lignes"), F.min("pos").alias("premiere"))


def register_of(text) -> Column:
    """Form of address of a French line: tu, vous, or nothing for neither and for both."""
    low = F.lower(text)
    tu = low.rlike(r"(^|[^\p{L}])(tu|te|toi|ton|ta|tes|t['’])([^\p{L}]|$)|(^|[^\p{L}])t['’]\p{L}")
    vous = low.rlike(r"(^|[^\p{L}])(vous|votre|vos)([^\p{L}]|$)")
    return F.when(tu & ~vous, "tu").when(vous & ~tu, "vous").otherwise("")


def register_by_page(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "bulles").where("langue_cible = 'fr' AND traduction IS NOT NULL AND oeuvre IS NOT NULL AND tome IS NOT NULL").select("oeuvre", "tome", "planche", register_of(F.col("traduction")).alias("r"))
    return b.groupBy("oeuvre", "tome", "planche").agg(F.sum(F.when(F.col("r") == "tu", 1).otherwise(0)).alias("tu"), F.sum(F.when(F.col("r") == "vous", 1).otherwise(0)).alias("vous")).where("tu + vous > 0")


QUERIES = {f.__name__: f for f in (first_failure_reason, all_failure_reasons, reason_histogram, runaway_repetition, repeated_line_collapse, dedup_bullets, contamination_exact_line, leak_zone, register_by_page)}

_R = f"""WITH p AS (SELECT bulle_id, canal, ocr, traduction, langue_source IN ('jp','ja','zh','ko') AS large, {tokens_sql('ocr')} AS ts, {tokens_sql('traduction')} AS tt, {words_sql('ocr')} AS ws, {words_sql('traduction')} AS wt,
 regexp_replace(lower(ocr), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS ks, regexp_replace(lower(traduction), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS kt FROM bulles WHERE ocr IS NOT NULL AND trim(ocr, ' ') <> ''),
 r AS (SELECT *, trim(coalesce(traduction, ''), ' ') = '' AS m1, coalesce(tt >= greatest(768, least(6000, CAST(floor(ts * 2.0) AS INT) + 256)) * 0.95, false) AS m2, coalesce(CASE WHEN large THEN regexp_matches(traduction, '{T.NARROW}') ELSE ks = kt AND length(ks) >= 12 END, false) AS m3,
 coalesce(tt > greatest(24, ts * 3), false) AS m4, coalesce(ts >= 8 AND tt < CASE WHEN large THEN 0.22 ELSE 0.55 END::DOUBLE * ts, false) AS m5, coalesce(wt < ws * 0.60::DOUBLE, false) AS m6 FROM p)"""
_LIST = "list_filter([CASE WHEN m1 THEN 'vide' END, CASE WHEN m2 THEN 'emballement' END, CASE WHEN m3 THEN 'source_residuelle' END, CASE WHEN m4 THEN 'trop_longue' END, CASE WHEN m5 THEN 'trop_courte' END, CASE WHEN m6 THEN 'perte_mots' END], lambda x: x IS NOT NULL)"
_LINES = "WITH l AS (SELECT doc_id, genre, unnest(string_split(text, chr(10))) AS ligne, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"

SQL = {
    "first_failure_reason": _R + " SELECT bulle_id, CASE WHEN m1 THEN 'vide' WHEN m2 THEN 'emballement' WHEN m3 THEN 'source_residuelle' WHEN m4 THEN 'trop_longue' WHEN m5 THEN 'trop_courte' ELSE 'perte_mots' END AS motif FROM r WHERE m1 OR m2 OR m3 OR m4 OR m5 OR m6",
    "all_failure_reasons": _R + f" SELECT bulle_id, array_to_string({_LIST}, '+') AS motifs FROM r WHERE m1 OR m2 OR m3 OR m4 OR m5 OR m6",
    "reason_histogram": _R + f" SELECT canal, motif, count(*) AS n FROM (SELECT canal, unnest({_LIST}) AS motif FROM r) GROUP BY ALL",
    "runaway_repetition": "WITH l AS (SELECT extrait_id, trim(unnest(string_split(text, chr(10))), ' ') AS l FROM extraits WHERE text IS NOT NULL) SELECT extrait_id, max(n) AS plus, count(*) AS lignes FROM (SELECT extrait_id, l, count(*) AS n FROM l WHERE length(l) >= 40 GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY extrait_id",
    "repeated_line_collapse": _LINES + ", m AS (SELECT doc_id, length(trim(ligne, ' ')) AS t, count(*) OVER (PARTITION BY doc_id, trim(ligne, ' ')) AS n, row_number() OVER (PARTITION BY doc_id, trim(ligne, ' ') ORDER BY pos) AS r FROM l) SELECT doc_id, count(*) AS avant, count(*) FILTER (t < 60 OR n < 3 OR r = 1) AS apres FROM m GROUP BY doc_id",
    "dedup_bullets": _LINES + ", m AS (SELECT doc_id, pos, trim(ligne, ' ') AS ligne FROM l) SELECT doc_id, pos, ligne FROM m WHERE ligne LIKE '- %' OR ligne LIKE '* %' QUALIFY row_number() OVER (PARTITION BY doc_id, ligne ORDER BY pos) = 1",
    "contamination_exact_line": _LINES + " SELECT doc_id, count(*) AS lignes FROM l WHERE genre IS DISTINCT FROM 'guide' AND trim(ligne, ' ') IN (SELECT trim(ligne, ' ') FROM l WHERE genre = 'guide' AND length(trim(ligne, ' ')) >= 12) GROUP BY doc_id",
    "leak_zone": _LINES + ", m AS (SELECT doc_id, pos, ligne LIKE '#%' AS titre, CASE WHEN regexp_matches(ligne, '^- .+\\|') THEN 1 ELSE 0 END AS entree FROM l), n AS (SELECT *, max(entree) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS pres FROM m) SELECT doc_id, count(*) AS lignes, min(pos) AS premiere FROM n WHERE entree = 1 OR (titre AND pres = 1) GROUP BY doc_id",
    "register_by_page": r"WITH b AS (SELECT oeuvre, tome, planche, regexp_matches(lower(traduction), '(^|[^\p{L}])(tu|te|toi|ton|ta|tes|t[''’])([^\p{L}]|$)|(^|[^\p{L}])t[''’]\p{L}') AS t, regexp_matches(lower(traduction), '(^|[^\p{L}])(vous|votre|vos)([^\p{L}]|$)') AS v FROM bulles WHERE langue_cible = 'fr' AND traduction IS NOT NULL AND oeuvre IS NOT NULL AND tome IS NOT NULL) SELECT oeuvre, tome, planche, count(*) FILTER (t AND NOT v) AS tu, count(*) FILTER (v AND NOT t) AS vous FROM b GROUP BY ALL HAVING count(*) FILTER (t <> v) > 0",
}
