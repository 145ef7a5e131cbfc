"""Marks of what went wrong in a text, and the expressions that clean, measure or read single lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.operators.glossary import _REP, repaired
from lutrin.operators.profiling import tokens_sql, words_sql
from lutrin.session import table

_WIDE = "[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]"
_IMAGE = r"<!-- IMG: [^>]*-->"
_COMMENT = r"(?s)<!--.*?-->"
_TITLE = r"(?m)^#{1,6}\s+\S"
#: Fixed patterns: signs of a glossary copied into a text, two of which are needed; the heading of a style guide.
LEAKS = (r"(?im)^\s*#+\s*(personnages|lieux|organisations|créatures|objets|termes)\b", r"\[(?:masculin|féminin|\?)[^\]]*(?:FORCÉ|NE PAS TRADUIRE)[^\]]*\]", r"(?i)\(variantes\s*:", r"(?i)\| ?source ?:")
_STYLE = r"(?im)^\s*#+\s*(?:guide de style|style guide|guía de estilo)"
_AUXILIARY = r"(?:^|[^\p{L}])(?:ai|as|a|avons|avez|ont|suis|es|est|sommes|êtes|sont) \p{L}+(?:é|ée|és|ées|i|ie|is|ies|u|ue|us|ues)(?:$|[^\p{L}])"


def leaked_glossary(text: Column) -> Column:
    """Do two of the signs of a copied glossary stand in the text?"""
    hits = F.lit(0)
    for p in LEAKS:
        hits = hits + text.rlike(p).cast("int")
    return hits >= 2


def last_tail(text: Column) -> Column:
    """Words after the last image marker; 0 without one."""
    return F.when(text.rlike(_IMAGE), T.word_count(F.element_at(F.split(text, _IMAGE), -1))).otherwise(0)


def unwrapped(text: Column) -> Column:
    """Line breaks between wide letters go, others become one blank."""
    joined = F.regexp_replace(text, f"(?<={_WIDE})[ \\t]*\\n[ \\t]*(?={_WIDE})", "")
    return F.regexp_replace(joined, r"[ \t]*\n[ \t]*", " ")


def match_form(line: Column) -> Column:
    """A line for comparison: without heading signs, emphasis and escapes, plain quotes and dashes, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(line, r"^#{1,6}\s+", ""), r"[*_`\\]", "")
    return F.lower(F.trim(F.regexp_replace(F.translate(bare, "’‘“”«»–—", "''\"\"\"\"--"), r"[ \t]+", " ")))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL")


def q_leaked_glossaries(s, d):
    return _docs(s, d).groupBy("genre").agg(F.count("*").alias("n"), F.count_if(leaked_glossary(F.col("text"))).alias("glossaires"), F.count_if(F.col("text").rlike(_STYLE)).alias("guides"))


def q_runaway_paragraphs(s, d):
    """Paragraphs of 60 signs and more that stand three times in one document."""
    p = _docs(s, d).select("doc_id", F.explode(F.split("text", r"\n\s*\n")).alias("p")).select("doc_id", F.trim("p").alias("p")).where("length(p) >= 60")
    return p.groupBy("doc_id", F.md5("p").alias("empreinte")).agg(F.count("*").alias("fois")).where("fois >= 3")


def q_residual_wide(s, d):
    """Wide letters left in renderings into other languages, without comments and forms the glossary leaves as they are."""
    e = repaired(table(s, d, "personnages").where("oeuvre IS NOT NULL").select("oeuvre", "nom", "variantes", "termes_source", "pluriel")).where("a_romaniser")
    forms = e.select("oeuvre", F.explode(F.concat(F.array("nom"), "variantes")).alias("f")).where(F.col("f").rlike(_WIDE)).distinct().groupBy("oeuvre").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.negative(F.length("f")).alias("n"), "f"))), lambda x: x["f"]).alias("formes"))
    b = table(s, d, "bulles").where("traduction IS NOT NULL AND langue_cible <> 'ja' AND oeuvre IS NOT NULL").select("bulle_id", "oeuvre", F.regexp_replace("traduction", _COMMENT, "").alias("t"))
    rows = b.where(F.col("t").rlike(_WIDE)).join(forms, "oeuvre", "left")
    left = F.aggregate(F.coalesce("formes", F.array().cast("array<string>")), F.col("t"), lambda t, f: F.replace(t, f, F.lit("")))
    return rows.select("bulle_id", F.regexp_count(left, F.lit(_WIDE)).alias("restes")).where("restes >= 1")


def q_extract_losses(s, d):
    """Every later extraction of a file against the one before: text lost after the last image, headings, words."""
    e = table(s, d, "extraits").where("text IS NOT NULL AND fichier IS NOT NULL").select("extrait_id", "oeuvre", "fichier", T.word_count("text").alias("mots"), last_tail(F.col("text")).alias("queue"), F.regexp_count("text", F.lit(_TITLE)).alias("titres"))
    w = Window.partitionBy("oeuvre", "fichier").orderBy("extrait_id")
    rows = e.select("*", *(F.lag(c).over(w).alias(f"a_{c}") for c in ("mots", "queue", "titres"))).where("a_mots IS NOT NULL")
    cut = (F.col("a_queue") >= 12) & (F.col("queue") * 2 < F.col("a_queue")) & (F.col("mots") < F.col("a_mots") * 0.85)
    return rows.select("extrait_id", cut.alias("image_tronquee"), (F.col("titres") < F.col("a_titres")).alias("titre_perdu"), (F.col("mots") < F.col("a_mots") * 0.85).alias("mots_perdus"))


def q_flag_comments(s, d):
    """Comments of a document by the word they open with."""
    rows = table(s, d, "extraits").where("text IS NOT NULL").select("extrait_id", F.explode(F.regexp_extract_all("text", F.lit(r"<!-- ?([A-Z]+)\b"), F.lit(1))).alias("drapeau"))
    return rows.groupBy("drapeau").agg(F.count("*").alias("n"), F.countDistinct("extrait_id").alias("extraits"))


def q_match_forms(s, d):
    rows = T.lines(_docs(s, d), "doc_id", "text").select("doc_id", match_form(F.col("ligne")).alias("forme")).where("length(forme) >= 20")
    return rows.groupBy(F.md5("forme").alias("empreinte")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")).where("documents >= 2")


def q_unwrapped_lines(s, d):
    b = table(s, d, "bulles").where("instr(ocr, '\\n') > 0")
    return b.select("bulle_id", unwrapped(F.col("ocr")).alias("texte"))


def q_cells(s, d):
    """Cells a text fills: wide signs count two, others one, blanks none."""
    t = F.regexp_replace("ocr", r"\s+", "")
    return table(s, d, "bulles").where("ocr IS NOT NULL").select("bulle_id", (F.length(t) + F.regexp_count(t, F.lit(_WIDE))).alias("cases_"))


def q_reply_caps(s, d):
    """Per page: tokens of its numbered lines, the cap of the answer and the room left in a context of 8,192."""
    rows = table(s, d, "bulles").where("ocr IS NOT NULL AND oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL").groupBy("oeuvre", "tome", "planche").agg(F.count("*").alias("n"), F.sum(T.token_estimate("ocr")).alias("jetons"))
    cap = F.greatest(F.lit(256), F.least(F.lit(4096), (F.col("jetons") * 2 + F.col("n") * 8).cast("bigint")))
    return rows.withColumn("plafond", cap).withColumn("place", F.floor(F.lit(8192) * F.lit(0.9)) - F.col("jetons") - F.col("plafond"))


def q_compound_past(s, d):
    """Compound tenses per French document, in narration only (no dashes, no quotes at the line's head)."""
    rows = T.lines(_docs(s, d).where("lower(lang) LIKE 'fr%'"), "doc_id", "text").where(~F.col("ligne").rlike(r"^\s*[—–«“\"-]"))
    return rows.groupBy("doc_id").agg(F.sum(F.regexp_count(F.lower("ligne"), F.lit(_AUXILIARY))).alias("n"))


def q_break_units(s, d):
    """Units a line may not break: words, parted after their inner hyphens."""
    units = F.filter(F.split(F.regexp_replace("traduction", r"(\p{L})-(\p{L})", "$1- $2"), r"\s+"), lambda x: x != "")
    return table(s, d, "bulles").where("trim(traduction) <> ''").select("bulle_id", F.size(units).alias("unites"), F.array_max(F.transform(units, lambda x: F.length(x))).alias("plus"))


def q_without_quotes(s, d):
    """Renderings that are one quoted stretch, without the quotes."""
    pattern = r"^\s*(?:«\s*([^«»]*?)\s*»|“([^“”]*)”)\s*$"
    inner = F.concat(F.regexp_extract("traduction", pattern, 1), F.regexp_extract("traduction", pattern, 2))
    return table(s, d, "bulles").where(F.col("traduction").rlike(pattern)).select("bulle_id", inner.alias("texte"))


def q_notes_removed(s, d):
    """Documents with notes in brackets that tell of a correction, and their sizes without them."""
    pattern = r"(?i)\s*[(\[](?:correction|note|ndt|n\.d\.t\.)\s*:[^)\]]*[)\]]"
    return _docs(s, d).where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_count("text", F.lit(pattern)).alias("notes"), F.length(F.regexp_replace("text", pattern, "")).alias("signes"))


def purged(text: Column, words: list[str]) -> tuple[Column, Column]:
    """(text without the words, in any case and as whole words; the words found, each once, in lower case)."""
    p = r"(?i)\b(" + "|".join(words) + r")\b"
    return F.trim(F.regexp_replace(F.regexp_replace(text, p, ""), r" {2,}", " ")), F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1))))


def q_purged_descriptions(s, d, words: tuple = ("frère", "soeur", "ami", "brother", "friend", "captain")):
    text, found = purged(F.col("description"), list(words))
    return table(s, d, "personnages").where("description IS NOT NULL").select("entree_id", F.md5(text).alias("empreinte"), F.array_join(found, "/").alias("retires")).where("retires <> ''")


def q_label_progress(s, d):
    """Progress read from labels: the furthest page and block of every log, and its total."""
    rows = T.lines(_docs(s, d).where("genre = 'journal'"), "doc_id", "text").select("doc_id", *(F.regexp_extract("ligne", r"\b(page|bloc) (\d+)/(\d+)", k).alias(n) for k, n in ((1, "sorte"), (2, "i"), (3, "n")))).where("sorte <> ''")
    return rows.groupBy("doc_id", "sorte").agg(F.max(F.col("i").cast("int")).alias("atteint"), F.max(F.col("n").cast("int")).alias("total"))


def q_page_lists(s, d):
    """Every page's bubbles as one numbered list (digest), a rule where the kind changes."""
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND idx IS NOT NULL AND ocr IS NOT NULL")
    w = Window.partitionBy("oeuvre", "tome", "planche").orderBy("idx", "bulle_id")
    line = F.concat(F.when(F.lag(F.coalesce("kind", F.lit("?"))).over(w) != F.coalesce("kind", F.lit("?")), "---\n").otherwise(""), F.row_number().over(w).cast("string"), F.lit(". "), F.replace("ocr", F.lit("\n"), F.lit(" ")))
    rows = b.select("oeuvre", "tome", "planche", F.row_number().over(w).alias("r"), line.alias("l"))
    return rows.groupBy("oeuvre", "tome", "planche").agg(F.count("*").alias("lignes"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "l"))), lambda x: x["l"]), "\n")).alias("empreinte"))


def q_titled_sections(s, d):
    """Sections of documents under their headings: lines and signs of each (the part before the first is number 0)."""
    rows = T.lines(_docs(s, d), "doc_id", "text").withColumn("t", F.col("ligne").rlike(r"^#{1,6} \S").cast("int"))
    rows = rows.withColumn("section", F.sum("t").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "section").agg(F.min_by("ligne", "pos").alias("tete"), F.count("*").alias("lignes"), F.sum(F.length("ligne")).alias("signes")).where("section > 0")


def q_property_paths(s, d):
    """Paths of the JSON properties of events, with how often each stands."""
    rows = table(s, d, "events").select(F.explode(F.json_object_keys("props")).alias("chemin"))
    return rows.groupBy("chemin").agg(F.count("*").alias("n"))


def q_sure_share(s, d):
    """Share of sure readings (score 0.8 and more) per kind of bubble; 0 where none is measured."""
    return table(s, d, "bulles").groupBy("kind").agg(F.round(F.coalesce(F.avg(F.when(F.col("score").isNotNull(), (F.col("score") >= 0.8).cast("double"))), F.lit(0.0)), 6).alias("part"))


def q_fenced_lines(s, d):
    """Fenced lines of documents put right: fences alone on their line, counted per document."""
    rows = T.lines(_docs(s, d), "doc_id", "text").where(F.col("ligne").rlike(r"^\s*:{3,}|:{3,}\s*$"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("clotures"), F.count_if(F.col("ligne").rlike(r"^\s*:{3,}\s*$")).alias("nues"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_L = "l AS (SELECT doc_id, genre, lang, unnest(string_split(text, chr(10))) AS ligne, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"
_words, _tokens = words_sql, tokens_sql
_tail = lambda x: f"CASE WHEN regexp_matches({x}, '{_IMAGE}') THEN {_words(f'regexp_split_to_array({x}, {chr(39)}{_IMAGE}{chr(39)})[-1]')} ELSE 0 END"
_REST = f"WITH {_REP}, f AS (SELECT oeuvre, list(f ORDER BY length(f) DESC, f) AS formes FROM (SELECT DISTINCT oeuvre, f FROM (SELECT oeuvre, unnest(list_concat([nom], variantes)) AS f FROM rr WHERE a_romaniser AND oeuvre IS NOT NULL) WHERE regexp_matches(f, '{_WIDE}')) GROUP BY 1)"
_QUOTES = "'" + "''" * 2 + '""""--' + "'"
_HEAD = r'^\s*[—–«“"-]'
_NOTE = r"(?i)\s*[(\[](?:correction|note|ndt|n\.d\.t\.)\s*:[^)\]]*[)\]]"
_QUOTED = r"^\s*(?:«\s*([^«»]*?)\s*»|“([^“”]*)”)\s*$"
_BAD = r"(?i)\b(frère|soeur|ami|brother|friend|captain)\b"
SQL = {
    "leaked_glossaries": "SELECT genre, count(*) AS n, count(*) FILTER (" + " + ".join(f"regexp_matches(text, '{p}')::INT" for p in LEAKS) + f" >= 2) AS glossaires, count(*) FILTER (regexp_matches(text, '{_STYLE}')) AS guides FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "runaway_paragraphs": r"WITH p AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\n\s*\n')), ' ') AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(p) AS empreinte, count(*) AS fois FROM p WHERE length(p) >= 60 GROUP BY 1, 2 HAVING count(*) >= 3",
    "residual_wide": _REST + f", b AS (SELECT bulle_id, oeuvre, regexp_replace(traduction, '{_COMMENT}', '', 'g') AS t FROM bulles WHERE traduction IS NOT NULL AND langue_cible <> 'ja' AND oeuvre IS NOT NULL), x AS (SELECT bulle_id, list_reduce(list_concat([t], coalesce(formes, [])), lambda a, f: replace(a, f, '')) AS u FROM b LEFT JOIN f USING (oeuvre) WHERE regexp_matches(t, '{_WIDE}')) SELECT bulle_id, len(regexp_extract_all(u, '{_WIDE}')) AS restes FROM x WHERE len(regexp_extract_all(u, '{_WIDE}')) >= 1",
    "extract_losses": f"WITH e AS (SELECT extrait_id, oeuvre, fichier, {_words('text')} AS mots, {_tail('text')} AS queue, len(regexp_extract_all(text, '{_TITLE}')) AS titres FROM extraits WHERE text IS NOT NULL AND fichier IS NOT NULL), p AS (SELECT *, lag(mots) OVER w AS am, lag(queue) OVER w AS aq, lag(titres) OVER w AS ati FROM e WINDOW w AS (PARTITION BY oeuvre, fichier ORDER BY extrait_id)) SELECT extrait_id, aq >= 12 AND queue * 2 < aq AND mots < am * 0.85::DOUBLE AS image_tronquee, titres < ati AS titre_perdu, mots < am * 0.85::DOUBLE AS mots_perdus FROM p WHERE am IS NOT NULL",
    "flag_comments": r"WITH f AS (SELECT extrait_id, unnest(regexp_extract_all(text, '<!-- ?([A-Z]+)\b', 1)) AS drapeau FROM extraits WHERE text IS NOT NULL) SELECT drapeau, count(*) AS n, count(DISTINCT extrait_id) AS extraits FROM f GROUP BY 1",
    "match_forms": f"WITH {_L}" + r", m AS (SELECT doc_id, lower(trim(regexp_replace(translate(regexp_replace(regexp_replace(ligne, '^#{1,6}\s+', ''), '[*_`\\]', '', 'g'), '’‘“”«»–—', " + _QUOTES + r"), '[ \t]+', ' ', 'g'), ' ')) AS forme FROM l) SELECT md5(forme) AS empreinte, count(*) AS n, count(DISTINCT doc_id) AS documents FROM m WHERE length(forme) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2",
    "unwrapped_lines": rf"WITH j AS (SELECT bulle_id, regexp_replace(regexp_replace(ocr, '({_WIDE})[ \t]*\n[ \t]*({_WIDE})', '\1\2', 'g'), '({_WIDE})[ \t]*\n[ \t]*({_WIDE})', '\1\2', 'g') AS t FROM bulles WHERE instr(ocr, chr(10)) > 0) SELECT bulle_id, regexp_replace(t, '[ \t]*\n[ \t]*', ' ', 'g') AS texte FROM j",
    "cells": rf"SELECT bulle_id, length(regexp_replace(ocr, '\s+', '', 'g')) + len(regexp_extract_all(ocr, '{_WIDE}')) AS cases_ FROM bulles WHERE ocr IS NOT NULL",
    "reply_caps": f"WITH p AS (SELECT oeuvre, tome, planche, count(*) AS n, sum({_tokens('ocr')}) AS jetons FROM bulles WHERE ocr IS NOT NULL AND oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL GROUP BY 1, 2, 3) SELECT *, greatest(256, least(4096, jetons * 2 + n * 8)) AS plafond, floor(8192 * 0.9::DOUBLE)::BIGINT - jetons - greatest(256, least(4096, jetons * 2 + n * 8)) AS place FROM p",
    "compound_past": f"WITH {_L} SELECT doc_id, sum(len(regexp_extract_all(lower(ligne), '{_AUXILIARY}'))) AS n FROM l WHERE lower(lang) LIKE 'fr%' AND NOT regexp_matches(ligne, '{_HEAD}') GROUP BY 1",
    "break_units": r"WITH u AS (SELECT bulle_id, list_filter(regexp_split_to_array(regexp_replace(traduction, '(\p{L})-(\p{L})', '\1- \2', 'g'), '\s+'), lambda x: x <> '') AS u FROM bulles WHERE trim(traduction, ' ') <> '') SELECT bulle_id, len(u) AS unites, list_max(list_transform(u, lambda x: length(x))) AS plus FROM u",
    "without_quotes": f"SELECT bulle_id, regexp_extract(traduction, '{_QUOTED}', 1) || regexp_extract(traduction, '{_QUOTED}', 2) AS texte FROM bulles WHERE regexp_matches(traduction, '{_QUOTED}')",
    "notes_removed": f"SELECT doc_id, len(regexp_extract_all(text, '{_NOTE}')) AS notes, length(regexp_replace(text, '{_NOTE}', '', 'g')) AS signes FROM documents WHERE regexp_matches(text, '{_NOTE}')",
    "purged_descriptions": f"WITH p AS (SELECT entree_id, md5(trim(regexp_replace(regexp_replace(description, '{_BAD}', '', 'g'), ' {{2,}}', ' ', 'g'), ' ')) AS empreinte, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(description), '{_BAD}', 1))), '/') AS retires FROM personnages WHERE description IS NOT NULL) SELECT * FROM p WHERE retires <> ''",
    "label_progress": f"WITH {_L}" + r", p AS (SELECT doc_id, regexp_extract(ligne, '\b(page|bloc) (\d+)/(\d+)', 1) AS sorte, regexp_extract(ligne, '\b(page|bloc) (\d+)/(\d+)', 2) AS i, regexp_extract(ligne, '\b(page|bloc) (\d+)/(\d+)', 3) AS n FROM l WHERE genre = 'journal') SELECT doc_id, sorte, max(i::INT) AS atteint, max(n::INT) AS total FROM p WHERE sorte <> '' GROUP BY 1, 2",
    "page_lists": "WITH b AS (SELECT oeuvre, tome, planche, row_number() OVER w AS r, CASE WHEN lag(coalesce(kind, '?')) OVER w <> coalesce(kind, '?') THEN '---' || chr(10) ELSE '' END || row_number() OVER w || '. ' || replace(ocr, chr(10), ' ') AS l FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND idx IS NOT NULL AND ocr IS NOT NULL WINDOW w AS (PARTITION BY oeuvre, tome, planche ORDER BY idx, bulle_id)) SELECT oeuvre, tome, planche, count(*) AS lignes, md5(string_agg(l, chr(10) ORDER BY r)) AS empreinte FROM b GROUP BY 1, 2, 3",
    "titled_sections": f"WITH {_L}" + r", s AS (SELECT *, sum(regexp_matches(ligne, '^#{1,6} \S')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, section, arg_min(ligne, pos) AS tete, count(*) AS lignes, sum(length(ligne)) AS signes FROM s WHERE section > 0 GROUP BY 1, 2",
    "property_paths": "SELECT chemin, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS chemin FROM events) GROUP BY 1",
    "sure_share": "SELECT kind, round(coalesce(avg(CASE WHEN score IS NOT NULL THEN (score >= 0.8::DOUBLE)::INT END), 0.0), 6) AS part FROM bulles GROUP BY 1",
    "fenced_lines": f"WITH {_L}" + r" SELECT doc_id, count(*) AS clotures, count(*) FILTER (regexp_matches(ligne, '^\s*:{3,}\s*$')) AS nues FROM l WHERE regexp_matches(ligne, '^\s*:{3,}|:{3,}\s*$') GROUP BY 1",
}
