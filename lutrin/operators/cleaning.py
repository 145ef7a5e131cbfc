"""Cleaning and comparing text: markers, headings, dialogue, widths, dots, labels, budgets, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.operators.profiling import tokens_sql, words_sql
from lutrin.session import table

MARKER = r"<!-- IMG: ([^|>]*?)(?:\|([^>]*?))? -->"
_FULL = "".join(map(chr, (0xFF01, 0xFF1F, 0xFF08, 0xFF09, 0xFF0C, 0xFF1A, 0x3001, 0x3002)))
_HALF = "!?(),:,."


def strip_markers(text) -> Column:
    """Without lines that hold an image marker alone, and without markers inside lines."""
    return F.regexp_replace(F.regexp_replace(T.c(text), r"(?m)^[ \t]*<!--[^>]*-->[ \t]*\n?", ""), "<!--[^>]*-->", "")


def plain_text(text) -> Column:
    """Readable text alone: no markers, code fences, heading signs or emphasis."""
    out = F.regexp_replace(strip_markers(text), r"(?m)^```[^\n]*\n?", "")
    out = F.regexp_replace(out, r"(?m)^#{1,6} ", "")
    return F.regexp_replace(out, r"\*{1,3}([^*\n]+)\*{1,3}", "$1")


def latin_signs(text) -> Column:
    """Full-width signs and digits in their narrow form."""
    digits = "".join(chr(0xFF10 + i) for i in range(10))
    return F.translate(T.c(text), _FULL + digits, _HALF + "0123456789")


def restore_dots(text) -> Column:
    """Runs of full-width stops and dots as ellipses."""
    return F.regexp_replace(F.regexp_replace(T.c(text), chr(0xFF0E), "."), r"\.{3,}", "…")


def duration_label(seconds) -> Column:
    """Seconds as ``1h02``, ``3min05`` or ``7s``; null as ``?``."""
    s = F.floor(T.c(seconds)).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s.isNull(), "?").when(s >= 3600, F.concat(h.cast("string"), F.lit("h"), F.lpad(m.cast("string"), 2, "0"))).when(s >= 60, F.concat(m.cast("string"), F.lit("min"), F.lpad((s % 60).cast("string"), 2, "0"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def shorten(text, most: int = 320) -> Column:
    """At most ``most`` characters, cut at the last blank, with a mark where cut."""
    t = T.c(text)
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.left(t, F.lit(most)), r"\s\S*\z", ""), F.lit(" […]"))).otherwise(t)


def anonymise(text, pairs: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements, longest first, tolerant to a line end in place of a blank."""
    out = T.c(text)
    for a, b in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        out = F.regexp_replace(out, r"(?:\s)".join("\\Q" + w + "\\E" for w in a.split(" ")), b)
    return out


def token_prefix(df: DataFrame, by: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each group's rows whose tokens fit a budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumul", F.sum(tokens).over(w)).where(F.col("cumul") <= budget)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL")


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "extraits").where("text IS NOT NULL")


def q_image_markers(s, d):
    """Image markers of extracts with their attributes and their place as a share of the text."""
    rows = _files(s, d).select("extrait_id", F.posexplode(F.regexp_extract_all("text", F.lit("(<!-- IMG: [^>]* -->)"), F.lit(1))).alias("rang", "m"), "text")
    return rows.select("extrait_id", "rang", F.regexp_extract("m", "IMG: ([^|>]*?)(?:[|]| -->)", 1).alias("chemin"), F.regexp_extract("m", r"width=([0-9.]+)in", 1).alias("largeur"))


def q_words_after_last_image(s, d):
    """Words after the last image marker of an extract, against all its words."""
    tail = F.substring_index("text", " -->", -1)
    return _files(s, d).where("instr(text, '<!-- IMG:') > 0").select("extrait_id", T.word_count(tail).alias("apres"), T.word_count(plain_text("text")).alias("mots"))


def q_plain_text_sizes(s, d):
    return _docs(s, d).select("doc_id", F.length(plain_text("text")).alias("taille"), F.length("text").alias("brute"))


def q_dialogue_share(s, d):
    """Spoken lines of an extract: those that open with a dash or a quote."""
    rows = T.lines(_files(s, d), "extrait_id", "text").where("trim(ligne) <> ''").withColumn("dit", F.col("ligne").rlike("^[—–-] ?|^[«“「]"))
    return rows.groupBy("extrait_id").agg(F.count("*").alias("lignes"), F.sum(F.when(F.col("dit"), 1).otherwise(0)).alias("repliques"))


def q_undashed_lines(s, d):
    """Dialogue dashes taken off: how many characters a document's lines lose."""
    rows = T.lines(_docs(s, d), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.sum(F.length("ligne") - F.length(F.regexp_replace("ligne", "^[—–] ?", ""))).alias("otes")).where("otes > 0")


def q_latin_signs(s, d):
    rows = table(s, d, "bulles").where("ocr IS NOT NULL").select("bulle_id", "ocr", latin_signs("ocr").alias("latin"))
    return rows.where("latin <> ocr").select("bulle_id", "latin")


def q_restored_dots(s, d):
    return table(s, d, "bulles").where("traduction LIKE '%...%' OR ocr LIKE '%...%'").select("bulle_id", restore_dots("ocr").alias("ocr"), restore_dots("traduction").alias("traduction"))


def q_duration_labels(s, d):
    return table(s, d, "events").select("event_id", duration_label(F.col("value") * 37).alias("duree"))


def q_shortened_descriptions(s, d):
    return _docs(s, d).where("length(text) > 320").select("doc_id", shorten("text").alias("extrait"))


def q_anonymised_counts(s, d):
    """Replacing two phrases by labels: characters before and after, per document that holds one."""
    out = anonymise("text", [("la vieille lanterne", "<OBJET>"), ("le vieux capitaine", "<PERSONNE>")])
    return _docs(s, d).select("doc_id", F.length("text").alias("avant"), F.length(out).alias("apres")).where("avant <> apres")


def q_doubled_labels(s, d):
    """Words that stand twice in a row in a document, the symptom of cascading replacements."""
    rows = _docs(s, d).select("doc_id", F.split(F.lower("text"), r"[^\p{L}]+").alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, 1_000_000_000), lambda a, b: F.coalesce((a == b) & (F.length(a) >= 4), F.lit(False)))
    return rows.select("doc_id", F.size(F.filter(pairs, lambda x: x)).alias("n")).where("n > 0")


def q_token_budget(s, d):
    """The first passages of each side of a unit that fit 120 tokens."""
    p = table(s, d, "passages").where("unite IS NOT NULL AND langue IS NOT NULL AND texte IS NOT NULL AND rang IS NOT NULL").withColumn("t", T.token_estimate("texte"))
    return token_prefix(p, ["unite", "langue"], ["rang", "passage_id"], "t", 120).groupBy("unite", "langue").agg(F.count("*").alias("n"), F.sum("t").alias("jetons"))


def q_character_limit(s, d):
    """Characters a block may have so that it stays under 2,200 tokens at the document's density, 6,000 at most."""
    density = T.token_estimate("text") / F.length("text")
    return _docs(s, d).where("length(text) > 0").select("doc_id", F.when(T.token_estimate("text") == 0, 6000).otherwise(F.least(F.lit(6000), F.floor(2200 / density).cast("int"))).alias("limite"))


def q_page_fingerprints(s, d):
    """Content fingerprint of every page: its bubbles in order, whatever their dates."""
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL")
    each = b.select("oeuvre", "tome", "planche", F.struct("idx", "bulle_id", F.md5(F.concat_ws("|", F.coalesce("ocr", F.lit("")), F.coalesce("traduction", F.lit("")))).alias("h")).alias("x"))
    return each.groupBy("oeuvre", "tome", "planche").agg(F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("x")), lambda y: y["h"])), 256).alias("empreinte"), F.count("*").alias("bulles"))


def q_proposed_plurals(s, d):
    """Entries without a plural whose name with an s stands in their work's renderings."""
    p = table(s, d, "personnages").where("oeuvre IS NOT NULL AND nom rlike '^[A-Za-z]{4,}$' AND coalesce(pluriel, '') = ''").select("entree_id", "oeuvre", F.concat("nom", F.lit("s")).alias("mot"))
    w = table(s, d, "bulles").where("oeuvre IS NOT NULL AND traduction IS NOT NULL").select("oeuvre", F.explode(F.regexp_extract_all("traduction", F.lit("([A-Za-z]+)"), F.lit(1))).alias("mot")).groupBy("oeuvre", "mot").agg(F.count("*").alias("n"))
    return p.join(w, ["oeuvre", "mot"], "left").groupBy(F.when(F.col("n").isNull(), "non vu").otherwise("vu").alias("etat")).agg(F.count("*").alias("entrees"))


def q_term_renderings(s, d):
    """Capitalised words that occur with a katakana word of the source, by how often (twice or more)."""
    b = table(s, d, "bulles").where("langue_source = 'ja' AND ocr IS NOT NULL AND traduction IS NOT NULL AND oeuvre IS NOT NULL")
    k = F.array_distinct(F.regexp_extract_all("ocr", F.lit("([ァ-ヺー]{3,})"), F.lit(1)))
    c = F.array_distinct(F.regexp_extract_all("traduction", F.lit(r"[\p{Ll},] (\p{Lu}\p{L}{2,})"), F.lit(1)))
    rows = b.select("oeuvre", F.explode(k).alias("terme"), c.alias("c")).select("oeuvre", "terme", F.explode("c").alias("rendu"))
    return rows.groupBy("oeuvre", "terme", "rendu").agg(F.count("*").alias("n")).where("n >= 2")


def q_previous_context(s, d):
    """For every page the size of the renderings of the two pages before it."""
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL").groupBy("oeuvre", "tome", "planche").agg(F.sum(F.coalesce(F.length("traduction"), F.lit(0))).alias("t"))
    w = Window.partitionBy("oeuvre", "tome").orderBy("planche").rowsBetween(-2, -1)
    return b.select("oeuvre", "tome", "planche", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("contexte"))


def q_zone_triage(s, d):
    """What a bubble's reading holds: nothing, signs, noise, or text (by the script of its source)."""
    b = table(s, d, "bulles")
    kind = F.when(F.trim(F.coalesce("ocr", F.lit(""))) == "", "vide").when(~F.col("ocr").rlike(r"[\p{L}\p{N}]"), "signes").when((F.col("langue_source") == "ja") & ~F.col("ocr").rlike(T.NARROW), "bruit").when((F.col("langue_source") != "ja") & F.col("ocr").rlike(T.NARROW), "bruit").otherwise("texte")
    return b.groupBy(F.coalesce("langue_source", F.lit("?")).alias("langue"), kind.alias("tri")).agg(F.count("*").alias("n"))


def q_page_regime(s, d):
    """Volumes by the shape of their pages: strip pages (three times as high as wide), pages, or both."""
    p = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").groupBy("oeuvre", "tome", "planche").agg((F.max("y1") >= 3 * F.max("x1")).alias("bande"))
    return p.groupBy("oeuvre", "tome").agg(F.when(F.min("bande"), "bandes").when(~F.max("bande"), "pages").otherwise("mixte").alias("regime"), F.count("*").alias("planches"))


def q_inferred_script(s, d):
    """Script of each document from its letters, against the language it states."""
    cjk = F.regexp_count("text", F.lit(T.NARROW))
    latin = F.regexp_count("text", F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ]"))
    kind = F.when(cjk * 10 > latin, "cjk").when(latin > 0, "latin").otherwise("?")
    return _docs(s, d).groupBy(F.lower(F.substring(F.coalesce("lang", F.lit("?")), 1, 2)).alias("langue"), kind.alias("ecriture")).agg(F.count("*").alias("n"))


def q_literal_leaks(s, d):
    """Documents that hold a literal they must not: a hash, a path, a prompt's first words."""
    low = F.lower("text")
    why = F.concat_ws("+", F.when(F.col("text").rlike("[0-9a-f]{32}"), "empreinte"), F.when(F.instr(low, "traduis les lignes") > 0, "consigne"), F.when(F.instr(low, "media/") > 0, "chemin"))
    return _docs(s, d).groupBy(why.alias("fuites")).agg(F.count("*").alias("documents"))


def q_embroidered_sounds(s, d):
    """Sound effects rendered at three times their size or more, above a floor of eight tokens."""
    b = table(s, d, "bulles").where("ocr IS NOT NULL AND traduction IS NOT NULL AND length(ocr) <= 8")
    ts, tt = T.token_estimate("ocr"), T.token_estimate("traduction")
    return b.where((tt >= 8) & (tt > 3.0 * ts)).select("bulle_id", ts.alias("source"), tt.alias("rendu"))


def q_first_correction(s, d):
    """Deliveries of one place: the first rendering and the first that differs from it."""
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND idx IS NOT NULL AND traduction IS NOT NULL")
    at = ["oeuvre", "tome", "planche", "idx"]
    w = Window.partitionBy(*at).orderBy("bulle_id")
    b = b.withColumn("base", F.first("traduction").over(w))
    return b.where("traduction <> base").groupBy("oeuvre", "tome", "planche", "idx").agg(F.min("bulle_id").alias("bulle_id"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \t]*<!--[^>]*-->[ \t]*\n?', '', 'g'), '<!--[^>]*-->', '', 'g'), '(?m)^```[^\n]*\n?', '', 'g'), '(?m)^#{1,6} ', '', 'g'), '\*{1,3}([^*\n]+)\*{1,3}', '\1', 'g')"
_L = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ligne FROM documents WHERE text IS NOT NULL)"
_DIGITS = "".join(chr(0xFF10 + i) for i in range(10))
SQL = {
    "image_markers": "WITH m AS (SELECT extrait_id, unnest(regexp_extract_all(text, '(<!-- IMG: [^>]* -->)', 1)) AS m, generate_subscripts(regexp_extract_all(text, '(<!-- IMG: [^>]* -->)', 1), 1) - 1 AS rang FROM extraits WHERE text IS NOT NULL) SELECT extrait_id, rang, regexp_extract(m, 'IMG: ([^|>]*?)(?:[|]| -->)', 1) AS chemin, regexp_extract(m, 'width=([0-9.]+)in', 1) AS largeur FROM m",
    "words_after_last_image": f"WITH t AS (SELECT extrait_id, string_split(text, ' -->')[-1] AS fin, {_PLAIN} AS tout FROM extraits WHERE text IS NOT NULL AND instr(text, '<!-- IMG:') > 0) SELECT extrait_id, {words_sql('fin')} AS apres, {words_sql('tout')} AS mots FROM t",
    "plain_text_sizes": f"SELECT doc_id, length({_PLAIN}) AS taille, length(text) AS brute FROM documents WHERE text IS NOT NULL",
    "dialogue_share": "WITH l AS (SELECT extrait_id, unnest(string_split(text, chr(10))) AS ligne FROM extraits WHERE text IS NOT NULL) SELECT extrait_id, count(*) AS lignes, count(*) FILTER (regexp_matches(ligne, '^[—–-] ?|^[«“「]')) AS repliques FROM l WHERE trim(ligne, ' ') <> '' GROUP BY 1",
    "undashed_lines": _L + " SELECT doc_id, sum(length(ligne) - length(regexp_replace(ligne, '^[—–] ?', ''))) AS otes FROM l GROUP BY 1 HAVING sum(length(ligne) - length(regexp_replace(ligne, '^[—–] ?', ''))) > 0",
    "latin_signs": f"SELECT bulle_id, translate(ocr, '{_FULL}{_DIGITS}', '{_HALF}0123456789') AS latin FROM bulles WHERE ocr IS NOT NULL AND translate(ocr, '{_FULL}{_DIGITS}', '{_HALF}0123456789') <> ocr",
    "restored_dots": "SELECT bulle_id, regexp_replace(replace(ocr, chr(65294), '.'), '\\.{3,}', '…', 'g') AS ocr, regexp_replace(replace(traduction, chr(65294), '.'), '\\.{3,}', '…', 'g') AS traduction FROM bulles WHERE traduction LIKE '%...%' OR ocr LIKE '%...%'",
    "duration_labels": "WITH s AS (SELECT event_id, CAST(floor(value * 37) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s IS NULL THEN '?' WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') WHEN s >= 60 THEN ((s % 3600) // 60) || 'min' || lpad((s % 60)::VARCHAR, 2, '0') ELSE s || 's' END AS duree FROM s",
    "shortened_descriptions": "SELECT doc_id, regexp_replace(left(text, 320), '\\s\\S*\\z', '') || ' […]' AS extrait FROM documents WHERE length(text) > 320",
    "anonymised_counts": "WITH a AS (SELECT doc_id, length(text) AS avant, length(regexp_replace(regexp_replace(text, 'la\\svieille\\slanterne', '<OBJET>', 'g'), 'le\\svieux\\scapitaine', '<PERSONNE>', 'g')) AS apres FROM documents WHERE text IS NOT NULL) SELECT * FROM a WHERE avant <> apres",
    "doubled_labels": "WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w), p AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM u) SELECT doc_id, count(*) AS n FROM p WHERE a = b AND length(a) >= 4 GROUP BY 1",
    "token_budget": f"WITH t AS (SELECT unite, langue, rang, passage_id, {tokens_sql('texte')} AS t FROM passages WHERE unite IS NOT NULL AND langue IS NOT NULL AND texte IS NOT NULL AND rang IS NOT NULL), c AS (SELECT *, sum(t) OVER (PARTITION BY unite, langue ORDER BY rang, passage_id ROWS UNBOUNDED PRECEDING) AS c FROM t) SELECT unite, langue, count(*) AS n, sum(t) AS jetons FROM c WHERE c <= 120 GROUP BY 1, 2",
    "character_limit": f"WITH t AS (SELECT doc_id, length(text) AS n, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL AND length(text) > 0) SELECT doc_id, CASE WHEN t = 0 THEN 6000 ELSE least(6000, CAST(floor(2200 / (t / n)) AS INT)) END AS limite FROM t",
    "page_fingerprints": "SELECT oeuvre, tome, planche, sha256(string_agg(md5(coalesce(ocr, '') || '|' || coalesce(traduction, '')), ',' ORDER BY idx NULLS FIRST, bulle_id)) AS empreinte, count(*) AS bulles FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL GROUP BY 1, 2, 3",
    "proposed_plurals": "WITH p AS (SELECT entree_id, oeuvre, nom || 's' AS mot FROM personnages WHERE oeuvre IS NOT NULL AND regexp_matches(nom, '^[A-Za-z]{4,}$') AND coalesce(pluriel, '') = ''), w AS (SELECT DISTINCT oeuvre, unnest(regexp_extract_all(traduction, '([A-Za-z]+)', 1)) AS mot FROM bulles WHERE oeuvre IS NOT NULL AND traduction IS NOT NULL) SELECT CASE WHEN w.mot IS NULL THEN 'non vu' ELSE 'vu' END AS etat, count(*) AS entrees FROM p LEFT JOIN w ON p.oeuvre = w.oeuvre AND p.mot = w.mot GROUP BY 1",
    "term_renderings": r"WITH b AS (SELECT oeuvre, list_distinct(regexp_extract_all(ocr, '([ァ-ヺー]{3,})', 1)) AS k, list_distinct(regexp_extract_all(traduction, '[\p{Ll},] (\p{Lu}\p{L}{2,})', 1)) AS c FROM bulles WHERE langue_source = 'ja' AND ocr IS NOT NULL AND traduction IS NOT NULL AND oeuvre IS NOT NULL), k AS (SELECT oeuvre, unnest(k) AS terme, c FROM b), r AS (SELECT oeuvre, terme, unnest(c) AS rendu FROM k) SELECT oeuvre, terme, rendu, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "previous_context": "WITH p AS (SELECT oeuvre, tome, planche, sum(coalesce(length(traduction), 0)) AS t FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL GROUP BY 1, 2, 3) SELECT oeuvre, tome, planche, coalesce(sum(t) OVER (PARTITION BY oeuvre, tome ORDER BY planche ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS contexte FROM p",
    "zone_triage": rf"SELECT coalesce(langue_source, '?') AS langue, CASE WHEN trim(coalesce(ocr, ''), ' ') = '' THEN 'vide' WHEN NOT regexp_matches(ocr, '[\p{{L}}\p{{N}}]') THEN 'signes' WHEN langue_source = 'ja' AND NOT regexp_matches(ocr, '{T.NARROW}') THEN 'bruit' WHEN langue_source <> 'ja' AND regexp_matches(ocr, '{T.NARROW}') THEN 'bruit' ELSE 'texte' END AS tri, count(*) AS n FROM bulles GROUP BY 1, 2",
    "page_regime": "WITH p AS (SELECT oeuvre, tome, planche, max(y1) >= 3 * max(x1) AS bande FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL GROUP BY 1, 2, 3) SELECT oeuvre, tome, CASE WHEN bool_and(bande) THEN 'bandes' WHEN NOT bool_or(bande) THEN 'pages' ELSE 'mixte' END AS regime, count(*) AS planches FROM p GROUP BY 1, 2",
    "inferred_script": f"WITH n AS (SELECT lower(substring(coalesce(lang, '?'), 1, 2)) AS langue, len(regexp_extract_all(text, '{T.NARROW}')) AS c, len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) AS l FROM documents WHERE text IS NOT NULL) SELECT langue, CASE WHEN c * 10 > l THEN 'cjk' WHEN l > 0 THEN 'latin' ELSE '?' END AS ecriture, count(*) AS n FROM n GROUP BY 1, 2",
    "literal_leaks": "SELECT concat_ws('+', CASE WHEN regexp_matches(text, '[0-9a-f]{32}') THEN 'empreinte' END, CASE WHEN instr(lower(text), 'traduis les lignes') > 0 THEN 'consigne' END, CASE WHEN instr(lower(text), 'media/') > 0 THEN 'chemin' END) AS fuites, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "embroidered_sounds": f"WITH t AS (SELECT bulle_id, {tokens_sql('ocr')} AS source, {tokens_sql('traduction')} AS rendu FROM bulles WHERE ocr IS NOT NULL AND traduction IS NOT NULL AND length(ocr) <= 8) SELECT * FROM t WHERE rendu >= 8 AND rendu > 3.0 * source",
    "first_correction": "WITH b AS (SELECT *, first_value(traduction) OVER (PARTITION BY oeuvre, tome, planche, idx ORDER BY bulle_id) AS base FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND idx IS NOT NULL AND traduction IS NOT NULL) SELECT oeuvre, tome, planche, idx, min(bulle_id) AS bulle_id FROM b WHERE traduction <> base GROUP BY 1, 2, 3, 4",
}
