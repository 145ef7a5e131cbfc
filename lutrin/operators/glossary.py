"""Glossary work: repair, audit, routing of fields, lines of text, drifts of names, consistency of attributes.

Every operator is a Catalyst expression over the entries (``personnages``) or over the lines of glossary documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.operators.profiling import key_sql
from lutrin.session import spread, table

_WIDE, _LATIN = "[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Words that betray a sentence in a list of variants; words of a gender.
_SENTENCE_WORDS = r"(?i)\b(qui|dont|lors|ici|elle|il|leur|ses|son|sa)\b"
_MASCULINE, _FEMININE = ("m", "masculin", "homme", "garcon", "garçon", "male", "mâle"), ("f", "feminin", "féminin", "femme", "fille", "female", "femelle")
#: Words of a heading and the category it opens, the first that applies.
_CATEGORIES = ((("personnage", "character"), "personnages"), (("lieu", "place", "location"), "lieux"), (("organisation", "organization", "faction"), "organisations"), (("creature", "monstre"), "creatures"), (("objet", "object", "item"), "objets"), (("terme", "term", "glossa"), "termes"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _list(c: str) -> Column:
    """A list column without nulls and blank values; null is the empty list."""
    return F.filter(F.coalesce(c, _none()), lambda x: F.trim(x) != "")


def repaired(entries: DataFrame) -> DataFrame:
    """Source spellings out of names, variants and plurals, into the list of source terms; idempotent.

    A name in source writing gives way to the first Latin variant; without one it stays and is marked
    ``a_romaniser``.  Columns ``nom, variantes, termes_source, pluriel`` are replaced, the others stay.
    """
    wide = lambda x: x.rlike(_WIDE)
    rows = entries.withColumn("_v", _list("variantes")).withColumn("_n", F.trim(F.coalesce("nom", F.lit("")))).withColumn("_p", F.trim(F.coalesce("pluriel", F.lit(""))))
    rows = rows.withColumn("_l", F.filter("_v", lambda x: ~wide(x))).withColumn("_first", F.try_element_at(F.filter("_l", lambda x: x.rlike(_LATIN)), F.lit(1)))
    moved = F.concat(_list("termes_source"), F.filter("_v", wide), F.when(wide(F.col("_n")), F.array("_n")).otherwise(_none()), F.when(wide(F.col("_p")), F.array("_p")).otherwise(_none()))
    promoted = wide(F.col("_n")) & F.col("_first").isNotNull()
    at = F.array_position("_l", F.col("_first")).cast("int")
    without = F.concat(F.slice("_l", F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice("_l", at + 1, F.greatest(F.size("_l") - at, F.lit(0))))
    return rows.select(
        *(c for c in entries.columns if c not in ("nom", "variantes", "termes_source", "pluriel")),
        F.when(promoted, F.col("_first")).otherwise(F.col("_n")).alias("nom"), F.when(promoted, without).otherwise(F.col("_l")).alias("variantes"),
        F.array_distinct(moved).alias("termes_source"), F.when(wide(F.col("_p")), "").otherwise(F.col("_p")).alias("pluriel"), (wide(F.col("_n")) & F.col("_first").isNull()).alias("a_romaniser"),
    )


def strict_variants(text: Column) -> tuple[Column, Column]:
    """(variants, spill): parts between commas or ``et`` up to the first that looks like a sentence, and the rest."""
    parts = F.filter(F.transform(F.split(text, r",| et "), lambda x: F.trim(x)), lambda x: x != "")
    bad = F.transform(parts, lambda x: (F.length(x) > 30) | x.contains(".") | x.rlike(_SENTENCE_WORDS))
    n = F.array_position(bad, F.lit(True)).cast("int")
    keep = F.when(n == 0, F.size(parts)).otherwise(n - 1)
    return F.slice(parts, F.lit(1), keep), F.array_join(F.slice(parts, keep + 1, F.greatest(F.size(parts) - keep, F.lit(0))), ", ")


def gender_of(value: Column) -> Column:
    first = F.regexp_extract(F.lower(F.trim(value)), r"^([^\s.]+)", 1)
    return F.when(first.isin(*_FEMININE), "féminin").when(first.isin(*_MASCULINE), "masculin").otherwise("?")


def category_of(heading: Column) -> Column:
    low, out = T.strip_accents(F.lower(heading)), F.lit(None).cast("string")
    for words, category in reversed(_CATEGORIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, category).otherwise(out)
    return out


def tag_fields(tag: Column) -> Column:
    """``traduire=non``, ``genre=...`` or null of a tag in brackets."""
    t = F.lower(F.trim(tag))
    return F.when(t.contains("ne pas traduire"), "traduire=non").when(t.isin("masculin", "homme", "m"), "genre=masculin").when(t.isin("féminin", "feminin", "femme", "f"), "genre=féminin").when(t == "?", "genre=?")


def deletions(word: Column, budget: int) -> Column:
    """The word and all it leaves after losing up to ``budget`` characters (native arrays)."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array(word)
    for _ in range(budget):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def within_edits(names: DataFrame, words: DataFrame, by: str, name: str, word: str) -> DataFrame:
    """Pairs of a name and another word of the same ``by`` within one edit, two from eight letters of the name on.

    Neighbourhoods of deletions meet as hashes, which is complete for the budget; the distance decides.  A word has tens
    of them, which no estimate of a plan knows, so they are merged and never broadcast.
    """
    keys = lambda c, both: F.explode(F.transform(F.when(F.length(c) >= both, deletions(F.lower(c), 2)).otherwise(deletions(F.lower(c), 1)), lambda k: F.xxhash64(by, k)))
    a = names.withColumn("_k", keys(name, 8))
    b = words.withColumn("_k", keys(word, 6)).withColumnRenamed(by, "_by")
    met = a.join(b.hint("merge"), "_k").where(F.col(by) == F.col("_by")).drop("_k", "_by").distinct()
    budget = F.when(F.length(name) <= 7, 1).otherwise(2)
    d = F.levenshtein(F.lower(name), F.lower(word))
    return met.where((d >= 1) & (d <= budget))


def _people(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "personnages")


def _lines(s: SparkSession, d: str, genre: str) -> DataFrame:
    return T.lines(table(s, d, "documents").where(F.col("genre") == genre), "doc_id", "text")


def q_entry_repair(s, d):
    return repaired(_people(s, d).select("entree_id", "nom", "variantes", "termes_source", "pluriel")).select("entree_id", "nom", "pluriel", "a_romaniser", F.array_join("variantes", "/").alias("variantes"), F.array_join("termes_source", "/").alias("termes"))


def q_glossary_audit(s, d):
    """Entries that still lack a rendering, as report lines."""
    e = repaired(_people(s, d).select("entree_id", "nom", "variantes", "termes_source", "pluriel")).where(F.col("a_romaniser"))
    return e.select("entree_id", F.concat(F.lit("personnages : « "), "nom", F.lit(" » (source : "), F.array_join("termes_source", ", "), F.lit(")")).alias("ligne"))


def q_allowed_wide_forms(s, d):
    """Source spellings that may stand in a rendering: of entries not yet romanised, the longest first."""
    e = repaired(_people(s, d).select("oeuvre", "nom", "variantes", "termes_source", "pluriel")).where(F.col("a_romaniser") & F.col("oeuvre").isNotNull())
    forms = e.select("oeuvre", F.explode(F.concat(F.array("nom"), "variantes")).alias("forme")).where(F.col("forme").rlike(_WIDE)).distinct()
    return forms.select("oeuvre", "forme", F.length("forme").alias("n")).orderBy("oeuvre", F.desc("n"), "forme")


def q_strict_variants(s, d):
    kept, spill = strict_variants(F.col("description"))
    return _people(s, d).where("description IS NOT NULL").select("entree_id", F.array_join(kept, "/").alias("variantes"), spill.alias("reste"))


def q_gender_vocabulary(s, d):
    return _people(s, d).where("genre IS NOT NULL").groupBy(gender_of(F.col("genre")).alias("norme"), "genre").agg(F.count("*").alias("n"))


def q_heading_categories(s, d):
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").where("ligne LIKE '#%'")
    return rows.groupBy(category_of(F.col("ligne")).alias("categorie")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def q_tagged_names(s, d):
    """Glossary lines with a tag in brackets: name, tag and the field it sets."""
    rows = _lines(s, d, "glossaire").select("doc_id", "pos", F.regexp_extract("ligne", r"^- ([^\[|]+)\[([^\]]+)\]", 1).alias("nom"), F.regexp_extract("ligne", r"^- ([^\[|]+)\[([^\]]+)\]", 2).alias("etiquette")).where("nom <> ''")
    return rows.select("doc_id", "pos", F.trim("nom").alias("nom"), "etiquette", tag_fields(F.col("etiquette")).alias("champ"))


def q_name_and_description(s, d):
    """Lines ``Name — description`` with a name of at most 60 signs."""
    at = F.regexp_extract("ligne", r"^(.*?)\s+[—–]\s+(.*)$", 1), F.regexp_extract("ligne", r"^(.*?)\s+[—–]\s+(.*)$", 2)
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.trim(at[0]).alias("nom"), F.trim(at[1]).alias("description"))
    return rows.where("nom <> '' AND description <> '' AND length(nom) <= 60").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("nom")).alias("plus"), F.sum(F.length("description")).alias("signes"))


def q_pair_lines(s, d):
    """Lines ``term → rendering`` or ``term = rendering``: both sides."""
    pattern = r"^\s*(?:- )?([^→=|]{1,60}?)\s*(?:→|=>|=)\s*([^→=|]+)$"
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.regexp_extract("ligne", pattern, 1).alias("terme"), F.trim(F.regexp_extract("ligne", pattern, 2)).alias("rendu"))
    return rows.where("terme <> '' AND rendu <> ''")


def q_elided_article(s, d):
    """``de`` or ``d'`` before the title of a work."""
    return table(s, d, "oeuvres").where("trim(titre) <> ''").select("oeuvre", F.when(F.lower("titre").rlike("^[aeiouyhàâéèêëîïôùûœ]"), F.concat(F.lit("d’"), "titre")).otherwise(F.concat(F.lit("de "), "titre")).alias("du"))


def q_filled_entries(s, d):
    """Every entry with all fields in order, defaults for what is missing."""
    e = _people(s, d)
    return e.select("entree_id", F.coalesce("nom", F.lit("")).alias("nom"), F.coalesce("pluriel", F.lit("")).alias("pluriel"), F.coalesce(F.nullif("genre", F.lit("")), F.lit("?")).alias("genre"), F.size(F.coalesce("variantes", _none())).alias("variantes"), F.size(F.coalesce("termes_source", _none())).alias("termes"), F.size(F.coalesce("interdits", _none())).alias("interdits"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("forcer", F.lit(False)).alias("forcer"))


def entry_line() -> Column:
    """An entry as one line: name, gender, mark of force, variants, banned forms, description; empty parts left out."""
    part = lambda label, c: F.when(F.size(_list(c)) > 0, F.concat(F.lit(f"{label} : "), F.array_join(_list(c), ", ")))
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat(F.lit("- "), F.concat_ws(" | ", filled("nom"), filled("genre"), F.when(F.col("forcer"), "forcer"), part("variantes", "variantes"), part("jamais", "interdits"), part("source", "termes_source"), filled("description")))


def q_entry_lines(s, d):
    return _people(s, d).where("trim(nom) <> ''").select("entree_id", entry_line().alias("ligne"))


def q_sectioned_glossary(s, d):
    """The glossary of every work as one text: digest and size of its sorted lines (entries of a work are bounded)."""
    rows = _people(s, d).where("oeuvre IS NOT NULL AND trim(nom) <> ''").select("oeuvre", entry_line().alias("ligne"))
    text = F.concat(F.lit("## personnages\n"), F.array_join(F.sort_array(F.collect_list("ligne")), "\n"))
    return rows.groupBy("oeuvre").agg(F.count("*").alias("entrees"), F.md5(text).alias("empreinte"), F.length(text).alias("signes"))


def q_character_forms(s, d):
    """Name, variants and the parts of the name from three signs on, each once."""
    forms = F.array_distinct(F.concat(F.array(F.trim("nom")), _list("variantes"), F.filter(F.split(F.trim("nom"), r"\s+"), lambda x: F.length(x) >= 3)))
    return _people(s, d).where("trim(nom) <> ''").select("entree_id", F.array_join(forms, "/").alias("formes"), F.size(forms).alias("n"))


def q_probe_alias(s, d):
    """Each incoming entry's first normalised form that an earlier entry of the work has, and that entry."""
    e = _people(s, d).where("oeuvre IS NOT NULL AND entree_id IS NOT NULL")
    forms = F.concat(F.array("nom"), F.coalesce("variantes", _none()), F.coalesce("termes_source", _none()))
    rows = e.select("entree_id", "oeuvre", F.posexplode(forms).alias("rang", "forme")).select("entree_id", "oeuvre", "rang", T.norm_key("forme").alias("cle")).where("cle <> ''")
    first = rows.groupBy("oeuvre", "cle").agg(F.min("entree_id").alias("premiere"))
    return rows.join(first, ["oeuvre", "cle"]).where("premiere < entree_id").groupBy("entree_id").agg(F.min(F.struct("rang", "premiere", "cle")).alias("x")).select("entree_id", "x.rang", "x.premiere", "x.cle")


def _names(s, d):
    return _people(s, d).where(r"oeuvre IS NOT NULL AND nom RLIKE '^[\\p{L}]{5,}$'")


def _words(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Capitalised words of five letters and more that stand after a small letter or a comma."""
    return rows.select(*keep, F.explode(F.regexp_extract_all("traduction", F.lit(r"[\p{Ll},] (\p{Lu}\p{L}{4,})"), F.lit(1))).alias("mot"))


def q_name_drift(s, d):
    """Names of one word against the capitalised words of their work: near misses and how often each stands."""
    n = _words(table(s, d, "bulles").where("traduction IS NOT NULL AND oeuvre IS NOT NULL"), ["oeuvre"]).groupBy("oeuvre", "mot").agg(F.count("*").alias("n"))
    names = _names(s, d).select("oeuvre", "nom").distinct()
    known = _people(s, d).where("oeuvre IS NOT NULL").select("oeuvre", F.explode(F.concat(F.array("nom", "pluriel"), F.coalesce("variantes", _none()), F.coalesce("interdits", _none()))).alias("f")).select("oeuvre", F.lower(F.trim("f")).alias("mot_")).where("mot_ IS NOT NULL").distinct()
    near = within_edits(names, n, "oeuvre", "nom", "mot")
    fresh = near.withColumn("mot_", F.lower("mot")).join(known, ["oeuvre", "mot_"], "left_anti")
    own = n.select("oeuvre", F.col("mot").alias("nom"), F.col("n").alias("n_nom"))
    return fresh.join(own, ["oeuvre", "nom"], "left").select("oeuvre", "nom", F.col("mot").alias("candidat"), F.coalesce("n_nom", F.lit(0)).alias("n_nom"), F.col("n").alias("n_candidat"), F.when(F.coalesce("n_nom", F.lit(0)) >= 3 * F.col("n"), "T2").otherwise("T3").alias("palier"))


def anchored_drift(bubbles: DataFrame, entries: DataFrame) -> DataFrame:
    """``bulle_id, entree_id, nom, mot``: a source term of the entry stands in the bubble's source and a capitalised word
    of the rendering nearly is its name.  Terms meet bubbles by work and their first signs, as hashes."""
    known = entries.select("entree_id", "oeuvre", "nom", F.explode(_list("termes_source")).alias("terme")).withColumn("debut", F.substring("terme", 1, 2))
    rows = bubbles.where("oeuvre IS NOT NULL AND ocr IS NOT NULL AND traduction IS NOT NULL").select("bulle_id", "oeuvre", "ocr", "traduction").withColumn("mots", F.array_distinct(F.regexp_extract_all("traduction", F.lit(r"(\p{Lu}\p{L}{4,})"), F.lit(1)))).where("size(mots) > 0")
    grams = F.concat(F.regexp_extract_all("ocr", F.lit("(?s)(?=(..))"), F.lit(1)), F.regexp_extract_all("ocr", F.lit("(?s)(.)"), F.lit(1)))
    seen = spread(rows).select("*", F.explode(F.array_distinct(grams)).alias("debut")).withColumn("k", F.xxhash64("oeuvre", "debut"))
    met = seen.join(known.select("entree_id", F.col("oeuvre").alias("o"), "nom", "terme", F.xxhash64("oeuvre", "debut").alias("k")), "k").where((F.col("o") == F.col("oeuvre")) & (F.instr("ocr", F.col("terme")) > 0))
    each = met.select("bulle_id", "entree_id", "nom", F.explode("mots").alias("mot")).distinct()
    dist = F.levenshtein(F.lower("nom"), F.lower("mot"))
    return each.where((dist >= 1) & (dist <= F.when(F.length("nom") <= 7, 1).otherwise(2)))


def q_anchored_drift(s, d):
    return anchored_drift(table(s, d, "bulles"), _names(s, d))


def append_banned(entries: DataFrame, drifts: DataFrame) -> DataFrame:
    """``entree_id, interdits, ajouts``: drifts (``oeuvre, nom, candidat``) appended to the banned forms of the entries of
    that name, without those known in any case; running it again adds nothing."""
    found = drifts.groupBy("oeuvre", "nom").agg(F.sort_array(F.collect_set("candidat")).alias("_c"))
    rows = entries.join(found, ["oeuvre", "nom"], "left").withColumn("_i", F.coalesce("interdits", _none()))
    low = F.transform("_i", lambda x: F.lower(x))
    new = F.filter(F.coalesce("_c", _none()), lambda x: ~F.array_contains(F.col("_low"), F.lower(x)))
    return rows.withColumn("_low", low).withColumn("_new", new).select("entree_id", F.concat("_i", "_new").alias("interdits"), F.size("_new").alias("ajouts"))


def q_drift_append(s, d):
    out = append_banned(_people(s, d).where("oeuvre IS NOT NULL AND nom IS NOT NULL"), q_name_drift(s, d))
    return out.where("ajouts > 0").select("entree_id", F.array_join("interdits", "/").alias("interdits"), "ajouts")


def q_consistency_messages(s, d):
    """Checks of the entries: unknown gender, a work that doesn't exist, a banned form that is a variant, no source term."""
    e = _people(s, d).where("entree_id IS NOT NULL")
    works = table(s, d, "oeuvres").where("oeuvre IS NOT NULL").select("oeuvre").distinct()
    checks = [
        (e.where("oeuvre IS NOT NULL").join(works, "oeuvre", "left_anti"), "oeuvre inconnue"),
        (e.where((F.trim("genre") != "") & ~F.col("genre").isin("m", "f", "?", "masculin", "féminin")), "genre hors liste"),
        (e.where(F.arrays_overlap(F.coalesce("interdits", _none()), F.coalesce("variantes", _none()))), "interdit et variante"),
        (e.where((F.trim("nom") != "") & (F.size(_list("termes_source")) == 0)), "sans source"),
    ]
    out = None
    for rows, message in checks:
        part = rows.select("entree_id", F.lit(message).alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def q_uncited_attributes(s, d):
    """Attributes of characters (role, description) that no bubble or document line of the work cites by name: removed
    ones and kept ones, per attribute."""
    e = _people(s, d).where("oeuvre IS NOT NULL AND trim(nom) <> ''").select("entree_id", "oeuvre", F.lower(F.regexp_extract("nom", r"^(\p{L}+)", 1)).alias("mot"), "role_recit", "description").where("mot <> ''")
    attributes = e.select("entree_id", "oeuvre", "mot", F.explode(F.map_from_arrays(F.array(F.lit("role_recit"), F.lit("description")), F.array("role_recit", "description"))).alias("attribut", "valeur")).where("trim(valeur) <> ''")
    said = table(s, d, "bulles").where("oeuvre IS NOT NULL AND traduction IS NOT NULL").select("oeuvre", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("traduction"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("mot")).distinct()
    kept = attributes.join(said, ["oeuvre", "mot"], "left_semi").groupBy("attribut").agg(F.count("*").alias("n")).withColumn("etat", F.lit("garde"))
    gone = attributes.join(said, ["oeuvre", "mot"], "left_anti").groupBy("attribut").agg(F.count("*").alias("n")).withColumn("etat", F.lit("retire"))
    return kept.unionByName(gone)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_L = "WITH l AS (SELECT doc_id, genre, unnest(string_split(text, chr(10))) AS ligne, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"
_FILL = "list_filter(coalesce({0}, []), lambda x: trim(x, ' ') <> '')"
_REP = f"""r0 AS (SELECT *, trim(coalesce(nom, ''), ' ') AS n_, trim(coalesce(pluriel, ''), ' ') AS p_, list_filter({_FILL.format('variantes')}, lambda x: NOT regexp_matches(x, '{_WIDE}')) AS l_ FROM personnages),
r1 AS (SELECT *, list_filter(l_, lambda x: regexp_matches(x, '{_LATIN}'))[1] AS f_ FROM r0),
r AS (SELECT entree_id, oeuvre, CASE WHEN regexp_matches(n_, '{_WIDE}') AND f_ IS NOT NULL THEN f_ ELSE n_ END AS nom, CASE WHEN regexp_matches(p_, '{_WIDE}') THEN '' ELSE p_ END AS pluriel, regexp_matches(n_, '{_WIDE}') AND f_ IS NULL AS a_romaniser,
 CASE WHEN regexp_matches(n_, '{_WIDE}') AND f_ IS NOT NULL THEN list_concat(l_[:list_position(l_, f_) - 1], l_[list_position(l_, f_) + 1:]) ELSE l_ END AS variantes,
 list_concat({_FILL.format('termes_source')}, list_filter({_FILL.format('variantes')}, lambda x: regexp_matches(x, '{_WIDE}')), CASE WHEN regexp_matches(n_, '{_WIDE}') THEN [n_] ELSE [] END, CASE WHEN regexp_matches(p_, '{_WIDE}') THEN [p_] ELSE [] END) AS t_ FROM r1),
rr AS (SELECT *, list_filter(t_, lambda x, i: list_position(t_, x) = i) AS termes FROM r)"""
_CAT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{c}'" for words, c in _CATEGORIES) + " END"
_LINE = "'- ' || concat_ws(' | ', nullif(trim(nom, ' '), ''), nullif(trim(genre, ' '), ''), CASE WHEN forcer THEN 'forcer' END, " + ", ".join(f"CASE WHEN len({_FILL.format(c)}) > 0 THEN '{n} : ' || array_to_string({_FILL.format(c)}, ', ') END" for n, c in (("variantes", "variantes"), ("jamais", "interdits"), ("source", "termes_source"))) + ", nullif(trim(description, ' '), ''))"
_MOTS = r"regexp_extract_all(traduction, '[\p{Ll},] (\p{Lu}\p{L}{4,})', 1)"
_DRIFT = rf"""w AS (SELECT oeuvre, mot, count(*) AS n FROM (SELECT oeuvre, unnest({_MOTS}) AS mot FROM bulles WHERE traduction IS NOT NULL AND oeuvre IS NOT NULL) GROUP BY 1, 2),
nm AS (SELECT DISTINCT oeuvre, nom FROM personnages WHERE oeuvre IS NOT NULL AND regexp_matches(nom, '^[\p{{L}}]{{5,}}$')),
kn AS (SELECT DISTINCT oeuvre, lower(trim(f, ' ')) AS f FROM (SELECT oeuvre, unnest(list_concat([nom, pluriel], coalesce(variantes, []), coalesce(interdits, []))) AS f FROM personnages WHERE oeuvre IS NOT NULL) WHERE f IS NOT NULL),
dr AS (SELECT nm.oeuvre, nm.nom, w.mot AS candidat, coalesce(o.n, 0) AS n_nom, w.n AS n_candidat, CASE WHEN coalesce(o.n, 0) >= 3 * w.n THEN 'T2' ELSE 'T3' END AS palier FROM nm JOIN w ON nm.oeuvre = w.oeuvre AND levenshtein(lower(nom), lower(mot)) BETWEEN 1 AND CASE WHEN length(nom) <= 7 THEN 1 ELSE 2 END LEFT JOIN w o ON o.oeuvre = nm.oeuvre AND o.mot = nm.nom WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.oeuvre = nm.oeuvre AND kn.f = lower(w.mot)))"""
SQL = {
    "entry_repair": f"WITH {_REP} SELECT entree_id, nom, pluriel, a_romaniser, coalesce(array_to_string(variantes, '/'), '') AS variantes, coalesce(array_to_string(termes, '/'), '') AS termes FROM rr",
    "glossary_audit": f"WITH {_REP} SELECT entree_id, 'personnages : « ' || nom || ' » (source : ' || coalesce(array_to_string(termes, ', '), '') || ')' AS ligne FROM rr WHERE a_romaniser",
    "allowed_wide_forms": f"WITH {_REP} SELECT DISTINCT oeuvre, forme, length(forme) AS n FROM (SELECT oeuvre, unnest(list_concat([nom], variantes)) AS forme FROM rr WHERE a_romaniser AND oeuvre IS NOT NULL) WHERE regexp_matches(forme, '{_WIDE}')",
    "strict_variants": rf"WITH p AS (SELECT entree_id, list_filter(list_transform(regexp_split_to_array(description, ',| et '), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM personnages WHERE description IS NOT NULL), b AS (SELECT *, coalesce(list_position(list_transform(p, lambda x: length(x) > 30 OR contains(x, '.') OR regexp_matches(x, '{_SENTENCE_WORDS}')), true), 0) AS n FROM p) SELECT entree_id, coalesce(array_to_string(CASE WHEN n = 0 THEN p ELSE p[:n - 1] END, '/'), '') AS variantes, CASE WHEN n = 0 THEN '' ELSE array_to_string(p[n:], ', ') END AS reste FROM b",
    "gender_vocabulary": rf"SELECT CASE WHEN g IN {_FEMININE} THEN 'féminin' WHEN g IN {_MASCULINE} THEN 'masculin' ELSE '?' END AS norme, genre, count(*) AS n FROM (SELECT genre, regexp_extract(lower(trim(genre, ' ')), '^([^\s.]+)', 1) AS g FROM personnages WHERE genre IS NOT NULL) GROUP BY 1, 2",
    "heading_categories": _L + f", h AS (SELECT doc_id, translate(lower(ligne), '{T._ACCENTED}', '{T._PLAIN}') AS x FROM l WHERE ligne LIKE '#%') SELECT {_CAT} AS categorie, count(*) AS n, count(DISTINCT doc_id) AS documents FROM h GROUP BY 1",
    "tagged_names": _L + r", t AS (SELECT doc_id, pos, trim(regexp_extract(ligne, '^- ([^\[|]+)\[([^\]]+)\]', 1), ' ') AS nom, regexp_extract(ligne, '^- ([^\[|]+)\[([^\]]+)\]', 2) AS etiquette FROM l WHERE genre = 'glossaire') SELECT *, CASE WHEN contains(lower(trim(etiquette, ' ')), 'ne pas traduire') THEN 'traduire=non' WHEN lower(trim(etiquette, ' ')) IN ('masculin', 'homme', 'm') THEN 'genre=masculin' WHEN lower(trim(etiquette, ' ')) IN ('féminin', 'feminin', 'femme', 'f') THEN 'genre=féminin' WHEN trim(etiquette, ' ') = '?' THEN 'genre=?' END AS champ FROM t WHERE nom <> ''",
    "name_and_description": _L + r", t AS (SELECT doc_id, trim(regexp_extract(ligne, '^(.*?)\s+[—–]\s+(.*)$', 1), ' ') AS nom, trim(regexp_extract(ligne, '^(.*?)\s+[—–]\s+(.*)$', 2), ' ') AS d FROM l) SELECT doc_id, count(*) AS n, max(length(nom)) AS plus, sum(length(d)) AS signes FROM t WHERE nom <> '' AND d <> '' AND length(nom) <= 60 GROUP BY 1",
    "pair_lines": _L + r", t AS (SELECT doc_id, pos, regexp_extract(ligne, '^\s*(?:- )?([^→=|]{1,60}?)\s*(?:→|=>|=)\s*([^→=|]+)$', 1) AS terme, trim(regexp_extract(ligne, '^\s*(?:- )?([^→=|]{1,60}?)\s*(?:→|=>|=)\s*([^→=|]+)$', 2), ' ') AS rendu FROM l) SELECT * FROM t WHERE terme <> '' AND rendu <> ''",
    "elided_article": "SELECT oeuvre, CASE WHEN regexp_matches(lower(titre), '^[aeiouyhàâéèêëîïôùûœ]') THEN 'd’' ELSE 'de ' END || titre AS du FROM oeuvres WHERE trim(titre, ' ') <> ''",
    "filled_entries": "SELECT entree_id, coalesce(nom, '') AS nom, coalesce(pluriel, '') AS pluriel, coalesce(nullif(genre, ''), '?') AS genre, len(coalesce(variantes, [])) AS variantes, len(coalesce(termes_source, [])) AS termes, len(coalesce(interdits, [])) AS interdits, coalesce(description, '') AS description, coalesce(forcer, false) AS forcer FROM personnages",
    "entry_lines": f"SELECT entree_id, {_LINE} AS ligne FROM personnages WHERE trim(nom, ' ') <> ''",
    "sectioned_glossary": f"WITH x AS (SELECT oeuvre, count(*) AS entrees, '## personnages' || chr(10) || string_agg(ligne, chr(10) ORDER BY ligne) AS t FROM (SELECT oeuvre, {_LINE} AS ligne FROM personnages WHERE oeuvre IS NOT NULL AND trim(nom, ' ') <> '') GROUP BY 1) SELECT oeuvre, entrees, md5(t) AS empreinte, length(t) AS signes FROM x",
    "character_forms": rf"WITH f AS (SELECT entree_id, list_concat([trim(nom, ' ')], {_FILL.format('variantes')}, list_filter(regexp_split_to_array(trim(nom, ' '), '\s+'), lambda x: length(x) >= 3)) AS f FROM personnages WHERE trim(nom, ' ') <> ''), g AS (SELECT entree_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS f FROM f) SELECT entree_id, array_to_string(f, '/') AS formes, len(f) AS n FROM g",
    "probe_alias": f"WITH f AS (SELECT entree_id, oeuvre, unnest(l) AS forme, generate_subscripts(l, 1) - 1 AS rang FROM (SELECT entree_id, oeuvre, list_concat([nom], coalesce(variantes, []), coalesce(termes_source, [])) AS l FROM personnages WHERE oeuvre IS NOT NULL AND entree_id IS NOT NULL)), k AS (SELECT entree_id, oeuvre, rang, {key_sql('forme')} AS cle FROM f), p AS (SELECT *, min(entree_id) OVER (PARTITION BY oeuvre, cle) AS premiere FROM k WHERE cle <> '') SELECT entree_id, rang, premiere, cle FROM p WHERE premiere < entree_id QUALIFY row_number() OVER (PARTITION BY entree_id ORDER BY rang, premiere, cle) = 1",
    "name_drift": f"WITH {_DRIFT} SELECT * FROM dr",
    "anchored_drift": rf"WITH e AS (SELECT entree_id, oeuvre, nom, unnest({_FILL.format('termes_source')}) AS terme FROM personnages WHERE oeuvre IS NOT NULL AND regexp_matches(nom, '^[\p{{L}}]{{5,}}$')), x AS (SELECT DISTINCT bulle_id, entree_id, nom, traduction FROM bulles JOIN e USING (oeuvre) WHERE instr(ocr, terme) > 0 AND traduction IS NOT NULL), m AS (SELECT bulle_id, entree_id, nom, unnest(regexp_extract_all(traduction, '(\p{{Lu}}\p{{L}}{{4,}})', 1)) AS mot FROM x) SELECT DISTINCT bulle_id, entree_id, nom, mot FROM m WHERE levenshtein(lower(nom), lower(mot)) BETWEEN 1 AND CASE WHEN length(nom) <= 7 THEN 1 ELSE 2 END",
    "drift_append": f"WITH {_DRIFT}, c AS (SELECT oeuvre, nom, list_sort(list_distinct(list(candidat))) AS c FROM dr GROUP BY 1, 2), a AS (SELECT entree_id, coalesce(interdits, []) AS i, list_filter(c, lambda x: NOT list_contains(list_transform(coalesce(interdits, []), lambda y: lower(y)), lower(x))) AS n FROM personnages JOIN c USING (oeuvre, nom)) SELECT entree_id, array_to_string(list_concat(i, n), '/') AS interdits, len(n) AS ajouts FROM a WHERE len(n) > 0",
    "consistency_messages": f"SELECT entree_id, 'oeuvre inconnue' AS message FROM personnages WHERE oeuvre IS NOT NULL AND entree_id IS NOT NULL AND oeuvre NOT IN (SELECT oeuvre FROM oeuvres WHERE oeuvre IS NOT NULL) UNION ALL SELECT entree_id, 'genre hors liste' FROM personnages WHERE entree_id IS NOT NULL AND trim(genre, ' ') <> '' AND genre NOT IN ('m', 'f', '?', 'masculin', 'féminin') UNION ALL SELECT entree_id, 'interdit et variante' FROM personnages WHERE entree_id IS NOT NULL AND list_has_any(coalesce(interdits, []), coalesce(variantes, [])) UNION ALL SELECT entree_id, 'sans source' FROM personnages WHERE entree_id IS NOT NULL AND trim(nom, ' ') <> '' AND len({_FILL.format('termes_source')}) = 0",
    "uncited_attributes": r"WITH e AS (SELECT oeuvre, lower(regexp_extract(nom, '^(\p{L}+)', 1)) AS mot, role_recit, description FROM personnages WHERE oeuvre IS NOT NULL AND trim(nom, ' ') <> ''), a AS (SELECT oeuvre, mot, 'role_recit' AS attribut FROM e WHERE mot <> '' AND trim(role_recit, ' ') <> '' UNION ALL SELECT oeuvre, mot, 'description' FROM e WHERE mot <> '' AND trim(description, ' ') <> ''), s AS (SELECT DISTINCT oeuvre, unnest(regexp_extract_all(lower(traduction), '(\p{L}+)', 1)) AS mot, true AS dit FROM bulles WHERE oeuvre IS NOT NULL AND traduction IS NOT NULL) SELECT attribut, CASE WHEN dit THEN 'garde' ELSE 'retire' END AS etat, count(*) AS n FROM a LEFT JOIN s USING (oeuvre, mot) GROUP BY 1, 2",
}
