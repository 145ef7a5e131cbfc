"""Entity dictionary: normalised-key upsert, aliases, conflicts, replacement, missing terms, drift, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.operators.glossary import within_edits
from lutrin.operators.profiling import key_sql
from lutrin.plans.stages import EDGES
from lutrin.session import materialise, spread, table

#: Signs of a source spelling that are joined on; buckets of the broadcast set of such beginnings, which only saves work.
_GRAM, _BUCKETS = 3, 1 << 20
_FILLED, _AROUND = r"[^\s\p{Z}]", r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def upsert(base: DataFrame, new: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Keyed merge: filled fields of the base stay, empty ones take the first filled new value, and the
    state is ``ajout``, ``fusion`` or ``conflit`` (a filled field that differs)."""
    w = Window.partitionBy("_k").orderBy(order)
    first = {f: F.first(F.nullif(F.trim(f), F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in fields}
    fresh = new.withColumn("_k", T.norm_key(key)).where("_k <> ''").select("_k", *[v.alias(f"n_{f}") for f, v in first.items()]).distinct()
    old = base.withColumn("_k", T.norm_key(key)).where("_k <> ''").select("_k", *[F.first(F.nullif(F.trim(f), F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"o_{f}") for f in fields]).distinct()
    clash = F.lit(False)
    for f in fields:
        clash = clash | F.coalesce(F.col(f"o_{f}") != F.col(f"n_{f}"), F.lit(False))
    out = old.withColumn("_o", F.lit(1)).join(fresh.withColumn("_n", F.lit(1)), "_k", "full")
    state = F.when(F.col("_o").isNull(), "ajout").when(F.col("_n").isNull(), "inchange").when(clash, "conflit").otherwise("fusion")
    return out.select(F.col("_k").alias("cle"), *[F.coalesce(f"o_{f}", f"n_{f}").alias(f) for f in fields], state.alias("etat"))


def alias_index(entries: DataFrame, key: str, arrays: list[str], name: str) -> DataFrame:
    """``cle, entree``: every normalised form of an entry, its arrays included, the least entry per form."""
    forms = F.concat(F.array(F.col(name)), *[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays])
    rows = entries.select(F.col(key).alias("entree"), "oeuvre", F.explode(forms).alias("forme")).select("entree", "oeuvre", T.norm_key("forme").alias("cle")).where("cle IS NOT NULL AND cle <> ''")
    return rows.groupBy("oeuvre", "cle").agg(F.min("entree").alias("entree"), F.countDistinct("entree").alias("entrees"))


def _people(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "personnages")


def q_entity_upsert(s, d):
    """Entries of the second half of the volumes into those of the first, per normalised name."""
    p = _people(s, d).where("nom IS NOT NULL").withColumn("late", F.coalesce(F.substring("tome", 5, 4).try_cast("int") > 4, F.lit(False)))
    return upsert(p.where("NOT late"), p.where("late"), "nom", ["genre", "role_recit"], "entree_id")


def q_alias_index(s, d):
    return alias_index(_people(s, d).where("oeuvre IS NOT NULL"), "entree_id", ["variantes", "termes_source"], "nom")


def q_known_forms(s, d):
    """Distinct lower-case forms per work: name, plural, variants and banned forms."""
    none = F.array().cast("array<string>")
    forms = F.concat(F.array("nom", "pluriel"), F.coalesce("variantes", none), F.coalesce("interdits", none))
    rows = _people(s, d).select("oeuvre", F.explode(forms).alias("f")).select("oeuvre", F.lower(F.trim("f")).alias("forme")).where("forme IS NOT NULL AND forme <> ''")
    return rows.groupBy("oeuvre").agg(F.countDistinct("forme").alias("formes"))


def q_capitalised_candidates(s, d):
    """Capitalised words of five letters or more inside sentences of French documents, by frequency."""
    rows = table(s, d, "documents").where("text IS NOT NULL AND lower(lang) LIKE 'fr%'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{Ll},] (\p{Lu}[\p{L}-]{4,})"), F.lit(1))).alias("mot"))
    return rows.groupBy("mot").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")).where("n >= 3")


def q_drift_volume(s, d):
    """Candidates for drift: rare words within the edit budget of a frequent one of the same work, that is
    three times as frequent; plurals are no drift.  Neighbourhoods of deletions, complete for the budget, find them."""
    words = table(s, d, "bulles").where("langue_cible = 'fr' AND traduction IS NOT NULL AND oeuvre IS NOT NULL").select("oeuvre", F.explode(F.regexp_extract_all(F.translate("traduction", T._ACCENTED, T._PLAIN), F.lit(r"[a-z,] ([A-Z][a-z]{4,})"), F.lit(1))).alias("mot"))
    n = materialise(words.groupBy("oeuvre", "mot").agg(F.count("*").alias("n")))
    near = within_edits(n.where("n >= 5").select("oeuvre", F.col("mot").alias("nom"), F.col("n").alias("na")), n.select("oeuvre", F.col("mot").alias("candidat"), F.col("n").alias("nb")), "oeuvre", "nom", "candidat")
    return near.where("na >= 3 * nb").where(~F.col("candidat").isin(F.concat("nom", F.lit("s")), F.concat("nom", F.lit("x")))).select("oeuvre", "nom", "candidat", "na", "nb")


def forced_forms(entries: DataFrame) -> DataFrame:
    """``oeuvre, ban, nom``: every banned or variant form, of one word or several, and the name that replaces it."""
    none = F.array().cast("array<string>")
    bans = entries.where("oeuvre IS NOT NULL AND nom IS NOT NULL AND trim(nom) <> ''").select("oeuvre", "nom", F.explode(F.array_distinct(F.concat(F.coalesce("interdits", none), F.coalesce("variantes", none)))).alias("ban"))
    return bans.where(F.col("ban").rlike(r"\p{L}") & (F.col("ban") != F.col("nom"))).groupBy("oeuvre", "ban").agg(F.min("nom").alias("nom"))


def replaced(bubbles: DataFrame, entries: DataFrame) -> DataFrame:
    """``bulle_id, texte, formes``: bubbles with a forced form, all forms replaced as whole words, the longest first.

    Forms meet bubbles by work and first word, as hashes; the whole form is looked for after.
    """
    word = lambda c: F.regexp_extract(c, r"(\p{L}+)", 1)
    bans = forced_forms(entries).withColumn("k", F.xxhash64("oeuvre", word("ban")))
    rows = bubbles.where("traduction IS NOT NULL AND oeuvre IS NOT NULL").select("bulle_id", "oeuvre", "traduction")
    seen = rows.select("*", F.explode(F.array_distinct(F.regexp_extract_all("traduction", F.lit(r"(\p{L}+)"), F.lit(1)))).alias("mot")).withColumn("k", F.xxhash64("oeuvre", "mot")).withColumnRenamed("oeuvre", "o")
    found = seen.join(bans, "k").where((F.col("o") == F.col("oeuvre")) & F.regexp_like("traduction", whole("ban")))
    each = found.groupBy("bulle_id", "oeuvre", "traduction").agg(F.sort_array(F.collect_set(F.struct(F.negative(F.length("ban")).alias("n"), "ban", "nom"))).alias("formes"))
    text = F.aggregate("formes", F.col("traduction"), lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})\Q"), x["ban"], F.lit(r"\E(?!\p{L})")), x["nom"]))
    return each.select("bulle_id", "oeuvre", text.alias("texte"), "formes")


def whole(form: str) -> Column:
    """Pattern of a form that stands between other signs than letters."""
    return F.concat(F.lit(r"(?:^|[^\p{L}])\Q"), F.col(form), F.lit(r"\E(?:$|[^\p{L}])"))


def q_forced_replace(s, d):
    """Banned and variant spellings replaced by the name: how many bubbles of the work each whole form stands in."""
    out = replaced(table(s, d, "bulles"), _people(s, d)).select("oeuvre", F.explode("formes").alias("x"))
    return out.select("oeuvre", "x.ban", "x.nom").groupBy("oeuvre", "ban", "nom").agg(F.count("*").alias("bulles"))


def q_missing_terms(s, d):
    """Bubbles with a whole katakana run that is a glossary spelling (four signs or more, no middle dot) and whose
    rendering lacks the name's first word.  A count by spelling; ``lost_terms`` looks for every spelling and form."""
    terms = _people(s, d).where("oeuvre IS NOT NULL AND nom IS NOT NULL AND trim(nom) <> ''").select("oeuvre", "nom", F.explode("termes_source").alias("terme")).where("length(terme) >= 4 AND terme NOT LIKE '%%・%%'".replace("%%", "%")).groupBy("oeuvre", "terme").agg(F.min("nom").alias("nom"))
    words = table(s, d, "bulles").where("langue_source = 'ja' AND ocr IS NOT NULL AND traduction IS NOT NULL AND oeuvre IS NOT NULL").select("bulle_id", "oeuvre", "traduction", F.explode(F.array_distinct(F.regexp_extract_all("ocr", F.lit("([ァ-ヺー]+)"), F.lit(1)))).alias("terme"))
    first = F.regexp_extract("nom", r"^(\p{L}+)", 1)
    return words.join(terms, ["oeuvre", "terme"]).where((first != "") & (F.instr(F.lower("traduction"), F.lower(first)) == 0)).groupBy("oeuvre", "terme").agg(F.count("*").alias("bulles"))


def lost_terms(bubbles: DataFrame, entries: DataFrame) -> DataFrame:
    """``bulle_id, entree_id, terme, nom``: a source spelling of an entry of the work stands anywhere in the bubble's
    source and no accepted form (name, plural, variants; any case) in its rendering.

    ``terme`` is the first spelling of the entry that the bubble holds.  Spellings meet bubbles by work and first
    signs (at most ``_GRAM``) as hashes, whole spellings are compared after.  Blank spellings and forms, names under five
    signs, and bubbles with a blank side count for nothing.
    """
    filled = lambda c: F.coalesce(F.filter(c, lambda x: x.rlike(_FILLED)), F.array().cast("array<string>"))
    bare = lambda c: F.regexp_replace(c, _AROUND, "")
    known = entries.where("oeuvre IS NOT NULL").select("entree_id", "oeuvre", bare("nom").alias("nom"), filled("termes_source").alias("termes"), F.transform(filled(F.concat(F.array("nom", "pluriel"), F.coalesce("variantes", F.array().cast("array<string>")))), lambda x: F.lower(bare(x))).alias("formes")).where("length(nom) >= 5")
    known = known.select("entree_id", "oeuvre", "nom", "formes", "termes", F.posexplode("termes").alias("rang", "terme"))
    known = known.select("entree_id", "oeuvre", "nom", "formes", "terme", F.slice("termes", F.lit(1), F.col("rang")).alias("avant"), F.substring("terme", 1, _GRAM).alias("debut"))
    rows = bubbles.where(F.col("oeuvre").isNotNull() & F.col("ocr").rlike(_FILLED) & F.col("traduction").rlike(_FILLED)).select("bulle_id", "oeuvre", "ocr", F.lower("traduction").alias("rendu")).withColumn("r", F.xxhash64("bulle_id", "oeuvre", "ocr", "rendu"))
    grams = [F.regexp_extract_all("ocr", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, _GRAM + 1)]
    seen = spread(rows).select("r", "oeuvre", F.explode(F.array_distinct(F.concat(*grams))).alias("debut")).withColumn("seau", F.pmod(F.xxhash64("debut"), F.lit(_BUCKETS)))
    seen = seen.join(F.broadcast(known.select(F.pmod(F.xxhash64("debut"), F.lit(_BUCKETS)).alias("seau")).distinct()), "seau", "left_semi").select("r", "oeuvre", F.xxhash64("oeuvre", "debut").alias("k")).distinct()
    near = seen.join(known.withColumn("k", F.xxhash64("oeuvre", "debut")), ["k", "oeuvre"]).drop("k", "debut")
    hit = rows.join(near, ["r", "oeuvre"]).where((F.instr("ocr", F.col("terme")) > 0) & ~F.exists("avant", lambda t: F.instr(F.col("ocr"), t) > 0) & ~F.exists("formes", lambda f: F.instr(F.col("rendu"), f) > 0))
    return hit.select("bulle_id", "entree_id", "terme", "nom")


def q_lost_terms(s, d):
    return lost_terms(table(s, d, "bulles"), _people(s, d))


def q_gender_evidence(s, d):
    """Masculine and feminine articles before a word in French documents; a gender where they differ by two."""
    rows = table(s, d, "documents").where("text IS NOT NULL AND lower(lang) LIKE 'fr%'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"((?:le|la|un|une) \p{L}{4,})"), F.lit(1))).alias("x"))
    rows = rows.select(F.substring_index("x", " ", 1).alias("art"), F.substring_index("x", " ", -1).alias("mot")).groupBy("mot").agg(F.sum(F.when(F.col("art").isin("le", "un"), 1).otherwise(0)).alias("m"), F.sum(F.when(F.col("art").isin("la", "une"), 1).otherwise(0)).alias("f"))
    return rows.where("m + f >= 2").withColumn("genre", F.when(F.col("m") - F.col("f") >= 2, "m").when(F.col("f") - F.col("m") >= 2, "f"))


def q_mention_context(s, d):
    """Lines within two of a mention of a lantern or a clock in a document: a band over the line number."""
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").withColumn("ici", F.when(F.lower("ligne").rlike("lanterne|horloge|lantern|clock"), 1).otherwise(0))
    near = F.max("ici").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-2, 2))
    return rows.withColumn("pres", near).groupBy("doc_id").agg(F.sum("ici").alias("mentions"), F.sum("pres").alias("lignes")).where("mentions > 0")


def q_volume_diff(s, d):
    """Lines of the two order halves of every customer compared by content: new, changed, same, gone."""
    o = table(s, d, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("an"), "o_totalprice")
    side = lambda lo, hi, n: o.where(F.col("an").between(lo, hi)).groupBy("o_custkey", "o_orderpriority").agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), F.round(F.sum("o_totalprice"), 0).cast("bigint").cast("string"))).alias(n))
    j = side(1990, 1994, "a").join(side(1995, 2030, "b"), ["o_custkey", "o_orderpriority"], "full")
    state = F.when(F.col("a").isNull(), "nouveau").when(F.col("b").isNull(), "absent").when(F.col("a") == F.col("b"), "identique").otherwise("modifie")
    return j.groupBy(state.alias("etat")).agg(F.count("*").alias("n"))


def q_overlay_manual(s, d):
    """Renderings with hand-made ones of the same place laid over: the last one received wins."""
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND idx IS NOT NULL")
    at = ["oeuvre", "tome", "planche", "idx"]
    hand = b.where("origine = 'manuelle' AND traduction IS NOT NULL").groupBy(*at).agg(F.max_by("traduction", "bulle_id").alias("main"))
    base = b.groupBy(*at).agg(F.min_by("traduction", "bulle_id").alias("base"))
    return base.join(hand, at, "left").groupBy("oeuvre").agg(F.count("*").alias("places"), F.count("main").alias("manuelles"), F.sum(F.when(F.col("main") != F.col("base"), 1).otherwise(0)).alias("changees"))


def q_orphan_multiset(s, d):
    """Lines of documents of a work that its extracts don't hold as often: a multiset difference."""
    docs = table(s, d, "documents").where("oeuvre IS NOT NULL AND text IS NOT NULL").select("oeuvre", F.explode(F.split("text", "\n")).alias("l"))
    have = table(s, d, "extraits").where("oeuvre IS NOT NULL AND text IS NOT NULL").select("oeuvre", F.explode(F.split("text", "\n")).alias("l"))
    left = docs.where("length(l) > 20").exceptAll(have.where("length(l) > 20"))
    return left.groupBy("oeuvre").agg(F.count("*").alias("orphelines"))


def q_stale_reasons(s, d):
    """Why a page is stale: a bubble received after the newest creation, a hand-made one, or none."""
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL").groupBy("oeuvre", "tome", "planche").agg(F.max("cree_le").alias("c"), F.max("recu_le").alias("r"), F.max(F.when(F.col("origine") == "manuelle", 1).otherwise(0)).alias("m"))
    why = F.concat_ws("+", F.when(F.col("r") > F.col("c") + F.expr("INTERVAL 1 DAY"), "recue plus tard"), F.when(F.col("m") == 1, "corrigee"))
    return b.groupBy(why.alias("motifs")).agg(F.count("*").alias("planches"))


def q_stage_closure(s, d):
    """Everything that depends on a stage, directly or not, and by how many ways: the table of direct dependants joined
    with itself until no way is longer."""
    edges = s.createDataFrame(list(EDGES), "a string, b string")
    ways = out = edges.withColumn("n", F.lit(1).cast("bigint"))
    for _ in range(len(EDGES)):
        longer = ways.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").groupBy("a", F.col("c").alias("b")).agg(F.sum("n").alias("n"))
        if longer.isEmpty():
            break
        ways, out = longer, out.unionByName(longer)
    return out.groupBy(F.col("a").alias("etape"), F.col("b").alias("dependante")).agg(F.sum("n").alias("chemins"))


def q_search_excerpt(s, d, needle: str = "lanterne", most: int = 500):
    """The first hit of a needle in each document (any case, any accent), with what stands around it: the first ``most``."""
    folded = T.strip_accents(F.lower("text"))
    rows = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.instr(folded, needle).alias("ou")).where("ou > 0")
    return rows.select("doc_id", "ou", T.excerpt("text", F.col("ou"), len(needle)).alias("extrait")).orderBy("doc_id").limit(most)


def q_numbered_parse(s, d):
    """Numbered lines of translation prompts: the first of a number wins, continuation lines are counted."""
    rows = T.lines(table(s, d, "documents").where("genre = 'consigne'"), "doc_id", "text").withColumn("num", F.regexp_extract("ligne", r"^\s*(\d{1,3})[.)]\s", 1))
    rows = rows.withColumn("num", F.when(F.col("num") != "", F.col("num")).cast("int")).withColumn("k", F.last("num", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    per = rows.groupBy("doc_id").agg(F.count("num").alias("numeros"), F.countDistinct("num").alias("distincts"), F.sum(F.when(F.col("k").isNull(), 1).otherwise(0)).alias("preambule"), F.max("num").alias("dernier"))
    return per


def q_glossary_parse(s, d):
    """Glossary documents read back into fields: ``- Name | field: value | ... | description``."""
    rows = T.lines(table(s, d, "documents").where("genre = 'glossaire'"), "doc_id", "text").where("ligne LIKE '- %|%'")
    body = F.regexp_replace("ligne", "^- ", "")
    return rows.select("doc_id", "pos", F.trim(F.substring_index(body, "|", 1)).alias("nom"), F.trim(F.regexp_extract("ligne", r"\| ?genre ?: ?([^|]*)", 1)).alias("genre"), F.trim(F.regexp_extract("ligne", r"\| ?source ?: ?([^|]*)", 1)).alias("source"), (F.size(F.split("ligne", r"\|")) - 1).alias("champs"))


def q_perf_log_phases(s, d):
    """Run logs: lines and seconds per phase of every log, phases never seen left out."""
    rows = T.lines(table(s, d, "documents").where("genre = 'journal'"), "doc_id", "text")
    rows = rows.select("doc_id", F.regexp_extract("ligne", r"\[(\p{L}+)\] (?:page|bloc) \d+/\d+ : (\d+\.\d+)s", 1).alias("phase"), F.regexp_extract("ligne", r"\[(\p{L}+)\] (?:page|bloc) \d+/\d+ : (\d+\.\d+)s", 2).alias("sec")).where("phase <> ''")
    return rows.groupBy("doc_id", "phase").agg(F.count("*").alias("n"), F.round(F.sum(F.col("sec").cast("double")), 4).alias("secondes"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_EDGES = "VALUES ('detection','nettoyage'),('detection','ocr'),('detection','sfx'),('nettoyage','rendu'),('ocr','terminologie'),('terminologie','traduction'),('traduction','rendu'),('sfx','rendu')"
_CLOSURE = f"WITH RECURSIVE e(a, b) AS ({_EDGES}), c(a, b) AS (SELECT a, b FROM e UNION ALL SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS etape, b AS dependante, count(*) AS chemins FROM c GROUP BY a, b"
_A, _P = T._ACCENTED, T._PLAIN
_L = "WITH l AS (SELECT doc_id, genre, unnest(string_split(text, chr(10))) AS ligne, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"
_FOLD = f"translate(lower(text), '{_A}', '{_P}')"
SQL = {
    "entity_upsert": f"WITH p AS (SELECT {key_sql('nom')} AS k, entree_id, nullif(trim(genre, ' '), '') AS genre, nullif(trim(role_recit, ' '), '') AS role_recit, coalesce(try_cast(substring(tome, 5, 4) AS INT) > 4, false) AS late FROM personnages WHERE nom IS NOT NULL), o AS (SELECT k, arg_min(genre, entree_id) FILTER (genre IS NOT NULL) AS g, arg_min(role_recit, entree_id) FILTER (role_recit IS NOT NULL) AS r FROM p WHERE k <> '' AND NOT late GROUP BY k), n AS (SELECT k, arg_min(genre, entree_id) FILTER (genre IS NOT NULL) AS g, arg_min(role_recit, entree_id) FILTER (role_recit IS NOT NULL) AS r FROM p WHERE k <> '' AND late GROUP BY k) SELECT coalesce(o.k, n.k) AS cle, coalesce(o.g, n.g) AS genre, coalesce(o.r, n.r) AS role_recit, CASE WHEN o.k IS NULL THEN 'ajout' WHEN n.k IS NULL THEN 'inchange' WHEN coalesce(o.g <> n.g, false) OR coalesce(o.r <> n.r, false) THEN 'conflit' ELSE 'fusion' END AS etat FROM o FULL JOIN n ON o.k = n.k",
    "alias_index": f"WITH f AS (SELECT entree_id, oeuvre, unnest(list_concat([nom], coalesce(variantes, []), coalesce(termes_source, []))) AS forme FROM personnages WHERE oeuvre IS NOT NULL), k AS (SELECT entree_id, oeuvre, {key_sql('forme')} AS cle FROM f) SELECT oeuvre, cle, min(entree_id) AS entree, count(DISTINCT entree_id) AS entrees FROM k WHERE cle IS NOT NULL AND cle <> '' GROUP BY 1, 2",
    "known_forms": "SELECT oeuvre, count(DISTINCT lower(trim(f, ' '))) AS formes FROM (SELECT oeuvre, unnest(list_concat([nom, pluriel], coalesce(variantes, []), coalesce(interdits, []))) AS f FROM personnages) WHERE f IS NOT NULL AND trim(f, ' ') <> '' GROUP BY 1",
    "capitalised_candidates": r"SELECT mot, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{Ll},] (\p{Lu}[\p{L}-]{4,})', 1)) AS mot FROM documents WHERE text IS NOT NULL AND lower(lang) LIKE 'fr%') GROUP BY 1 HAVING count(*) >= 3",
    "drift_volume": f"WITH w AS (SELECT oeuvre, unnest(regexp_extract_all(translate(traduction, '{_A}', '{_P}'), '[a-z,] ([A-Z][a-z]{{4,}})', 1)) AS mot FROM bulles WHERE langue_cible = 'fr' AND traduction IS NOT NULL AND oeuvre IS NOT NULL), n AS (SELECT oeuvre, mot, count(*) AS n FROM w GROUP BY 1, 2) SELECT a.oeuvre, a.mot AS nom, b.mot AS candidat, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.oeuvre = b.oeuvre AND a.mot <> b.mot AND a.n >= 5 AND a.n >= 3 * b.n AND levenshtein(lower(a.mot), lower(b.mot)) <= CASE WHEN length(a.mot) <= 7 THEN 1 ELSE 2 END AND b.mot NOT IN (a.mot || 's', a.mot || 'x')",
    "forced_replace": r"WITH b AS (SELECT oeuvre, ban, min(nom) AS nom FROM (SELECT oeuvre, nom, unnest(list_distinct(list_concat(coalesce(interdits, []), coalesce(variantes, [])))) AS ban FROM personnages WHERE oeuvre IS NOT NULL AND nom IS NOT NULL AND trim(nom, ' ') <> '') WHERE regexp_matches(ban, '\p{L}') AND ban <> nom GROUP BY 1, 2) SELECT b.oeuvre, ban, nom, count(*) AS bulles FROM bulles t JOIN b ON t.oeuvre = b.oeuvre WHERE CASE WHEN instr(traduction, ban) > 0 THEN regexp_matches(traduction, '(?:^|[^\p{L}])\Q' || ban || '\E(?:$|[^\p{L}])') ELSE false END GROUP BY ALL",
    "missing_terms": r"WITH t AS (SELECT oeuvre, terme, min(nom) AS nom FROM (SELECT oeuvre, nom, unnest(termes_source) AS terme FROM personnages WHERE oeuvre IS NOT NULL AND nom IS NOT NULL AND trim(nom, ' ') <> '') WHERE length(terme) >= 4 AND terme NOT LIKE '%・%' GROUP BY 1, 2), w AS (SELECT bulle_id, oeuvre, traduction, unnest(list_distinct(regexp_extract_all(ocr, '([ァ-ヺー]+)', 1))) AS terme FROM bulles WHERE langue_source = 'ja' AND ocr IS NOT NULL AND traduction IS NOT NULL AND oeuvre IS NOT NULL) SELECT oeuvre, terme, count(*) AS bulles FROM w JOIN t USING (oeuvre, terme) WHERE regexp_extract(nom, '^(\p{L}+)', 1) <> '' AND instr(lower(traduction), lower(regexp_extract(nom, '^(\p{L}+)', 1))) = 0 GROUP BY 1, 2",
    "lost_terms": r"WITH e AS (SELECT entree_id, oeuvre, regexp_replace(nom, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS nom, list_filter(termes_source, lambda t: regexp_matches(t, '[^\s\p{Z}]')) AS termes, list_filter(list_concat([nom, pluriel], coalesce(variantes, [])), lambda f: regexp_matches(f, '[^\s\p{Z}]')) AS formes FROM personnages), h AS (SELECT bulle_id, entree_id, list_filter(termes, lambda t: instr(ocr, t) > 0)[1] AS terme, nom, list_filter(formes, lambda f: instr(lower(traduction), lower(regexp_replace(f, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))) > 0) AS la FROM bulles JOIN e USING (oeuvre) WHERE length(nom) >= 5 AND regexp_matches(ocr, '[^\s\p{Z}]') AND regexp_matches(traduction, '[^\s\p{Z}]')) SELECT bulle_id, entree_id, terme, nom FROM h WHERE terme IS NOT NULL AND len(la) = 0",
    "gender_evidence": r"WITH x AS (SELECT unnest(regexp_extract_all(lower(text), '((?:le|la|un|une) \p{L}{4,})', 1)) AS x FROM documents WHERE text IS NOT NULL AND lower(lang) LIKE 'fr%'), y AS (SELECT split_part(x, ' ', 2) AS mot, count(*) FILTER (split_part(x, ' ', 1) IN ('le', 'un')) AS m, count(*) FILTER (split_part(x, ' ', 1) IN ('la', 'une')) AS f FROM x GROUP BY 1) SELECT mot, m, f, CASE WHEN m - f >= 2 THEN 'm' WHEN f - m >= 2 THEN 'f' END AS genre FROM y WHERE m + f >= 2",
    "mention_context": _L + ", i AS (SELECT doc_id, pos, CASE WHEN regexp_matches(lower(ligne), 'lanterne|horloge|lantern|clock') THEN 1 ELSE 0 END AS ici FROM l), p AS (SELECT doc_id, ici, max(ici) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pres FROM i) SELECT doc_id, sum(ici) AS mentions, sum(pres) AS lignes FROM p GROUP BY 1 HAVING sum(ici) > 0",
    "volume_diff": "WITH o AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS an, o_totalprice FROM orders), a AS (SELECT o_custkey, o_orderpriority, md5(count(*) || '|' || round(sum(o_totalprice), 0)::BIGINT) AS a FROM o WHERE an BETWEEN 1990 AND 1994 GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderpriority, md5(count(*) || '|' || round(sum(o_totalprice), 0)::BIGINT) AS b FROM o WHERE an BETWEEN 1995 AND 2030 GROUP BY 1, 2) SELECT CASE WHEN a IS NULL THEN 'nouveau' WHEN b IS NULL THEN 'absent' WHEN a = b THEN 'identique' ELSE 'modifie' END AS etat, count(*) AS n FROM a FULL JOIN b USING (o_custkey, o_orderpriority) GROUP BY 1",
    "overlay_manual": "WITH b AS (SELECT * FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND idx IS NOT NULL), r AS (SELECT oeuvre, tome, planche, idx, arg_max(traduction, bulle_id) FILTER (origine = 'manuelle' AND traduction IS NOT NULL) AS main, first(traduction ORDER BY bulle_id) AS base FROM b GROUP BY 1, 2, 3, 4) SELECT oeuvre, count(*) AS places, count(main) AS manuelles, count(*) FILTER (main <> base) AS changees FROM r GROUP BY 1",
    "orphan_multiset": "WITH d AS (SELECT oeuvre, unnest(string_split(text, chr(10))) AS l FROM documents WHERE oeuvre IS NOT NULL AND text IS NOT NULL), e AS (SELECT oeuvre, unnest(string_split(text, chr(10))) AS l FROM extraits WHERE oeuvre IS NOT NULL AND text IS NOT NULL), x AS (SELECT * FROM d WHERE length(l) > 20 EXCEPT ALL SELECT * FROM e WHERE length(l) > 20) SELECT oeuvre, count(*) AS orphelines FROM x GROUP BY 1",
    "stale_reasons": "WITH b AS (SELECT max(cree_le) AS c, max(recu_le) AS r, max(CASE WHEN origine = 'manuelle' THEN 1 ELSE 0 END) AS m FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL GROUP BY oeuvre, tome, planche) SELECT concat_ws('+', CASE WHEN r > c + INTERVAL 1 DAY THEN 'recue plus tard' END, CASE WHEN m = 1 THEN 'corrigee' END) AS motifs, count(*) AS planches FROM b GROUP BY 1",
    "stage_closure": _CLOSURE,
    "search_excerpt": f"WITH h AS (SELECT doc_id, text, instr({_FOLD}, 'lanterne') AS ou FROM documents WHERE text IS NOT NULL) SELECT doc_id, ou, (CASE WHEN greatest(1, ou - 28) > 1 THEN '…' ELSE '' END) || substring(text, greatest(1, ou - 28), ou + 36 - greatest(1, ou - 28)) || (CASE WHEN ou + 35 < length(text) THEN '…' ELSE '' END) AS extrait FROM h WHERE ou > 0 ORDER BY doc_id LIMIT 500",
    "numbered_parse": _L + r", n AS (SELECT doc_id, pos, CAST(nullif(regexp_extract(ligne, '^\s*(\d{1,3})[.)]\s', 1), '') AS INT) AS num FROM l WHERE genre = 'consigne'), k AS (SELECT *, last_value(num IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n) SELECT doc_id, count(num) AS numeros, count(DISTINCT num) AS distincts, count(*) FILTER (k IS NULL) AS preambule, max(num) AS dernier FROM k GROUP BY 1",
    "glossary_parse": _L + r" SELECT doc_id, pos, trim(split_part(regexp_replace(ligne, '^- ', ''), '|', 1), ' ') AS nom, trim(regexp_extract(ligne, '\| ?genre ?: ?([^|]*)', 1), ' ') AS genre, trim(regexp_extract(ligne, '\| ?source ?: ?([^|]*)', 1), ' ') AS source, len(string_split(ligne, '|')) - 1 AS champs FROM l WHERE genre = 'glossaire' AND ligne LIKE '- %|%'",
    "perf_log_phases": _L + r", p AS (SELECT doc_id, regexp_extract(ligne, '\[(\p{L}+)\] (?:page|bloc) \d+/\d+ : (\d+\.\d+)s', 1) AS phase, regexp_extract(ligne, '\[(\p{L}+)\] (?:page|bloc) \d+/\d+ : (\d+\.\d+)s', 2) AS sec FROM l WHERE genre = 'journal') SELECT doc_id, phase, count(*) AS n, round(sum(sec::DOUBLE), 4) AS secondes FROM p WHERE phase <> '' GROUP BY 1, 2",
}
