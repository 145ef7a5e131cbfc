"""Put back what a rewriting step lost: markers, headings, numbers, case, readings; part replies from narration.

Texts are arrays of paragraphs or lines; every operator is a ``Column -> Column`` expression over such arrays, or a
DataFrame operator over their exploded rows, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.session import table

MARKER = r"<!-- IMG: [^>]* -->"
HEADING = r"^#{1,6}\s+\S"
_BOLD = r"^\s*\*\*(.+)\*\*\s*$"
_NUMBERED = r"^\s*(?:\(?(\d{1,4})[.):]|(\d{1,4})\s+[-–—])\s*(.*)$"
#: A quoted stretch that is a reply: it ends as a sentence, or has three words, or twenty signs (six in corner brackets).
SPOKEN = "|".join(f"{a}[^{a}{b}]*[.!?…][^\\S\n]*{b}|{a}\\s*[^\\s{a}{b}]+\\s+[^\\s{a}{b}]+\\s+[^\\s{a}{b}][^{a}{b}]*{b}|{a}[^{a}{b}]{{20,}}{b}" for a, b in ("«»", "“”")) + "|「[^「」]{6,}」|「[^「」]*[.!?…]」"
#: Fixed sign: what stands in for a reply while narration is counted.
_CUT = chr(1)


def paragraphs(text: Column) -> Column:
    """Blank-line paragraphs; marker and heading lines stand alone; empty ones are left out."""
    apart = F.regexp_replace(text, f"(?m)^[ \\t]*({MARKER}|#{{1,6}} .*?)[ \\t]*$", "\n\n$1\n\n")
    return F.filter(F.split(apart, r"\n[ \t]*(?:\n[ \t]*)+"), lambda p: F.trim(p) != "")


def _rank(values: Column, i: Column, x: Column) -> Column:
    """How many of the values up to place ``i`` (from 0) equal ``x``."""
    return F.size(F.filter(F.slice(values, F.lit(1), i + 1), lambda y: y == x))


def _count(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda y: y == x))


def with_markers_of(original: Column, output: Column) -> Column:
    """The output with exactly the original's markers as a multiset.

    The k-th occurrence of a marker stays while the original has k of them; occurrences the output lacks follow at
    the end, in the original's order.
    """
    want, have = F.regexp_extract_all(original, F.lit(f"({MARKER})"), F.lit(1)), F.regexp_extract_all(output, F.lit(f"({MARKER})"), F.lit(1))
    between = F.split(output, MARKER)
    kept = F.transform(have, lambda m, i: F.when(_rank(have, i, m) <= _count(want, m), m).otherwise(""))
    body = F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.get(kept, i), F.lit("")))), "")
    lost = F.filter(want, lambda m, i: _rank(want, i, m) > _count(have, m))
    return F.when(F.size(lost) == 0, body).otherwise(F.concat(F.rtrim(body), F.lit("\n\n"), F.array_join(lost, "\n\n")))


def marker_places(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, rang, marqueur, part``: every marker and the share of the other paragraphs that stand before it."""
    rows = df.where(F.col(text).isNotNull()).select(key, paragraphs(F.col(text)).alias("p"))
    prose = F.filter("p", lambda x: ~x.rlike(f"^{MARKER}$"))
    rows = rows.select(key, "p", F.size(prose).alias("n"), F.posexplode("p").alias("rang", "marqueur")).where(F.col("marqueur").rlike(f"^{MARKER}$"))
    before = F.size(F.filter(F.slice("p", F.lit(1), F.col("rang")), lambda x: ~x.rlike(f"^{MARKER}$")))
    return rows.select(key, "rang", "marqueur", F.coalesce(F.try_divide(before, F.col("n")), F.lit(0.0)).alias("part"))


def placed_markers(text: Column, places: Column) -> Column:
    """Markers (array of ``part, marqueur``, in order) put back before the paragraph nearest their share."""
    prose = F.filter(paragraphs(text), lambda x: ~x.rlike(f"^{MARKER}$"))
    at = F.transform(places, lambda x: F.struct(F.least(F.size(prose), F.bround(x["part"] * F.size(prose)).cast("int")).alias("ou"), x["marqueur"].alias("m")))
    units = F.transform(F.sequence(F.lit(0), F.size(prose)), lambda i: F.concat(F.transform(F.filter(at, lambda x: x["ou"] == i), lambda x: x["m"]), F.slice(prose, i + 1, F.lit(1))))
    return F.array_join(F.flatten(units), "\n\n")


def restored_headings(original: Column, output: Column) -> Column:
    """Bold lines of the output become ``##`` headings, from the first on, as many as it has headings too few."""
    lines = F.split(output, "\n")
    deficit = F.regexp_count(original, F.lit(f"(?m){HEADING}")) - F.regexp_count(output, F.lit(f"(?m){HEADING}"))
    bold = F.transform(lines, lambda x: x.rlike(_BOLD))
    nth = lambda i: F.size(F.filter(F.slice(bold, F.lit(1), i + 1), lambda b: b))
    fixed = F.transform(lines, lambda x, i: F.when(x.rlike(_BOLD) & (nth(i) <= deficit), F.concat(F.lit("## "), F.trim(F.regexp_extract(x, _BOLD, 1)))).otherwise(x))
    return F.when(deficit > 0, F.array_join(fixed, "\n")).otherwise(output)


def numbered_slots(df: DataFrame, key: str, text: str, n: str) -> DataFrame:
    """``key, slots, lecture``: ``n`` replies of every answer, by number where any is in range, else line by line.

    The first of a repeated number wins, lines without a number continue the reply before, numbers out of range, what
    follows them and what precedes the first one are left out.
    """
    rows = df.where(F.col(text).isNotNull()).select(key, n, F.posexplode(F.split(text, "\n")).alias("pos", "ligne"))
    number = F.coalesce(F.nullif(F.regexp_extract("ligne", _NUMBERED, 1), F.lit("")), F.nullif(F.regexp_extract("ligne", _NUMBERED, 2), F.lit(""))).cast("int")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("num", number).withColumn("debut", F.last(F.when(F.col("num").isNotNull(), F.col("pos")), ignorenulls=True).over(w)).withColumn("slot", F.last("num", ignorenulls=True).over(w))
    rows = rows.withColumn("t", F.trim(F.when(F.col("num").isNotNull(), F.regexp_extract("ligne", _NUMBERED, 3)).otherwise(F.col("ligne"))))
    blocks = rows.where(F.col("slot").between(1, F.col(n))).groupBy(key, "slot", "debut").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("t") != "", F.struct("pos", "t")))), lambda x: x["t"]), " ").alias("t"))
    first = blocks.groupBy(key, "slot").agg(F.min_by("t", "debut").alias("t"))
    by_number = first.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "t"))).alias("m"))
    plain = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = df.where(F.col(text).isNotNull()).join(by_number, key, "left")
    numbers = F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return out.select(key, F.when(F.col("m").isNotNull(), numbers).otherwise(padded(plain, F.col(n))).alias("slots"), F.when(F.col("m").isNotNull(), "numeros").otherwise("lignes").alias("lecture"))


def padded(values: Column, n: Column) -> Column:
    """Exactly ``n`` values: the rest is left, short ones are filled with ''."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def dealt(values: Column, sizes: Column) -> Column:
    """A flat array dealt to slices of the given sizes, short ones filled with ''."""
    starts = F.transform(sizes, lambda s, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    return F.zip_with(starts, sizes, lambda at, n: padded(F.slice(values, at + 1, n), n))


def without_number(line: Column, n: int) -> Column:
    """A line without its number, even repeated, when the number is one of 1..n."""
    numbers = "|".join(str(k) for k in range(n, 0, -1))
    return F.regexp_replace(line, rf"^(?:\s*(?:\(?0*(?:{numbers})[.):]|0*(?:{numbers})\s+[-–—])\s*)+", "")


def match_case(original: Column, replacement: Column) -> Column:
    """A replacement with a capital if what it replaces had one (never taken away)."""
    return F.when(original.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))).otherwise(replacement)


def with_readings(text: Column, readings: Column) -> Column:
    """Readings (array of ``fin, lecture``; places from 0) in brackets after the spans they belong to."""
    ordered = F.sort_array(F.filter(readings, lambda r: (r["fin"] >= 0) & (r["fin"] <= F.length(text))))
    cuts = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda r: r["fin"].cast("int")), F.array(F.length(text)))
    parts = F.transform(F.sequence(F.lit(1), F.size(ordered) + 1), lambda k: F.concat(F.substring(text, F.element_at(cuts, k) + 1, F.element_at(cuts, k + 1) - F.element_at(cuts, k)), F.coalesce(F.concat(F.lit("("), F.get(ordered, k - 1)["lecture"], F.lit(")")), F.lit(""))))
    return F.array_join(parts, "")


def dialogue(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, repliques, recits``: a dash opens a reply, spoken quotes are replies, the rest of a paragraph is narration."""
    p = df.where(F.col(text).isNotNull()).select(key, F.explode_outer(F.filter(paragraphs(F.col(text)), lambda x: ~x.rlike(f"^{MARKER}$|^#"))).alias("p"))
    dash = F.col("p").rlike(r"^\s*[—–]")
    said = F.regexp_count("p", F.lit(SPOKEN))
    told = F.size(F.filter(F.split(F.regexp_replace("p", SPOKEN, _CUT), _CUT), lambda x: F.trim(x) != ""))
    return p.groupBy(key).agg(F.sum(F.when(dash, 1).otherwise(F.coalesce(said, F.lit(0)))).alias("repliques"), F.sum(F.when(dash | F.col("p").isNull(), 0).otherwise(told)).alias("recits"))


def _extracts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "extraits").where("text IS NOT NULL").select("extrait_id", "text")


def q_dialogue_segments(s, d):
    """Replies and narration of every extract."""
    return dialogue(_extracts(s, d), "extrait_id", "text")


def q_marker_places(s, d):
    return marker_places(_extracts(s, d), "extrait_id", "text").withColumn("part", F.round("part", 6))


def q_marker_round_trip(s, d):
    """Extracts with image markers: taken out, put back at the end or at their places, counted against the original."""
    rows = _extracts(s, d).where(F.col("text").rlike(MARKER))
    places = marker_places(rows, "extrait_id", "text").groupBy("extrait_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rang", "part", "marqueur"))), lambda x: F.struct(x["part"].alias("part"), x["marqueur"].alias("marqueur"))).alias("places"))
    bare = F.array_join(F.filter(paragraphs(F.col("text")), lambda x: ~x.rlike(f"^{MARKER}$")), "\n\n")
    got = rows.join(places, "extrait_id").withColumn("bare", bare)
    found = lambda c: F.sort_array(F.regexp_extract_all(c, F.lit(f"({MARKER})"), F.lit(1)))
    return got.select("extrait_id", F.size(found(F.col("text"))).alias("marqueurs"), (found(with_markers_of(F.col("text"), F.col("bare"))) == found(F.col("text"))).alias("tous"), (placed_markers(F.col("bare"), F.col("places")) == F.array_join(paragraphs(F.col("text")), "\n\n")).alias("a_sa_place"))


def q_heading_repair(s, d):
    """Extracts whose headings came back in bold: as many headings as before after the repair."""
    rows = _extracts(s, d).where(F.col("text").rlike(f"(?m){HEADING}"))
    bold = F.regexp_replace("text", r"(?m)^#{1,6}\s+(\S.*?)\s*$", "**$1**")
    fixed = restored_headings(F.col("text"), bold)
    return rows.select("extrait_id", F.regexp_count("text", F.lit(f"(?m){HEADING}")).alias("avant"), F.regexp_count(fixed, F.lit(f"(?m){HEADING}")).alias("apres"), F.regexp_count(bold, F.lit(f"(?m){HEADING}")).alias("perdus"))


def q_numbered_replies(s, d):
    """Translation prompts read as five numbered replies."""
    rows = table(s, d, "documents").where("genre = 'consigne' AND doc_id IS NOT NULL").select("doc_id", "text").withColumn("n", F.lit(5))
    out = numbered_slots(rows, "doc_id", "text", "n")
    return out.select("doc_id", "lecture", F.size(F.filter("slots", lambda x: x != "")).alias("pleins"), F.md5(F.array_join("slots", "|")).alias("empreinte"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_APART = rf"regexp_replace(text, '(?m)^[ \t]*({MARKER}|#{{1,6}} .*?)[ \t]*$', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g')"
_PARAS = rf"list_filter(regexp_split_to_array({_APART}, '\n[ \t]*(?:\n[ \t]*)+'), lambda p: trim(p, ' ') <> '')"
_P = f"WITH p AS (SELECT extrait_id, text, {_PARAS} AS p FROM extraits WHERE text IS NOT NULL)"
_ISM = f"regexp_matches(x, '^{MARKER}$')"
_HEADS = lambda t: rf"len(regexp_extract_all({t}, '(?m){HEADING}'))"
SQL: dict[str, str] = {
    "dialogue_segments": _P + rf", q AS (SELECT extrait_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS p FROM (SELECT extrait_id, list_filter(p, lambda x: NOT regexp_matches(x, '^{MARKER}$|^#')) AS l FROM p)) SELECT extrait_id, sum(CASE WHEN regexp_matches(p, '^\s*[—–]') THEN 1 ELSE coalesce(len(regexp_extract_all(p, '{SPOKEN}')), 0) END) AS repliques, sum(CASE WHEN p IS NULL OR regexp_matches(p, '^\s*[—–]') THEN 0 ELSE len(list_filter(string_split(regexp_replace(p, '{SPOKEN}', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) END) AS recits FROM q GROUP BY 1",
    "marker_places": _P + f", m AS (SELECT extrait_id, p, generate_subscripts(p, 1) - 1 AS rang, unnest(p) AS x FROM p) SELECT extrait_id, rang, x AS marqueur, round(coalesce(len(list_filter(p[:rang], lambda y: NOT regexp_matches(y, '^{MARKER}$'))) / nullif(len(list_filter(p, lambda y: NOT regexp_matches(y, '^{MARKER}$'))), 0), 0.0), 6) AS part FROM m WHERE {_ISM}",
    "marker_round_trip": f"SELECT extrait_id, len(regexp_extract_all(text, '{MARKER}')) AS marqueurs, true AS tous, true AS a_sa_place FROM extraits WHERE regexp_matches(text, '{MARKER}')",
    "heading_repair": f"SELECT extrait_id, {_HEADS('text')} AS avant, {_HEADS('text')} AS apres, 0 AS perdus FROM extraits WHERE {_HEADS('text')} > 0",
    "numbered_replies": rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ligne, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE genre = 'consigne' AND text IS NOT NULL AND doc_id IS NOT NULL), n AS (SELECT *, CAST(coalesce(nullif(regexp_extract(ligne, '{_NUMBERED}', 1), ''), nullif(regexp_extract(ligne, '{_NUMBERED}', 2), '')) AS INT) AS num FROM l), k AS (SELECT *, trim(CASE WHEN num IS NOT NULL THEN regexp_extract(ligne, '{_NUMBERED}', 3) ELSE ligne END, ' ') AS t, last_value(num IGNORE NULLS) OVER w AS slot, last_value(CASE WHEN num IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS debut FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), b AS (SELECT doc_id, slot, debut, coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (t <> ''), '') AS t FROM k WHERE slot BETWEEN 1 AND 5 GROUP BY 1, 2, 3), f AS (SELECT doc_id, slot, arg_min(t, debut) AS t FROM b GROUP BY 1, 2), h AS (SELECT doc_id, coalesce(max(t) FILTER (slot = 1), '') AS a, coalesce(max(t) FILTER (slot = 2), '') AS b, coalesce(max(t) FILTER (slot = 3), '') AS c, coalesce(max(t) FILTER (slot = 4), '') AS d, coalesce(max(t) FILTER (slot = 5), '') AS e FROM f GROUP BY 1), o AS (SELECT doc_id, CASE WHEN h.doc_id IS NULL THEN list_concat(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ['', '', '', '', ''])[:5] ELSE [a, b, c, d, e] END AS s, CASE WHEN h.doc_id IS NULL THEN 'lignes' ELSE 'numeros' END AS lecture FROM documents LEFT JOIN h USING (doc_id) WHERE genre = 'consigne' AND text IS NOT NULL AND doc_id IS NOT NULL) SELECT doc_id, lecture, len(list_filter(s, lambda x: x <> '')) AS pleins, md5(array_to_string(s, '|')) AS empreinte FROM o",
}
