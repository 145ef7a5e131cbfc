"""Problem 5: pair the lines of the two sides of a bilingual unit that render the same sentence.

Method: the paired documents are the units, cut into short blocks at the same place of both sides.  Words
of the two languages that keep occurring in the same blocks are correlated (phi), and each mutually strong
pair of words is a concept both languages share; words written alike on both sides are one too.  A span of
text is the vector of its words' similarities to the concepts, weighted by rarity; spans of one unit are
compared by sparse cosine, a join on the concept in SQL.  Spans are whole lines, the sentences and joined
clauses of a line, and windows of two neighbouring lines.  The best span pairs of all that compete for a piece
of text are kept, round after round until none is left.  The pairs found serve as sharper paired documents, from
which concepts and pairs are found again.

All spans of a unit that share a concept are compared, however far apart their places are (a part may be left out
or stand elsewhere), so work grows with the square of a unit's length.  Both sides of a long unit are dealt out in
parts of about ``PART`` spans and every two parts are one block; rows are placed by block, so the dot products are
summed where they arise and no pair is shuffled before it has passed ``LEAST``.

Defined results: lines with a null unit, language, key or text, blank lines and ornaments are in no pair; units
with one language give none; of units with more than two languages every two are compared.  Equal scores
go to the nearer place, then the smaller keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.llm import lookalikes
from lutrin.session import materialise, one_per_key, running, settings, spread, table

BLOCK = 6
PART = 512
#: Words on more than this share of a language's lines say nothing; those on less tell blocks apart.
COMMON, TELLING = 0.2, 0.1
#: Least cosine of a kept pair, in the first and in the last pass.
LEAST = (0.4, 0.42)
_KANA = "[" + chr(0x30A1) + "-" + chr(0x30FA) + chr(0x30FC) + "]+"
_HAN = "[" + chr(0x4E00) + "-" + chr(0x9FFF) + chr(0x3005) + "]+"
_HIRA = "[" + chr(0x3041) + "-" + chr(0x3096) + "]{2,}"
_TOKENS = re.compile(rf"\d+|{_KANA}|{_HAN}|{_HIRA}|(?:(?![{chr(0x3041)}-{chr(0x9FFF)}])[^\W\d_])+|[?？]|[!！]")
_SENTENCES = re.compile(r"(?<=[.!?…。！？])[\"'»”」』\s]*(?=\S)")
#: Words that join a clause to the one before.
_JOINS = re.compile(r"[,;、]\s*(?:and then|and|then|but|while|et puis|puis|et|mais|tandis que|y luego|luego|y|pero|mientras|そして|それから|しかし|また)(?=\s|(?<=[ぁ-ん]))[\s、]*|[—–;；]\s+", re.I)


def tokens_of(text: str) -> list[str]:
    out = []
    for t in _TOKENS.findall(lookalikes.look(text).casefold()):
        out.append("#" + str(int(t)) if t.isdecimal() else {"？": "?", "！": "!"}.get(t, t))
    return out


def pieces_of(text: str) -> list[str]:
    """Sentences of a line, each cut before joining words."""
    out = []
    for s in _SENTENCES.split(text):
        for c in _JOINS.split(s):
            if c and re.search(r"\w", c):
                out.append(c)
    return out


def _atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, cols = [], ([], [])
        for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
            pieces = [p for p in map(tokens_of, pieces_of(text)) if p]
            for k, p in enumerate(pieces):
                keep.append(i)
                cols[0].append(k)
                cols[1].append(p)
        rest = [c.take(pa.array(keep, pa.int64())) for c in b.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.string()))], names=[*b.schema.names[:-1], "atome", "mots"])


def placed_lines(passages: DataFrame) -> DataFrame:
    """``g, lp, cote, langue, id, ordre, place, texte``: one row per line and comparison it takes part in.

    ``g`` stands for a unit and two of its languages, ``lp`` for the two languages, ``cote`` is 0 for the
    first of them; ``place`` is scaled to the longer side.
    """
    rows = passages.where("unite IS NOT NULL AND langue IS NOT NULL AND passage_id IS NOT NULL AND texte IS NOT NULL")
    rows = rows.select(F.col("passage_id").cast("bigint").alias("id"), "unite", F.lower(F.substring(F.trim("langue"), 1, 2)).alias("langue"), F.coalesce("rang", F.lit(0)).alias("rang"), "texte")
    rows = one_per_key(rows, "id").where(F.col("texte").rlike(r"[\p{L}\p{N}]"))
    sizes = rows.groupBy("unite", "langue").agg(F.count("*").alias("n"))
    a, b = sizes.alias("a"), sizes.alias("b")
    both = a.join(b, (F.col("a.unite") == F.col("b.unite")) & (F.col("a.langue") < F.col("b.langue")))
    both = both.select(F.col("a.unite").alias("unite"), F.xxhash64("a.unite", "a.langue", "b.langue").alias("g"), F.xxhash64("a.langue", "b.langue").alias("lp"), F.greatest("a.n", "b.n").alias("most"), F.explode(F.array(F.struct(F.col("a.langue").alias("l"), F.lit(0).alias("cote"), F.col("a.n").alias("n")), F.struct(F.col("b.langue").alias("l"), F.lit(1).alias("cote"), F.col("b.n").alias("n")))).alias("x"))
    both = both.select("unite", F.col("x.l").alias("langue"), "g", "lp", F.col("x.cote").alias("cote"), "most", F.col("x.n").alias("n"))
    rows = running(rows, ["unite", "langue"], [F.col("rang"), F.col("id")], F.lit(1), "ordre").withColumn("ordre", (F.col("ordre") - 1).cast("int"))
    return rows.join(both, ["unite", "langue"]).select("g", "lp", "cote", "langue", "id", "ordre", ((F.col("ordre") + 0.5) * F.col("most") / F.col("n")).cast("float").alias("place"), "texte")


def concepts_from(docs_a: DataFrame, docs_b: DataFrame, least: float, keep: int = 3) -> DataFrame:
    """Concepts of paired documents: ``lp, doc, x`` and ``lp, doc, y`` -> ``lp, x, y, phi`` (word ids).

    A concept is a pair of words that are among each other's ``keep`` strongest correlations.
    """
    total = docs_a.groupBy("lp").agg(F.countDistinct("doc").alias("n"))
    x = docs_a.groupBy("lp", "x").agg(F.count("*").alias("nx"))
    y = docs_b.groupBy("lp", "y").agg(F.count("*").alias("ny"))
    # a pair of words counts from two documents on, so words of one document are left out before the join
    seen_a = docs_a.join(x.where("nx >= 2").select("lp", "x"), ["lp", "x"], "left_semi")
    seen_b = docs_b.join(y.where("ny >= 2").select("lp", "y"), ["lp", "y"], "left_semi")
    both = seen_a.join(seen_b.drop("lp"), "doc").groupBy("lp", "x", "y").agg(F.count("*").cast("int").alias("c")).where("c >= 2")
    joined = both.join(x, ["lp", "x"]).join(y, ["lp", "y"]).join(F.broadcast(total), "lp")
    expected = F.col("nx") * F.col("ny") / F.col("n")
    phi = joined.withColumn("phi", (F.col("c") - expected) / F.sqrt(F.col("nx").cast("double") * F.col("ny"))).where(F.col("phi") >= least).select("lp", "x", "y", "phi")
    for_x = Window.partitionBy("lp", "x").orderBy(F.desc("phi"), "y")
    for_y = Window.partitionBy("lp", "y").orderBy(F.desc("phi"), "x")
    return phi.withColumn("rx", F.row_number().over(for_x)).withColumn("ry", F.row_number().over(for_y)).where((F.col("rx") <= keep) & (F.col("ry") <= keep)).select("lp", "x", "y", "phi")


def _spans(atoms: DataFrame) -> DataFrame:
    """``g, lp, cote, span, sorte, place, pieces, mots``: the spans to compare; ``pieces`` are what they cover.

    A piece is named by its line and number; spans are whole lines (``l``), pieces of lines that have
    several (``a``) and two neighbouring lines of one piece each (``w``).
    """
    here = [F.col(c) for c in ("g", "lp", "cote", "id", "ordre", "place")]
    lines = atoms.groupBy(*here).agg(F.sort_array(F.collect_list(F.struct("atome", "mots"))).alias("a"))
    lines = lines.withColumn("pieces", F.transform("a", lambda x: F.xxhash64("g", "id", x["atome"]))).withColumn("n", F.size("a")).withColumn("mots", F.flatten(F.transform("a", lambda x: x["mots"])))
    side = ["g", "lp", "cote"]
    whole = lines.select(*side, F.xxhash64("g", "id").alias("span"), F.lit("l").alias("sorte"), "place", "pieces", "mots")
    one = materialise(lines.where("n = 1").select(*side, "id", "ordre", "place", "pieces", "mots"))
    after = one.select("g", "cote", (F.col("ordre") - 1).alias("ordre"), F.struct("mots", "pieces").alias("suite"))
    two = one.join(after, ["g", "cote", "ordre"]).select(*side, F.xxhash64("g", "id", F.lit("w")).alias("span"), F.lit("w").alias("sorte"), (F.col("place") + 0.5).cast("float").alias("place"), F.concat("pieces", "suite.pieces").alias("pieces"), F.concat("mots", "suite.mots").alias("mots"))
    many = lines.where("n > 1").select(*side, "id", "place", "pieces", F.posexplode("a").alias("k", "x")).select(*side, F.xxhash64("g", "id", F.lit("a"), "k").alias("span"), F.lit("a").alias("sorte"), "place", F.slice("pieces", F.col("k") + 1, 1).alias("pieces"), F.col("x.mots").alias("mots"))
    return whole.unionByName(two).unionByName(many)


def span_pairs(spans: DataFrame, concepts: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """``sa, sb, score``: pairs of spans of the two sides by sparse cosine in the space of concepts."""
    bags = spans.select("g", "lp", "cote", "span", "place", F.explode("mots").alias("mot")).groupBy("g", "lp", "cote", "span", "place", "mot").agg(F.sqrt(F.count("*").cast("float")).alias("n"))
    bags = bags.join(words.select("mot", "idf"), "mot")
    sides = concepts.select("lp", F.lit(0).alias("cote"), F.col("x").alias("mot"), F.xxhash64("x", "y").alias("c"), "phi").unionByName(concepts.select("lp", F.lit(1).alias("cote"), F.col("y").alias("mot"), F.xxhash64("x", "y").alias("c"), "phi"))
    v = bags.join(sides, ["lp", "cote", "mot"]).select("g", "cote", "span", "place", "c", (F.col("idf") * F.col("n") * F.sqrt("phi")).cast("float").alias("v"))
    v = materialise(v.groupBy("g", "cote", "span", "place").agg(F.collect_list(F.struct("c", "v")).alias("vec")).select("g", "cote", "span", "place", "vec", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x["v"] * x["v"])).alias("norm")))
    of = lambda cote: F.ceil(F.count_if(F.col("cote") == cote) / PART).cast("int")
    parts = v.groupBy("g").agg(of(0).alias("na"), of(1).alias("nb")).where("na > 0 AND nb > 0")
    unit = (F.col("x.v") / F.col("norm")).cast("float").alias("v")

    def dealt(cote: int, own: str, others: str, name: str) -> DataFrame:
        mine, other = F.pmod("span", own).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        rows = v.where(f"cote = {cote}").join(parts, "g").select("g", "span", "norm", "vec", mine.alias("mine"), other.alias("other"))
        block = F.xxhash64("g", "mine", "other") if cote == 0 else F.xxhash64("g", "other", "mine")
        return rows.select(block.alias("bloc"), F.col("span").alias(name), "norm", F.explode("vec").alias("x")).select("bloc", name, F.col("x.c").alias("c"), unit).repartition("bloc")

    # Placed by block alone, the join and the sums need no other exchange.
    with settings(v.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        dots = dealt(0, "na", "nb", "sa").alias("a").join(dealt(1, "nb", "na", "sb").alias("b"), ["bloc", "c"])
        dots = materialise(dots.groupBy("bloc", "sa", "sb").agg(F.sum(F.col("a.v") * F.col("b.v")).alias("cos")).where(F.col("cos") >= least).select("sa", "sb", "cos"))
    # Figures are kept by every rendering: spans that both hold some must share one.
    figures = words.where("chiffre").select("mot")
    with_f = spans.select("span", F.explode("mots").alias("mot")).join(figures, "mot").groupBy("span").agg(F.collect_set("mot").alias("f"))
    info = spans.select("span", "sorte", "place", "pieces").join(with_f, "span", "left")
    name = lambda x: info.select(F.col("span").alias("s" + x), *(F.col(c).alias(c + x) for c in ("sorte", "place", "pieces", "f")))
    full = dots.join(name("a"), "sa").join(name("b"), "sb").where("fa IS NULL OR fb IS NULL OR arrays_overlap(fa, fb)")
    near = 0.06 / (1 + F.abs(F.col("placea") - F.col("placeb")) / 4)
    joined = F.when((F.col("sortea") == "w") | (F.col("sorteb") == "w"), -0.08).otherwise(0.0)  # two lines must beat each
    return full.select(F.xxhash64("sa", "sb").alias("p"), (F.col("cos") + near + joined).alias("score"), F.concat("piecesa", "piecesb").alias("pieces"))


def best_spans(pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """``p, score, pieces``: the pairs that win every piece of text they cover, round after round.

    A round takes the best of the pairs left, so there is always a next winner until none is left; ``rounds`` stops
    earlier, which the first pass does (it wants sure pairs alone).
    """
    left, won, turn = materialise(pairs), None, 0
    while True:
        turn += 1
        each = left.select("p", "score", F.explode("pieces").alias("piece"))
        top = each.groupBy("piece").agg(F.max(F.struct("score", "p")).alias("best"))
        kept = each.join(top, "piece").withColumn("ok", F.col("best.p") == F.col("p"))
        winners = kept.groupBy("p").agg(F.min("ok").alias("ok")).where("ok").select("p")
        now = materialise(left.join(winners, "p", "left_semi"))
        won = now if won is None else won.unionByName(now)
        if turn == rounds:
            return won
        used = now.select(F.explode("pieces").alias("piece")).distinct()
        left = materialise(left.join(each.join(used, "piece", "left_semi").select("p").distinct(), "p", "left_anti"))
        if left.isEmpty():
            return won


def lines_of(won: DataFrame, pieces: DataFrame) -> DataFrame:
    """``a, b, score``: the pairs of lines that the span pairs cover."""
    covered = won.select("p", "score", F.explode("pieces").alias("piece")).join(pieces, "piece").select("p", "score", "cote", "id").distinct()
    a = covered.where("cote = 0").select("p", "score", F.col("id").alias("a"))
    return a.join(covered.where("cote = 1").select("p", F.col("id").alias("b")), "p").groupBy("a", "b").agg(F.max("score").alias("score"))


def aligned_lines(passages: DataFrame) -> DataFrame:
    """``passage_a, passage_b, score``: the lines that render the same sentence."""
    lines = placed_lines(passages)
    kinds = "g bigint, lp bigint, cote int, langue string, id bigint, ordre int, place float, atome int, mots array<string>"
    texts = materialise(spread(lines).mapInArrow(_atoms, kinds))
    # Words become numbers, told apart by language; a figure or sign is one word in all languages.
    coded = materialise(texts.withColumn("mots", F.transform("mots", lambda m: F.struct(F.when(m.rlike("^[#?!]"), F.xxhash64(m)).otherwise(F.xxhash64("langue", m)).alias("m"), m.startswith("#").alias("c"), F.xxhash64(m).alias("t")))))
    each = coded.select("langue", "id", F.explode("mots").alias("x")).select("langue", "id", F.col("x.m").alias("mot"), F.col("x.c").alias("chiffre"), F.col("x.t").alias("t")).distinct()
    totals = each.groupBy("langue").agg(F.countDistinct("id").alias("n"))
    counts = each.groupBy("langue", "mot").agg(F.count("*").alias("df"), F.max("chiffre").alias("chiffre"), F.max("t").alias("t")).join(F.broadcast(totals), "langue")
    by_language = materialise(counts.select("langue", "mot", "t", "chiffre", F.log((F.col("n") + 1) / F.col("df")).alias("idf"), (F.col("df") / F.col("n")).alias("part")))
    words = materialise(by_language.groupBy("mot").agg(F.max("idf").cast("float").alias("idf"), F.min("part").alias("part"), F.max("chiffre").alias("chiffre")).where(f"part <= {COMMON}"))
    atoms = materialise(coded.withColumn("mots", F.transform("mots", lambda x: x["m"])).drop("langue"))

    # Words written alike on both sides of a pair of languages are one concept.
    pairs_of = texts.select("lp", "cote", "langue").distinct()
    known = by_language.join(F.broadcast(pairs_of), "langue").where(f"part <= {COMMON}")
    a, b = known.where("cote = 0").alias("a"), known.where("cote = 1").alias("b")
    alike = a.join(b, (F.col("a.lp") == F.col("b.lp")) & (F.col("a.t") == F.col("b.t"))).select(F.col("a.lp").alias("lp"), F.col("a.mot").alias("x"), F.col("b.mot").alias("y"), F.when(F.col("a.mot") == F.col("b.mot"), 1.0).otherwise(0.7).alias("phi"))
    alike = materialise(alike)

    def with_alike(found: DataFrame) -> DataFrame:
        return materialise(found.unionByName(alike).groupBy("lp", "x", "y").agg(F.max("phi").alias("phi")))

    telling = atoms.select("g", "lp", "cote", "id", "place", F.explode("mots").alias("mot")).join(words.where(f"part <= {TELLING}").select("mot"), "mot").distinct()
    telling = materialise(telling)
    block = telling.select("lp", "cote", F.xxhash64("g", F.floor(F.col("place") / BLOCK)).alias("doc"), "mot").distinct()
    concepts = with_alike(concepts_from(block.where("cote = 0").select("lp", "doc", F.col("mot").alias("x")), block.where("cote = 1").select("lp", "doc", F.col("mot").alias("y")), 0.1))
    spans = materialise(_spans(atoms))
    pieces = materialise(atoms.select(F.xxhash64("g", "id", "atome").alias("piece"), "cote", "id"))
    found = materialise(lines_of(best_spans(span_pairs(spans.where("sorte = 'l'"), concepts, words, LEAST[0]), 1), pieces))
    # The pairs found are the paired documents of the second pass.
    docs = found.select(F.xxhash64("a", "b").alias("doc"), "a", "b")
    one = docs.join(telling.where("cote = 0").select(F.col("id").alias("a"), "lp", F.col("mot").alias("x")), "a").select("lp", "doc", "x").distinct()
    two = docs.join(telling.where("cote = 1").select(F.col("id").alias("b"), "lp", F.col("mot").alias("y")), "b").select("lp", "doc", "y").distinct()
    concepts = with_alike(concepts_from(one, two, 0.15))
    final = lines_of(best_spans(span_pairs(spans, concepts, words, LEAST[1])), pieces)
    return final.select(F.least("a", "b").alias("passage_a"), F.greatest("a", "b").alias("passage_b"), "score").groupBy("passage_a", "passage_b").agg(F.max("score").alias("score"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_lines(table(spark, sf_dir, "passages")).select("passage_a", "passage_b")
