"""Problem 4: noise in text from scanned pages, and the text repaired into readable paragraphs.

Method: words of scanned text that clean text hardly knows are joined, in SQL, with the words whose anagram
hash (the sum of the fifth powers of their characters) differs by exactly what a known confusion of glyphs
changes; the string check that follows keeps the pairs in which putting the glyphs back gives the word,
and the most frequent such word is the correction.  Lines at page edges that are a page number or a
running header are furniture.  A hyphen at a line's end parts one word when the corpus knows the joined word
better than the compound; furniture between the halves is skipped.

Counts of words are over all texts: what translations and digital files say is clean evidence, what
bubbles and scans say is noisy evidence.  Characters of problem 6 are brought to their look first.

Defined results: null and empty texts give no rows.  ``ligne`` counts from 0 the pieces between ``\\n``.  A
header or number line has that one kind only; a line has each other kind at most once.  Whole texts are used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.llm import furniture, lookalikes
from lutrin.session import materialise, spread, table

#: What is read, and what stood there.
CONFUSIONS = tuple(x.split(">") for x in (
    "c>e e>c f>t t>f f>e 0>o 1>i 1>l |>l |>i !>l !>i 5>s $>s @>a 4>a ii>u u>ii cl>d d>cl rn>m m>rn li>h h>li vv>w w>vv i>l l>i "
    "9>g 6>g q>g g>q 6>b 6>é 8>b 3>e €>e ¢>c 7>t 2>z n>ri ri>n n>u u>n in>m ni>m b>h h>b lc>k £>l j>i "
    "e'>è e'>é e`>è a'>á a`>à i'>í o'>ó u'>ú n~>ñ e^>ê a^>â i^>î o^>ô u^>û"
).split())
_SIGNS = "|@¢$€£"
_TOKEN = re.compile(rf"[\w{re.escape(_SIGNS)}]+(?:[!](?=\w)[\w{re.escape(_SIGNS)}]+)*")
#: An accent read as a sign after its letter, inside a word.
_DETACHED = re.compile(r"[^\W\d_]+[aeioun]['`^~´][^\W\d_]+", re.I)
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿŒœ]")
_MIXED = re.compile(rf"[^\W\d_][\d{re.escape(_SIGNS)}!]+[^\W\d_]|[{re.escape(_SIGNS)}][^\W\d_]{{2}}|[^\W\d_]{{2}}[{re.escape(_SIGNS)}\d]|[\d][^\W\d_]{{3}}")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|er|re|e|ème|eme|º|ª|h|km|m|s)?|[^\W\d_]{1,6}\d{1,4}")
_HYPHEN = re.compile(r"([^\W\d_][\w|@¢$]*(?:-[\w|@¢$]+)*)\s?([-‐‑¬" + chr(0xAD) + r"])[ \t" + chr(0xA0) + "]*$")
_START = re.compile(r"\W{0,2}?([\w|@¢$]+(?:-[\w|@¢$]+)*)")
_MASK = (1 << 63) - 1
#: Most words broadcast as certainly right: they save the joins of words no correction names, and change no row.
COMMON = 20_000
#: Share of the clean words from which a word is known to stand alone, so a hyphen after it needs evidence.
STANDS_ALONE = 2e-5
#: Longer words are compared with all right words of like length instead of by hashes.
LONG = 40


def anagram(word: str) -> int:
    return sum(ord(c) ** 5 for c in word) & _MASK


_DELTAS = [(read, true, anagram(read) - anagram(true)) for read, true in CONFUSIONS]


_ODD_LETTERS = re.compile("[^" + chr(0) + "-" + chr(0x17F) + chr(0x2010) + "-" + chr(0x2026) + chr(0x3000) + "-" + chr(0x9FFF) + "]|[" + chr(0xA0) + chr(0xAD) + "]")


def _seen_words(text: str) -> list[str]:
    """Words in their look and case, with the signs that may have been read for letters."""
    if not text.isascii() and _ODD_LETTERS.search(text):
        text = lookalikes.look(text)
    found = _TOKEN.findall(text)
    return found + _DETACHED.findall(text) if "'" in text or "~" in text or "`" in text or "^" in text else found


def words_of(line: str) -> list[str]:
    """Lower-case words that hold a Latin letter."""
    return [w for w in map(str.casefold, _seen_words(line)) if _LATIN.search(w)]


def targets(word: str) -> list[int] | None:
    """Anagram hashes of the words that one or two kinds of confusion, each any number of times, could have turned
    into ``word``; None for a word of over ``LONG`` characters, whose pairs of steps would be too many."""
    if len(word) > LONG:
        return None
    h, steps = anagram(word), []
    for i, (read, _, delta) in enumerate(_DELTAS):
        steps += [(i, k * delta) for k in range(1, word.count(read) + 1)]
    one = {(h - d) & _MASK for _, d in steps}
    two = {(h - a - b) & _MASK for (i, a), (j, b) in combinations(steps, 2) if i != j} if len(word) > 3 else set()
    return list(one | two)


def undone(word: str, true: str, kinds: int = 2) -> bool:
    """Can glyphs of at most ``kinds`` confusions, wherever they stand, be put back so that ``word`` is ``true``?"""
    todo = [(0, 0, frozenset())]
    met = set(todo)
    while todo:
        i, j, used = todo.pop()
        if i == len(word) and j == len(true):
            return True
        if i == len(word) or j == len(true):
            continue
        steps = [(i + 1, j + 1, used)] if word[i] == true[j] else []
        for n, (read, real, _) in enumerate(_DELTAS):
            if (n in used or len(used) < kinds) and word.startswith(read, i) and true.startswith(real, j):
                steps.append((i + len(read), j + len(real), used | {n}))
        for step in steps:
            if step not in met:
                met.add(step)
                todo.append(step)
    return False


def scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``champ, cle, texte, titre, propre``: every text that counts; ``propre`` where it is clean evidence."""
    titles = table(spark, sf_dir, "oeuvres").where("oeuvre IS NOT NULL").groupBy("oeuvre").agg(F.max("titre").alias("titre"))
    b = table(spark, sf_dir, "bulles")
    # Only values of several lines can hold a header, so only they need their work's title.
    several = b.where("instr(ocr, '\\n') > 0").select("bulle_id", "ocr", "oeuvre").join(titles, "oeuvre", "left").select(F.lit("bulles.ocr").alias("champ"), F.col("bulle_id").alias("cle"), F.col("ocr").alias("texte"), "titre", F.lit(False).alias("propre"))
    single = b.where("instr(ocr, '\\n') = 0").select(F.lit("bulles.ocr").alias("champ"), F.col("bulle_id").alias("cle"), F.col("ocr").alias("texte"), F.lit(None).cast("string").alias("titre"), F.lit(False).alias("propre"))
    clean = b.where("traduction IS NOT NULL").select(F.lit("bulles.traduction").alias("champ"), F.col("bulle_id").alias("cle"), F.col("traduction").alias("texte"), F.lit(None).cast("string").alias("titre"), F.lit(True).alias("propre"))
    e = table(spark, sf_dir, "extraits").where("text IS NOT NULL")
    scanned = F.coalesce(F.lower("outil").contains("ocr"), F.lit(False)) | F.coalesce(F.lower("type_fichier").contains("scan"), F.lit(False))
    files = e.select(F.lit("extraits.text").alias("champ"), F.col("extrait_id").alias("cle"), F.col("text").alias("texte"), F.col("fichier").alias("titre"), (~scanned).alias("propre"))
    return several.unionByName(single).unionByName(clean).unionByName(files)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        clean: Counter = Counter()
        noisy: Counter = Counter()
        for text, is_clean in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if _LATIN.search(text):
                into = clean if is_clean else noisy
                into.update(_seen_words(text))
                if "-" in text:
                    into.update(_COMPOUND.findall(text))
        folded: dict[str, list[int]] = {}
        for place, seen in enumerate((clean, noisy)):
            for w, n in seen.items():
                if _LATIN.search(w):
                    row = folded.setdefault(w.casefold(), [0, 0, 0])
                    row[place] += n
                    if w[0].islower():
                        row[2] += n
        yield pa.RecordBatch.from_arrays([pa.array(folded, pa.string()), *(pa.array([r[i] for r in folded.values()], pa.int64()) for i in range(3))], names=["mot", "propres", "bruites", "minuscules"])


def vocabulary(texts: DataFrame) -> DataFrame:
    """``mot, propres, bruites, minuscules``: occurrences of every word in clean, in noisy text, and of
    both those that begin with a small letter (a name has none)."""
    rows = spread(texts.where("texte IS NOT NULL").select("texte", "propre")).mapInArrow(_count, "mot string, propres bigint, bruites bigint, minuscules bigint")
    return rows.groupBy("mot").agg(*(F.sum(c).alias(c) for c in ("propres", "bruites", "minuscules")))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([anagram(w) for w in words], pa.int64()), pa.array([targets(w) if c else None for w, c in zip(words, b.column(4).to_pylist())], pa.list_(pa.int64()))], names=[*b.schema.names, "h", "cibles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [undone(w, v) for w, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def corrections(words: DataFrame) -> DataFrame:
    """``mot, juste``: misread words and their correction (null where only the signs tell)."""
    n = F.col("propres") + F.col("bruites")
    # A word is suspect where clean text hardly has it beside what noisy text has.
    suspect = (F.col("bruites") > 0) & (F.col("propres") <= F.greatest(F.lit(1), F.col("bruites") / 5)) & ~F.col("mot").contains("-") & (F.length("mot") > 1)
    hashed = materialise(words.select("mot", "propres", "bruites", "minuscules", suspect.alias("suspect")).mapInArrow(_hashes, "mot string, propres bigint, bruites bigint, minuscules bigint, suspect boolean, h bigint, cibles array<bigint>"))
    bad = hashed.where("suspect").select(F.col("mot").alias("w"), n.alias("nw"), F.col("propres").alias("pw"), F.col("minuscules").alias("lw"), F.explode("cibles").alias("h"))
    good = hashed.where("propres >= 3 AND mot rlike '^[\\\\p{L}]{2,}$'").select(F.col("mot").alias("v"), n.alias("nv"), F.col("minuscules").alias("lv"), "h")
    # Two names may differ by a confusable glyph and both be right, so letters alone tell little of a name.
    names = (F.col("lw") == 0) & (F.col("lv") == 0) & F.col("w").rlike(r"^\p{L}+$") & (F.col("nw") > 2) & (F.col("nv") < 200 * F.col("nw"))
    # A confusion at most halves or doubles a word, so the long ones meet the right words of like magnitude.
    size = F.floor(F.log2(F.length("mot"))).cast("int")
    long_bad = hashed.where(f"suspect AND length(mot) > {LONG}").select(F.col("mot").alias("w"), n.alias("nw"), F.col("propres").alias("pw"), F.col("minuscules").alias("lw"), F.explode(F.array(size - 1, size, size + 1)).alias("z"))
    long_good = hashed.where(f"propres >= 3 AND length(mot) > {LONG // 2} AND mot rlike '^[\\\\p{{L}}]+$'").select(F.col("mot").alias("v"), n.alias("nv"), F.col("minuscules").alias("lv"), size.alias("z"))
    met = bad.join(good, "h").drop("h").unionByName(long_bad.join(long_good, "z").drop("z"))
    near = met.where("v <> w AND nv >= 5 * nw AND (pw = 0 OR nv >= 20 * nw)").where(~names).select("w", "v", "nv")
    right = near.mapInArrow(_verify, "w string, v string, nv bigint").groupBy("w").agg(F.max(F.struct("nv", "v")).alias("best")).select(F.col("w").alias("mot"), F.col("best.v").alias("juste"))
    signs = hashed.where("suspect").where(F.col("mot").rlike(r"\p{L}[0-9|@¢$€£!]+\p{L}|[|@¢$€£]\p{L}{2}|\p{L}{2}[|@¢$€£]|\p{L}{3}[0-9]$|^[0-9]\p{L}{3}")).where(~F.col("mot").rlike(r"^[0-9]+(st|nd|rd|th|er|re|e|ème|º|ª|h|km)$")).select("mot")
    return signs.join(right, "mot", "full").select("mot", "juste")


def furniture_lines(lines: list[str], title: str | None, bubble: bool) -> dict[int, str]:
    """Line -> ``entete`` or ``folio``."""
    out: dict[int, str] = {}
    if len(lines) < 2:
        return out
    first = next((i for i, x in enumerate(lines) if x.strip()), 0)
    edges = {0, 1, len(lines) - 1, len(lines) - 2} if bubble else None
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or (edges is not None and i not in edges):
            continue
        if (len(s) <= 24 or len("".join(s.split())) <= 24) and furniture.is_folio(s):
            plain = re.fullmatch(r"\d{1,4}|[ivxl]+\.?", furniture.bare(s))
            year = re.fullmatch(r"1\d{3}|20\d\d", s) and i <= first + 4 and not bubble
            if not year and not (bubble and plain and (i not in (0, len(lines) - 1) or not s[0].isdigit())):
                out[i] = "folio"
                continue
        if (bubble or i > first) and (s[-1] not in ".!?…。！？,;:、」”»" or s[-2:-1].isdigit()) and furniture.is_header(s, title):
            out[i] = "entete"
    return out


def halves(lines: list[str], noise: dict[int, str]) -> list[tuple[int, str, str, str]]:
    """(line, first half, second half, sign) of every hyphen at a line's end with a word to follow."""
    out = []
    for i, line in enumerate(lines[:-1]):
        if i in noise or not line:
            continue
        m = _HYPHEN.search(line)
        if not m:
            continue
        j, skipped = i + 1, False
        while j < len(lines) and (j in noise or not lines[j].strip()):
            skipped = skipped or j in noise
            j += 1
        if j < len(lines) and (j == i + 1 or skipped):
            n = _START.match(lines[j].lstrip())
            if n:
                out.append((i, m.group(1), n.group(1), m.group(2)))
    return out


def _layout(common: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])

            def add(*row) -> None:
                for c, x in zip(cols, row):
                    c.append(x)

            for champ, cle, text, title in zip(d["champ"], d["cle"], d["texte"], d["titre"]):
                lines = text.split("\n")
                bubble = champ == "bulles.ocr"
                title = (furniture.plain_caps(title) if title else None) if bubble else furniture.title_of_file(title)
                noise = furniture_lines(lines, title, bubble)
                for i, kind in noise.items():
                    add(champ, cle, i, kind, None, None, None)
                if not _LATIN.search(text):
                    continue
                parted: dict[int, set[str]] = {}
                for i, left, right, sign in halves(lines, noise):
                    a, z = lookalikes.look(left).casefold(), lookalikes.look(right).casefold()
                    kind = "cesure" if sign in "¬" + chr(0xAD) else "cesure~" if right[0].islower() or left.isupper() else "cesure?"
                    add(champ, cle, i, kind, a + z, f"{a}-{z}", a)
                    # a half is no word of its own; only signs inside it show a misreading
                    for part in (*words_of(left), *words_of(right)):
                        if part.isalpha():
                            parted.setdefault(i, set()).add(part)
                for i, line in enumerate(lines):
                    if i not in noise and line and _LATIN.search(line):
                        rare = {w for w in words_of(line) if w not in common} - parted.get(i, set()) - parted.get(i - 1, set())
                        for w in rare:
                            add(champ, cle, i, "mot", w, None, None)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["champ", "cle", "ligne", "quoi", "mot", "compose", "gauche"])

    return run


def noise_rows(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, words): ``champ, cle, ligne, bruit, mot, juste`` of every noisy line, and the corrections."""
    words = materialise(vocabulary(texts))
    fixes = materialise(corrections(words))
    sure = words.where("propres >= 50 AND propres > bruites / 5").orderBy(F.desc("propres"), "mot").limit(COMMON)
    common = frozenset(r.mot for r in sure.join(fixes.select("mot"), "mot", "left_anti").select("mot").collect())
    noisy = texts.where("NOT propre AND texte IS NOT NULL AND texte <> ''").select("champ", F.col("cle").cast("bigint").alias("cle"), "texte", "titre")
    rows = materialise(spread(noisy).mapInArrow(_layout(common), "champ string, cle bigint, ligne int, quoi string, mot string, compose string, gauche string"))
    known = words.select("mot", (F.col("propres") + F.col("bruites")).alias("n"))
    glyphs = rows.where("quoi = 'mot'").join(fixes, "mot").select("champ", "cle", "ligne", F.lit("glyphe").alias("bruit"), "mot", "juste")
    # Without evidence for either spelling a hyphen parts a word, unless its first half is known to stand alone.
    total = words.agg(F.sum("propres")).first()[0] or 0
    alone = words.where(F.col("propres") >= STANDS_ALONE * total).select(F.col("mot").alias("gauche"), F.lit(True).alias("seul"))
    cuts = rows.where("quoi like 'cesure%'")
    cuts = cuts.join(known.select(F.col("mot"), F.col("n").alias("n_joint")), "mot", "left").join(known.select(F.col("mot").alias("compose"), F.col("n").alias("n_compose")), "compose", "left").join(alone, "gauche", "left")
    joined, compound = F.coalesce("n_joint", F.lit(0)), F.coalesce("n_compose", F.lit(0))
    by_form = (F.col("quoi") == "cesure") | ((F.col("quoi") == "cesure~") & F.col("seul").isNull())
    cuts = cuts.where((joined > compound) | ((joined == compound) & by_form)).select("champ", "cle", "ligne", F.lit("cesure").alias("bruit"), "mot", F.lit(None).cast("string").alias("juste"))
    edges = rows.where("quoi IN ('entete', 'folio')").select("champ", "cle", "ligne", F.col("quoi").alias("bruit"), "mot", F.lit(None).cast("string").alias("juste"))
    return edges.unionByName(cuts).unionByName(glyphs), fixes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_rows(scan_texts(spark, sf_dir))[0].select("champ", "cle", "ligne", "bruit").distinct()


def repair(text: str, noise: dict[int, set[str]], fixes: dict[int, dict[str, str]]) -> str:
    """Continuous paragraphs: furniture out, halves joined, misread words put right, lines unwrapped."""
    lines = text.split("\n")
    kept: list[tuple[str, bool]] = []
    gap = False
    for i, line in enumerate(lines):
        kinds = noise.get(i, set())
        if kinds & {"entete", "folio"}:
            gap = True
            continue
        if not line.strip():
            # a blank line beside furniture belongs to the page, not to the text
            if kept and not gap and not (i + 1 < len(lines) and noise.get(i + 1, set()) & {"entete", "folio"}):
                kept.append(("", False))
            continue
        gap = False
        for wrong, right in fixes.get(i, {}).items():
            line = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", lambda m: right.upper() if m.group().isupper() else right.capitalize() if m.group()[:1].isupper() else right, line, flags=re.I)
        kept.append((line.strip(), "cesure" in kinds))
    out: list[str] = []
    parted = new = False
    for line, cut in kept:
        if not line:
            new, parted = True, False
            continue
        line = re.sub(r"[-‐‑¬" + chr(0xAD) + r"]\s*$", "", line) if cut else line
        if not out or (new and not parted):
            out.append(line)
        else:
            wide = re.search("[ぁ-ヿ一-鿿、。」！？]$", out[-1])
            out[-1] += line if parted or wide or out[-1].endswith("-") else " " + line
        new, parted = False, cut
    return "\n\n".join(out)


def repaired_texts(texts: DataFrame) -> DataFrame:
    """``champ, cle, texte``: every non-null noisy text in continuous paragraphs."""
    found, _ = noise_rows(texts)
    per = found.groupBy("champ", "cle").agg(F.collect_set(F.struct("ligne", "bruit", "mot", "juste")).alias("bruits"))
    rows = texts.where("NOT propre AND texte IS NOT NULL").select("champ", F.col("cle").cast("bigint").alias("cle"), "texte").join(per, ["champ", "cle"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                noise: dict[int, set[str]] = {}
                fixes: dict[int, dict[str, str]] = {}
                for x in found or []:
                    noise.setdefault(x["ligne"], set()).add(x["bruit"])
                    if x["bruit"] == "glyphe" and x["juste"]:
                        fixes.setdefault(x["ligne"], {})[x["mot"]] = x["juste"]
                out.append(repair(text, noise, fixes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["champ", "cle", "texte"])

    return rows.select("champ", "cle", "texte", "bruits").mapInArrow(run, "champ string, cle bigint, texte string")


def p4_textes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_texts(scan_texts(spark, sf_dir))
