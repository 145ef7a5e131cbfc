"""Problem 6: one consistent form for text that looks the same but holds different characters.

Method: the vocabulary is every token of the values, with its frequency: of the values written in plain characters
(those spellings are plain) and of the others.  Each odd token traverses a trie of the vocabulary with a weighted edit
automaton, in which look-alike units cost nothing and ignorable characters cost nothing to skip (any other edit costs
1, over the budget of 0).  Of the spellings reached the plain one is canonical, else the most frequent one (ties by code
point) as the table writes it.  The walk alone brings look-alike letters together; the table (compatibility forms, kinds of blank and of
apostrophe) normalises what reaches no spelling and the signs between tokens.  Trie and tokens are dealt out by their
look (the units' classes), which every zero-cost path keeps, so a shard sees all spellings of its looks; there are as
many shards as the counted vocabulary needs, and no vocabulary is broadcast.

Tokens are runs of one kind of letter, and the kind is that of the look, so values that look the same
fall into the same tokens (signs shared by both kana belong to their neighbours).  Of all tokens with one look at most one is plain: a kanji that looks like a kana
is plain only where it stands alone, and such a kana only beside another one.  So a plain value is its own
form, and only odd values need work.

Looks the same: half-width, full-width and plain forms, composed and combined accents, ligatures, zero-width
characters, kinds of blank, apostrophe and hyphen, an ellipsis and three dots, letters of other scripts, blanks
at the end.  Does not: case, line breaks, name separators, misread letters.

Defined results: a null value has no form and is in no pair; an empty or blank value has the form ''.
Rows with a null ``oeuvre`` (or ``tome``) are in no pair.  Two entries that share an identical term compare
equal as they stand and are no pair, whatever else they hold.  Whole values are used, however long.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.session import materialise, spread, table

#: Spellings per trie.
SHARD_TOKENS = 20_000

#: Characters and the plain ones they look like, Cyrillic, Greek and kanji in turn.
_LIKE = dict(
    zip("аеёіорсухѕјһԁӏкԛѡАВЕЁІКМНОРСТУХЅЈԌ", "aeëiopcyxsjhdlkqwABEËIKMHOPCTYXSJG")
) | dict(zip("οανικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavikABEZHIKMNOPTYX")) | dict(zip("口力一二八工夕卜", "ロカーニハエタト"))
_HYPHENS = "".join(map(chr, (0x2010, 0x2011, 0xFE63, 0xFF0D)))
_APOSTROPHES = "".join(map(chr, (0x2018, 0x2019, 0x201B, 0x02BC, 0x02B9, 0x2032, 0x00B4, 0x0060, 0xFF07, 0xA78C)))
_BLANKS = "".join(map(chr, (0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x2800, 0x3164)))
_IGNORABLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10))))
_DROP = frozenset(_IGNORABLE)
_SIGNS = {c: "-" for c in _HYPHENS} | {c: "'" for c in _APOSTROPHES} | {c: " " for c in _BLANKS}
_CLASS = _LIKE | _SIGNS
_AMBIGUOUS = "".join(c for c in _LIKE if ord(c) > 0x3000)
#: Hiragana and the katakana they look like; which of the two is meant shows in the neighbours.
_EITHER_HIRA, _EITHER_KANA = "りへべぺ", "リヘベペ"
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x3099, 0x309A)))
_ALIKE_KANA = "".join(_LIKE[c] for c in _AMBIGUOUS)
_KANA = "".join((chr(0x30A1), "-", chr(0x30FA), chr(0x30FC)))
_HIRA = chr(0x3041) + "-" + chr(0x3096)
_HAN = chr(0x4E00) + "-" + chr(0x9FFF) + chr(0x3005)
_WIDE_SIGNS = "".join(map(chr, (0xFF1F, 0xFF01, 0xFF1D)))
_WIDE = _KANA + _HIRA + _HAN + "".join(map(chr, (0x3001, 0x3002, 0x300D, 0x300F, 0x30FB)))


#: Values of these characters only, and without the patterns below, are plain.
_PLAIN = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x0A, 0x0A), (0x20, 0x2C), (0x2E, 0x5A), (0x61, 0x7E), (0xA1, 0xA1), (0xAB, 0xAB), (0xBB, 0xBB), (0xBF, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x152, 0x153), (0x178, 0x178), (0x2014, 0x2015), (0x201C, 0x201D), (0x2026, 0x2026), (0x3001, 0x3002), (0x3005, 0x3005), (0x300C, 0x300F), (0x3041, 0x3096), (0x30A1, 0x30FC), (0x4E00, 0x9FFF), (0xFF01, 0xFF01), (0xFF1D, 0xFF1D), (0xFF1F, 0xFF1F))) + r"_\-\[\]\\"
_ODD = re.compile("|".join((
    f"[^{_PLAIN}]", f"[{_KANA}][{_AMBIGUOUS}]", f"[{_AMBIGUOUS}][{_KANA}{_AMBIGUOUS}]", f"(?<![{_KANA}])[{_ALIKE_KANA}](?![{_KANA}])",
    f"[{_KANA}{_AMBIGUOUS}][{_EITHER_HIRA}]", f"[{_EITHER_HIRA}][{_KANA}{_AMBIGUOUS}]", f"(?<![{_KANA}{_AMBIGUOUS}])[{_EITHER_KANA}]+(?![{_KANA}{_AMBIGUOUS}])",
    "[.][.][.]", r"\s\Z", f"(?<=[{_WIDE}])[?!=]", f"(?<![{_WIDE}{_WIDE_SIGNS}])[{_WIDE_SIGNS}]", f"[?!=][{_WIDE_SIGNS}]|[{_WIDE_SIGNS}][?!=]",
)))
_RUNS = f"[{_KANA}{_AMBIGUOUS}]+|[{_HIRA}]+|(?:(?![{_AMBIGUOUS}])[{_HAN}])+"
_FREE = _MARKS + _IGNORABLE
#: Signs and blanks are never part of a token, though some count as letters.
_APART = "".join(map(re.escape, _SIGNS))
_WORDS = re.compile(_RUNS + f"|(?:(?![{_KANA}{_HIRA}{_HAN}{_APART}])[^{chr(92)}W_])+")
#: The same runs in any dress: what looks like kana counts as kana, marks and ignorables go with their run.
_HALF = chr(0xFF66) + "-" + chr(0xFF9F)
_TOKEN = re.compile(f"[{_KANA}{_AMBIGUOUS}{_HALF}{_FREE}]*[{_KANA}{_AMBIGUOUS}{_HALF}][{_KANA}{_AMBIGUOUS}{_HALF}{_FREE}]*|[{_HIRA}{_FREE}]*[{_HIRA}][{_HIRA}{_FREE}]*|[{_FREE}]*(?:(?![{_AMBIGUOUS}])[{_HAN}][{_FREE}]*)+|[{_FREE}]*(?:(?![{_KANA}{_HIRA}{_HAN}{_HALF}{_APART}])[^{chr(92)}W_][{_FREE}]*)+")


def units(text: str) -> list[str]:
    """The visible units of a text: compatibility parts, without ignorable characters."""
    out = []
    for ch in text:
        if ch in _DROP:
            continue
        out.extend(unicodedata.normalize("NFKD", _SIGNS.get(ch, ch)))
    return out


def look(text: str) -> str:
    """The class of every unit: equal for texts that look the same (up to case, which is kept)."""
    return unicodedata.normalize("NFC", "".join(_CLASS.get(u, u) for u in units(text)))


def by_table(text: str) -> str:
    """Compatibility parts put together, plain signs, no ignorables; letters of other scripts stay what they are."""
    return unicodedata.normalize("NFC", "".join(units(text)))


class LookTrie:
    """Vocabulary trie over units, walked by a weighted edit automaton."""

    def __init__(self, words: list[tuple[str, int]], budget: int = 0):
        self.budget = budget
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for u in units(word):
                node = node.setdefault(u, {})
            node.setdefault(None, []).append((word, n))

    def reach(self, token: str) -> list[tuple[str, int]]:
        """Spellings within the budget of ``token``: look-alike units and ignorables are free."""
        states = self._open({id(self.root): (self.root, 0)})
        for u in units(token):
            kind, after = _CLASS.get(u, u), {}
            for node, cost in states.values():
                for edge, child in node.items():
                    if edge is None:
                        continue
                    c = cost + (_CLASS.get(edge, edge) != kind)
                    if c <= self.budget and c < after.get(id(child), (None, c + 1))[1]:
                        after[id(child)] = (child, c)
                if cost < self.budget and cost + 1 < after.get(id(node), (None, cost + 2))[1]:
                    after[id(node)] = (node, cost + 1)
            states = self._open(after)
            if not states:
                return []
        best = min((cost for node, cost in states.values() if None in node), default=None)
        return [w for node, cost in states.values() if cost == best for w in node.get(None, [])]

    def _open(self, states: dict) -> dict:
        """Insertions: edges taken without input, at cost 1 each."""
        todo = [x for x in states.values() if x[1] < self.budget]
        while todo:
            node, cost = todo.pop()
            for edge, child in node.items():
                if edge is not None and cost + 1 < states.get(id(child), (None, cost + 2))[1]:
                    states[id(child)] = (child, cost + 1)
                    if cost + 1 < self.budget:
                        todo.append((child, cost + 1))
        return states


_WIDEN = str.maketrans(chr(0xFF98) + chr(0xFF8D), _EITHER_KANA[:2])
_TO_KANA, _TO_HIRA = str.maketrans(_EITHER_HIRA, _EITHER_KANA), str.maketrans(_EITHER_KANA, _EITHER_HIRA)
_EITHER = re.compile(f"[{_FREE}]*(?:[{_EITHER_HIRA}{_EITHER_KANA}][{_FREE}]*)+")
_KANA_LOOK = re.compile(f"[{_KANA}{_HALF}{_AMBIGUOUS}]")


def _by_neighbours(text: str) -> str:
    """Signs that are one in both kana: katakana beside (what looks like) katakana, else hiragana."""

    def put(m: re.Match) -> str:
        beside = text[max(m.start() - 1, 0) : m.start()] + text[m.end() : m.end() + 1]
        return m.group().translate(_TO_KANA if _KANA_LOOK.search(beside) else _TO_HIRA)

    return _EITHER.sub(put, text)


def _is_plain(token: str) -> bool:
    """Is this token of an odd value the plain spelling of its look?"""
    if look(token) == token:
        return not (len(token) == 1 and token in _ALIKE_KANA)
    return len(token) == 1 and token in _AMBIGUOUS


def _ending(form: str) -> str:
    """Dots, signs and blanks that depend on what stands beside them."""
    form = form.replace("...", chr(0x2026)).rstrip()
    wide = str.maketrans("?!=", _WIDE_SIGNS)
    return re.sub("[?!=" + _WIDE_SIGNS + "]+", lambda m: m.group().translate(wide if m.start() and re.match(f"[{_WIDE}]", form[m.start() - 1]) else {ord(w): n for w, n in zip(_WIDE_SIGNS, "?!=")}), form)


def _shard(vocabulary: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
    if not len(tokens):
        return pd.DataFrame({"token": [], "form": []}, dtype=object)
    plain = set(vocabulary["token"])
    trie = LookTrie([*zip(vocabulary["token"], vocabulary["n"]), *((t, n) for t, n in zip(tokens["token"], tokens["n"]) if t not in plain)])
    out = []
    for t in tokens["token"]:
        found = trie.reach(t)
        best = min(found, key=lambda x: (x[0] not in plain, -x[1], x[0]))[0] if found else t
        out.append(best if best in plain else by_table(best))
    return pd.DataFrame({"token": list(tokens["token"]), "form": out}, dtype=object)


def _cut(text: str, seen: Counter) -> tuple[list[str], list[int], list[str], list[str]]:
    """Segments of an odd value; places, spellings and looks of its odd tokens.  Its plain ones count as ``seen``."""
    segments, at, tokens, looks = [], [], [], []
    done, text = 0, _by_neighbours(text.translate(_WIDEN))
    for m in _TOKEN.finditer(text):
        if m.start() > done:
            segments.append(by_table(text[done : m.start()]))
        word, done = m.group(), m.end()
        if _is_plain(word):
            seen[word] += 1
            segments.append(word)
        else:
            at.append(len(segments))
            tokens.append(word)
            looks.append(look(word))
            segments.append(by_table(word))
    if done < len(text):
        segments.append(by_table(text[done:]))
    return segments, at, tokens, looks


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the values (the last column): plain rows lose their text, odd ones are cut into
    tokens, and one row a batch without a key has the words of the plain values with their counts."""
    odd_in, words = _ODD.search, _WORDS.findall
    text = pa.list_(pa.string())
    for b in batches:
        values = b.column(b.num_columns - 1).to_pylist()
        seen: Counter = Counter()
        texts, cols = [], ([], [], [], [])
        for t in values:
            if odd_in(t):
                texts.append(t)
                for c, x in zip(cols, _cut(t, seen)):
                    c.append(x)
            else:
                seen.update(words(t))
                texts.append(None)
                for c in cols:
                    c.append(None)
        texts.append(None)
        for c, x in zip(cols, (None, list(seen.values()), list(seen), None)):
            c.append(x)
        keep = [pa.concat_arrays([x, pa.nulls(1, x.type)]) for x in b.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), *(pa.array(c, k) for c, k in zip(cols, (text, pa.list_(pa.int32()), text, text)))], names=[*b.schema.names[:-1], "text", "segments", "at", "tokens", "looks"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_ending(x) for x in b.column(1).to_pylist()], pa.string())], names=["k", "form"])


def consistent_forms(rows: DataFrame, key: str, text: str, keep: list[str] = (), shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(odd, plain): ``k, *keep, text, form`` of the odd rows, ``k, *keep`` of the plain ones.

    A plain row's value is its own form.  ``k`` names a row's key and value (repeated rows share it); rows whose
    key or value is null are in neither.  ``keep`` must not hold the names k, text, form, segments, at, tokens
    or looks.
    """
    value = F.col(text).cast("string")
    rows = rows.where(F.col(key).isNotNull() & value.isNotNull()).select(F.concat_ws("#", F.col(key).cast("string"), F.xxhash64(value).cast("string")).alias("k"), *keep, value.alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    seen = materialise(spread(rows).mapInArrow(_survey, f"{kinds}, segments array<string>, at array<int>, tokens array<string>, looks array<string>"))
    cut = seen.where("text IS NOT NULL")

    found = cut.select("k", F.explode(F.arrays_zip("at", "tokens", "looks")).alias("x")).select("k", "x.at", F.col("x.tokens").alias("token"), F.col("x.looks").alias("look"))
    tokens = found.groupBy("token", "look").agg(F.count("*").alias("n"))
    vocabulary = (
        seen.where("k IS NULL").select(F.explode(F.arrays_zip("at", "tokens")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.at").alias("n"))
        .where(~F.col("token").rlike(f"^[{_ALIKE_KANA}]$"))
        .groupBy("token").agg(F.sum("n").alias("n"))
        .withColumn("look", F.translate("token", _AMBIGUOUS, _ALIKE_KANA))
    )
    tokens, vocabulary = materialise(tokens), materialise(vocabulary)
    shards = shards or max(8, -(-(tokens.count() + vocabulary.count()) // SHARD_TOKENS))
    shard = F.pmod(F.xxhash64("look"), F.lit(shards)).cast("int").alias("shard")
    forms = (
        vocabulary.select(shard, "token", "n").groupBy("shard")
        .cogroup(tokens.select(shard, "token", "n").groupBy("shard"))
        .applyInPandas(_shard, "token string, form string")
    )
    words = found.join(forms, "token").groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("at", "form"))).alias("forms"))
    whole = F.concat_ws("", F.transform("segments", lambda x, i: F.coalesce(F.try_element_at("forms", i), x)))
    done = cut.select("k", "segments").dropDuplicates(["k"]).join(words, "k", "left").select("k", whole.alias("form")).mapInArrow(_finish, "k string, form string")
    return cut.select("k", *keep, "text").join(done, "k"), seen.where("text IS NULL AND k IS NOT NULL").select("k", *keep)


def same_look_pairs(rows: DataFrame, key: str, cle: str, group: list[str], text: str) -> DataFrame:
    """``cle_a, cle_b`` of rows of one group whose values have one form but differ in characters.

    ``key`` tells rows apart, ``cle`` is what a pair names (one ``cle`` may have several values).  Forms
    are compared by two 64-bit hashes, so the joins carry numbers, not texts.
    """
    rows = rows.where(" AND ".join(f"{g} IS NOT NULL" for g in [*group, text]))
    value = F.col(text).cast("string")
    by = [F.col(c) for c in group]
    rows = rows.select(F.col(key).alias("cle_"), F.col(cle).alias("cle"), *(F.col(g).alias(f"g{i}") for i, g in enumerate(group)), F.xxhash64(F.lit(1), *by, value).alias("h"), F.xxhash64(F.lit(2), *by, value).alias("i"), F.xxhash64(value).alias("t"), value.alias("texte_"))
    names = [f"g{i}" for i in range(len(group))]
    odd, plain = consistent_forms(rows, "cle_", "texte_", ["cle", *names, "h", "i", "t"])
    form = [F.col(c) for c in (*names, "form")]
    a = materialise(odd.select(F.xxhash64(F.lit(1), *form).alias("h"), F.xxhash64(F.lit(2), *form).alias("i"), "cle", "t"))
    b = a.unionByName(plain.select("h", "i", "cle", "t"))
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.cle") != F.col("b.cle")) & (F.col("a.t") != F.col("b.t")))
    return pairs.select(F.least("a.cle", "b.cle").alias("cle_a"), F.greatest("a.cle", "b.cle").alias("cle_b")).distinct()


def without_shared(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs whose two keys (``cle``) have no identical value: those that have one compare equal as they stand."""
    held = values.where("texte IS NOT NULL").groupBy("cle").agg(F.collect_set(F.xxhash64("texte")).alias("h"))
    a, b = held.select(F.col("cle").alias("cle_a"), F.col("h").alias("ha")), held.select(F.col("cle").alias("cle_b"), F.col("h").alias("hb"))
    return pairs.join(a, "cle_a").join(b, "cle_b").where("NOT arrays_overlap(ha, hb)").select("cle_a", "cle_b")


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bubbles = table(spark, sf_dir, "bulles").select("bulle_id", "oeuvre", "tome", F.col("ocr").alias("texte"))
    entries = table(spark, sf_dir, "personnages").select("entree_id", "oeuvre", F.posexplode("termes_source").alias("rang", "texte"))
    return bubbles, entries


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bubbles, entries = _values(spark, sf_dir)
    a = same_look_pairs(bubbles, "bulle_id", "bulle_id", ["oeuvre", "tome"], "texte").select(F.lit("bulles.ocr").alias("champ"), "cle_a", "cle_b")
    entries = entries.withColumn("k", F.concat_ws("-", "entree_id", "rang"))
    b = same_look_pairs(entries, "k", "entree_id", ["oeuvre"], "texte")
    return a.unionByName(without_shared(b, entries.select(F.col("entree_id").alias("cle"), "texte")).select(F.lit("personnages.termes_source").alias("champ"), "cle_a", "cle_b"))


def value_forms(bubbles: DataFrame, entries: DataFrame) -> DataFrame:
    """``champ, cle, rang, forme``: every value in its consistent form; null stays null.  ``rang`` is the place of a
    term in its entry's list, null for bubbles.  Each field has the words of its own plain values as vocabulary."""
    rows = entries.withColumn("cle", F.concat_ws("-", "entree_id", "rang"))

    def formed(values: DataFrame, key: str) -> DataFrame:
        odd, _ = consistent_forms(values, key, "texte", [key])
        return values.join(odd.select(key, F.col("text").alias("texte"), "form").distinct(), [key, "texte"], "left")

    a = formed(bubbles, "bulle_id").select(F.lit("bulles.ocr").alias("champ"), F.col("bulle_id").alias("cle"), F.lit(None).cast("int").alias("rang"), F.coalesce("form", "texte").alias("forme"))
    b = formed(rows, "cle").select(F.lit("personnages.termes_source").alias("champ"), F.col("entree_id").alias("cle"), "rang", F.coalesce("form", "texte").alias("forme"))
    return a.unionByName(b)


def p6_formes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of ``bulles.ocr`` and of ``personnages.termes_source`` in its consistent form."""
    return value_forms(*_values(spark, sf_dir))
