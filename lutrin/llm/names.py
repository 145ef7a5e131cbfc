"""Problem 2: link the entries of one work that stand for the same character.

Method: a symmetric-delete neighbourhood index over the distinct tokens of a work's names (and of its source
spellings) finds those within one edit; entries that hold equal or neighbouring tokens are candidates.  A token two
edits away counts only beside an equal one (``name_score``), which makes the pair a candidate by itself, so one
deletion is enough.  A candidate pair's tokens, however many, are aligned by optimal assignment, in which a token
may be misspelt, reduced to its initial, abbreviated, or a nickname, and titles count for nothing.  Source
spellings are compared in their consistent form (problem 6).  Sure pairs form cores (connected components by
label propagation); an entry with no sure pair joins the one core it fits best,
if nothing in the core rules it out and no other core fits as well.

The entries of a frequent token are dealt out in parts of ``PART``, and every two parts meet in a group of their own.
Entries that say the same are one representative; pairs are expanded at the end.  A mark of generation in the
name or the source tells namesakes apart, different full source spellings tell close names apart.

Defined results: entries with a null ``oeuvre`` or key are in no pair; an entry with neither name, variant
nor source spelling is in no pair.  Null lists are empty lists.  Of rows that repeat a key the least counts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm import lookalikes
from lutrin.session import materialise, one_per_key, spread, table

SURE, LIKELY, MARGIN = 0.9, 0.55, 0.04
PART = 256
#: Words before or after a name that are not part of it.
_TITLES = frozenset(
    "capitaine capt captain cap capitan dame maitre me sergent sgt sergeant sargento docteur dr doctor dra madame mme mrs ms miss monsieur mr sir lord lady prince princesse princess roi reine king queen comte comtesse count general gen colonel col lieutenant lt teniente professeur prof professor pr frere soeur pere mere oncle tante baron baronne duc duchesse commandant cdt commander inspecteur señor senor señora senora sr sra don doña dona master mister maestro maestra".split()
)
_JA_TITLES = frozenset(("先生", "隊長", "ドクター", "博士", "船長", "団長", "教授", "殿", "様", "さん", "王", "女王", "姫", "陛下", "殿下", "少佐", "大佐", "軍曹", "マスター", "キャプテン", "ボス", "師匠", "卿", "夫人", "旦那", "社長", "委員長", "先輩", "兄", "姉"))
_GENERATIONS = (
    (re.compile(r"\b(?:le jeune|the younger|el joven|junior|jr|fils|hijo|cadet|le cadet)\b\.?"), "j"),
    (re.compile(r"\b(?:l['’ ]?ancien|l['’ ]?aine|le vieux|the elder|el viejo|senior|pere|padre)\b\.?"), "a"),
    (re.compile(r"(?<=\s)(?:ii|2nd|2e|le second|the second)$"), "2"),
    (re.compile(r"(?<=\s)(?:iii|3rd|3e|le troisieme)$"), "3"),
)
_JA_GENERATION = re.compile("([二ニ三四]|[2-4])世$|(?:ジュニア|シニア)$")
_NICK = re.compile("[bcdfglmnrt]?(?:ie|y|o|ou|ette|us|i|a|ine|ot|on|e|et|otte|is)")
#: Spellings of one sound, in the order they are put right.
_SOUNDS = tuple(x.split(">") for x in "ph>f qu>k ck>k c>k q>k l>r w>v v>b z>s y>i ei>e ai>e ou>u oo>u ee>e h>".split())
_KANA_SOUNDS = tuple(x.split(">") for x in "ヴァ>バ ヴィ>ビ ヴェ>ベ ヴォ>ボ ヴ>ブ ウェ>エ ウィ>イ ウォ>オ ファ>ハ フィ>ヒ フェ>ヘ フォ>ホ ティ>チ ディ>ジ ドゥ>ド トゥ>ト ー> ッ> ・>".split())
_SEPARATORS = re.compile("[・＝=\\s／/&,、·‧•-]+")


def fold(text: str) -> str:
    """Lower case without accents, in plain characters."""
    text = unicodedata.normalize("NFKD", lookalikes.look(text)).casefold()
    return "".join(c for c in text if not unicodedata.combining(c))


def parse_name(name: str | None) -> tuple[list[str], str, bool] | None:
    """(tokens, given first; mark of generation; was there a title), or None for no name."""
    if not name or not name.strip():
        return None
    text, generation = " ".join(fold(name).split()), ""
    for pattern, mark in _GENERATIONS:
        found = pattern.search(text)
        if found and found.start() > 0:
            generation, text = mark, (text[: found.start()] + " " + text[found.end() :]).strip()
            break
    if "," in text:
        family, given = text.split(",", 1)
        text = f"{given} {family}"
    tokens = [t.strip(".'’-") for t in re.split(r"[\s._]+|(?<=\w)-(?=\w)", text) if t.strip(".'’-")]
    rest = [t for t in tokens if t not in _TITLES or (len(t) == 1)]
    title = len(rest) < len(tokens)
    return (rest, generation, title) if rest else None


def parse_source(term: str | None) -> tuple[list[str], str] | None:
    """(parts, mark of generation) of a source spelling in its consistent form; None for titles."""
    if not term:
        return None
    text = lookalikes.look(term).strip()
    found = _JA_GENERATION.search(text)
    if found:
        text = text[: found.start()]
    parts = [p for p in _SEPARATORS.split(text) if p and p not in _JA_TITLES]
    if not parts or (len(parts) == 1 and not re.search("[ァ-ヺ]", parts[0]) and not found):
        return None
    return parts, "x" if found else ""


def parse_entry(name: str | None, variants: list | None, terms: list | None) -> dict:
    """What an entry says: name forms, full and partial source spellings, mark of generation."""
    forms, generation = [], ""
    for n in [name, *(variants or [])]:
        p = parse_name(n)
        if p:
            generation = generation or p[1]
            if [p[0], p[2]] not in forms:
                forms.append([p[0], p[2]])
    full, parts = [], []
    for t in terms or []:
        p = parse_source(t)
        if p:
            generation = generation or p[1]
            (full if len(p[0]) > 1 else parts).append(p[0])
    own = parse_name(name)
    return {"f": forms, "n": own[0] if own else [], "s": full, "p": [x[0] for x in parts], "g": generation}


@lru_cache(maxsize=50_000)
def sound(token: str) -> str:
    """A rough key of how a name sounds: spellings that are taken for each other fall together."""
    for a, b in _SOUNDS:
        token = token.replace(a, b)
    token = re.sub(r"(.)\1+", r"\1", token)
    return token[:-1] if len(token) > 3 and token[-1] == "e" else token


@lru_cache(maxsize=50_000)
def kana_sound(term: str) -> str:
    for a, b in _KANA_SOUNDS:
        term = term.replace(a, b)
    return term


def deletes(token: str) -> set[str]:
    """The token and what is left after losing any one character."""
    return {token} | {token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) > 3 else {token}


def anchors_of(e: dict) -> set[str]:
    """What an entry is found by: tokens (``t``), names of one token (``m``), first tokens of others (``v``), source spellings (``s``, whole ``w``)."""
    out: set[str] = set()
    for tokens, _ in e["f"]:
        out |= {"t" + t for t in tokens if len(t) > 2 or len(tokens) == 1}
        if len(tokens) == 1:
            out.add("m" + tokens[0])
        else:
            out.add("v" + tokens[0])
    for parts in e["s"]:
        out |= {"w" + "".join(parts)} | {"s" + p for p in parts}
    return out | {"w" + p for p in e["p"]}


def keys_of(anchor: str) -> set[str]:
    """Keys of an anchor's neighbourhood: two anchors that share one are compared."""
    kind, t = anchor[0], anchor[1:]
    if kind == "t":
        keys = {"t" + d for d in deletes(t)} | {"n" + t[:k] for k in (2, 3, 4) if len(t) > k}
        return keys | {"p" + sound(t)} if len(t) > 3 else keys
    # a short form (capital) meets the long forms (small) of its stem: N the tokens of any name, O names of one token
    short = {t[:k] for k in (2, 3, 4) if len(t) > k and _NICK.fullmatch(t[k:])} | {t[:4]}
    if kind == "m":
        return {"N" + x for x in short} | {"o" + t[:k] for k in (2, 3, 4) if len(t) > k}
    if kind == "v":
        return {"O" + x for x in short} | ({"n" + t} if len(t) < 3 else set())
    if kind == "w":
        return {"s" + d for d in deletes(t)} | {"q" + kana_sound(t)}
    return {"s" + t}


def neighbours(a: str, b: str) -> bool:
    """Are two anchors that share a key spellings of one thing?"""
    if a[0] in "sw":
        return True
    return token_score(a[1:], b[1:]) > (0.8 if a[0] == b[0] == "t" else 0)


@lru_cache(maxsize=50_000)
def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, at most 3."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return min(3, rows[-1][-1])


def one_lost(a: str, b: str) -> bool:
    """Is one the other without one sign?"""
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) != 1:
        return False
    i = next((k for k, c in enumerate(short) if c != long[k]), len(short))
    return short[i:] == long[i + 1 :]


def token_score(a: str, b: str) -> float:
    """1 the same, 0.85 misspelt, 0.5 an initial, 0.45 cut short, 0.4 a nickname, 0 different."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.5 if long.startswith(short) else 0.0
    d = edits(a, b)
    if len(short) >= 4 and (d == 1 or (d == 2 and len(short) >= 7)):
        return 0.85 if d == 1 else 0.7
    if len(short) >= 3 and long.startswith(short):
        return 0.45
    if len(short) >= 4:
        x, y = sound(a), sound(b)
        if x == y:
            return 0.85
        if min(len(x), len(y)) >= 4 and edits(x, y) == 1:
            return 0.7
    for k in (4, 3, 2):
        if len(short) > k and short[:k] == long[:k] and _NICK.fullmatch(short[k:]):
            return 0.4
    return 0.0


def assignment(gain: list[list[float]]) -> list[int]:
    """The column of every row so that the summed gain is greatest (rows <= columns), each column used once.

    Rows enter one after the other; each entering row searches the cheapest chain of exchanges to a free column over
    reduced costs, so the time grows with rows squared times columns.
    """
    n, m = len(gain), len(gain[0]) if gain else 0
    row_price, col_price = [0.0] * n, [0.0] * m
    owner: list[int] = [-1] * m
    for entering in range(n):
        dist, before, done = [float("inf")] * m, [-1] * m, [False] * m
        row, reached, at = entering, 0.0, -1
        while True:
            for j in range(m):
                if not done[j]:
                    d = reached - gain[row][j] - row_price[row] - col_price[j]
                    if d < dist[j] - 1e-12:
                        dist[j], before[j] = d, at
            at = min((j for j in range(m) if not done[j]), key=lambda j: dist[j])
            reached, done[at] = dist[at], True
            if owner[at] < 0:
                break
            row = owner[at]
        for j in range(m):
            if done[j]:
                if owner[j] >= 0:
                    row_price[owner[j]] += reached - dist[j]
                col_price[j] -= reached - dist[j]
        row_price[entering] += reached
        while at >= 0:
            owner[at] = entering if before[at] < 0 else owner[before[at]]
            at = before[at]
    return [owner.index(i) for i in range(n)]


def align(a: list[str], b: list[str]) -> tuple[float, list[float]]:
    """Optimal assignment of the shorter name's tokens to the longer's: (sum, scores)."""
    short, long = sorted((a, b), key=len)
    if not short:
        return -1.0, []
    scores = [[token_score(t, u) for u in long] for t in short]
    if len(long) <= 3:
        best = max((tuple(row[i] for row, i in zip(scores, chosen)) for chosen in permutations(range(len(long)), len(short))), key=sum)
    else:
        best = tuple(row[i] for row, i in zip(scores, assignment(scores)))
    return sum(best), list(best)


def name_score(a: list, b: list) -> float:
    """How far two name forms say the same: 0 different, up to 0.92 the same full name."""
    (x, tx), (y, ty) = a, b
    total, scores = align(x, y)
    if not scores or min(scores) == 0:
        return 0.0
    if len(x) >= 2 and len(y) >= 2:
        if len(x) != len(y):
            return 0.75 if min(scores) >= 0.85 else 0.0
        if min(scores) == 1:
            return 0.92
        if min(scores) >= 0.85:
            return 0.9 if scores.count(1.0) else 0.8
        if min(scores) >= 0.7:
            return 0.8 if 1.0 in scores else 0.0
        return 0.7 if max(scores) == 1 else 0.62 if max(scores) >= 0.85 else 0.0
    if len(x) == len(y) == 1:
        return {1.0: 0.9, 0.85: 0.72, 0.7: 0.5}.get(scores[0], 0.5 if scores[0] in (0.4, 0.45) else 0.0)
    # one token against a full name: a given name, a family name with a title, or a nickname
    one, many = (x, y) if len(x) == 1 else (y, x)
    first = token_score(one[0], many[0])
    if first == 1:
        return 0.7
    if first >= 0.85:
        return 0.62
    if first in (0.4, 0.45):
        return 0.58
    return 0.5 if scores[0] >= 0.85 and (tx if len(x) == 1 else ty) else 0.4 if scores[0] >= 0.85 else 0.0


def source_relation(a: dict, b: dict) -> tuple[str, float]:
    """same, near, part, none or diff."""
    fa, fb = a["s"], b["s"]
    wholes_a = {"".join(p) for p in fa} | {"".join(p[::-1]) for p in fa}
    wholes_b = {"".join(p) for p in fb} | {"".join(p[::-1]) for p in fb}
    pa_, pb = set(a["p"]), set(b["p"])
    if wholes_a & wholes_b or wholes_a & pb or wholes_b & pa_:
        return "same", 1.0
    single = lambda e: not e["s"] and e["p"] and all(len(t) == 1 for t, _ in e["f"])
    if pa_ & pb and (single(a) or single(b)) and not (fa and fb):
        return ("same", 1.0) if single(a) and single(b) else ("part", 0.8)
    # A source spelling varies in how a sound is written or by one lost sign; another sound is another name.
    one, two = (w | (p if not f else set()) for w, p, f in ((wholes_a, pa_, fa), (wholes_b, pb, fb)))
    one, two = one | {kana_sound(x) for x in one}, two | {kana_sound(x) for x in two}
    if any(len(x) >= 4 and (x == y or (len(x) >= 5 and one_lost(x, y))) for x in one for y in two):
        return "near", 0.9
    if fa and fb:
        return "diff", 0.0
    halves_a, halves_b = {x for p in fa for x in p}, {x for p in fb for x in p}
    if pa_ & halves_b or pb & halves_a or pa_ & pb:
        given = {p[0] for p in fa} & pb or {p[0] for p in fb} & pa_
        return "part", 0.7 if given else 0.5
    if (fa or pa_) and (fb or pb):
        return "diff", 0.0
    return "none", 0.0


CONFLICT = -1.0


def pair_score(a: dict, b: dict) -> float:
    """Likelihood that two entries stand for one character; ``CONFLICT`` where that is ruled out."""
    full = lambda e: bool(e["s"]) or any(len(t) > 1 for t, _ in e["f"])
    if a["g"] != b["g"]:
        if (not a["g"] or not b["g"]) and full(a) and full(b):
            return CONFLICT
        if a["g"] and b["g"] and "x" not in (a["g"], b["g"]):
            return CONFLICT
        if not (full(a) and full(b)):
            return 0.0 if a["g"] and b["g"] else min(0.56, _pair(a, b))
    return _pair(a, b)


def _pair(a: dict, b: dict) -> float:
    relation, strength = source_relation(a, b)
    name = max((name_score(x, y) for x in a["f"] for y in b["f"]), default=0.0)
    nameless = not a["f"] or not b["f"]
    if relation == "same":
        return 1.0
    # Two full names that don't agree are two persons, whatever nickname they share.
    whole = [name_score(x, y) for x in a["f"] for y in b["f"] if min(len(x[0]), len(y[0])) > 1]
    if whole and max(whole) == 0:
        return CONFLICT
    if relation == "near":
        return 0.95 if name >= 0.5 else 0.9 if nameless else 0.0
    if relation == "diff":
        return SURE if name >= 0.92 else CONFLICT
    if relation == "part":
        if nameless:
            return 0.62 if strength >= 0.7 else 0.4
        return min(0.97, name + (0.12 if strength >= 0.7 else 0.05)) if name else 0.0
    return name


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        parsed = [parse_entry(n, v, t) for n, v, t in zip(d["nom"], d["variantes"], d["termes"])]
        anchors = [sorted(anchors_of(e)) for e in parsed]
        said = [json.dumps(e, ensure_ascii=False, sort_keys=True) for e in parsed]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(anchors, pa.list_(pa.string()))], names=["entree", "oeuvre", "dit", "anchors"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sorted(keys_of(a)) for a in b.column("anchor").to_pylist()], pa.list_(pa.string()))], names=[*b.schema.names, "keys"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([neighbours(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_()))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = lru_cache(maxsize=16_384)(json.loads)
    for b in batches:
        s = [pair_score(read(x), read(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["a", "b", "score"])


def candidates(same: DataFrame) -> DataFrame:
    """``a, b`` (a < b): representatives (``id, oeuvre, anchors``) with equal or neighbouring anchors, repeats included."""
    held = materialise(same.select("id", "oeuvre", F.explode("anchors").alias("anchor")).select("id", "oeuvre", "anchor", F.xxhash64("oeuvre", "anchor").alias("k")))
    anchors = held.groupBy("k").agg(F.min("oeuvre").alias("oeuvre"), F.min("anchor").alias("anchor"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    anchors = materialise(spread(anchors).mapInArrow(_keys, "k bigint, oeuvre string, anchor string, parts int, keys array<string>"))
    keyed = anchors.select("k", "oeuvre", "anchor", "parts", F.explode("keys").alias("key"))
    form = F.substring("key", 1, 1)
    meets = F.when(form.isin("N", "O"), F.concat(F.lower(form), F.substring("key", 2, 99))).otherwise(F.col("key"))
    x = keyed.where(~form.isin("n", "o")).select("k", "anchor", "parts", F.xxhash64("oeuvre", meets).alias("j"), (~form.isin("N", "O")).alias("twice"))
    y = keyed.where(~form.isin("N", "O")).select("k", "anchor", "parts", F.xxhash64("oeuvre", "key").alias("j"))
    met = x.alias("x").join(y.alias("y"), (F.col("x.j") == F.col("y.j")) & ((F.col("x.k") < F.col("y.k")) | (~F.col("x.twice") & (F.col("x.k") != F.col("y.k")))))
    met = met.groupBy(F.col("x.k").alias("ka"), F.col("y.k").alias("kb")).agg(F.min("x.anchor").alias("va"), F.min("y.anchor").alias("vb"), F.min("x.parts").alias("pa"), F.min("y.parts").alias("pb"))
    near = met.mapInArrow(_near, "ka bigint, kb bigint, va string, vb string, pa int, pb int").select("ka", "kb", "pa", "pb")
    near = near.unionByName(anchors.select(F.col("k").alias("ka"), F.col("k").alias("kb"), F.col("parts").alias("pa"), F.col("parts").alias("pb")))
    # The entries of an anchor are dealt out in parts; two parts are one group of at most about PART * PART pairs.
    group = near.select("ka", "kb", "pa", "pb", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("ia")).select("ka", "kb", "pa", "pb", "ia", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("ib")).where("ka <> kb OR ia <= ib")
    group = materialise(group.withColumn("g", F.xxhash64("ka", "kb", "ia", "ib")))
    parts = anchors.select("k", "parts")
    member = held.select("id", "k").join(parts, "k").select("id", "k", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("i"))
    a = member.join(group.select(F.col("ka").alias("k"), F.col("ia").alias("i"), "g", (F.col("ka") == F.col("kb")).alias("own"), (F.col("ia") == F.col("ib")).alias("level")), ["k", "i"]).select("g", F.col("id").alias("a"), (F.col("own") & F.col("level")).alias("once"))
    b = member.join(group.select(F.col("kb").alias("k"), F.col("ib").alias("i"), "g"), ["k", "i"]).select("g", F.col("id").alias("b"))
    return a.join(b, "g").where("a < b OR (a > b AND NOT once)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, core``: the least id each node is connected to (label propagation with pointer jumps, until none moves)."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(nodes.select("id", F.col("id").alias("core")))
    while True:
        offered = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("core").alias("offer"))
        joined = labels.join(offered, labels.id == offered.a, "left")
        step = joined.select("id", F.least("core", F.coalesce("offer", "core")).alias("new"), "core")
        # a node follows the label of its label, which halves long chains
        jump = step.select(F.col("id").alias("j"), F.col("new").alias("to"))
        step = materialise(step.join(jump, step.new == jump.j, "left").select("id", F.least("new", F.coalesce("to", "new")).alias("core"), F.col("core").alias("old")))
        labels = step.select("id", "core")
        if step.where("core <> old").isEmpty():
            return labels


def same_characters(entries: DataFrame) -> DataFrame:
    """``oeuvre, entree, perso``: every usable entry and its character (the least key in it)."""
    rows = entries.where("oeuvre IS NOT NULL AND entree_id IS NOT NULL").select(F.col("entree_id").cast("bigint").alias("entree"), "oeuvre", "nom", "variantes", F.col("termes_source").alias("termes"))
    rows = one_per_key(rows, "entree")
    read = materialise(spread(rows).mapInArrow(_index, "entree bigint, oeuvre string, dit string, anchors array<string>").where("size(anchors) > 0"))
    same = materialise(read.groupBy("oeuvre", "dit").agg(F.min("entree").alias("id"), F.min("anchors").alias("anchors")))
    pairs = candidates(same).distinct()
    said = same.select("id", "dit")
    scored = pairs.join(said.select(F.col("id").alias("a"), F.col("dit").alias("da")), "a").join(said.select(F.col("id").alias("b"), F.col("dit").alias("db")), "b").select("a", "b", "da", "db")
    scored = materialise(scored.mapInArrow(_score, "a bigint, b bigint, score double").where(f"score >= {LIKELY} OR score = {CONFLICT}"))

    cores = components(same.select("id"), scored.where(f"score >= {SURE}"))
    # An entry alone in its core joins the core it fits best, if no other fits as well.
    sizes = cores.groupBy("core").agg(F.count("*").alias("n"))
    placed = materialise(cores.join(sizes, "core"))
    either = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    fits = (
        either.join(placed.where("n = 1").select(F.col("id").alias("a")), "a")
        .join(placed.select(F.col("id").alias("b"), "core", "n"), "b")
        .groupBy("a", "core").agg(F.max("score").alias("score"), F.min("score").alias("moins"))
        .where(f"moins > {CONFLICT}")
    )
    best = fits.groupBy("a").agg(F.max(F.struct("score", F.negative("core").alias("m"))).alias("top"), F.sort_array(F.collect_list("score"), asc=False).alias("all"))
    chosen = best.where((F.size("all") == 1) | (F.col("top.score") - F.element_at("all", 2) >= MARGIN)).select("a", F.negative("top.m").alias("b"))
    joined = components(same.select("id"), scored.where(f"score >= {SURE}").select("a", "b").unionByName(chosen))
    ids = same.select("oeuvre", "dit", "id").join(joined, "id")
    return read.select("oeuvre", "dit", "entree").join(ids, ["oeuvre", "dit"]).select("oeuvre", "entree", F.col("core").alias("perso"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = materialise(same_characters(table(spark, sf_dir, "personnages")))
    a, b = one.alias("a"), one.alias("b")
    return a.join(b, (F.col("a.perso") == F.col("b.perso")) & (F.col("a.entree") < F.col("b.entree"))).select(F.col("a.entree").alias("entree_a"), F.col("b.entree").alias("entree_b"))


def p2_personnages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with the character it stands for."""
    return same_characters(table(spark, sf_dir, "personnages"))
