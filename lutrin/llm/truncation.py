"""Problem 1: texts that were cut off before their end, and how often each source cuts.

Method: intact values (a bounded sample by hashed key, ``SAMPLE`` per field) are cut artificially, at
random places and at the limits the sources show, with and without debris, to make positives; a logistic
regression over hashed features of the closing characters and words, the punctuation of both sides and
the length against the source's limit is fitted on them and scores every record.  An exact check of what the model
takes for cut follows: a bubble that ends with a stop, is empty, a placeholder or the source text given back is not a
cut one, nor is what ends otherwise than inside a sentence without debris; a line whose own source has no final stop
either counts only where the length against the limit or debris shows it, or where the model is sure
(``UNFINISHED``) that it stops inside a word or phrase.  Debris after a closed sentence is a case by itself.

The limits are statistics over all data: for every source the largest length in characters and in bytes,
and how many of its values end right there.

Defined results: null, empty and blank values are never cases.  Rows with a null source share one null
source.  The whole value is used; the features look at its end and its length.  Repeated rows are scored
each by itself.  With no intact value to learn from (an empty table), nothing is a case.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm import answers, furniture
from lutrin.session import materialise, spread, table

#: Largest number of intact values per field and language from which positives are made.
SAMPLE = 4_000
#: Largest number of pairs of field and languages the sample is taken from, the commonest.
PAIRS = 64
#: Largest number of different limits at which the sample is cut.
KINDS = 16
BITS = 16
#: Least probability of a cut where the source has no final stop either.
UNFINISHED = 0.985
_STOP = ".!?…。！？"
_CLOSE = "\"'»”’」』)）]】  "
_BREAK = "—―–"
_DEBRIS = re.compile(r"(?:�+|&#?[A-Za-z0-9]{0,7}|(?:\\n)?\\u?[0-9a-fA-F]{0,3}|(?:\\[nrt])+\\?(?:u[0-9a-fA-F]{0,3})?|<!?-{0,2}[A-Za-z/]*[^<>]{0,40}|%[0-9A-F]?)$")
_DEBRIS_START = re.compile(r"[&<%\\�]")
_ENDS = re.compile(r"^(?:FIN|THE END|END|終わり|おわり|完|À SUIVRE|TO BE CONTINUED|CONTINUARÁ|つづく|続く)$", re.I)
_MARKER = re.compile(r"^(?:[*#~=_\-–—·•\s◆◇■□●○★☆※]+|<!--.*-->|!\[.*\]\(.*\)|#{1,6} .*)$")
_SENTENCE = re.compile(r"[.!?…。！？]+")


def strip_debris(text: str) -> tuple[str, str]:
    """(text without what a broken transfer left at its end, that debris)."""
    body = text.rstrip()
    if body[-1:].isalnum() and not _DEBRIS_START.search(body, max(0, len(body) - 60)):
        return body, ""
    found = _DEBRIS.search(body, max(0, len(body) - 60))
    if found and found.group() and not (found.group()[0] == "<" and found.group().rstrip().endswith("-->")):
        return body[: found.start()].rstrip(), found.group()
    return body, ""


def end_class(text: str) -> str:
    """How a text ends: stop, break, close (a quote or bracket), marker, word or none."""
    if not text:
        return "none"
    if text[-1] in _STOP:
        return "stop"
    if text[-1] in _BREAK or text.endswith("--"):
        return "break"
    if text[-1] in _CLOSE:
        return "word" if text[-1] in "'’" and text[-2:-1].isalpha() else "close"
    last = text.rsplit("\n", 1)[-1].strip()
    if _ENDS.match(last) or _MARKER.match(last):
        return "marker"
    return "word"


def _h(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def features(field: str, text: str, source_text: str | None, at_limit: int, pair: str) -> list[int]:
    """Hashed binary features of one (debris-free) value.

    ``at_limit``: 0 no limit known, 1 shorter than it, 2 right at it.
    """
    end = end_class(text)
    tail = text[-24:]
    out = [f"f{field}", f"e{end}", f"l{at_limit}", f"el{end}{at_limit}"]
    if source_text is not None:
        other = end_class(source_text)
        finished = other in ("stop", "break", "close")
        mine, theirs = len(_SENTENCE.findall(text)), len(_SENTENCE.findall(source_text))
        if end == "word":
            mine += 1
        if not finished:
            theirs += 1
        out += [f"s{other}", f"p{end}{finished}", f"n{max(-2, min(2, mine - theirs))}{end}"]
        part, whole = len(_SENTENCE.split(text.rstrip(_STOP))[-1]), len(_SENTENCE.split(source_text.rstrip(_STOP))[-1])
        out.append(f"r{pair}{end}{int(4 * math.log2((part + 1) / (whole + 1)))}")
    if end in ("word", "close"):
        words = tail.split()
        out += [f"w{end}{words[-1].lower()}" if words else "w", f"b{' '.join(words[-2:]).lower()}"]
        out += [f"c{k}{tail[-k:].lower()}" for k in (1, 2, 3, 4, 6)]
    return [_h(x) for x in out]


class Cutter:
    """The fitted model: weights of the hashed features."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights

    def fit(self, rows: list[list[int]], labels: list[int], rounds: int = 6, rate: float = 0.25, decay: float = 1e-6, seed: int = 5, batch: int = 64) -> "Cutter":
        """Adagrad on the log loss, in a seeded order, ``batch`` examples at a time."""
        w, g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
        order, y = np.random.default_rng(seed), np.asarray(labels, float)
        unique = [sorted(set(r)) for r in rows]
        width = max(map(len, unique), default=0)
        x = np.array([r + [1 << BITS] * (width - len(r)) for r in unique], dtype=np.int64).reshape(len(rows), width)
        for _ in range(rounds):
            turn = order.permutation(len(x))
            for k in range(0, len(turn), batch):
                at, here = turn[k : k + batch], x[turn[k : k + batch]]
                z = np.append(w, 0.0)[here].sum(1)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]
                ids, back = np.unique(here, return_inverse=True)
                step = np.bincount(back.ravel(), weights=np.repeat(error, width), minlength=len(ids))
                ids, step = (ids[:-1], step[:-1]) if ids[-1] == 1 << BITS else (ids, step)
                step += decay * w[ids]
                g[ids] += step * step
                w[ids] -= rate * step / np.sqrt(g[ids])
        self.weights = w
        return self

    def score(self, x: list[int]) -> float:
        if isinstance(self.weights, np.ndarray):
            self.weights = self.weights.tolist()
        z = sum(map(self.weights.__getitem__, set(x)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _cuts(text: str, rng: np.random.Generator, limits: list[tuple[int, int]]) -> list[tuple[str, int]]:
    """Artificial cuts of an intact value: (what is left, at_limit).  A limit is one of characters or of bytes."""
    out = []
    for chars, size in limits:
        if chars and len(text) > chars + 1:
            out.append((text[:chars], 2))
        elif size and len(text.encode("utf-8", "replace")) > size + 1:
            out.append((text.encode("utf-8", "replace")[:size].decode("utf-8", "ignore"), 2))
    for _ in range(2):
        k = int(rng.integers(2, max(3, len(text))))
        out.append((text[:k], int(rng.integers(0, 2))))
    return [(t.rstrip(), a) for t, a in out if t.strip() and end_class(t.rstrip()) not in ("stop", "marker")]


def training_set(sample: list[tuple], limits: list[tuple[int, int]]) -> tuple[list[list[int]], list[int]]:
    """Positives cut from intact values, and the intact values themselves.

    ``sample`` holds (field, text, source text or None, pair, seed); intact are values that end as complete
    ones do, or, with a source text, that end without a stop just as it does.
    """
    rows, labels = [], []
    for field, text, source, pair, seed in sample:
        rng = np.random.default_rng(seed & 0xFFFFFFFF)
        body, debris = strip_debris(furniture.content(text))
        if debris or not body:
            continue
        end = end_class(body)
        if source is not None:
            source = furniture.content(source)
            if not source or body == source or (end == "word" and end_class(source) != "word"):
                continue
        elif end == "word":
            continue
        if source is not None and rng.random() < 0.1:
            source = None  # some records come without one
        rows.append(features(field, body, source, int(rng.integers(0, 2)), pair))
        labels.append(0)
        for left, at in _cuts(body, rng, limits):
            rows.append(features(field, left, source, at, pair))
            labels.append(1)
    return rows, labels


def source_limits(rows: DataFrame) -> DataFrame:
    """Per ``champ, source``: the limit in characters or bytes that its values run into, else null.

    A source has a limit where at least 20 values and one in 200 end within 3 of its largest length: free
    lengths thin out towards their largest, cut ones pile up there.
    """
    lengths = rows.select("champ", "source", F.length("texte").alias("c"), F.octet_length("texte").alias("o"))
    n = lengths.groupBy("champ", "source", "c", "o").agg(F.count("*").alias("n"))
    top = n.groupBy("champ", "source").agg(F.max("c").alias("mc"), F.max("o").alias("mo"), F.sum("n").alias("all"))
    a, b = n.alias("a"), F.broadcast(top).alias("b")
    near = a.join(b, (F.col("a.champ") == F.col("b.champ")) & F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.mc", "b.mo", "b.all").groupBy("champ", "source")
    piles = near.agg(F.first("mc").alias("mc"), F.first("mo").alias("mo"), F.first("all").alias("all"), F.sum(F.when(F.col("c") == F.col("mc"), F.col("n")).otherwise(0)).alias("at_c"), F.sum(F.when(F.col("o") >= F.col("mo") - 3, F.col("n")).otherwise(0)).alias("at_o"))
    enough = F.greatest(F.lit(20), F.col("all") / 200)
    by_bytes = (F.col("at_o") >= enough) & (F.col("at_o") > 1.5 * F.col("at_c"))
    return piles.select("champ", "source", F.when((F.col("at_c") >= enough) & ~by_bytes, F.col("mc")).alias("lim_c"), F.when(by_bytes, F.col("mo")).alias("lim_o"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``champ, cle, source, texte, ocr, titre, paire`` of both fields."""
    bubbles = table(spark, sf_dir, "bulles").select(F.lit("bulles.traduction").alias("champ"), F.col("bulle_id").alias("cle"), F.col("canal").alias("source"), F.col("traduction").alias("texte"), "ocr", F.lit(None).cast("string").alias("fichier"), F.concat_ws(">", "langue_source", "langue_cible").alias("paire"))
    files = table(spark, sf_dir, "extraits").select(F.lit("extraits.text").alias("champ"), F.col("extrait_id").alias("cle"), F.col("outil").alias("source"), F.col("text").alias("texte"), F.lit(None).cast("string").alias("ocr"), "fichier", F.lower(F.substring(F.trim("langue"), 1, 2)).alias("paire"))
    return bubbles.unionByName(files)


def fit_cutter(rows: DataFrame, limits: DataFrame, sample: int = SAMPLE) -> Cutter:
    """Fit on about ``sample`` values per field and language pair, those with the smallest hashed keys, each cut
    at the limit of its own or a neighbouring source; hashed features, not texts, reach the driver."""
    full = rows.where("texte IS NOT NULL AND trim(texte) <> ''").select("champ", F.coalesce("paire", F.lit("")).alias("paire"), "texte", "ocr", F.shiftrightunsigned(F.xxhash64("cle", F.lit(3)), 1).alias("h"))
    sizes = full.groupBy("champ", "paire").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "champ", "paire").limit(PAIRS)
    few = full.join(F.broadcast(sizes), ["champ", "paire"]).where(F.col("h") / F.lit(float(1 << 63)) < F.lit(float(sample)) / F.col("n")).select("champ", "paire", "texte", "ocr", "h")
    # Cuts are made at the commonest limits: at most ``KINDS`` of them, in characters and in bytes.
    kinds = limits.where("lim_c IS NOT NULL OR lim_o IS NOT NULL").groupBy("lim_c", "lim_o").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lim_c", "lim_o").limit(KINDS).collect()
    spans = sorted((r.lim_c or 0, r.lim_o or 0) for r in kinds)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features alone leave the executors; the texts stay there."""
        for b in batches:
            d = b.to_pydict()
            x, y, h = [], [], []
            for c, p, t, o, k in zip(d["champ"], d["paire"], d["texte"], d["ocr"], d["h"]):
                some, labels = training_set([(c, t, o, p, k)], spans)
                x, y, h = x + some, y + labels, h + [k] * len(labels)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.int32()))], names=["h", "y", "x"])

    made = few.mapInArrow(examples, "h bigint, y int, x array<int>").collect()
    made.sort(key=lambda r: (r.h, r.y, r.x))
    model = Cutter()
    return model.fit([r.x for r in made], [r.y for r in made]) if 0 < sum(r.y for r in made) < len(made) else model


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with the limits ``lim_c, lim_o`` of their ``champ`` and ``source`` (null where there is none)."""
    a, b = rows.alias("a"), limits.where("lim_c IS NOT NULL OR lim_o IS NOT NULL").alias("b")
    same = (F.col("a.champ") == F.col("b.champ")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    return a.join(b, same, "left").select("a.*", "b.lim_c", "b.lim_o")


def judge(model: Cutter, limit: tuple, champ: str, text: str | None, source_text: str | None, title: str | None, pair: str) -> tuple[float, bool]:
    """(probability by the model that a value was cut, is it a case after the exact checks)."""
    if not text or model.weights is None:
        return 0.0, False
    body, debris = strip_debris(furniture.content(text, title))
    if not body:
        return 0.0, False
    bubble = champ == "bulles.traduction"
    lim_c, lim_o = limit
    at = 0 if not (lim_c or lim_o) else 2 if (lim_c and len(text) >= lim_c) or (lim_o and len(text.encode("utf-8", "replace")) >= lim_o - 3) else 1
    source = furniture.content(source_text) if bubble and source_text is not None else None
    p = model.score(features(champ, body, source, at, pair))
    end = end_class(body)
    # Debris after a closed sentence is left of what followed it.
    broken = bool(debris) and end != "word"
    if p < 0.5 and not broken:
        return p, False
    if bubble and (text[-1] in _STOP or answers.is_empty(text) or (source is not None and answers.is_copy(source, text))):
        return p, False  # nothing follows a translation, so its own end decides
    if end != "word" and not debris:
        return p, False
    # A line may end as its source does, without a stop: only what stops inside a word or phrase is cut then.
    if source is not None and end_class(source) in ("word", "none", "marker") and not debris and at < 2:
        return p, p >= UNFINISHED
    return (max(p, 0.5), True) if broken else (p, True)


def score_records(rows: DataFrame, model: Cutter, limits: DataFrame) -> DataFrame:
    """``champ, cle, source, coupe DOUBLE, cas BOOLEAN`` of every record (0 and false for null and empty values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            found = [judge(model, (lc, lo), c, t, o, furniture.title_of_file(f), q or "") for c, t, o, f, q, lc, lo in zip(d["champ"], d["texte"], d["ocr"], d["fichier"], d["paire"], d["lim_c"], d["lim_o"])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([p for p, _ in found], pa.float64()), pa.array([x for _, x in found], pa.bool_())], names=["champ", "cle", "source", "coupe", "cas"])

    used = with_limits(spread(rows.select("champ", "cle", "source", "texte", "ocr", "fichier", "paire")), limits)
    return used.mapInArrow(run, "champ string, cle bigint, source string, coupe double, cas boolean")


def truncation_scores(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    limits = materialise(source_limits(rows))
    return score_records(rows, fit_cutter(rows, limits, sample), limits)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_scores(records(spark, sf_dir)).where("cas").select("champ", "cle")


def p1_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut records of each ``canal`` and each ``outil``."""
    return truncation_scores(records(spark, sf_dir)).groupBy("champ", "source").agg(F.count("*").alias("n"), F.count_if("cas").alias("coupes"), F.avg(F.col("cas").cast("double")).alias("part"), F.avg("coupe").alias("moyenne"))
