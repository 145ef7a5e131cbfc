"""Problem 9: cut oversized texts into overlapping pieces at natural places.

Method: a recursive hierarchy of separators (section, paragraph, line, sentence, word, character) breaks a
text into parts of at most ``limit - overlap`` tokens: a part that is too large is broken at the next
finer level only.  Parts are packed greedily up to the limit (each cut is looked up from the coarsest level), and each following piece starts
``overlap`` tokens before the end of the one before.  Places are token boundaries of the whole text's
encoding, so a piece's ids are a slice of the text's ids and the overlap is exact.

Defined results: texts of at most ``limit`` tokens, null, empty ones included, give no rows; a row with a null key keeps it.  A piece
never ends or starts inside a character; where the exact overlap would start inside one, an earlier
place of the same level is taken if the piece stays three quarters full, else the overlap grows by the one to
three tokens that complete the character.  An overlap that is null or negative counts as 0, one
that leaves less than a quarter of the limit, or less than 8 tokens, for new text is reduced.  Limits under
8 (a character can take 4 tokens) are refused.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm import bpe
from lutrin.session import small_rows, spread, table

LEVELS = ("section", "paragraphe", "ligne", "phrase", "mot", "caractere", "fin")
_HEADING = re.compile(rb"#{1,6} |(?:Planche|Chapitre|Chapter|Cap\xc3\xadtulo|CHAPITRE|CHAPTER|CAP\xc3\x8dTULO) ?\d|\xe7\xac\xac\d+\xe7\xab\xa0|\* ?\* ?\*")
_CLOSERS = re.compile(rb"(?:[.!?\"')\]]|\xc2\xbb|\xe2\x80[\x9d\x99\xa6]|\xc2\xa0\xc2\xbb|\xe3\x80[\x8d\x8f\x82]|\xef\xbc[\x81\x9f])*")
#: Classes of bytes: 1 a line end, 2 a blank, 4 a stop, 8 the first byte of a heading.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x0A, 0x0D]] = 1
_KIND[[0x20, 0x09]] = 2
_KIND[[0x2E, 0x21, 0x3F]] = 4
_KIND[[0x23, 0x50, 0x43, 0xE7, 0x2A]] = 8


def _after(data: bytes, sign: bytes) -> list[int]:
    """Offsets right after each place of a sign."""
    out, i = [], data.find(sign)
    while i >= 0:
        i += len(sign)
        out.append(i)
        i = data.find(sign, i)
    return out


def _natural_places(data: bytes, raw: np.ndarray) -> list[np.ndarray]:
    """Byte offsets of the ends of sections, paragraphs, lines, sentences and words."""
    size = len(data)
    kind = _KIND[raw]
    end = kind == 1
    lines = np.flatnonzero(end[:-1] & ~end[1:]) + 1  # after the last line end of a run
    before = np.flatnonzero(end[1:] & ~end[:-1]) + 1
    if size and end[0]:
        before = np.concatenate([[0], before])
    starts = before[: len(lines)]
    crlf = np.array([data.count(b"\r\n", i, j) for i, j in zip(starts.tolist(), lines.tolist())], np.int64) if b"\r\n" in data else 0
    paragraphs = lines[lines - starts - crlf > 1]
    heads = lines[kind[lines] == 8] if len(lines) else lines
    sections = np.array([i for i in heads.tolist() if _HEADING.match(data, i)], np.int64)

    stops = np.flatnonzero(kind == 4) + 1
    follow = kind[np.minimum(stops, size - 1)]
    plain = (stops < size) & ((follow == 1) | (follow == 2))
    ends = stops[plain].tolist()
    for i in stops[~plain].tolist() + _after(data, b"\xe2\x80\xa6"):
        j = _CLOSERS.match(data, i).end()
        if j < size and data[j] in b" \n\r\t\xc2\xe3":
            ends.append(j)
    for sign in (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f"):
        for i in _after(data, sign):
            ends.append(_CLOSERS.match(data, i).end())
    blank = kind == 2
    words = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    commas = [i for x in (b"\xe3\x80\x81", b"\xe3\x80\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9") for i in _after(data, x)]
    if commas:
        words = np.unique(np.concatenate([words, np.array(commas, np.int64)]))
    return [sections, paragraphs, lines, np.array(sorted(set(ends)), np.int64), words]


class _Text:
    """Places of one encoded text, as sorted token positions per level."""

    def __init__(self, data: bytes, ends: np.ndarray):
        n = len(ends)
        raw = np.frombuffer(data, np.uint8)
        inner = np.zeros(len(data) + 1, bool)
        inner[:-1] = (raw & 0xC0) == 0x80
        starts = np.concatenate([[0], ends])  # byte offset before token i
        self.whole = ~inner[starts]  # token boundaries between characters
        self.n = n
        at = np.full(len(data) + 1, -1, np.int64)
        at[starts] = np.arange(n + 1)
        self.places = []
        for offsets in _natural_places(data, raw):
            found = at[offsets]  # in order, as the offsets are
            self.places.append(found[found > 0].tolist())

    def cut(self, limit: int, most: int) -> tuple[int, int]:
        """(place, level) of the last cut at or before ``limit``.

        The part around ``limit`` is narrowed level by level: while it has more than ``most`` tokens it is
        broken at the next finer level, and the cut is where the part that can stay whole begins.
        """
        left, right, found = 0, self.n, 0
        for level, places in enumerate(self.places):
            i = bisect_right(places, limit)
            if i and places[i - 1] > left:
                left, found = places[i - 1], level
            if i < len(places) and places[i] < right:
                right = places[i]
            if right - left <= most:
                return left, found
        while not self.whole[limit]:
            limit -= 1
        return limit, len(self.places)


    def exact(self, end: int, level: int, overlap: int, least: int) -> int:
        """The last place of the same level, not under ``least``, whose overlap starts with a character."""
        whole = self.whole
        if level < len(self.places):
            places = self.places[level]
            i = bisect_left(places, end) - 1
            while i >= 0 and places[i] >= least:
                if whole[places[i] - overlap]:
                    return places[i]
                i -= 1
        else:
            for k in range(end - 1, least - 1, -1):
                if whole[k] and whole[k - overlap]:
                    return k
        return end


def pieces_of(text: _Text, limit: int, overlap: int) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and levels (of the cut at the end) of the pieces of a text larger than ``limit``."""
    overlap = min(max(overlap, 0), limit * 3 // 4, max(0, limit - 8))
    most = limit - overlap - (3 if overlap else 0)  # the overlap may grow to complete a character
    starts, stops, cuts = [], [], []
    start, n, whole = 0, text.n, text.whole
    while n - start > limit:
        end, level = text.cut(start + limit, most)
        if overlap and not whole[end - overlap]:
            end = text.exact(end, level, overlap, start + limit * 3 // 4)
        starts.append(start)
        stops.append(end)
        cuts.append(level)
        start = end - overlap
        while not whole[start]:
            start -= 1
    starts.append(start)
    stops.append(n)
    cuts.append(len(LEVELS) - 1)
    return starts, stops, cuts


def split_texts(df: DataFrame, profiles: list[tuple[str, int, int]], tokenizer: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """Pieces of the texts of (``doc_id``, ``text``) for each (name, limit, overlap) of ``profiles``."""
    path = bpe.vocabulary_path(tokenizer, directory)
    profiles = [(p, int(n), int(o or 0)) for p, n, o in profiles if n is not None]
    if any(n < 8 for _, n, _ in profiles):
        raise ValueError("a limit under 8 tokens cannot hold every character")
    least = min((n for _, n, _ in profiles), default=0)
    names = ["profil", "doc_id", "rang", "debut", "fin", "n_tokens", "niveau", "texte"]
    schema = "profil string, doc_id bigint, rang int, debut int, fin int, n_tokens int, niveau string, texte string"

    def run(batches):
        enc = bpe.load(path)
        for b in batches:
            done: list[tuple] = []  # (profile, document, starts, stops, levels)
            texts: list[str] = []
            held = 0
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t or len(t) * 4 <= least:  # a character has at most 4 tokens
                    continue
                ids = enc.encode(t)
                if len(ids) <= least:
                    continue
                data = t.encode("utf-8", "replace")
                ends = np.cumsum(enc.lengths[ids])
                places = _Text(data, ends)
                offset = [0, *ends.tolist()]
                for p, (_, limit, overlap) in enumerate(profiles):
                    if len(ids) > limit:
                        starts, stops, cuts = pieces_of(places, limit, overlap)
                        done.append((p, doc, starts, stops, cuts))
                        texts += [data[offset[s] : offset[e]].decode("utf-8", "replace") for s, e in zip(starts, stops)]
                        held += len(data)
                if held > 8 << 20:
                    yield _batch(done, texts)
                    done, texts, held = [], [], 0
            if done:
                yield _batch(done, texts)

    def _batch(done: list[tuple], texts: list[str]) -> pa.RecordBatch:
        sizes = np.array([len(x[2]) for x in done])
        debut, fin = (np.fromiter(chain.from_iterable(x[k] for x in done), np.int32, len(texts)) for k in (2, 3))
        level = pa.DictionaryArray.from_arrays(np.fromiter(chain.from_iterable(x[4] for x in done), np.int8, len(texts)), pa.array(LEVELS)).cast(pa.string())
        profile = pa.DictionaryArray.from_arrays(np.repeat(np.array([x[0] for x in done], np.int8), sizes), pa.array([p for p, _, _ in profiles], pa.string())).cast(pa.string())
        rank = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        doc = pa.array([x[1] for x in done], pa.int64()).take(pa.array(np.repeat(np.arange(len(done)), sizes)))
        return pa.RecordBatch.from_arrays([profile, doc, pa.array(rank), pa.array(debut), pa.array(fin), pa.array(fin - debut), level, pa.array(texts, pa.string())], names=names)

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    return spread(rows).mapInArrow(run, schema)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = [(r.profil, r.taille_max, r.recouvrement) for r in small_rows(table(spark, sf_dir, "decoupes").select("profil", "taille_max", "recouvrement").distinct())]
    return split_texts(table(spark, sf_dir, "documents"), profiles)
