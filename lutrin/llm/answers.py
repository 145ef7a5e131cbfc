"""Problem 3: defective answers of prompt and response pairs, each with its kind of defect.

Method: a response compressed with its prompt as a zstandard dictionary shrinks to almost nothing when it
gives the prompt back (pairs with about as many letters that share half their words are tried).  Copies, given and made
of prompts, and answers that are none, fix two bounds on the compressed size: below the first is a copy, over the second
is none, between them an exact check for one lost character breaks the tie; dictionaries of words per language, counted
in all texts, tell the language of each sentence; dictionaries of refusal phrases tell refusals; the terminal-context
model of problem 1 tells cut answers.  The first kind that applies is given: ``vide``, ``refus``,
``copie``, ``autre_langue``, ``tronquee``.

Defined results: a prompt that is null, empty, or holds no words to translate (punctuation, a name, a
sound) has no defect.  A null answer to a prompt with words is ``vide``.  A null target language rules
out ``autre_langue``.  Whole texts are used.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm import furniture
from lutrin.session import materialise, spread, table

#: Least share of all words that a word has in lower case, else it tells nothing of a language: with all texts counted
#: nearly every name stands in lower case somewhere.  (Three times at least; so the dictionary has 33,333 words at most.)
LOWER = 3e-5
LANGUAGES = ("en", "fr", "es")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_JA = re.compile("[" + chr(0x3041) + "-" + chr(0x30FA) + chr(0x4E00) + "-" + chr(0x9FFF) + chr(0xFF66) + "-" + chr(0xFF9F) + "]")
_JA_WORDS = re.compile("[" + chr(0x3041) + "-" + chr(0x3096) + chr(0x4E00) + "-" + chr(0x9FFF) + "]")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\s\"'»”」』]*(?=\S)")
_NUMBER = re.compile(r"^\s*[\[(]?\d{1,3}\s*[.):\]-]\s*")
_PLACEHOLDERS = frozenset(("null", "none", "nil", "nan", "na", "nd", "tbd", "todo", "vide", "empty", "blank", "vacio", "vacía", "vacío", "untranslated", "missing", "undefined", "sanstexte", "sansparole", "notext", "sintexto", "texteabsent", "textemanquant", "notranslation", "pasdetraduction", "sintraduccion", "sintraducción", "空", "空白", "なし", "無し", "翻訳なし", "テキストなし"))
_LONGEST = max(map(len, _PLACEHOLDERS))

#: Refusals: what a translator says of its task, and the ways of saying no, in the languages met (lower case).
_ALWAYS = (
    "language model", "as an ai ", "ai assistant", "the assistant", "my guidelines", "content polic", "please rephrase",
    "modèle de lang", "en tant qu'ia", "en tant qu'assistant", "l'assistant", "mes consignes", "merci de reformuler",
    "modelo de lengua", "como ia", "como una ia", "el asistente", "mis directrices", "reformul",
    "言語モデル", "アシスタント", "ガイドライン", "お手伝いできません", "翻訳できません", "翻訳することはできません", "対応いたしかね", "対応できません", "お応えできません", "お答えできません",
)
_NO = (
    "can't", "cannot", "can not", "unable", "won't", "decline", "refuse", "sorry", "unfortunately", "apolog", "against", "not able", "rather not",
    "ne peux pas", "ne puis pas", "ne saurais", "n'est pas possible", "pas en mesure", "impossible", "décliner", "préfère ne pas", "malheureusement", "désolé", "navré", "regrette", "enfreint", "ne peut être",
    "no puedo", "no podemos", "no me es posible", "imposible", "rechazar", "declinar", "lamentablemente", "lamento", "lo siento", "prefiero no",
    "申し訳", "できません", "いたしかね", "残念ながら", "お断り",
)
_TASK = (
    "this text", "this passage", "this content", "this request", "this translation", "this line", "this bubble", "this type", "the text you", "the bubble you", "the passage you", "the content you",
    "your request", "a translation", "more context", "further context", "something else i can", "translating",
    "ce texte", "ce passage", "ce contenu", "cette demande", "cette traduction", "cette réplique", "cette bulle", "de texte", "texte demandé", "votre demande", "votre texte", "davantage de contexte", "plus de contexte", "vous aider autrement",
    "este texto", "este pasaje", "este contenido", "este fragmento", "esta solicitud", "esta petición", "esta traducción", "su solicitud", "su petición", "más contexto", "ayudarle",
    "この文章", "このテキスト", "この内容", "この翻訳", "この依頼", "ご依頼", "ご要望", "ご希望",
)


def letters_of(text: str) -> str:
    """Letters and digits alone, without case or width."""
    return "".join(c for c in unicodedata.normalize("NFKC", furniture.bare(text)).casefold() if c.isalnum())


def is_empty(text: str | None) -> bool:
    """No actual answer: nothing but blanks, signs, a line number or a placeholder."""
    if not text:
        return True
    seen, longest = 0, _LONGEST if max(text) < "\u1100" else 4 * _LONGEST  # from there on, several letters may be one composed
    for m in _LETTERS.finditer(text):  # most values have more letters than any placeholder, soon
        seen += m.end() - m.start()
        if seen > longest:
            return False
    body = _NUMBER.sub("", furniture.bare(text))
    core = "".join(_LETTERS.findall(unicodedata.normalize("NFKC", body))).casefold()
    return not core or core in _PLACEHOLDERS


def _almost(a: str, b: str) -> bool:
    """Equal, or equal after one lost, added or changed character."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    n = min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def extra(prompt: str, answer: str) -> int | None:
    """Bytes that the answer's letters take with the prompt as dictionary beyond those of the prompt given back, or the
    prompt's with the answer as dictionary, whichever is more; and the letters, but one, by which their numbers differ
    (a stretch given twice or left out at an end costs the compressor next to nothing).

    0 for a whole copy, some for a lost character, more the more is new or missing; null where either holds no letters.
    """
    import zstandard

    p, a = letters_of(prompt).encode(), letters_of(answer).encode()
    if not p or not a:
        return None
    if p == a:
        return 0  # both sizes are the same by definition

    def size(known: bytes, text: bytes, base: bytes) -> int:
        d = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(text)) - len(c.compress(base))

    return max(size(p, a, p), size(a, p, a)) + max(0, abs(len(p.decode()) - len(a.decode())) - 1)


def _may_copy(prompt: str, answer: str) -> bool:
    """Can the answer be the prompt?  Copies have about as many letters, and share script and words."""
    wide = not prompt.isascii() and _JA.search(prompt)
    if wide and (answer.isascii() or not _JA.search(answer)):
        return False
    p, a = sum(map(len, _LETTERS.findall(prompt))), sum(map(len, _LETTERS.findall(answer)))
    if abs(p - a) > 2 + p // 8:
        return False
    if wide:
        return True
    p, a = set(_LETTERS.findall(prompt.casefold())), set(_LETTERS.findall(answer.casefold()))
    return 2 * len(p & a) >= len(a) or len(a) <= 2


def _exactly(prompt: str, answer: str) -> bool:
    forms = [letters_of(x) for x in (prompt, _NUMBER.sub("", prompt))]
    return any(_almost(f, letters_of(x)) for f in forms for x in (answer, _NUMBER.sub("", answer)))


class Copies:
    """Copies by compressed size: at most ``sure`` extra bytes is a copy, over ``most`` is none; between, the
    exact check decides.  The two bounds are fitted on copies, given and made, and on answers that are none."""

    def __init__(self, sure: int = -1, most: int = 24):
        self.sure, self.most = sure, most

    def fit(self, pairs: list[tuple[str, str]], seed: int = 3) -> "Copies":
        """``most``: what the dearest copy takes (an answer that is one, or made of a prompt: another case, a number
        before it, one character lost).  ``sure``: one less than the cheapest that is no copy takes (an answer, or a prompt
        with a word lost or doubled or a few characters lost)."""
        rng, made, others = random.Random(seed), [], []
        for prompt, answer in pairs:
            k = rng.randrange(len(prompt))
            made += [x for t in (prompt.upper(), f"{k % 9 + 1}. {prompt}", prompt[:k] + prompt[k + 1 :]) if (x := extra(prompt, t)) is not None]
            words = prompt.split()
            near = [" ".join(words[:-1]), " ".join(words + words[-1:]), prompt[:k] + prompt[k + 3 :]]
            others += [x for t in near if not _exactly(prompt, t) and (x := extra(prompt, t)) is not None]
            if (x := self.size(prompt, answer)) is not None:
                (made if _exactly(prompt, answer) else others).append(x)
        self.most = max(made, default=self.most)
        self.sure = min(min(others, default=0) - 1, self.most)
        return self

    @staticmethod
    def size(prompt: str, answer: str) -> int | None:
        """``extra`` of a pair, with or without the line numbers, whichever is less."""
        if not (_NUMBER.match(answer) or _NUMBER.match(prompt)):
            return extra(prompt, answer)
        return min((x for a in (answer, _NUMBER.sub("", answer)) for p in (prompt, _NUMBER.sub("", prompt)) if (x := extra(p, a)) is not None), default=None)

    def found(self, prompt: str | None, answer: str | None) -> bool:
        if not prompt or not answer or not _may_copy(prompt, answer):
            return False
        n = self.size(prompt, answer)
        return n is not None and n <= self.most and (n <= self.sure or _exactly(prompt, answer))


def is_copy(prompt: str | None, answer: str | None) -> bool:
    """Is the answer the prompt given back whole?  With unfitted bounds, so the exact check decides."""
    return Copies().found(prompt, answer)


def is_refusal(answer: str) -> bool:
    text = answer.lower().replace("’", "'")
    return any(x in text for x in _TASK) and any(x in text for x in _NO) or any(x in text for x in _ALWAYS)


class WordLanguages:
    """Log-odds of words per language; names (hardly seen in lower case) and unknown words tell nothing."""

    def __init__(self, weights: dict[str, tuple[float, ...]] | None = None):
        self.weights = weights or {}

    def fit(self, counts: dict[str, Counter], lower: Counter, totals: dict[str, int] | None = None) -> "WordLanguages":
        """A word's weight in a language is the log of its share there over its mean share elsewhere.  ``totals``: words
        of each language, if ``counts`` leaves some out."""
        totals = {k: n + 1 for k, n in (totals or {k: sum(c.values()) for k, c in counts.items()}).items()}
        words = set().union(*counts.values()) if counts else set()
        for w in words:
            rate = [(counts.get(k, Counter())[w] + 0.02) / (totals.get(k, 1) / 1e4 + 1) for k in LANGUAGES]
            if lower[w] >= 3:
                self.weights[w] = tuple(max(-4.0, min(4.0, math.log(r / ((sum(rate) - r) / (len(rate) - 1))))) for r in rate)
        return self

    def other_than(self, sentence: str, target: str) -> bool:
        """Is this sentence written in another language than ``target``?"""
        if sentence and max(sentence) > "　":
            wide = len(_JA.findall(sentence))
            if 2 * wide > sum(map(str.isalpha, sentence)):
                return target != "ja" and len(_JA_WORDS.findall(sentence)) >= 1 and wide >= 2
        if target == "ja":
            return len(_WORDS.findall(sentence)) >= 2
        if target not in LANGUAGES:
            return False
        t = LANGUAGES.index(target)
        known = [self.weights[w] for w in _WORDS.findall(sentence.casefold()) if w in self.weights]
        sums = [sum(max(-2.5, x[i]) for x in known) for i in range(len(LANGUAGES))]
        best = max(range(len(LANGUAGES)), key=lambda i: sums[i])
        strong = sum(x[best] > 1 for x in known)
        return best != t and strong >= 2 and sums[best] - sums[t] >= 4 and not any(x[t] > 2 for x in known)

    def may_be_other(self, answer: str, target: str) -> bool:
        """Could any sentence be in another language?  No where hardly a word says so."""
        if target not in LANGUAGES or max(answer) > "　":
            return True
        t = LANGUAGES.index(target)
        get = self.weights.get
        foreign = 0
        for w in _WORDS.findall(answer.casefold()):
            x = get(w)
            if x is not None and x[t] < 0 and max(x) > 1:
                foreign += 1
                if foreign > 1:
                    return True
        return False

    def holds_words(self, prompt: str, language: str | None) -> bool:
        """Does a prompt hold words, not just a name, a sound or signs?"""
        prompt = furniture.bare(prompt)
        if _JA.search(prompt):
            return bool(_JA_WORDS.search(prompt))
        words = _WORDS.findall(prompt)
        if len(words) < 2:
            return bool(words) and not words[0].isupper() and words[0].casefold() in self.weights and max(self.weights[words[0].casefold()]) > 1 and "!!" not in prompt
        return len(words) > 3 or any(w.casefold() in self.weights and max(self.weights[w.casefold()]) > 1 for w in words)


def fit_languages(bubbles: DataFrame) -> WordLanguages:
    """From the words of all texts; the driver takes those often enough (``LOWER``) in lower case."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, rows = b.to_pydict(), []
            for k in LANGUAGES:
                tokens = Counter(" ".join(y for l, t in (("langue_cible", "traduction"), ("langue_source", "ocr")) for x, y in zip(d[l], d[t]) if x == k and y).split())
                seen: Counter = Counter()  # no word goes over a blank, so equal tokens are looked at once
                for token, n in tokens.items():
                    for w in _WORDS.findall(furniture.bare(token)):
                        seen[w] += n
                rows += [(k, w.casefold(), n, n if w[0].islower() else 0) for w, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["l", "mot", "n", "bas"])

    seen = bubbles.select("langue_cible", "traduction", "langue_source", "ocr").mapInArrow(count, "l string, mot string, n bigint, bas bigint")
    each = materialise(seen.groupBy("mot").agg(*(F.coalesce(F.sum(F.when(F.col("l") == k, F.col("n"))), F.lit(0)).alias(k) for k in LANGUAGES), F.sum("bas").alias("bas")))
    totals = each.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in LANGUAGES)).first().asDict()
    rows = each.where(F.col("bas") >= max(3, LOWER * sum(totals.values()))).collect()
    return WordLanguages().fit({k: Counter({r.mot: r[k] for r in rows}) for k in LANGUAGES}, Counter({r.mot: r.bas for r in rows}), totals)


def fit_copies(bubbles: DataFrame) -> Copies:
    """From all pairs that may be copies, so from all that the two bounds decide: every given copy is within ``most``
    and every answer that is none over ``sure``."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            if pairs := {(p, a) for p, a in zip(d["ocr"], d["traduction"]) if _may_copy(p, a)}:
                c = Copies().fit(sorted(pairs))
                yield pa.RecordBatch.from_arrays([pa.array([c.sure], pa.int32()), pa.array([c.most], pa.int32())], names=["sure", "most"])

    pairs = bubbles.where("length(trim(ocr)) > 0 AND length(trim(traduction)) > 0").select("ocr", "traduction")
    r = pairs.mapInArrow(fit, "sure int, most int").agg(F.min("sure").alias("sure"), F.max("most").alias("most")).first()
    return Copies() if r.sure is None else Copies(r.sure, r.most)


def defect(words: WordLanguages, copies: Copies, prompt: str | None, answer: str | None, source: str | None, target: str | None) -> str | None:
    """The first defect of an answer but ``tronquee``; '' for none, null where there is nothing to judge."""
    if not prompt:
        return None
    kind = ""
    if is_empty(answer):
        kind = "vide"
    elif is_refusal(answer):
        kind = "refus"
    elif copies.found(prompt, answer):
        kind = "copie"
    elif target and words.may_be_other(answer, target) and any(words.other_than(s, target) for s in _SENTENCE.split(furniture.bare(answer))):
        kind = "autre_langue"
    return kind if not kind or words.holds_words(prompt, source) else None


def answer_defects(bubbles: DataFrame) -> DataFrame:
    """``bulle_id, defaut`` of the defective bubbles."""
    from lutrin.llm import truncation

    words = fit_languages(bubbles)
    rows = bubbles.select(F.lit("bulles.traduction").alias("champ"), F.col("bulle_id").alias("cle"), F.col("canal").alias("source"), F.col("traduction").alias("texte"), "ocr", F.concat_ws(">", "langue_source", "langue_cible").alias("paire"))
    limits = materialise(truncation.source_limits(rows))
    model = truncation.fit_cutter(rows, limits)
    copies = fit_copies(bubbles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, kinds = [], []
            d = b.to_pydict()
            for k, o, t, ls, lc, *limit in zip(d["bulle_id"], d["ocr"], d["traduction"], d["langue_source"], d["langue_cible"], d["lim_c"], d["lim_o"]):
                kind = defect(words, copies, o, t, ls, lc)
                # What ends with a stop is no cut bubble, whatever the model says of it.
                if kind == "" and t[-1] not in truncation._STOP and truncation.judge(model, tuple(limit), "bulles.traduction", t, o, None, f"{ls}>{lc}" if ls and lc else ls or lc or "")[1]:
                    kind = "tronquee"
                if kind:
                    keys.append(k)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string())], names=["bulle_id", "defaut"])

    used = bubbles.select(F.col("bulle_id").cast("bigint").alias("bulle_id"), "ocr", "traduction", "langue_source", "langue_cible", F.lit("bulles.traduction").alias("champ"), F.col("canal").alias("source"))
    return truncation.with_limits(spread(used), limits).mapInArrow(run, "bulle_id bigint, defaut string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_defects(table(spark, sf_dir, "bulles"))
