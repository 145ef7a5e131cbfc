"""Column functions over text: sizes, keys, cleaning.  All are built-in expressions; null gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that weigh as one token, and those that carry text (kana, ideographs, hangul).
WIDE = r"[\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}]"
CARRIES = r"\x{3005}\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7A3}"
NARROW = f"[{CARRIES}]"
_ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_in(text, characters: str) -> Column:
    """How many characters of a class a text has: what goes when its runs are taken out (no array of hits)."""
    return F.length(c(text)) - F.length(F.regexp_replace(c(text), characters + "+", ""))


def token_estimate(text) -> Column:
    """Estimated tokens: one for each wide character, a quarter for each other one."""
    wide = count_in(text, WIDE)
    return wide + F.floor((F.length(c(text)) - wide) / 4).cast("int")


def output_cap(text, mult: float = 2.0, floor: int = 768, ceiling: int = 6000) -> Column:
    """Bound of an answer's tokens, in proportion to its source."""
    wanted = F.floor(token_estimate(text) * F.lit(mult)).cast("int") + 256
    return F.when(wanted.isNotNull(), F.greatest(F.lit(floor), F.least(F.lit(ceiling), wanted)))


def word_count(text) -> Column:
    """Letter runs, with ideographs and kana counted as half a word each."""
    rest = F.regexp_replace(c(text), NARROW + "+", " ")
    # Every letter run becomes one mark; the marks are what is left to count.
    marks = F.length(F.regexp_replace(F.regexp_replace(rest, r"\p{L}+", "\u0001"), "[^\u0001]+", ""))
    return marks + F.floor(count_in(text, NARROW) / 2).cast("int")


def cjk_rate(text) -> Column:
    """Share of wide characters; 0 for an empty text."""
    return F.when(F.length(c(text)) == 0, 0.0).otherwise(count_in(text, WIDE) / F.length(c(text)))


def strip_accents(text) -> Column:
    """Latin letters without their accents (lower case in, lower case out)."""
    return F.translate(c(text), _ACCENTED, _PLAIN)


def norm_key(text) -> Column:
    """Key of comparison: lower case, no Latin accents, everything but letters, digits and CJK text a blank."""
    folded = strip_accents(F.lower(c(text)))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, f"[^a-z0-9 {CARRIES}]+", " "), " +", " "))


def repeat_key(text) -> Column:
    """Key under which repeated furniture falls together: trimmed lower case, digits as ``#``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c(text))), "[0-9]+", "#"), "[ \t]+", " ")


def copy_key(text) -> Column:
    """Lower case letters and digits alone."""
    return F.regexp_replace(F.lower(c(text)), r"[^\p{L}\p{N}]+", "")


def natural_key(text) -> Column:
    """Sort key: runs of digits compare as numbers."""
    parts = F.regexp_extract_all(F.lower(c(text)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t, 12, "0")).otherwise(t))


def replace_all(text, pairs: list[tuple[str, str]]) -> Column:
    """Ordered chain of literal replacements; earlier ones feed later ones."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, c(text))


def excerpt(text, at, width: int, margin: int = 28) -> Column:
    """Up to ``margin`` characters each side of a hit of ``width`` at 1-based ``at``, with ellipses where cut."""
    start = F.greatest(F.lit(1), at - margin)
    size = at + width + margin - start
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substr(c(text), start, size), F.when(start + size - 1 < F.length(c(text)), "…").otherwise(""))


def lines(df, key: str, text: str):
    """``key, pos, ligne``: the lines of every non-null text, ``pos`` from 0."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "ligne"))
