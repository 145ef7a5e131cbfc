"""Column functions that read small notations: lists, markers, switches, versions, sizes, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lutrin.functions.text import c

#: Words that say yes and no in the tables people type.
_YES = ("oui", "o", "yes", "y", "vrai", "true", "1", "x")
_NO = ("non", "n", "no", "faux", "false", "0")
_NOTHING = ("", "-", "—", "aucun", "aucune", "none", "n/a", "null")


def tri_state(text) -> Column:
    """True, false, or null for anything that says neither."""
    t = F.lower(F.trim(c(text)))
    return F.when(t.isin(*_YES), True).when(t.isin(*_NO), False)


def split_list(text) -> Column:
    """Items of a typed list, parted by commas, semicolons, slashes or "et" outside brackets; words for nothing
    are left out, repeated items stay."""
    marked = F.regexp_replace(c(text), r"(?:\s*[,;/]\s*|\s+et\s+)(?![^()]*\))", "\u0001")
    items = F.transform(F.split(marked, "\u0001"), F.trim)
    return F.filter(items, lambda x: ~F.lower(x).isin(*_NOTHING))


def split_marker(text) -> Column:
    """``path`` and ``attributes`` of an image marker's body."""
    at = F.instr(c(text), "|")
    return F.struct(F.trim(F.when(at > 0, F.substr(c(text), F.lit(1), at - 1)).otherwise(c(text))).alias("chemin"), F.trim(F.when(at > 0, F.substr(c(text), at + 1)).otherwise(F.lit(""))).alias("attributs"))


def make_marker(path, attributes) -> Column:
    """The inverse: a marker with its attributes, if any."""
    more = F.when(F.coalesce(c(attributes), F.lit("")) != "", F.concat(F.lit("|"), c(attributes))).otherwise("")
    return F.concat(F.lit("<!-- IMG: "), c(path), more, F.lit(" -->"))


def version_key(text) -> Column:
    """A version's numbers as an array that orders as versions do; null for none."""
    found = F.regexp_extract(c(text), r"^v?(\d+(?:\.\d+)*)", 1)
    numbers = F.transform(F.split(found, r"\."), lambda x: x.try_cast("int"))
    return F.when(found != "", F.slice(F.concat(numbers, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3))


def newer(a, b) -> Column:
    """Is version ``a`` newer than ``b``?  Null where either is none."""
    return version_key(a) > version_key(b)


def human_bytes(size) -> Column:
    """A size in bytes with its unit; null as ``?``."""
    n = c(size).cast("double")
    text = lambda v, u: F.concat(F.format_string("%.1f", v), F.lit(u))
    return F.when(n.isNull(), "?").when(n >= 1 << 30, text(n / (1 << 30), " Go")).when(n >= 1 << 20, text(n / (1 << 20), " Mo")).when(n >= 1 << 10, text(n / (1 << 10), " Ko")).otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(" o")))


def path_segment(text) -> Column:
    """One safe part of a path; null where nothing safe is left."""
    safe = F.regexp_replace(F.trim(c(text)), r"[\\/:*?\"<>|\x00-\x1F]+", "_")
    return F.when(~safe.isin("", ".", ".."), safe)


def strip_thinking(text) -> Column:
    """An answer without its reasoning, closed or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(c(text), r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*\z|\A.*</think>", ""))


def strip_fences(text) -> Column:
    """A text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(c(text), r"\A\s*```[^\n]*\n", ""), r"\n```\s*\z", "")


def merge_maps(base, over) -> Column:
    """Leaf by leaf union of two maps, the second winning; a null map is an empty one."""
    empty = F.create_map().cast("map<string,string>")
    b, o = F.coalesce(c(base), empty), F.coalesce(c(over), empty)
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)
