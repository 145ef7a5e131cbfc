"""The coverage page: a join is listed once, and as built only where a query does the whole of it."""

import os
import re

PAGE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "COVERAGE.md")
#: What no query does: re-split chapters, groups of boxes, pairs of vectors.
OPEN = {17, 18, 27, 28, 31, 37, 38}


def _joins(built):
    out = []
    with open(PAGE, encoding="utf-8") as f:
        section = f.read().split("## Joins")[1].split("##")[0]
    for row in re.findall(r"^\| (.+) \|$", section, re.M)[1:]:
        first, second = row.split(" | ", 1)
        if (first != "not built") == built:
            cell = second.split("(")[0] if first == "not built" else first
            for a, b in re.findall(r"(\d\d)(?: to (\d\d))?", cell):
                out += range(int(a), int(b or a) + 1)
    return out


def test_joins_are_listed_once_and_open_ones_as_not_built():
    built, missing = _joins(True), _joins(False)
    assert sorted(built + missing) == list(range(1, 53))
    assert set(missing) >= OPEN


def test_every_query_named_as_built_is_registered():
    from lutrin import registry

    with open(PAGE, encoding="utf-8") as f:
        rows = [r for r in re.findall(r"^\| (.+) \|$", f.read(), re.M) if not r.startswith("not built")]
    named = {q for r in rows for part in re.findall(r"quer(?:y|ies) ((?:`\w+`(?:, )?)+)", r) for q in re.findall(r"`(\w+)`", part)}
    assert len(named) > 100 and not {q for q in named if not re.match(r"p\d_", q)} - set(registry.queries())
