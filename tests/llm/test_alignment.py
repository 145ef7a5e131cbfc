import random
from collections import Counter

from lutrin.llm import alignment as A

SCHEMA = "passage_id bigint, unite string, langue string, rang int, texte string, place string"
_A, _B, _C = "ka ki ku ke ko ta chi tsu te to na ni nu ne no ma mi mu me mo ra ri ru re ro".split(), "カキクケコタチツテトナニヌネノマミムメモラリルレロ", "春夏秋冬山川海空星月花鳥風雨雪火水木金土石竹米糸虫"
EN = {"o": ["zan" + _A[i] + _A[-i] for i in range(25)], "p": ["pel" + _A[i] + _A[(7 * i) % 25] for i in range(25)], "n": [(_A[i] + _A[(3 * i) % 25] + "n").title() for i in range(25)]}
JA = {"o": [_C[i] + "具" + _C[-i] for i in range(25)], "p": [_C[i] + "場" + _C[(7 * i) % 25] for i in range(25)], "n": [_B[i] + _B[(3 * i) % 25] + "ン" for i in range(25)]}
FORMS = [("{n} hid the {o} near the {p}.", "{n}は{p}に{o}を隠した。"), ("Where is the {o} of {n}?", "{n}の{o}はどこだ？"), ("{n} counted {k} candles in the {p}.", "{n}は{p}で{k}本の蝋燭を数えた。"), ("The rain kept falling on the {p}.", "{p}には雨が降り続いていた。")]


def _sentence(rng):
    f, i, j, m, k = rng.randrange(len(FORMS)), rng.randrange(25), rng.randrange(25), rng.randrange(25), rng.randrange(2, 90)
    fill = lambda s, w: s.format(n=w["n"][m], o=w["o"][i], p=w["p"][j], k=k)
    return fill(FORMS[f][0], EN), fill(FORMS[f][1], JA)


def _units(n, seed):
    """Units with dropped, swapped and joined lines, and the pairs that are true."""
    rng, rows, true, key = random.Random(seed), [], set(), 0
    for u in range(n):
        pairs = [_sentence(rng) for _ in range(rng.randrange(8, 16))]
        order = list(range(len(pairs)))
        k = rng.randrange(len(order) - 1)
        order[k], order[k + 1] = order[k + 1], order[k]
        joined = rng.randrange(1, len(pairs) - 1)
        left, right = [], []
        for i, (en, _) in enumerate(pairs):
            if rng.random() > 0.06:
                left.append(([i], en))
        for i in order:
            if right and i == joined and rng.random() < 0.7:
                right[-1] = (right[-1][0] + [i], right[-1][1] + pairs[i][1])
            elif rng.random() > 0.06:
                right.append(([i], pairs[i][1]))
        ids: dict = {}
        for side, lines in (("en", left), ("ja", right)):
            for rank, (of, text) in enumerate(lines):
                rows.append((key, f"u{u}", side, rank, text, "x"))
                for i in of:
                    ids.setdefault(i, {}).setdefault(side, []).append(key)
                key += 1
        for i, both in ids.items():
            true |= {(min(a, b), max(a, b)) for a in both.get("en", []) for b in both.get("ja", [])}
    return rows, true


def test_recall_and_precision_on_known_pairs(spark):
    rows, true = _units(120, 12)
    rows += [(100_000, None, "en", 0, "lost", ""), (100_001, "u0", None, 0, "lost", ""), (100_002, "u0", "en", 99, "* * *", ""), (100_003, "u0", "ja", 99, None, ""), (100_004, "seul", "en", 0, "Where is the zanka of Kan?", ""), (100_005, "u0", "ja", None, "", "")]
    got = {(r.passage_a, r.passage_b) for r in A.aligned_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got & true) >= 0.95 * len(true), len(got & true) / len(true)
    assert len(got & true) >= 0.95 * len(got), len(got & true) / len(got)


def test_pairs_far_apart_in_a_long_unit(spark):
    """A third of a long unit stands at its other end, and a stretch of it is left out on one side."""
    rows, _ = _units(60, 5)
    rng, pairs = random.Random(8), {}
    while len(pairs) < 700:
        en, ja = _sentence(rng)
        if any(c.isdigit() for c in en):
            pairs.setdefault(en, ja)
    pairs, key, ids = list(pairs.items()), len(rows), {}
    order = [*range(230, 330), *range(480, 700), *range(230)]
    for side, of in (("en", range(700)), ("ja", order)):
        for rank, i in enumerate(of):
            rows.append((key, "long", side, rank, pairs[i][side == "ja"], "x"))
            ids[side, i] = key
            key += 1
    got = {(r.passage_a, r.passage_b) for r in A.aligned_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    true = {(ids["en", i], ids["ja", i]) for i in order}
    assert len(got & true) >= 0.9 * len(true), len(got & true) / len(true)


def test_units_joined_into_one_with_one_side_in_reverse_order(spark):
    """A unit of over 400 lines a side whose blocks stand in reverse order on one side keeps its pairs."""
    rows, true = _units(160, 31)
    merged = {f"u{k}" for k in range(40)}
    place = {u: k for k, u in enumerate(sorted(merged))}
    out = []
    for key, unit, side, rank, text, x in rows:
        if unit in merged:
            block = place[unit] if side == "en" else len(merged) - place[unit]
            out.append((key, "long", side, block * 100 + rank, text, x))
        else:
            out.append((key, unit, side, rank, text, x))
    text = {r[0]: r[4] for r in out if r[1] == "long"}
    times = Counter(text.values())
    # a sentence that stands in several places has several right renderings: only the others tell
    want = {p for p in true if p[0] in text and times[text[p[0]]] == 1}
    got = {(r.passage_a, r.passage_b) for r in A.aligned_lines(spark.createDataFrame(out, SCHEMA)).collect()}
    assert len(text) > 800 and len(want) > 250 and len(got & want) >= 0.95 * len(want), len(got & want) / len(want)


def test_empty_table(spark):
    assert A.aligned_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces():
    assert A.pieces_of("Non, dit-il, puis la pluie tomba. Où ?") == ["Non, dit-il", "la pluie tomba.", "Où ?"]
    assert A.tokens_of("Les 12 feux !") == ["les", "#12", "feux", "!"]
