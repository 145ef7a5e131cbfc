import itertools
import random

from lutrin.llm import names as N

SCHEMA = "entree_id bigint, oeuvre string, nom string, variantes array<string>, termes_source array<string>, dit string"


def _linked(spark, rows):
    df = spark.createDataFrame([(k, o, n, v, t, "x") for k, (o, n, v, t) in enumerate(rows)], SCHEMA)
    groups: dict = {}
    for r in N.same_characters(df).collect():
        groups.setdefault((r.oeuvre, r.perso), set()).add(r.entree)
    return {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}


def test_variants_of_one_person(spark):
    rows = [
        ("o", "Garbane Dunique", [], ["ガルベイン・ドゥニーク"]), ("o", "Duniqte Garbane", None, []), ("o", "G. Dunique", [], ["ガルベイン・ドゥニーク"]), ("o", "Garie", ["Garbane Dunique"], None),
        ("o", None, [], ["ガルベイン＝ドゥニーク"]), ("o", "Capitaine Garbane Dunique", [], []), ("o", "GARBANE DUNIQUE", [], []), ("o", "Dunique, Garbane", [], []),
        ("o", "Garroupin Dunique", [], ["ガルルーパン・ドゥニーク"]), ("o", "Garbane Dunique le Jeune", [], ["ガルベイン・ドゥニーク二世"]),
        ("p", "Garbane Dunique", [], ["ガルベイン・ドゥニーク"]), (None, "Garbane Dunique", [], []), ("o", "", [], []), ("o", None, None, None),
    ]
    same = set(itertools.combinations(range(8), 2))
    assert _linked(spark, rows) == same


def test_close_names_with_other_sources_stay_apart(spark):
    rows = [("o", "Melric Tolan", [], ["メルリック・トラン"]), ("o", "Melrin Tolan", [], ["メルリン・トラン"]), ("o", "Kanorko", [], ["カノルコ"]), ("o", "Kanolko", [], ["カノルコ"]), ("o", "Kanorko", [], [])]
    assert _linked(spark, rows) == {(2, 3), (2, 4), (3, 4)}


def test_identical_entries_and_hot_works(spark):
    rows = [("o", "Ana Belro", [], [])] * 40 + [(f"w{k % 7}", "Ana Belro", [], []) for k in range(14)]
    got = _linked(spark, rows)
    assert len(got) == 40 * 39 // 2 + 7


def test_empty_table(spark):
    assert N.same_characters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_delete_index_finds_every_single_edit():
    rng = random.Random(10)
    letters = "abcdefgh"
    for _ in range(2_000):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(4, 9)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + rng.choice(letters) + a[i:], a[:i] + rng.choice(letters) + a[i + 1 :], a[:i] + a[i + 1 : i + 2] + a[i] + a[i + 2 :]])
        if len(b) > 3:
            assert N.deletes(a) & N.deletes(b), (a, b)


def _meet(a, b):
    """Would the index bring two entries together?"""
    for x in N.anchors_of(a):
        for y in N.anchors_of(b):
            kx, ky = N.keys_of(x), N.keys_of(y)
            meet = lambda p, q: {k[0].lower() + k[1:] if k[0] in "NO" else k for k in p if k[0] not in "no"} & {k for k in q if k[0] not in "NO"}
            if x == y or ((meet(kx, ky) or meet(ky, kx)) and N.neighbours(x, y)):
                return True
    return False


def test_the_index_loses_no_pair_that_would_be_linked():
    rng = random.Random(21)
    given, family = ["Garbane", "Melric", "Bertrando", "Ana", "Philippine", "Li"], ["Dunique", "Tolan", "Rossi", "Vandermeulen", "Wen"]

    def spoilt(t, n):
        for _ in range(n):
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice("aeinrst") + t[i:], t[:i] + rng.choice("aeinrst") + t[i + 1 :]]) or t
        return t

    def name():
        g, f = rng.choice(given), rng.choice(family)
        g = rng.choice([g, spoilt(g, 1), spoilt(g, 2), g[0] + ".", g[:4], g[:3] + "ou"])
        f = rng.choice([f, spoilt(f, 1), spoilt(f, 2)])
        return rng.choice([f"{g} {f}", f"{f}, {g}", g, f, f"Capitaine {f}", f"{g} de la {f}"])

    linked = 0
    for _ in range(6_000):
        a, b = N.parse_entry(name(), [name()] if rng.random() < 0.3 else [], []), N.parse_entry(name(), [], [])
        if N.pair_score(a, b) >= N.LIKELY:
            linked += 1
            assert _meet(a, b), (a, b)
    assert linked > 100


def test_assignment_is_optimal_for_any_number_of_tokens():
    rng = random.Random(22)
    for _ in range(300):
        n = rng.randrange(1, 6)
        m = rng.randrange(n, 7)
        gain = [[rng.choice((0, 0.4, 0.5, 0.7, 0.85, 1.0)) for _ in range(m)] for _ in range(n)]
        chosen = N.assignment(gain)
        assert len(set(chosen)) == n
        best = max(sum(gain[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert abs(sum(gain[i][j] for i, j in enumerate(chosen)) - best) < 1e-9
    names = [N.parse_name(x)[0] for x in ("ana bela cora dina rossi", "ana bela cora dina weber", "rossi dina cora bela ana")]
    assert N.name_score([names[0], False], [names[1], False]) == 0.0 and N.name_score([names[0], False], [names[2], False]) == 0.92


def test_hot_tokens_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 3)
    rows = [("o", f"{g} Dunique", [], []) for g in ("Garbane", "Melric", "Ana", "Bertrand", "Céline", "Odile", "Ursule", "Yvonne", "Kevran")] + [("o", "Duniqe, Melric", [], []), ("o", "Bertrant Dunique", [], [])]
    assert _linked(spark, rows) == {(1, 9), (3, 10)}


def test_components_of_long_chains(spark):
    nodes = spark.range(60).toDF("id")
    links = spark.createDataFrame([(k, k + 1) for k in range(39)] + [(50, 55), (55, 50)], "a bigint, b bigint")
    got = {r.id: r.core for r in N.components(nodes, links).collect()}
    assert all(got[k] == 0 for k in range(40)) and got[55] == 50 and got[45] == 45
