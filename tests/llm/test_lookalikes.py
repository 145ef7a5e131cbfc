import itertools
import random
import unicodedata

from lutrin.llm import lookalikes as L

ROWS = "bulle_id bigint, oeuvre string, tome string, ocr string, form string"


def _plain_look(t):
    """Brute force: every sign to its class, signs shared by both kana to one."""
    t = "".join(L._SIGNS.get(c, c) for c in t if c not in L._DROP)
    t = "".join(L._CLASS.get(c, c) for c in unicodedata.normalize("NFKD", t))
    t = unicodedata.normalize("NFC", t).translate(str.maketrans(L._EITHER_HIRA, L._EITHER_KANA))
    return t.replace("…", "...").rstrip()


def _pairs(spark, values):
    df = spark.createDataFrame([(k, "o", "v", t, "x") for k, t in enumerate(values)], ROWS)
    return {(r.cle_a, r.cle_b) for r in L.same_look_pairs(df, "bulle_id", "bulle_id", ["oeuvre", "tome"], "ocr").collect()}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["カルー", "ヤロ", "エリ", "終わり", "へ", "もう一度", "二世", "the", "café", "l'été", "…", "？", "!", "。", "a b", "ガ", "ニト", "12"]
    dress = [lambda t: t, lambda t: unicodedata.normalize("NFD", t), lambda t: t.replace("a", "а").replace("e", "е"), lambda t: t[:1] + chr(0x200B) + t[1:], lambda t: t.replace("ー", "一").replace("ロ", "口").replace("エ", "工"), lambda t: t.replace("一", "ー").replace("二", "ニ"), lambda t: t.replace("り", "リ").replace("へ", "ヘ"), lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t), lambda t: t.replace("…", "..."), lambda t: t.replace("'", chr(0x2019)), lambda t: t + chr(0xA0), lambda t: t.replace(" ", chr(0x3000))]
    base = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    values = [rng.choice(dress)(rng.choice(base)) for _ in range(220)]
    want = {(a, b) for a, b in itertools.combinations(range(len(values)), 2) if values[a] != values[b] and _plain_look(values[a]) == _plain_look(values[b])}
    assert want and _pairs(spark, values) == want


def test_what_looks_the_same_and_what_does_not(spark):
    a = chr(0xFF76) + chr(0xFF9E)
    assert _pairs(spark, [a + "ルー", "ガルー", "ガル一", "ガル", "カルー"]) == {(0, 1), (0, 2), (1, 2)}
    assert _pairs(spark, ["Ana", "ANA", "ana"]) == set()
    assert _pairs(spark, ["a\nb", "a b", "a・b", "a＝b"]) == set()
    assert _pairs(spark, ["mot", "m0t", "mo t", "mot ", "mot" + chr(0x2009)]) == {(0, 3), (0, 4), (3, 4)}
    assert _pairs(spark, ["!?", "！？", "?!"]) == {(0, 1)}
    assert _pairs(spark, ["Ana's clock", "Ana" + chr(0x2BC) + chr(0x455) + " clock", "終わりに", "終わ" + chr(0xFF98) + "に"]) == {(0, 1), (2, 3)}


def test_cases(spark):
    rows = [(1, "o", "v", None, ""), (2, "o", None, "a", ""), (3, None, "v", "a ", ""), (4, "o", "v", "", ""), (5, "o", "v", "  ", ""), (6, "p", "v", "x", ""), (7, "o", "v", "x ", ""), (8, "o", "w", "x", ""), (9, "o", "v", "é" * 30_000, ""), (10, "o", "v", unicodedata.normalize("NFD", "é" * 30_000), "")]
    df = spark.createDataFrame(rows, ROWS)
    got = {(r.cle_a, r.cle_b) for r in L.same_look_pairs(df, "bulle_id", "bulle_id", ["oeuvre", "tome"], "ocr").collect()}
    assert got == {(4, 5), (9, 10)}
    assert L.same_look_pairs(df.limit(0), "bulle_id", "bulle_id", ["oeuvre"], "ocr").count() == 0


def test_form_prefers_the_spelling_in_use(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["もう一度", "もう一度", "もうー度", "力ルーヤ", "カルーヤ", "ﬁn"])], "k bigint, t string")
    df = df.unionByName(df).withColumnRenamed("k", "key")  # rows that repeat
    odd, _ = L.consistent_forms(df, "key", "t")
    assert odd.count() == 6
    assert {r.text: r.form for r in odd.collect()} == {"もうー度": "もう一度", "力ルーヤ": "カルーヤ", "ﬁn": "fin"}


def test_automaton_charges_other_edits():
    trie = L.LookTrie([("valley", 3), ("volley", 1)], budget=1)
    assert {w for w, _ in trie.reach("vаlley")} == {"valley"}
    assert {w for w, _ in trie.reach("vlley")} == {"valley", "volley"}
    assert L.LookTrie([("valley", 3)]).reach("vlley") == []


def test_forms_of_both_fields(spark, tmp_path):
    spark.createDataFrame([(1, "o", "v", "カルーヤ", ""), (2, "o", "v", "力ルーヤ", ""), (3, "o", "v", None, "")], ROWS).write.parquet(f"{tmp_path}/bulles.parquet")
    spark.createDataFrame([(7, "o", ["エリ", "工リ", None]), (8, "o", None), (9, None, ["ﾏﾘ"])], "entree_id bigint, oeuvre string, termes_source array<string>").write.parquet(f"{tmp_path}/personnages.parquet")
    got = {(r.champ, r.cle, r.rang, r.forme) for r in L.p6_formes(spark, str(tmp_path)).collect()}
    terms = {(7, 0, "エリ"), (7, 1, "エリ"), (7, 2, None), (9, 0, "マリ")}
    assert got == {("bulles.ocr", 1, None, "カルーヤ"), ("bulles.ocr", 2, None, "カルーヤ"), ("bulles.ocr", 3, None, None)} | {("personnages.termes_source", *t) for t in terms}


def test_without_the_walk_look_alike_letters_stay_apart(spark, monkeypatch):
    """The trie decides: the table alone brings no letters of other scripts together."""
    values = ["valley", "v" + chr(0x430) + "lley", "カル一", "カルー", "ｖａｌｌｅｙ"]
    assert _pairs(spark, values) == {(0, 1), (0, 4), (1, 4), (2, 3)}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(values)], "key bigint, t string")
    assert {r.text: r.form for r in L.consistent_forms(df, "key", "t")[0].collect()} == {values[1]: "valley", values[2]: "カルー", values[4]: "valley"}
    assert {t: L.by_table(t) for t in values[1:3]} == {t: t for t in values[1:3]} and L.by_table(values[4]) == "valley"


def test_shards_follow_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TOKENS", 1)
    test_pairs_equal_brute_force(spark)


def test_entries_that_share_a_term_are_no_pair(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/bulles.parquet")
    rows = [(1, "o", ["エリ", "カルー"]), (2, "o", ["工リ", "カルー"]), (3, "o", ["工リ"]), (4, "o", None), (5, "o", [None, "エリ"])]
    spark.createDataFrame(rows, "entree_id bigint, oeuvre string, termes_source array<string>").write.parquet(f"{tmp_path}/personnages.parquet")
    assert {(r.cle_a, r.cle_b) for r in L.p6_found(spark, str(tmp_path)).collect()} == {(1, 3), (2, 5), (3, 5)}
