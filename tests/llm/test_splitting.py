import random

import pytest

from lutrin.llm import bpe, splitting

PROFILES = [("s", 16, 0), ("m", 32, 8), ("l", 128, 32)]


def _split(spark, vocabulary, texts, profiles=PROFILES):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, rang string")
    out: dict = {}
    for r in splitting.split_texts(df, profiles, directory=vocabulary).collect():
        out.setdefault((r.profil, r.doc_id), []).append(r)
    return {k: sorted(v, key=lambda r: r.rang) for k, v in out.items()}


def test_pieces_cover_the_text_within_the_limit(spark, vocabulary):
    enc = bpe.load(bpe.vocabulary_path("byte_bpe_50k", vocabulary))
    rng = random.Random(6)
    pool = ["Une phrase. ", "mot ", "\n\n", "\n", "# Titre\n", "猫が好き。", "🙂", "x" * 60, "…", "\r\n", "é", "　"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 120))) for _ in range(40)] + [None, "", " ", "court", "a" * 5_000, "猫" * 400, "🙂" * 200, "word " * 3_000]
    pieces = _split(spark, vocabulary, texts)
    for k, t in enumerate(texts):
        n = len(enc.encode(t)) if t else 0
        for name, limit, overlap in PROFILES:
            got = pieces.get((name, k), [])
            assert bool(got) == (n > limit)
            if not got:
                continue
            assert [r.rang for r in got] == list(range(len(got))) and got[0].debut == 0 and got[-1].fin == n
            assert all(0 < r.n_tokens <= limit and "�" not in r.texte for r in got)
            assert all(enc.count(r.texte) <= limit for r in got)
            for a, b in zip(got, got[1:]):
                assert overlap <= a.fin - b.debut <= overlap + 3 and a.fin < b.fin
            if overlap == 0:
                assert "".join(r.texte for r in got) == t


def test_cuts_are_natural_where_they_can_be(spark, vocabulary):
    text = "\n\n".join("Une phrase de plus. Une autre encore." for _ in range(12))
    got = _split(spark, vocabulary, [text])["s", 0]
    assert {r.niveau for r in got[:-1]} == {"paragraphe"} or {r.niveau for r in got[:-1]} <= {"paragraphe", "phrase"}
    got = _split(spark, vocabulary, ["mot " * 300])["m", 0]
    assert {r.niveau for r in got[:-1]} == {"mot"}
    got = _split(spark, vocabulary, ["x1" * 3_000])["m", 0]
    assert {r.niveau for r in got[:-1]} == {"caractere"}


def test_limits_and_empty_tables(spark, vocabulary):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert splitting.split_texts(df, PROFILES, directory=vocabulary).count() == 0
    assert splitting.split_texts(df, [], directory=vocabulary).count() == 0
    nameless = spark.createDataFrame([(None, "mot " * 40), (None, "mot " * 40)], "doc_id bigint, text string")
    assert {r.doc_id for r in splitting.split_texts(nameless, PROFILES, directory=vocabulary).collect()} == {None}
    with pytest.raises(ValueError):
        splitting.split_texts(df, [("z", 4, 0)], directory=vocabulary)
    # an overlap that leaves no room is reduced, and the text still ends
    got = _split(spark, vocabulary, ["mot " * 200], [("o", 16, 16), ("n", 16, None)])
    assert got["o", 0][-1].fin == got["n", 0][-1].fin
