import base64
import random
import time

import pytest

from lutrin.llm import bpe, encoding


@pytest.fixture(scope="module")
def enc(vocabulary):
    return bpe.load(bpe.vocabulary_path("byte_bpe_50k", vocabulary))


@pytest.fixture(scope="module")
def reference(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{vocabulary}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_plain_merging_on_random_texts(enc, reference):
    rng = random.Random(4)
    pool = ["a", "b", "the", "ing", " ", "  ", "\n", "\r\n", "é", "日本", "ﬁ", "🙂", "…", "'s", "1", "=" * 9, "x" * 33, "​", "\x1c", "<|endoftext|>"]
    for _ in range(2_000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))
        assert enc.encode(t) == reference.encode_ordinary(t)


def test_decoding_gives_the_text_back(enc):
    for t in ("", " ", "L'été — 漢字 🙂\r\n", "a" * 500, "\n\n\n x"):
        assert enc.decode(enc.encode(t)) == t


def test_slices_inside_a_piece_are_encodings(enc):
    ids = enc.encode_bytes(("unbrokenrun" * 40).encode())
    for k in range(0, len(ids), 7):
        part = enc.decode_bytes(ids[:k])
        assert part == b"" or enc.encode_bytes(part) == ids[:k]


def test_long_unbroken_runs_stay_linear(enc):
    sizes = []
    for n in (20_000, 80_000):
        t = time.process_time()
        enc.encode_bytes(b"ab" * n)
        sizes.append(time.process_time() - t)
    assert sizes[1] < 12 * max(sizes[0], 0.01)


def test_encode_texts_cases(spark, vocabulary, enc):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", None), (4, "Bonjour", "x"), (4, "Bonjour", "x")], "doc_id bigint, text string, ids string")
    rows = encoding.encode_texts(df, "doc_id", "text", directory=vocabulary)
    got = sorted((r.doc_id, list(r.ids)) for r in rows.collect())
    assert got == [(1, []), (2, []), (3, enc.encode(" ")), (4, enc.encode("Bonjour")), (4, enc.encode("Bonjour"))]
    back = encoding.decode_ids(rows, "doc_id", "ids", directory=vocabulary)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "", 2: "", 3: " ", 4: "Bonjour"}
    assert encoding.encode_texts(df.limit(0), "doc_id", "text", directory=vocabulary).count() == 0
    sizes = {r.doc_id: r.n_tokens for r in encoding.token_counts(df, "text", ["doc_id"], directory=vocabulary).collect()}
    assert sizes == {1: 0, 2: 0, 3: 1, 4: len(enc.encode("Bonjour"))}


def test_whole_table(spark, data, reference):
    rows = encoding.p7_ids(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    assert all(list(r.ids) == (reference.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []) for r in rows)
