import random

import pytest
from pyspark.sql import functions as F

from lutrin.llm import mixing


def _documents(spark, sizes):
    rows, k = [], 0
    for source, counts in sizes.items():
        for n in counts:
            rows.append((k, "mot " * n if n is not None else None, source, "x"))
            k += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, melange string")


def _targets(spark, rows):
    return spark.createDataFrame(rows, "melange string, source string, part_cible double, repetitions_max int")


def test_apportionment_equals_seat_by_seat(spark):
    rng = random.Random(5)
    for _ in range(5):
        units = [(u, rng.random(), rng.randrange(0, 30)) for u in "abcdef"]
        seats = min(40, sum(c for _, _, c in units))
        df = spark.createDataFrame([("m", u, w, c, seats) for u, w, c in units], "g string, u string, w double, cap int, seats int")
        got = {r.u: r.out for r in mixing._apportion(df, ["g"], "u", "w", "cap", "seats", "out").collect()}
        won = dict.fromkeys((u for u, _, _ in units), 0)
        for _ in range(seats):
            u = max(((w / (2 * won[u] + 1), -ord(u), u) for u, w, c in units if won[u] < c))[2]
            won[u] += 1
        assert got == won


def test_shares_caps_and_report(spark, vocabulary):
    docs = _documents(spark, {"a": [10] * 50 + [0, None], "b": [5] * 30, "rare": [8] * 4, None: [9] * 5})
    targets = _targets(spark, [("m", "a", 0.5, 1), ("m", "b", 0.25, 2), ("m", "rare", 0.1, 3), ("m", "absent", 0.15, 2), ("n", "a", 1.0, None), ("n", "b", None, 1), (None, "a", 0.5, 1)])
    records, report = mixing.mix_sources(docs, targets, blocks=400, directory=vocabulary)
    rows, rep = records.collect(), {(r.melange, r.source): r for r in report.collect()}
    caps = {("m", "a"): 1, ("m", "b"): 2, ("m", "rare"): 3, ("n", "a"): 1}
    assert all(1 <= r.repetitions <= caps[r.melange, r.source] for r in rows)
    assert len({(r.melange, r.doc_id) for r in rows}) == len(rows)
    assert rep["m", "absent"].part_reelle == 0 and rep["m", "absent"].tokens_pris == 0
    for s in ("a", "b", "rare"):
        r = rep["m", s]
        assert abs(r.part_reelle - r.part_visee) < 0.05
        assert r.tokens_pris == sum(x.n_tokens * x.repetitions for x in rows if (x.melange, x.source) == ("m", s))
    assert abs(rep["n", "a"].part_reelle - 1) < 1e-9 and ("n", "b") not in rep
    again = mixing.mix_sources(docs, targets, blocks=400, directory=vocabulary)[0].collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_a_total_bounds_the_set(spark, vocabulary):
    docs = _documents(spark, {"a": [10] * 100, "b": [10] * 100})
    records, _ = mixing.mix_sources(docs, _targets(spark, [("m", "a", 0.75, 1), ("m", "b", 0.25, 1)]), blocks=100, total_tokens=400, directory=vocabulary)
    size = {r.source: r.n for r in records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repetitions")).alias("n")).collect()}
    assert size["a"] == pytest.approx(300, abs=11) and size["b"] == pytest.approx(100, abs=11)


def test_empty_tables(spark, vocabulary):
    docs, targets = _documents(spark, {"a": [3]}), _targets(spark, [("m", "a", 1.0, 1)])
    assert mixing.mix_sources(docs.limit(0), targets, directory=vocabulary)[0].count() == 0
    assert mixing.mix_sources(docs, targets.limit(0), directory=vocabulary)[1].count() == 0


def test_repeated_rows_are_one_record(spark, vocabulary):
    docs = _documents(spark, {"a": [10] * 20})
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "mot mot", "a", "x")], docs.schema))
    records, _ = mixing.mix_sources(twice, _targets(spark, [("m", "a", 1.0, 1)]), blocks=20, directory=vocabulary)
    rows = records.collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 20 and {r.repetitions for r in rows} == {1}


@pytest.mark.parametrize("shard_rows", [2_000, 20])
def test_more_shards_than_blocks(spark, vocabulary, shard_rows):
    docs = _documents(spark, {"a": [10] * 2_000, "b": [50] * 400})
    records, report = mixing.mix_sources(docs, _targets(spark, [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)]), blocks=40, shard_rows=shard_rows, directory=vocabulary)
    rep = {r.source: r for r in report.collect()}
    assert abs(rep["a"].part_reelle - 0.5) < 0.005 and rep["a"].tokens_pris + rep["b"].tokens_pris >= 0.99 * 40_000


def test_what_a_long_record_leaves_is_filled_by_others(spark, vocabulary):
    """Shares hold although the seeded order meets records longer than a quota's rest."""
    rng = random.Random(3)
    docs = _documents(spark, {"a": [rng.choice((5, 9, 30, 400)) for _ in range(120)], "b": [7] * 300})
    total = 1_500
    _, report = mixing.mix_sources(docs, _targets(spark, [("m", "a", 0.6, 1), ("m", "b", 0.4, 1)]), total_tokens=total, directory=vocabulary)
    rep = {r.source: r for r in report.collect()}
    assert abs(rep["a"].tokens_pris - 900) <= 5 and abs(rep["b"].tokens_pris - 600) <= 4


def test_repeated_keys_that_differ_count_as_the_least(spark, vocabulary):
    docs = spark.createDataFrame([(1, "mot " * 9, "a", ""), (1, "mot " * 3, "a", ""), (2, "mot " * 5, "a", "")], "doc_id bigint, text string, source string, melange string")
    records, _ = mixing.mix_sources(docs, _targets(spark, [("m", "a", 1.0, 1)]), directory=vocabulary)
    small = mixing.token_counts(docs, "text", ["doc_id"], directory=vocabulary).where("doc_id = 1").agg(F.min("n_tokens")).first()[0]
    assert {r.doc_id: r.n_tokens for r in records.collect()}[1] == small
