from pyspark.sql import functions as F

from lutrin.functions import text as T


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column("t").alias("x")).first().x


def test_token_estimate(spark):
    assert _one(spark, "abcd" * 3, T.token_estimate) == 3
    assert _one(spark, "猫がabcd", T.token_estimate) == 3
    assert _one(spark, "", T.token_estimate) == 0
    assert _one(spark, None, T.token_estimate) is None


def test_word_count_counts_ideographs_by_half(spark):
    assert _one(spark, "l'été a 3 jours", T.word_count) == 4
    assert _one(spark, "猫が好き", T.word_count) == 2
    assert _one(spark, "（）", T.word_count) == 0


def test_norm_key_keeps_voiced_kana(spark):
    assert _one(spark, "  L'Été—Noir ", T.norm_key) == "l ete noir"
    assert _one(spark, "バ", T.norm_key) != _one(spark, "ハ", T.norm_key)


def test_output_cap_has_floor_and_ceiling(spark):
    assert _one(spark, "a", T.output_cap) == 768
    assert _one(spark, "猫" * 9000, T.output_cap) == 6000
    assert _one(spark, None, T.output_cap) is None


def test_natural_key_orders_numbers(spark):
    rows = spark.createDataFrame([("Page 10",), ("Page 2",), ("Page 2b",), ("page 1",)], "t string")
    assert [r.t for r in rows.orderBy(T.natural_key("t")).collect()] == ["page 1", "Page 2", "Page 2b", "Page 10"]


def test_excerpt_marks_what_is_cut(spark):
    row = spark.createDataFrame([("x" * 50 + "NEEDLE" + "y" * 50,)], "t string").select(T.excerpt("t", F.instr("t", "NEEDLE"), 6).alias("e")).first()
    assert row.e == "…" + "x" * 28 + "NEEDLE" + "y" * 28 + "…"


def test_ordered_replacement_feeds_later_pairs(spark):
    row = spark.createDataFrame([("foo",)], "t string").select(T.replace_all("t", [("foo", "bar"), ("bar", "qux")]).alias("e")).first()
    assert row.e == "qux"
