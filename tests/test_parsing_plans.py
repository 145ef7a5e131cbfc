import pytest
from pyspark.sql import functions as F

from lutrin import registry
from lutrin.functions import parsing as P
from lutrin.plans import stages


def _col(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, t {kind}")
    return [r.x for r in rows.select("k", fn("t").alias("x")).orderBy("k").collect()]


def test_switches_lists_and_versions(spark):
    assert _col(spark, ["Oui", "non ", "?", None, "1"], P.tri_state) == [True, False, None, None, True]
    assert _col(spark, ["a, b et c", "x (y, z); w", "aucun", "", None, "a/a"], P.split_list) == [["a", "b", "c"], ["x (y, z)", "w"], [], [], None, ["a", "a"]]
    assert _col(spark, ["v1.10.2", "2", "x", None], P.version_key) == [[1, 10, 2], [2, 0, 0], None, None]
    assert _col(spark, ["1.10", "1.9.9"], lambda t: P.newer(t, F.lit("1.9.10"))) == [True, False]


def test_markers_round_trip(spark):
    rows = spark.createDataFrame([("a.png|w=1", 0), ("b.png", 1)], "t string, k int").select("k", P.split_marker("t").alias("m")).select("k", P.make_marker(F.col("m.chemin"), F.col("m.attributs")).alias("x"))
    assert [r.x for r in rows.orderBy("k").collect()] == ["<!-- IMG: a.png|w=1 -->", "<!-- IMG: b.png -->"]


def test_sizes_paths_and_answers(spark):
    assert _col(spark, [None, 5, 2048, 5 << 20, 3 << 30], P.human_bytes, "bigint") == ["?", "5 o", "2.0 Ko", "5.0 Mo", "3.0 Go"]
    assert _col(spark, ["a/b", "..", " ", None, "Vol.1"], P.path_segment) == ["a_b", None, None, None, "Vol.1"]
    assert _col(spark, ["<think>x</think> oui", "<think>x", "reste</think>non", "ok", None], P.strip_thinking) == ["oui", "", "non", "ok", None]
    assert _col(spark, ["```md\ntexte\n```", "texte"], P.strip_fences) == ["texte", "texte"]


def test_maps_merge_leaf_by_leaf(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"x": "1"}), ({"y": "1"}, None)], "a map<string,string>, b map<string,string>")
    assert [r.m for r in rows.select(P.merge_maps("a", "b").alias("m")).collect()] == [{"a": "1", "b": "3"}, {"x": "1"}, {"y": "1"}]


def test_stages_to_redo(spark):
    every = sorted(stages.closure())
    units = spark.createDataFrame([(1, every, False, None), (2, every, True, None), (3, every, None, "traduction"), (4, [e for e in every if e != "ocr"], False, "?"), (5, None, False, None)], "unite int, presentes array<string>, force boolean, depuis string")
    got: dict = {}
    for r in stages.stages_to_redo(spark, units).collect():
        got.setdefault(r.unite, set()).add(r.etape)
    assert got == {2: set(every), 3: {"traduction", "rendu"}, 4: {"ocr", "terminologie", "traduction", "rendu"}, 5: set(every)}
    with pytest.raises(ValueError):
        stages.closure([("a", "b"), ("b", "a")])


def test_signatures_and_settings(spark):
    fresh = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "unite int, signature string")
    stored = spark.createDataFrame([(1, "x"), (2, "other"), (3, None)], "unite int, signature string")
    assert {r.unite: r.etat for r in stages.adopt_signatures(stored, fresh).collect()} == {1: "garde", 2: "jete", 3: "adopte"}
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "nom string")
    assert [tuple(r) for r in stages.unknown_settings(names("seui", "actif"), names("actif", "seuil")).collect()] == [("seui", "seuil")]
    assert stages.unknown_settings(names("a"), names("b").limit(0)).count() == 1


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"stream_progress", "stream_windows"}))
def test_no_query_compares_all_with_all(spark, data, name):
    assert stages.quadratic_joins(registry.queries()[name](spark, data)) == []


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = stages.plan_of(registry.queries()["first_failure_reason"](spark, data))
    assert "PushedFilters: [IsNotNull(ocr)]" in plan and "taille_police" not in plan
