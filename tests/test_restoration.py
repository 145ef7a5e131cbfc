import random

from pyspark.sql import functions as F

from lutrin.operators import restoration as R

A, B = "<!-- IMG: a.png -->", "<!-- IMG: b.png|width=1in -->"


def _one(spark, expr, **values):
    """The value of an expression over one row of the given values."""
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_paragraphs_keep_markers_and_headings_apart(spark):
    assert _one(spark, R.paragraphs(F.col("t")), t=f"# T\nun\ndeux\n{A}\n\n\n trois") == ["# T", "un\ndeux", A, "trois"]
    assert _one(spark, R.paragraphs(F.col("t")), t="") == []


def test_markers_come_back_as_they_were(spark):
    rng, rows = random.Random(1), []
    for k in range(60):
        units = [rng.choice([A, B, None]) or f"p{i}" for i in range(rng.randrange(1, 12))]
        bare = "\n\n".join(u for u in units if u not in (A, B))
        text = "\n\n".join(units)
        rows += [(k, text, out, bare) for out in (bare, text, text + A + B, bare + "\n\n" + B)]
    df = spark.createDataFrame(rows, "k int, text string, out string, bare string")
    for r in df.select("*", R.with_markers_of(F.col("text"), F.col("out")).alias("kept")).collect():
        found = lambda t: sorted(t.count(m) for m in (A, B))
        assert found(r.kept) == found(r.text), r
    places = R.marker_places(df.dropDuplicates(["k"]), "k", "text").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rang", "part", "marqueur"))).alias("p"))
    for r in df.dropDuplicates(["k"]).join(places, "k").select("text", R.placed_markers(F.col("bare"), F.col("p")).alias("back")).collect():
        assert r.back == r.text


def test_headings_that_came_back_in_bold(spark):
    got = _one(spark, R.restored_headings(F.col("o"), F.col("t")), o="# Un\n\nx\n\n## Deux\n\n## Drei", t="**One**\n\nx\n**Two** \n\n**Three**\n# Four")
    assert got == "## One\n\nx\n## Two\n\n**Three**\n# Four"
    assert _one(spark, R.restored_headings(F.col("o"), F.col("t")), o="x", t="**One**") == "**One**"


def test_numbered_replies(spark):
    rows = [(1, "bla\n1. un\n suite\n3) trois\n1. encore\n9. hors\nperdu", 3), (2, "a\n\nb", 3), (3, "", 2), (4, None, 2), (5, "1. a\n\n2 - b", 2)]
    got = {r.k: (r.slots, r.lecture) for r in R.numbered_slots(spark.createDataFrame(rows, "k int, t string, n int"), "k", "t", "n").collect()}
    assert got == {1: (["un suite", "", "trois"], "numeros"), 2: (["a", "b", ""], "lignes"), 3: (["", ""], "lignes"), 5: (["a", "b"], "numeros")}


def test_arrays_and_words(spark):
    assert _one(spark, R.dealt(F.split(F.lit("a,b,c,d,e"), ","), F.array(*map(F.lit, (2, 1, 4))))) == [["a", "b"], ["c"], ["d", "e", "", ""]]
    assert _one(spark, R.without_number(F.lit("2. 2. mot"), 3)) == "mot" and _one(spark, R.without_number(F.lit("12. mot"), 3)) == "12. mot"
    case = lambda a, b: _one(spark, R.match_case(F.lit(a), F.lit(b)))
    assert case("Été", "hiver") == "Hiver" and case("été", "Hiver") == "Hiver" and case("", "x") == "x"
    readings = F.array(*(F.struct(F.lit(e).alias("fin"), F.lit(t).alias("lecture")) for e, t in ((5, "かな"), (2, "かんじ"), (99, "?"))))
    assert _one(spark, R.with_readings(F.lit("漢字と仮名"), readings)) == "漢字(かんじ)と仮名(かな)"


def test_replies_and_narration(spark):
    rows = [(1, "— Où est-il ?"), (2, "Il dit « viens vite ici » et rit du « non »."), (3, "「灯台の近くで待て」"), (4, ""), (5, "# T\n\nIl dort.\n\n" + A), (6, "« Non ! » dit-elle. “oui”")]
    got = {r.k: (r.repliques, r.recits) for r in R.dialogue(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got == {1: (1, 0), 2: (1, 2), 3: (1, 0), 4: (0, 0), 5: (0, 1), 6: (1, 1)}
