"""Population statistics: quantiles by index, rates, separation, weighted modes, gap clusters, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.session import running, table


def counted(df: DataFrame, by: list[str], value: str, *more: Column) -> DataFrame:
    """``by, value, k, cum, n``: every distinct value with its count, the count up to it and the group's count.

    Values are counted before anything is ordered, and the running counts are put together from parts, so no
    group is sorted or held in one task.  ``more`` are further aggregates per value.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"), *more)
    total = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    cum = running(per, by, [F.col(value)], F.col("k"), "cum")
    same = None
    for c in by:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if same is None else same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return cum.alias("a").join(total.alias("b"), same).select("a.*", "b.n")


def at_index(value: str, index: Column) -> Column:
    """Aggregate over counted values: the value at a 0-based place of the ordered population."""
    return F.min(F.when(F.col("cum") > index, F.col(value)))


def percentile(value: str, p: float) -> Column:
    """Aggregate over counted values: the percentile between the two nearest places."""
    place = F.lit(p) * (F.col("n") - 1)
    low, high = at_index(value, F.floor(place)), at_index(value, F.ceil(place))
    part = F.max(place - F.floor(place))
    return low + (high - low) * part


def index_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Quantiles that are values of the population: the one at 0-based ``min(n - 1, floor(p n))``."""
    pick = [at_index(value, F.least(F.col("n") - 1, F.floor(F.col("n") * p))).alias(name) for name, p in points.items()]
    return counted(df, by, value).groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("mini"), *pick, F.max(value).alias("maxi"))


def separation(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by mean ranks over ties; null where a side is empty."""
    rows = counted(df.select(*by, value, positive.alias("p")), by, value, F.count_if("p").alias("hits"))
    rank = F.col("cum") - (F.col("k") - 1) / 2
    a, b = F.sum("hits"), F.sum(F.col("k") - F.col("hits"))
    return rows.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("hits") * rank) - a * (a + 1) / 2, a * b), 6).alias("auc"), a.alias("na"), b.alias("nb"))


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Most weighty value per group; under 15 % of the weight, the weighted median instead."""
    per = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*by)
    cum = per.withColumn("tout", F.sum("w").over(w)).withColumn("cumul", F.sum("w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    out = cum.groupBy(*by).agg(F.max(F.struct("w", F.negative(value).alias("moins"))).alias("m"), F.max("tout").alias("tout"), F.min(F.when(F.col("cumul") * 2 >= F.col("tout"), F.col(value))).alias("mediane"))
    return out.select(*by, F.when(F.col("m.w") >= F.col("tout") * 0.15, F.negative("m.moins")).otherwise(F.col("mediane")).alias("mode"), "tout")


def gap_clusters(df: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """Groups of values no further than ``gap`` from their neighbour: ``groupe, moyenne, n``."""
    w = Window.partitionBy(*by).orderBy(value)
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    rows = rows.withColumn("groupe", F.sum(F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)).over(w))
    return rows.groupBy(*by, "groupe").agg(F.round(F.sum(F.col(value) * F.col("k")) / F.sum("k"), 6).alias("moyenne"), F.sum("k").alias("n"), F.min(value).alias("bas"), F.max(value).alias("haut"))


def dominant_value(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per key; ties go to the one met first."""
    per = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("premier"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "premier", value)
    return per.withColumn("r", F.row_number().over(w)).where("r = 1").select(*by, value, "n")


def q_custom_quantiles(s, d):
    return index_quantiles(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"mediane": 0.5, "p90": 0.9, "p99": 0.99})


def q_linear_percentiles(s, d):
    return counted(table(s, d, "orders"), ["o_orderpriority"], "o_totalprice").groupBy("o_orderpriority").agg(*[F.round(percentile("o_totalprice", p), 6).alias(f"p{int(p * 100)}") for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)])


def q_auc_separation(s, d):
    return separation(table(s, d, "bulles").where("canal IS NOT NULL"), ["canal"], "score", F.coalesce(F.col("debordement"), F.lit(False)))


def q_judge_verdict(s, d):
    """Two populations of bubbles per channel: does the gap of medians reach the spread, and the AUC 0.80?"""
    b = table(s, d, "bulles").where("canal IS NOT NULL AND score IS NOT NULL").withColumn("haut", F.coalesce(F.col("debordement"), F.lit(False)))
    auc = separation(b, ["canal"], "score", F.col("haut"))
    half = counted(b, ["canal", "haut"], "score").groupBy("canal", "haut").agg(percentile("score", 0.5).alias("m"))
    middle = half.groupBy("canal").agg(F.max(F.when(F.col("haut"), F.col("m"))).alias("mh"), F.max(F.when(~F.col("haut"), F.col("m"))).alias("mb"))
    med = b.groupBy("canal").agg(F.stddev_samp(F.when(~F.col("haut"), F.col("score"))).alias("sd")).join(middle, "canal")
    verdict = F.when(F.col("auc").isNull(), "non mesure").when((F.col("mh") - F.col("mb") >= F.col("sd")) & (F.col("auc") >= 0.8), "utilisable").otherwise("inutilisable")
    return med.join(auc, "canal").select("canal", F.round("mh", 6).alias("mh"), F.round("mb", 6).alias("mb"), "auc", verdict.alias("verdict"))


def q_weighted_mode_size(s, d):
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL").select("oeuvre", "taille_police", F.length("traduction").cast("bigint").alias("poids"))
    return weighted_mode(b, ["oeuvre"], "taille_police", "poids")


def q_gap_cluster_tiers(s, d):
    return gap_clusters(table(s, d, "part"), ["p_brand"], "p_retailprice", 15.0)


def q_dominant_value(s, d):
    return dominant_value(table(s, d, "events"), ["user_id"], "event_type", "event_id")


def q_recall_precision_f1(s, d):
    """A rule (long text for the box) against the overflow mark, in total and per area bucket."""
    b = table(s, d, "bulles").where("x1 > x0 AND y1 > y0 AND traduction IS NOT NULL AND debordement IS NOT NULL").select("debordement", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("bigint").alias("aire"), F.length("traduction").alias("n"))
    b = b.withColumn("predit", F.col("n") * 320 > F.col("aire")).withColumn("tranche", F.when(F.col("aire") < 2000, "0-2000").when(F.col("aire") < 10000, "2000-10000").when(F.col("aire") < 40000, "10000-40000").otherwise(">=40000"))
    tp, fp, fn = (F.sum(F.when(x, 1).otherwise(0)) for x in (F.col("predit") & F.col("debordement"), F.col("predit") & ~F.col("debordement"), ~F.col("predit") & F.col("debordement")))
    out = b.rollup("tranche").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select(F.coalesce("tranche", F.lit("total")).alias("tranche"), "tp", "fp", "fn", F.round(p, 6).alias("precision_"), F.round(r, 6).alias("rappel"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def q_phase_shares(s, d):
    """Share of each kind of event in a user's total value, and its usable weight over users."""
    e = table(s, d, "events").where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    e = e.withColumn("part", F.col("v") / F.sum("v").over(Window.partitionBy("user_id"))).where("part > 0")
    spread = F.max("part") / F.min("part")
    middle = percentile("part", 0.5)
    return counted(e.select("event_type", "part"), ["event_type"], "part").groupBy("event_type").agg(F.sum("k").alias("n"), F.round(middle, 6).alias("mediane"), F.round(F.min("part"), 6).alias("mini"), F.round(F.max("part"), 6).alias("maxi"), F.when((F.sum("k") >= 3) & (spread <= 3), F.round(middle, 4)).alias("poids"))


def q_population_scale(s, d):
    rows = table(s, d, "lineitem")
    middle = counted(rows, ["l_linestatus"], "l_quantity").groupBy("l_linestatus").agg(F.round(percentile("l_quantity", 0.5), 6).alias("mediane"))
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("moyenne"), F.round(F.stddev_samp("l_quantity"), 6).alias("ecart"), F.min("l_quantity").alias("mini"), F.max("l_quantity").alias("maxi")).join(middle, "l_linestatus")


def q_centroid_anchors(s, d):
    """The three parts of each brand nearest its centroid, by distances in units of the range."""
    p = table(s, d, "part").where("p_size IS NOT NULL AND p_retailprice IS NOT NULL")
    w = Window.partitionBy("p_brand")
    off = lambda x: F.abs(F.col(x) - F.avg(x).over(w)) / F.nullif(F.max(x).over(w) - F.min(x).over(w), F.lit(0).cast("double"))
    rows = p.withColumn("ecart", F.round(F.coalesce(off("p_size"), F.lit(0.0)) + F.coalesce(off("p_retailprice"), F.lit(0.0)), 9))
    return rows.withColumn("rang", F.row_number().over(w.orderBy("ecart", "p_partkey"))).where("rang <= 3").select("p_brand", "p_partkey", "rang", F.round("ecart", 6).alias("ecart"))


def q_coverage_table(s, d):
    n = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(s, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_mktsegment", F.least(F.coalesce("n", F.lit(0)), F.lit(3)).alias("commandes")).agg(F.count("*").alias("clients"))


def q_votes_and_duels(s, d):
    """Orders of a priority against the next of the same customer: wins, losses, ties at half a vote."""
    o = table(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    duel = o.select("o_orderpriority", "o_totalprice", F.lead("o_orderpriority").over(w).alias("autre"), F.lead("o_totalprice").over(w).alias("prix")).where("autre IS NOT NULL AND autre <> o_orderpriority")
    vote = F.when(F.col("o_totalprice") > F.col("prix"), 1.0).when(F.col("o_totalprice") < F.col("prix"), 0.0).otherwise(0.5)
    return duel.select(F.least("o_orderpriority", "autre").alias("a"), F.greatest("o_orderpriority", "autre").alias("b"), F.when(F.col("o_orderpriority") < F.col("autre"), vote).otherwise(1 - vote).alias("pour_a")).groupBy("a", "b").agg(F.count("*").alias("duels"), F.sum("pour_a").alias("voix_a"))


def q_last_answer_wins(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("dernier"), F.count("*").alias("n"))


def q_seeded_sample(s, d):
    """A reproducible sample: the 50 orders with the smallest md5 of seed and key."""
    return table(s, d, "orders").select("o_orderkey", F.md5(F.concat(F.lit("7-"), F.col("o_orderkey").cast("string"))).alias("h")).orderBy("h").limit(50)


def q_distinct_clients_sum(s, d):
    """Counters summed over distinct customers only."""
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_mktsegment", "c_acctbal").distinct().groupBy("c_mktsegment").agg(F.count("*").alias("clients"), F.round(F.sum("c_acctbal"), 4).alias("solde"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

SQL = {
    "custom_quantiles": "WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL) SELECT l_returnflag, max(n) AS n, min(v) AS mini, max(v) FILTER (r = least(n, floor(n * 0.5::DOUBLE) + 1)) AS mediane, max(v) FILTER (r = least(n, floor(n * 0.9::DOUBLE) + 1)) AS p90, max(v) FILTER (r = least(n, floor(n * 0.99::DOUBLE) + 1)) AS p99, max(v) AS maxi FROM r GROUP BY 1",
    "linear_percentiles": "SELECT o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 6) AS p{int(p * 100)}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM orders GROUP BY 1",
    "auc_separation": "WITH r AS (SELECT canal, coalesce(debordement, false) AS p, rank() OVER (PARTITION BY canal ORDER BY score) + (count(*) OVER (PARTITION BY canal, score) - 1) / 2 AS r FROM bulles WHERE canal IS NOT NULL AND score IS NOT NULL) SELECT canal, round((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / nullif(count(*) FILTER (p) * count(*) FILTER (NOT p), 0), 6) AS auc, count(*) FILTER (p) AS na, count(*) FILTER (NOT p) AS nb FROM r GROUP BY 1",
    "judge_verdict": "WITH b AS (SELECT canal, score, coalesce(debordement, false) AS h FROM bulles WHERE canal IS NOT NULL AND score IS NOT NULL), r AS (SELECT canal, h, score, rank() OVER (PARTITION BY canal ORDER BY score) + (count(*) OVER (PARTITION BY canal, score) - 1) / 2 AS r FROM b), a AS (SELECT canal, round((sum(r) FILTER (h) - count(*) FILTER (h) * (count(*) FILTER (h) + 1) / 2) / nullif(count(*) FILTER (h) * count(*) FILTER (NOT h), 0), 6) AS auc, median(score) FILTER (h) AS mh, median(score) FILTER (NOT h) AS mb, stddev_samp(score) FILTER (NOT h) AS sd FROM r GROUP BY 1) SELECT canal, round(mh, 6) AS mh, round(mb, 6) AS mb, auc, CASE WHEN auc IS NULL THEN 'non mesure' WHEN mh - mb >= sd AND auc >= 0.8 THEN 'utilisable' ELSE 'inutilisable' END AS verdict FROM a",
    "weighted_mode_size": "WITH p AS (SELECT oeuvre, taille_police AS v, sum(length(traduction)) AS w FROM bulles WHERE oeuvre IS NOT NULL AND taille_police IS NOT NULL AND traduction IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY oeuvre) AS tout, sum(w) OVER (PARTITION BY oeuvre ORDER BY v ROWS UNBOUNDED PRECEDING) AS cumul, row_number() OVER (PARTITION BY oeuvre ORDER BY w DESC, v) AS r FROM p) SELECT oeuvre, CASE WHEN max(w) >= max(tout) * 0.15::DOUBLE THEN max(v) FILTER (r = 1) ELSE min(v) FILTER (cumul * 2 >= tout) END AS mode, max(tout) AS tout FROM c GROUP BY 1",
    "gap_cluster_tiers": "WITH v AS (SELECT p_brand, p_retailprice AS x, count(*) AS k FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY p_brand ORDER BY x) > 15 THEN 1 ELSE 0 END AS f FROM v), h AS (SELECT *, sum(f) OVER (PARTITION BY p_brand ORDER BY x) AS groupe FROM g) SELECT p_brand, groupe, round(sum(x * k) / sum(k), 6) AS moyenne, sum(k) AS n, min(x) AS bas, max(x) AS haut FROM h GROUP BY 1, 2",
    "dominant_value": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS p FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, p, event_type) = 1",
    "recall_precision_f1": "WITH b AS (SELECT debordement AS v, length(traduction) * 320 > CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS p, (x1 - x0) * (y1 - y0) AS a FROM bulles WHERE x1 > x0 AND y1 > y0 AND traduction IS NOT NULL AND debordement IS NOT NULL), t AS (SELECT CASE WHEN a < 2000 THEN '0-2000' WHEN a < 10000 THEN '2000-10000' WHEN a < 40000 THEN '10000-40000' ELSE '>=40000' END AS tranche, count(*) FILTER (p AND v) AS tp, count(*) FILTER (p AND NOT v) AS fp, count(*) FILTER (NOT p AND v) AS fn FROM b GROUP BY 1), u AS (SELECT * FROM t UNION ALL SELECT 'total', sum(tp), sum(fp), sum(fn) FROM t), m AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM u) SELECT tranche, tp, fp, fn, round(p, 6) AS precision_, round(r, 6) AS rappel, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM m",
    "phase_shares": "WITH e AS (SELECT user_id, event_type, sum(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2), q AS (SELECT event_type, v / sum(v) OVER (PARTITION BY user_id) AS part FROM e) SELECT event_type, count(*) AS n, round(median(part), 6) AS mediane, round(min(part), 6) AS mini, round(max(part), 6) AS maxi, CASE WHEN count(*) >= 3 AND max(part) / min(part) <= 3 THEN round(median(part), 4) END AS poids FROM q WHERE part > 0 GROUP BY 1",
    "population_scale": "SELECT l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS moyenne, round(median(l_quantity), 6) AS mediane, round(stddev_samp(l_quantity), 6) AS ecart, min(l_quantity) AS mini, max(l_quantity) AS maxi FROM lineitem GROUP BY 1",
    "centroid_anchors": "WITH e AS (SELECT p_brand, p_partkey, round(coalesce(abs(p_size - avg(p_size) OVER w) / nullif(max(p_size) OVER w - min(p_size) OVER w, 0), 0) + coalesce(abs(p_retailprice - avg(p_retailprice) OVER w) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0), 0), 9) AS ecart FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL WINDOW w AS (PARTITION BY p_brand)) SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY ecart, p_partkey) AS rang, round(ecart, 6) AS ecart FROM e QUALIFY rang <= 3",
    "coverage_table": "SELECT c_mktsegment, least(coalesce(n, 0), 3) AS commandes, count(*) AS clients FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1, 2",
    "votes_and_duels": "WITH d AS (SELECT o_orderpriority AS x, o_totalprice AS px, lead(o_orderpriority) OVER w AS y, lead(o_totalprice) OVER w AS py FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), v AS (SELECT *, CASE WHEN px > py THEN 1.0 WHEN px < py THEN 0.0 ELSE 0.5 END AS vote FROM d WHERE y IS NOT NULL AND x <> y) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS duels, sum(CASE WHEN x < y THEN vote ELSE 1 - vote END)::DOUBLE AS voix_a FROM v GROUP BY 1, 2",
    "last_answer_wins": "SELECT user_id, event_type, arg_max(value, {'t': ts, 'i': event_id}) AS dernier, count(*) AS n FROM events GROUP BY 1, 2",
    "seeded_sample": "SELECT o_orderkey, md5('7-' || o_orderkey) AS h FROM orders ORDER BY h LIMIT 50",
    "distinct_clients_sum": "SELECT c_mktsegment, count(*) AS clients, round(sum(c_acctbal), 4) AS solde FROM (SELECT DISTINCT c_custkey, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1",
}
