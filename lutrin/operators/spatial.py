"""Boxes and vectors: overlaps, containment, recurring places, suppression, order of reading, cosines.

Boxes are half-open (right and bottom edges excluded).  Box joins are within one page, a bounded group; the
sequential ones (suppression, reading order) run per page in pandas.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.session import table

PAGE = ["oeuvre", "tome", "planche"]


def boxes(s: SparkSession, d: str) -> DataFrame:
    ok = "oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND x1 > x0 AND y1 > y0"
    return table(s, d, "bulles").where(ok).select("bulle_id", *PAGE, "x0", "y0", "x1", "y1", "score", "langue_source")


def overlap(a: str, b: str) -> Column:
    """Area two boxes share."""
    w = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    h = F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")
    return F.when((w > 0) & (h > 0), w.cast("bigint") * h).otherwise(F.lit(0).cast("bigint"))


def area(a: str) -> Column:
    return (F.col(f"{a}.x1") - F.col(f"{a}.x0")).cast("bigint") * (F.col(f"{a}.y1") - F.col(f"{a}.y0"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    b = boxes(s, d)
    x, y = b.alias("x"), b.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in PAGE]
    # Overlapping boxes only: the range conditions are part of the join, so pairs apart are never built.
    near = [F.col("x.bulle_id") < F.col("y.bulle_id"), F.col("x.x0") < F.col("y.x1"), F.col("y.x0") < F.col("x.x1"), F.col("x.y0") < F.col("y.y1"), F.col("y.y0") < F.col("x.y1")]
    return x.join(y, same + near)


def q_box_iou_pairs(s, d):
    inter = overlap("x", "y")
    return _pairs(s, d).select(F.col("x.bulle_id").alias("a"), F.col("y.bulle_id").alias("b"), F.round(inter / (area("x") + area("y") - inter), 6).alias("iou"))


def q_containment_anti(s, d):
    """Boxes that no other box of the page covers to nine tenths."""
    p = _pairs(s, d)
    inter = overlap("x", "y")
    covered = p.select(F.explode(F.array(F.when(inter >= area("x") * 0.9, F.col("x.bulle_id")), F.when(inter >= area("y") * 0.9, F.col("y.bulle_id")))).alias("bulle_id")).where("bulle_id IS NOT NULL").distinct()
    return boxes(s, d).join(covered, "bulle_id", "left_anti").groupBy("oeuvre").agg(F.count("*").alias("libres"))


def q_recurring_places(s, d):
    """Places (on a grid of 200) that hold a box on at least three pages of a volume and on a twentieth of them."""
    b = boxes(s, d).select("oeuvre", "tome", "planche", *[F.floor(F.col(c) / 200).alias(c) for c in ("x0", "y0", "x1", "y1")])
    pages = b.groupBy("oeuvre", "tome").agg(F.countDistinct("planche").alias("toutes"))
    seen = b.groupBy("oeuvre", "tome", "x0", "y0", "x1", "y1").agg(F.countDistinct("planche").alias("planches")).where("planches >= 3")
    return seen.join(pages, ["oeuvre", "tome"]).where("planches * 20 >= toutes").drop("toutes")


def q_box_gaps(s, d):
    """Gap of each box to the next of its page from top to bottom: 0 where they meet or overlap."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "bulle_id")
    gap = F.greatest(F.lit(0), F.lead("y0").over(w) - F.col("y1"))
    return boxes(s, d).select("bulle_id", gap.alias("ecart")).where("ecart IS NOT NULL")


def q_area_budget(s, d):
    """Characters a box has room for, capped by the source's length where it isn't Japanese."""
    b = table(s, d, "bulles").where("x1 > x0 AND y1 > y0 AND ocr IS NOT NULL AND langue_source IS NOT NULL")
    room = F.greatest(F.lit(12), F.floor((F.col("x1") - F.col("x0")).cast("bigint") * (F.col("y1") - F.col("y0")) / 320))
    cap = F.greatest(F.lit(12), F.floor(F.length("ocr") * F.lit(1.3).cast("double")))
    return b.select("bulle_id", F.when(F.col("langue_source") == "ja", room).otherwise(F.least(room, cap)).alias("signes"))


def q_box_nms(s, d):
    """Greedy suppression per page: by score, a box falls to a kept one it overlaps by 0.45 or more."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "bulle_id"], ascending=[False, True])
        kept: list = []
        for r in pdf.itertuples():
            for k in kept:
                w, h = min(r.x1, k.x1) - max(r.x0, k.x0), min(r.y1, k.y1) - max(r.y0, k.y0)
                if w > 0 and h > 0 and w * h >= 0.45 * ((r.x1 - r.x0) * (r.y1 - r.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - w * h):
                    break
            else:
                kept.append(r)
        return pd.DataFrame({"bulle_id": [k.bulle_id for k in kept]})

    return boxes(s, d).where("score IS NOT NULL").groupBy(*PAGE).applyInPandas(keep, "bulle_id long")


def q_reading_order(s, d):
    """Order of a page's boxes by recursive cuts at the widest gutter, right to left for Japanese works."""

    def cut(group: list, rtl: bool) -> list:
        if len(group) < 2:
            return group
        best = (0, None, None)
        for lo, hi, axis in ((2, 4, "y"), (1, 3, "x")):
            ordered, reach = sorted(group, key=lambda r: (r[lo], r[0])), None
            for r in ordered:
                if reach is not None and r[lo] - reach > best[0]:
                    best = (r[lo] - reach, axis, r[lo])
                reach = r[hi] if reach is None else max(reach, r[hi])
        _, axis, at = best
        if axis is None:
            return sorted(group, key=lambda r: (r[2], -r[3] if rtl else r[1], r[0]))
        lo = 2 if axis == "y" else 1
        first, second = [r for r in group if r[lo] < at], [r for r in group if r[lo] >= at]
        if axis == "x" and rtl:
            first, second = second, first
        return cut(first, rtl) + cut(second, rtl)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["bulle_id", "x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        done = cut(rows, bool((pdf["langue_source"] == "ja").any()))
        return pd.DataFrame({"bulle_id": [r[0] for r in done], "rang": range(len(done))})

    return boxes(s, d).groupBy(*PAGE).applyInPandas(order, "bulle_id long, rang int")


def unit_vectors(df: DataFrame, key: str, vector: str, *keep: str) -> DataFrame:
    """Vectors of length one; a zero vector stays zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.select(key, *keep, F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))).alias("v"))


def cosine(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def _centroids(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = unit_vectors(table(s, d, "embeddings"), "vec_id", "embedding", "label")
    parts = u.where("label IS NOT NULL").select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return u, c


def q_cosine_to_centroid(s, d):
    """Each vector's cosine to the mean direction of its label (no pairs of vectors are built)."""
    u, c = _centroids(s, d)
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return u.join(c, "label").select("vec_id", "label", F.round(F.try_divide(cosine("v", "c"), length), 5).alias("cosinus"))


def q_label_cohesion(s, d):
    """Cohesion of each label: mean pairwise cosine of its members from the length of their sum alone."""
    u = unit_vectors(table(s, d, "embeddings"), "vec_id", "embedding", "label").where("label IS NOT NULL")
    sums = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    g = sums.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.max("n").alias("n"))
    return g.select("label", "n", F.round(F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)), 5).alias("cohesion"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_OK = "oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND x1 > x0 AND y1 > y0"
_PAIRS = f"WITH b AS (SELECT * FROM bulles WHERE {_OK}), p AS (SELECT x.bulle_id AS a, y.bulle_id AS b, (least(x.x1, y.x1) - greatest(x.x0, y.x0))::BIGINT * (least(x.y1, y.y1) - greatest(x.y0, y.y0)) AS i, (x.x1 - x.x0)::BIGINT * (x.y1 - x.y0) AS sa, (y.x1 - y.x0)::BIGINT * (y.y1 - y.y0) AS sb FROM b x JOIN b y ON x.oeuvre = y.oeuvre AND x.tome = y.tome AND x.planche = y.planche AND x.bulle_id < y.bulle_id AND x.x0 < y.x1 AND y.x0 < x.x1 AND x.y0 < y.y1 AND y.y0 < x.y1)"
_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: coalesce(x / nullif(sqrt(list_sum(list_transform(e, lambda y: y * y))), 0), 0)) AS v FROM v), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u WHERE label IS NOT NULL)"
SQL = {
    "box_iou_pairs": _PAIRS + " SELECT a, b, round(i / (sa + sb - i), 6) AS iou FROM p",
    "containment_anti": _PAIRS + ", c AS (SELECT a AS k FROM p WHERE i >= sa * 0.9::DOUBLE UNION SELECT b FROM p WHERE i >= sb * 0.9::DOUBLE) SELECT oeuvre, count(*) AS libres FROM b WHERE bulle_id NOT IN (SELECT k FROM c) GROUP BY 1",
    "recurring_places": f"WITH b AS (SELECT oeuvre, tome, planche, floor(x0 / 200) AS x0, floor(y0 / 200) AS y0, floor(x1 / 200) AS x1, floor(y1 / 200) AS y1 FROM bulles WHERE {_OK}), n AS (SELECT oeuvre, tome, count(DISTINCT planche) AS toutes FROM b GROUP BY 1, 2), s AS (SELECT oeuvre, tome, x0, y0, x1, y1, count(DISTINCT planche) AS planches FROM b GROUP BY ALL HAVING count(DISTINCT planche) >= 3) SELECT s.* FROM s JOIN n USING (oeuvre, tome) WHERE planches * 20 >= toutes",
    "box_gaps": f"SELECT bulle_id, ecart FROM (SELECT bulle_id, CASE WHEN lead(y0) OVER w IS NOT NULL THEN greatest(0, lead(y0) OVER w - y1) ELSE 0 END AS ecart FROM bulles WHERE {_OK} WINDOW w AS (PARTITION BY oeuvre, tome, planche ORDER BY y0, x0, bulle_id))",
    "area_budget": "SELECT bulle_id, CASE WHEN langue_source = 'ja' THEN greatest(12, floor((x1 - x0)::BIGINT * (y1 - y0) / 320)) ELSE least(greatest(12, floor((x1 - x0)::BIGINT * (y1 - y0) / 320)), greatest(12, floor(length(ocr) * 1.3::DOUBLE))) END AS signes FROM bulles WHERE x1 > x0 AND y1 > y0 AND ocr IS NOT NULL AND langue_source IS NOT NULL",
    "cosine_to_centroid": _V + ", m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS l FROM m GROUP BY 1) SELECT vec_id, label, round(list_inner_product(v, c) / l, 5) AS cosinus FROM u JOIN c USING (label)",
    "label_cohesion": _V + ", m AS (SELECT label, i, sum(x) AS x, count(*) AS n FROM x GROUP BY 1, 2), g AS (SELECT label, sum(x * x) AS q, max(n) AS n FROM m GROUP BY 1) SELECT label, n, round((q - n) / nullif(n * (n - 1), 0), 5) AS cohesion FROM g",
}
