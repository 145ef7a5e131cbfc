"""Pages as blocks: statistics, running headers and headings, furniture, text bands, satellites, windows, matched boxes.

A block is a bubble: its text, the size of its letters and its box.  What depends on a whole page, volume or work is an
aggregate joined back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.operators.spatial import PAGE, area, boxes, overlap
from lutrin.session import table

FOOT, TIER, LONGEST = 0.92, 0.5, 120
WINDOW, OVERLAP = 900, 200


def blocks(s: SparkSession, d: str) -> DataFrame:
    """``bulle_id, page, texte, corps, y0, y1, pied, signes``: every block; ``pied`` where it lies in the foot of its page."""
    ok = "oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND x1 > x0 AND y1 > y0 AND trim(ocr) <> ''"
    b = table(s, d, "bulles").where(ok).select("bulle_id", *PAGE, F.col("ocr").alias("texte"), F.col("taille_police").cast("double").alias("corps"), "x0", "y0", "y1")
    height = b.groupBy(*PAGE).agg(F.max("y1").alias("haut"))
    return b.join(height, PAGE).withColumn("pied", F.col("y0") >= F.col("haut") * FOOT).withColumn("signes", F.length("texte")).withColumn("cle", T.repeat_key("texte")).drop("haut")


def classed(b: DataFrame) -> DataFrame:
    """Blocks with ``classe``: ``pied`` (a foot line whose key stands on three pages of the volume), ``titre`` (at most 120
    signs, not said twice in the volume, within half a size of the work's largest) or ``corps``."""
    foot = b.where("pied").groupBy("oeuvre", "tome", "cle").agg(F.countDistinct("planche").alias("pages")).where("pages >= 3").select("oeuvre", "tome", "cle", F.lit(True).alias("repete"))
    twice = b.groupBy("oeuvre", "tome", "texte").agg(F.count("*").alias("fois"))
    tier = b.groupBy("oeuvre").agg(F.max("corps").alias("palier"))
    rows = b.join(foot, ["oeuvre", "tome", "cle"], "left").join(twice, ["oeuvre", "tome", "texte"]).join(tier, "oeuvre")
    title = (F.col("signes") <= LONGEST) & (F.col("fois") < 2) & (F.abs(F.col("corps") - F.col("palier")) <= TIER)
    return rows.withColumn("classe", F.when(F.col("pied") & F.col("repete"), "pied").when(title, "titre").otherwise("corps"))


def q_page_blocks(s, d):
    return blocks(s, d).select("bulle_id", "signes", "corps", "pied", F.coalesce(F.try_divide(T.count_in("texte", "[A-Z]"), F.col("signes")) >= 0.5, F.lit(False)).alias("capitales"))


def q_block_statistics(s, d):
    """Signs per size of letters in every work, and its commonest size by signs."""
    per = blocks(s, d).where("corps IS NOT NULL").groupBy("oeuvre", "corps").agg(F.sum("signes").alias("signes"), F.count("*").alias("blocs"))
    w = Window.partitionBy("oeuvre").orderBy(F.desc("signes"), "corps")
    return per.withColumn("courant", F.row_number().over(w) == 1)


def q_block_classes(s, d):
    return classed(blocks(s, d)).groupBy("oeuvre", "classe").agg(F.count("*").alias("n"), F.sum("signes").alias("signes"))


def q_page_items(s, d):
    """Every page without its foot lines: blocks from top to bottom as one digest (a page's blocks are few)."""
    rows = classed(blocks(s, d)).where("classe <> 'pied'")
    items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "bulle_id", "classe"))), lambda x: F.concat(x["classe"], F.lit(":"), x["bulle_id"].cast("string"))), "|")
    return rows.groupBy(*PAGE).agg(F.count("*").alias("blocs"), F.md5(items).alias("empreinte"))


def q_furniture_boxes(s, d):
    """Boxes wholly above or below the span of their page's tall boxes (over half of the tallest)."""
    b = boxes(s, d).withColumn("h", F.col("y1") - F.col("y0"))
    tall = b.join(b.groupBy(*PAGE).agg(F.max("h").alias("hm")), PAGE).where("h > 0.5 * hm").groupBy(*PAGE).agg(F.min("y0").alias("haut"), F.max("y1").alias("bas"))
    return b.join(tall, PAGE).where("y1 <= haut OR y0 >= bas").select("bulle_id", "haut", "bas")


def q_text_band(s, d):
    """Where a page's text lives: from half a step over the median top to half a step under the lowest bottom."""
    b = boxes(s, d).withColumn("h", (F.col("y1") - F.col("y0")).cast("double"))
    return b.groupBy(*PAGE).agg(F.median("h").alias("pas"), F.median("y0").alias("m"), F.max("y1").alias("b")).select(*PAGE, F.round(F.col("m") - F.col("pas") / 2, 4).alias("haut"), F.round(F.col("b") + F.col("pas") / 2, 4).alias("bas"))


def q_satellite_boxes(s, d):
    """Narrow boxes (at most half of the page's median width) and the wider box they stand close to the right of."""
    b = boxes(s, d).withColumn("l", (F.col("x1") - F.col("x0")).cast("double"))
    b = b.join(b.groupBy(*PAGE).agg(F.median("l").alias("pas")), PAGE)
    narrow, wide = b.where("l <= 0.5 * pas").alias("x"), b.where("l > 0.5 * pas").alias("y")
    near = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in PAGE] + [F.col("x.x0") >= F.col("y.x1"), F.col("x.x0") - F.col("y.x1") <= F.col("x.pas"), F.col("x.y0") < F.col("y.y1"), F.col("y.y0") < F.col("x.y1")]
    pairs = narrow.join(wide, near).groupBy(F.col("x.bulle_id").alias("bulle_id")).agg(F.min(F.struct((F.col("x.x0") - F.col("y.x1")).alias("ecart"), F.col("y.bulle_id").alias("hote"))).alias("h"))
    return pairs.select("bulle_id", "h.hote", "h.ecart")


def q_cell_suspects(s, d):
    """Blocks whose text fills a quarter more or less cells than the box holds (six cells at least)."""
    b = table(s, d, "bulles").where("x1 > x0 AND y1 > y0 AND taille_police > 0 AND ocr IS NOT NULL")
    cells = F.floor((F.col("x1") - F.col("x0")) / F.col("taille_police")).cast("bigint") * F.floor((F.col("y1") - F.col("y0")) / F.col("taille_police")).cast("bigint")
    rows = b.select("oeuvre", cells.alias("cases"), F.length(F.regexp_replace("ocr", r"\s+", "")).alias("n"))
    return rows.where("cases >= 6").groupBy("oeuvre").agg(F.count("*").alias("blocs"), F.count_if(F.abs(F.col("n") - F.col("cases")) * 4 > F.col("cases")).alias("suspects"))


def shape_class(w: Column, h: Column, page: Column) -> Column:
    """Form of a picture by its extents and its share of the page."""
    ratio = w / h
    return F.when(w * h >= 0.6 * page, "pleine page").when(ratio >= 2.5, "bandeau").when(ratio <= 0.4, "colonne").when((w < 80) & (h < 80), "vignette").when(ratio < 0.9, "portrait").when(ratio > 1.1, "paysage").otherwise("carre")


def q_shape_classes(s, d):
    b = boxes(s, d)
    page = b.groupBy(*PAGE).agg((F.max("x1").cast("bigint") * F.max("y1")).alias("page"))
    kind = shape_class((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"), F.col("page").cast("double"))
    return b.join(page, PAGE).groupBy(kind.alias("forme")).agg(F.count("*").alias("n"))


def q_cover_candidates(s, d):
    """The first box of every work, in the order of its pages, that is upright and at least of median area."""
    b = boxes(s, d).withColumn("aire", (F.col("x1") - F.col("x0")).cast("bigint") * (F.col("y1") - F.col("y0")))
    middle = b.groupBy("oeuvre").agg(F.median("aire").alias("mediane"))
    ok = b.join(middle, "oeuvre").where("aire >= mediane AND y1 - y0 > x1 - x0")
    return ok.groupBy("oeuvre").agg(F.min(F.struct(T.natural_key("tome").alias("k"), "planche", "bulle_id")).alias("x")).select("oeuvre", F.col("x.planche").alias("planche"), F.col("x.bulle_id").alias("bulle_id"))


def windowed(b: DataFrame, window: int = WINDOW, shared: int = OVERLAP) -> DataFrame:
    """Boxes in every window of their page that they touch, in the window's own places; ``coupe`` where a seam cuts them."""
    step = window - shared
    first, last = F.greatest(F.ceil((F.col("y0") - window + 1) / step), F.lit(0)).cast("int"), F.floor((F.col("y1") - 1) / step).cast("int")
    rows = b.withColumn("fenetre", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("depart", F.col("fenetre") * step)
    local = lambda c: F.greatest(F.lit(0), F.least(F.lit(window), F.col(c) - F.col("depart")))
    cut = (F.col("y0") < F.col("depart")) | (F.col("y1") > F.col("depart") + window)
    return rows.select("bulle_id", *PAGE, "fenetre", "depart", "x0", "x1", local("y0").alias("y0"), local("y1").alias("y1"), cut.alias("coupe"))


def q_window_boxes(s, d):
    return windowed(boxes(s, d)).select("bulle_id", "fenetre", "y0", "y1", "coupe")


def q_windows_to_pages(s, d):
    """Boxes of windows back in the places of the page: whole ones where there are any, else the largest part."""
    w = windowed(boxes(s, d)).select("bulle_id", "fenetre", (F.col("y0") + F.col("depart")).alias("y0"), (F.col("y1") + F.col("depart")).alias("y1"), "coupe")
    best = w.groupBy("bulle_id").agg(F.min(F.struct("coupe", (F.col("y0") - F.col("y1")).alias("h"), "fenetre", "y0", "y1")).alias("x"), F.count("*").alias("vues"))
    return best.select("bulle_id", "vues", "x.fenetre", "x.y0", "x.y1", "x.coupe")


def _deliveries(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first box of every place of a page, and the later ones (delivered again)."""
    b = boxes(s, d).join(table(s, d, "bulles").where("idx IS NOT NULL").select("bulle_id", "idx"), "bulle_id")
    first = b.groupBy(*PAGE, "idx").agg(F.min("bulle_id").alias("bulle_id"))
    return b.join(first.select("bulle_id"), "bulle_id", "left_semi"), b.join(first.select("bulle_id"), "bulle_id", "left_anti")


def iou_between(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """``ancienne, nouvelle, iou``, with the page: boxes of two sets that share ``least`` of their union."""
    x, y = old.alias("x"), new.alias("y")
    near = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in PAGE] + [F.col("x.x0") < F.col("y.x1"), F.col("y.x0") < F.col("x.x1"), F.col("x.y0") < F.col("y.y1"), F.col("y.y0") < F.col("x.y1")]
    inter = overlap("x", "y")
    return x.join(y, near).select(*(F.col(f"x.{c}") for c in PAGE), F.col("x.bulle_id").alias("ancienne"), F.col("y.bulle_id").alias("nouvelle"), F.round(inter / (area("x") + area("y") - inter), 6).alias("iou")).where(F.col("iou") >= least)


def q_tracked_boxes(s, d):
    """Which earlier box every box delivered again follows: the one it shares most with."""
    old, new = _deliveries(s, d)
    w = Window.partitionBy("nouvelle").orderBy(F.desc("iou"), "ancienne")
    return iou_between(old, new, 0.3).withColumn("r", F.row_number().over(w)).where("r = 1").select("nouvelle", "ancienne", "iou")


def matched(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of the two sets, the best first: a pair is taken when neither box is taken yet."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        for i, a, b in pdf.sort_values(["iou", "ancienne", "nouvelle"], ascending=[False, True, True])[["ancienne", "nouvelle"]].itertuples():
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                keep.append(i)
        return pdf.loc[keep, ["ancienne", "nouvelle", "iou"]]

    return pairs.groupBy(*PAGE).applyInPandas(greedy, "ancienne bigint, nouvelle bigint, iou double")


def q_matched_boxes(s, d):
    old, new = _deliveries(s, d)
    return matched(iou_between(old, new, 0.3))


def q_candidate_verdict(s, d):
    """Is the second delivery of a page's boxes better than the first?  Vetoes first, then gains."""
    old, new = _deliveries(s, d)
    pages = old.groupBy(*PAGE).agg(F.count("*").alias("avant"), F.round(F.avg("score"), 6).alias("s_avant")).join(new.groupBy(*PAGE).agg(F.count("*").alias("apres"), F.round(F.avg("score"), 6).alias("s_apres")), PAGE)
    kept = iou_between(old, new, 0.3).groupBy(*PAGE).agg(F.countDistinct("ancienne").alias("suivies"))
    rows = pages.join(kept, PAGE, "left").withColumn("suivies", F.coalesce("suivies", F.lit(0)))
    verdict = F.when(F.col("s_apres").isNull(), "non mesure").when(F.col("suivies") == 0, "veto : rien ne suit").when(F.col("s_apres") < F.col("s_avant") - 0.05, "veto : moins sur").when(F.col("apres") > F.col("avant"), "gain : plus de boites").when(F.col("s_apres") > F.col("s_avant"), "gain : plus sur").otherwise("inchange")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("pages"), F.sum("suivies").alias("suivies"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_BOX = "b AS (SELECT bulle_id, oeuvre, tome, planche, idx, x0, y0, x1, y1, score FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND x1 > x0 AND y1 > y0)"
_G = "oeuvre, tome, planche"
_KEY = "regexp_replace(regexp_replace(lower(trim(ocr, ' ')), '[0-9]+', '#', 'g'), '[ \t]+', ' ', 'g')"
_BLOCK = f"k AS (SELECT bulle_id, {_G}, ocr AS texte, taille_police::DOUBLE AS corps, x0, y0, y1, length(ocr) AS signes, {_KEY} AS cle, y0 >= max(y1) OVER (PARTITION BY {_G}) * {FOOT}::DOUBLE AS pied FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL AND x1 > x0 AND y1 > y0 AND trim(ocr, ' ') <> '')"
_CLASS = f"""{_BLOCK}, f AS (SELECT oeuvre, tome, cle, true AS repete FROM k WHERE pied GROUP BY 1, 2, 3 HAVING count(DISTINCT planche) >= 3),
c AS (SELECT k.*, CASE WHEN pied AND repete THEN 'pied' WHEN signes <= {LONGEST} AND count(*) OVER (PARTITION BY k.oeuvre, k.tome, texte) < 2 AND abs(corps - max(corps) OVER (PARTITION BY k.oeuvre)) <= {TIER} THEN 'titre' ELSE 'corps' END AS classe FROM k LEFT JOIN f USING (oeuvre, tome, cle))"""
_TWO = f"{_BOX}, i AS (SELECT * FROM b WHERE idx IS NOT NULL), o AS (SELECT *, bulle_id = min(bulle_id) OVER (PARTITION BY {_G}, idx) AS premiere FROM i)"
_IOU = f"p AS (SELECT x.oeuvre, x.tome, x.planche, x.bulle_id AS ancienne, y.bulle_id AS nouvelle, round(((least(x.x1, y.x1) - greatest(x.x0, y.x0))::BIGINT * (least(x.y1, y.y1) - greatest(x.y0, y.y0)))::DOUBLE / ((x.x1 - x.x0)::BIGINT * (x.y1 - x.y0) + (y.x1 - y.x0)::BIGINT * (y.y1 - y.y0) - (least(x.x1, y.x1) - greatest(x.x0, y.x0))::BIGINT * (least(x.y1, y.y1) - greatest(x.y0, y.y0))), 6) AS iou FROM o x JOIN o y USING ({_G}) WHERE x.premiere AND NOT y.premiere AND x.x0 < y.x1 AND y.x0 < x.x1 AND x.y0 < y.y1 AND y.y0 < x.y1)"
_STEP = WINDOW - OVERLAP
_WIN = f"{_BOX}, w0 AS (SELECT *, greatest(ceil((y0 - {WINDOW} + 1) / {_STEP}), 0)::INT AS f0, floor((y1 - 1) / {_STEP})::INT AS f1 FROM b), w1 AS (SELECT *, unnest(range(f0, greatest(f0, f1) + 1))::INT AS fenetre FROM w0), w AS (SELECT bulle_id, fenetre, fenetre * {_STEP} AS depart, greatest(0, least({WINDOW}, y0 - fenetre * {_STEP})) AS y0, greatest(0, least({WINDOW}, y1 - fenetre * {_STEP})) AS y1, y0 < fenetre * {_STEP} OR y1 > fenetre * {_STEP} + {WINDOW} AS coupe FROM w1)"
SQL = {
    "page_blocks": f"WITH {_BLOCK} SELECT bulle_id, signes, corps, pied, coalesce(length(regexp_replace(texte, '[^A-Z]', '', 'g')) / nullif(signes, 0) >= 0.5, false) AS capitales FROM k",
    "block_statistics": f"WITH {_BLOCK}, p AS (SELECT oeuvre, corps, sum(signes) AS signes, count(*) AS blocs FROM k WHERE corps IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY oeuvre ORDER BY signes DESC, corps) = 1 AS courant FROM p",
    "block_classes": f"WITH {_CLASS} SELECT oeuvre, classe, count(*) AS n, sum(signes) AS signes FROM c GROUP BY 1, 2",
    "page_items": f"WITH {_CLASS} SELECT {_G}, count(*) AS blocs, md5(string_agg(classe || ':' || bulle_id, '|' ORDER BY y0, x0, bulle_id)) AS empreinte FROM c WHERE classe <> 'pied' GROUP BY {_G}",
    "furniture_boxes": f"WITH {_BOX}, h AS (SELECT *, max(y1 - y0) OVER (PARTITION BY {_G}) AS hm FROM b), t AS (SELECT {_G}, min(y0) AS haut, max(y1) AS bas FROM h WHERE y1 - y0 > 0.5 * hm GROUP BY {_G}) SELECT bulle_id, haut, bas FROM b JOIN t USING ({_G}) WHERE y1 <= haut OR y0 >= bas",
    "text_band": f"WITH {_BOX} SELECT {_G}, round(median(y0) - median(y1 - y0) / 2, 4) AS haut, round(max(y1) + median(y1 - y0) / 2, 4) AS bas FROM b GROUP BY {_G}",
    "satellite_boxes": f"WITH {_BOX}, m AS (SELECT *, x1 - x0 AS l FROM b), q AS (SELECT m.*, pas FROM m JOIN (SELECT {_G}, median(l) AS pas FROM m GROUP BY {_G}) USING ({_G})) SELECT x.bulle_id, y.bulle_id AS hote, x.x0 - y.x1 AS ecart FROM q x JOIN q y USING ({_G}) WHERE x.l <= 0.5 * x.pas AND y.l > 0.5 * y.pas AND x.x0 >= y.x1 AND x.x0 - y.x1 <= x.pas AND x.y0 < y.y1 AND y.y0 < x.y1 QUALIFY row_number() OVER (PARTITION BY x.bulle_id ORDER BY x.x0 - y.x1, y.bulle_id) = 1",
    "cell_suspects": r"WITH c AS (SELECT oeuvre, floor((x1 - x0) / taille_police)::BIGINT * floor((y1 - y0) / taille_police)::BIGINT AS cases, length(regexp_replace(ocr, '\s+', '', 'g')) AS n FROM bulles WHERE x1 > x0 AND y1 > y0 AND taille_police > 0 AND ocr IS NOT NULL) SELECT oeuvre, count(*) AS blocs, count(*) FILTER (abs(n - cases) * 4 > cases) AS suspects FROM c WHERE cases >= 6 GROUP BY 1",
    "shape_classes": f"WITH {_BOX}, p AS (SELECT x1 - x0 AS w, y1 - y0 AS h, max(x1) OVER (PARTITION BY {_G})::BIGINT * max(y1) OVER (PARTITION BY {_G}) AS page FROM b) SELECT CASE WHEN w * h >= 0.6::DOUBLE * page THEN 'pleine page' WHEN w / h >= 2.5 THEN 'bandeau' WHEN w / h <= 0.4::DOUBLE THEN 'colonne' WHEN w < 80 AND h < 80 THEN 'vignette' WHEN w / h < 0.9::DOUBLE THEN 'portrait' WHEN w / h > 1.1::DOUBLE THEN 'paysage' ELSE 'carre' END AS forme, count(*) AS n FROM p GROUP BY 1",
    "cover_candidates": f"WITH {_BOX}, a AS (SELECT *, (x1 - x0)::BIGINT * (y1 - y0) AS aire FROM b), m AS (SELECT oeuvre, median(aire) AS mediane FROM a GROUP BY 1) SELECT oeuvre, planche, bulle_id FROM a JOIN m USING (oeuvre) WHERE aire >= mediane AND y1 - y0 > x1 - x0 QUALIFY row_number() OVER (PARTITION BY oeuvre ORDER BY list_transform(regexp_extract_all(lower(tome), '(\\d+|\\D+)', 1), lambda t: CASE WHEN regexp_matches(t, '^\\d+$') THEN lpad(t, 12, '0') ELSE t END), planche, bulle_id) = 1",
    "window_boxes": f"WITH {_WIN} SELECT bulle_id, fenetre, y0, y1, coupe FROM w",
    "windows_to_pages": f"WITH {_WIN} SELECT bulle_id, count(*) OVER (PARTITION BY bulle_id) AS vues, fenetre, y0 + depart AS y0, y1 + depart AS y1, coupe FROM w QUALIFY row_number() OVER (PARTITION BY bulle_id ORDER BY coupe, y0 - y1, fenetre) = 1",
    "tracked_boxes": f"WITH {_TWO}, {_IOU} SELECT nouvelle, ancienne, iou FROM p WHERE iou >= 0.3 QUALIFY row_number() OVER (PARTITION BY nouvelle ORDER BY iou DESC, ancienne) = 1",
    "candidate_verdict": f"WITH {_TWO}, {_IOU}, g AS (SELECT {_G}, count(*) FILTER (premiere) AS avant, round(avg(score) FILTER (premiere), 6) AS s_avant, count(*) FILTER (NOT premiere) AS apres, round(avg(score) FILTER (NOT premiere), 6) AS s_apres FROM o GROUP BY {_G} HAVING count(*) FILTER (NOT premiere) > 0), t AS (SELECT {_G}, count(DISTINCT ancienne) AS suivies FROM p WHERE iou >= 0.3 GROUP BY {_G}), v AS (SELECT *, coalesce(t.suivies, 0) AS n FROM g LEFT JOIN t USING ({_G})) SELECT CASE WHEN s_apres IS NULL THEN 'non mesure' WHEN n = 0 THEN 'veto : rien ne suit' WHEN s_apres < s_avant - 0.05::DOUBLE THEN 'veto : moins sur' WHEN apres > avant THEN 'gain : plus de boites' WHEN s_apres > s_avant THEN 'gain : plus sur' ELSE 'inchange' END AS verdict, count(*) AS pages, sum(n) AS suivies FROM v GROUP BY 1",
}
