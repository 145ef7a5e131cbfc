"""Ordered-sequence operators: islands, batches, running maxima, remaining time, intervals, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.session import table


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "ile") -> DataFrame:
    """Number the runs that begin where ``starts`` holds; rows before the first start are run 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def batches_without_gaps(df: DataFrame, by: list[str], number: str, size: int) -> DataFrame:
    """Batches of at most ``size`` consecutive numbers that never cross a missing one."""
    w = Window.partitionBy(*by).orderBy(number)
    rows = df.select(*by, number).distinct().withColumn("ile", F.col(number) - F.row_number().over(w))
    inner = Window.partitionBy(*by, "ile").orderBy(number)
    return rows.withColumn("lot", F.floor((F.row_number().over(inner) - 1) / size)).groupBy(*by, "ile", "lot").agg(F.min(number).alias("debut"), F.max(number).alias("fin"), F.count("*").alias("n"))


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Intervals that overlap, or lie no more than ``gap`` apart, as one."""
    df = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*by, start, end).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = islands(df.withColumn("_r", reach), by, [start, end], F.col("_r").isNull() | (F.col(start) > F.col("_r") + F.lit(gap)), "_g")
    return rows.groupBy(*by, "_g").agg(F.min(start).alias("debut"), F.max(end).alias("fin"), F.sum("_k").alias("n")).drop("_g")


def q_progress_monotone(s, d):
    """A user's values replayed as progress: the running maximum, and how often a value fell below it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").where("value IS NOT NULL").withColumn("haut", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") < F.col("haut"), 1).otherwise(0)).alias("reculs"), F.max("value").alias("atteint"))


def q_run_islands(s, d):
    """Sessions: runs of a user's events, a new one after an hour without any."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").where("ts IS NOT NULL").withColumn("avant", F.lag("ts").over(w))
    e = islands(e, ["user_id"], ["ts", "event_id"], F.col("avant").isNull() | (F.col("ts") > F.col("avant") + F.expr("INTERVAL 1 HOUR")))
    return e.groupBy("user_id", "ile").agg(F.count("*").alias("n"), F.min("ts").alias("debut"), F.max("ts").alias("fin"))


def q_phase_changes(s, d):
    """Runs of the same kind of event of a user, in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("avant", F.lag("event_type").over(w))
    e = islands(e, ["user_id"], ["ts", "event_id"], F.col("avant").isNull() | (F.col("avant") != F.col("event_type")))
    runs = e.groupBy("user_id", "ile", "event_type").agg(F.count("*").alias("n"))
    return runs.groupBy("event_type").agg(F.count("*").alias("suites"), F.max("n").alias("plus_longue"))


def q_eta_last_n(s, d):
    """Rate over a user's last twelve events: seconds per event at the end; null under four."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(s, d, "events").where("ts IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r <= 12")
    n = F.count("*")
    return e.groupBy("user_id").agg(n.alias("points"), F.when(n >= 4, F.round((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6 / (n - 1), 6)).alias("secondes"))


def q_batch_groups_no_gap(s, d):
    b = table(s, d, "bulles").where("oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL")
    return batches_without_gaps(b, ["oeuvre", "tome"], "planche", 8).drop("ile", "lot")


def q_register_switches(s, d):
    """Pages where the majority form of address differs from that of the page before that has one."""
    from lutrin.operators.quality import register_by_page

    p = register_by_page(s, d).withColumn("r", F.when(F.col("tu") > F.col("vous"), "tu").when(F.col("vous") > F.col("tu"), "vous")).where("r IS NOT NULL")
    w = Window.partitionBy("oeuvre", "tome").orderBy("planche")
    p = p.withColumn("avant", F.lag("r").over(w))
    return p.groupBy("oeuvre", "tome").agg(F.count("*").alias("planches"), F.sum(F.when(F.col("r") != F.col("avant"), 1).otherwise(0)).alias("bascules"))


def q_interval_merge(s, d):
    """Busy periods of each supplier: five-day windows from every shipping, merged."""
    rows = table(s, d, "lineitem").select("l_suppkey", F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).alias("a")).withColumn("z", F.col("a") + 5)
    return merge_intervals(rows, ["l_suppkey"], "a", "z")


def q_idle_gaps(s, d):
    """The complement: per supplier, idle spans of at least ten days between busy periods."""
    m = q_interval_merge(s, d)
    w = Window.partitionBy("l_suppkey").orderBy("debut")
    return m.select("l_suppkey", F.lag("fin").over(w).alias("de"), F.col("debut").alias("a")).where("a - de >= 10")


def q_fractional_position(s, d):
    """Where headings stand in a document, as a fraction of its lines."""
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    return rows.where("ligne LIKE '#%'").select("doc_id", "pos", F.round(F.col("pos") / F.col("n"), 6).alias("fraction"))


def q_equal_pieces(s, d):
    """Lines of a document dealt to four pieces with rounded bounds."""
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("piece", F.floor(F.col("pos") * 4 / F.col("n")))
    return rows.groupBy("doc_id", "piece").agg(F.count("*").alias("lignes"), F.min("pos").alias("debut"), F.sum(F.length("ligne")).alias("taille"))


def q_split_half(s, d):
    """The line end nearest the middle of a document, the earlier of two."""
    w = Window.partitionBy("doc_id")
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").withColumn("cumul", F.sum(F.length("ligne") + 1).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("tout", F.sum(F.length("ligne") + 1).over(w)).where("cumul < tout")
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.abs(F.col("cumul") * 2 - F.col("tout")).alias("e"), "pos")).alias("m")).select("doc_id", F.col("m.pos").alias("coupe"))


def q_proportional_split(s, d):
    """Lines to three blocks of weights 1, 2 and 1: the block whose share their midpoint falls in."""
    w = Window.partitionBy("doc_id")
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").withColumn("t", F.length("ligne") + 1)
    rows = rows.withColumn("mi", F.sum("t").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t") / 2).withColumn("tout", F.sum("t").over(w))
    rows = rows.withColumn("bloc", F.when(F.col("mi") * 4 < F.col("tout"), 0).when(F.col("mi") * 4 < F.col("tout") * 3, 1).otherwise(2))
    return rows.groupBy("doc_id", "bloc").agg(F.count("*").alias("lignes"), F.sum("t").alias("taille"))


def q_block_packing(s, d):
    """Greedy packing of lines into blocks of at most 2,000 characters, as a native fold per document."""
    most = 2000
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("t"))
    zero = F.struct(F.lit(0).cast("int").alias("blocs"), F.lit(0).cast("int").alias("cours"), F.lit(0).cast("int").alias("plus"))

    def step(acc, n):
        close = (acc["cours"] > 0) & (acc["cours"] + n > most)
        now = F.when(close, n + 2).otherwise(acc["cours"] + n + 2)
        return F.struct((acc["blocs"] + F.when(close, 1).otherwise(0)).cast("int").alias("blocs"), now.cast("int").alias("cours"), F.greatest(acc["plus"], now).cast("int").alias("plus"))

    return docs.select("doc_id", F.aggregate("t", zero, step).alias("x")).select("doc_id", (F.col("x.blocs") + 1).alias("blocs"), F.col("x.plus").alias("plus"))


def q_heading_levels(s, d):
    """Heading levels a document has at least twice; the highest of them parts it into chapters."""
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.length(F.regexp_extract("ligne", "^(#{1,6}) ", 1)).alias("niveau")).where("niveau > 0")
    per = rows.groupBy("doc_id", "niveau").agg(F.count("*").alias("n")).where("n >= 2")
    return per.withColumn("chapitre", F.col("niveau") == F.min("niveau").over(Window.partitionBy("doc_id")))


def q_detect_sections(s, d):
    """Sections of comic scripts and marked documents: their title, lines and size."""
    rows = T.lines(table(s, d, "documents"), "doc_id", "text").withColumn("titre", F.col("ligne").rlike(r"^#{1,6} |^Planche [0-9]+$"))
    rows = islands(rows, ["doc_id"], ["pos"], F.col("titre"), "section")
    return rows.groupBy("doc_id", "section").agg(F.min(F.when(F.col("titre"), F.col("ligne"))).alias("titre"), F.count("*").alias("lignes"), F.sum(F.length("ligne")).alias("taille"))


def q_sliding_windows(s, d):
    """Windows of 500 over every page's height, 400 apart, the last one moved back to end at the bottom."""
    p = table(s, d, "bulles").where("y1 IS NOT NULL AND planche IS NOT NULL AND oeuvre IS NOT NULL AND tome IS NOT NULL").groupBy("oeuvre", "tome", "planche").agg(F.max("y1").alias("h")).where("h > 0")
    starts = F.when(F.col("h") <= 500, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("h") - 500), F.lit(400)), F.array(F.col("h") - 500))))
    return p.select("oeuvre", "tome", "planche", F.explode(starts).alias("debut"), "h").select("oeuvre", "tome", "planche", "debut", F.least(F.col("debut") + 500, "h").alias("fin"))


def q_layout_signature(s, d):
    """Fingerprint of a document's layout: its count of lines and a hash of their lengths, not of their content."""
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("string")).alias("t"))
    return docs.select("doc_id", F.concat(F.size("t").cast("string"), F.lit(":"), F.substring(F.sha2(F.concat_ws("|", "t"), 256), 1, 12)).alias("signature"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_L = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ligne, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"
_B = "WITH r AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + 5 AS z, count(*) AS k FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL), f AS (SELECT *, max(z) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), g AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM f), i AS (SELECT l_suppkey, min(a) AS debut, max(z) AS fin, sum(k) AS n FROM g GROUP BY l_suppkey, g)"
SQL = {
    "progress_monotone": "SELECT user_id, count(*) AS n, count(*) FILTER (value < haut) AS reculs, max(value) AS atteint FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS haut FROM events WHERE value IS NOT NULL) GROUP BY 1",
    "run_islands": "WITH a AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE ts IS NOT NULL), b AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ile FROM a) SELECT user_id, ile, count(*) AS n, min(ts) AS debut, max(ts) AS fin FROM b GROUP BY 1, 2",
    "phase_changes": "WITH a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ile FROM a) SELECT event_type, count(*) AS suites, max(n) AS plus_longue FROM (SELECT user_id, ile, event_type, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1",
    "eta_last_n": "WITH e AS (SELECT user_id, ts FROM events WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12) SELECT user_id, count(*) AS points, CASE WHEN count(*) >= 4 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1), 6) END AS secondes FROM e GROUP BY 1",
    "batch_groups_no_gap": "WITH p AS (SELECT DISTINCT oeuvre, tome, planche FROM bulles WHERE oeuvre IS NOT NULL AND tome IS NOT NULL AND planche IS NOT NULL), i AS (SELECT *, planche - row_number() OVER (PARTITION BY oeuvre, tome ORDER BY planche) AS ile FROM p), b AS (SELECT *, (row_number() OVER (PARTITION BY oeuvre, tome, ile ORDER BY planche) - 1) // 8 AS lot FROM i) SELECT oeuvre, tome, min(planche) AS debut, max(planche) AS fin, count(*) AS n FROM b GROUP BY oeuvre, tome, ile, lot",
    "interval_merge": _B + " SELECT * FROM i",
    "idle_gaps": _B + " SELECT l_suppkey, de, a FROM (SELECT l_suppkey, lag(fin) OVER (PARTITION BY l_suppkey ORDER BY debut) AS de, debut AS a FROM i) WHERE a - de >= 10",
    "fractional_position": _L + " SELECT doc_id, pos, round(pos / n, 6) AS fraction FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l) WHERE ligne LIKE '#%'",
    "equal_pieces": _L + " SELECT doc_id, floor(pos * 4 / n) AS piece, count(*) AS lignes, min(pos) AS debut, sum(length(ligne)) AS taille FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l) GROUP BY 1, 2",
    "split_half": _L + ", c AS (SELECT doc_id, pos, sum(length(ligne) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS cumul, sum(length(ligne) + 1) OVER (PARTITION BY doc_id) AS tout FROM l) SELECT doc_id, pos AS coupe FROM c WHERE cumul < tout QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(cumul * 2 - tout), pos) = 1",
    "proportional_split": _L + ", c AS (SELECT doc_id, length(ligne) + 1 AS t, sum(length(ligne) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - (length(ligne) + 1) / 2 AS mi, sum(length(ligne) + 1) OVER (PARTITION BY doc_id) AS tout FROM l) SELECT doc_id, CASE WHEN mi * 4 < tout THEN 0 WHEN mi * 4 < tout * 3 THEN 1 ELSE 2 END AS bloc, count(*) AS lignes, sum(t) AS taille FROM c GROUP BY 1, 2",
    "block_packing": _L.replace("WITH", "WITH RECURSIVE") + ", p AS (SELECT doc_id, pos, 0 AS bloc, length(ligne) + 2 AS cours FROM l WHERE pos = 0 UNION ALL SELECT l.doc_id, l.pos, p.bloc + CASE WHEN p.cours > 0 AND p.cours + length(l.ligne) > 2000 THEN 1 ELSE 0 END, CASE WHEN p.cours > 0 AND p.cours + length(l.ligne) > 2000 THEN length(l.ligne) + 2 ELSE p.cours + length(l.ligne) + 2 END FROM p JOIN l ON l.doc_id = p.doc_id AND l.pos = p.pos + 1) SELECT doc_id, max(bloc) + 1 AS blocs, max(cours) AS plus FROM p GROUP BY 1",
    "heading_levels": _L + ", h AS (SELECT doc_id, length(regexp_extract(ligne, '^(#{1,6}) ', 1)) AS niveau FROM l), n AS (SELECT doc_id, niveau, count(*) AS n FROM h WHERE niveau > 0 GROUP BY 1, 2 HAVING count(*) >= 2) SELECT doc_id, niveau, n, niveau = min(niveau) OVER (PARTITION BY doc_id) AS chapitre FROM n",
    "detect_sections": _L + ", t AS (SELECT *, regexp_matches(ligne, '^#{1,6} |^Planche [0-9]+$') AS titre FROM l), s AS (SELECT *, sum(CASE WHEN titre THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM t) SELECT doc_id, section, min(ligne) FILTER (titre) AS titre, count(*) AS lignes, sum(length(ligne)) AS taille FROM s GROUP BY 1, 2",
    "sliding_windows": "WITH p AS (SELECT oeuvre, tome, planche, max(y1) AS h FROM bulles WHERE y1 IS NOT NULL AND planche IS NOT NULL AND oeuvre IS NOT NULL AND tome IS NOT NULL GROUP BY ALL HAVING max(y1) > 0), s AS (SELECT DISTINCT oeuvre, tome, planche, h, unnest(CASE WHEN h <= 500 THEN [0] ELSE list_append(range(0, h - 499, 400), h - 500) END) AS debut FROM p) SELECT oeuvre, tome, planche, debut, least(debut + 500, h) AS fin FROM s",
    "layout_signature": "SELECT doc_id, len(string_split(text, chr(10))) || ':' || substring(sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: length(x)::VARCHAR), '|')), 1, 12) AS signature FROM documents WHERE text IS NOT NULL",
}
SQL["register_switches"] = "SELECT oeuvre, tome, count(*) AS planches, count(*) FILTER (r <> avant) AS bascules FROM (SELECT *, lag(r) OVER (PARTITION BY oeuvre, tome ORDER BY planche) AS avant FROM (SELECT oeuvre, tome, planche, CASE WHEN tu > vous THEN 'tu' ELSE 'vous' END AS r FROM (@) WHERE tu <> vous)) GROUP BY 1, 2"


def _finish() -> None:
    from lutrin.operators.quality import SQL as Q

    SQL["register_switches"] = SQL["register_switches"].replace("@", Q["register_by_page"])


_finish()
