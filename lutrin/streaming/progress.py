"""Streams: progress states per user, windows with late rows, last answers; file sinks for exactly-once results."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lutrin.session import ensure_checkpoint_dir

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 4) -> DataFrame:
    """The events as a stream of files (one file, or a folder of them, on any file system)."""
    place = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(place).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(place if folder else f"{sf_dir}/events*.parquet")


def fold(start: tuple, values) -> tuple:
    """(values, best, setbacks) after further values in order; a value below the best so far is a setback."""
    n, best, back = start
    for v in values:
        n, back, best = n + 1, back + (best is not None and v < best), v if best is None else max(best, v)
    return n, best, back


def progress_state(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Monotone progress of one user in the order of event time, whatever batch an event arrives in.

    Events newer than the watermark wait in the state, sorted with those of later batches; once the watermark has
    passed them they are folded for good.  What is given out is the settled fold with the waiting events on top.
    """
    settled, waiting = (state.get[:3], list(zip(*state.get[3:]))) if state.exists else ((0, None, 0), [])
    rows = pd.concat(list(batches)).dropna(subset=["value"])
    waiting = sorted([*waiting, *zip(rows["t"].astype("datetime64[us]").astype("int64").tolist(), rows["event_id"].tolist(), rows["value"].tolist())])
    passed = state.getCurrentWatermarkMs() * 1000
    ready = bisect.bisect_left(waiting, (passed,))
    settled, waiting = fold(settled, (v for _, _, v in waiting[:ready])), waiting[ready:]
    state.update((*settled, *(map(list, zip(*waiting)) if waiting else ([], [], []))))
    n, best, back = fold(settled, (v for _, _, v in waiting))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "atteint": [best], "reculs": [back]})


def progress(stream: DataFrame, late: str) -> DataFrame:
    """Progress per user; the state holds the events of the last ``late``, and only what is later than that is folded
    in the order of its arrival."""
    rows = stream.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).select("user_id", "t", "event_id", "value")
    kept = "n bigint, atteint double, reculs bigint, t array<bigint>, id array<bigint>, v array<double>"
    return rows.groupBy("user_id").applyInPandasWithState(progress_state, "user_id bigint, n bigint, atteint double, reculs bigint", kept, "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Events and sums per kind and window; rows later than ``late`` are left out of closed windows."""
    ts = F.col("ts").cast("timestamp")
    return stream.withColumn("t", ts).withWatermark("t", late).groupBy(F.window("t", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("somme"))


def drain(query_of, spark: SparkSession) -> DataFrame:
    """Run a streaming writer over what there is (available now), in the shared folder, and read its files back."""
    import uuid

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    place = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query_of(place).awaitTermination()
    return spark.read.parquet(f"{place}/out")


def stream_progress(spark: SparkSession, sf_dir: str, late: str = "400 days", per_trigger: int = 4) -> DataFrame:
    """Final progress of every user, from the updates the stream wrote batch by batch."""

    def start(place: str):
        def sink(df: DataFrame, epoch: int) -> None:
            df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}")

        return progress(event_stream(spark, sf_dir, per_trigger), late).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(sink).trigger(availableNow=True).start()

    out = drain(start, spark)
    return out.groupBy("user_id").agg(F.max_by(F.struct("n", "atteint", "reculs"), "epoch").alias("x")).select("user_id", "x.n", "x.atteint", "x.reculs")


def stream_windows(spark: SparkSession, sf_dir: str, per_trigger: int = 4) -> DataFrame:
    """Daily windows by kind of event, each given out once, when the watermark (a day) has closed it."""

    def start(place: str):
        out = windowed(event_stream(spark, sf_dir, per_trigger)).select(F.col("window.start").alias("debut"), "event_type", "n", F.round("somme", 4).alias("somme"))
        return out.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()

    return drain(start, spark)


QUERIES = {"stream_progress": stream_progress, "stream_windows": stream_windows}

SQL = {
    "stream_progress": "SELECT user_id, count(*) AS n, max(value) AS atteint, count(*) FILTER (value < haut) AS reculs FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS haut FROM events WHERE value IS NOT NULL) GROUP BY 1",
    "stream_windows": "SELECT date_trunc('day', ts) AS debut, event_type, count(*) AS n, round(sum(value), 4) AS somme FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
}
