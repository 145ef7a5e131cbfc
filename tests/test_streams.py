"""Streams over several files: order across micro-batches, closed windows, late rows."""

import datetime as dt

from pyspark.sql import functions as F

from lutrin.streaming import progress as P


def _progress(df):
    return {r.user_id: (r.n, r.atteint, r.reculs) for r in df.collect()}


def test_order_across_batches(spark, data, tmp_path):
    """The events dealt to eight files at random give what the one file gives."""
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(8, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got, want = _progress(P.stream_progress(spark, str(tmp_path), per_trigger=1)), _progress(P.stream_progress(spark, data))
    assert got == want and len(got) > 10
    rows = events.where("value IS NOT NULL").orderBy("user_id", "ts", "event_id").collect()
    brute: dict = {}
    for r in rows:
        brute[r.user_id] = P.fold(brute.get(r.user_id, (0, None, 0)), [r.value])
    assert {k: v for k, v in got.items() if v[0]} == brute


def test_settled_events_leave_the_state(spark, tmp_path):
    """Two batches a year apart: the first is folded for good, the result is the same."""
    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(days=d), 1, "a", v, "") for k, (d, v) in enumerate([(0, 5.0), (1, 3.0), (500, 4.0), (501, 9.0), (502, None)])]
    for i, part in enumerate((rows[:2], rows[2:3], rows[3:])):
        spark.createDataFrame(part, P.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert _progress(P.stream_progress(spark, str(tmp_path), late="10 days", per_trigger=1)) == {1: (4, 9.0, 2)}


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 12)
    at = lambda k, d, v: (k, day + dt.timedelta(days=d), 1, "a", v, "")
    import time

    for part in ([at(0, 0, 1.0), at(1, 1, 1.0)], [at(2, 10, 1.0)], [at(4, 10, 2.0)], [at(3, 0, 50.0), at(5, 14, 1.0)]):
        spark.createDataFrame(part, P.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(1.1)  # files are read in the order of their times
    got = {(r.debut.day, r.n, r.somme) for r in P.stream_windows(spark, str(tmp_path), per_trigger=1).collect()}
    assert got == {(1, 1, 1.0), (2, 1, 1.0), (11, 2, 3.0)}
