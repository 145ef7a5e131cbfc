"""Session helpers shared by every operator."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SMALL_ROWS = 10_000


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this library: by its place where executors share the machine, else as
    an archive Spark hands out (once per context)."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in (sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if not sc.master.startswith("local") and not getattr(sc, "_lutrin_shipped", False):
        import shutil

        base = os.path.join(tempfile.mkdtemp(), "lutrin")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "lutrin"))
        sc._lutrin_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily read one parquet table of the data directory (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Before work that is slow per row: one small file read as fewer partitions than there are cores is
    dealt out over them; larger inputs, already in more partitions, are left where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; set a local one only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = os.path.join(tempfile.gettempdir(), "lutrin-checkpoints")
        sc.setCheckpointDir(named)
    return named or ""


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so later steps survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, at a fraction of its size, and later reads prune columns.
    """
    import uuid

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, bound: int = _SMALL_ROWS) -> list:
    """Collect a parameter table, refusing one that is larger than ``bound`` rows."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"parameter table has more than {bound} rows")
    return rows


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """SQL settings that hold while a plan is built and run, and are put back after."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, x in values.items():
        spark.conf.set(k, x)
    try:
        yield
    finally:
        for k, x in old.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key``: of rows that repeat it with other values, the least one (column by column, nulls first)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def running(df: DataFrame, group: list[str], order: list, value, name: str) -> DataFrame:
    """``df`` with ``name``: the running sum of ``value`` within ``group``, in ``order``, this row included.

    No group is gathered in one task: rows are range-partitioned by group and order, summed inside their partition, and
    every part of a group is shifted by the sum of the parts before it (at most one row per group and partition).
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = [F.col(c) for c in group]
    placed = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).select("*", value.alias("_v"), F.monotonically_increasing_id().alias("_m"))
    placed = materialise(placed).withColumn("_p", F.shiftright("_m", 33))
    before = placed.groupBy(*group, "_p").agg(F.sum("_v").alias("_s"))
    before = before.withColumn("_o", F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = placed.withColumn("_i", F.sum("_v").over(Window.partitionBy(*group, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)))
    a, b = inside.alias("a"), before.alias("b")
    same = F.col("a._p") == F.col("b._p")
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a._i") + F.col("b._o")).alias(name))
