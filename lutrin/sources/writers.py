"""Writers: tables for people, archives, partitioned corpora; a write is seen whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_cell(x) -> Column:
    """A cell of a Markdown table: null as a dash, bars escaped, line ends as blanks."""
    text = F.regexp_replace(F.regexp_replace(F.col(x).cast("string"), r"\|", r"\\\\|"), r"[\r\n]+", " ")
    return F.coalesce(text, F.lit("—"))


def markdown_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``ligne``: a Markdown table of ``df``, header first, in the given order."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "p int, ligne string")
    body = df.orderBy(*order).select(F.lit(2).alias("p"), F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(c) for c in df.columns]), F.lit(" |")).alias("ligne"))
    return head.unionByName(body)


def write_table(df: DataFrame, path: str) -> None:
    """Cells parted by ``;`` with a header; arrays as comma lists (the loss is the reader's to know)."""
    flat = df.select(*[F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=True, escape='"')


def write_corpus(df: DataFrame, path: str, by: list[str], rows_per_file: int = 500_000) -> None:
    """Parquet by partition columns; rows of one partition are dealt out, so a hot one isn't one task's work."""
    salted = df.repartition(*[F.col(c) for c in by], F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(16)))
    salted.write.mode("overwrite").partitionBy(*by).option("maxRecordsPerFile", rows_per_file).parquet(path)


def append_journal(df: DataFrame, path: str) -> None:
    """Append rows to a journal of JSON lines."""
    df.write.mode("append").json(path)
