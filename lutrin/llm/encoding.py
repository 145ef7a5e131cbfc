"""Problem 7: token ids of every text of a corpus, by the backtracking encoder of ``bpe``.

Defined results: a null or empty text has the empty list of ids (``[]``, never null); blank texts are
encoded like any other.  A text is never shortened.  Repeated rows give repeated rows; columns other
than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm import bpe
from lutrin.session import spread, table


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, so long texts don't pile up in a worker."""
    sizes = np.cumsum([len(x) if x is not None else 0 for x in batch.column(1).to_pylist()])
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row; empty list for null and empty texts."""
    path = bpe.vocabulary_path(tokenizer, directory)

    def run(batches):
        enc = bpe.load(path)
        for whole in batches:
            for b in _slices(whole):
                ids = [enc.encode(t) if t else [] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))).mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def decode_ids(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """``key`` and ``text``: the inverse of ``encode_texts`` (a null list gives a null text)."""
    path = bpe.vocabulary_path(tokenizer, directory)

    def run(batches):
        enc = bpe.load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["k", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").select(F.col("k").alias(key), "text")


def token_counts(df: DataFrame, text: str, keep: list[str], tokenizer: str = "byte_bpe_50k", directory: str | None = None, name: str = "n_tokens") -> DataFrame:
    """Columns ``keep`` and the size in tokens of ``text`` (0 for null and empty)."""
    path = bpe.vocabulary_path(tokenizer, directory)
    small = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))

    def run(batches):
        enc = bpe.load(path)
        for b in batches:
            n = [len(enc.encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "n"])

    kinds = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return spread(small).mapInArrow(run, f"{kinds}, n bigint").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias(name))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
