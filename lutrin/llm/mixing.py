"""Problem 8: combine sources to target shares of the total size in tokens.

Method: the total is cut into equal blocks of tokens; Sainte-Lague apportionment gives each source the
blocks with the highest quotients share / (2k + 1), never more than its allowed repetitions can fill;
a second apportionment spreads a source's blocks over its shards by their size, which gives integer
quotas; inside a shard, records come in a seeded order and are taken round after round (a whole round
is one use of every record) as long as they stay within the quota.  What a shard leaves of its quota is settled
over the whole source: further records that fit what is missing, in seeded order, again and again until none
fits, then the smallest one if that brings the source nearer.  So a source misses its quota by at most half of its
smallest unused record, however many shards it has.

Defined results: texts that are null or empty have no size and are never taken, nor are
rows without a key; rows that repeat a key are one record (the one of the least source, then size).  A source of a mix that
is absent from the corpus gets nothing; the others keep their shares relative to each other, and the
report shows target, aimed-at and reached share.  By default the total is the largest one at which
every present source reaches its share within its allowed repetitions.  Null shares or shares <= 0 get
nothing; a null or smaller than 1 ``repetitions_max`` counts as 1.  A repeated target row of one mix and
source counts once, with the largest values.  Equal seeded hashes are ordered by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lutrin.llm.encoding import token_counts
from lutrin.session import materialise, one_per_key, running, table

BLOCKS = 4_000
SHARD_ROWS = 20_000
SEED = 20_240


def _apportion(df: DataFrame, group: list[str], unit: str, weight: str, cap: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: ``seats`` per group to its units by ``weight``, each at most ``cap``; adds ``out``.

    The rows generated per unit reach its cap or all seats, whichever is less: at most units * seats per group.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("_q"), unit)
    most = F.least(F.col(cap), F.col(seats)).cast("int")
    quotients = df.where(most > 0).select(*group, unit, weight, seats, F.explode(F.sequence(F.lit(0), most - 1)).alias("_k")).select(*group, unit, seats, (F.col(weight) / (2 * F.col("_k") + 1)).alias("_q"))
    won = quotients.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col(seats)).groupBy(*group, unit).agg(F.count("*").alias(out))
    return df.join(won, [*group, unit], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def mix_quotas(sizes: DataFrame, targets: DataFrame, blocks: int = BLOCKS, total_tokens: int | None = None) -> DataFrame:
    """Quota in blocks of every (melange, source): the first apportionment and its parameters."""
    wanted = (
        targets.where("melange IS NOT NULL AND source IS NOT NULL AND part_cible > 0")
        .groupBy("melange", "source")
        .agg(F.max("part_cible").alias("part_cible"), F.greatest(F.max(F.coalesce("repetitions_max", F.lit(1))), F.lit(1)).alias("repetitions_max"))
    )
    there = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))
    mix = Window.partitionBy("melange")
    rows = (
        wanted.join(there, "source", "left")
        .withColumn("present", F.coalesce(F.col("tokens") > 0, F.lit(False)))
        .withColumn("part_visee", F.when(F.col("present"), F.col("part_cible") / F.sum(F.when(F.col("present"), F.col("part_cible"))).over(mix)).otherwise(0.0))
        .withColumn("room", F.when(F.col("present"), F.col("tokens") * F.col("repetitions_max")).otherwise(0))
        .withColumn("total", F.lit(total_tokens).cast("double") if total_tokens else F.min(F.when(F.col("present"), F.col("room") / F.col("part_visee"))).over(mix))
        .withColumn("block", F.col("total") / blocks)
        .withColumn("cap_blocks", F.coalesce(F.floor(F.col("room") / F.col("block") + 1e-6), F.lit(0)))
        .withColumn("seats", F.lit(blocks))
    )
    return _apportion(rows, ["melange"], "source", "part_visee", "cap_blocks", "seats", "quota_blocks")


def _settle(taken: DataFrame, aims: DataFrame) -> DataFrame:
    """Use further records until no source can come nearer to its ``aim`` (tokens per melange and source)."""
    where = ["melange", "source"]
    once = ["melange", "source", "doc_id"]

    def missing() -> DataFrame:
        size = taken.groupBy(*where).agg(F.sum(F.col("n_tokens") * F.col("repetitions")).alias("size"))
        return size.join(aims, where).select(*where, (F.col("aim") - F.col("size")).alias("gap")).where("gap > 0")

    def used_once_more(chosen: DataFrame) -> DataFrame:
        return materialise(taken.join(chosen.select(*once, F.lit(1).alias("more")), once, "left").withColumn("repetitions", F.col("repetitions") + F.coalesce("more", F.lit(0))).drop("more"))

    # A round fills what is missing with records in seeded order; the gap it leaves is less than the first record
    # that no longer fitted, so every round shrinks what may still fit.
    while True:
        fits = taken.join(missing(), where).where("repetitions < repetitions_max AND n_tokens <= gap")
        chosen = materialise(running(fits, where, [F.col("repetitions"), F.col("h"), F.col("doc_id")], F.col("n_tokens"), "upto").where("upto <= gap").select(*once))
        if chosen.isEmpty():
            break
        taken = used_once_more(chosen)
    least = taken.join(missing(), where).where("repetitions < repetitions_max").groupBy(*where, "gap").agg(F.min(F.struct("n_tokens", "h", "doc_id")).alias("x"))
    return used_once_more(least.where("x.n_tokens < 2 * gap").select(*where, "x.doc_id"))


def mix_sources(documents: DataFrame, targets: DataFrame, blocks: int = BLOCKS, total_tokens: int | None = None, seed: int = SEED, tokenizer: str = "byte_bpe_50k", directory: str | None = None, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(records, report): records has ``melange, source, doc_id, n_tokens, repetitions``; see the module."""
    used = documents.select("doc_id", "source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    counted = token_counts(used, "text", ["doc_id", "source"], tokenizer, directory).where("n_tokens > 0 AND doc_id IS NOT NULL")
    sizes = materialise(one_per_key(counted, "doc_id"))
    quotas = materialise(mix_quotas(sizes, targets, blocks, total_tokens))

    # Shards: one per ``shard_rows`` records, but no more than leave each shard at least four blocks of the quota, so
    # both apportionments have at most ``blocks`` seats and a quarter as many units, whatever the corpus holds.
    planned = quotas.where("quota_blocks > 0").withColumn("n_shards", F.greatest(F.lit(1), F.least(F.ceil(F.col("records") / shard_rows), F.floor(F.col("quota_blocks") / 4))))
    hashed = sizes.select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("deal"))
    sharded = hashed.join(planned.select("melange", "source", "n_shards"), "source").select("melange", "source", "doc_id", "n_tokens", "h", F.pmod("deal", "n_shards").alias("shard"))
    shard_sizes = sharded.groupBy("melange", "source", "shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    spread = shard_sizes.join(planned.select("melange", "source", "repetitions_max", "block", "quota_blocks", "tokens"), ["melange", "source"])
    # With at least four blocks a shard, one of entitlement e wins at most 1.125 e + 0.5 blocks, so 2 e + 4 rows do.
    entitled = F.ceil(2 * F.col("quota_blocks") * F.col("shard_tokens") / F.col("tokens") + 4)
    spread = spread.withColumn("shard_cap", F.least(F.ceil(F.col("shard_tokens") * F.col("repetitions_max") / F.col("block")), entitled))
    spread = _apportion(spread, ["melange", "source"], "shard", "shard_tokens", "shard_cap", "quota_blocks", "shard_blocks")
    spread = spread.withColumn("quota_tokens", F.least(F.col("shard_blocks") * F.col("block"), (F.col("shard_tokens") * F.col("repetitions_max")).cast("double")))

    # Whole rounds give every record of a shard the same count; the last round ends before the quota is passed.
    upto = running(sharded, ["melange", "source", "shard"], [F.col("h"), F.col("doc_id")], F.col("n_tokens"), "upto")
    rounds = F.floor(F.col("quota_tokens") / F.col("shard_tokens"))
    rest = F.col("quota_tokens") - rounds * F.col("shard_tokens")
    taken = upto.join(spread.select("melange", "source", "shard", "shard_tokens", "quota_tokens", "repetitions_max"), ["melange", "source", "shard"])
    taken = taken.select("melange", "source", "doc_id", "n_tokens", "h", "repetitions_max", F.least(rounds + F.when(F.col("upto") <= rest, 1).otherwise(0), F.col("repetitions_max")).cast("int").alias("repetitions"))
    aims = planned.select("melange", "source", (F.col("quota_blocks") * F.col("block")).alias("aim"))
    records = _settle(materialise(taken), aims).where("repetitions > 0").select("melange", "source", "doc_id", "n_tokens", "repetitions")
    reached = records.groupBy("melange", "source").agg(F.sum(F.col("n_tokens") * F.col("repetitions")).alias("tokens_pris"), F.sum("repetitions").alias("usages"), F.count("*").alias("documents_pris"), F.max("repetitions").alias("repetitions_reelles"))
    report = (
        quotas.join(reached, ["melange", "source"], "left")
        .withColumn("tokens_pris", F.coalesce("tokens_pris", F.lit(0)))
        .select(
            "melange", "source", "part_cible", F.col("part_visee"),
            F.coalesce(F.col("tokens_pris") / F.sum("tokens_pris").over(Window.partitionBy("melange")), F.lit(0.0)).alias("part_reelle"),
            "tokens_pris", F.coalesce("tokens", F.lit(0)).alias("tokens_disponibles"), F.coalesce("documents_pris", F.lit(0)).alias("documents_pris"),
            F.coalesce("usages", F.lit(0)).alias("usages"), "repetitions_max", F.coalesce("repetitions_reelles", F.lit(0)).alias("repetitions_reelles"), "quota_blocks",
        )
    )
    return records, report


def p8_melange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "melange_cibles"))[0]


def p8_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "melange_cibles"))[1]
