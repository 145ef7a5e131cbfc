"""Incremental work: which stages of which unit must run again, and what a plan of a query looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.session import small_rows

#: Direct dependants of every stage.
EDGES = (
    ("detection", "nettoyage"), ("detection", "ocr"), ("detection", "sfx"), ("nettoyage", "rendu"), ("ocr", "terminologie"),
    ("terminologie", "traduction"), ("traduction", "rendu"), ("sfx", "rendu"),
)


def closure(edges=EDGES) -> dict[str, set[str]]:
    """Every stage and all that depends on it, itself included.  A cycle is refused."""
    out: dict[str, set[str]] = {}
    after: dict[str, set[str]] = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reach(stage: str, path: tuple[str, ...]) -> set[str]:
        if stage in path:
            raise ValueError("stages depend on each other: " + " > ".join((*path, stage)))
        if stage not in out:
            out[stage] = {stage}.union(*(reach(x, (*path, stage)) for x in after[stage]))
        return out[stage]

    for stage in after:
        reach(stage, ())
    return out


def stages_to_redo(spark: SparkSession, units: DataFrame, edges=EDGES) -> DataFrame:
    """``unite, etape``: stages to run again.

    ``units`` has ``unite`` (key), ``presentes ARRAY<STRING>`` (stages whose result is there), ``force BOOLEAN`` (all
    again) and ``depuis STRING`` (this one and all after it).  A missing stage takes its dependants along.
    """
    deps = closure(edges)
    table = F.create_map(*[x for k, v in deps.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    every = F.array(*map(F.lit, sorted(deps)))
    missing = F.filter(every, lambda e: ~F.array_contains(F.coalesce("presentes", F.array().cast("array<string>")), e))
    wanted = F.when(F.coalesce("force", F.lit(False)), every).otherwise(F.concat(missing, F.when(F.col("depuis").isin(*deps), F.array("depuis")).otherwise(F.array().cast("array<string>"))))
    return units.select("unite", F.explode(F.array_distinct(F.flatten(F.transform(wanted, lambda e: F.element_at(table, e))))).alias("etape"))


def adopt_signatures(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``unite, etat`` of cached results against a layout signature: adopted where none was stored, kept where it
    is the same, dropped where it differs."""
    both = fresh.select("unite", F.col("signature").alias("neuve")).join(stored.select("unite", F.col("signature").alias("ancienne")), "unite", "left")
    return both.select("unite", F.when(F.col("ancienne").isNull(), "adopte").when(F.col("ancienne") == F.col("neuve"), "garde").otherwise("jete").alias("etat"))


def unknown_settings(given: DataFrame, known: DataFrame) -> DataFrame:
    """Setting names that aren't known, each with the nearest known one (a parameter table, bounded)."""
    names = [r.nom for r in small_rows(known.select("nom").distinct())]
    nearest = F.array_min(F.array(*[F.struct(F.levenshtein("nom", F.lit(n)).alias("d"), F.lit(n).alias("n")) for n in sorted(names)])) if names else None
    rows = given.select("nom").distinct().where(~F.col("nom").isin(*names)) if names else given.select("nom").distinct()
    return rows.select("nom", (nearest["n"] if names else F.lit(None).cast("string")).alias("proche"))


def plan_of(df: DataFrame) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def quadratic_joins(df: DataFrame) -> list[str]:
    """Nodes of the plan that compare every row with every other."""
    return [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin") if n in plan_of(df)]
