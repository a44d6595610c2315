"""Concept resolution: candidates merged, conflicts marked, the preferred value chosen.

candidates: asset_id, role, idx (builder order), priority, value. Conflicts are found without pairing rows: a scope has
a conflict exactly if its smallest and largest value differ by more than the tolerance, and a candidate takes part in
one if it differs from either of these two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of one key become one: highest priority, longest value (ties: the largest), first place, all sources counted."""
    best = F.max_by("value", F.struct(F.length("value"), "value"))
    return candidates.groupBy(*keys).agg(F.max("priority").alias("priority"), best.alias("value"), F.min("idx").alias("idx"), F.count("*").alias("n_sources"))


def conflicts(candidates: DataFrame, scope: list[str], tolerance: float | None = None) -> DataFrame:
    """candidates with conflict: whether a candidate of the same scope has another value (numbers: beyond tolerance)."""
    w = Window.partitionBy(*scope)
    low, high = F.min("value").over(w), F.max("value").over(w)
    if tolerance is None:
        return candidates.withColumn("conflict", low != high)
    return candidates.withColumn("conflict", (F.col("value") - low > tolerance) | (high - F.col("value") > tolerance))


def preferred(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """The preferred candidate of each scope: highest priority, ties to the first. One partial aggregation."""
    cols = [c for c in candidates.columns if c not in scope]
    best = F.max_by(F.struct(*cols), F.struct(F.col("priority"), -F.col("idx")))
    return candidates.groupBy(*scope).agg(best.alias("_b")).select(*scope, "_b.*")


def summary(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope: candidates, distinct values, preferred value and state."""
    return candidates.groupBy(*scope).agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.max_by("value", F.struct(F.col("priority"), -F.col("idx"))).alias("value"),
        F.when(F.min("value") != F.max("value"), "conflict").otherwise("agreed").alias("state"),
    )
