"""Typed item graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import spread


#: Pairs of a task.
PAIR_ROWS = 1 << 19


def typed_degrees(edges: DataFrame) -> DataFrame:
    """Edges and distinct end points of each reference type."""
    return edges.groupBy("ref_type").agg(F.count("*").alias("n_edges"), F.countDistinct("from_id").alias("n_from"), F.countDistinct("to_id").alias("n_to"))


def linked_roles(edges: DataFrame) -> DataFrame:
    """Per item and role: how many other items share a source with it in that role.

    Pairs are counted before they are made, and dealt into as many partitions as their number asks for; so are the edges.
    """
    at = spread(edges.select("from_id", "to_id", "ref_type").where("from_id is not null and to_id is not null"), "from_id")
    e = at.distinct()  # takes the partitions as they are
    pairs = at.groupBy("from_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0] or 0
    a = e.select("from_id", F.col("to_id").alias("primary_id"))
    b = e.select("from_id", F.col("to_id").alias("other"), F.col("ref_type").alias("role"))
    both = a.join(b.hint("merge"), "from_id").where("primary_id <> other").select("primary_id", "role", "other")
    return spread(both, "primary_id", "role", "other", rows=int(pairs), task_rows=PAIR_ROWS).distinct().groupBy("primary_id", "role").agg(F.count("other").alias("linked"))
