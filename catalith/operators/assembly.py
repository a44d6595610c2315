"""Reassembly of payloads that come in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parts(turns: DataFrame) -> DataFrame:
    """Conversation turns as parts: asset_id, part_index, part_count, content."""
    w = Window.partitionBy("conv_id")
    return turns.select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("part_index"), F.count("*").over(w).alias("part_count"), F.col("text").alias("content"))


def joined(p: DataFrame, sep: str = "") -> DataFrame:
    """One payload for each asset, its parts in index order."""
    seq = F.array_sort(F.collect_list(F.struct("part_index", "content")))
    return p.groupBy("asset_id").agg(F.count("*").alias("parts"), F.array_join(F.transform(seq, lambda x: x["content"]), sep).alias("payload"))


def completeness(p: DataFrame) -> DataFrame:
    """Gaps of each sequence: ok if every index from 0 is there and the count is as declared."""
    prev = F.lag("part_index").over(Window.partitionBy("asset_id").orderBy("part_index"))
    g = p.withColumn("gap", (F.col("part_index") != F.coalesce(prev, F.lit(-1)) + 1).cast("long"))
    return g.groupBy("asset_id").agg(F.count("*").alias("parts"), F.max("part_count").alias("part_count"), F.sum("gap").alias("gaps"), F.min("part_index").alias("low")).select(
        "asset_id", "parts", "part_count", "gaps", F.when((F.col("parts") == F.col("part_count")) & (F.col("low") == 0), "ok").otherwise("malformed").alias("status"))


def offsets(p: DataFrame) -> DataFrame:
    """Parts with their logical offset and size in bytes."""
    w = Window.partitionBy("asset_id").orderBy("part_index").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("content").cast("long")
    return p.withColumn("logical_size", size).withColumn("logical_offset", F.coalesce(F.sum("logical_size").over(w), F.lit(0)))


def slice_extents(o: DataFrame, start: int, end: int) -> DataFrame:
    """The byte range of each part that the logical slice [start, end) covers."""
    a, n = F.col("logical_offset"), F.col("logical_size")
    hit = o.where((a < end) & (a + n > start))
    return hit.select("asset_id", "part_index", (F.greatest(a, F.lit(start)) - a).cast("long").alias("from_byte"), (F.least(a + n, F.lit(end)) - a).cast("long").alias("to_byte"))
