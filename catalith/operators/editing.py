"""Logical edits, imports, translation between schemas and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The descriptors between the two descriptive schemas: name, dataset, most bytes, repeated.
MAPPING = (
    ("title", 5, 64, False), ("description", 120, 2000, False), ("creator", 80, 32, True), ("subject", 25, 64, True), ("rights", 116, 128, False), ("credit", 110, 32, False),
    ("source", 115, 32, False), ("city", 90, 32, False), ("location", 92, 32, False), ("state", 95, 32, False), ("country", 101, 64, False), ("country_code", 100, 3, False),
    ("headline", 105, 256, False), ("instructions", 40, 256, False), ("transmission_reference", 103, 32, False), ("author_position", 85, 32, False), ("caption_writer", 122, 32, False),
    ("category", 15, 3, False), ("supplemental", 20, 32, True), ("urgency", 10, 1, False),
)


def mapping(spark) -> DataFrame:
    return spark.createDataFrame(list(MAPPING), "name string, dataset int, max_bytes int, repeated boolean")


def sequential(base: DataFrame, ops: DataFrame, keys: list[str]) -> DataFrame:
    """The state after ordered ops (keys, seq, op in set/add/remove, value) on base (keys, value).

    Ops on one key run in order as one fold; keys are independent of each other. set replaces all values by one, add
    appends one, remove drops all. Keys left without values have an empty list.
    """
    own = base.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("vals"))
    seq = ops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "value"))).alias("ops"))
    j = own.join(seq, keys, "full_outer")
    start = F.coalesce("vals", F.array().cast("array<string>"))
    run = lambda acc, o: F.when(o["op"] == "set", F.array(o["value"])).when(o["op"] == "add", F.concat(acc, F.array(o["value"]))).otherwise(F.array().cast("array<string>"))
    return j.select(*keys, F.when(F.col("ops").isNull(), start).otherwise(F.aggregate(F.coalesce("ops", F.array().cast("array<struct<seq:int,op:string,value:string>>")), start, run)).alias("vals"))


def import_unique(items: DataFrame, entries: DataFrame) -> DataFrame:
    """items (asset_id, name, value) onto the entry of that name: applied if there is exactly one, else why not."""
    n = entries.groupBy("asset_id", "name").agg(F.count("*").alias("n"), F.min("entry_id").alias("entry_id"))
    j = items.join(n, ["asset_id", "name"], "left")
    return j.select("asset_id", "name", F.when(F.col("n") == 1, F.col("entry_id")).alias("entry_id"), F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok").alias("status"))


def translated(values: DataFrame, dim: DataFrame) -> DataFrame:
    """values (asset_id, name, value) as datasets. A value of more bytes than the target holds is refused: status too_long and no value."""
    j = values.join(F.broadcast(dim), "name")  # as many rows as MAPPING
    size = F.octet_length("value").cast("long")
    status = F.when(size > F.col("max_bytes"), "too_long").otherwise("fits")
    return j.select("asset_id", "name", "dataset", F.when(size <= F.col("max_bytes"), F.col("value")).alias("value"), size.alias("bytes"), status.alias("status"))


def reconciled(by_family: DataFrame, families: list[str], policy: str = "priority") -> DataFrame:
    """One value from a column for each family: the first in order that has one; with policy 'fail', none on conflict."""
    cols: list[Column] = [F.col(f) for f in families]
    picked = F.coalesce(*cols)
    vals = F.array_distinct(F.filter(F.array(*cols), lambda v: v.isNotNull()))
    conflict = F.size(vals) > 1
    source = F.coalesce(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in families])
    out = by_family.withColumn("conflict", conflict)
    if policy == "fail":
        return out.withColumn("value", F.when(~F.col("conflict"), picked)).withColumn("status", F.when(F.col("conflict"), "conflict").when(picked.isNull(), "empty").otherwise("ok"))
    return out.withColumn("value", picked).withColumn("source", source)
