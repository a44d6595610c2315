"""Entries as streams: arrival statistics over event time and the running preferred value of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files below path as a stream, with the schema of the files that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def arrivals(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events and values by type and window of event time; what is later than `late` is dropped."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def preferred_updates(stream: DataFrame) -> DataFrame:
    """asset_id, priority, value whenever a key's preferred candidate changes: highest priority, ties to the first seen.

    stream: asset_id, priority, value. The state of a key is its best candidate so far.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        changed = False
        for b in batches:
            for p, v in zip(b.priority, b.value, strict=True):
                if best is None or p > best[0]:
                    best, changed = (int(p), str(v)), True
        if best is not None:
            state.update(best)
        if changed:
            yield pd.DataFrame({"asset_id": [key[0]], "priority": [best[0]], "value": [best[1]]})

    schema = "asset_id long, priority int, value string"
    return stream.groupBy("asset_id").applyInPandasWithState(step, schema, "priority int, value string", "update", "NoTimeout")
