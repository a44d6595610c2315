"""Streams give what the same batch gives."""

from catalith.streaming import ingest
from pyspark.sql import functions as F


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_arrivals(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(1).write.parquet(str(tmp_path / "ev"))
    s = ingest.read_events(spark, str(tmp_path / "ev"))
    got = drain(ingest.arrivals(s), "arrivals", "complete").agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{sf}/events.parquet").count()


def test_preferred_updates(spark, tmp_path):
    rows = [(1, 10, "a"), (1, 20, "b"), (1, 20, "c"), (2, 5, "z")]
    spark.createDataFrame(rows, "asset_id long, priority int, value string").coalesce(1).write.parquet(str(tmp_path / "c"))
    s = spark.readStream.schema("asset_id long, priority int, value string").parquet(str(tmp_path / "c"))
    assert {(r.asset_id, r.value) for r in drain(ingest.preferred_updates(s), "pref", "update").collect()} == {(1, "b"), (2, "z")}
