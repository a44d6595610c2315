"""Concept queries: dates, coordinates, merged candidates, conflicts and preferred values."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import dates
from catalith.operators import concepts, store
from catalith.plans.registry import query
from catalith.session import table
from catalith.sources import bridge as B

OD, PE = B.ORDER_DATES_SQL, B.PAGE_ENTRIES_SQL


@query("datetime_normalize", """SELECT event_id AS asset_id, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS second, 'second' AS precision,
  CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 7200 AS utc_second FROM events""")
def datetime_normalize(spark, d):
    text = F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit("+02:00"))
    p = B.events(spark, d).select(F.col("event_id").alias("asset_id"), text.alias("t")).withColumn("p", dates.parsed_datetime(F.col("t")))
    return p.select("asset_id", F.date_format("p.day", "yyyy-MM-dd").alias("day"), "p.second", "p.precision", dates.utc_second(F.col("p"), dates.offset_minutes(F.col("t"))).alias("utc_second"))


_DATED = """SELECT o_orderkey AS asset_id, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) // 86400 * 86400 + 45296 - {offset} AS utc_second,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 THEN '111' END AS subsecond, CAST({source} AS BIGINT) AS offset_id FROM orders"""


def _dated(spark, d, inherit=None):
    e = B.date_entries(spark, d)
    base = store.find_all(e, tag=B.DATE_TAG).select("asset_id", "block_id", "ifd", "entry_id", "v_text")
    c = store.companions(base, e, {"offset": B.OFFSET_TAG, "sub": B.SUBSECOND_TAG}, inherit)
    utc = dates.utc_second(dates.parsed_datetime(F.col("v_text")), dates.offset_minutes(F.col("offset.text")))
    return c.select("asset_id", utc.alias("utc_second"), F.col("sub.text").alias("subsecond"), F.col("offset.id").alias("offset_id"))


@query("date_companions", _DATED.format(offset="CASE WHEN o_orderkey % 3 = 0 THEN 7200 ELSE 0 END", source="CASE WHEN o_orderkey % 3 = 0 THEN 1 END"))
def date_companions(spark, d):
    return _dated(spark, d)


@query("date_companions_inherited", _DATED.format(offset="CASE o_orderkey % 3 WHEN 0 THEN 7200 WHEN 1 THEN -12600 ELSE 0 END", source="CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END"))
def date_companions_inherited(spark, d):
    return _dated(spark, d, spark.createDataFrame([(1, "")], "block_id long, ifd string"))


@query("datetime_conflict", f"""WITH {OD} SELECT asset_id, count(*) AS n, count(DISTINCT substr(v_text, 1, 4)) AS n_years, min(substr(v_text, 1, 4)) <> max(substr(v_text, 1, 4)) AS conflict FROM od GROUP BY asset_id""")
def datetime_conflict(spark, d):
    c = B.order_dates(spark, d).withColumn("value", F.substring("v_text", 1, 4))
    return concepts.summary(c, ["asset_id"]).select("asset_id", "n", F.col("n_values").alias("n_years"), (F.col("state") == "conflict").alias("conflict"))


@query("dms_to_decimal", """SELECT c_custkey AS asset_id, round((CASE WHEN c_nationkey % 2 = 0 THEN -1 ELSE 1 END) * (c_custkey % 90 + (c_custkey % 60) / 60.0 + (c_custkey % 59) / 3600.0), 9) + 0.0 AS latitude FROM customer""")
def dms_to_decimal(spark, d):
    k = F.col("c_custkey")
    v = dates.dms_to_decimal(k % 90, k % 60, k % 59, F.when(F.col("c_nationkey") % 2 == 0, "S").otherwise("N"))
    return table(spark, d, "customer").select(k.alias("asset_id"), F.round(v, 9).alias("latitude"))


@query("coord_conflict_tolerance", """WITH c AS (SELECT c_custkey AS asset_id, CAST(c_custkey % 90 AS DOUBLE) AS a, c_custkey % 90 + CASE c_custkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 5e-8 ELSE 1e-3 END AS b FROM customer)
  SELECT asset_id, abs(a - b) > 1e-7 AS conflict FROM c""")
def coord_conflict_tolerance(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("asset_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("idx"), (k % 90).cast("double").alias("value")),
        F.struct(F.lit(1).alias("idx"), ((k % 90).cast("double") + F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 5e-8).otherwise(1e-3)).alias("value")),
    )).alias("c")).select("asset_id", "c.*")
    return concepts.conflicts(c, ["asset_id"], 1e-7).groupBy("asset_id").agg(F.bool_or("conflict").alias("conflict"))


@query("price_conflict_tolerance", f"""WITH {B.LINE_BLOCKS_SQL}, c AS (SELECT p_partkey AS asset_id, 0 AS idx, p_retailprice AS value FROM part UNION ALL SELECT l_partkey, l_orderkey * 100 + block_id + 1, l_extendedprice / l_quantity FROM lb)
  SELECT asset_id, count(*) AS n, max(value) - min(value) > 500 AS conflict FROM c GROUP BY asset_id""")
def price_conflict_tolerance(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.lit(0).cast("long").alias("idx"), F.col("p_retailprice").alias("value")).unionAll(
        B.line_blocks(spark, d).select("l_partkey", F.col("l_orderkey") * 100 + F.col("block_id") + 1, F.col("l_extendedprice") / F.col("l_quantity")))
    return c.groupBy("asset_id").agg(F.count("*").alias("n"), (F.max("value") - F.min("value") > 500).alias("conflict"))


_PC = f"WITH {PE}, c AS (SELECT asset_id, role, block_id AS idx, priority, v AS value FROM pe)"


def _page_candidates(spark, d):
    return B.page_entries(spark, d).select("asset_id", "role", F.col("block_id").alias("idx"), "priority", F.col("v").alias("value"))


@query("concept_merge", _PC + " SELECT asset_id, role, max(priority) AS priority, arg_max(value, length(value)) AS value, min(idx) AS idx, count(*) AS n_sources FROM c GROUP BY ALL")
def concept_merge(spark, d):
    return concepts.merged(_page_candidates(spark, d), ["asset_id", "role"])


@query("concept_conflicts", f"""WITH {OD}, y AS (SELECT asset_id, idx, substr(v_text, 1, 4) AS value FROM od)
  SELECT a.asset_id, a.idx, EXISTS (SELECT 1 FROM y b WHERE b.asset_id = a.asset_id AND b.value <> a.value) AS conflict FROM y a""")
def concept_conflicts(spark, d):
    c = B.order_dates(spark, d).withColumn("value", F.substring("v_text", 1, 4))
    return concepts.conflicts(c, ["asset_id"]).select("asset_id", "idx", "conflict")


@query("concept_preferred", f"""WITH {OD} SELECT asset_id, v_text, priority, idx FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY priority DESC, idx) AS rn FROM od WHERE idx > 0) WHERE rn = 1""")
def concept_preferred(spark, d):
    return concepts.preferred(B.order_dates(spark, d).where("idx > 0"), ["asset_id"])


@query("concept_summary", _PC + """ SELECT asset_id, role, count(*) AS n, count(DISTINCT value) AS n_values, arg_max(value, priority * 10 - idx) AS value, CASE WHEN min(value) <> max(value) THEN 'conflict' ELSE 'agreed' END AS state FROM c GROUP BY ALL""")
def concept_summary(spark, d):
    return concepts.summary(_page_candidates(spark, d), ["asset_id", "role"])


@query("collection_preferred", """SELECT conv_id AS asset_id, role AS value, min(turn) AS idx, 90 AS priority FROM conversations GROUP BY conv_id, role""")
def collection_preferred(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("role").alias("value"), F.col("turn").alias("idx"), F.lit(90).alias("priority"))
    return concepts.preferred(c, ["asset_id", "value"])
