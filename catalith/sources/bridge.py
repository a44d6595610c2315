"""Ordinary tables as entries: every measure, label or header of a row becomes one entry of an asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.session import spread, table

#: Measures of a line, in tag order.
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with block_id: their place within the order."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("block_id", F.row_number().over(w).cast("long") - 1)


def line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of order lines: six a line, one for each measure; some are tombstones."""
    n = len(MEASURES)
    cells = F.array(*[
        F.struct(
            F.lit(i + 1).alias("tag"), F.lit("scalar" if i < 4 else "text").alias("value_kind"), F.lit("f64" if i < 4 else None).cast("string").alias("elem_type"),
            (F.col(c) if i < 4 else F.lit(None)).cast("double").alias("v_double"), (F.col(c) if i >= 4 else F.lit(None)).cast("string").alias("v_text"),
        )
        for i, c in enumerate(MEASURES)
    ])
    return line_blocks(spark, sf_dir).select("*", F.explode(cells).alias("e")).select(
        F.col("l_orderkey").alias("asset_id"), (F.col("block_id") * n + F.col("e.tag") - 1).alias("entry_id"), "block_id", F.col("e.tag").alias("order_in_block"),
        F.lit("exif_tag").alias("key_kind"), F.concat(F.lit("ln"), F.col("l_linenumber").cast("string")).alias("ifd"), "e.tag", "e.value_kind", "e.elem_type",
        "e.v_double", "e.v_text", F.when((F.col("l_partkey") % 17 == 0) & (F.col("e.tag") == 4), 1).otherwise(0).alias("flags"),
    )


def typed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each order line with keys and values of several kinds, some of them broken: a table for validation."""
    e = lambda text: F.expr(text)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").cast("long").alias("entry_id"),
        e("element_at(array('exif_tag', 'xmp_property', 'iptc_dataset', 'png_text'), cast(l_partkey % 4 as int) + 1)").alias("key_kind"),
        e("if(l_suppkey % 5 = 0, '', if(l_suppkey % 2 = 0, 'ifd0', 'exififd'))").alias("ifd"), e("cast(256 + l_partkey % 7 as int)").alias("tag"),
        e("if(l_suppkey % 7 = 0, '', 'http://ns.adobe.com/exif/1.0/')").alias("ns"), e("concat('LensSpecification[', l_suppkey % 5, ']')").alias("path"), e("l_returnflag").alias("name"),
        e("cast(250 + l_orderkey % 10 as int)").alias("record"), e("cast(l_suppkey % 300 as int)").alias("dataset"),
        e("element_at(array('scalar', 'text', 'empty', 'scalar', 'scalar'), cast(l_orderkey % 5 as int) + 1)").alias("value_kind"),
        e("element_at(array('u8', 'i8', 'urational', 'u16', 'srational', 'i16'), cast(l_suppkey % 6 as int) + 1)").alias("elem_type"),
        e("cast(case l_orderkey % 5 when 1 then if(l_linenumber = 3, 3, 2) when 2 then if(l_linenumber = 4, 1, 0) else if(l_linenumber = 5, 2, 1) end as bigint)").alias("count"),
        e("l_quantity * 10 - 60").alias("v_double"), e("named_struct('num', cast(l_partkey % 3 as bigint), 'den', cast(l_orderkey % 2 as bigint))").alias("v_ratio"),
        e("cast(null as array<double>)").alias("v_nums"), e("concat(l_returnflag, l_linestatus)").alias("v_text"), e("cast(null as binary)").alias("v_bytes"),
        e("cast(if(l_partkey % 17 = 0, 1, 0) as int)").alias("flags"),
    )


#: Tags of a date with its offset and its part of a second.
DATE_TAG, OFFSET_TAG, SUBSECOND_TAG = 0x9003, 0x9011, 0x9291


def date_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders in block 0; offsets there, in block 1 or nowhere; parts of a second, some of them deleted."""
    cell = lambda i, block, tag, text, when: F.when(when, F.struct(
        F.lit(i).cast("long").alias("entry_id"), F.lit(block).cast("long").alias("block_id"), F.lit("exififd").alias("ifd"), F.lit(tag).alias("tag"), text.alias("v_text"),
        F.when((F.col("o_orderkey") % 7 == 0) & (F.lit(tag) == SUBSECOND_TAG), 1).otherwise(0).alias("flags")))
    k = F.col("o_orderkey")
    cells = F.array(
        cell(0, 0, DATE_TAG, F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 12:34:56")), F.lit(True)), cell(1, 0, OFFSET_TAG, F.lit("+02:00"), k % 3 == 0),
        cell(2, 0, OFFSET_TAG, F.lit("+09:00"), k % 3 == 0), cell(3, 1, OFFSET_TAG, F.lit("-03:30"), k % 3 != 2), cell(4, 0, SUBSECOND_TAG, F.lit("111"), k % 2 == 0),
    )
    return table(spark, sf_dir, "orders").select(k.alias("asset_id"), F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("e")).select("asset_id", "e.*")


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date candidates of an order: its own date (block 0, priority 100) and its lines' ship dates (priority 90)."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.lit(0).cast("long").alias("idx"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("v_text"), F.lit(100).alias("priority"))
    lines = line_blocks(spark, sf_dir).select(F.col("l_orderkey").alias("asset_id"), (F.col("block_id") + 1).alias("idx"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("v_text"), F.lit(90).alias("priority"))
    return own.unionAll(lines)


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and language carriers of a page: head (block 0), body (1), url (2)."""
    p = table(spark, sf_dir, "pages")
    pick = lambda c, r: F.nullif(F.regexp_extract(c, r, 1), F.lit(""))
    cells = F.array(
        F.struct(F.lit(0).alias("block_id"), F.lit("title").alias("role"), F.lit(90).alias("priority"), pick("html", r"<title>([^<]*)</title>").alias("v")),
        F.struct(F.lit(1).alias("block_id"), F.lit("title").alias("role"), F.lit(80).alias("priority"), pick("html", r"<h1[^>]*>([^<]*)</h1>").alias("v")),
        F.struct(F.lit(0).alias("block_id"), F.lit("language").alias("role"), F.lit(90).alias("priority"), pick("html", r'<html lang="([^"]*)"').alias("v")),
        F.struct(F.lit(2).alias("block_id"), F.lit("identifier").alias("role"), F.lit(70).alias("priority"), F.col("url").alias("v")),
    )
    return p.select(F.col("page_id").alias("asset_id"), F.explode(cells).alias("e")).select("asset_id", "e.*").where("v is not null")


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive entries of documents: language and source as properties, length as a number, labels where there are any."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    own = d.select(F.col("doc_id").alias("asset_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("block_id"), F.lit("xmp_property").alias("key_kind"), F.lit("dc").alias("ns"), F.lit("language").alias("name"), F.lit(None).cast("int").alias("record"), F.lit(None).cast("int").alias("dataset"), F.col("lang").alias("v")),
        F.struct(F.lit(0).alias("block_id"), F.lit("iptc_dataset").alias("key_kind"), F.lit(None).cast("string").alias("ns"), F.lit("source").alias("name"), F.lit(2).alias("record"), F.lit(115).alias("dataset"), F.col("source").alias("v")),
        F.struct(F.lit(0).alias("block_id"), F.lit("bmff_field").alias("key_kind"), F.lit(None).cast("string").alias("ns"), F.lit("n_chars").alias("name"), F.lit(None).cast("int").alias("record"), F.lit(None).cast("int").alias("dataset"), F.col("n_chars").cast("string").alias("v")),
    )).alias("e")).select("asset_id", "e.*")
    more = lab.select(F.col("doc_id").alias("asset_id"), F.explode(F.array(*[
        F.struct(F.lit(1).alias("block_id"), F.lit("png_text").alias("key_kind"), F.lit("label").alias("ns"), F.lit(c).alias("name"), F.lit(None).cast("int").alias("record"), F.lit(None).cast("int").alias("dataset"), F.col(c).cast("string").alias("v"))
        for c in ("quality", "toxic")
    ])).alias("e")).select("asset_id", "e.*")
    return own.unionAll(more)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


#: The same views in SQL.
LINE_BLOCKS_SQL = "lb AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS block_id FROM lineitem)"
LINE_ENTRIES_SQL = LINE_BLOCKS_SQL + ", le AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey AS asset_id, block_id * 6 + {i} AS entry_id, block_id, {i + 1} AS order_in_block, 'ln' || l_linenumber AS ifd, {i + 1} AS tag, "
    f"'{'scalar' if i < 4 else 'text'}' AS value_kind, {'\'f64\'' if i < 4 else 'NULL'} AS elem_type, {c if i < 4 else 'CAST(NULL AS DOUBLE)'} AS v_double, "
    f"{c if i >= 4 else 'CAST(NULL AS VARCHAR)'} AS v_text, {'CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END' if i == 3 else '0'} AS flags FROM lb"
    for i, c in enumerate(MEASURES)
) + ")"
TYPED_ENTRIES_SQL = """te AS (SELECT l_orderkey AS asset_id, CAST(l_linenumber AS BIGINT) AS entry_id, ['exif_tag', 'xmp_property', 'iptc_dataset', 'png_text'][CAST(l_partkey % 4 AS INTEGER) + 1] AS key_kind,
  CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_suppkey % 2 = 0 THEN 'ifd0' ELSE 'exififd' END AS ifd, 256 + l_partkey % 7 AS tag, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'http://ns.adobe.com/exif/1.0/' END AS ns,
  'LensSpecification[' || (l_suppkey % 5) || ']' AS path, 250 + l_orderkey % 10 AS record, l_suppkey % 300 AS dataset, ['scalar', 'text', 'empty', 'scalar', 'scalar'][CAST(l_orderkey % 5 AS INTEGER) + 1] AS value_kind,
  ['u8', 'i8', 'urational', 'u16', 'srational', 'i16'][CAST(l_suppkey % 6 AS INTEGER) + 1] AS elem_type,
  CASE l_orderkey % 5 WHEN 1 THEN CASE WHEN l_linenumber = 3 THEN 3 ELSE 2 END WHEN 2 THEN CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END ELSE CASE WHEN l_linenumber = 5 THEN 2 ELSE 1 END END AS n,
  l_quantity * 10 - 60 AS v, l_partkey % 3 AS num, l_orderkey % 2 AS den, strlen(l_returnflag || l_linestatus) AS held, l_partkey % 17 = 0 AS gone FROM lineitem)"""
ORDER_DATES_SQL = LINE_BLOCKS_SQL + """, od AS (
  SELECT o_orderkey AS asset_id, 0 AS idx, strftime(o_orderdate, '%Y-%m-%d') AS v_text, 100 AS priority FROM orders
  UNION ALL SELECT l_orderkey, block_id + 1, strftime(l_shipdate, '%Y-%m-%d'), 90 FROM lb)"""
PAGE_ENTRIES_SQL = """pe AS (SELECT * FROM (
  SELECT page_id AS asset_id, 0 AS block_id, 'title' AS role, 90 AS priority, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS v FROM pages
  UNION ALL SELECT page_id, 1, 'title', 80, nullif(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '') FROM pages
  UNION ALL SELECT page_id, 0, 'language', 90, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') FROM pages
  UNION ALL SELECT page_id, 2, 'identifier', 70, url FROM pages) WHERE v IS NOT NULL)"""
DOC_ENTRIES_SQL = """de AS (
  SELECT doc_id AS asset_id, 0 AS block_id, 'xmp_property' AS key_kind, 'dc' AS ns, 'language' AS name, NULL AS record, NULL AS dataset, lang AS v FROM documents
  UNION ALL SELECT doc_id, 0, 'iptc_dataset', NULL, 'source', 2, 115, source FROM documents
  UNION ALL SELECT doc_id, 0, 'bmff_field', NULL, 'n_chars', NULL, NULL, CAST(n_chars AS VARCHAR) FROM documents
  UNION ALL SELECT doc_id, 1, 'png_text', 'label', 'quality', NULL, NULL, CAST(quality AS VARCHAR) FROM labels
  UNION ALL SELECT doc_id, 1, 'png_text', 'label', 'toxic', NULL, NULL, CAST(toxic AS VARCHAR) FROM labels)"""
