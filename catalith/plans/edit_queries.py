"""Validation, editing, translation and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import editing, store, validation
from catalith.plans.registry import query
from catalith.session import table
from catalith.sources import bridge as B
from catalith.sources import decoders

LE, DE, PE = B.LINE_ENTRIES_SQL, B.DOC_ENTRIES_SQL, B.PAGE_ENTRIES_SQL
_RULES = f"""{LE}, i AS (SELECT asset_id, entry_id, 'discount_too_high' AS code, 'error' AS severity FROM le WHERE flags & 1 = 0 AND tag = 3 AND v_double > 0.09
  UNION ALL SELECT asset_id, entry_id, 'quantity_large', 'warning' FROM le WHERE flags & 1 = 0 AND tag = 1 AND v_double >= 45
  UNION ALL SELECT asset_id, entry_id, 'text_not_upper', 'error' FROM le WHERE flags & 1 = 0 AND value_kind = 'text' AND NOT regexp_matches(v_text, '^[A-Z]$'))"""


def _issues(spark, d):
    return validation.issues(B.line_entries(spark, d), [
        ("discount_too_high", "error", (F.col("tag") == 3) & (F.col("v_double") > 0.09)), ("quantity_large", "warning", (F.col("tag") == 1) & (F.col("v_double") >= 45)),
        ("text_not_upper", "error", (F.col("value_kind") == "text") & ~F.rlike("v_text", F.lit("^[A-Z]$"))),
    ])


@query("validate_rules", f"WITH {_RULES} SELECT * FROM i")
def validate_rules(spark, d):
    return _issues(spark, d)


_TE = B.TYPED_ENTRIES_SQL


@query("validate_standard", f"""WITH {_TE}, k AS (SELECT *, CASE key_kind WHEN 'exif_tag' THEN ifd = '' WHEN 'xmp_property' THEN ns = '' WHEN 'png_text' THEN ns = '' ELSE false END AS bad,
    CASE value_kind WHEN 'scalar' THEN n <> 1 WHEN 'empty' THEN n <> 0 ELSE n <> held END AS shape FROM te), a AS (SELECT * FROM k WHERE NOT bad AND NOT gone), c AS (SELECT * FROM a WHERE NOT shape AND value_kind = 'scalar')
  SELECT asset_id, entry_id, 'invalid_key' AS code, 'error' AS severity FROM k WHERE bad
  UNION ALL SELECT asset_id, entry_id, 'invalid_key', 'error' FROM a WHERE key_kind = 'iptc_dataset' AND (record > 255 OR dataset > 255)
  UNION ALL SELECT asset_id, entry_id, 'invalid_value_shape', 'error' FROM a WHERE shape
  UNION ALL SELECT asset_id, entry_id, 'scalar_out_of_range', 'error' FROM c WHERE (elem_type = 'u8' AND (v < 0 OR v > 255)) OR (elem_type = 'i8' AND (v < -128 OR v > 127)) OR (elem_type = 'u16' AND v < 0)
  UNION ALL SELECT asset_id, entry_id, 'rational_denominator_zero', 'error' FROM c WHERE elem_type IN ('urational', 'srational') AND den = 0
    AND NOT (key_kind = 'xmp_property' AND elem_type = 'urational' AND num = 0 AND path IN ('LensSpecification[3]', 'LensSpecification[4]'))""")
def validate_standard(spark, d):
    return validation.standard_issues(B.typed_entries(spark, d))


#: A small tag schema: directory, tag, types, least and most count (0: no end).
TAG_SCHEMA = (("ifd0", 256, ["u16", "u32"], 1, 1), ("ifd0", 257, ["u16", "u32"], 1, 1), ("ifd0", 258, ["u16"], 2, 0), ("exififd", 259, ["urational"], 1, 1), ("exififd", 260, ["i8", "u8"], 1, 1), ("ifd0", 260, ["u16"], 0, 1))


@query("validate_schema", f"""WITH {_TE}, s(ifd, tag, types, lo, hi) AS (VALUES ('ifd0', 256, ['u16', 'u32'], 1, 1), ('ifd0', 257, ['u16', 'u32'], 1, 1), ('ifd0', 258, ['u16'], 2, 0), ('exififd', 259, ['urational'], 1, 1), ('exififd', 260, ['i8', 'u8'], 1, 1), ('ifd0', 260, ['u16'], 0, 1)),
  e AS (SELECT * FROM te WHERE key_kind = 'exif_tag' AND NOT gone)
  SELECT asset_id, entry_id, 'unknown_exif_tag' AS code, 'warning' AS severity FROM e WHERE tag NOT IN (SELECT tag FROM s)
  UNION ALL SELECT asset_id, entry_id, 'wrong_ifd', 'error' FROM e WHERE tag IN (SELECT tag FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.tag = e.tag AND s.ifd = e.ifd)
  UNION ALL SELECT asset_id, entry_id, 'wrong_type', 'error' FROM e JOIN s USING (ifd, tag) WHERE NOT list_contains(types, elem_type)
  UNION ALL SELECT asset_id, entry_id, 'wrong_count', 'error' FROM e JOIN s USING (ifd, tag) WHERE n < lo OR (hi <> 0 AND n > hi)""")
def validate_schema(spark, d):
    schema = spark.createDataFrame(list(TAG_SCHEMA), "ifd string, tag int, types array<string>, min_count int, max_count int")
    return validation.schema_issues(store.find_all(B.typed_entries(spark, d), key_kind="exif_tag"), schema)


@query("validate_image_context", f"""WITH {LE}, f AS (SELECT asset_id, tag, min(entry_id) AS entry_id, arg_min(v_double, entry_id) AS v FROM le WHERE flags & 1 = 0 AND tag IN (1, 3) GROUP BY ALL)
  SELECT f.asset_id, f.entry_id, f.tag FROM f JOIN orders o ON o.o_orderkey = f.asset_id WHERE (f.tag = 1 AND f.v <> o.o_custkey % 50 + 1) OR (f.tag = 3 AND f.v <> 0.05)""")
def validate_image_context(spark, d):
    o = table(spark, d, "orders")
    want = F.array(F.struct(F.lit(1).alias("tag"), (F.col("o_custkey") % 50 + 1).cast("double").alias("expected")), F.struct(F.lit(3).alias("tag"), F.lit(0.05).alias("expected")))
    context = o.select(F.col("o_orderkey").alias("asset_id"), F.explode(want).alias("w")).select("asset_id", "w.*")
    return validation.image_context_issues(B.line_entries(spark, d).where(F.col("tag").isin(1, 3)), context)


@query("validation_summary", f"""WITH {_RULES} SELECT asset_id, CAST(count_if(severity = 'error') AS BIGINT) AS n_errors, CAST(count_if(severity = 'warning') AS BIGINT) AS n_warnings, least(count(*), 3) AS n_reported,
  CASE WHEN count_if(severity = 'error') > 0 THEN 'invalid' ELSE 'valid_with_warnings' END AS status FROM i GROUP BY asset_id""")
def validation_summary(spark, d):
    return validation.summary(_issues(spark, d), 3)


@query("duplicate_singletons", f"""WITH {LE}, m AS (SELECT *, min(entry_id) OVER (PARTITION BY asset_id, ifd, tag) AS related_id FROM le WHERE flags & 1 = 0) SELECT asset_id, ifd, tag, entry_id, related_id FROM m WHERE entry_id > related_id""")
def duplicate_singletons(spark, d):
    return validation.duplicate_singletons(B.line_entries(spark, d), ["ifd", "tag"])


@query("required_missing", f"""WITH {DE}, r(name) AS (VALUES ('language'), ('quality'), ('rights')) SELECT d.doc_id AS asset_id, r.name AS missing FROM documents d CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.asset_id = d.doc_id AND de.name = r.name)""")
def required_missing(spark, d):
    e = B.doc_entries(spark, d).withColumn("flags", F.lit(0))
    return validation.required_missing(e, table(spark, d, "documents").select(F.col("doc_id").alias("asset_id")), ["language", "quality", "rights"], "name")


@query("forbidden_present", f"WITH {DE} SELECT asset_id, name, count(*) AS n FROM de WHERE name IN ('toxic', 'secret') GROUP BY ALL")
def forbidden_present(spark, d):
    return validation.forbidden_present(B.doc_entries(spark, d).withColumn("flags", F.lit(0)), ["toxic", "secret"], "name")


@query("edit_sequential_ops", """SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 4 = 0 THEN 'X,extra' WHEN o_orderkey % 4 = 1 THEN o_orderpriority || ',extra' WHEN o_orderkey % 4 = 2 THEN '' ELSE o_orderpriority END AS vals FROM orders""")
def edit_sequential_ops(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderpriority").alias("value"))
    op = lambda cond, seq, name, v: o.where(cond).select("asset_id", F.lit(seq).alias("seq"), F.lit(name).alias("op"), F.lit(v).cast("string").alias("value"))
    ops = op("asset_id % 4 = 0", 1, "set", "X").unionAll(op("asset_id % 4 in (0, 1)", 2, "add", "extra")).unionAll(op("asset_id % 4 = 2", 3, "remove", None))
    return editing.sequential(o, ops, ["asset_id"]).select("asset_id", F.array_join("vals", ",").alias("vals"))


@query("flat_import_unique", f"""WITH {LE}, n AS (SELECT asset_id, ifd || ':' || tag AS name, count(*) AS n, min(entry_id) AS entry_id FROM le WHERE flags & 1 = 0 GROUP BY ALL)
  SELECT o_orderkey AS asset_id, 'ln1:4' AS name, CASE WHEN n = 1 THEN entry_id END AS entry_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM orders LEFT JOIN n ON n.asset_id = o_orderkey AND n.name = 'ln1:4'""")
def flat_import_unique(spark, d):
    e = store.live(B.line_entries(spark, d)).withColumn("name", F.concat("ifd", F.lit(":"), F.col("tag").cast("string")))
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.lit("ln1:4").alias("name"), F.lit(1.0).alias("value"))
    return editing.import_unique(items, e)


def _descriptive(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("asset_id"), F.explode(F.array(
        F.struct(F.lit("source").alias("name"), F.col("source").alias("value")), F.struct(F.lit("country_code").alias("name"), F.concat("lang", F.lit("-x")).alias("value")),
        F.struct(F.lit("description").alias("name"), F.col("text").alias("value")), F.struct(F.lit("unmapped").alias("name"), F.col("lang").alias("value")),
    )).alias("e")).select("asset_id", "e.*")


_MAP = """m AS (SELECT doc_id AS asset_id, 'source' AS name, 115 AS dataset, 32 AS cap, source AS value FROM documents UNION ALL SELECT doc_id, 'country_code', 100, 3, lang || '-x' FROM documents UNION ALL SELECT doc_id, 'description', 120, 2000, text FROM documents)"""


@query("translate_map", f"WITH {_MAP} SELECT asset_id, name, CAST(dataset AS INTEGER) AS dataset, CASE WHEN strlen(value) <= cap THEN value END AS value FROM m")
def translate_map(spark, d):
    return editing.translated(_descriptive(spark, d), editing.mapping(spark)).select("asset_id", "name", "dataset", "value")


@query("translate_truncate_check", f"WITH {_MAP} SELECT name, CASE WHEN strlen(value) > cap THEN 'too_long' ELSE 'fits' END AS status, count(*) AS n, CAST(max(strlen(value)) AS BIGINT) AS longest FROM m GROUP BY ALL")
def translate_truncate_check(spark, d):
    return editing.translated(_descriptive(spark, d), editing.mapping(spark)).groupBy("name", "status").agg(F.count("*").alias("n"), F.max("bytes").alias("longest"))


_FAM = f"""{PE}, f AS (SELECT page_id AS asset_id, (SELECT max(v) FROM pe WHERE pe.asset_id = page_id AND role = 'title' AND block_id = 0) AS xmp, CASE WHEN page_id % 3 = 0 THEN 'other' WHEN page_id % 3 = 1 THEN (SELECT max(v) FROM pe WHERE pe.asset_id = page_id AND role = 'title' AND block_id = 1) END AS iptc FROM pages)"""


def _families(spark, d):
    t = B.page_entries(spark, d).where("role = 'title'").groupBy("asset_id").agg(F.max(F.when(F.col("block_id") == 0, F.col("v"))).alias("xmp"), F.max(F.when(F.col("block_id") == 1, F.col("v"))).alias("h1"))
    p = table(spark, d, "pages").select(F.col("page_id").alias("asset_id")).join(t, "asset_id", "left")
    return p.select("asset_id", "xmp", F.when(F.col("asset_id") % 3 == 0, "other").when(F.col("asset_id") % 3 == 1, F.col("h1")).alias("iptc"))


@query("reconcile_priority", f"WITH {_FAM} SELECT asset_id, xmp, iptc, coalesce(iptc <> xmp, false) AS conflict, coalesce(iptc, xmp) AS value, CASE WHEN iptc IS NOT NULL THEN 'iptc' WHEN xmp IS NOT NULL THEN 'xmp' END AS source FROM f")
def reconcile_priority(spark, d):
    return editing.reconciled(_families(spark, d), ["iptc", "xmp"])


@query("reconcile_fail_conflict", f"""WITH {_FAM} SELECT asset_id, xmp, iptc, coalesce(iptc <> xmp, false) AS conflict, CASE WHEN NOT coalesce(iptc <> xmp, false) THEN coalesce(iptc, xmp) END AS value,
  CASE WHEN coalesce(iptc <> xmp, false) THEN 'conflict' WHEN coalesce(iptc, xmp) IS NULL THEN 'empty' ELSE 'ok' END AS status FROM f""")
def reconcile_fail_conflict(spark, d):
    return editing.reconciled(_families(spark, d), ["iptc", "xmp"], "fail")


@query("decode_iptc", "SELECT doc_id AS asset_id, 0 AS order_in_block, 2 AS record, 115 AS dataset, source AS v_text FROM documents UNION ALL SELECT doc_id, 1, 2, 25, lang FROM documents UNION ALL SELECT doc_id, 2, 2, 120, text FROM documents")
def decode_iptc(spark, d):
    """Fields of documents written as dataset records and decoded again."""
    docs = table(spark, d, "documents")

    def rec(ds: int, c):
        size = F.octet_length(c)
        # two bytes of length, or, from 32768 on, the extended form: how many bytes the length has, then the length
        length = F.when(size < 32768, F.lpad(F.hex(size), 4, "0")).otherwise(F.concat(F.lit("8004"), F.lpad(F.hex(size), 8, "0")))
        return F.concat(F.unhex(F.concat(F.lit(f"1C02{ds:02X}"), length)), c.cast("binary"))

    raw = docs.select(F.col("doc_id").alias("asset_id"), F.concat(rec(115, F.col("source")), rec(25, F.col("lang")), rec(120, F.col("text"))).alias("content"))
    return decoders.decoded(raw, "iptc").select("asset_id", "order_in_block", "record", "dataset", F.decode("v_bytes", "UTF-8").alias("v_text"))


@query("decode_png_text", "SELECT page_id AS asset_id, 'url' AS name, url AS v_text FROM pages UNION ALL SELECT page_id, 'html', html FROM pages")
def decode_png_text(spark, d):
    """Columns of pages written as text chunks and decoded again."""
    pages = table(spark, d, "pages")

    def chunk(keyword: str, c):
        body = F.concat(F.lit(keyword).cast("binary"), F.lit(bytes(1) * 5), c.cast("binary"))
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), F.lit(b"iTXt"), body, F.lit(bytes(4)))

    raw = pages.select(F.col("page_id").alias("asset_id"), F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), chunk("url", F.col("url")), chunk("html", F.col("html"))).alias("content"))
    return decoders.decoded(raw, "png").select("asset_id", "name", "v_text")
