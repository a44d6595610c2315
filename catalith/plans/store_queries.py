"""Queries over the store: statistics, lookups, scopes, commits, names, assembly and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.operators import assembly, graph, names, store
from catalith.plans.registry import query
from catalith.session import table
from catalith.sources import bridge as B

LE, LB = B.LINE_ENTRIES_SQL, B.LINE_BLOCKS_SQL


@query("entry_unpivot", f"WITH {LE} SELECT asset_id, entry_id, block_id, order_in_block, ifd, tag, value_kind, elem_type, v_double, v_text, flags FROM le")
def entry_unpivot(spark, d):
    return B.line_entries(spark, d).drop("key_kind")


@query("store_stats", f"""WITH {LE} SELECT ifd, value_kind, elem_type, count(*) AS n_entries, count(DISTINCT asset_id) AS n_assets,
  CAST(sum(flags & 1) AS BIGINT) AS n_deleted FROM le GROUP BY ALL""")
def store_stats(spark, d):
    return store.corpus_stats(B.line_entries(spark, d))


@query("duplicate_keys_top10", f"""WITH {LE}, g AS (SELECT asset_id, ifd, tag, count(*) AS n FROM le WHERE flags & 1 = 0 GROUP BY ALL HAVING count(*) > 1)
  SELECT ifd, tag, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_entries FROM g GROUP BY ALL ORDER BY n_entries DESC, ifd, tag LIMIT 10""")
def duplicate_keys_top10(spark, d):
    return store.duplicate_keys(B.line_entries(spark, d), ["ifd", "tag"], 10)


@query("key_index_runs", f"WITH {LE} SELECT asset_id, ifd, tag, count(*) AS n, min(entry_id) AS first_id FROM le WHERE flags & 1 = 0 GROUP BY ALL")
def key_index_runs(spark, d):
    return store.key_runs(B.line_entries(spark, d), ["ifd", "tag"])


@query("block_spans", f"""WITH {LE}, g AS (SELECT asset_id, block_id, count(*) AS n FROM le GROUP BY ALL)
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY asset_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g""")
def block_spans(spark, d):
    return store.block_spans(B.line_entries(spark, d))


@query("find_all_key", f"WITH {LE} SELECT asset_id, entry_id, v_double FROM le WHERE flags & 1 = 0 AND ifd = 'ln2' AND tag = 1")
def find_all_key(spark, d):
    return store.find_all(B.line_entries(spark, d), ifd="ln2", tag=1).select("asset_id", "entry_id", "v_double")


@query("entries_in_block_order", f"""WITH {LE} SELECT asset_id, entry_id, CAST(row_number() OVER (PARTITION BY asset_id, block_id ORDER BY order_in_block, entry_id) AS INTEGER) AS pos
  FROM le WHERE block_id = 1""")
def entries_in_block_order(spark, d):
    w = Window.partitionBy("asset_id", "block_id").orderBy("order_in_block", "entry_id")
    return store.find_all(B.line_entries(spark, d).withColumn("flags", F.lit(0)), block_id=1).select("asset_id", "entry_id", F.row_number().over(w).alias("pos"))


@query("scope_semi", f"""WITH {LE}, s(block_id, ifd) AS (VALUES (0, 'ln1'), (2, 'ln3'), (1, ''))
  SELECT asset_id, entry_id FROM le WHERE EXISTS (SELECT 1 FROM s WHERE s.block_id = le.block_id AND (s.ifd = '' OR s.ifd = le.ifd))""")
def scope_semi(spark, d):
    sel = spark.createDataFrame([(0, "ln1"), (2, "ln3"), (1, "")], "block_id long, ifd string")
    return store.in_scope(B.line_entries(spark, d), sel).select("asset_id", "entry_id")


@query("scope_wildcard_block", f"WITH {LE} SELECT asset_id, count(*) AS n FROM le WHERE block_id = 1 GROUP BY ALL")
def scope_wildcard_block(spark, d):
    return store.in_scope(B.line_entries(spark, d), spark.createDataFrame([(1, "")], "block_id long, ifd string")).groupBy("asset_id").agg(F.count("*").alias("n"))


@query("scope_empty", f"WITH {LE} SELECT asset_id, entry_id FROM le WHERE false")
def scope_empty(spark, d):
    return store.in_scope(B.line_entries(spark, d), spark.createDataFrame([], "block_id long, ifd string")).select("asset_id", "entry_id")


@query("companion_first", f"""WITH {LE}, c AS (SELECT asset_id, block_id, ifd, min(entry_id) AS tax_id FROM le WHERE tag = 4 AND flags & 1 = 0 GROUP BY ALL)
  SELECT le.asset_id, le.entry_id, c.tax_id FROM le LEFT JOIN c USING (asset_id, block_id, ifd) WHERE le.tag = 1 AND le.flags & 1 = 0""")
def companion_first(spark, d):
    e = B.line_entries(spark, d)
    return store.companion(store.find_all(e, tag=1), e, 4, "tax_id").select("asset_id", "entry_id", "tax_id")


def _order_base(spark, d):
    o = table(spark, d, "orders")
    base = o.select(F.col("o_orderkey").alias("asset_id"), F.lit(0).cast("long").alias("entry_id"), F.col("o_totalprice").alias("v_double"), F.lit(0).alias("flags")).unionAll(
        o.select("o_orderkey", F.lit(1).cast("long"), F.col("o_custkey").cast("double"), F.lit(0)))
    edits = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("asset_id"), F.lit(1).alias("seq"), F.lit("set").alias("op"), F.lit(0).cast("long").alias("target_id"), F.lit(0.5).alias("v_double")).unionAll(
        o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(2), F.lit("tombstone"), F.lit(1).cast("long"), F.lit(None).cast("double"))).unionAll(
        o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(3), F.lit("add"), F.lit(None).cast("long"), F.lit(7.0)))
    return base, edits


_COMMIT = """SELECT o_orderkey AS asset_id, 0 AS entry_id, CASE WHEN {ok} AND o_orderkey % 3 = 0 THEN 0.5 ELSE o_totalprice END AS v_double, CASE WHEN {ok} AND o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS flags FROM orders
  UNION ALL SELECT o_orderkey, 1, CAST(o_custkey AS DOUBLE), CASE WHEN {ok} AND o_orderkey % 5 = 0 THEN 3 ELSE 0 END FROM orders
  UNION ALL SELECT o_orderkey, 2, 7.0, 2 FROM orders WHERE o_orderkey % 2 = 0 AND {ok}"""


@query("commit_add_set_tombstone", _COMMIT.format(ok="true"))
def commit_add_set_tombstone(spark, d):
    return store.commit(*_order_base(spark, d))


@query("commit_rollback_on_limit", _COMMIT.format(ok="o_orderkey % 2 <> 0"))
def commit_rollback_on_limit(spark, d):
    return store.commit(*_order_base(spark, d), max_entries=2)


@query("compact_renumber", f"WITH c AS ({_COMMIT.format(ok='true')}) SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY entry_id) - 1 AS entry_id, v_double, flags FROM c WHERE flags & 1 = 0")
def compact_renumber(spark, d):
    return store.compact(store.commit(*_order_base(spark, d)))


@query("canonical_names", f"""WITH {B.DOC_ENTRIES_SQL} SELECT asset_id, name, CASE key_kind WHEN 'xmp_property' THEN 'xmp:' || ns || ':' || name WHEN 'iptc_dataset' THEN 'iptc:' || record || ':' || dataset
  WHEN 'bmff_field' THEN 'bmff:' || name ELSE 'png_text:' || ns || ':' || name END AS canonical FROM de""")
def canonical_names(spark, d):
    e = B.doc_entries(spark, d).withColumn("path", F.col("name"))
    return e.select("asset_id", "name", names.canonical_name(e).alias("canonical"))


@query("flat_names", f"""WITH {B.DOC_ENTRIES_SQL} SELECT asset_id, CASE key_kind WHEN 'xmp_property' THEN 'DC:' || name WHEN 'iptc_dataset' THEN 'IPTC:' || name END AS flat, count(*) AS n
  FROM de WHERE key_kind IN ('xmp_property', 'iptc_dataset') GROUP BY ALL""")
def flat_names(spark, d):
    e = B.doc_entries(spark, d)
    return e.withColumn("flat", names.flat_name()).where("flat is not null").groupBy("asset_id", "flat").agg(F.count("*").alias("n"))


@query("exif_canonical_names", f"WITH {LE} SELECT DISTINCT ifd, tag, 'exif:' || ifd || ':0x' || printf('%04X', tag) AS canonical FROM le")
def exif_canonical_names(spark, d):
    e = B.line_entries(spark, d)
    return e.select("ifd", "tag", names.canonical_name(e).alias("canonical")).distinct()


@query("value_text", f"WITH {LE} SELECT asset_id, entry_id, CASE WHEN value_kind = 'text' THEN v_text ELSE printf('%.4f', v_double) END AS display FROM le WHERE flags & 1 = 0")
def value_text(spark, d):
    return store.live(B.line_entries(spark, d)).select("asset_id", "entry_id", T.display("value_kind", "v_double", "v_text", 4).alias("display"))


@query("rational_text", f"""WITH {LB} SELECT l_orderkey AS asset_id, block_id, CAST(round(l_discount * 100) AS BIGINT) || '/100' AS rational,
  CAST(CAST(round(l_discount * 100) AS BIGINT) // gcd(CAST(round(l_discount * 100) AS BIGINT), 100) AS BIGINT) AS num, CAST(100 // gcd(CAST(round(l_discount * 100) AS BIGINT), 100) AS BIGINT) AS den FROM lb""")
def rational_text(spark, d):
    n = F.round(F.col("l_discount") * 100).cast("long")
    r = T.reduced(n, F.lit(100).cast("long"))
    return B.line_blocks(spark, d).select(F.col("l_orderkey").alias("asset_id"), "block_id", T.ratio_text(n, F.lit(100)).alias("rational"), r["num"].alias("num"), r["den"].alias("den"))


@query("orientation_decompose", """SELECT p_partkey AS asset_id, p_size % 9 AS code, p_size % 9 BETWEEN 1 AND 8 AS valid, p_size % 9 IN (2, 4, 5, 7) AS mirrored, p_size % 9 BETWEEN 5 AND 8 AS swaps,
  CASE WHEN p_size % 9 IN (3, 4) THEN 180 WHEN p_size % 9 IN (5, 8) THEN 270 WHEN p_size % 9 IN (6, 7) THEN 90 ELSE 0 END AS rotation_cw FROM part""")
def orientation_decompose(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_size") % 9).alias("code"))
    return p.select("asset_id", "code", *names.orientation("code"))


@query("label_lookup", """SELECT o_orderkey AS asset_id, o_orderstatus AS code, coalesce(v.label, 'unknown(' || o_orderstatus || ')') AS label FROM orders LEFT JOIN (VALUES ('F', 'finished'), ('O', 'open')) v(code, label) ON v.code = o_orderstatus""")
def label_lookup(spark, d):
    dim = spark.createDataFrame([("F", "finished"), ("O", "open")], "code string, label string")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderstatus").alias("code"))
    return names.labelled(o, dim, "code")


_TB = "tb AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS rn, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations), tk AS (SELECT * FROM tb WHERE (conv_id * 7 + turn) % 5 <> 0)"


@query("assemble_sequence", f"WITH {_TB} SELECT conv_id AS asset_id, count(*) AS parts, string_agg(text, chr(10) ORDER BY turn) AS payload FROM conversations GROUP BY conv_id")
def assemble_sequence(spark, d):
    return assembly.joined(assembly.parts(table(spark, d, "conversations")), "\n")


@query("assemble_gaps", f"""WITH {_TB}, g AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, total FROM tk)
  SELECT conv_id AS asset_id, count(*) AS parts, any_value(total) AS part_count, CAST(sum(CASE WHEN turn <> coalesce(prev, -1) + 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps,
  CASE WHEN count(*) = any_value(total) AND min(turn) = 0 THEN 'ok' ELSE 'malformed' END AS status FROM g GROUP BY conv_id""")
def assemble_gaps(spark, d):
    p = assembly.parts(table(spark, d, "conversations")).where((F.col("asset_id") * 7 + F.col("part_index")) % 5 != 0)
    return assembly.completeness(p)


@query("assemble_offsets", """SELECT conv_id AS asset_id, turn AS part_index, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset,
  CAST(strlen(text) AS BIGINT) AS logical_size FROM conversations""")
def assemble_offsets(spark, d):
    return assembly.offsets(assembly.parts(table(spark, d, "conversations"))).select("asset_id", "part_index", "logical_offset", "logical_size")


@query("range_extents", """WITH o AS (SELECT conv_id, turn, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, strlen(text) AS n FROM conversations)
  SELECT conv_id AS asset_id, turn AS part_index, CAST(greatest(a, 50) - a AS BIGINT) AS from_byte, CAST(least(a + n, 250) - a AS BIGINT) AS to_byte FROM o WHERE a < 250 AND a + n > 50""")
def range_extents(spark, d):
    o = assembly.offsets(assembly.parts(table(spark, d, "conversations")))
    return assembly.slice_extents(o, 50, 250)


@query("graph_degree", """SELECT l_returnflag AS ref_type, count(*) AS n_edges, count(DISTINCT l_orderkey) AS n_from, count(DISTINCT l_partkey) AS n_to FROM lineitem GROUP BY ALL""")
def graph_degree(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("ref_type"), F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"))
    return graph.typed_degrees(e)


@query("graph_linked_roles", """WITH e AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS t, l_linestatus AS r FROM lineitem)
  SELECT a.t AS primary_id, b.r AS role, count(DISTINCT b.t) AS linked FROM e a JOIN e b ON a.f = b.f AND a.t <> b.t GROUP BY ALL""")
def graph_linked_roles(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_linestatus").alias("ref_type"))
    return graph.linked_roles(e)


@query("container_sniff", """SELECT page_id AS asset_id, CASE WHEN lower(substr(ltrim(html), 1, 9)) = '<!doctype' THEN 'html' WHEN lower(substr(ltrim(html), 1, 5)) = '<html' THEN 'html' WHEN substr(ltrim(html), 1, 5) = '<?xml' THEN 'xml'
  WHEN substr(ltrim(html), 1, 1) IN ('{', '[') THEN 'json' ELSE 'unsupported' END AS format, CAST(strlen(html) AS BIGINT) AS size FROM pages""")
def container_sniff(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("asset_id"), T.text_format("html").alias("format"), F.octet_length("html").cast("long").alias("size"))


@query("page_carriers", f"WITH {B.PAGE_ENTRIES_SQL} SELECT asset_id, block_id, role, v FROM pe")
def page_carriers(spark, d):
    return B.page_entries(spark, d).select("asset_id", "block_id", "role", "v")


@query("json_entries", """SELECT event_id AS asset_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_entries(spark, d):
    return B.events(spark, d).select(F.col("event_id").alias("asset_id"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("text_dump", f"""WITH {B.DOC_ENTRIES_SQL} SELECT asset_id, string_agg(block_id || ':' || name || '=' || coalesce(v, ''), ';' ORDER BY block_id, name) AS dump FROM de GROUP BY asset_id""")
def text_dump(spark, d):
    line = F.concat(F.col("block_id").cast("string"), F.lit(":"), "name", F.lit("="), F.coalesce("v", F.lit("")))
    return B.doc_entries(spark, d).groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "name", line.alias("l")))), lambda x: x["l"]), ";").alias("dump"))


@query("audit_flags", """SELECT d.source, count(*) AS n, CAST(count_if(l.toxic = 1) AS BIGINT) AS n_toxic, CAST(count_if(l.doc_id IS NULL) AS BIGINT) AS n_unlabelled, CAST(count_if(d.n_chars <> length(d.text)) AS BIGINT) AS n_bad_size,
  CASE WHEN count_if(l.toxic = 1) > 0 THEN 'review' ELSE 'pass' END AS decision FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def audit_flags(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("quality").isNull()).alias("n_unlabelled"), F.count_if(F.col("n_chars") != F.length("text")).alias("n_bad_size"),
        F.when(F.count_if(F.col("toxic") == 1) > 0, "review").otherwise("pass").alias("decision"),
    )
