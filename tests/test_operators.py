"""Operators on small hand-made tables."""

import re
import struct

import pytest

from catalith import session
from catalith.functions import dates, text
from catalith.operators import assembly, concepts, editing, graph, names, search, semantic, store, validation
from catalith.plans import query_queries
from catalith.sources import decoders
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tombstones_are_hidden_and_duplicates_kept(spark):
    e = spark.createDataFrame([(1, i, 0, "ifd0", 5, f) for i, f in enumerate((0, 1, 0))], "asset_id long, entry_id long, block_id long, ifd string, tag int, flags int")
    assert [r.entry_id for r in store.find_all(e, ifd="ifd0", tag=5).orderBy("entry_id").collect()] == [0, 2]
    assert [r.entry_id for r in store.compact(e).orderBy("entry_id").collect()] == [0, 1]


def test_scope_none_selects_all_and_empty_nothing(spark):
    e = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "block_id long, ifd string")
    none = spark.createDataFrame([], "block_id long, ifd string")
    assert store.in_scope(e, None).count() == 3 and store.in_scope(e, none).count() == 0
    assert store.in_scope(e, spark.createDataFrame([(0, "")], "block_id long, ifd string")).count() == 2


def test_commit_rolls_back_over_the_limit(spark):
    base = spark.createDataFrame([(1, 0, 1.0, 0), (2, 0, 2.0, 0)], "asset_id long, entry_id long, v_double double, flags int")
    edits = spark.createDataFrame([(1, 1, "add", None, 9.0), (1, 2, "set", 0, 5.0), (2, 1, "set", 0, 6.0)], "asset_id long, seq int, op string, target_id long, v_double double")
    assert rows(store.commit(base, edits)) == [(1, 0, 5.0, 2), (1, 1, 9.0, 2), (2, 0, 6.0, 2)]
    assert rows(store.commit(base, edits, max_entries=1)) == [(1, 0, 1.0, 0), (2, 0, 6.0, 2)]
    # an asset without base entries
    adds = spark.createDataFrame([(7, 2, "add", None, 3.0), (7, 1, "add", None, 4.0)], edits.schema)
    assert rows(store.commit(base.where("false"), adds)) == [(7, 0, 4.0, 2), (7, 1, 3.0, 2)]
    assert rows(store.commit(base.where("false"), adds, max_entries=1)) == []


@pytest.mark.parametrize(("kind", "row", "want"), [
    ("exif_tag", {"ifd": "ifd0", "tag": 0x112}, "exif:ifd0:0x0112"), ("comment", {}, "comment"), ("icc_tag", {"num_key": 0x64657363}, "icc:tag:0x64657363"), ("geotiff_key", {"num_key": 1024}, "geotiff:1024"), ("jumbf_field", {"name": "x"}, "jumbf:x"),
])
def test_canonical_names(spark, kind, row, want):
    schema = "key_kind string, ifd string, tag int, num_key long, name string"
    df = spark.createDataFrame([(kind, row.get("ifd"), row.get("tag"), row.get("num_key"), row.get("name"))], schema)
    got = df.select(names.canonical_name(df)).first()[0]
    assert got == want


def test_names_split_acronyms_and_camel_case(spark):
    df = spark.createDataFrame([("GPSLatitude",), ("AAaBb",), ("ISO100Speed",), ("a--b_c",)], "n string")
    assert [r[0] for r in df.select(text.normalised_name("n")).collect()] == ["gps latitude", "a aa bb", "iso100 speed", "a b c"]


@pytest.mark.parametrize(("q", "least", "k", "want"), [
    ("", 80, 8, "empty_query"), ("wb", 80, 8, "query_too_short"), ("x" * 257, 80, 8, "query_too_long"), ("é", 80, 8, "unsupported_query_text"), ("abc", 49, 8, "invalid_options"), ("abc", 80, 0, "invalid_options"), ("abc", 80, 257, "invalid_options"), ("abc", 80, 8, "ok"),
])
def test_search_contract(q, least, k, want):
    assert search.query_status(q, least, k) == want


def test_search_ranks_exact_alias_similar(spark):
    e = spark.createDataFrame([(3, "Creator"), (1, "Author"), (2, "Creatr"), (0, "Other"), (4, "creator tool")], "id long, name string")
    got = [(r.rank, r.id, r.score, r.kind) for r in search.fuzzy_top_k(e, "name", ["creator"], [("creator", "author")], least=80, k=4).orderBy("rank").collect()]
    assert got[:3] == [(1, 3, 100.0, "exact"), (2, 4, 100.0, "exact"), (3, 1, 96.0, "alias")] and got[3][1] == 2 and got[3][3] == "fuzzy"


def test_search_equals_brute_force(spark, sf):
    """Every name against every query, by the ratio alone."""
    part = [(r.p_partkey, r.p_name) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name").collect()]
    part += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "gren gizmo"), (10**6 + 3, "Gren  Gizmo"), (10**6 + 4, "a" * 5000)]
    e = spark.createDataFrame(part, "id long, name string")
    queries, aliases = ["red plte", "azure gizmo", "gren gizmo"], [("azure gizmo", "blue gizmo")]
    norm = {r.id: r.n for r in e.select("id", text.normalised_name("name").alias("n")).collect()}
    want = []
    for q in queries:
        found = []
        for i, n in norm.items():
            if n:
                hits = [(-min(round(search.best_window_ratio(q, n), 6), 95.0), 2)]
                hits += [(-100.0, 0)] if f" {q} " in f" {n} " else []
                hits += [(-96.0, 1) for k, a in aliases if k == q and f" {a} " in f" {n} "]
                found.append((*min(hits), i))
        want += [(q, at + 1, i, -s, ("exact", "alias", "fuzzy")[kind]) for at, (s, kind, i) in enumerate(sorted(x for x in found if -x[0] >= 60)[:8])]
    got = [tuple(r) for r in search.fuzzy_top_k(e, "name", queries, aliases, least=60, k=8).collect()]
    assert sorted(got) == sorted(want) and len(want) > 8


def test_indel_ratio():
    assert search.indel_ratio("abc", "abc") == 100 and search.indel_ratio("abc", "xyz") == 0 and search.indel_ratio("", "a") == 0
    assert search.indel_ratio("abcd", "abxd") == pytest.approx(75.0)


def test_dates(spark):
    df = spark.createDataFrame([("2024:02:30 10:00:00",), ("2024-02-29T23:59:58Z",), ("on 2024/1",), ("20240131",), ("2024:01:31 25:00:00",), (None,)], "t string")
    got = [r.p and (str(r.p.day), r.p.second, r.p.precision) for r in df.select(dates.parsed_datetime(F.col("t")).alias("p")).collect()]
    assert got == [None, ("2024-02-29", 86398, "second"), None, ("2024-01-31", 0, "day"), ("2024-01-31", 0, "day"), None]
    off = spark.createDataFrame([("x+02:30",), ("x-0100",), ("Z",), ("x",)], "t string").select(dates.offset_minutes(F.col("t"))).collect()
    assert [r[0] for r in off] == [150, -60, 0, None]


def test_rational_keeps_zero_denominator_text_and_reduces(spark):
    df = spark.createDataFrame([(50, 100), (0, 100), (7, 100)], "n long, d long")
    assert [tuple(r[0]) for r in df.select(text.reduced(F.col("n"), F.col("d"))).collect()] == [(1, 2), (0, 1), (7, 100)]


def test_conflicts_and_preferred(spark):
    c = spark.createDataFrame([(1, 0, 90, "a"), (1, 1, 100, "b"), (1, 2, 100, "c"), (2, 0, 1, "z")], "asset_id long, idx int, priority int, value string")
    assert {(r.asset_id, r.conflict) for r in concepts.conflicts(c, ["asset_id"]).collect()} == {(1, True), (2, False)}
    assert {r.asset_id: r.value for r in concepts.preferred(c, ["asset_id"]).collect()} == {1: "b", 2: "z"}


def test_budget_cuts_a_prefix(spark):
    df = spark.createDataFrame([("a", i, 4) for i in range(3)], "g string, i int, n long")
    assert [r.returned for r in semantic.budgeted(df, ["g"], ["i"], "n", 6).orderBy("i").collect()] == [4, 2, 0]


def test_term_rules_and_confidence(spark):
    df = spark.createDataFrame([("DefaultCropOrigin",), ("LensDistortCorrection",), ("WBShift",), ("nothing",)], "name string")
    got = {(r.name, r.kind): r.c for r in semantic.match_terms(df, "name").withColumn("c", semantic.confidence(F.col("kind"), F.col("terms"))).collect()}
    assert got[("DefaultCropOrigin", "crop")] == 90 and got[("LensDistortCorrection", "lens_correction")] == 92 and got[("WBShift", "white_balance")] == 90 and not any(k[0] == "nothing" for k in got)


def test_sequential_edits_run_in_order(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, value string")
    ops = spark.createDataFrame([(1, 2, "add", "y"), (1, 1, "set", "x"), (2, 1, "remove", None), (3, 1, "add", "n")], "k long, seq int, op string, value string")
    assert {r.k: r.vals for r in editing.sequential(base, ops, ["k"]).collect()} == {1: ["x", "y"], 2: [], 3: ["n"]}


def test_validation_and_gaps(spark):
    e = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "a", 0), (1, 2, "b", 1)], "asset_id long, entry_id long, name string, flags int")
    assert rows(validation.duplicate_singletons(e, ["name"])) == [(1, "a", 1, 0)]
    p = spark.createDataFrame([(1, 0, 2, "x"), (1, 1, 2, "y"), (2, 1, 2, "z")], "asset_id long, part_index int, part_count long, content string")
    assert {r.asset_id: (r.gaps, r.status) for r in assembly.completeness(p).collect()} == {1: (0, "ok"), 2: (1, "malformed")}


def _tiff(order: str) -> bytes:
    o = "<" if order == "II" else ">"
    entries = struct.pack(o + "HHIHH", 0x112, 3, 1, 6, 0) + struct.pack(o + "HHII", 0x10F, 2, 6, 100) + struct.pack(o + "HHII", 0x11A, 5, 1, 110) + struct.pack(o + "HHII", 0x8769, 4, 1, 120)
    sub = struct.pack(o + "H", 1) + struct.pack(o + "HHII", 0x9000, 2, 4, int.from_bytes(b"0231", "little" if o == "<" else "big")) + bytes(4)
    head = order.encode() + struct.pack(o + "HI", 42, 8) + struct.pack(o + "H", 4) + entries + bytes(4)
    return head.ljust(100, b"\0") + b"Maker\0".ljust(10, b"\0") + struct.pack(o + "II", 72, 0).ljust(10, b"\0") + sub


@pytest.mark.parametrize("order", ["II", "MM"])
def test_tiff(order):
    got = {(r["ifd"], r["tag"]): r for r in decoders.tiff(_tiff(order)) if r.get("key_kind")}
    assert got[("ifd0", 0x112)]["v_num"] == 6 and got[("ifd0", 0x10F)]["v_text"] == "Maker" and got[("ifd0", 0x11A)]["v_text"] == "72/0" and got[("ifd0", 0x11A)]["v_num"] is None
    assert got[("exififd", 0x9000)]["v_text"] == "0231"


def test_iptc_icc_jpeg():
    long = b"\x1c\x02\x78\x80\x04\0\0\0\x03abc"
    assert [r.get("v_bytes") or r["status"] for r in decoders.iptc(b"\x1c\x02\x05\0\x02hi" + long + b"\x1c\x02\x05\0\x09x")] == [b"hi", b"abc", "truncated"]
    icc = bytearray(160)
    icc[36:40], icc[128:132], icc[132:144] = b"acsp", (1).to_bytes(4, "big"), b"desc" + struct.pack(">II", 144, 16)
    assert [r for r in decoders.icc(bytes(icc)) if r["key_kind"] == "icc_tag"][0]["num_key"] == 0x64657363
    assert next(decoders.icc(b"x" * 200))["status"] == "malformed"
    exif = b"Exif\0\0II*\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xfe\0\x04hi\xff\xda\0\x02"
    assert [r["name"] for r in decoders.jpeg(jpeg)] == ["exif", "comment"]


@pytest.mark.parametrize("kind", sorted(decoders.DECODERS))
def test_hostile_bytes_give_a_status(spark, kind):
    blobs = [b"", b"\0", b"II*\0\xff\xff\xff\xff", b"\x89PNG\r\n\x1a\n\0\0\0\x09zTXta\0\0xx\0\0\0\0", bytes(range(256)), b"\x1c" * 9, None]
    df = spark.createDataFrame(list(enumerate(blobs)), "asset_id long, content binary")
    assert {r.status for r in decoders.decoded(df, kind).collect()} <= {"ok", "truncated", "malformed"}


def test_binaries_are_read_and_sniffed(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(_tiff("II"))
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    got = {r.path.rsplit("/", 1)[1]: r.format for r in decoders.read_binaries(spark, str(tmp_path)).collect()}
    assert got == {"a.tif": "tiff", "b.png": "png"}


def test_standard_validation(spark):
    schema = "asset_id long, entry_id long, key_kind string, ifd string, ns string, path string, name string, record int, dataset int, value_kind string, elem_type string, count long, v_double double, v_ratio struct<num:long,den:long>, v_nums array<double>, v_text string, v_bytes binary, flags int"
    xmp = ("xmp_property", None, "http://ns.adobe.com/exif/1.0/", "LensSpecification[3]", None, None, None)
    exif = ("exif_tag", "ifd0", None, None, None, None, None)
    data = [
        (*exif, "scalar", "u8", 1, 256.0, None, None, None, None, 0), (*exif, "scalar", "u8", 1, 256.0, None, None, None, None, 1), ("exif_tag", None, *exif[2:], "scalar", "u8", 1, 300.0, None, None, None, None, 1),
        (*xmp, "scalar", "urational", 1, None, (0, 0), None, None, None, 0), (*xmp, "scalar", "srational", 1, None, (0, 0), None, None, None, 0), (*xmp, "scalar", "urational", 1, None, (1, 0), None, None, None, 0),
        (*exif, "text", None, 3, None, None, None, "ab", None, 0), (*exif, "text", None, 9, None, None, None, "x" * 9, None, 0), (*exif, "empty", None, None, None, None, None, None, None, 0), (*exif, None, None, None, None, None, None, None, None, 0),
        ("iptc_dataset", None, None, None, None, 2, 256, "scalar", "i8", 1, -128.0, None, None, None, None, 0), ("exif_tag", "i" * 20, *exif[2:], "empty", None, 0, None, None, None, None, None, 0),
    ]
    e = spark.createDataFrame([(1, i, *r) for i, r in enumerate(data)], schema)
    got = sorted((r.entry_id, r.code) for r in validation.standard_issues(e, max_key_bytes=16, max_value_bytes=8).collect())
    # key columns shorter than the namespace of the aperture rows need a larger bound
    wide = sorted((r.entry_id, r.code) for r in validation.standard_issues(e, max_value_bytes=8).collect())
    assert wide == [(0, "scalar_out_of_range"), (2, "invalid_key"), (4, "rational_denominator_zero"), (5, "rational_denominator_zero"), (6, "invalid_value_shape"), (7, "value_limit_exceeded"), (9, "invalid_value_shape"), (10, "invalid_key")]
    assert {i for i, c in got if c == "invalid_key"} == {2, 3, 4, 5, 10, 11}
    assert validation.standard_issues(e.where("false")).count() == 0


def test_companions_stay_local_unless_inherited(spark):
    e = spark.createDataFrame([
        (1, 0, "exififd", 0, 1, "a", 0), (1, 0, "exififd", 1, 2, None, 0), (1, 0, "exififd", 2, 2, "x", 1), (1, 1, "exififd", 3, 2, "y", 0), (1, 0, "ifd0", 4, 2, "z", 0), (2, 1, "exififd", 0, 1, "b", 0), (2, 1, "exififd", 1, 2, "w", 0),
    ], "asset_id long, block_id long, ifd string, entry_id long, tag int, v_text string, flags int")
    base = store.find_all(e, tag=1).select("asset_id", "block_id", "ifd", "entry_id")
    found = lambda inherit: {r.asset_id: r.c and tuple(r.c) for r in store.companions(base, e, {"c": 2}, inherit).collect()}
    assert found(None) == {1: None, 2: (1, "w")}
    assert found(spark.createDataFrame([(0, "ifd0")], "block_id long, ifd string")) == {1: (4, "z"), 2: (1, "w")}
    assert found(spark.createDataFrame([(1, "")], "block_id long, ifd string")) == {1: (3, "y"), 2: (1, "w")}


def test_scope_is_a_condition_without_a_join(spark, capfd, monkeypatch):
    e = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, None, 3), (None, "a", 4), (2, "a", 5), (2, "c", 6), (3, "", 7)], "block_id long, ifd string, id int")
    s = spark.createDataFrame([(0, "a"), (1, ""), (1, "z"), (2, "c"), (2, None), (None, "a"), (0, "a")], "block_id long, ifd string")
    out = store.in_scope(e, s)
    out.explain()
    assert "Join" not in capfd.readouterr().out
    want = [1, 3, 6]
    assert sorted(r.id for r in out.collect()) == want
    monkeypatch.setattr(store, "SCOPE_TERMS", 1)
    assert sorted(r.id for r in store.in_scope(e, s).collect()) == want


def test_tasks_follow_the_rows(spark):
    assert [session.spread(spark.range(n), "id", task_rows=10).rdd.getNumPartitions() for n in (0, 40, 1000)] == [4, 4, 100]
    assert session.spread(spark.range(5), "id", rows=200, task_rows=10).rdd.getNumPartitions() == 20


def test_linked_roles_deal_counted_pairs(spark, capfd, monkeypatch):
    edges = [(i % 9, i * 7 % 13, "xy"[i % 2]) for i in range(80)] + [(0, 0, "x"), (0, None, "x"), (None, 1, "y"), (None, 2, "y")]
    monkeypatch.setattr(graph, "PAIR_ROWS", 16)
    out = graph.linked_roles(spark.createDataFrame(edges, "from_id long, to_id long, ref_type string"))
    out.explain()
    n = sum(f == g for f, t, _ in edges for g, o, _ in edges if None not in (f, t, o))
    assert f"{-(-n // 16)}), REPARTITION_BY_NUM" in capfd.readouterr().out
    want = {}
    for f, t, _ in edges:
        for g, o, r in edges:
            if f is not None and f == g and None not in (t, o) and t != o:
                want.setdefault((t, r), set()).add(o)
    assert rows(out) == sorted((t, r, len(o)) for (t, r), o in want.items())


def test_term_rules_are_plain_texts_read_by_kind(spark, sf, capfd):
    names_ = ["wb x", "x wb", "xwb", "Object  Name", "object name", "OBJECTNAME", "f-number", "a\nwb", "", None, "Keyword"]
    df = spark.createDataFrame([(n,) for n in names_], "name string")
    want = set()
    for n in names_:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), n or "")
        for kind in {r[0] for r in semantic.RULES}:
            bits = sum(semantic.bit(t) for k, t, p in semantic.RULES if k == kind and n is not None and re.search(p.replace("~", " ?"), low))
            want |= {(n, kind, bits)} if bits else set()
    assert {tuple(r) for r in semantic.match_terms(df, "name").select("name", "kind", "terms").collect()} == want
    assert not any(c in p for _, _, p in semantic.RULES for c in ".*+?()[]{}$")
    query_queries.default_terms(spark, sf).explain()
    plan = capfd.readouterr().out
    assert "headline" in plan and "RLIKE" not in plan and "vignet" not in plan and plan.count("translate(") == 1
