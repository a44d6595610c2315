"""Validation rules over entries; every rule is an expression, and all run in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.operators.store import is_deleted, live


def issues(entries: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """asset_id, entry_id, code, severity of each broken rule (code, severity, condition) of each live entry."""
    cells = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules])
    return live(entries).select("asset_id", "entry_id", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("i")).select("asset_id", "entry_id", "i.*")


# The ranges of whole-number element types.
INTEGER_RANGES = {
    "u8": (0, 255), "i8": (-128, 127), "u16": (0, 65_535), "i16": (-32_768, 32_767), "u32": (0, 4_294_967_295), "i32": (-2_147_483_648, 2_147_483_647),
}
# Namespaces and paths in which 0/0 stands for an unknown aperture.
UNKNOWN_APERTURE_NS = ("http://ns.adobe.com/exif/1.0/", "http://cipa.jp/exif/1.0/")
UNKNOWN_APERTURE_PATHS = ("LensSpecification[3]", "LensSpecification[4]")


def standard_issues(entries: DataFrame, max_key_bytes: int = 1024, max_value_bytes: int = 1 << 24) -> DataFrame:
    """asset_id, entry_id, code, severity: the standard rules over columns of the entry table (see schema.ENTRIES).

    A key that fails (an empty or too long directory, namespace, path or keyword) ends its row. A deleted entry is
    checked for its key alone. The shape of a value comes next: a count other than its kind asks for ends the value's
    rules; then its size, which ends them too; then the range of whole numbers and denominators of zero, except 0/0
    where it stands for an unknown aperture. Record and dataset numbers above 255 break the key without ending the row.
    Null parts of a key count as empty, null counts as 0. One projection over the scan, no shuffle.
    """
    kind, elem = F.col("key_kind"), F.col("elem_type")
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    bad = lambda c, required: (size(c) > max_key_bytes) | ((size(c) == 0) if required else F.lit(False))
    key_bad = (
        F.when(kind == "exif_tag", bad("ifd", True)).when(kind == "xmp_property", bad("ns", True) | bad("path", True)).when(kind == "exr_attribute", bad("name", True))
        .when(kind == "png_text", bad("ns", True) | bad("name", False))
        .when(kind.isin("photoshop_irb_field", "printim_field", "bmff_field", "jumbf_field", "jumbf_cbor_key"), bad("name", False)).otherwise(F.lit(False))
    )
    value, count = F.col("value_kind"), F.coalesce("count", F.lit(0))
    held = F.when(value == "array", F.coalesce(F.size("v_nums"), F.lit(0))).when(value == "bytes", size("v_bytes")).when(value == "text", size("v_text"))
    shape_bad = F.when(value == "empty", count != 0).when(value == "scalar", count != 1).when(value.isin("array", "bytes", "text"), count != held).otherwise(F.lit(True))
    too_large = ~shape_bad & value.isin("array", "bytes", "text") & (held > max_value_bytes)
    rest = ~shape_bad & ~too_large
    out = F.lit(False)
    for name, (low, high) in INTEGER_RANGES.items():
        out = out | ((elem == name) & ~F.col("v_double").between(low, high))
    unknown = (kind == "xmp_property") & F.col("ns").isin(*UNKNOWN_APERTURE_NS) & F.col("path").isin(*UNKNOWN_APERTURE_PATHS) & (elem == "urational") & (F.col("v_ratio.num") == 0)
    zero = elem.isin("urational", "srational") & (value == "scalar") & (F.col("v_ratio.den") == 0) & ~F.coalesce(unknown, F.lit(False))
    alive = ~key_bad & ~is_deleted()
    rules = [
        ("invalid_key", key_bad), ("invalid_value_shape", alive & shape_bad), ("value_limit_exceeded", alive & too_large), ("scalar_out_of_range", alive & rest & (value == "scalar") & out),
        ("rational_denominator_zero", alive & rest & zero), ("invalid_key", alive & (kind == "iptc_dataset") & ((F.col("record") > 255) | (F.col("dataset") > 255))),
    ]
    cells = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules])
    return entries.select("asset_id", "entry_id", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("code"), F.lit("error").alias("severity"))


def schema_issues(entries: DataFrame, schema: DataFrame, unknown: str = "warning") -> DataFrame:
    """asset_id, entry_id, code, severity of live tag entries (ifd, tag, elem_type, count) against schema.

    schema: ifd, tag, types (array), min_count, max_count (0: no end), at most one row for a directory and tag. A tag that only
    another directory knows: wrong_ifd; one that none knows: unknown_exif_tag of severity unknown ("allow": no issue);
    else wrong_type and wrong_count. The schema is grouped by tag into one map, so a single join decides all four.
    """
    dim = schema.groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct("ifd", F.struct("types", "min_count", "max_count")))).alias("_own"))
    j = live(entries).join(dim, "tag", "left")
    s = F.col("_own")[F.col("ifd")]
    count = F.coalesce("count", F.lit(0))
    none = F.lit(None).cast("string")
    cells = F.array(
        F.when(F.col("_own").isNull(), none if unknown == "allow" else F.lit("unknown_exif_tag")).when(s.isNull(), "wrong_ifd"),
        F.when(s.isNotNull() & ~F.coalesce(F.array_contains(s["types"], F.col("elem_type")), F.lit(False)), "wrong_type"),
        F.when(s.isNotNull() & ((count < s["min_count"]) | ((s["max_count"] != 0) & (count > s["max_count"]))), "wrong_count"),
    )
    found = j.select("asset_id", "entry_id", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("code"))
    return found.withColumn("severity", F.when(F.col("code") == "unknown_exif_tag", unknown).otherwise("error"))


def image_context_issues(entries: DataFrame, context: DataFrame) -> DataFrame:
    """asset_id, entry_id, tag of each first live dimension entry whose value is not the asset's.

    context: asset_id, tag, expected; a tag's first live entry of an asset (lowest id) is compared, others are not. One
    aggregation with a map-side part, then an equi-join on the asset.
    """
    first = live(entries).groupBy("asset_id", "tag").agg(F.min_by(F.struct("entry_id", "v_double"), "entry_id").alias("f"))
    j = first.join(context, ["asset_id", "tag"]).where(F.col("f.v_double") != F.col("expected"))
    return j.select("asset_id", F.col("f.entry_id").alias("entry_id"), "tag")


def duplicate_singletons(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One issue for each live entry of a key after its first, with the first as related."""
    w = Window.partitionBy("asset_id", *keys).orderBy("entry_id")
    d = live(entries).withColumn("related_id", F.min("entry_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return d.where("entry_id > related_id").select("asset_id", *keys, "entry_id", "related_id")


def required_missing(entries: DataFrame, assets: DataFrame, required: list[str], key: str) -> DataFrame:
    """Assets and required keys that no live entry has: the keys present are gathered in one aggregation."""
    have = live(entries).where(F.col(key).isin(required)).groupBy("asset_id").agg(F.collect_set(key).alias("have"))
    want = F.array(*[F.lit(r) for r in required])
    none = F.array().cast("array<string>")
    return assets.join(have, "asset_id", "left").select("asset_id", F.explode(F.array_except(want, F.coalesce("have", none))).alias("missing"))


def forbidden_present(entries: DataFrame, forbidden: list[str], key: str) -> DataFrame:
    return live(entries).where(F.col(key).isin(forbidden)).groupBy("asset_id", key).agg(F.count("*").alias("n"))


def summary(found: DataFrame, max_issues: int) -> DataFrame:
    """Per asset: issues by severity, how many a cap lets through, and the status."""
    return found.groupBy("asset_id").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.least(F.count("*"), F.lit(max_issues)).alias("n_reported"),
    ).withColumn("status", F.when(F.col("n_errors") > 0, "invalid").otherwise("valid_with_warnings"))
