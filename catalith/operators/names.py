"""Names of entries in several styles, label lookups and orientation codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_name(entries: DataFrame) -> Column:
    """One text for each key; columns that entries lacks count as null."""
    col = lambda c: F.col(c).cast("string") if c in entries.columns else F.lit(None).cast("string")
    num = lambda c: F.col(c) if c in entries.columns else F.lit(None).cast("int")
    hexed = lambda c, n: F.concat(F.lit("0x"), F.lpad(F.hex(num(c)), n, "0"))
    hex4 = lambda c: hexed(c, 4)
    j = lambda *parts: F.concat(*[F.lit(p[1:]) if p.startswith("=") else col(p) for p in parts])
    kind = F.col("key_kind")
    return (
        F.when(kind == "exif_tag", F.concat(j("=exif:", "ifd", "=:"), hex4("tag"))).when(kind == "comment", F.lit("comment"))
        .when(kind == "exr_attribute", j("=exr:part:", "part", "=:", "name")).when(kind == "iptc_dataset", j("=iptc:", "record", "=:", "dataset"))
        .when(kind == "xmp_property", j("=xmp:", "ns", "=:", "path")).when(kind == "icc_header_field", j("=icc:header:", "num_key"))
        .when(kind == "icc_tag", F.concat(F.lit("icc:tag:"), hexed("num_key", 8))).when(kind == "photoshop_irb", F.concat(F.lit("psirb:"), hex4("num_key")))
        .when(kind == "photoshop_irb_field", F.concat(F.lit("psirb_field:"), hex4("num_key"), j("=:", "name"))).when(kind == "geotiff_key", j("=geotiff:", "num_key"))
        .when(kind == "printim_field", j("=printim:", "name")).when(kind == "bmff_field", j("=bmff:", "name")).when(kind == "jumbf_field", j("=jumbf:", "name"))
        .when(kind == "jumbf_cbor_key", j("=jumbf_cbor:", "name")).when(kind == "png_text", j("=png_text:", "ns", "=:", "name"))
    )


def flat_name() -> Column:
    """Prefixed flat names; keys without one are null."""
    return F.when((F.col("key_kind") == "xmp_property") & (F.col("ns") == "dc"), F.concat(F.lit("DC:"), "name")).when(F.col("key_kind") == "xmp_property", F.concat(F.lit("XMP:"), "name")).when(
        F.col("key_kind") == "iptc_dataset", F.concat(F.lit("IPTC:"), "name"))


def labelled(df: DataFrame, dim: DataFrame, code: str) -> DataFrame:
    """df with the label of its code from a small dimension; unknown codes are named as such."""
    return df.join(dim, code, "left").withColumn("label", F.coalesce("label", F.concat(F.lit("unknown("), code, F.lit(")"))))


def orientation(code: str) -> list[Column]:
    """valid, mirrored, swaps (width and height), rotation_cw of an orientation code."""
    c = F.col(code)
    return [
        c.between(1, 8).alias("valid"), c.isin(2, 4, 5, 7).alias("mirrored"), c.between(5, 8).alias("swaps"),
        F.when(c.isin(3, 4), 180).when(c.isin(5, 8), 270).when(c.isin(6, 7), 90).otherwise(0).alias("rotation_cw"),
    ]
