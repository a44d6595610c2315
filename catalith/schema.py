"""The entry table: one row for each key and value of an asset, with its origin and flags."""

from __future__ import annotations

from pyspark.sql import types as T

# Bits of the flags column.
DELETED, DIRTY, DERIVED, TRUNCATED, UNREADABLE, CONTEXTUAL_NAME, VALUE_BIG_ENDIAN = 1, 2, 4, 8, 16, 32, 64

# Key kinds in their sort order.
KEY_KINDS = (
    "exif_tag", "comment", "exr_attribute", "iptc_dataset", "xmp_property", "icc_header_field", "icc_tag", "photoshop_irb",
    "photoshop_irb_field", "geotiff_key", "printim_field", "bmff_field", "jumbf_field", "jumbf_cbor_key", "png_text",
)

RATIO = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])

ENTRIES = T.StructType([
    T.StructField("asset_id", T.LongType()), T.StructField("entry_id", T.LongType()), T.StructField("block_id", T.LongType()),
    T.StructField("order_in_block", T.IntegerType()), T.StructField("key_kind", T.StringType()), T.StructField("ifd", T.StringType()),
    T.StructField("tag", T.IntegerType()), T.StructField("ns", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("record", T.IntegerType()), T.StructField("dataset", T.IntegerType()),
    T.StructField("part", T.IntegerType()), T.StructField("num_key", T.LongType()), T.StructField("value_kind", T.StringType()),
    T.StructField("elem_type", T.StringType()), T.StructField("count", T.LongType()), T.StructField("v_double", T.DoubleType()),
    T.StructField("v_ratio", RATIO), T.StructField("v_nums", T.ArrayType(T.DoubleType())), T.StructField("v_text", T.StringType()),
    T.StructField("v_bytes", T.BinaryType()), T.StructField("flags", T.IntegerType()),
])
