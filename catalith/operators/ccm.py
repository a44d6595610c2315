"""Fields and checks of colour calibration values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields(values: DataFrame) -> DataFrame:
    """asset_id, n, n_rows, n_cols of each value x: square if it can be, else rows of three, else one row."""
    v = values.withColumn("n", F.size("x").cast("long")).withColumn("side", F.round(F.sqrt(F.size("x").cast("double"))).cast("long"))
    square = (F.col("side") * F.col("side") == F.col("n")) & (F.col("n") > 4)
    return v.select(
        "asset_id", "n", F.when(square, F.col("side")).when(F.col("n") % 3 == 0, F.floor(F.col("n") / 3)).otherwise(1).cast("long").alias("n_rows"),
        F.when(square, F.col("side")).when(F.col("n") % 3 == 0, 3).otherwise(F.col("n")).cast("long").alias("n_cols"),
    )


def issues(values: DataFrame) -> DataFrame:
    """One row for each broken rule of each value, found in one pass."""
    n, side = F.size("x"), F.round(F.sqrt(F.size("x").cast("double"))).cast("int")
    rules = F.array(
        F.when(n % 3 != 0, "matrix_count_not_multiple_of_3"), F.when(n > 36, "matrix_count_too_large"), F.when(side * side != n, "calibration_not_square"),
        F.when((n == 2) & ~((F.get("x", F.lit(0)) > 0) & (F.get("x", F.lit(1)) > 0) & (F.get("x", F.lit(0)) + F.get("x", F.lit(1)) <= 1)), "white_xy_out_of_range"),
        F.when((n >= 3) & (F.array_min("x") <= 0), "balance_not_positive"),
    )
    return values.select("asset_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("issue"))
