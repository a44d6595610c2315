"""Session helpers shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "catalith", **conf) -> SparkSession:
    """A local session with the settings that results and oracles agree on."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Rows of a task where rows are grouped or sorted in memory.
TASK_ROWS = 1 << 17


def spread(df: DataFrame, *keys: str, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys into as many partitions as its rows ask for, at least those of the session's shuffles.

    What one task sorts or groups then stays the same however large the table is. rows: their number, if it is known.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // task_rows)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Spark's reader resolves the path, whatever the store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
