"""Helpers shared by the corpus operators: byte batches, rolling hashes, checkpoints, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Stands for a null doc_id in join keys, so that the keys are never null.
NULL_ID = -(2**63)
#: Text bytes handled by one vectorised step in a task (a longer text is one step of its own).
STEP_BYTES = 1 << 20
#: Rounds of a component search; they grow with the logarithm of the longest chain, so this is never reached in practice.
ROUNDS = 200
#: Links that a task of a component search reads at least.
TASK_LINKS = 1 << 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a folder of our own only in local mode, where driver and tasks are one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    home = sc.getConf().get("spark.checkpoint.dir")
    if not home and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(home or tempfile.mkdtemp(prefix="spark-ckpt-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def count_runs(text: Column, separators: str) -> Column:
    """Number of maximal runs of characters outside separators (the inside of a character class); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{separators}]+")), F.lit(0)).cast("long")


def count_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space (0x20, 0x09 to 0x0D); null: 0.

    Plain byte replacements, several times cheaper than a regular expression: all white space becomes blanks, each run of
    blanks becomes one blank and one mark, and the marks are counted.
    """
    one = F.replace(text, F.lit("\x01"), F.lit("x"))
    for ws in "\t\n\x0b\x0c\r":
        one = F.replace(one, F.lit(ws), F.lit(" "))
    one = F.replace(F.replace(F.trim(one), F.lit(" "), F.lit(" \x01")), F.lit("\x01 "), F.lit(""))
    # one array of the two lengths, so that the string is made once
    sizes = F.transform(F.array(one), lambda s: F.when(s == "", 0).otherwise(F.octet_length(s) - F.octet_length(F.replace(s, F.lit("\x01"), F.lit(""))) + 1))
    return F.coalesce(F.element_at(sizes, 1), F.lit(0)).cast("long")


def doc_key(df: DataFrame) -> list[Column]:
    """Never-null identity of a document row: its id (null: NULL_ID) and a hash of its text and of whether it has an id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th")]


def arrow_texts(col: pa.Array) -> pa.Array:
    """A string or binary column as plain 64-bit-offset binary, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_binary()), b"")


def text_steps(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of bounded runs of rows: offsets has one more entry than rows."""
    arr = arrow_texts(batch.column(batch.schema.get_field_index(name)))
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + STEP_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low-entropy sums spread over all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial prefix hashes modulo 2**64 with an odd base: any span's hash in O(1)."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum((values.astype(U64) + U64(1)) * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def _links(e: DataFrame) -> tuple[int, object]:
    """How many links there are, and a sum of their hashes."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, by alternating large-star and small-star rounds.

    edges: pairs of one orderable type, any order, self-links ignored. Each round is three shuffles of the links, two to
    the nodes and one that leaves each link once; the links are cut from their lineage by a checkpoint and read by as many
    tasks as their number asks for. Nodes without links don't appear.
    """
    least = F.min("v").over(Window.partitionBy("u"))
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = _links(e)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        both = e.coalesce(-(-seen[0] // TASK_LINKS)).select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("x")).select("x.*")
        large = both.withColumn("m", F.least(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least).select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("x")).select("x.*")
        e = checkpointed(small.where("u <> v").distinct())
        before, seen = seen, _links(e)
        if seen == before:
            break
    else:
        raise RuntimeError("the components didn't settle in ROUNDS rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
