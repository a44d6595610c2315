"""Shards of near-equal bytes by vector bin packing.

The items are groups of equal texts, as vectors (bytes, tokens, rows). So that nothing unbounded meets in one place,
groups are hashed into a fixed number of cells, groups too large for a cell are cut into pieces, and only the cells'
vectors - CELLS rows at most - come to the driver, which places them largest first where the dot product with the
residual capacity is highest. Slots are prefix sums over the cells plus a row number within a cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import checkpointed, count_words

SHARDS = 40
#: Cells for each shard: what the driver places is SHARDS * CELLS_PER_SHARD vectors at most.
CELLS_PER_SHARD = 512
#: A group of more than this part of a shard is cut into pieces of about that size.
PIECE = 1 / 4
OVERHEAD = 16
#: Bytes are what the law holds; tokens and rows follow as far as they can.
WEIGHTS = (4.0, 1.0, 1.0)
#: Difference of the fullest and the emptiest shard's bytes, as a part of the mean, that ends the evening out.
TOLERANCE = 1e-4


def place(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item: largest first, to the highest dot product with the shards' residual capacity."""
    total = vectors.sum(0)
    w = np.sqrt(np.array(weights)) / np.where(total > 0, total, 1)
    scaled = vectors * w
    room = np.tile(scaled.sum(0) / shards, (shards, 1))
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-scaled[:, 0], kind="stable"):
        s = int(np.argmax(room @ scaled[i]))
        out[i] = s
        room[s] -= scaled[i]
    return _evened(vectors[:, 0], out, shards)


def _evened(size: np.ndarray, out: np.ndarray, shards: int, rounds: int = 4000) -> np.ndarray:
    """Move or exchange single items between the fullest and the emptiest shard until bytes are within TOLERANCE, and no
    further: each move costs some of the balance of tokens and rows."""
    load = np.bincount(out, size, shards)
    near = max(1.0, load.mean() * TOLERANCE)
    for _ in range(rounds):
        a, b = int(load.argmax()), int(load.argmin())
        gap = load[a] - load[b]
        here, there = np.flatnonzero(out == a), np.flatnonzero(out == b)
        if gap <= near or not len(here):
            break
        own = size[here]
        move = int(np.argmin(np.abs(own - gap / 2)))
        best = (abs(gap - 2 * own[move]), here[move], -1)
        if len(there):
            # the exchange whose difference is nearest to half the gap
            order = there[np.argsort(size[there], kind="stable")]
            at = np.clip(np.searchsorted(size[order], own - gap / 2), 0, len(order) - 1)
            left = np.abs(gap - 2 * (own - size[order[at]]))
            j = int(left.argmin())
            if left[j] < best[0]:
                best = (left[j], here[j], order[at[j]])
        if best[0] >= gap:
            break
        _, i, j = best
        out[i] = b
        load[a] -= size[i]
        load[b] += size[i]
        if j >= 0:
            out[j] = a
            load[a] += size[j]
            load[b] -= size[j]
    return out


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def shard_rows(docs: DataFrame, shards: int = SHARDS, cells_per_shard: int = CELLS_PER_SHARD, piece: float = PIECE, carry_text: bool = True) -> DataFrame:
    """Every row of docs with the columns size, text_crc32, law, shard, slot and grown_shard.

    The law is 'bytes': sizes of the shards near equal, as near as the largest single row allows. Equal texts stay
    together unless their group exceeds PIECE of a shard; null texts are one such group of size 16 a row, with a null
    text_crc32. Repeated rows get slots of their own; a null doc_id sorts first; the other columns of docs are carried
    (those named like the new ones are replaced; without carry_text, text is not); an empty table gives an empty result.
    Slots follow (cell, doc_id). A large group is cut by the rows' numbers in the table as read, whatever their doc_ids.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    base = docs.drop(*[c for c in docs.columns if c.lower() in new])
    text = F.col("text")
    full = base.withColumns({
        "size": text_size(text), "text_crc32": F.crc32(text.cast("binary")),
        "__shard_h": F.coalesce(F.xxhash64(text, F.octet_length(text)), F.lit(0)), "__shard_t": count_words(text),
        "__shard_r": F.monotonically_increasing_id(),
    })
    cells = shards * cells_per_shard
    # written once, so that a row keeps its number
    full = slim = checkpointed(full if carry_text else full.drop("text"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    most = max(1.0, total / shards * piece)
    groups = slim.groupBy("__shard_h").agg(F.sum("size").alias("gb"))
    # groups above piece of a shard: at most shards / piece of them
    large = groups.where(F.col("gb") > most).select("__shard_h", F.ceil(F.col("gb") / most).cast("long").alias("__shard_k"))
    known = {r["__shard_h"]: r["__shard_k"] for r in large.collect()}
    if known:
        by = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        pieces = F.coalesce(F.try_element_at(by, F.col("__shard_h")), F.lit(1).cast("long"))
    else:
        pieces = F.lit(1).cast("long")
    cell = F.pmod(F.xxhash64("__shard_h", F.pmod(F.col("__shard_r"), pieces)), F.lit(cells)).cast("int").alias("__shard_cell")
    loads = slim.withColumn("__shard_cell", cell).groupBy("__shard_cell").agg(F.sum("size").alias("b"), F.sum("__shard_t").alias("t"), F.count("*").alias("n")).orderBy("__shard_cell").collect()
    vec = np.array([[r.b, r.t, r.n] for r in loads], float).reshape(-1, 3)
    where = place(vec, shards) if len(vec) else np.zeros(0, int)
    start, rows = np.zeros(shards, np.int64), []
    for r, s in zip(loads, where, strict=True):
        rows.append((r["__shard_cell"], int(s), int(start[s])))
        start[s] += r.n
    plan = F.broadcast(docs.sparkSession.createDataFrame(rows, "__shard_cell int, shard int, __shard_from long"))
    within = Window.partitionBy("__shard_cell").orderBy(F.asc_nulls_first("doc_id"), "__shard_h", "__shard_r", "size")
    placed = full.withColumn("__shard_cell", cell).withColumn("__shard_n", F.row_number().over(within)).join(plan, "__shard_cell")
    return placed.select(
        *[c for c in base.columns if carry_text or c.lower() != "text"], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__shard_from") + F.col("__shard_n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_rows(docs, carry_text=False).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
