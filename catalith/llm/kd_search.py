"""Exact top-k inner products by one KD-tree for each shard.

Rows are dealt into shards; each shard is stored as a KD-tree (median splits, tight boxes, leaves of LEAF rows) in one
binary row. Blocks of queries visit every shard: a block walks the leaves best-first by the box-to-query bound of
the inner product and stops once no box can reach the kth score so far. A first round searches one shard for each
query; its kth score is propagated and starts the search in all others. Trees and blocks meet cell by cell, one tree and
one block each, by shuffles alone: their binaries are far larger than the planner estimates and must not be broadcast.
"""

from __future__ import annotations

import io
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import checkpointed, partitions

SCALE = 256
TOP = 5
EVERY = 50
LEAF = 64
#: Most rows of a shard and queries of a block on average, and the rows below which a shard isn't divided for more tasks.
SHARD_ROWS = 32768
BLOCK_ROWS = 8192
LEAST_ROWS = 4096
#: Partitions of the shuffle that brings trees and blocks together.
CELL_TASKS = 2000


def quantised(col: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null or hold a null or non-finite one."""
    x = F.transform(col, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(col.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def build_tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Median splits on the widest axis; leaves as runs of rows with tight boxes."""
    order = np.lexsort((ids,))
    stack, leaves = [order], []
    while stack:
        at = stack.pop()
        if len(at) <= leaf:
            leaves.append(at)
            continue
        own = x[at]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        half = len(at) // 2
        at = at[np.argpartition(own[:, axis], half)]
        stack += [at[half:], at[:half]]
    size = np.array([len(a) for a in leaves])
    rows = np.concatenate(leaves)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    pts = x[rows]
    return {"ids": ids[rows], "x": pts, "first": first, "size": size, "lo": np.minimum.reduceat(pts, first), "hi": np.maximum.reduceat(pts, first)}


def search(tree: dict[str, np.ndarray], qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row id, score) of each query's k best rows of the tree with a score of floor at least, best-first.

    Leaves are visited in rings: the next unvisited leaf of every open query, ordered by its bound; a query closes when
    its best remaining bound is below its kth score.
    """
    # integer products and sums below 2**53 are exact in double; larger ones are told apart as whole numbers
    most = np.abs(q).max(initial=0) * np.abs(tree["x"]).max(initial=0) * q.shape[1]
    if most >= 2**53:
        return _search_whole(tree, qid, q, floor, k)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = up @ tree["hi"].T + down @ tree["lo"].T
    order = np.argsort(-bound, axis=1, kind="stable")
    n, width = len(q), int(tree["size"].max())
    best = np.full((n, k), -np.inf)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.astype(float).copy()
    open_ = np.arange(n)
    for ring in range(order.shape[1]):
        leaf = order[open_, ring]
        live = bound[open_, leaf] >= kth[open_]
        open_, leaf = open_[live], leaf[live]
        if not len(open_):
            break
        by = np.argsort(leaf, kind="stable")
        open_, leaf = open_[by], leaf[by]
        cut = np.flatnonzero(np.diff(leaf)) + 1
        score = np.full((len(open_), width), -np.inf)
        ids = np.full((len(open_), width), np.iinfo(np.int64).max)
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(leaf)], strict=True):
            f, m = tree["first"][leaf[a]], tree["size"][leaf[a]]
            score[a:b, :m] = q[open_[a:b]] @ tree["x"][f : f + m].T
            ids[a:b, :m] = tree["ids"][f : f + m]
        # most leaves hold nothing for a query; only the others are merged
        some = np.flatnonzero(score.max(1) >= kth[open_])
        at, score, ids = open_[some], score[some], ids[some]
        score[ids == qid[at][:, None]] = -np.inf
        score[score < kth[at][:, None]] = -np.inf
        ids[np.isneginf(score)] = np.iinfo(np.int64).max
        all_s, all_i = np.hstack([best[at], score]), np.hstack([best_id[at], ids])
        pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        best[at], best_id[at] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
        kth[at] = np.maximum(kth[at], best[at, k - 1])
    row, col = np.nonzero(~np.isneginf(best))
    return row, best_id[row, col], best[row, col].astype(np.int64)


def _search_whole(tree: dict[str, np.ndarray], qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """search by whole numbers of any size, one query after another; a score outside long can't be returned."""
    whole = lambda a: np.array([[int(v) for v in r] for r in a], object)
    lo, hi, own = whole(tree["lo"]), whole(tree["hi"]), whole(q)
    rows, ids, scores = [], [], []
    for i, v in enumerate(own):
        box = np.where(v > 0, hi * v, lo * v).sum(1)
        best: list[tuple[int, int]] = []
        for leaf in sorted(range(len(box)), key=lambda j: -box[j]):
            # the kth score travels as a double: stay below it by its rounding
            if box[leaf] < floor[i] - abs(floor[i]) * 2.0**-50 or (len(best) == k and box[leaf] < -best[-1][0]):
                break
            at = slice(tree["first"][leaf], tree["first"][leaf] + tree["size"][leaf])
            got = zip((whole(tree["x"][at]) * v).sum(1), tree["ids"][at], strict=True)
            best = sorted([*best, *((-s, int(d)) for s, d in got if d != qid[i])])[:k]
        rows += [i] * len(best)
        ids += [d for _, d in best]
        scores += [-s for s, _ in best]
    if any(abs(s) >= 2**63 for s in scores):
        raise OverflowError("an inner product is outside the range of long")
    return np.array(rows, np.int64), np.array(ids, np.int64), np.array(scores, np.int64)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_list()).astype(np.float64)


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them all; those beyond 32 bits stay doubles."""
    most = np.abs(a).max(initial=0)
    return a.astype(np.int16 if most < 2**15 else np.int32) if most < 2**31 else a


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: _small(v) if k in _WHOLE else v for k, v in arrays.items()})
    return out.getvalue()


def _unpack(packed: bytes) -> dict[str, np.ndarray]:
    z = np.load(io.BytesIO(packed))
    return {k: z[k].astype(np.float64) if k in _WHOLE else z[k] for k in z.files}


#: Arrays of scaled components, which travel in small types and are doubles in the search.
_WHOLE = ("x", "lo", "hi")


def _tree_row(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tree = build_tree(rows.id.to_numpy(), _matrix(rows.x))
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [_pack(**tree)]})


def _block_row(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    kth = rows.kth.fillna(-np.inf).to_numpy(float)
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "block": [key[2]], "qs": [_pack(id=rows.id.to_numpy(), x=_matrix(rows.x), kth=kth)]})


_FOUND = "query_id long, vec_id long, score long"


def _searched(k: int):
    def step(trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})]
        for tree in trees.tree:
            for qs in blocks.qs:
                own = _unpack(qs)
                row, ids, score = search(_unpack(tree), own["id"], own["x"], own["kth"], k)
                out.append(pd.DataFrame({"query_id": own["id"][row], "vec_id": ids, "score": score}))
        return pd.concat(out)

    return step


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by inner product, ties to the smaller vec_id.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by every. Vectors that are null or hold a
    null or non-finite component, empty vectors and null vec_ids take no part; vectors are compared with those of the
    same length; a query's own vec_id is never its candidate, on repeated rows either; each repeated row is a candidate
    of its own; of several query rows with one vec_id the smallest vector asks. Scores are exact integers (components
    below 2**53 in size once scaled; a score outside long is an error). No rows, or a single row, give an empty result.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("x")).where("id is not null and x is not null and size(x) > 0")
    x = x.withColumn("dim", F.size("x"))
    n = x.count()
    # small tables are divided further, down to LEAST_ROWS, so that all tasks have work
    shards, blocks = max(1, -(-n // shard_rows), min(partitions(x.sparkSession), n // LEAST_ROWS)), max(1, -(-n // every // block_rows))
    tasks = min(CELL_TASKS, shards * blocks)
    cell = ["dim", "shard", "block"]
    dealt = lambda m, seed, c="id": F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m)).cast("int")
    trees = x.withColumn("shard", dealt(shards, 0)).repartition(min(CELL_TASKS, shards), "dim", "shard").groupBy("dim", "shard").applyInPandas(_tree_row, "dim int, shard int, tree binary")
    if shards > 1:
        trees = checkpointed(trees)
    queries = x.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))
    queries = queries.withColumn("home", dealt(shards, 0)).withColumn("block", dealt(blocks, 1))
    block = "dim int, shard int, block int, qs binary"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def run(packed: DataFrame) -> DataFrame:
        every_block = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *cell)
        return every_block.groupBy(*cell).cogroup(packed.repartition(tasks, *cell).groupBy(*cell)).applyInPandas(_searched(k), _FOUND)

    home = run(queries.withColumn("kth", F.lit(None).cast("double")).withColumn("shard", F.col("home")).groupBy(*cell).applyInPandas(_block_row, block))
    if shards == 1:
        return ranked(home)
    home = checkpointed(home)
    kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    # the packed blocks are repeated for the shards, not the single queries
    packed = (
        queries.join(kth.hint("merge"), F.col("id") == F.col("query_id"), "left").withColumn("shard", F.lit(-1)).groupBy(*cell).applyInPandas(_block_row, block)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    # the home shard's rows come twice
    return ranked(home.unionAll(run(packed).where(dealt(shards, 0, "vec_id") != dealt(shards, 0, "query_id"))))


def op6_kd_search(spark, sf_dir: str) -> DataFrame:
    """The five best other vectors of each vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
