"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the tokens before it, times that of the token within its class. The
classes are the end of a text, the most frequent words (one each) and groups of words by their first two bytes; the
class softmax is log-linear in hashed n-gram and skip features. Within a class of many words a second softmax runs over
its words: a word's weight is the logarithm of its count, which a model of single words alone would learn, plus weights
of its kind (the last byte's group of KINDS) in hashed features of the class, the token before and the class before. Words
of one kind share these, so the sum over all words of the class is one over kinds, of the counts' exact sums. Both are
trained by distributed gradient updates: tasks run
minibatch steps over their own documents, their updates are averaged feature block by feature block, and the averaged
weights (a fixed size) start the next round. Counts over all training tokens decide the unigram base score. Counts travel as packed arrays: a block of documents asks for its distinct tokens, each bucket of token
hashes adds up what all blocks counted and answers each, and the block's documents are scored with its answers. The
number of blocks and buckets follows the bytes of all texts, so that what one task holds does not grow with the corpus.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import Rolling, checkpointed, partitions, text_steps

CLASSES, TOP = 32, 11
#: Rows of hashed features (a power of two), gradient rounds, tokens of a minibatch, and the step size.
HASHED, ROUNDS, MINIBATCH, RATE = 1 << 14, 2, 8192, 0.15
ALPHA = 0.1
#: Text bytes of a block of documents, which one task holds at once (a single longer text is a block's part as it is).
BLOCK_BYTES = 32 << 20
END = np.uint64(0x5DEECE66D1234567)
#: Feature rows: bias, class of the last and the last but one token, then hashed features.
ROWS = 1 + 2 * CLASSES + HASHED
SLICES = 8
#: Groups of words, kinds of words within a group, and rows of the hashed features within a group (a power of two).
GROUPS, KINDS, INSIDE = CLASSES - 1 - TOP, 8, 1 << 13
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROLL = Rolling(0x9E3779B97F4A7C15)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first-bytes group times KINDS plus last-byte kind, tokens of each row) of the batch's texts: words, then one end for each row."""
    hashes, groups, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)]
    for _, _, data, off in text_steps(batch):
        n = len(off) - 1
        low = _LOWER[data]
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = word[:-1]
        before[off] = False
        start = np.flatnonzero(word & ~before)
        after = np.append(word[1:], False)
        after[off[1:] - 1] = False  # an empty first row marks the last place, which is no word
        end = np.flatnonzero(word & ~after) + 1
        row = np.searchsorted(off, start, side="right") - 1
        per = np.bincount(row, minlength=n)
        h = np.full(len(start) + n, END, np.uint64)
        g = np.zeros(len(start) + n, np.uint8)
        at = np.arange(len(start)) + row
        h[at] = _ROLL.spans(_ROLL.prefix(low), start, end)
        second = np.where(end - start > 1, np.append(low, 0)[start + 1 if len(start) else start], 0).astype(np.uint64)
        group = ((low[start].astype(np.uint64) * np.uint64(257) + second) * np.uint64(2654435761) >> np.uint64(12)) % np.uint64(GROUPS)
        g[at] = group * np.uint64(KINDS) + low[end - 1] % np.uint8(KINDS) if len(start) else 0
        hashes.append(h)
        groups.append(g)
        sizes.append(per + 1)
    return np.concatenate(hashes), np.concatenate(groups), np.concatenate(sizes)


def classes_of(h: np.ndarray, g: np.ndarray, top: np.ndarray) -> np.ndarray:
    """0 the end, 1.. the frequent words of top (sorted hashes), then the groups."""
    k = (g // np.uint8(KINDS) + np.uint8(1 + TOP)).astype(np.uint8)
    if len(top):
        at = np.minimum(np.searchsorted(top, h), len(top) - 1)
        hit = top[at] == h
        k[hit] = 1 + at[hit]
    k[h == END] = 0
    return k


def features(h: np.ndarray, k: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[tokens, 6] feature rows: bias, last class, skipped class, last word, last two words, skipped word."""
    n = len(h)
    start = np.zeros(n, bool)
    start[np.cumsum(sizes)[:-1]] = True
    start[:1] = True
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    c1, c2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
    one[1:], two[2:] = h[:-1], h[:-2]
    c1[1:], c2[2:] = k[:-1], k[:-2]
    one[start], c1[start] = END, 0
    second = np.append(False, start[:-1]) | start
    two[second], c2[second] = END, 0
    mod = np.uint64(HASHED - 1)
    f = np.empty((n, 6), np.int64)
    f[:, 0] = 0
    f[:, 1] = 1 + c1
    f[:, 2] = 1 + CLASSES + c2
    base = 1 + 2 * CLASSES
    f[:, 3] = base + ((one * np.uint64(0x9E3779B1)) >> np.uint64(20) & mod).astype(np.int64)
    f[:, 4] = base + (((one * np.uint64(31) + two) * np.uint64(0x85EBCA6B)) >> np.uint64(21) & mod).astype(np.int64)
    f[:, 5] = base + ((two * np.uint64(0xC2B2AE35)) >> np.uint64(19) & mod).astype(np.int64)
    return f


def class_probabilities(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    x = w.take(f[:, 0], axis=0)
    for j in range(1, f.shape[1]):
        x += w.take(f[:, j], axis=0)
    return _softmax(x)


def _softmax(x: np.ndarray) -> np.ndarray:
    # halves against each other, and a product with ones: reductions along short rows take several times as long
    most = x
    while most.shape[1] > 1:
        half = -(-most.shape[1] // 2)
        most = np.maximum(most[:, :half], most[:, -half:])
    x -= most
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def inside_features(f: np.ndarray, k: np.ndarray) -> np.ndarray:
    """[tokens, 3] feature rows of the softmax within class k: the class, with the last word, with the last class."""
    c = k.astype(np.int64)
    out = np.empty((len(k), 3), np.int64)
    out[:, 0] = c
    out[:, 1] = CLASSES + ((f[:, 3] * CLASSES + c) * 0x9E3779B1 >> 15) % (INSIDE - CLASSES)
    out[:, 2] = CLASSES + ((f[:, 1] * CLASSES + c) * 0x85EBCA6B >> 13) % (INSIDE - CLASSES)
    return out


def kind_probabilities(w: np.ndarray, f: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """[tokens, KINDS] probabilities of each kind within the token's class: the kind's words summed, exp(weights) each.

    mass: [tokens, KINDS], the logarithm of the sum of the words' own weights.
    """
    x = w.take(f[:, 0], axis=0)
    for j in range(1, f.shape[1]):
        x += w.take(f[:, j], axis=0)
    x += mass
    return _softmax(x)


def sgd(w: np.ndarray, square: np.ndarray, f: np.ndarray, k: np.ndarray, mass: np.ndarray | None = None) -> None:
    """Minibatch steps, scaled by each weight row's past gradients, in place; with mass, of the softmax within classes."""
    # the first columns point to few rows, the bias and the classes: their gradients are one matrix product
    dense, few = (3, 1 + 2 * CLASSES) if mass is None else (1, CLASSES)
    for lo in range(0, len(k), MINIBATCH):
        fs, ks = f[lo : lo + MINIBATCH], k[lo : lo + MINIBATCH]
        n, each = np.float32(len(ks)), np.arange(len(ks))
        g = class_probabilities(w, fs) if mass is None else kind_probabilities(w, fs, mass[lo : lo + MINIBATCH])
        g[each, ks] -= 1
        hot = np.zeros((len(ks), few), np.float32)
        for j in range(dense):
            hot[each, fs[:, j]] = 1
        flat = fs[:, dense:].ravel().astype(np.uint16)  # which numpy sorts by radix; there are fewer rows than 2**16
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        # two weights are added at once, as a complex number
        runs = np.add.reduceat(g.view(np.complex64).take(order // (fs.shape[1] - dense), axis=0), first, axis=0).view(np.float32)
        for rows, grad in ((np.arange(few), hot.T @ g / n), (flat[first].astype(np.int64), runs / n)):
            square[rows] += (grad * grad) @ np.ones(grad.shape[1], np.float32)
            w[rows] -= grad * (RATE / np.sqrt(square[rows] + 1e-8))[:, None]


def _parts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the class softmax and those within classes, as views of one array that travels and is averaged."""
    return w[:ROWS], w[ROWS:].reshape(INSIDE, KINDS)


#: Rows of CLASSES weights that hold both.
ALL_ROWS = ROWS + INSIDE * KINDS // CLASSES


def _trained(w0: bytes, top: np.ndarray, mass: np.ndarray):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.frombuffer(w0, np.float32).reshape(ALL_ROWS, CLASSES)
        w, n = start.copy(), 0
        outer, inner = _parts(w)
        square, square_in = np.zeros(ROWS, np.float32), np.zeros(INSIDE, np.float32)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                h, g, sizes = tokens_of(b.slice(lo, 256))
                k = classes_of(h, g, top)
                f = features(h, k, sizes)
                sgd(outer, square, f, k)
                many = np.flatnonzero(k > TOP)
                km = k[many]
                sgd(inner, square_in, inside_features(f[many], km), g[many] % KINDS, mass[km - 1 - TOP])
                n += len(h)
        if n:
            # each row's update weighs as often as the task saw it
            # rows within classes are KINDS wide and share a travelling row, weighed by their mean
            seen = np.sqrt(np.concatenate([square, square_in.reshape(-1, CLASSES // KINDS).mean(1)]))[:, None]
            delta = np.concatenate([(w - start) * seen, seen], 1).astype(np.float32)
            for i, part in enumerate(np.array_split(delta, SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "delta"])

    return step


def _added(t: pa.Table) -> pa.Table:
    total = None
    for x in t.column("delta"):
        one = np.frombuffer(x.as_py(), np.float32)
        total = one.astype(np.float64) if total is None else total + one
    return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "delta": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, top: np.ndarray, mass: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights [ALL_ROWS, CLASSES]. docs: text, part (the round that reads the row). One pass over all rows.

    mass: [GROUPS, KINDS], the logarithm of the sum of the words' own weights.
    """
    w = np.zeros((ALL_ROWS, CLASSES), np.float32)
    for r in range(rounds):
        parts = docs.where(F.col("part") == r).select("text").mapInArrow(_trained(w.tobytes(), top, mass), "slice int, delta binary")
        # one level more, so that no task adds up all tasks' updates
        spread = parts.withColumn("fan", F.spark_partition_id() % 16).groupBy("slice", "fan").applyInArrow(_halved, "slice int, delta binary")
        got = {x.slice: x.delta for x in spread.groupBy("slice").applyInArrow(_added, "slice int, delta binary").collect()}
        for i, at in enumerate(np.array_split(np.arange(ALL_ROWS), SLICES)):
            if i in got:
                s = np.frombuffer(got[i], np.float64).reshape(len(at), CLASSES + 1)
                w[at] += (s[:, :-1] / np.maximum(s[:, -1:], 1e-12)).astype(np.float32)
    return w


def _halved(t: pa.Table) -> pa.Table:
    out = _added(t)
    x = np.frombuffer(out.column("delta")[0].as_py(), np.float64).astype(np.float32)
    return out.set_column(1, "delta", pa.array([x.tobytes()], pa.binary()))


def _distinct(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct token hashes of a block, their training counts, their groups."""
    hs, gs, ns = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)], [np.empty(0, bool)]
    for b in t.to_batches():
        h, g, sizes = tokens_of(b)
        hs.append(h)
        gs.append(g)
        ns.append(np.repeat(~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool), sizes))
    h, train_ = np.concatenate(hs), np.concatenate(ns)
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(inverse, train_, len(u)).astype(np.int64), np.concatenate(gs)[first]


def _cuts(u: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's stretch of the sorted hashes begins, and the end."""
    edge = (np.arange(1, buckets, dtype=object) * 2**64 // buckets).astype(np.uint64) if buckets > 1 else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(u, edge), [len(u)]]).astype(np.int64)


def _asked(buckets: int):
    def step(t: pa.Table) -> pa.Table:
        u, c, g = _distinct(t)
        cut = _cuts(u, buckets)
        on = np.flatnonzero(cut[1:] > cut[:-1])
        rows = [(u[cut[i] : cut[i + 1]], c[cut[i] : cut[i + 1]].astype(np.int32), g[cut[i] : cut[i + 1]]) for i in on]
        return pa.table({
            "bucket": pa.array(on, pa.int32()), "block": pa.array(np.full(len(on), t.column("block")[0].as_py()), pa.int32()),
            **{k: pa.array([r[j].tobytes() for r in rows], pa.binary()) for j, k in enumerate(("h", "c", "g"))},
        })

    return step


_ANSWER = "block int, bucket int, counts binary, n array<long>, v array<long>, top array<struct<h:long,c:long,g:int>>"


def _answered(t: pa.Table) -> pa.Table:
    hs = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("h")]
    u, first, inverse = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
    c = np.bincount(inverse, np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in t.column("c")]), len(u)).astype(np.int64)
    g = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("g")])[first]
    groups = GROUPS * KINDS
    word = u != END
    n = np.append(np.bincount(g[word], c[word], groups), c[~word].sum()).astype(np.int64)
    v = np.append(np.bincount(g[word], c[word] > 0, groups), (c[~word] > 0).sum()).astype(np.int64)
    best = np.flatnonzero(word)
    best = best[np.lexsort((u[best], -c[best]))][:TOP]
    top = [{"h": int(u[i].astype(np.int64)), "c": int(c[i]), "g": int(g[i])} for i in best if c[i]]
    at, out = 0, []
    for x in hs:
        out.append(c[inverse[at : at + len(x)]].tobytes())
        at += len(x)
    stats = [[n.tolist()] + [None] * (len(hs) - 1), [v.tolist()] + [None] * (len(hs) - 1), [top] + [None] * (len(hs) - 1)]
    longs = pa.list_(pa.int64())
    return pa.table({
        "block": t.column("block"), "bucket": t.column("bucket"), "counts": pa.array(out, pa.binary()), "n": pa.array(stats[0], longs), "v": pa.array(stats[1], longs),
        "top": pa.array(stats[2], pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("g", pa.int32())]))),
    })


def _scored(packed: bytes):
    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        z = np.load(io.BytesIO(packed))
        w, top, mass, total, kinds = (z[k] for k in ("w", "top", "mass", "total", "kinds"))
        outer, inner = _parts(w)
        h_all, g_all, sizes_all = (np.concatenate(x) for x in zip((np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int64)), *(tokens_of(b) for b in left.to_batches()), strict=True))
        inverse = np.unique(h_all, return_inverse=True)[1]
        ends = np.append(0, np.cumsum(sizes_all))
        order = np.argsort(right.column("bucket").to_numpy())
        counts = right.column("counts")
        c = np.concatenate([np.frombuffer(counts[int(i)].as_py(), np.int64) for i in order] or [np.empty(0, np.int64)])
        cols: dict[str, list[np.ndarray]] = {k: [] for k in ("n_tokens", "n_known", "base", "score")}
        for lo in range(0, len(sizes_all), 256):
            sizes = sizes_all[lo : lo + 256]
            at = slice(ends[lo], ends[lo + len(sizes)])
            h, g, own = h_all[at], g_all[at], c[inverse[at]]
            k = classes_of(h, g, top)
            p = np.empty(len(h))
            f = features(h, k, sizes)
            for a in range(0, len(h), MINIBATCH):
                part = class_probabilities(outer, f[a : a + MINIBATCH])
                p[a : a + MINIBATCH] = part[np.arange(len(part)), k[a : a + MINIBATCH]]
            many = np.flatnonzero(k > TOP)
            km, kind = k[many], g[many] % KINDS
            log_mass = mass[km - 1 - TOP]
            each = np.arange(len(many))
            inside = np.ones(len(h))
            # exp(a word's weight) over the sum of its kind's, times the kind's share of the whole sum
            inside[many] = (own[many] + ALPHA) * np.exp(-log_mass[each, kind].astype(float)) * kind_probabilities(inner, inside_features(f[many], km), log_mass)[each, kind]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            cols["n_tokens"].append(sizes)
            cols["n_known"].append(np.add.reduceat((own > 0).astype(np.int64), first))
            cols["base"].append(np.add.reduceat(np.log10((own + ALPHA) / (total + ALPHA * (kinds + 1))), first))
            cols["score"].append(np.add.reduceat(np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(inside, 1e-300)), first))
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), **{k: pa.array(np.concatenate(cols[k]), pa.int64()) for k in ("n_tokens", "n_known")},
            "train_tokens": pa.array(np.full(left.num_rows, int(total)), pa.int64()), "base_score": pa.array(np.concatenate(cols["base"]), pa.float64()), "score": pa.array(np.concatenate(cols["score"]), pa.float64()),
        })

    return step


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes each, and one for each shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // block_bytes))


def score(docs: DataFrame, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    A null text is empty: one token, the end. Rows with a null doc_id are training rows; repeated rows count each; other
    columns are ignored; an empty table gives an empty result. A word in no training text has count 0 in the base, and
    in its class the share of the one word not seen of its kind. Scores are log10 probabilities.
    """
    n = block_count(docs, block_bytes)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), is_held_out(F.col("doc_id")).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"),
    )
    blocks = base.repartition(n, "block")  # as many partitions as blocks, which the grouping takes as they are
    asked = blocks.groupBy("block").applyInArrow(_asked(n), "bucket int, block int, h binary, c binary, g binary")
    answers = checkpointed(asked.repartition(n, "bucket").groupBy("bucket").applyInArrow(_answered, _ANSWER))
    sums = answers.where("n is not null").select(F.posexplode(F.arrays_zip("n", "v"))).groupBy("pos").agg(F.sum("col.n").alias("n"), F.sum("col.v").alias("v")).collect()
    groups = GROUPS * KINDS
    in_n, in_v = np.zeros(groups + 1, np.int64), np.zeros(groups + 1, np.int64)
    for x in sums:
        in_n[x.pos], in_v[x.pos] = x.n, x.v
    total, kinds = int(in_n.sum()), int(in_v.sum())
    best = answers.where("top is not null").select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("c"), "h").limit(TOP).collect()
    for x in best:
        in_n[x.g] -= x.c
        in_v[x.g] -= 1
    top = np.sort(np.array([x.h for x in best], np.int64).view(np.uint64))
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(rounds))
    # a word not seen has its place in each kind
    mass = np.log(in_n[:-1] + ALPHA * (in_v[:-1] + 1)).astype(np.float32).reshape(GROUPS, KINDS)
    w = train(base.where("not held_out").select("text", part.alias("part")), top, mass, rounds)
    out = io.BytesIO()
    np.savez(out, w=w, top=top, mass=mass, total=total, kinds=kinds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    to = answers.select("block", "bucket", "counts").repartition(n, "block")
    return blocks.groupBy("block").cogroup(to.groupBy("block")).applyInArrow(_scored(out.getvalue()), schema)


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
