"""Removal of long repeated passages by a logarithmic family of suffix arrays.

A passage of LENGTH bytes that starts at two places of the corpus, in one document or two, is a repeat. The
places of a passage are brought together by content: each passage belongs to the smallest of its K-byte hashes,
so equal passages always meet, and neighbouring passages that share that hash travel as one segment. Only segments
whose hash comes twice matter, and equal segments are counted before they move. A hash with too many distinct
segments for one task (a common line in many surroundings) is cut anew by the hashes of longer strings, up to the
passage itself, so the segments of any hash stay few. They are indexed in tasks by families of suffix arrays: a new batch
gets its suffix array, is merge-scanned against the existing levels for matches of LENGTH bytes, and levels of equal size
merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import Rolling, checkpointed, doc_key, partitions, text_steps, window_min

LENGTH = 200
#: Bytes of the strings whose hashes deal out the passages; the next where a hash has more than CROWD distinct segments
#: (of at most 376 bytes each, so that the suffix arrays of one hash take about 100 MB).
KS = (24, 72, 136, 200)
CROWD = 6000
#: Suffixes sorted at once.
BATCH = 1 << 15


def _runs(length: int, k: int):
    """Arrow batches of (did, th, text) to segments (did, th, start, n, key, seg, own): n passages from start."""
    w = length - k + 1
    grams, whole = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)

    def of(data: np.ndarray, off: np.ndarray):
        sizes = np.diff(off) - (length - 1)
        if len(data) < length or not (sizes > 0).any():
            return None
        p = grams.prefix(data)
        n = len(data) - k + 1
        h = (p[k:] - p[:-k]) * grams.down[:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = window_min(h, w)
        change = np.empty(len(low), bool)
        change[0] = True
        np.not_equal(low[1:], low[:-1], out=change[1:])
        has = np.flatnonzero(sizes > 0)
        change[off[has]] = True
        # a run ends at the next change or at its document's last passage
        start = np.flatnonzero(change)
        row = np.searchsorted(off, start, side="right") - 1
        last = off[row] + np.maximum(sizes[row], 0)
        end = np.minimum(np.append(start[1:], len(low)), last)
        ok = end > start
        start, end, row = start[ok], end[ok], row[ok]
        # a hash that comes twice inside one run: its segment may repeat within itself
        edge = np.zeros(w - 1, np.uint64)
        least = np.flatnonzero(~window_min(~np.concatenate([edge, low, edge]), w) == h)
        a, b = np.searchsorted(least, start), np.searchsorted(least, end + (w - 1))
        run = np.repeat(np.arange(len(start)), b - a)
        at = np.arange(len(run)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[run]
        own = np.bincount(run, h[least[at]] == low[start[run]], len(start)) > 1
        seg = whole.spans(whole.prefix(data), start, end + (length - 1))
        return row, start - off[row], end - start, low[start].view(np.int64), seg.view(np.int64), own

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, th = b.column("did").to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_steps(b):
                if (got := of(data, off)) is None:
                    continue
                row, start, n, key, seg, own = got
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[lo:hi][row]), pa.array(th[lo:hi][row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(seg), pa.array(own)],
                    names=["did", "th", "start", "n", "key", "seg", "own"],
                )

    return step


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of text as one number in byte order (zeros beyond the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(text)] << np.uint64(56 - 8 * j)
    return out


class SuffixArray:
    """The suffixes of text at the places order (sorted by their first length bytes), with the number of each."""

    def __init__(self, text: np.ndarray, places: np.ndarray, ids: np.ndarray, length: int):
        self.text, self.words, self.length = text, _words(text), length
        # prefix sorting: eight bytes a round, only among the suffixes that are still alike
        rank, order, alike = np.zeros(len(places), np.int64), np.arange(len(places)), np.arange(len(places))
        for at in range(0, length, 8):
            if not len(alike):
                break
            w = self._word(places[order[alike]], at)
            by = np.lexsort((w, rank[alike]))
            order[alike] = order[alike][by]
            r, w = rank[alike], w[by]
            new = np.append(True, (w[1:] != w[:-1]) | (r[1:] != r[:-1]))
            group = np.maximum.accumulate(np.where(new, alike, -1))
            rank[alike] = group
            single = new & np.append(new[1:], True)
            alike = alike[~single]
        self.order, self.ids = places[order], ids[order]
        #: Whether a suffix equals the one before it.
        self.same = np.zeros(len(places), bool)
        self.same[1:] = rank[1:] == rank[:-1]

    def _word(self, places: np.ndarray, at: int) -> np.ndarray:
        w = self.words[places + at]
        return w & ~np.uint64(0) << np.uint64(8 * (8 - min(8, self.length - at))) if self.length - at < 8 else w

    def compare(self, mine: np.ndarray, other: SuffixArray, places: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the suffixes of text at mine stand to other's at places."""
        out, alike = np.zeros(len(mine), np.int8), np.arange(len(mine))
        for at in range(0, self.length, 8):
            if not len(alike):
                break
            x, y = self._word(mine[alike], at), other._word(places[alike], at)
            out[alike] = np.where(x < y, -1, np.where(x > y, 1, 0))
            alike = alike[x == y]
        return out

    def find(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Merge scan: where each suffix of other belongs in this array, and whether that place holds its equal."""
        lo, hi = np.zeros(len(other.order), np.int64), np.full(len(other.order), len(self.order))
        hit = np.zeros(len(lo), bool)
        open_ = np.arange(len(lo))
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            c = self.compare(self.order[mid], other, other.order[open_])
            lo[open_] = np.where(c < 0, mid + 1, lo[open_])
            hi[open_] = np.where(c >= 0, mid, hi[open_])
            hit[open_] |= c == 0
            open_ = open_[lo[open_] < hi[open_]]
        return lo, hit

    def merged(self, other: SuffixArray) -> SuffixArray:
        """One array of both, in a single merge by place; of equal suffixes this array's stays."""
        at, hit = self.find(other)
        keep = ~hit & ~other.same
        out = object.__new__(SuffixArray)
        out.length, out.text = self.length, np.concatenate([self.text, other.text])
        out.words = np.concatenate([self.words, other.words])
        out.order = np.insert(self.order, at[keep], other.order[keep] + len(self.text))
        out.ids = np.insert(self.ids, at[keep], other.ids[keep])
        out.same = np.zeros(len(out.order), bool)
        return out


class Family:
    """Suffix arrays of geometrically growing sizes over the segments added so far."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, text: np.ndarray, places: np.ndarray, ids: np.ndarray, repeated: np.ndarray) -> None:
        """Mark in repeated (by number) every passage that the batch or a level has twice, then add the batch."""
        new = SuffixArray(text, places, ids, self.length)
        repeated[new.ids[new.same]] = True
        repeated[new.ids[:-1][new.same[1:]]] = True
        for old in self.levels:
            at, hit = old.find(new)
            repeated[new.ids[hit]] = True
            # a level keeps one copy of a passage, so its first place stands for it
            repeated[old.ids[at[hit]]] = True
        while self.levels and len(self.levels[-1].order) <= 2 * len(new.order):
            new = self.levels.pop().merged(new)
        if new.same.any():
            keep = ~new.same
            new.order, new.ids, new.same = new.order[keep], new.ids[keep], new.same[keep]
        self.levels.append(new)


def _group(segments: list[bytes], length: int, batch: int = BATCH) -> list[np.ndarray]:
    """For each distinct segment of one or more hashes: which of its passages another place has too."""
    whole = np.array([len(s) for s in segments])
    sizes = whole - length + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    repeated = np.zeros(first[-1], bool)
    family = Family(length)
    lo = 0
    while lo < len(segments):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + batch, side="right")) - 1)
        hi = min(hi, len(segments))
        ids = np.arange(first[lo], first[hi])
        places = ids - first[lo] + np.repeat(np.arange(hi - lo), sizes[lo:hi]) * (length - 1)
        family.add(np.frombuffer(b"".join(segments[lo:hi]), np.uint8), places, ids, repeated)
        lo = hi
    return np.split(repeated, first[1:-1])


def _true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _matches(length: int):
    """Arrow batches of (key, seg, body), sorted by key, to repeated runs (key, seg, a, b) within segments."""

    def flush(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        out: list[list[int]] = [[], [], [], []]
        for (key, seg, _), mask in zip(rows, _group([r[2] for r in rows], length), strict=True):
            for a, b in zip(*_true_runs(mask), strict=True):
                for x, v in zip(out, (key, seg, a, b), strict=True):
                    x.append(int(v))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "seg", "a", "b"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, key = 0, None
        for b in batches:
            for r in zip(b.column("key").to_pylist(), b.column("seg").to_pylist(), b.column("body").to_pylist(), strict=True):
                if r[0] != key and size >= BATCH:
                    yield flush(held)
                    held, size = [], 0
                key = r[0]
                held.append(r)
                size += len(r[2]) - length + 1
        if held:
            yield flush(held)

    return step


def _again(length: int, k: int):
    """Segments of crowded hashes cut into runs by the hashes of longer strings; the segment stands as (key, seg)."""
    cut = _runs(length, k)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(b.rename_columns(["did", "th", "text"]) for b in batches)

    return step


def _matched(segs: DataFrame, bodies: DataFrame, ks: tuple[int, ...], length: int, crowd: int) -> DataFrame:
    """key, seg, a, b: the runs [a, b) of passages within distinct segments that another place has too.

    segs: key, seg, c (places), own, m (distinct segments of the key); bodies: key, seg, m, body.
    """
    twice = segs.where("c > 1").select("key", "seg", F.lit(0).alias("a"), F.col("n").alias("b"))
    crowded = bool(ks) and not segs.where(F.col("m") > crowd).isEmpty()
    if crowded:  # read more than once
        bodies = checkpointed(bodies)
    n = partitions(segs.sparkSession)
    few = bodies.where((F.col("m") <= crowd) | F.lit(not ks)).select("key", "seg", "body").repartition(n, "key").sortWithinPartitions("key", "seg")
    out = twice.unionAll(few.mapInArrow(_matches(length), "key long, seg long, a int, b int"))
    if not crowded:
        return out
    many = bodies.where(F.col("m") > crowd).select(F.col("key").alias("did"), F.col("seg").alias("th"), F.col("body").alias("text"))
    inner = repeated_runs(many, many.mapInArrow(_again(length, ks[0]), _RUNS), ks[1:], length, crowd)
    return out.unionAll(inner.select(F.col("did").alias("key"), F.col("th").alias("seg"), "a", "b"))


_RUNS = "did long, th long, start int, n int, key long, seg long, own boolean"


def repeated_runs(texts: DataFrame, runs: DataFrame, ks: tuple[int, ...], length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """did, th, a, b: the runs [a, b) of passages of texts (did, th, text), cut into runs, that another place has too."""
    keys = runs.groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("o")).where("c > 1 or o").select("key")
    found = checkpointed(runs.join(keys, "key"))
    segs = found.groupBy("key", "seg").agg(F.count("*").alias("c"), F.max("own").alias("own"), F.min(F.struct("did", "th", "start", "n")).alias("at"))
    crowded = segs.groupBy("key").agg(F.count("*").alias("m"))
    segs = checkpointed(segs.join(crowded, "key").select("key", "seg", "c", "own", "m", "at.*"))
    # a segment's bytes come from one of its places; a segment alone with its hash needs none
    bodies = segs.where("m > 1 or own").join(texts, ["did", "th"]).select("key", "seg", "m", F.expr(f"substring(text, start + 1, n + {length - 1})").alias("body"))
    inner = _matched(segs, bodies, ks, length, crowd)
    return found.join(inner, ["key", "seg"]).select("did", "th", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, ks: tuple[int, ...] = KS, crowd: int = CROWD) -> DataFrame:
    """(did, th, spans): the byte runs [from, to) of each document that repeated passages cover, unmerged.

    docs: did, th, text (see doc_key); documents without repeats don't appear.
    """
    runs = repeated_runs(docs, docs.mapInArrow(_runs(length, ks[0]), _RUNS), ks[1:], length, crowd)
    return runs.groupBy("did", "th").agg(F.collect_list(F.struct(F.col("a").alias("f"), (F.col("b") + (length - 1)).alias("t"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        flat = b.column("spans")
        for i, text in enumerate(b.column("text")):
            raw = text.as_py() or b""
            runs: list[list[int]] = []
            if flat[i].is_valid:
                for f, t in sorted((s["f"], s["t"]) for s in flat[i].as_py()):
                    if runs and f <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], t)
                    else:
                        runs.append([f, t])
            parts, at = [], 0
            for f, t in runs:
                parts.append(raw[at:f])
                at = t
            kept = b"".join([*parts, raw[at:]])
            for x, v in zip(out, (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, runs), strict=True):
                out[x].append(v)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(out[x], pa.int64()) for x in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"]), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], pa.list_(pa.list_(pa.int64())))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
        )


def dedup_passages(docs: DataFrame, length: int = LENGTH, ks: tuple[int, ...] = KS, crowd: int = CROWD) -> DataFrame:
    """Cut every byte that a repeated passage covers out of each document.

    Returns one row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining
    bytes) and spans (the removed runs). A null text is empty; texts shorter than length lose nothing; rows with a
    null or repeated doc_id are documents of their own (two rows of the same text are repeats of each other); other
    columns of docs are ignored; an empty table gives an empty result. Segments are told apart by two 64-bit hashes.
    """
    base = docs.select(*doc_key(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spans = repeated_spans(base.drop("doc_id"), length, ks, crowd)
    joined = base.join(spans, ["did", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's removed bytes and the hash of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
