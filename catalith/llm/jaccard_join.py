"""Exact Jaccard join on word shingles by vertical partitioning.

The global order of the shingles is rarest first, by document frequency and then by hash. Blocks of documents ask buckets
of hashes how often each of their distinct shingles comes. A set that links with another shares at least PERCENT of its
shingles with it, so sets with too many shingles of their own are done. What is left is small: of each such set only
a prefix in the global order finds candidates (two sets that link share a shingle of it), and the overlap of each candidate
pair is counted fragment by fragment of the hash range and summed. Equal sets are one class from the start. In a group
that shares a shingle, members are first compared with one of them; after that only members of different components
are, chunk by chunk, so a group of near copies costs its size and not its square, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import U64, checkpointed, components, doc_key, mix64
from catalith.llm.lm_score import tokens_of

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Text bytes of a block of documents, and of the share of all texts that one bucket of shingle hashes stands for.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Candidate sets' frequencies are broadcast up to this many bytes to fetch their texts; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Fragments that verify, cells of the sketch that rules pairs out, and members compared with each other at a time.
FRAGMENTS, CELLS, CHUNK = 4, 256, 256
#: What is known of a document: its key, set size and set key.
DOC = np.dtype([("did", "<i8"), ("known", "u1"), ("th", "<i8"), ("n", "<i4"), ("a", "V16")])
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U64)


def shingle_sets(batch: pa.RecordBatch, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each row's distinct shingles in hash order; a text of fewer words is one shingle."""
    h, _, sizes = tokens_of(batch)
    ends = np.cumsum(sizes) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = sizes - 1
    x = np.zeros(len(h), U64)
    for j in range(words):
        x[: max(0, len(h) - j)] += h[j:] * _STEP[j % 5] * U64(2 * j + 1)
    at = np.arange(len(h))
    whole = at + words <= ends[owner]
    # short texts: their words up to the end token, which stands for nothing but the length
    short = (at == (ends - n)[owner]) & (n[owner] > 0) & (n[owner] < words)
    for i in np.flatnonzero(short):
        k = n[owner[i]]
        with np.errstate(over="ignore"):
            x[i] = (h[i : i + k] * _STEP[np.arange(k) % 5]).sum() + U64(k) * U64(0x2545F4914F6CDD1D)
    ok = whole | short
    x, owner = mix64(x[ok]), owner[ok]
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return x[first], np.bincount(owner[first], minlength=len(sizes))


def set_keys(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each set, as 16 bytes; zeros for an empty one."""
    has = sizes > 0
    first = (np.cumsum(sizes) - sizes)[has]
    out = np.zeros((len(sizes), 2), ">u8")
    if len(first):
        for j, salt in enumerate((U64(0x8CB92BA72F3D8DD7), U64(0x94D049BB133111EB))):
            out[has, j] = mix64(np.add.reduceat(mix64(x ^ salt), first) + sizes[has].astype(U64))
    return out.view("V16").ravel()


def sketches(x: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Shingles of each set in each of CELLS ranges of hashes, modulo 256: two sets differ in no less than these do."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    per = np.bincount(owner * CELLS + (x >> U64(64 - (CELLS - 1).bit_length())).astype(np.int64), minlength=CELLS * len(sizes)).astype(np.uint8)
    return [r.tobytes() for r in per.reshape(-1, CELLS)]


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches and sizes allow the threshold."""
    d = np.abs(a - b)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * np.minimum(d, 256 - d).sum(1) <= (100 - percent) * (na + nb))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about BLOCK_BYTES."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(end):
        hi = int(np.searchsorted(end, (end[lo - 1] if lo else 0) + BLOCK_BYTES, side="right"))
        hi = min(max(hi, lo + 1), lo + 65_535)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _asked(words: int, buckets: int):
    """Documents to blocks: a row for each bucket (24 bits of each distinct hash, and in how many of the block's documents
    it is), and one with the block's documents and whose the hashes are."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _runs(batch):
                x, sizes = shingle_sets(part, words)
                docs = np.empty(len(sizes), DOC)
                docs["did"], docs["th"], docs["known"] = (part.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th", "known"))
                docs["n"], docs["a"] = sizes, set_keys(x, sizes)
                owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
                order = np.argsort(x, kind="stable")
                x, owner = x[order], owner[order]
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, int)
                times = np.diff(np.append(first, len(x))).astype("<u2")
                x = x[first]
                bucket = (((x >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(x) else np.empty(0, int)
                ends = np.append(cut[1:], len(x))[: len(cut)]
                low = np.ascontiguousarray((x & U64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
                n = len(cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(bucket[cut], -1 - block % buckets).astype(np.int32)), pa.array(np.full(n + 1, block)),
                    pa.array([*(low[i:j].tobytes() for i, j in zip(cut, ends, strict=True)), None], pa.binary()), pa.array([*(times[i:j].tobytes() for i, j in zip(cut, ends, strict=True)), times.tobytes()], pa.binary()),
                    pa.array([None] * n + [docs.tobytes()], pa.binary()), pa.array([None] * n + [owner.astype("<u2").tobytes()], pa.binary()),
                ], names=["bucket", "block", "data", "times", "docs", "owner"])
                block += 1

    return step


_ASKED = "bucket int, block long, data binary, times binary, docs binary, owner binary"


def _answered(table: pa.Table) -> pa.Table:
    """A bucket's rows with data replaced by one byte for each hash: in how many documents it is, 255 at most."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    low = [np.frombuffer(v.as_py(), np.uint8).reshape(-1, 3).astype(np.uint32) for v in table.column("data")]
    ends = np.cumsum([len(v) for v in low])
    low = np.concatenate(low)
    times = np.concatenate([np.frombuffer(v.as_py(), "<u2") for v in table.column("times")])
    _, inverse = np.unique(low[:, 0] | low[:, 1] << 8 | low[:, 2] << 16, return_inverse=True)
    level = np.minimum(np.bincount(inverse, times), 255).astype(np.uint8)[inverse]
    none = pa.nulls(table.num_rows, pa.binary())
    return pa.table([table.column("bucket"), table.column("block"), pa.array([v.tobytes() for v in np.split(level, ends[:-1])], pa.binary()), none, none, none], names=table.column_names)


def _told(percent: int):
    """A block's rows to its documents; levels (the answers in the order of the hashes) of those that may have a link."""

    def block(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket").to_numpy()
        head = int(np.flatnonzero(bucket < 0)[0])
        docs, owner, times = (np.frombuffer(table.column(c)[head].as_py(), t) for c, t in (("docs", DOC), ("owner", "<u2"), ("times", "<u2")))
        rows = [i for i in np.argsort(bucket) if i != head]
        level = np.concatenate([np.frombuffer(table.column("data")[int(i)].as_py(), np.uint8) for i in rows]) if rows else np.empty(0, np.uint8)
        level = np.repeat(level, times)[np.argsort(owner, kind="stable")]
        n = docs["n"].astype(np.int64)
        end = np.cumsum(n)
        shared = np.bincount(np.sort(owner)[level > 1], minlength=len(n))
        may = (n > 0) & (100 * shared >= percent * n)
        levels = [level[e - k : e].tobytes() if m else None for e, k, m in zip(end, n, may, strict=True)]
        known = docs["known"] == 0
        return pa.table([
            pa.array(docs["did"].copy()), pa.array(docs["th"].copy()), pa.array(docs["did"].copy(), mask=known), pa.array(n), pa.array([v.tobytes() for v in docs["a"]], pa.binary()), pa.array(levels, pa.binary()),
        ], names=["did", "th", "doc_id", "n", "a", "levels"])

    return block


def _sets(words: int, percent: int):
    """Rows (a, c, levels, text) to the sets that may have a link: n, cells, the pieces of each fragment, and the
    prefix: sigs (shingles that other classes have too) and mids (whether a smaller set may be found by it)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch):
                x, sizes = shingle_sets(part, words)
                keys, cells = set_keys(x, sizes), sketches(x, sizes)
                out: dict[str, list] = {c: [] for c in ("a", "n", "cells", "pieces", "sigs", "mids")}
                end = np.cumsum(sizes)
                for i, (a, c, levels) in enumerate(zip(part.column("a"), part.column("c"), part.column("levels"), strict=True)):
                    if keys[i].tobytes() != a.as_py():  # another text of the same key
                        continue
                    n, own, level = int(sizes[i]), x[end[i] - sizes[i] : end[i]], np.frombuffer(levels.as_py(), np.uint8)
                    # a shingle that only this class's documents have is in no other set
                    alone = (level <= c.as_py()) & (level < 255)
                    probe, mid = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                    if 100 * (n - alone.sum()) < percent * n:
                        continue
                    order = np.argsort(level, kind="stable")[:probe]
                    rank = np.flatnonzero(~alone[order])
                    cut = np.searchsorted(own, (np.arange(1, FRAGMENTS) * (2**64 // FRAGMENTS)).astype(U64))
                    for k, v in zip(out, (a.as_py(), n, cells[i], [p.tobytes() for p in np.split(own, cut)], own[order[rank]].view(np.int64), rank < mid), strict=True):
                        out[k].append(v)
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return step


def _cells(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in col), np.uint8).reshape(-1, CELLS).astype(np.int16)


def _crossed(percent: int, likeliest: bool):
    """Two chunks of a group (sides 0 and 1; side 0 alone: a chunk with itself) to the pairs of classes of different
    components that may be similar and of which the smaller is to be found by this group. With likeliest, of each
    class only the pair with the sketch most like its own in each other component."""

    def chunks(table: pa.Table) -> pa.Table:
        n, mid, side = (table.column(c).to_numpy() for c in ("n", "mid", "side"))
        _, comp = np.unique(np.array(table.column("comp").to_pylist(), object), return_inverse=True)
        a, cells = np.array(table.column("a").to_pylist(), object), _cells(table.column("cells"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one = not len(right)
        lo, hi = [], []
        for k, i in enumerate(left):
            far = left[k + 1 :] if one else right
            far = far[(comp[far] != comp[i]) & np.where(n[far] < n[i], mid[far], np.where(n[far] > n[i], mid[i], mid[i] | mid[far]))]
            far = far[possible(cells[far], cells[i], n[far], n[i], percent)] if len(far) else far
            if likeliest and len(far) > 1:
                far = far[np.argsort(np.abs(cells[far] - cells[i]).sum(1), kind="stable")]
                far = far[np.unique(comp[far], return_index=True)[1]]
            for j in far:
                lo.append(min(a[i], a[j]))
                hi.append(max(a[i], a[j]))
        return pa.table([pa.array(lo, pa.binary()), pa.array(hi, pa.binary())], names=["lo", "hi"])

    return chunks


def _ruled_out(percent: int):
    """Pairs with both sketches to those that may be similar."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = pa.array(possible(_cells(b.column("cl")), _cells(b.column("ch")), b.column("nl").to_numpy(), b.column("nh").to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([b.column("lo").filter(ok), b.column("hi").filter(ok)], names=["lo", "hi"])

    return step


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of each pair within one fragment."""
    for b in batches:
        n = [
            len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True))
            for x, y in zip(b.column("pl"), b.column("ph"), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([b.column("lo"), b.column("hi"), b.column("nl"), b.column("nh"), pa.array(n, pa.int64())], names=["lo", "hi", "nl", "nh", "part"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (lo, hi) that reach the threshold: overlaps counted fragment by fragment, then summed."""
    pieces = sets.select("a", "n", F.posexplode("pieces").alias("frag", "piece"))
    low = pieces.select(F.col("a").alias("lo"), "frag", F.col("n").alias("nl"), F.col("piece").alias("pl"))
    high = pieces.select(F.col("a").alias("hi"), "frag", F.col("n").alias("nh"), F.col("piece").alias("ph"))
    sized = pairs.join(high, "hi").join(low, ["lo", "frag"])
    parts = sized.select("lo", "hi", "nl", "nh", "pl", "ph").mapInArrow(_partial, "lo binary, hi binary, nl long, nh long, part long")
    whole = parts.groupBy("lo", "hi", "nl", "nh").agg(F.sum("part").alias("both"))
    return checkpointed(whole.where(100 * F.col("both") >= percent * (F.col("nl") + F.col("nh") - F.col("both"))).select("lo", "hi"))


def told_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """did, th, doc_id, n (set size), a (set key) and levels of every row of docs; levels is null if no link is possible."""
    base = docs.select(*doc_key(docs), F.col("doc_id").isNotNull().cast("byte").alias("known"), F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET_BYTES) + 1
    return (
        base.mapInArrow(_asked(words, buckets), _ASKED).groupBy("bucket").applyInArrow(_answered, _ASKED)
        .groupBy("block").applyInArrow(_told(percent), "did long, th long, doc_id long, n long, a binary, levels binary")
    )


def candidate_sets(docs: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a, n, cells, pieces, sigs, mids (see _sets) of each class that may have a link, from the text of one document of each."""
    may = rows.where("levels is not null").groupBy("a").agg(F.count("*").alias("c"), F.min(F.struct("did", "th")).alias("at"), F.min("levels").alias("levels"))
    may = checkpointed(may.select("a", "c", "levels", "at.did", "at.th"))
    if (may.agg(F.sum(F.octet_length("levels") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        may = F.broadcast(may)
    base = docs.select(*doc_key(docs), F.col("text").cast("binary").alias("text"))
    found = base.join(may, ["did", "th"]).select("a", "c", "levels", "text").mapInArrow(_sets(words, percent), "a binary, n long, cells binary, pieces array<binary>, sigs array<long>, mids array<boolean>")
    # a document that comes twice gives its set twice
    return checkpointed(found.dropDuplicates(["a"]))


def crossing(groups: DataFrame, comp: DataFrame, sets: DataFrame, percent: int = PERCENT, likeliest: bool = False) -> DataFrame:
    """lo, hi: the possible links between different components (comp: a, component) within each group (sig, a, n, mid, first).

    The members of the leader's component and the rest are cut into chunks by hash, and each chunk of the rest meets
    each other chunk in a task of its own.
    """
    named = groups.join(comp, "a", "left").withColumn("comp", F.coalesce("component", "a"))
    named = named.join(comp.select(F.col("a").alias("first"), F.col("component").alias("c1")), "first", "left").withColumn("main", F.col("comp") == F.coalesce("c1", "first"))
    named = checkpointed(named.select("sig", "a", "n", "mid", "comp", "main"))
    sizes = named.groupBy("sig").agg(*[F.ceil(F.sum(F.when(c, 1).otherwise(0)) / CHUNK).cast("int").alias(k) for k, c in (("km", F.col("main")), ("kr", ~F.col("main")))]).where("kr > 0")
    named = named.join(sizes, "sig").withColumn("h", F.pmod(F.xxhash64("a"), F.when(F.col("main"), F.col("km")).otherwise(F.col("kr"))).cast("int"))
    upto = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>"))
    # (i, j, side): the main chunk i or, marked by -1 - i, the rest chunk i with the rest chunk j
    meet = F.when(F.col("main"), F.transform(upto("kr"), lambda j: F.struct(F.col("h").alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(F.concat(
        F.transform(upto("km"), lambda i: F.struct(i.alias("i"), F.col("h").alias("j"), F.lit(1).alias("side"))),
        F.transform(upto("kr"), lambda k: F.struct((-1 - F.least(k, "h")).alias("i"), F.greatest(k, "h").alias("j"), (F.col("h") > k).cast("int").alias("side"))),
    ))
    met = named.join(sets.select("a", "cells"), "a").select("sig", "a", "n", "mid", "comp", "cells", F.explode(meet).alias("m")).select("sig", "a", "n", "mid", "comp", "cells", "m.*")
    return met.groupBy("sig", "i", "j").applyInArrow(_crossed(percent, likeliest), "lo binary, hi binary").distinct()


def joined(near: DataFrame) -> DataFrame:
    """a, component of every class that the links near (lo, hi) reach."""
    return checkpointed(components(near, "lo", "hi").select(F.col("node").alias("a"), "component"))


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row of docs (doc_id, text) with n_shingles and component_id.

    Returns did, th (see doc_key), doc_id, n_shingles, component_id and component (the component's own key, null for an
    empty set), one row for each input row. Equal sets are linked with each other; empty sets (null texts, texts without
    words) with nothing, and have their own doc_id. A component's id is its smallest doc_id that isn't null. Other columns
    are ignored; an empty table gives an empty result. Shingles are identified by 64-bit, sets by 128-bit hashes.
    """
    rows = checkpointed(told_rows(docs, words, percent))
    sets = candidate_sets(docs, rows, words, percent)
    groups = sets.select("a", "n", F.explode(F.arrays_zip("sigs", "mids")).alias("s")).select(F.col("s.sigs").alias("sig"), "a", "n", F.col("s.mids").alias("mid"))
    heads = groups.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.when(F.col("mid"), F.struct("n", "a"))).alias("lead")).where("c > 1 and lead is not null")
    groups = checkpointed(groups.join(heads.select("sig", F.col("lead.a").alias("first")), "sig"))
    star = groups.where("a <> first").select(F.least("a", "first").alias("lo"), F.greatest("a", "first").alias("hi")).distinct()
    side = lambda x: sets.select(F.col("a").alias(x), F.col("n").alias("n" + x[0]), F.col("cells").alias("c" + x[0]))
    star = checkpointed(star.join(side("lo"), "lo").join(side("hi"), "hi").mapInArrow(_ruled_out(percent), "lo binary, hi binary"))
    comp, seen = joined(verified(star, sets, percent)), star
    # the likeliest links first: they join what belongs together, so that few pairs are left for the whole comparison
    for likeliest in (True, False):
        other = checkpointed(crossing(groups, comp, sets, percent, likeliest).join(seen, ["lo", "hi"], "left_anti"))
        if other.isEmpty():
            continue
        near, seen = verified(other, sets, percent), seen.unionAll(other)
        if not near.isEmpty():
            # what is joined already goes on as one link a member
            comp = joined(near.unionAll(comp.select(F.col("component").alias("lo"), F.col("a").alias("hi"))))
    full = rows.where("n > 0")
    ids = full.groupBy("a").agg(F.min("doc_id").alias("id")).join(comp, "a", "left").select("a", "id", F.coalesce("component", "a").alias("component"))
    named = ids.join(ids.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("a", "component", "component_id")
    linked = full.join(named, "a").select("did", "th", "doc_id", F.col("n").alias("n_shingles"), "component_id", "component")
    return linked.unionAll(rows.where("n = 0").select("did", "th", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component")))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles are alike to 80 per cent."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: The same by joining all shingles; the words are joined with blanks, which no word holds.
OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s
), e AS (SELECT doc_id, unnest(s) AS g FROM s
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n_shingles + y.n_shingles - k)
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""
