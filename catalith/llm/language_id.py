"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is labelled: two gated recurrent layers, one from each side, feed a softmax at each position, and
a document's probabilities are the mean over its positions. Texts run through the network in chunks of CHUNK bytes, so
that any length takes bounded memory. The network is trained in numpy by backpropagation through time, on a bounded
sample of labelled rows; inference is numpy over Arrow batches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import arrow_texts

HIDDEN = 10
CHUNK = 64
#: The bounded sample: documents for each language, bytes of each in so many stretches, and the languages up to which
#: each gets its full number of documents; with more, all are learned from fewer documents each.
SAMPLE_DOCS, SAMPLE_BYTES, PIECES, SAMPLE_LANGS = 160, 1024, 4, 64
EPOCHS, BATCH, RATE, SEED = 3, 128, 0.02, 7
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def initial(n_langs: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights of both directions stacked: e[256, 2, 3h] input rows (update, reset, candidate), u[2, h, 3h], o[2h, langs]."""
    r = np.random.default_rng(seed)
    h = hidden
    return {
        "e": r.normal(0, 0.3, (257, 2, 3 * h)).astype(np.float32), "u": r.normal(0, 0.3, (2, h, 3 * h)).astype(np.float32),
        "o": r.normal(0, 0.3, (2 * h, n_langs)).astype(np.float32), "b": np.zeros(n_langs, np.float32),
    }


def forward(w: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    """Hidden states [T, 2, B, h] (second direction in its own time order) of byte chunks x [T, B]; with keep, the gates too."""
    T, B = x.shape
    h = w["u"].shape[1]
    both = np.stack([x, x[::-1]], 1)
    uz, uc = w["u"][:, :, : 2 * h], w["u"][:, :, 2 * h :]
    s = np.zeros((2, B, h), np.float32)
    states = np.empty((T, 2, B, h), np.float32)
    gates = []
    e0, e1 = np.ascontiguousarray(w["e"][:, 0]), np.ascontiguousarray(w["e"][:, 1])
    for t in range(T):
        inp = np.stack([e0[both[t, 0]], e1[both[t, 1]]])
        zr = _sigmoid(inp[:, :, : 2 * h] + s @ uz)
        z, r = zr[:, :, :h], zr[:, :, h:]
        c = np.tanh(inp[:, :, 2 * h :] + (r * s) @ uc)
        if keep:
            gates.append((s, z, r, c))
        s = s + z * (c - s)
        states[t] = s
    return (states, gates, both) if keep else states


def position_logits(w: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    """[T, B, langs]: each position sees its left side and its right side."""
    h = states.shape[3]
    return states[:, 0] @ w["o"][:h] + states[::-1, 1] @ w["o"][h:] + w["b"]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the labelled positions, and its gradients, by backpropagation through time."""
    T, B = x.shape
    h = w["u"].shape[1]
    states, gates, both = forward(w, x, keep=True)
    p = _softmax(position_logits(w, states))
    n = max(1.0, float(mask.sum()))
    loss = -float((np.log(np.take_along_axis(p, y[None, :, None].repeat(T, 0), 2)[..., 0] + 1e-9) * mask).sum()) / n
    d = p.copy()
    d[:, np.arange(B), y] -= 1
    d *= (mask / n)[..., None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["b"] = d.sum((0, 1))
    g["o"][:h] = np.tensordot(states[:, 0], d, ([0, 1], [0, 1]))
    g["o"][h:] = np.tensordot(states[::-1, 1], d, ([0, 1], [0, 1]))
    ds = np.stack([d @ w["o"][:h].T, (d @ w["o"][h:].T)[::-1]], 1)
    uz, uc = w["u"][:, :, : 2 * h], w["u"][:, :, 2 * h :]
    run = np.zeros((2, B, h), np.float32)
    for t in range(T - 1, -1, -1):
        s, z, r, c = gates[t]
        run = run + ds[t]
        dc = run * z * (1 - c * c)
        dz = run * (c - s) * z * (1 - z)
        drs = dc @ uc.transpose(0, 2, 1)
        dr = drs * s * r * (1 - r)
        dzr = np.concatenate([dz, dr], 2)
        g["u"][:, :, : 2 * h] += s.transpose(0, 2, 1) @ dzr
        g["u"][:, :, 2 * h :] += (r * s).transpose(0, 2, 1) @ dc
        full = np.concatenate([dzr, dc], 2)
        for k in (0, 1):
            np.add.at(g["e"][:, k], both[t, k], full[k])
        run = run * (1 - z) + dzr @ uz.transpose(0, 2, 1) + drs * r
    return loss, g


def chunks_of(texts: list[bytes], size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte chunks [size, n] (256 pads), their mask, and the text that each belongs to."""
    lens = np.array([len(t) for t in texts], np.int64)
    per = -(-lens // size)
    owner = np.repeat(np.arange(len(texts)), per)
    out = np.full(int(per.sum()) * size, 256, np.int16)
    at = np.concatenate([[0], np.cumsum(per)[:-1]]) * size
    for a, t in zip(at, texts, strict=True):
        out[a : a + len(t)] = np.frombuffer(t, np.uint8)
    out = out.reshape(-1, size).T
    return out, out < 256, owner


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> tuple[dict[str, np.ndarray], list[str]]:
    """Weights and the language of each output, by Adam over shuffled chunks; languages weigh the same."""
    langs = sorted(set(labels))
    w = initial(len(langs), hidden, seed)
    x, mask, owner = chunks_of(texts)
    y = np.array([langs.index(v) for v in labels])[owner] if len(owner) else np.zeros(0, int)
    r = np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    most = max(np.bincount(y, minlength=len(langs))) if len(y) else 0
    for epoch in range(epochs):
        # each language comes equally often
        order = np.concatenate([np.resize(r.permutation(np.flatnonzero(y == k)), most) for k in range(len(langs)) if (y == k).any()] or [np.zeros(0, int)])
        r.shuffle(order)
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            _, g = gradients(w, x[:, at], mask[:, at], y[at])
            step += 1
            for k in w:
                a = np.clip(g[k], -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                w[k] -= (RATE / (1 + epoch) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w, langs


def probabilities(w: dict[str, np.ndarray], texts: list[bytes], width: int = 2048) -> np.ndarray:
    """Mean of the position probabilities of each whole text; uniform for an empty one."""
    n = w["o"].shape[1]
    total, count = np.zeros((len(texts), n)), np.zeros(len(texts))
    lens = np.array([len(t) for t in texts], np.int64)
    lo = 0
    while lo < len(texts):
        hi = lo + 1
        size = lens[lo]
        while hi < len(texts) and size + lens[hi] <= width * CHUNK:
            size += lens[hi]
            hi += 1
        x, mask, owner = chunks_of(texts[lo:hi])
        for a in range(0, x.shape[1], width):
            part = x[:, a : a + width]
            p = _softmax(position_logits(w, forward(w, part))) * mask[:, a : a + width, None]
            np.add.at(total, owner[a : a + width] + lo, p.sum(0))
            np.add.at(count, owner[a : a + width] + lo, mask[:, a : a + width].sum(0))
        lo = hi
    return np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], 1 / max(n, 1))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> tuple[dict[str, np.ndarray], list[str]]:
    """Train on a bounded sample of the rows that are not held out and have a language, of every language there is: by a
    hash of the document about docs_per_lang of each (fewer above SAMPLE_LANGS languages), and of each text sample_bytes
    in PIECES stretches spread over the whole of it."""
    rows = docs.where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return initial(1), [UNKNOWN]
    each = max(1, min(docs_per_lang, docs_per_lang * SAMPLE_LANGS // len(counts)))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**40))
    # a language of few rows gives all of them; rows that repeat share a hash and come together
    shares = F.create_map(*[F.lit(x) for c in counts for x in (c["lang"], int(2**40 * min(1.0, (1.5 * each + 8) / c["count"])))])
    near = rows.withColumn("h", h).where(F.col("h") < F.element_at(shares, F.col("lang")))
    size = F.octet_length("text")
    piece = sample_bytes // PIECES
    stretch = lambda i: F.substring(F.col("text").cast("binary"), (F.floor((size - piece) * i / (PIECES - 1)) + 1).cast("int"), F.lit(piece))
    cut = F.when(size <= sample_bytes, F.col("text").cast("binary")).otherwise(F.concat(*[stretch(i) for i in range(PIECES)]))
    order = Window.partitionBy("lang").orderBy("h", "text")
    got = near.select("lang", "h", cut.alias("text")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * each).orderBy("h", "lang", "text").collect()
    return train([bytes(g["text"]) for g in got], [g["lang"] for g in got])


def predict(docs: DataFrame, model: tuple[dict[str, np.ndarray], list[str]]) -> DataFrame:
    """docs with lang_pred and score: the best language of each whole text and its pooled probability.

    'und' with score 0 where the text is null or has no letter. Only the text is an input; all columns of docs are
    carried (but earlier lang_pred and score are replaced), one row for each input row.
    """
    w, langs = model
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    names = base.columns
    out = io.BytesIO()
    np.savez(out, **w)
    packed = out.getvalue()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.load(io.BytesIO(packed))
        own = {k: z[k] for k in z.files}
        for b in batches:
            texts = arrow_texts(b.column("text")).to_pylist()
            p = probabilities(own, texts)
            best = p.argmax(1)
            letters = [any(c.isalpha() for c in t.decode("utf-8", "replace")) for t in texts]
            lang = [langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            score = [float(v) if ok else 0.0 for v, ok in zip(p.max(1), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "lang_pred string", "score double"])
    return base.mapInArrow(step, schema)


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score; trained on the rows that are not held out."""
    return predict(docs, fit(docs)).withColumn("held_out", is_held_out(F.col("doc_id")))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
