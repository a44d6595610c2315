"""Ranked name search: exact phrases, aliases and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.text import normalised_name

#: Kinds of a hit, best first at equal scores.
_KINDS = ("exact", "alias", "fuzzy")
#: Scores of a phrase and of an alias found in a name; similarity alone never reaches the latter.
EXACT, ALIAS, MOST_SIMILAR = 100.0, 96.0, 95.0
#: Characters told apart when names are ruled out by their letter counts.
_LETTERS = 128


def query_status(q: str, least: int, k: int) -> str:
    """The first contract that a query breaks, or ok."""
    if not 50 <= least <= 100 or not 1 <= k <= 256:
        return "invalid_options"
    if len(q.encode()) > 256:
        return "query_too_long"
    if not q.isascii():
        return "unsupported_query_text"
    words = "".join(c if c.isalnum() else " " for c in q).split()
    if not words:
        return "empty_query"
    return "query_too_short" if len(" ".join(words)) < 3 else "ok"


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b), the longest common subsequence by bit-parallel rows."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def best_window_ratio(query: str, name: str) -> float:
    """The query against the whole name and against each run of as many words."""
    words, n = name.split(), len(query.split())
    runs = {name} | {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    return max(indel_ratio(query, r) for r in runs)


def exact_and_alias(names: DataFrame, queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (id, norm) whose words hold a query's phrase (100, exact) or an alias of it (96, alias)."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    terms = queries.select("query", F.col("query").alias("term"), F.lit("exact").alias("kind"), F.lit(100.0).alias("score")).unionAll(
        queries.join(aliases, "query").select("query", F.col("alias").alias("term"), F.lit("alias"), F.lit(96.0)))
    first = terms.withColumn("w", F.split("term", " ")[0])
    words = names.select("id", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("w"))
    hit = words.join(first, "w").where(F.contains(pad(F.col("norm")), pad(F.col("term"))))
    return hit.groupBy("query", "id").agg(F.max_by(F.struct("score", "kind"), "score").alias("b")).select("query", "id", "b.score", "b.kind")


def _letter_counts(texts: list[str]) -> np.ndarray:
    """[texts, letters] how often each character comes; names are ASCII after normalisation."""
    data = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(row * _LETTERS + data, minlength=len(texts) * _LETTERS).reshape(-1, _LETTERS).astype(np.int32)


def similar_names(names: list[str], query: str, least: float) -> dict[int, float]:
    """Place -> best window ratio of the names that reach least.

    A common subsequence uses no letter more often than both texts have it, so the letter counts bound the ratio; only
    runs whose bound reaches least are compared in full.
    """
    n = len(query.split())
    runs: dict[str, list[int]] = {}
    for at, name in enumerate(names):
        words = name.split()
        for r in {name, *(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))}:
            runs.setdefault(r, []).append(at)
    texts = list(runs)
    if not texts:
        return {}
    size = np.array([len(t) for t in texts]) + len(query)
    shared = np.minimum(_letter_counts(texts), _letter_counts([query])).sum(1)
    out: dict[int, float] = {}
    for i in np.flatnonzero(200.0 * shared >= (least - 1e-6) * size):
        s = round(indel_ratio(query, texts[i]), 6)
        if s >= least:
            for at in runs[texts[i]]:
                out[at] = max(out.get(at, 0.0), s)
    return out


def _hits(queries: list[str], aliases: list[tuple[str, str]], least: float):
    terms = [(q, f" {q} ", 0, EXACT) for q in queries] + [(q, f" {a} ", 1, ALIAS) for q, a in aliases if q in queries]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place, names = pd.factorize(b.norm)
            names = list(names)
            best: dict[tuple[str, int], tuple[float, int]] = {}
            for q in queries:
                best.update({(q, at): (min(s, MOST_SIMILAR), 2) for at, s in similar_names(names, q, least).items()})
            for at, name in enumerate(names):
                padded = f" {name} "
                for q, term, kind, s in terms:
                    if term in padded:
                        best[q, at] = max(best.get((q, at), (0.0, 9)), (s, kind), key=lambda x: (x[0], -x[1]))
            hits = pd.DataFrame([(q, at, s, kind) for (q, at), (s, kind) in best.items()], columns=["query", "at", "score", "kind"])
            yield pd.DataFrame({"id": b.id.array, "at": place}).merge(hits, on="at")[["query", "id", "score", "kind"]]

    return step


def fuzzy_top_k(entries: DataFrame, name: str, queries: list[str], aliases: list[tuple[str, str]] = (), least: int = 80, k: int = 8) -> DataFrame:
    """query, rank, id, score, kind: the k best names of each stated query; score, then kind, then id decide.

    entries: id and name; a null or empty name is never found. Queries that break a contract are left out (see
    query_status). Names are scored where they are read, once in an Arrow batch however often they come; each task cuts
    its hits to the k best before they are shuffled, so the names themselves never move.
    """
    good = list(dict.fromkeys(" ".join("".join(c if c.isalnum() else " " for c in q).lower().split()) for q in queries if query_status(q, least, k) == "ok"))
    named = entries.select("id", normalised_name(name).alias("norm")).where("norm <> ''")
    id_type = named.schema["id"].dataType.simpleString()
    hits = named.mapInPandas(_hits(good, list(aliases), float(least)), f"query string, id {id_type}, score double, kind int")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "kind", "id")
    label = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), F.col("kind") + 1)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "score", label.alias("kind"))
