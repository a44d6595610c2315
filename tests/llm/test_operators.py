"""Corpus operators against brute force, on whole small tables and on awkward rows."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalith.llm import common, decontaminate, jaccard_join, kd_search, language_id, license_scan, lm_score, mixing, registry, sharding, suffix_dedup, token_counts
from tests import oracle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "one two three four five six seven eight nine ten " * 40
ROWS = [
    (1, None, None, None, 0), (2, "", "en", "s", 0), (3, " \n\t", "en", "s", 0), (None, LONG, "en", None, 1), (5, LONG, "en", "s", 1), (5, LONG, "en", "s", 1),
    (6, "a" * 3000, "de", "t", 2), (7, "kurz", "de", "t", 2), (8, LONG + " Under the MIT license, CC BY-NC; Apache License Version 2.0 <|endoftext|> x", "de", "t", 3), (9, "\x01 12 345.6 é", None, "u", 4),
    (10, " ".join(f"w{i}" for i in range(20000)), "fr", "t", 5),
]
#: Columns whose names clash with the operators' own.
EXTRA = ["size", "shard", "did", "th", "no", "score", "row", "block", "n"]


def awkward(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    for c in EXTRA[1:]:
        df = df.withColumn(c, F.lit("x"))
    return df


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["sf", "awkward"])
def docs(request, spark, sf):
    return common.documents(spark, sf) if request.param == "sf" else awkward(spark).drop("row")


def test_suffix_dedup(docs):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_passages(docs).collect())
    raw = [(i, t.encode()) for i, t in texts(docs)]
    seen = Counter(b[p : p + 200] for _, b in raw for p in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i or -1, len(b), int(gone.sum()), len(suffix_dedup._true_runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_suffix_dedup_cuts_crowded_hashes_alike(spark, sf):
    docs = common.documents(spark, sf)
    pick = lambda n: sorted((r.doc_id, r.kept_sha256) for r in suffix_dedup.dedup_passages(docs, crowd=n).collect())
    assert pick(1) == pick(1500)


@pytest.mark.parametrize("length", [8, 20, 27])
def test_family_of_suffix_arrays(length):
    rng = np.random.default_rng(1)
    segs = [bytes(rng.integers(97, 100, int(rng.integers(length, 90))).astype(np.uint8)) for _ in range(60)]
    segs += [segs[3][5:] + segs[4], segs[7], b"a" * 80, b"b" * (length - 1) + b"a" * 60 + b"\0" * 40]
    segs = [s for s in segs if len(s) >= length]
    count = Counter(s[i : i + length] for s in segs for i in range(len(s) - length + 1))
    for batch in (100, 1 << 15):
        got = suffix_dedup._group(segs, length, batch)
        assert [m.tolist() for m in got] == [[count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in segs]


def test_suffix_arrays_are_sorted_and_levels_grow_geometrically():
    rng = np.random.default_rng(2)
    f, rep, texts = suffix_dedup.Family(12), np.zeros(4000, bool), []
    for lo in range(0, 4000, 100):
        texts.append(rng.integers(97, 99, 111).astype(np.uint8))
        f.add(texts[-1], np.arange(100), np.arange(lo, lo + 100), rep)
    assert len(f.levels) <= 8
    for level in f.levels:
        found = [level.text[p : p + 12].tobytes() for p in level.order]
        assert found == sorted(set(found))


def test_license_scan(docs):
    got = sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word if r.first_word is not None else -1, r.last_word if r.last_word is not None else -1, r.base_labels) for r in license_scan.scan_licenses(docs).collect())
    want = []
    for i, t in texts(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        at, labels = [], set()
        for label, phrase in license_scan.BASE:
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want.append((i or -1, len(w), len(at), min(at, default=-1), max(at, default=-1), ",".join(sorted(labels))))
    assert got == sorted(want)


def test_license_rules_rank_and_suppress(spark):
    t = ["SPDX-License-Identifier: GPL-2.0-or-later", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "plain words", "CC BY-NC-SA 4.0 applies; the public domain is not of the public domain"]
    got = [r.labels for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:4] == ["gpl-2.0", "gpl-3.0", "apache-2,apache-2.0", ""] and "cc-by-nc-sa" in got[4].split(",") and "public-domain" in got[4].split(",")
    assert len(license_scan.rules()) > 200


def test_license_rules_suppression_by_brute_force(spark):
    def names(w):
        found = [(m.start(1), m.end(1), p, i, label) for i, (label, p, k, x) in enumerate(license_scan.rules()) if k in w for m in re.finditer(f"(?<= )({x})(?= )", w)]
        key = lambda d: (d[0], -d[1], -d[2], d[3])
        return {d[4] for d in found if d[2] == 5 or not any(o is not d and key(o) < key(d) and o[1] >= d[1] and o[2] >= d[2] for o in found)}

    t = ["Licensed under the MIT License and the BSD 3 Clause License", "gnu lesser general public license version 2.1, mpl 2.0, cc by sa 3.0 license", "released under the creative commons attribution share alike 4.0 license"]
    got = [r.labels for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    norm = [" " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", x.translate(LOWER)).strip() + " " for x in t]
    assert got == [",".join(sorted(names(w))) for w in norm]


def _phrases(parsed, rng, first):
    """A string that the parsed expression matches: the first choices, or random ones."""
    from re import _constants as c

    out = ""
    for op, arg in parsed:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.IN:
            chars = [chr(x) for o, a in arg for x in ([a] if o is c.LITERAL else range(a[0], a[1] + 1))]
            out += chars[0] if first else rng.choice(chars)
        elif op is c.BRANCH:
            out += _phrases(arg[1][0] if first else rng.choice(arg[1]), rng, first)
        elif op is c.SUBPATTERN:
            out += _phrases(arg[3], rng, first)
        else:
            out += _phrases(arg[2], rng, first) if not first and rng.random() < 0.5 else ""
    return out


def test_license_rules_find_their_own_phrase(spark):
    import random
    from re import _parser

    rng, rules = random.Random(7), license_scan.rules()
    texts = sorted({_phrases(_parser.parse(x), rng, i == 0) for _, _, _, x in rules for i in range(3)})
    texts += ["Released under Apache 2.0", "available under Mozilla Public 2.0", "Creative Commons Attribution 4.0", "Proprietary and confidential", "MIT X11", "PSF", "ICU", "GFDL"]
    found = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "score", "labels").collect()
    got = {texts[r.doc_id]: (r.score, r.labels) for r in found}
    for t in texts:
        w = " " + re.sub(r"[^a-z0-9]+", " ", t.lower()).strip() + " "
        ungated = [r for r in rules if re.search(f"(?<= )({r[3]})(?= )", w) and (r[3] not in license_scan.UNSURE or any(x in w for x in license_scan.UNSURE[r[3]]))]
        assert got[t][0] == max((license_scan.CONFIDENCE[r[1]] for r in ungated), default=0.0), t
        assert set(got[t][1].split(",")) - {""} <= {r[0] for r in ungated} and bool(got[t][1]) == bool(ungated), t
    # a German preposition is no license
    assert [r.labels for r in license_scan.scan_licenses(spark.createDataFrame([(1, "Wir fahren mit dem Zug."), (2, "MIT, copyright 2020")], "doc_id long, text string")).orderBy("doc_id").collect()] == ["", "mit"]


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = token_counts.default_path()
    lib = Tokenizer.from_file(path)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect())
    want = [(i or -1, len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts(docs)]
    assert got == sorted(want)


def test_whole_tokens_are_proved():
    whole, tok, _ = token_counts.prove_whole_tokens(token_counts.default_path())
    assert len(whole) > 40_000 and all(len(tok.encode(s, add_special_tokens=False).ids) == 1 for s in list(whole)[:500])


def test_language_id(spark, sf):
    df = common.documents(spark, sf)
    model = language_id.fit(df)
    got = language_id.predict(df, model).withColumn("held_out", language_id.is_held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd = {(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in language_id.predict(awkward(spark), model).collect()}
    assert (1, "und", True) in odd and (2, "und", True) in odd and (3, "und", True) in odd and not any(k == 7 and lang == "und" for k, lang, _ in odd)
    assert language_id.predict(awkward(spark, []), language_id.fit(awkward(spark, []))).count() == 0


def test_network_gradients():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_id.initial(3, 4).items()}
    x, mask, y = r.integers(0, 257, (6, 5)), np.ones((6, 5), bool), r.integers(0, 3, 5)
    _, g = language_id.gradients(w, x, mask, y)
    for k, at in (("u", (0, 1, 2)), ("u", (1, 2, 9)), ("o", (3, 1)), ("b", (2,)), ("e", (int(x[2, 1]), 0, 5))):
        e = 1e-3
        w[k][at] += e
        up, _ = language_id.gradients(w, x, mask, y)
        w[k][at] -= 2 * e
        down, _ = language_id.gradients(w, x, mask, y)
        w[k][at] += e
        assert (up - down) / (2 * e) == pytest.approx(g[k][at], abs=2e-4)


def test_kd_search(spark, sf):
    oracle.same(spark, oracle.connect(sf), kd_search.op6_kd_search, kd_search.OP6_SQL, sf)
    rows = [(i, [float((i * 7 + j * j) % 5) / 4 for j in range(3)]) for i in range(300)] + [(50, [0.5, 0.5, 0.5]), (301, None), (302, [1.0, None, 0.0]), (303, [float("nan"), 0.0, 0.0]), (304, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (100, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("kth", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in kd_search.top_k(v, shard_rows=64, block_rows=2).collect())
    good = [(i, [math.floor(256 * c) for c in x]) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        x = min(v for i, v in good if i == q)
        s = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in good if i != q and len(v) == len(x))[:5]
        want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    assert got == sorted(want)
    assert kd_search.top_k(v.where("false")).count() == 0


def targets_of(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_w = sum(w[s] for s in w if s not in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / open_w for s in w}
        new = {s for s in w if s not in full and t[s] > cap * sizes[s]}
        if not new:
            return t
        full |= new


def test_mixing(docs):
    src = docs.select("doc_id", "source", "text")
    got, again = mixing.mix(src).collect(), mixing.mix(src).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = defaultdict(int)
    for r in src.collect():
        sizes[r.source] += len(WS.findall(r.text or ""))
    want, taken = targets_of(sizes), defaultdict(int)
    assert len(got) == src.count()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    total = sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= max(64, 0.002 * total) for s in sizes)


def test_mixing_gives_tiny_sources_their_target(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, "huge", words(20_000)) for i in range(40)] + [(100 + i, f"tiny{i}", words(3 + i)) for i in range(6)] + [(200 + i, "tiny9", words(7)) for i in range(5)]
    got, taken, target = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect(), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        target[(r.source)] = r.target
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(taken[s] == round(target[s]) for s in target)


def test_mixing_of_nothing(spark):
    assert mixing.mix(awkward(spark, []).drop("row")).count() == 0
    got = mixing.mix(awkward(spark, ROWS[:3]).drop("row")).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0)] * 3


def test_jaccard_join(docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard_join.link_components(docs).collect())
    sets = []
    for i, t in texts(docs):
        w = WS.findall(t.translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    par = list(range(len(sets)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                par[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        ids[find(k)].append(i)
    want = []
    for k, (i, s) in enumerate(sets):
        own = [x for x in ids[find(k)] if x is not None]
        want.append((i if i is not None else -1, len(s), min(own) if own else -1))
    assert got == sorted(want)


def test_jaccard_join_finds_every_link_of_mutated_texts(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(12):
        size = int(rng.integers(5, 260))
        base = [f"g{g}w{k}" for k in range(size)]
        for _ in range(8):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 25)))):
                w[int(rng.integers(0, size))] = f"x{rng.integers(1e9)}"
            rows.append((n, " ".join(w)))
            n += 1
    test_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))


def test_jaccard_join_one_large_group_in_many_components(spark, monkeypatch):
    """Texts that all share most of their shingles, some linked and some not, compared in several chunks of a group."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    rng = np.random.default_rng(5)
    base, rows = [f"b{k}" for k in range(120)], []
    for n in range(90):
        w = list(base)
        for k in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, 120))] = f"x{rng.integers(40)}"
        rows.append((n, " ".join(w)))
    test_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))


def test_components(spark):
    e = spark.createDataFrame([(9, 8), (8, 7), (3, 7), (20, 21), (5, 5), (22, 21), (7, 3)], "a long, b long")
    assert {r.node: r.component for r in common.components(e).collect()} == {3: 3, 7: 3, 8: 3, 9: 3, 20: 20, 21: 20, 22: 20}


def test_components_take_few_shuffles_and_tasks(spark):
    """A round is three shuffles and a sum; every shuffle leaves files for each of its tasks."""
    e = common.checkpointed(spark.range(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    ids = spark.sparkContext._jsc.sc()
    before = ids.newShuffleId()
    got = common.components(e).collect()
    assert {(r.node, r.component) for r in got} == {(n, 0) for n in range(65)}
    assert ids.newShuffleId() - before < 25
    assert common.components(e.where("a < 0")).collect() == []


def test_decontaminate(spark, sf):
    docs, bench = common.documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.did, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert got == {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}


def test_decontaminate_names_that_begin_sentences(spark):
    items = ["Janet has 3 apples. Janet buys 4 pears. Janet gives 2 plums away.", "New York has 3 old bridges and 7 wide parks. New York needs 2 more bridges soon."]
    texts = ["Carla has 5 apples. Carla buys 6 pears. Carla gives 9 plums away.", "Paris has 8 old bridges and 9 wide parks. Paris needs 4 more bridges soon.", "Carla has 5 apples. Dora buys 6 pears. Edna gives 9 plums away.", "Carla sees 5 dogs. Carla walks 6 miles. Carla knows 9 towns there."]
    docs, bench = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for k, x in (("doc_id", texts), ("item_id", items)))
    got = {(r.did, r.item_id): r.coverage for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0}


def test_decontaminate_templates_and_slots(spark):
    item = "Anna buys 3 apples and 12 pears for 7 dollars today in the old shop. Then Anna pays Bob and walks home."
    other = item.replace("Anna", "Carl").replace("Bob", "Dora").replace("12 pears", "90 pears")
    broken = "So Eve buys 3 apples and 12 pears for 7 dollars today in the old shop. Then Carl pays Bob and walks home."
    docs = spark.createDataFrame([(1, item), (2, other), (3, "nothing of the kind is told here at all, not one word of it"), (4, None), (5, ""), (None, item), (6, broken)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, None), (2, "too short")], "item_id long, text string")
    got = {r.did: (r.coverage, r.slots_changed) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[1] == (1.0, 0) and got[2][0] >= 0.5 and got[2][1] >= 2 and common.NULL_ID in got and not got.keys() & {3, 4, 5}
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_decontaminate_short_items(spark):
    items = [(0, "What is 3 plus 4?"), (1, "Yes."), (2, "..."), (3, None), (None, "Name the last king")]
    texts = ["first\nwhat is 3 plus 4\nlast", "What is 5 plus 4?", "yes", "Yes.\nno", "He asked what is 3 plus 4 and left.", "Name  the LAST king!", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (7, "x\n" * 5000 + "What is 3 plus 4?")], "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("key", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = sorted((r.did, r.item_id, r.coverage) for r in decontaminate.contaminated(docs, bench).collect() if r.item_id is not None)
    assert got == [(0, 0, 1.0), (2, 1, 1.0), (7, 0, 1.0)]
    assert {r.did for r in decontaminate.contaminated(docs, bench).collect() if r.item_id is None} == {5}


def test_lm_score(docs):
    got = lm_score.score(docs).collect()
    toks = [(i, WS.findall(t.translate(LOWER)) + [None], i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, t in texts(docs)]
    c = Counter(t for _, w, held in toks if not held for t in w)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, held, len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 4)) for i, w, held in toks)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_blocks_follow_the_bytes(docs):
    part = sum(len((t or "").encode()) for _, t in texts(docs)) // 11
    assert lm_score.block_count(docs, 1 << 40) == common.partitions(docs.sparkSession) < lm_score.block_count(docs, part) <= 12
    one, many = ({(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score(docs, block_bytes=b).collect()} for b in (1 << 40, part))
    assert one == many


def test_lm_softmax_within_classes_sums_to_one_and_heeds_context():
    rng = np.random.default_rng(0)
    count, kind = rng.integers(0, 50, 400), rng.integers(0, lm_score.KINDS, 400)
    mass = np.log(np.bincount(kind, count + lm_score.ALPHA, lm_score.KINDS)).astype(np.float32)
    w = rng.normal(0, 1, (lm_score.INSIDE, lm_score.KINDS)).astype(np.float32)
    f = np.array([[13, 77, 99]])
    own = np.log(count + lm_score.ALPHA) + w[f[0]].sum(0)[kind]
    want = np.exp(own) / np.exp(own).sum()
    got = (count + lm_score.ALPHA) * np.exp(-mass[kind].astype(float)) * lm_score.kind_probabilities(w, f, mass[None])[0, kind]
    assert got == pytest.approx(want, rel=1e-4) and got.sum() == pytest.approx(1, abs=1e-4)
    # a step makes the words of the seen kind likelier after this context
    f, k, m = np.tile([13, 77, 99], (64, 1)), np.full(64, 3), np.tile(mass, (64, 1))
    before = lm_score.kind_probabilities(w, f, m)[0, 3]
    lm_score.sgd(w, np.zeros(lm_score.INSIDE, np.float32), f, k, m)
    assert lm_score.kind_probabilities(w, f, m)[0, 3] > before


def test_lm_word_in_its_class_depends_on_the_word_before(spark):
    """Words of one class with equal counts: after a, always one ending in x; after b, always one ending in y."""
    pairs = [(i, " ".join(["a zqx", "b zqy"][j % 2] for j in range(40)) + " " + " ".join(f"f{i % 7}{n}" for n in range(12))) for i in range(300)]
    frequent = " ".join(f"top{n} " * 60 for n in range(lm_score.TOP))
    docs = spark.createDataFrame([*((i, t + " " + frequent) for i, t in pairs), (9001, "a zqx"), (9002, "a zqy")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(docs).where("doc_id > 9000").collect()}
    assert got[9001] > got[9002] + 0.05


def test_lm_step_is_the_plain_gradient():
    rng = np.random.default_rng(3)
    f = np.stack([np.zeros(500, int), rng.integers(1, 33, 500), rng.integers(33, 65, 500), *rng.integers(65, 90, (3, 500))], 1)
    k, w = rng.integers(0, lm_score.CLASSES, 500), rng.normal(0, 1, (100, lm_score.CLASSES)).astype(np.float32)
    g = np.exp(w[f].sum(1).astype(float))
    g = g / g.sum(1, keepdims=True) - np.eye(lm_score.CLASSES)[k]
    grad = np.zeros(w.shape)
    for j in range(6):
        np.add.at(grad, f[:, j], g / 500)
    want = w - lm_score.RATE * grad / np.sqrt((grad * grad).sum(1) + 1e-8)[:, None]
    lm_score.sgd(w, np.zeros(100, np.float32), f, k)
    assert w == pytest.approx(want, abs=1e-4)


def test_lm_scoring_reads_the_tokens_once(monkeypatch):
    docs = pa.table({"doc_id": [1, 2, 3], "text": pa.array([b"a b a", b"", b"c b"], pa.binary()), "held_out": [False, True, False], "block": pa.array([0, 0, 0], pa.int32())})
    u, c, _ = lm_score._distinct(docs)
    out, read, tokens_of = io.BytesIO(), [], lm_score.tokens_of
    np.savez(out, w=np.zeros((lm_score.ALL_ROWS, lm_score.CLASSES), np.float32), top=np.empty(0, np.uint64), mass=np.zeros((lm_score.GROUPS, lm_score.KINDS), np.float32), total=c.sum(), kinds=len(u))
    monkeypatch.setattr(lm_score, "tokens_of", lambda b: read.append(b.num_rows) or tokens_of(b))
    got = lm_score._scored(out.getvalue())(docs, pa.table({"bucket": pa.array([0], pa.int32()), "counts": pa.array([c.tobytes()], pa.binary())}))
    assert got.column("n_tokens").to_pylist() == [4, 1, 3] and got.column("n_known").to_pylist() == [4, 1, 3] and sum(read) == 3


def test_lm_beats_its_base(spark, sf):
    held = [r for r in lm_score.score(common.documents(spark, sf)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_sharding(docs):
    got = sharding.shard_rows(docs, shards=4).collect()
    assert len(got) == docs.count() and sorted(x for x in docs.columns if x not in ("size", "shard")) == sorted(x for x in got[0].asDict() if x not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    by = defaultdict(list)
    for r in got:
        assert r.size == 16 + len((r.text or "").encode()) and r.text_crc32 == (None if r.text is None else zlib.crc32(r.text.encode())) and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(4))
    load = [sum(r.size for r in by[s]) for s in range(4)]
    assert max(load) - min(load) <= max(r.size for r in got)


@pytest.mark.parametrize("fn", [
    lambda d: suffix_dedup.dedup_passages(d), lambda d: license_scan.scan_licenses(d), lambda d: token_counts.count_tokens(d, token_counts.default_path()), lambda d: jaccard_join.link_components(d), lambda d: lm_score.score(d), lambda d: sharding.shard_rows(d),
])
def test_empty_tables(spark, fn):
    assert fn(awkward(spark, []).drop("row")).count() == 0


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)


def test_sharding_cuts_a_crowd_of_equal_rows(spark):
    rows = [(None, "same " * 20)] * 400 + [(7, "again " * 20)] * 400 + [(i, f"text {i} " * 10) for i in range(400)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, carry_text=False)
    assert got.count() == len(rows) and "text" not in got.columns
    load = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 4 and max(load) - min(load) <= 0.02 * sum(load) / 4


def test_packing_keeps_bytes_tokens_and_rows_even():
    r = np.random.default_rng(1)
    v = np.stack([r.integers(50, 4000, 2000), r.integers(5, 700, 2000), r.integers(1, 5, 2000)], 1).astype(float)
    at = sharding.place(v, 8)
    for k, off in ((0, 2e-4), (1, 0.05), (2, 0.05)):
        load = np.bincount(at, v[:, k], 8)
        assert load.max() - load.min() <= off * load.mean(), k


def test_kd_search_broadcasts_no_binaries(spark, capfd):
    v = spark.range(2000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.sin(F.col("id") * j)).alias("embedding"))
    out = kd_search.top_k(v, shard_rows=100, block_rows=4)
    out.count()
    out.explain()
    plan = capfd.readouterr().out
    assert "FlatMapCoGroupsInPandas" in plan and "Broadcast" not in plan
    # trees and blocks of one size, whatever the number of rows
    assert {(r.query_id, r.rank): r.vec_id for r in out.collect()} == {(r.query_id, r.rank): r.vec_id for r in kd_search.top_k(v).collect()}


def test_kd_search_beyond_double(spark):
    rows = [(i, [1e6 + i * 0.25, -1e6 + (i * 7 % 5), float(i)]) for i in range(60)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in kd_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=16).collect())
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(x[q], x[i], strict=True)), i) for i in x if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert max(abs(w[3]) for w in want) > 2**53 and got == want


def test_language_sample_learns_every_language_from_all_of_a_text(spark):
    rows = [(8 * i + j, " " * 4000 + f"{chr(97 + j % 26)}{chr(97 + j // 26)} " * 400, f"l{j:02}") for i in range(2) for j in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    train = language_id.train
    try:
        language_id.train = lambda texts, langs: seen.append((texts, langs))
        language_id.fit(docs)
    finally:
        language_id.train = train
    texts, langs = seen[0]
    kept = {r.lang for r in docs.where(~language_id.is_held_out(F.col("doc_id"))).collect()}
    assert set(langs) == kept and len(kept) > 64 and all(len(t) == 1024 and t.strip() for t in texts)
