"""Benchmark decontamination by template windows, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other figures or people keeps its template.
Windows of WINDOW template tokens are hashed and joined; matches are told from chance by the share of an item's windows
found on one diagonal, and by slots: what stands for a placeholder must map one item value to one document value.

Whether a capitalised word that begins a sentence is a name can't be told from the text. So a text has two readings, made
from one marking of it: in the plain reading such a word is itself; in the open reading it is a name too, and a run of
names is one placeholder that its last word stands for. Any reading of a document may meet any of an item; the reading of
the item with most coverage counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import NULL_ID, bound, checkpointed, doc_key

WINDOW = 8
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Items of fewer than WINDOW tokens are found verbatim, as a line of this many tokens at least or as a whole text.
LINE = 3
#: Benchmark windows up to this many are broadcast (16 bytes a window and the slots); more are shuffled.
BROADCAST_WINDOWS = 200_000
#: A fixed-size filter of 2**FILTER_BITS bits over the benchmark's pairs of neighbouring tokens; a document window
#: whose first, last or a middle pair isn't in it is not hashed.
FILTER_BITS = 20
#: Capitalised words, those after NAME's blank inside a sentence, and names before another name.
CAPITAL = r"(?=\p{Lu})(?<![\p{L}\p{M}\p{N}_])"
NAME = r"\x01q(?<=[^.!?:;\n\s] \x01q)"
EARLIER = r"\x01([pq][\p{L}\p{M}\p{N}_]+ +)(?=\x01[pq])"
#: a-z first: most characters are settled there.
BETWEEN = r"[^a-z\p{L}\p{M}\p{N}\x01_]+"
#: Units after a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "ounce", "ounces", "pound", "pounds", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "gram", "grams", "kilogram", "kilograms", "liter", "liters", "litre", "litres", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degrees",
)


def marked(text: Column) -> Column:
    """The lower-cased text with \\x01p before names inside a sentence, \\x01q before capitalised words that begin one,
    \\x01rp and \\x01rq instead where another such word follows, \\x01n before numbers and \\x01u before units after one."""
    names = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x01"), F.lit(" ")), CAPITAL, "\x01q")
    names = F.regexp_replace(F.regexp_replace(names, NAME, "\x01p"), EARLIER, "\x01r$1")
    with_numbers = lambda m: F.when(F.rlike(m, F.lit(r"\p{N}")), _numbered(m)).otherwise(m)
    return F.lower(bound(names, with_numbers))


def _numbered(m: Column) -> Column:
    joined = F.regexp_replace(m, r"[.,:/](?=\p{N})(?<=\p{N}[.,:/])", "_")
    numbers = F.regexp_replace(joined, r"\p{N}[\p{N}_]*", " \x01n$0 ")
    return F.regexp_replace(numbers, r"(?i)(\x01n[\p{N}_]+\s+)(" + "|".join(UNITS) + r")(?![\p{L}\p{M}\p{N}])", "$1\x01u$2")


def coded(x: Column, openly: bool) -> Column:
    """A marked token as its reading has it: a placeholder, or itself."""
    if openly:
        named = F.when(x.startswith("\x01q"), F.lit("\x01p"))
    else:
        named = F.when(x.startswith("\x01q"), F.substring(x, 3, 2**30)).when(x.startswith("\x01rq"), F.substring(x, 4, 2**30)).when(x.startswith("\x01r"), F.lit("\x01p"))
    return F.when(x.startswith("\x01"), named.otherwise(F.substring(x, 1, 2))).otherwise(x)


def slot(x: Column, openly: bool) -> Column:
    """What stands for the placeholder of a marked token; empty for a literal one."""
    if openly:
        return F.when(x.startswith("\x01"), F.substring(x, 3, 2**30)).otherwise(F.lit(""))
    named = F.when(x.startswith("\x01q") | x.startswith("\x01rq"), F.lit("")).when(x.startswith("\x01r"), F.substring(x, 4, 2**30))
    return F.when(x.startswith("\x01"), named.otherwise(F.substring(x, 3, 2**30))).otherwise(F.lit(""))


def _low(a: Column, b: Column) -> Column:
    """The filter bit of two neighbouring tokens' codes, each below 2**FILTER_BITS."""
    return (a * 31 + b).bitwiseAND(F.lit(2**FILTER_BITS - 1))


def tokens(m: Column) -> Column:
    return F.array_remove(F.split(m, BETWEEN), "")


def _reading(t: Column, n: int, bits: Column | None, openly: bool) -> Column:
    """The windows of one reading of the marked tokens t: h (hash), pos (from 0), s (its slots' values), open (0 or 1).
    With bits, only windows whose pairs of tokens may all be in the filter; without, b too, the filter bits of all pairs."""
    own = F.filter(t, lambda x: ~x.startswith("\x01r")) if openly else t

    def picked(t: Column, h: Column) -> Column:
        if bits is None:
            at = F.when(F.size(h) >= n, F.sequence(F.lit(1), F.size(h) - (n - 1))).otherwise(F.array().cast("array<int>"))
        else:
            inside = lambda p: F.getbit(F.element_at(bits, F.shiftright(p, 6) + 1), p.bitwiseAND(F.lit(63))) == 1
            at = bound(F.transform(h, lambda a, i: F.when(inside(_low(a, F.get(h, i + 1))), i + 1).otherwise(-1)), among)
        pairs = lambda i: [] if bits is not None else [F.zip_with(F.slice(h, i, n - 1), F.slice(h, i + 1, n - 1), _low).alias("b")]
        return F.transform(at, lambda i: bound(F.slice(t, i, n), lambda w: F.struct(
            F.xxhash64(F.transform(w, lambda x: coded(x, openly))).alias("h"), (i - 1).alias("pos"), *pairs(i),
            F.array_join(F.transform(w, lambda x: slot(x, openly)), "\x02").alias("s"), F.lit(int(openly)).alias("open"),
        )))

    def among(o: Column) -> Column:
        """The windows whose first, last and a middle pair are in the filter; o: each pair's place (from 1), or -1."""
        return F.filter(F.array_remove(o, -1), lambda i: (F.get(o, i + (n - 3)) != -1) & (F.get(o, i + (n // 2 - 2)) != -1))

    codes = lambda t: F.transform(t, lambda x: F.hash(coded(x, openly)).bitwiseAND(F.lit(2**FILTER_BITS - 1)))
    return bound(own, lambda t: bound(codes(t), lambda h: picked(t, h)))


def readings(df: DataFrame, n: int = WINDOW, bits: Column | None = None) -> DataFrame:
    """df without text, one row for each window of either reading."""
    both = lambda t: F.concat(_reading(t, n, bits, False), _reading(t, n, bits, True))
    found = bound(tokens(marked(F.col("text"))), lambda t: F.when(F.size(t) >= n, both(t)))
    keep = [c for c in df.columns if c != "text"]
    # explode would make the optimiser add a filter on found, which reads each text once more
    return df.select(*keep, F.explode_outer(found).alias("_w")).select(*keep, "_w.*").where("h is not null")


def filter_bits(pairs: list[int]) -> Column:
    """The filter over the bits in pairs, as one constant array of longs."""
    words = [0] * (2**FILTER_BITS // 64)
    for p in pairs:
        words[p >> 6] |= 1 << (p & 63)
    return F.split(F.lit(",".join(str(w - 2**64 if w >= 2**63 else w) for w in words)), ",").cast("array<bigint>")


def verbatim(docs: DataFrame, short: DataFrame, n: int, small: bool) -> DataFrame:
    """did, th, item_id of the documents that hold one of the short items (item_id, key) as a line of LINE tokens or more,
    or as the whole text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.size(_plain(x)) >= LINE)
    own = docs.select(*doc_key(docs), F.explode_outer(F.array_union(lines, F.array("text"))).alias("x")).select("did", "th", F.xxhash64(_plain(F.col("x"))).alias("key"))
    return own.join(F.broadcast(short) if small else short, "key").select("did", "th", "item_id").distinct()


def _plain(text: Column) -> Column:
    return tokens(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\x01"), F.lit(" "))))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """did, th, item_id, item_windows, matched, coverage, slots_changed: documents that hold a benchmark item.

    Windows count once for each place in the item. Slots of a diagonal (one placing of the item in the document) are
    consistent if no item value stands for two document values. Items of fewer than n template tokens can't be told from
    chance by templates: they match the texts that hold their very tokens, figures and names too, as a line of LINE tokens
    or more or as the whole text, with one window and coverage 1; items without tokens match nothing; null texts have no tokens; repeated rows of one doc_id and text count as one; null doc_ids
    are identified by their text (did is NULL_ID; the query gives null); null item_ids are kept as an item of their own; other columns are ignored.
    """
    items = benchmark.select(F.coalesce("item_id", F.lit(-1)).alias("item_id"), "text").distinct()
    short = checkpointed(items.where(F.size(tokens(marked(F.col("text")))) < n).where(F.size(_plain(F.col("text"))) > 0).select("item_id", F.xxhash64(_plain(F.col("text"))).alias("key")))
    n_short = short.limit(BROADCAST_WINDOWS + 1).count()
    bench = readings(items, n)
    bench = bench.select("item_id", "h", F.col("pos").alias("bpos"), F.col("s").alias("bs"), "b", F.col("open").alias("bopen"))
    bench = checkpointed(bench)
    bits = filter_bits([r.b for r in bench.select(F.explode("b").alias("b")).distinct().collect()])  # 2**FILTER_BITS values at most
    bench = bench.drop("b")
    small = bench.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    sizes = bench.groupBy("item_id", "bopen").agg(F.countDistinct("bpos").alias("item_windows"))
    own = readings(docs.select(*doc_key(docs), "text"), n, bits)
    hits = own.join(F.broadcast(bench) if small else bench, "h").withColumn("diag", F.col("pos") - F.col("bpos"))
    # (item value, document value) of each slot; both sides have the same placeholders at the same places
    pairs = F.filter(F.arrays_zip(F.split("bs", "\x02").alias("b"), F.split("s", "\x02").alias("d")), lambda x: x["b"] != "")
    diag = hits.select("did", "th", "item_id", "bopen", "open", "diag", "bpos", pairs.alias("p")).groupBy("did", "th", "item_id", "bopen", "open", "diag").agg(
        F.collect_set("bpos").alias("at"), F.array_distinct(F.flatten(F.collect_set("p"))).alias("p")
    )
    names = F.array_distinct(F.transform("p", lambda x: x["b"]))
    diag = diag.withColumn("consistent", F.size("p") == F.size(names)).withColumn("changed", F.size(F.filter("p", lambda x: x["b"] != x["d"])))
    found = diag.where("consistent").groupBy("did", "th", "item_id", "bopen").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched"), F.coalesce(F.min(F.when(F.col("open") == F.col("bopen"), F.col("changed"))), F.min("changed")).cast("long").alias("slots_changed"))
    found = found.join(sizes, ["item_id", "bopen"]).withColumn("coverage", F.round(F.col("matched") / F.col("item_windows"), 6)).where(F.col("coverage") >= coverage)
    best = F.max(F.struct("coverage", (-F.col("bopen")).alias("plain"), F.col("item_windows").cast("long").alias("item_windows"), "matched", "slots_changed")).alias("b")
    found = found.groupBy("did", "th", "item_id").agg(best).select("did", "th", "item_id", "b.item_windows", "b.matched", "b.coverage", "b.slots_changed")
    if n_short:
        one = F.lit(1).cast("long")
        exact = verbatim(docs, short, n, n_short <= BROADCAST_WINDOWS)
        found = found.unionByName(exact.select("did", "th", "item_id", one.alias("item_windows"), one.alias("matched"), F.lit(1.0).alias("coverage"), (one - 1).alias("slots_changed")))
    return found.select(
        "did", "th", F.when(F.col("item_id") >= 0, F.col("item_id")).alias("item_id"), "item_windows", "matched", "coverage", "slots_changed"
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document that holds an item of the benchmark, with the item."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = contaminated(docs, bench)
    return got.select(F.nullif("did", F.lit(NULL_ID)).alias("doc_id"), "item_id", "item_windows", "matched", "coverage", "slots_changed")
