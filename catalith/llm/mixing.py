"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash, are one long row of words cut into equal blocks. A schedule of 2**k
slots takes the van der Corput point of each slot and maps it through the cumulative target weights to a source;
the slots of a source are ranked, and rank r takes block r modulo the number of blocks. Joining the schedule with
the blocks tells how many words of each document the mix takes. A slot that a border between sources cuts gives each
its part: what a source's whole slots leave of its target is taken word by word after its last block, so that every
source, however small, takes its target to the word. Plain DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import checkpointed, count_words

WEIGHTS = (5, 2, 1)
CAP = 3
#: The schedule has 2**k slots, about SLOT_WORDS words each, with k within BITS.
SLOT_WORDS, BITS = 64, (12, 20)
#: Documents of a source whose prefix sums one task makes.
RUN_ROWS = 2000


def word_count(text: Column) -> Column:
    return count_words(text)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, no (by code point, null last), source_size, target of each source of sizes (source, size).

    Targets share all words by weight; a source above cap times its own size stops there and the excess is shared anew
    by weight. That is water-filling: sources sorted by how soon they fill (size / weight) fill one after another, so one
    ordered pass finds who is full and what the rest gets for each unit of weight. There is one row for each source.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a bounded table of sources: a window over all of it
    no = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("no"), F.lit(len(weights))) + 1).cast("int"))
    src = one.withColumn("no", no).withColumn("w", w)
    every = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), "no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumns({
        "all": F.sum("source_size").over(every).cast("double"),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "full_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * cap,
    })
    # the share of a unit of weight if all that fill sooner are full; a source is full if that exceeds its cap
    src = src.withColumn("unit", (F.col("all") - F.col("full_before")) / F.col("w_left")).withColumn("full", F.col("unit") * F.col("w") > cap * F.col("source_size"))
    src = src.withColumn("open_unit", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), "no", "unit"))).over(every)["unit"])
    target = F.when(F.col("full"), F.col("source_size").cast("double") * cap).otherwise(F.col("open_unit") * F.col("w"))
    return src.select("source", F.col("no").cast("long").alias("no"), "source_size", target.alias("target"))


def _bits(total: Column) -> Column:
    k = F.ceil(F.log2(F.greatest(total / SLOT_WORDS, F.lit(2.0)))).cast("int")
    return F.greatest(F.lit(BITS[0]), F.least(F.lit(BITS[1]), k))


def stretches(targets: DataFrame) -> DataFrame:
    """targets with k, slots (2**k) and the whole cells from (inclusive) to to (exclusive) of each source's stretch."""
    every = Window.partitionBy(F.lit(0))
    t = targets.withColumn("k", _bits(F.sum("target").over(every))).withColumn("slots", F.pow(F.lit(2.0), "k"))
    share, total = F.sum("target").over(every.orderBy("no")), F.sum("target").over(every)
    t = t.withColumns({"from": F.ceil((share - F.col("target")) / total * F.col("slots")).cast("long"), "to": F.floor(share / total * F.col("slots")).cast("long")})
    return t.withColumn("to", F.greatest("from", "to"))


def schedule(targets: DataFrame) -> DataFrame:
    """no, slot, rank: the source of each slot that lies whole in one source's stretch and the slot's rank within it.

    Slot i has the van der Corput point of i. With 2**k slots these points are the cells j / 2**k, each once, so the
    cells of a source's stretch of cumulative weights, with their bits reversed, are its slots.
    """
    cells = stretches(targets).where("target > 0 and to > from").select("no", "k", F.explode(F.sequence("from", F.col("to") - 1)).alias("cell"))
    slot = F.conv(F.reverse(F.lpad(F.bin("cell"), F.col("k"), F.lit("0"))), 2, 10).cast("long")
    return cells.withColumn("slot", slot).select("no", "slot", (F.row_number().over(Window.partitionBy("no").orderBy("slot")) - 1).cast("long").alias("rank"))


def shuffled(sized: DataFrame, targets: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """sized with no and the columns at: words of its source before it, in the order of a hash.

    Prefix sums in two levels: a source's hash range is cut into runs of about run_rows rows, so a hot source is spread.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, 15), 16, 10).cast("long")
    own = targets.select(F.col("source").alias("_source"), "no")
    t = sized.withColumn("h", key).join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    counts = t.groupBy("no").agg(F.count("*").alias("n")).withColumn("step", F.greatest(F.lit(1).cast("long"), (F.pow(F.lit(2.0), F.lit(60.0)) / F.ceil(F.col("n") / run_rows)).cast("long")))
    t = t.join(counts.select("no", "step"), "no").withColumn("run", F.floor(F.col("h") / F.col("step")).cast("long"))
    sums = t.groupBy("no", "run").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0)))
    within = Window.partitionBy("no", "run").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return t.join(sums.select("no", "run", "base"), ["no", "run"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("base", "run", "step")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """row, doc_id, source, size, source_size, target and taken of every row of docs (doc_id, source, text; row if given).

    taken counts the words that the mix takes, repeats counted: at most cap times size, since no block is taken more than
    cap times. A null text has size 0; a null source is a source of its own, the last; rows with a null or repeated
    doc_id stand for themselves; other columns are ignored; where there are no words all targets and taken are 0; an
    empty table gives an empty result.
    """
    row = F.col("row") if "row" in docs.columns else F.lit(0).cast("long")
    sized = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.alias("row")))
    targets = checkpointed(source_targets(sized, weights, cap))
    slots = schedule(targets)
    total = Window.partitionBy(F.lit(0))
    edge = lambda b: F.least(F.floor(b * F.col("block")).cast("long"), F.col("source_size"))
    # words of a block: a slot's share of all words, so that a source's slots take what its target says
    block = stretches(targets).withColumn("block", F.sum("target").over(total) / F.col("slots")).where("source_size > 0").withColumns({
        "blocks": F.ceil(F.col("source_size") / F.col("block")).cast("long"), "n": F.col("to") - F.col("from"),
    })
    # the whole slots end at word stop of the source's row; rest words of the target are left, round and round from there
    block = block.withColumn("stop", edge(F.pmod(F.col("n"), F.col("blocks"))))
    block = block.withColumn("rest", F.greatest(F.round("target").cast("long") - F.floor(F.col("n") / F.col("blocks")).cast("long") * F.col("source_size") - F.col("stop"), F.lit(0).cast("long")))
    block = block.select("no", "source_size", "target", "block", "blocks", "stop", "rest")
    uses = slots.join(block.select("no", "blocks"), "no").where(F.col("rank") < cap * F.col("blocks")).groupBy("no", F.pmod(F.col("rank"), F.col("blocks")).alias("b")).agg(F.count("*").alias("uses"))
    placed = shuffled(sized.where("size > 0"), targets).join(block, "no")
    # how many of a document's words lie in [stop, stop + rest) of the row repeated: whole rounds and two stretches
    upto = lambda end: F.least(F.greatest(end - F.col("at"), F.lit(0).cast("long")), F.col("size"))
    end = F.col("stop") + F.col("rest") % F.col("source_size")
    more = F.floor(F.col("rest") / F.col("source_size")).cast("long") * F.col("size") + upto(end) - upto(F.col("stop")) + upto(end - F.col("source_size"))
    placed = placed.withColumn("more", more)
    first, last = F.floor(F.col("at") / F.col("block")).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")).cast("long") + 1
    last = F.least(last, F.col("blocks") - 1)
    pieces = placed.withColumn("b", F.explode(F.sequence(F.least(F.greatest(first - 1, F.lit(0)), last), last))).withColumn(
        "overlap", F.least(F.col("at") + F.col("size"), edge(F.col("b") + 1)) - F.greatest(F.col("at"), edge(F.col("b")))
    ).where("overlap > 0")
    keys = ["no", "doc_id", "source", "size", "row", "at", "more"]
    taken = pieces.join(uses, ["no", "b"], "left").groupBy(*keys).agg((F.sum(F.col("overlap") * F.coalesce("uses", F.lit(0))) + F.col("more")).alias("taken"))
    own = targets.select("no", "source_size", "target")
    none = sized.where("size = 0").join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    out = ["row", "doc_id", "source", "size", "source_size", "target", "taken"]
    return taken.join(own, "no").select(*out).unionByName(none.withColumn("taken", F.lit(0).cast("long")).select(*out))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, its sources weighted 5, 2, 1 in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "taken")
