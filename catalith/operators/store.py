"""Store operators over the entry table: statistics, lookups, scopes, commits and compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.schema import DELETED, DIRTY


def is_deleted(flags: Column | str = "flags") -> Column:
    return F.col(flags).bitwiseAND(DELETED) == DELETED if isinstance(flags, str) else flags.bitwiseAND(DELETED) == DELETED


def live(entries: DataFrame) -> DataFrame:
    return entries.where(~is_deleted())


def corpus_stats(entries: DataFrame) -> DataFrame:
    """Entries, assets and tombstones by directory, value kind and element type. One partial aggregation, one shuffle."""
    return entries.groupBy("ifd", "value_kind", "elem_type").agg(
        F.count("*").alias("n_entries"), F.countDistinct("asset_id").alias("n_assets"), F.sum(is_deleted().cast("long")).alias("n_deleted"),
    )


def duplicate_keys(entries: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """The keys that most often come more than once within an asset, by number of live entries."""
    per = live(entries).groupBy("asset_id", *keys).agg(F.count("*").alias("n")).where("n > 1")
    return per.groupBy(*keys).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_entries")).orderBy(F.desc("n_entries"), *keys).limit(top)


def key_runs(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per asset and key: how many live entries, and the lowest id that represents them."""
    return live(entries).groupBy("asset_id", *keys).agg(F.count("*").alias("n"), F.min("entry_id").alias("first_id"))


def block_spans(entries: DataFrame) -> DataFrame:
    """Per block: its entries and where its span begins in the block order of its asset."""
    per = entries.groupBy("asset_id", "block_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("asset_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))


def find_all(entries: DataFrame, **key: object) -> DataFrame:
    """Live entries with exactly this key. Over a stored entry table the predicates reach the scan; over entries made
    from other columns (see sources.bridge) they are applied once these are made."""
    out = live(entries)
    for k, v in key.items():
        out = out.where(F.col(k) == F.lit(v))
    return out


#: Distinct selectors up to which a scope is a condition of the plan.
SCOPE_TERMS = 256


def in_scope(entries: DataFrame, selectors: DataFrame | None) -> DataFrame:
    """Entries whose (block, directory) a selector names; an empty directory in a selector means any. None: all.

    There are few blocks, each with many entries, so a join by block would put a large share of all entries into one task.
    Up to SCOPE_TERMS distinct selectors become a condition on each entry, without a join; more are joined.
    """
    if selectors is None:
        return entries
    s = selectors.select(F.col("block_id").alias("s_block"), F.col("ifd").alias("s_ifd")).where("s_block is not null and s_ifd is not null").distinct()
    few = s.limit(SCOPE_TERMS + 1).collect()
    if len(few) <= SCOPE_TERMS:
        any_ifd = sorted({x.s_block for x in few if x.s_ifd == ""})
        one_ifd: dict[str, list] = {}
        for x in few:
            if x.s_ifd and x.s_block not in any_ifd:
                one_ifd.setdefault(x.s_ifd, []).append(x.s_block)
        hit = F.col("block_id").isin(any_ifd)
        for ifd, blocks in sorted(one_ifd.items()):
            hit = hit | ((F.col("ifd") == ifd) & F.col("block_id").isin(sorted(blocks)))
        return entries.where(hit)
    return entries.join(s, (F.col("block_id") == F.col("s_block")) & ((F.col("s_ifd") == "") | (F.col("s_ifd") == F.col("ifd"))), "left_semi")


def companion(base: DataFrame, entries: DataFrame, tag: int, name: str) -> DataFrame:
    """base with the first live entry of tag in the same asset, block and directory (null if there is none)."""
    own = find_all(entries, tag=tag).groupBy("asset_id", "block_id", "ifd").agg(F.min("entry_id").alias(name))
    return base.join(own, ["asset_id", "block_id", "ifd"], "left")


def companions(base: DataFrame, entries: DataFrame, tags: dict[str, int], inherit: DataFrame | None = None) -> DataFrame:
    """base with a struct (id, text) for each name in tags: the first live entry of that tag beside the base entry.

    Beside means the same asset, block and directory. With inherit (block_id, ifd; an empty directory is any), an entry in
    one of these of the same asset serves where none is beside. Null without one. All tags are gathered in one
    aggregation a level, whatever their number.
    """
    own = live(entries).where(F.col("tag").isin(*tags.values()) & F.col("v_text").isNotNull())
    first = lambda t: F.min(F.when(F.col("tag") == t, F.struct(F.col("entry_id").alias("id"), F.col("v_text").alias("text"))))
    beside = own.groupBy("asset_id", "block_id", "ifd").agg(*[first(t).alias(n) for n, t in tags.items()])
    out = base.join(beside, ["asset_id", "block_id", "ifd"], "left")
    if inherit is None:
        return out
    other = in_scope(own, inherit).groupBy("asset_id").agg(*[first(t).alias(f"_other_{n}") for n, t in tags.items()])
    out = out.join(other, "asset_id", "left")
    return out.select(*base.columns, *[F.coalesce(n, f"_other_{n}").alias(n) for n in tags])


def commit(base: DataFrame, edits: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Apply edits (asset_id, seq, op in add/set/tombstone, target_id, v_double) to base (asset_id, entry_id, v_double, flags).

    Set replaces the value and marks it dirty; tombstone marks deleted and dirty; adds get the next ids in seq order.
    With max_entries, an asset whose commit would exceed it keeps its base unchanged. An asset without base entries gets
    what is added, numbered from 0.
    """
    change = edits.where("op <> 'add'").groupBy("asset_id", F.col("target_id").alias("entry_id")).agg(
        F.max_by("v_double", F.when(F.col("op") == "set", F.col("seq"))).alias("new_v"), F.max(F.col("op") == "set").alias("has_set"), F.max(F.col("op") == "tombstone").alias("gone")
    )
    sizes = base.groupBy("asset_id").agg(F.count("*").alias("size"), F.max("entry_id").alias("last"))
    adds = edits.where("op = 'add'").withColumn("k", F.row_number().over(Window.partitionBy("asset_id").orderBy("seq")))
    n_adds = adds.groupBy("asset_id").agg(F.count("*").alias("adds"))
    ok = F.lit(True) if max_entries is None else F.coalesce("size", F.lit(0)) + F.coalesce("adds", F.lit(0)) <= max_entries
    allowed = sizes.join(n_adds, "asset_id", "full_outer").select("asset_id", F.coalesce("last", F.lit(-1)).alias("last"), ok.alias("ok"))
    changed = base.join(change, ["asset_id", "entry_id"], "left").join(allowed, "asset_id")
    apply = F.col("ok") & (F.coalesce("has_set", F.lit(False)) | F.coalesce("gone", F.lit(False)))
    old = changed.select(
        "asset_id", "entry_id", F.when(F.col("ok") & F.coalesce("has_set", F.lit(False)), F.col("new_v")).otherwise(F.col("v_double")).alias("v_double"),
        F.when(apply, F.col("flags").bitwiseOR(F.when(F.coalesce("gone", F.lit(False)), DELETED | DIRTY).otherwise(DIRTY))).otherwise(F.col("flags")).alias("flags"),
    )
    new = adds.join(allowed.where("ok"), "asset_id").select("asset_id", (F.col("last") + F.col("k")).alias("entry_id"), "v_double", F.lit(DIRTY).alias("flags"))
    return old.unionByName(new)


def compact(entries: DataFrame) -> DataFrame:
    """Without tombstones; ids dense again in the old order."""
    w = Window.partitionBy("asset_id").orderBy("entry_id")
    return live(entries).withColumn("entry_id", F.row_number().over(w).cast("long") - 1)
