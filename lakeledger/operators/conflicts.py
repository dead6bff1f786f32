"""The conflict queue: stable ids, no duplicates, self-healing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entity_type", "left_id", "field_name", "conflict_type"]


def open_ones(conflicts: DataFrame) -> DataFrame:
    return conflicts.filter("resolved_at is null")


def queue(conflicts: DataFrame, found: DataFrame) -> DataFrame:
    """Conflicts to append: found keys that no open one has, with ids after the greatest.

    Ids are numbered over hash shards, whose sizes are summed first, so no task sees all rows.
    """
    there = open_ones(conflicts).select(*(F.col(c).alias(f"_{c}") for c in KEY))
    fresh = found.dropDuplicates(KEY)
    fresh = fresh.join(there, [fresh[c].eqNullSafe(there[f"_{c}"]) for c in KEY], "left_anti")
    top = conflicts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return numbered(fresh, KEY).crossJoin(F.broadcast(top)).withColumn("id", F.col("n") + F.col("top")).drop("n", "top")  # one row


def numbered(rows: DataFrame, order: list[str], shards: int = 64) -> DataFrame:
    """``rows`` with ``n`` from 1: by shard of the key's hash, then by the key."""
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards)))
    sizes = dealt.groupBy("_shard").count()  # one row per shard
    before = F.coalesce(F.sum("count").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_shard", before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("_shard").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "_shard").withColumn("n", at + F.col("_before")).drop("_shard", "_before")


def prune_duplicates(conflicts: DataFrame) -> DataFrame:
    """Open conflicts of one key but the oldest, which is to be kept."""
    first = open_ones(conflicts).groupBy(*KEY).agg(F.min("id").alias("keep"))
    rows = open_ones(conflicts)
    return rows.join(first, [rows[c].eqNullSafe(first[c]) for c in KEY]).filter("id > keep").select("id", "keep")


def resolve_stale(conflicts: DataFrame, items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Open new-record conflicts that are settled: the item is mapped, archived, empty or gone."""
    rows = open_ones(conflicts).filter("conflict_type = 'new_record'").select("id", "left_id")
    state = items.select(F.col("id").alias("left_id"), "archived", (F.coalesce("remaining_weight", F.lit(0.0)) <= 0).alias("empty"), F.lit(True).alias("there"))
    mapped = mapping.select(F.col("left_item_id").alias("left_id"), F.lit(True).alias("mapped"))
    why = F.when(F.col("mapped"), "mapped").when(F.col("there").isNull(), "gone").when(F.col("archived"), "archived").when(F.col("empty"), "empty")
    return rows.join(mapped, "left_id", "left").join(state, "left_id", "left").select("id", "left_id", why.alias("reason")).filter("reason is not null")


def self_heal(conflicts: DataFrame, paired: DataFrame) -> DataFrame:
    """Open deletion conflicts whose two sides are back."""
    back = paired.filter("left_id is not null and right_id is not null").select(F.col("left_item_id").alias("left_id"))
    return open_ones(conflicts).filter("conflict_type = 'deletion'").join(back, "left_id", "left_semi").select("id", "left_id")


def counts_by(conflicts: DataFrame, *columns: str) -> DataFrame:
    return open_ones(conflicts).groupBy(*columns).agg(F.count("*").alias("n"))


def first_open(conflicts: DataFrame) -> DataFrame:
    """The first open conflict of each entity."""
    return open_ones(conflicts).groupBy("entity_type", "left_id").agg(F.min("id").alias("conflict_id"))
