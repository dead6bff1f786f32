"""Three-way change detection against the last snapshot, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units, values
from ..options import Options


def pairs(mapping: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Mapped items with both sides (columns prefixed ``left_`` and ``right_``), absent ones null."""
    a = left.select(*(F.col(c).alias(f"left_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns))
    rows = mapping.select(F.col("id").alias("mapping_id"), "left_item_id", "right_item_id")
    return rows.join(a, rows["left_item_id"] == a["left_id"], "left").join(b, rows["right_item_id"] == b["right_id"], "left")


def weight_changes(paired: DataFrame, then_left: DataFrame, then_right: DataFrame, options: Options) -> DataFrame:
    """Per pair: weights then and now, which side changed, and the action.

    A pair without a snapshot on either side is a first sight: it gets a baseline only.  For
    newest-wins ``paired`` has ``left_ts`` and ``right_ts`` (see ``with_times``).
    """
    rows = (
        paired.join(then_left.select(F.col("entity_id").alias("left_item_id"), F.col("remaining_weight").alias("left_then")), "left_item_id", "left")
        .join(then_right.select(F.col("entity_id").alias("right_item_id"), F.col("total_weight").alias("right_then")), "right_item_id", "left")
        .filter("left_id is not null and right_id is not null")
    )
    baseline = F.col("left_then").isNull() | F.col("right_then").isNull()
    left_changed = ~baseline & units.weight_changed(F.col("left_then"), F.col("left_remaining_weight"), options.weight_threshold)
    right_changed = ~baseline & units.weight_changed(F.col("right_then"), F.col("right_total_weight"), options.weight_threshold)
    act = values.action(left_changed, right_changed, F.lit(options.direction), F.lit(options.policy), *_times(rows))
    return rows.select(
        "left_item_id", "right_item_id", "left_then", F.col("left_remaining_weight").alias("left_now"), "right_then", F.col("right_total_weight").alias("right_now"),
        left_changed.alias("left_changed"), right_changed.alias("right_changed"), F.when(baseline, "baseline").otherwise(act).alias("action"),
    )


def weight_writes(changes: DataFrame, tare: Column, decimals: int = 1) -> DataFrame:
    """What a push to the right writes: a usage event for a decrease, a gross weight for an increase."""
    delta = F.round(F.col("left_then") - F.col("left_now"), 2)
    used = delta > 0
    return changes.filter("action = 'push_right'").select(
        "left_item_id", "right_item_id", F.when(used, "usage").otherwise("set").alias("kind"), F.when(used, delta).alias("grams"),
        F.when(used, F.round(F.col("right_now") - delta, 2)).otherwise(units.net_to_gross(F.col("left_now"), tare, decimals)).alias("total_weight"),
    )


def field_changes(now: DataFrame, then: DataFrame, options: Options, either_missing_is_first: bool = False, agree: bool = True) -> DataFrame:
    """The template of all field passes, over long rows.

    ``now`` is (pair, field, left, right), ``then`` (pair, field, left, right) from the snapshot,
    values in compare form.  A missing snapshot row means first sight; a null snapshot value on one
    side means it only if ``either_missing_is_first``.  With ``agree``, two sides that changed to
    the same value converge.  Rows may carry ``inherited``: equal values are skipped there and
    others are divergences from the master.
    """
    old = then.select("pair", "field", F.col("left").alias("left_then"), F.col("right").alias("right_then"), F.lit(True).alias("seen"))
    rows = now.join(old, ["pair", "field"], "left")
    missing = (F.col("left_then").isNull() | F.col("right_then").isNull()) if either_missing_is_first else (F.col("left_then").isNull() & F.col("right_then").isNull())
    baseline = F.col("seen").isNull() | missing
    left_changed, right_changed = values.differ(F.col("left"), F.col("left_then")), values.differ(F.col("right"), F.col("right_then"))
    equal = F.col("left").eqNullSafe(F.col("right"))
    act = values.action(left_changed, right_changed, F.lit(options.direction), F.lit(options.policy), *_times(rows))
    act = F.when(baseline, "baseline").otherwise(F.when(left_changed & right_changed & equal, "converge").otherwise(act) if agree else act)
    if "inherited" in now.columns:
        act = F.when(F.col("inherited") & equal, "skip").when(F.col("inherited") & (act == "push_right"), "master_divergence").otherwise(act)
    return rows.select("pair", "field", "left_then", "left", "right_then", "right", act.alias("action"))


def _times(rows: DataFrame) -> tuple[Column, Column]:
    """The times of both sides, void where the rows have none."""
    return tuple(F.col(c) if c in rows.columns else F.lit(None).cast("timestamp") for c in ("left_ts", "right_ts"))


def with_times(rows: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """``rows`` with the times that newest-wins compares.

    ``times`` has (key, last_used, registered, updated, captured_left, captured_right), the first
    three as ISO text.  The left time is that of the last use, else of the registration; either is
    void unless it is after the earlier capture.
    """
    anchor = F.least("captured_left", "captured_right")  # of one side where the other has none
    left = units.instant(F.coalesce(F.nullif("last_used", F.lit("")), "registered"))
    found = times.select(key, units.after(left, anchor).alias("left_ts"), units.after(units.instant(F.col("updated")), anchor).alias("right_ts"))
    return rows.join(found, key, "left")


def deletions(paired: DataFrame, xref_cleared: Column) -> DataFrame:
    """What becomes of pairs of which a side is gone."""
    no_left, no_right = F.col("left_id").isNull(), F.col("right_id").isNull()
    fate = F.when(no_left & no_right, "purge").when(no_left, "conflict").when(no_right & xref_cleared, "purge").when(no_right, "conflict")
    return paired.filter(no_left | no_right).select("left_item_id", "right_item_id", fate.alias("fate"))


def identity_changes(rows: DataFrame, options: Options) -> DataFrame:
    """Fills the empty side of an identity by direction; two different ones go to the policy.  No snapshot is read."""
    a, b = F.nullif(F.trim("left_uuid"), F.lit("")), F.nullif(F.trim("right_uuid"), F.lit(""))
    both = values.action(F.lit(True), F.lit(True), F.lit(options.direction), F.lit(options.policy), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))
    act = F.when(a.eqNullSafe(b), "noop").when(b.isNull(), F.lit("noop" if options.direction == "right_to_left" else "push_right")).when(a.isNull(), F.lit("noop" if options.direction == "left_to_right" else "push_left")).otherwise(both)
    return rows.select("pair", act.alias("action"))


def new_records(items: DataFrame, mapping: DataFrame, product_mapping: DataFrame, auto_create: bool) -> DataFrame:
    """Active items without a mapping: create under a mapped product, import the product, or ask."""
    free = items.filter(~F.col("archived")).join(mapping.select(F.col("left_item_id").alias("id")), "id", "left_anti")
    known = product_mapping.select(F.col("left_id").alias("product_id"), F.lit(True).alias("known"))
    route = F.when(~F.lit(auto_create), "conflict").when(F.col("known"), "create_item").otherwise("import_product")
    return free.join(known, "product_id", "left").select("id", "product_id", F.coalesce("known", F.lit(False)).alias("product_mapped"), (F.coalesce("remaining_weight", F.lit(0.0)) <= 0).alias("empty"), route.alias("route"))


def new_item_routes(live: DataFrame, mapped: DataFrame, products: DataFrame, held: DataFrame | None) -> DataFrame:
    """Live items (id, product_id, weight) of one side that nothing is mapped to: under a mapped product the item is
    created, else the product imported; products of ``held`` wait for the user's choice of how families are formed."""
    free = live.join(mapped, "id", "left_anti").join(products.distinct().withColumn("known", F.lit(True)), "product_id", "left")
    waiting = F.lit(False)
    if held is not None:
        free = free.join(held.withColumn("held", F.lit(True)), "product_id", "left")
        waiting = F.coalesce("held", F.lit(False))
    known = F.coalesce("known", F.lit(False))
    route = F.when(waiting & ~known, "held").when(known, "create_item").otherwise("import_product")
    return free.select(F.col("id").cast("string").alias("record"), route.alias("route"), (F.coalesce("weight", F.lit(0.0)) <= 0).alias("empty"))
