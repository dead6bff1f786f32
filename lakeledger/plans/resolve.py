"""What resolving conflicts does: one frame of actions, each row standing or failing alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units

#: Fields for which a typed-in value makes no sense.
NOT_BY_HAND = ("color", "multicolor", "finish_tags")
NUMERIC = ("weight", "cost", "spool_weight", "nozzle_temp", "bed_temp", "density", "diameter")


def choose(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decided conflicts (id, resolution, manual) with the chosen value and whether they can be applied."""
    open_ = conflicts.filter("resolved_at is null").select("id", "entity_type", "left_id", "field_name", "left_value", "right_value")  # a queue has resolutions of its own
    rows = decisions.join(open_, "id", "left")
    value = F.when(F.col("resolution") == "left", F.col("left_value")).when(F.col("resolution") == "right", F.col("right_value")).when(F.col("resolution") == "manual", F.col("manual"))
    bad_number = F.col("field_name").isin(*NUMERIC) & value.isNotNull() & value.try_cast("double").isNull()
    error = (
        F.when(F.col("field_name").isNull(), "not open")
        .when(~F.col("resolution").isin("left", "right", "manual"), "unknown resolution")
        .when((F.col("resolution") == "manual") & F.col("field_name").isin(*NOT_BY_HAND), "not by hand")
        .when(bad_number, "not a number")
    )
    return rows.select("id", "entity_type", "left_id", "field_name", "resolution", value.alias("value"), error.alias("error"))


def writes(chosen: DataFrame) -> DataFrame:
    """Writes of the valid decisions: to the side that did not win, or to both by hand."""
    rows = chosen.filter("error is null")
    sides = F.when(F.col("resolution") == "left", F.array(F.lit("right"))).when(F.col("resolution") == "right", F.array(F.lit("left"))).otherwise(F.array(F.lit("left"), F.lit("right")))
    normal = F.when(F.col("field_name").isin("nozzle_temp", "bed_temp"), units.as_temperature(F.col("value")).cast("string")).when(F.col("field_name").isin(*NUMERIC), units.as_amount(F.col("value")).cast("string")).otherwise(F.col("value"))
    return rows.select("id", F.explode(sides).alias("side"), "entity_type", "left_id", "field_name", normal.alias("value"))


def resolved(conflicts: DataFrame, chosen: DataFrame, now) -> DataFrame:
    """The conflict table after the decisions."""
    done = chosen.filter("error is null").select("id", F.col("resolution").alias("_how"), F.col("value").alias("_value"))
    rows = conflicts.join(done, "id", "left")
    names = [c for c in conflicts.columns if c not in ("resolved_at", "resolution", "resolved_value")]
    return rows.select(*names, F.when(F.col("_how").isNotNull(), now).otherwise(F.col("resolved_at")).alias("resolved_at"), F.coalesce("_how", "resolution").alias("resolution"), F.coalesce("_value", "resolved_value").alias("resolved_value"))


def converge_weight(rows: DataFrame) -> DataFrame:
    """An absolute weight: a usage event if it is lower than the current one, a set if higher."""
    delta = F.round(F.col("current") - F.col("target"), 2)
    return rows.select("id", F.when(delta > 0, "usage").when(delta < 0, "set").otherwise("none").alias("kind"), F.when(delta > 0, delta).alias("grams"), units.clamp(F.col("target")).alias("weight"))


def divergence(decision: DataFrame, variants: DataFrame) -> DataFrame:
    """Writes for a value that differs from its master's, field by field id.

    apply_all: the master takes the value and its overriding variants follow; variant_override:
    only the variant; ignore: nothing, but the baseline moves.
    """
    rows = decision.join(variants.select("variant_id", "master_id"), "variant_id")
    everyone = variants.select("master_id", F.col("variant_id").alias("_sibling"), "overrides")
    to_all = rows.filter("how = 'apply_all'")
    to_master = to_all.select(F.col("master_id").alias("right_id"), "field", "value")
    to_siblings = to_all.join(everyone.filter("overrides"), "master_id").select(F.col("_sibling").alias("right_id"), "field", "value")
    to_one = rows.filter("how = 'variant_override'").select(F.col("variant_id").alias("right_id"), "field", "value")
    return to_master.unionByName(to_siblings).unionByName(to_one).distinct()


def siblings_settled(conflicts: DataFrame, decision: DataFrame, variants: DataFrame) -> DataFrame:
    """Open divergences of the same master and field, settled by an apply_all."""
    done = decision.filter("how = 'apply_all'").join(variants.select("variant_id", "master_id"), "variant_id").select("master_id", "field")
    rows = conflicts.filter("resolved_at is null and conflict_type = 'master_divergence'").join(variants.select("variant_id", "master_id"), "variant_id")
    return rows.join(done.withColumnRenamed("field", "field_name"), ["master_id", "field_name"], "left_semi").select("id")


def import_records(conflicts: DataFrame, items: DataFrame, product_mapping: DataFrame, item_mapping: DataFrame) -> DataFrame:
    """What importing the left item of each open new-record conflict does, or why it cannot be done."""
    known = product_mapping.groupBy(F.col("left_id").alias("product_id")).agg(F.min("right_id").alias("right_id"))
    live = items.select(F.col("id").alias("left_id"), "product_id", "archived", (F.coalesce("remaining_weight", F.lit(0.0)) <= 0).alias("empty"))
    mapped = item_mapping.select(F.col("left_item_id").alias("left_id"), F.lit(True).alias("mapped"))
    rows = conflicts.filter("resolved_at is null").select("id", "left_id").join(live, "left_id", "left").join(mapped, "left_id", "left").join(known, "product_id", "left")
    error = F.when(F.col("product_id").isNull(), "record is gone").when(F.col("mapped"), "already mapped").when(F.col("archived"), "archived").when(F.col("empty"), "empty")
    act = F.when(error.isNotNull(), None).when(F.col("right_id").isNull(), "create_product_and_item").otherwise("create_item")
    return rows.select("id", "left_id", "product_id", "right_id", error.alias("error"), act.alias("action"))
